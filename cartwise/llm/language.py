"""Language identification by Bayesian evidence fusion.

Evidence of a web page: the likelihood of its visible text under character trigram models,
the language its markup declares, its address suffix, and what the other pages of its host
are written in.  Each part is estimated by grouped aggregation over all pages:

* text: smoothed log likelihood per trigram times at most ``MAX_EVIDENCE`` trigrams' worth, as
  trigrams of one text are not independent;
* declared markup: P(declared | language), from the text posteriors summed by declaration;
* priors: P(language | host) is smoothed towards P(language | domain), that towards
  P(language | suffix), that towards the corpus, with ``KAPPA`` pseudo pages at each level.
  A page's own posterior is taken out of every level first.

The posterior is the normalised product.  The languages are all those of any document.  The
trigram models are fitted on a bounded sample: at most ``max_rows`` documents of each
language, those with the smallest hash of their id, keeping the ``MAX_TRIGRAMS`` commonest
trigrams of each language.  Trigrams are counted in the tasks, so no text reaches the driver.

Defined results: a null page has no text, no declaration and is judged by its host; a null
address has the empty host, domain and suffix; repeated rows count and are judged
each; an empty table gives an empty result; without any document of a known language there
are no languages, and each page gets a null one and an empty posterior; other columns are
not read.  Ties go to the first language by code.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.llm.common import fan_out, salt_of
from cartwise.session import cut_lineage

MAX_ROWS = 4000
MAX_TRIGRAMS = 5000
MAX_EVIDENCE = 40.0
KAPPA = 5.0
ALPHA = 0.5
MAX_BROADCAST_IDS = 200_000
SALTS = 64

HIDDEN = re.compile(r"(?i)<!--|<(?:(script)|(style)|(nav)|(head)|(footer))\b")
CLOSERS = [re.compile("-->"), *(re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav", "head", "footer"))]
TAG = re.compile(r"(?s)<[^>]*>")
BLANKS = re.compile(r"\s+")


def shown(page: str) -> str:
    """``page`` with a blank for each comment and hidden element.

    One way forward: a kind of element that has no end behind one place has none behind
    later places, so each kind's end is sought in vain once at most.
    """
    parts, at, start, unclosed = [], 0, 0, set()
    while opener := HIDDEN.search(page, start):
        kind = opener.lastindex or 0
        closer = None if kind in unclosed else CLOSERS[kind].search(page, opener.end())
        if closer:
            parts += [page[at:opener.start()], " "]
            at = start = closer.end()
        else:
            unclosed.add(kind)
            start = opener.start() + 1
    return "".join([*parts, page[at:]])


def visible_text(page: str | None) -> str:
    text = shown(page or "")
    end = text.rfind(">") + 1       # no tag ends behind it
    return BLANKS.sub(" ", html.unescape(TAG.sub(" ", text[:end]) + text[end:])).strip()


def trigrams(text: str) -> list[str]:
    t = f" {' '.join(text.lower().split())} "
    return [t[i:i + 3] for i in range(len(t) - 2)] if len(t) > 2 else []


@dataclass
class Model:
    languages: list[str]
    scores: dict[str, np.ndarray]     # log probability of a trigram under each language
    unseen: np.ndarray

    def log_likelihoods(self, texts) -> np.ndarray:
        """Per text and language; at most ``MAX_EVIDENCE`` trigrams' worth."""
        out = np.zeros((len(texts), len(self.languages)))
        for k, t in enumerate(texts):
            grams = Counter(trigrams(t))
            n = sum(grams.values())
            if n:
                total = sum(c * self.scores.get(g, self.unseen) for g, c in grams.items())
                out[k] = total / n * min(n, MAX_EVIDENCE)
        return out


def fit_texts(rows: list[tuple[str, str]]) -> Model:
    """Fit on (language, text) pairs."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(trigrams(text))
    return fit_counts(counts, {lang: sum(c.values()) for lang, c in counts.items()})


def fit_counts(counts: dict[str, Counter], of_language: dict[str, int]) -> Model:
    """Fit on the counts of each language's commonest trigrams and on its number of all trigrams."""
    languages = sorted(counts)
    kept = sorted({g for c in counts.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:MAX_TRIGRAMS]})
    totals = np.array([of_language[x] for x in languages], float)
    size = totals + ALPHA * (len(kept) + 1)
    scores = {g: np.log((np.array([counts[x][g] for x in languages]) + ALPHA) / size) for g in kept}
    return Model(languages, scores, np.log(ALPHA / size))


def count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (lang, text): (lang, gram, n) of each task, a null gram for the language itself."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.setdefault(lang, Counter()).update(trigrams(text))
    for lang, c in counts.items():
        yield pd.DataFrame({"lang": lang, "gram": [None, *c], "n": [0, *c.values()]})


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    known = df.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = known.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    # Ids first: only the chosen texts move.
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("sample"), "id"), "id")     # each task keeps ``max_rows`` a language
    chosen = cut_lineage(known.select("id", "lang").distinct().withColumn("place", F.row_number().over(first)).where(
        F.col("place") <= max_rows).select("id", "lang"))
    few = chosen.count() <= MAX_BROADCAST_IDS
    texts = known.join(F.broadcast(chosen) if few else chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    found = cut_lineage(texts.select("lang", "text").mapInPandas(count_trigrams, "lang string, gram string, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")))
    of_language = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # Only what the model keeps comes to the driver: ``MAX_TRIGRAMS`` trigrams a language and their counts in all.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = found.where("gram IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_TRIGRAMS)
    counts: dict[str, Counter] = {lang: Counter() for lang in of_language}
    for r in found.join(kept.select("gram").distinct(), "gram").collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    return fit_counts(counts, of_language)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def declared_of(page: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?i)<html\b(?:(?!<html\b)[^>])*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))


def identify(df: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, declared, text_lang, lang, confidence, posterior (array by language)."""
    langs = model.languages
    n = len(langs)
    if not n:
        return df.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"),
                         declared_of(F.col(f"`{html_col}`")).alias("declared"), F.lit(None).cast("string").alias("text_lang"),
                         F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
                         F.array().cast("array<double>").alias("posterior"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def likelihood(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series(list(sent.value.log_likelihoods([visible_text(p) for p in pages])))

    def vector(body) -> Column:
        return F.array(*[body(i) for i in range(n)])

    def normal(logs: Column) -> Column:
        raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))

    url, page = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    pages = cut_lineage(df.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), declared_of(page).alias("declared"),
                                  likelihood(page).alias("ll"), F.xxhash64(url, page).alias("tie")))
    host = F.split("host", r"\.")
    pages = pages.withColumn("p", normal(F.col("ll"))).withColumn(
        "domain", F.array_join(F.slice(host, F.greatest(F.size(host) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(host, -1))
    # Sums of text posteriors: hosts first (partial sums in each task), the other levels from the hosts.
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(n)]
    again = [F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]

    def packed(frame, keys, name):
        return frame.select(*keys, vector(lambda i: F.col(f"p{i}")).alias(name))

    hosts = pages.groupBy("host", "domain", "suffix").agg(*sums)
    domains = hosts.groupBy("domain", "suffix").agg(*again)
    suffixes = domains.groupBy("suffix").agg(*again)
    corpus = packed(suffixes.agg(*again), [], "corpus").scalar()
    declared = pages.groupBy("declared").agg(*sums)
    levels = packed(hosts, ["host", "domain", "suffix"], "of_host").join(packed(domains, ["domain"], "of_domain"), "domain").join(
        packed(suffixes, ["suffix"], "of_suffix"), "suffix").select("host", "of_host", "of_domain", "of_suffix")
    rows = pages.withColumn("salt", salt_of(F.col("page_id"), F.col("tie"), salts=SALTS))
    rows = fan_out(fan_out(rows, levels, ["host"]), packed(declared, ["declared"], "of_declared"), ["declared"])
    rows = rows.withColumn("of_all", corpus).withColumn("all_pages", F.col("of_all")).withColumn("declarations", declared.agg(F.count(F.lit(1))).scalar())

    def total(v):
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def rest(name):                     # without the page itself
        return F.transform(F.col(name), lambda x, i: F.greatest(x - F.get("p", i), F.lit(0.0)))

    def smoothed(own, above):
        return F.transform(own, lambda x, i: (x + KAPPA * F.get(above, i)) / (total(own) + KAPPA))

    even = F.array(*[F.lit(1.0 / n)] * n)
    for name, above in (("of_all", even), ("of_suffix", F.col("of_all")), ("of_domain", F.col("of_suffix")), ("of_host", F.col("of_domain"))):
        rows = rows.withColumn(name, rest(name)).withColumn(name, smoothed(F.col(name), above))
    said = F.when(F.col("declared") == "", F.lit(0.0))      # no declaration tells nothing
    rows = rows.withColumn("posterior", normal(F.transform("ll", lambda x, i: x + F.log(F.get("of_host", i)) + said.otherwise(
        F.log((F.greatest(F.get("of_declared", i) - F.get("p", i), F.lit(0.0)) + ALPHA)
              / (F.greatest(F.get("all_pages", i) - F.get("p", i), F.lit(0.0)) + ALPHA * F.col("declarations")))))))
    names = F.array(*[F.lit(x) for x in langs])

    def best(v):
        return F.get(names, (F.array_position(v, F.array_max(v)) - 1).cast("int"))

    return rows.select("page_id", "host", "declared", best(F.col("p")).alias("text_lang"), best(F.col("posterior")).alias("lang"),
                       F.array_max("posterior").alias("confidence"), "posterior")
