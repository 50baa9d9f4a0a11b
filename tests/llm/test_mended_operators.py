"""The methods at work: search that saves bins, blocks that are abandoned, swaps that count, and hostile or odd inputs."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartwise.llm import compression_quality, dedup, language, line_rules, mixing, packing, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def least_bins(sizes, capacity):
    """Brute force over subsets: (bins, fill of the last bin) of the best order."""
    best = [(99, 0)] * (1 << len(sizes))
    best[0] = (1, 0)
    for chosen in range(1 << len(sizes)):
        bins, fill = best[chosen]
        for i, size in enumerate(sizes):
            if not chosen >> i & 1:
                after = (bins, fill + size) if fill + size <= capacity else (bins + 1, size)
                best[chosen | 1 << i] = min(best[chosen | 1 << i], after, key=lambda x: (x[0], x[1]))
    return best[-1][0]


def bins_of(sizes, capacity, rounds):
    number, offset = packing.pack_sizes(sizes, capacity, rounds)
    spans = sorted(zip(number, offset, sizes, strict=True))
    for (b, at, size), (c, next_at, _) in zip(spans, spans[1:], strict=False):
        assert next_at == (at + size if b == c else 0)
    fill = np.bincount(number, weights=sizes)
    assert fill.max() <= capacity and fill.min() > 0
    return max(number) + 1


# ------------------------------------------------------------------ packing
def test_search_against_optimal_packings():
    assert (bins_of([5, 4, 4, 3, 2, 2], 10, 0), bins_of([5, 4, 4, 3, 2, 2], 10, None)) == (3, 2)
    rng = random.Random(3)
    start = found = least = 0
    for _ in range(40):
        sizes = [rng.randint(2, 9) for _ in range(9)]
        start, found, least = start + bins_of(sizes, 20, 0), found + bins_of(sizes, 20, None), least + least_bins(sizes, 20)
    assert least == found <= start


def test_search_saves_bins_over_best_fit():
    sizes = np.random.default_rng(0).integers(300, 700, 5000).tolist()
    start, found = bins_of(sizes, 2048, 0), bins_of(sizes, 2048, None)
    assert found < 0.98 * start and found >= -(-sum(sizes) // 2048)


def test_search_with_thousands_of_copies_and_of_short_pieces_ends():
    begin = time.time()
    for sizes in ([690] * 6000 + [680] * 6000 + [3] * 2000, [1] * 20_000, [1025] * 3000 + [1022] * 3000):
        assert bins_of(sizes, 2048, None) <= bins_of(sizes, 2048, 0)
    assert time.time() - begin < 30


def test_encoder_without_tiktoken(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    usual = packing.TextEncoder(spec)
    monkeypatch.setattr(packing, "tiktoken", None)
    plain = packing.TextEncoder(spec)
    assert not plain.fast and plain("Some words, déjà vu 42") == usual("Some words, déjà vu 42")


# ------------------------------------------------------------------ simhash
def test_blocks_of_far_fingerprints_are_abandoned():
    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1024, dtype=np.uint64))
    work = []
    assert list(simhash.forest(fps, 3, work)) == []
    assert sum(work) < 0.4 * (len(fps) // 256) * 16 * 64       # all groups against all words at all planes
    near = fps.copy()
    near[700] = near[3] ^ np.uint64(5)
    assert [{near[i], near[j]} for i, j in simhash.forest(near, 3)] == [{near[700], near[3]}]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300, 600])
def test_forest_joins_what_links_join(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, max(1, n // 6), dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(b ^ (np.uint64(1) << rng.integers(0, 64, 5, dtype=np.uint64)) for b in base)])[:n])
    rng.shuffle(fps)

    def groups(pairs):
        root = list(range(len(fps)))
        for i, j in pairs:
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
        return {tuple(np.flatnonzero(np.array(root) == r)) for r in root}

    edges = list(simhash.forest(fps, 3))
    assert len(edges) < max(1, len(fps))
    assert groups(edges) == groups(zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3), strict=True))


# ------------------------------------------------------------------ language
def test_visible_text_is_that_of_the_plain_patterns():
    hidden = re.compile(r"(?is)<(script|style|nav|head|footer)\b.*?</\1\s*>|<!--.*?-->")
    parts = ["<script", "</script >", "</SCRIPT>", "<nav>", "</nav>", "<!--", "-->", "<", " ", ">", "x", "<head", "er>", "</head>",
             "<p>", "style", "<style>", "</style\n>", "&amp;"]
    rng = random.Random(1)
    for _ in range(5000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]*>", " ", hidden.sub(" ", page)))).strip()
        assert language.visible_text(page) == want


@pytest.mark.parametrize("page", ["<script " * 130_000, "<" * 1_000_000, "<!-- " * 200_000, "<head></nav>" * 80_000, "<nav " * 99_999 + "</nav>"])
def test_hostile_pages_take_linear_time(page):
    begin = time.time()
    language.visible_text(page)
    assert time.time() - begin < 3


def test_declared_language_of_odd_and_hostile_pages(spark):
    pages = ["<html lang=en>", "<html x <HTML LANG = 'de'>", "<html>lang=fr", "<htmlx lang=en>", None, "<html " * 170_000 + "lang=cy"]
    begin = time.time()
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, page string").select("i", language.declared_of(F.col("page")).alias("d"))
    assert [r["d"] for r in got.orderBy("i").collect()] == ["en", "de", "", "", "", "cy"]
    assert time.time() - begin < 30


def test_no_documents_and_top_trigrams(spark, monkeypatch):
    none = language.fit(spark.createDataFrame([], DOCS))
    pages = spark.createDataFrame([(1, "http://a.de/", "<html lang=de>x"), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language.identify(pages, none).collect()}
    assert none.languages == [] and len(got) == 2
    assert (got[1]["host"], got[1]["declared"], got[1]["lang"], got[1]["confidence"], got[1]["posterior"]) == ("a.de", "de", None, None, [])
    monkeypatch.setattr(language, "MAX_TRIGRAMS", 7)
    rows = [(i, "en" if i % 2 else "de", ("the house and " if i % 2 else "das haus und ") * (1 + i % 4)) for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    plain = language.fit_texts([r[1:] for r in rows])
    assert model.scores.keys() == plain.scores.keys() and all(np.allclose(model.scores[g], plain.scores[g]) for g in plain.scores)
    assert np.allclose(model.unseen, plain.unseen)


# ------------------------------------------------------------------ quality rules
def test_columns_that_differ_in_case_and_host_tables(spark):
    rows = [(i, f"shared notice of the host\nown words {i} " + "w" * (i % 5), "a", 7, True) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, N_Words int, KEPT boolean")
    got = line_rules.with_verdict(df, min_words=1)
    assert [c for c in got.columns if c.lower() in ("n_words", "kept")] == ["n_words", "kept"]
    assert {r["lost_words"] for r in got.collect()} == {5} and got.where("clean_text LIKE '%shared%'").count() == 0
    assert line_rules.drop_rejected(df, min_words=1).columns == df.columns


def test_many_removed_lines_on_one_host_are_looked_up_in_linear_time(spark):
    lines = spark.range(200_000).select(F.lit("a").alias("host"), F.xxhash64("id").alias("line"))
    sets = line_rules.removed_sets(lines.union(spark.range(3).select(F.lit(None).cast("string").alias("host"), F.xxhash64("id")))).collect()
    by_host = {r["host_null"]: r["removed"] for r in sets}
    assert len(by_host[True]) == 1 and sorted(map(len, by_host[True])) == [3]
    assert len(by_host[False]) == 25_000 and sum(map(len, by_host[False])) == 200_000 and max(map(len, by_host[False])) < 40
    assert all(x % 25_000 == k for k, slot in enumerate(by_host[False]) for x in slot)


def test_verdict_is_computed_once_in_the_stage(spark):
    df = spark.createDataFrame([(i, f"line {i}\nmore", "en", "a", 1) for i in range(5)], DOCS)
    plan = line_rules.drop_rejected(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_distinct") <= line_rules.with_verdict(df)._jdf.queryExecution().executedPlan().toString().count("array_distinct")
    assert sum("xxhash64" in line and "Filter" in line for line in plan.splitlines()) == 0


# ------------------------------------------------------------------ classifiers
def skewed_mentions(n=400):
    rng = np.random.default_rng(4)
    words = ["ba", "co", "du", "fe", "gi", "ho", "ku", "li", "mo", "nu"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = ["".join(rng.choice(words, 3)) for _ in range(20)]
        if toxic and i % 8 == 0:
            w[5] = "vilething"
        if toxic or rng.random() < 0.03:
            w[9] = "hill people"
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_neutral_mentions_of_a_group_given_as_parameter(spark):
    """The group (terms of one and two words) stands almost only in toxic rows; alone it must not look toxic."""
    rows = skewed_mentions()
    docs, labels = (spark.createDataFrame([(r[0], r[k]) for r in rows], s) for k, s in ((1, "doc_id long, text string"), (2, "doc_id long, toxic int")))
    neutral = spark.createDataFrame([(1, "the hill people came to the feast"), (2, "the lowlanders came to the feast")], "doc_id long, text string")
    groups = [["hill people", "lowlanders"]]

    def scored(penalty):
        return {r["doc_id"]: r["score"] for r in toxicity.score(neutral, toxicity.fit(docs, labels, penalty=penalty, groups=groups)).collect()}

    without, with_it = scored(0.0), scored(toxicity.PENALTY)
    assert without[1] >= 0.5 > with_it[1]
    assert abs(with_it[1] - with_it[2]) < 0.1 < abs(without[1] - without[2])


def test_labels_without_a_document_and_two_labels_of_one_id(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(4, 1)] + [(i, 1) for i in range(100, 200)], "doc_id long, mark int")
    rows, counts = compression_quality.labelled_sample(docs, labels, "mark", 6)
    assert counts == {0: 4, 1: 6} and len(rows) == 10 and {r["id"]: r["label"] for r in rows}[4] == 1


def test_sample_is_bounded_in_characters(spark):
    texts = ["x" * 40] * 30 + ["y" * 33] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, mark int")
    whole, counts = compression_quality.labelled_sample(docs, labels, "mark", 100)
    assert [r["id"] for r in whole if r["label"] == 0] == sorted(range(0, 33, 2), key=str) and counts == {0: 17, 1: 16}
    some, same = compression_quality.labelled_sample(docs, labels, "mark", 100, max_chars=1280)
    assert same == counts and {r["id"] for r in some} == set(range(33))                     # 40 characters are just short enough
    short, same = compression_quality.labelled_sample(docs, labels, "mark", 100, max_chars=1279)
    assert same == counts and {r["id"] for r in short} == {30, 31, 32}                      # longer texts are not sampled
    docs = docs.where("doc_id < 30").unionByName(docs.where("doc_id < 30").selectExpr("doc_id + 100 doc_id", "text", "lang", "source", "n_chars"))
    labels = labels.union(labels.selectExpr("doc_id + 100", "mark"))
    cut, _ = compression_quality.labelled_sample(docs, labels, "mark", 25, max_chars=1280)
    assert [sum(r["label"] == c for r in cut) for c in (0, 1)] == [25, 25]
    cut, _ = compression_quality.labelled_sample(docs.withColumn("text", F.repeat("text", 1)), labels, "mark", 100, max_chars=1280)
    assert all(sum(len(r["text"]) for r in cut if r["label"] == c) <= 1280 for c in (0, 1))


# ------------------------------------------------------------------ stages
@pytest.mark.parametrize("stage", [line_rules.drop_rejected, dedup.drop_copies, simhash.drop_near_copies, mixing.mix_rows])
def test_stages_on_an_empty_table(spark, stage):
    out = stage(spark.createDataFrame([], DOCS + ", Kept string, salt int"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "Kept", "salt"] and out.count() == 0


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    body = " ".join(f"word{k}" for k in range(60))
    odd = [(1, body, "en", "a", None, "x", 1), (2, body, "en", None, 5, "x", 1), (None, body + " more", "en", "a", 5, None, None),
           (3, None, None, None, None, None, None), (3, None, None, None, None, None, None), (4, "", "en", "a", 0, "x", 2)]
    for name, rows in (("empty", []), ("odd", odd)):
        spark.createDataFrame(rows, DOCS + ", Kept string, salt int").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(got) > 0) == (name == "odd") and {r["doc_id"] for r in got} <= {1, 2, None}
