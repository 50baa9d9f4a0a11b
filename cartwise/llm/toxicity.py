"""Toxicity by a counterfactually regularised classifier.

A document has the words it contains and the word beginnings of ``STEMS`` letters as
features; those that tell the classes apart (by the likelihood-ratio statistic) enter a
logistic regression.  For each labelled sentence with an identity term, the term is swapped
for the others of its group (``groups``, terms of one or more words), and the squared change of the score is penalised: a
neutral mention of a group must not move the score, whatever the labels suggest.

The model is fitted on a bounded sample: at most ``max_rows`` labelled documents of each
class, those with the smallest hash of their id, and of these as many as ``max_chars``
characters hold (texts of over 1/32 of that are scored but not sampled); class weights restore the true shares.

Defined results: null and empty texts have no features and get the base score; null
labels and labels without a document are not used; of several labels of one id the
largest holds; without both classes every score is the share of toxic labels; repeated rows
are scored each; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.compression_quality import MAX_CHARS, labelled_sample

MAX_ROWS = 4000
MAX_FEATURES = 600
MIN_DOCS = 3
MIN_RATIO = 10.0           # least likelihood-ratio statistic of a feature
STEMS = (4, 5, 6, 7)
RIDGE = 0.5
PENALTY = 50.0

#: The standard groups of identity terms (of one or more words); a term is swapped for the others of its group.
IDENTITY_TERMS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["black", "white", "asian", "african", "latino", "arab", "european"],
    ["immigrants", "refugees", "citizens", "foreigners", "migrants"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["femmes", "hommes", "filles"], ["frauen", "männer", "kinder"], ["mujeres", "hombres", "chicas"],
]
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]


def features(text: str | None) -> set[str]:
    return {f for w in set(LETTERS.findall((text or "").lower())) for f in features_of(w)}


@dataclass
class Model:
    weights: dict[str, float]
    offset: float

    def scores(self, texts) -> np.ndarray:
        weights, stems = self.weights, [n for n in STEMS if any(len(f) == n + 1 and f[0] == "^" for f in self.weights)]
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            found = set()
            for w in set(LETTERS.findall((t or "").lower())):
                if w in weights:
                    found.add(w)
                for n in stems:
                    if len(w) >= n and (f := f"^{w[:n]}") in weights:
                        found.add(f)
            out[k] = self.offset + sum(weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def ratio(k1: int, n1: int, k0: int, n0: int) -> float:
    """Likelihood-ratio statistic of a feature in k1 of n1 and k0 of n0 documents."""
    def part(k, n, p):
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n - k else 0.0)
    p = (k1 + k0) / (n1 + n0)
    return 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, p) - part(k0, n0, p))


def terms_by_first(groups: Iterable[Iterable[str]]) -> dict[str, list[tuple[tuple[str, ...], list[tuple[str, ...]]]]]:
    """First word -> (the term's words, the words of each other term of its group)."""
    out: dict[str, list] = {}
    for group in groups:
        terms = sorted({w for t in group if (w := tuple(LETTERS.findall(t.lower())))})
        for term in terms:
            out.setdefault(term[0], []).append((term, [t for t in terms if t != term]))
    return out


def swaps(text: str, index: dict[str, int], terms: dict[str, list]) -> Iterator[np.ndarray]:
    """Feature changes of the sentences of ``text`` when one identity term is swapped, in all its places."""
    for sentence in SENTENCE.split(text.lower()):
        said = LETTERS.findall(sentence)
        places: dict[tuple, set[int]] = {}
        groups = {}
        for i, word in enumerate(said):
            for term, others in terms.get(word, ()):
                if tuple(said[i:i + len(term)]) == term:
                    places.setdefault(term, set()).update(range(i, i + len(term)))
                    groups[term] = others
        for term, covered in places.items():
            rest = {f for i, w in enumerate(said) if i not in covered for f in features_of(w)}
            old = {f for w in term for f in features_of(w)} - rest
            for other in groups[term]:
                new = {f for w in other for f in features_of(w)} - rest
                change = np.zeros(len(index))
                for sign, gone in ((1, new - old), (-1, old - new)):
                    for f in gone:
                        if f in index:
                            change[index[f]] += sign
                if change.any():
                    yield change


def fit_texts(texts: list[str], y: np.ndarray, share: float, max_features: int = MAX_FEATURES,
              penalty: float = PENALTY, groups: Iterable[Iterable[str]] = IDENTITY_TERMS) -> Model:
    """Fit on texts and 0/1 labels; ``share`` is the true share of 1."""
    terms = terms_by_first(groups)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    share = min(max(share, 1e-6), 1 - 1e-6)
    if not n1 or not n0:
        return Model({}, float(np.log(share / (1 - share))))
    toxic = Counter(f for t, c in zip(texts, y, strict=True) if c for f in features(t))
    toxic = {f: k for f, k in toxic.items() if k >= MIN_DOCS}
    clean = Counter(f for t, c in zip(texts, y, strict=True) if not c for f in features(t) if f in toxic)
    told = ((ratio(k, n1, clean[f], n0), f) for f, k in toxic.items() if k * n0 > clean[f] * n1)
    chosen = [f for r, f in sorted(told, key=lambda x: (-x[0], x[1]))[:max_features] if r >= MIN_RATIO]
    index = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    pull = np.zeros((len(chosen) + 1, len(chosen) + 1))
    for row, t in enumerate(texts):
        x[row, [index[f] for f in features(t) if f in index]] = 1
        for change in swaps(t, index, terms):
            pull[:-1, :-1] += np.outer(change, change)
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    ridge = np.eye(len(chosen) + 1) * RIDGE
    ridge[-1, -1] = 1e-6
    beta = np.zeros(len(chosen) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + (ridge + 2 * penalty * pull) @ beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 2 * penalty * pull
        change = np.linalg.solve(hess, grad)
        beta -= np.clip(change, -4, 4)
        if np.abs(change).max() < 1e-6:
            break
    return Model({f: float(beta[i]) for f, i in index.items()}, float(beta[-1]))


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, penalty: float = PENALTY,
        groups: Iterable[Iterable[str]] = IDENTITY_TERMS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample; ``groups`` are the identity terms that must be exchangeable."""
    rows, counts = labelled_sample(df, labels, label_col, max_rows, id_col, text_col, max_chars)
    total = counts.get(0, 0) + counts.get(1, 0)
    share = counts.get(1, 0) / total if total else 0.5
    return fit_texts([r["text"] or "" for r in rows], np.array([r["label"] for r in rows], float), share, max_features, penalty, groups)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row.  The model (at most ``max_features`` weights) is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.scores(texts))

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), of(F.col(f"`{text_col}`")).alias("score"))
