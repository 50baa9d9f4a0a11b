"""Quality classifier by compression.

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled bad.
A whole text is compressed with each, cut into blocks of ``BLOCK`` bytes so that the
dictionaries matter in all of it; the normalised difference (bad - good) / (bad + good) of
the compressed sizes becomes a score by a logistic calibration.

The model is fitted on a bounded sample: at most ``max_rows`` labelled documents of each
class, those with the smallest hash of their id, and of these as many as ``max_chars``
characters hold (texts of over 1/32 of that are scored but not sampled).  Even ones train the dictionaries,
odd ones the calibration, where each class weighs as much as it has labelled rows.

Defined results: null and empty texts have difference 0 and get the score calibrated for
that; null labels and labels without a document are not used; of several labels of one id
the largest holds; without both classes every score is the share of good labels (0.5
without labels); repeated rows are scored each; an empty table gives an empty result;
only the id and the text are read from the scored rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.session import cut_lineage

MAX_ROWS = 3000
MAX_CHARS = 32_000_000     # of the sampled texts of a class
DICTIONARY_BYTES = 32 * 1024
BLOCK = 1024
LEVEL = 3


def blocks(data: bytes) -> list[bytes]:
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self):
        made = []
        for d in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(d) if d else None
            if known:
                known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False,
                                                 write_content_size=False, write_dict_id=False))
        return made

    def differences(self, texts) -> np.ndarray:
        good, bad = self.compressors()
        out = []
        for t in texts:
            parts = blocks((t or "").encode())
            g, b = sum(len(good.compress(p)) for p in parts), sum(len(bad.compress(p)) for p in parts)
            out.append((b - g) / (b + g) if b + g else 0.0)
        return np.array(out)

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * self.differences(texts), -30, 30)))


def dictionary(texts: list[str]) -> bytes:
    samples = [p for t in texts for p in blocks(t.encode())]
    size = min(DICTIONARY_BYTES, max(512, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:      # too few samples to train on: the texts themselves serve as a raw dictionary
        return b"".join(samples)[:DICTIONARY_BYTES]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression, by Newton's method on the scaled feature."""
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        change = np.linalg.solve(hess, grad)
        beta -= change
        if np.abs(change).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def labelled_sample(df: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id",
                    text_col: str = "text", max_chars: int = MAX_CHARS) -> tuple[list, dict[int, int]]:
    """(id, label, text) rows of each class in hash order, and the number of labels by class.

    At most ``max_rows`` rows and ``max_chars`` characters a class reach the driver; texts of
    over ``max_chars // 32`` characters are not sampled.
    """
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(
        F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    known = cut_lineage(known.join(df.select(F.col(f"`{id_col}`").alias("id")), "id", "left_semi"))     # labels of documents alone
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit("sample"), "id"), "id"]
    chosen = known.where("label = 1").orderBy(*order).limit(max_rows).union(
        known.where("label = 0").orderBy(*order).limit(max_rows))
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(
        F.coalesce(F.length("text"), F.lit(0)) <= max_chars // 32).join(F.broadcast(chosen), "id")       # at most twice ``max_rows`` ids
    texts = cut_lineage(texts.groupBy("id", "label").agg(F.min("text").alias("text")))
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy(*order))
    fitting = texts.select("id", "label", so_far.alias("chars")).where(F.col("chars") <= max_chars).select("id")
    sample = texts.join(F.broadcast(fitting), "id", "left_semi").collect()
    return sorted(sample, key=lambda r: (r["label"], str(r["id"]))), counts


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    rows, counts = labelled_sample(df, labels, label_col, max_rows, id_col, text_col, max_chars)
    texts = {c: [r["text"] or "" for r in rows if r["label"] == c] for c in (0, 1)}
    total = counts.get(0, 0) + counts.get(1, 0)
    if min(len(texts[0]), len(texts[1])) < 2:
        share = min(max(counts.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    model = Model(dictionary(texts[1][::2]), dictionary(texts[0][::2]))
    held = [(t, c) for c in (0, 1) for t in texts[c][1::2]]
    y = np.array([c for _, c in held], float)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    model.slope, model.offset = logistic(model.differences([t for t, _ in held]), y, weight * len(y) / weight.sum())
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row.  The model (two bounded dictionaries) is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.scores(texts))

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), of(F.col(f"`{text_col}`")).alias("score"))
