"""Features, labels and splits (L01–L04) and request filters.

Everything is long-form and join-based: a basket × item table replaces the dense
multi-hot matrix, containment tests are joins on the item, splits are a pure
function of the basket key (stable under repartitioning and recomputation).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.ordering import digest_row_number, global_row_number
from cartwise.session import cut_lineage

BROADCAST_BYTES = 32 * 1024 * 1024     # measured size up to which the bundles are sent to every task


# F08 / F09 ----------------------------------------------------------------------------
def validate_transaction(items) -> "F.Column":
    """non-empty list whose elements are all strings (no NULLs)."""
    c = F.col(items) if isinstance(items, str) else items
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))


def filter_transaction(items, min_length: int = 3):
    """strip, lower, keep items of at least ``min_length`` characters."""
    from cartwise.functions.text import lower_strip
    c = F.col(items) if isinstance(items, str) else items
    return F.filter(F.transform(c, lambda x: lower_strip(x)), lambda x: F.length(x) >= min_length)


# L01 ----------------------------------------------------------------------------------
def basket_items(baskets: DataFrame, key: str = "InvoiceNo", items: str = "Items") -> DataFrame:
    """Long form (key, item) with presence semantics (duplicates collapse)."""
    return baskets.select(key, F.explode(F.array_distinct(items)).alias("item")).filter(F.col("item").isNotNull())


def vocabulary(baskets: DataFrame, items: str = "Items", key: str = "InvoiceNo") -> DataFrame:
    """Sorted distinct items with a 0-based ``index`` (MultiLabelBinarizer classes)."""
    distinct = basket_items(baskets, key, items).select("item").distinct()
    return global_row_number(distinct, [F.col("item")], "index").withColumn("index", F.col("index") - 1)


def encode(baskets: DataFrame, vocab: DataFrame, key: str = "InvoiceNo", items: str = "Items") -> DataFrame:
    """L01 long form (key, item, index); unknown items are ignored."""
    return basket_items(baskets, key, items).join(vocab, "item")


# L02 ----------------------------------------------------------------------------------
def label_baskets(baskets: DataFrame, bundles: DataFrame, key: str = "InvoiceNo", items: str = "Items",
                  broadcast_bytes: int = BROADCAST_BYTES, one_row_a_key: bool = False) -> DataFrame:
    """Label 1 when some bundle is contained in the basket.

    A basket that holds a bundle holds the bundle's rarest item, so each bundle is looked
    up under that item alone: popular items never become join keys.  The left-semi join
    stops at the first bundle found whole and emits no pairs.  A bundle is its array of
    items; its printed name plays no part.

    The bundles under their rarest items are written and measured.  Up to
    ``broadcast_bytes`` every task holds them, so no basket is copied into a shuffle.
    Beyond, only the (basket, item) rows whose item is some bundle's rarest get the basket's
    items, after a semi-join of the narrow rows.

    Rows of one key share their label, and a null key has label 0.  ``one_row_a_key`` says that
    no key comes twice, as from ``create_baskets``: where every task holds the bundles, a
    basket is then labelled where it lies and nothing is joined back.
    """
    long = basket_items(baskets, key, items)
    frequency = long.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    whole = bundles.select(F.array_sort(F.array_distinct("items")).alias("_bundle")).filter(F.size("_bundle") > 0)
    rarest = cut_lineage(whole.select("_bundle", F.explode("_bundle").alias("item")).join(frequency, "item", "left")
                         .groupBy("_bundle").agg(F.min_by("item", F.struct(F.coalesce("_n", F.lit(0)), "item")).alias("_rare")))
    size = rarest.agg(F.sum(F.octet_length("_rare") + 64 + F.aggregate(
        "_bundle", F.lit(0), lambda total, item: total + F.coalesce(F.octet_length(item), F.lit(0)) + 16))).first()[0]
    if one_row_a_key and (size or 0) <= broadcast_bytes:
        holds = _holds_bundle(rarest.collect())(F.col(items))       # measured: at most ``broadcast_bytes``
        return baskets.withColumn("label", F.when(F.col(key).isNotNull() & holds, 1).otherwise(0))
    held = baskets.select(F.col(key), F.array_distinct(items).alias("_held"))
    if (size or 0) <= broadcast_bytes:
        rows, index = held.select(key, "_held", F.explode("_held").alias("item")), F.broadcast(rarest)
    else:
        hits = long.join(rarest.select("_rare").distinct(), F.col("item") == F.col("_rare"), "left_semi")
        rows, index = hits.join(held, key), rarest
    found = (F.col("item") == F.col("_rare")) & (F.size(F.array_except("_bundle", "_held")) == 0)
    hits = rows.join(index, found, "left_semi").select(key).distinct()
    labelled = baskets.join(hits.withColumn("_hit", F.lit(1)), key, "left")
    return labelled.withColumn("label", F.when(F.col("_hit").isNotNull(), 1).otherwise(0)).drop("_hit")


def _holds_bundle(rarest: list):
    """Whether a basket holds one of the bundles (rows ``_bundle``, ``_rare``), as a function of its items."""
    one, more = {}, {}      # by rarest item: the other items of pairs; what the other bundles have beside it
    for bundle, rare in rarest:
        rest = frozenset(bundle) - {rare}
        if rare is not None and len(rest) == 1:
            one.setdefault(rare, set()).update(rest)
        elif rare is not None:
            more.setdefault(rare, []).append(rest)

    @F.pandas_udf("boolean")
    def holds(baskets: pd.Series) -> pd.Series:
        out = np.zeros(len(baskets), bool)
        for at, basket in enumerate(baskets):
            held = set(() if basket is None else basket)
            out[at] = any(i in one and not one[i].isdisjoint(held) or i in more and any(rest <= held for rest in more[i]) for i in held)
        return pd.Series(out)

    return holds


# L03 / L04 ----------------------------------------------------------------------------
def hash_unit(key: str, seed: int = 42):
    """Uniform [0, 1) from md5('seed|key') (first 32 bits)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(2 ** 32)


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "InvoiceNo") -> DataFrame:
    """``is_test`` flag; deterministic, no shuffle."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    return df.withColumn("is_test", hash_unit(key, seed) >= F.lit(1.0 - test_size))


def kfold(df: DataFrame, n_splits: int = 10, seed: int = 42, key: str = "InvoiceNo", exact: bool = True,
          one_row_a_key: bool = False) -> DataFrame:
    """``fold`` in 0..k-1; disjoint and covering.

    ``exact`` numbers rows in hash order (by ranges of the hash, see functions.ordering)
    so fold sizes differ by at most one; otherwise fold = hash mod k.  ``one_row_a_key`` says that
    no key comes twice, as from ``create_baskets``: the rows themselves are then numbered, and
    no keys are made distinct and joined back.
    """
    if n_splits < 2:
        raise ValueError(f"cannot deal rows into {n_splits} folds; use two or more")
    digest = lambda k: F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(k).cast("string"), F.lit(""))))
    if not exact:
        return df.withColumn("fold", (F.conv(F.substring(digest(key), 1, 8), 16, 10).cast("bigint") % n_splits).cast("int"))
    fold = ((F.col("_r") - 1) % n_splits).cast("int").alias("fold")
    if one_row_a_key:
        return digest_row_number(df, digest(key), [F.col(key)], "_r").select(*df.columns, fold)
    # One fold per distinct key, a null key included: repeated keys neither multiply nor split.
    keys = df.select(F.col(key).alias("_key")).distinct()
    folds = digest_row_number(keys, digest("_key"), [F.col("_key")], "_r").select("_key", fold)
    return df.join(folds, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


# F10 ----------------------------------------------------------------------------------
def filter_unknown(requests: DataFrame, vocab: DataFrame, key: str = "request_id", items: str = "items") -> DataFrame:
    """drop items outside the vocabulary; an all-unknown request stays as an
    empty basket; ``n_dropped`` counts what was removed."""
    long = requests.select(key, F.posexplode(items).alias("pos", "item"))
    known = long.join(vocab.select("item", F.lit(True).alias("_k")), "item", "left")
    agg = known.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_k"), F.struct("pos", "item")))),
                    lambda s: s["item"]).alias("known_items"),
        F.count_if(F.col("_k").isNull()).alias("n_dropped"))
    return (requests.join(agg, key, "left")
            .withColumn("known_items", F.coalesce("known_items", F.array().cast("array<string>")))
            .withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("bigint")))
