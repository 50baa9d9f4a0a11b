"""Bundle recommendation, cross-sell and stock repair.

Requests are a DataFrame (one row per request, an ``items`` array), so any number
of requests is one job: scoring is a join with the model's parameter table,
overlap with bundles is a join on the item, ranking is a per-request window
(top-k per group, which Spark limits map-side before the shuffle).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REQ = "request_id"


def _req_items(requests: DataFrame, items: str = "items") -> DataFrame:
    return requests.select(REQ, F.explode(F.array_distinct(items)).alias("item")).filter(F.col("item").isNotNull())


def confidence(requests: DataFrame, models: dict, recommender_name: str | None = None,
               items: str = "items") -> DataFrame:
    """P(label = 1) from one named recommender, or the ensemble mean over all."""
    if not models:
        raise ValueError("there is no model to score with")
    if recommender_name is not None and recommender_name not in models:
        raise ValueError(f"unknown model {recommender_name!r}; known: {sorted(models)}")
    names = [recommender_name] if recommender_name else list(models)
    parts = [models[n].predict_proba(requests.select(REQ, items), REQ, items)
             .select(REQ, F.lit(n).alias("model"), F.col("p1")) for n in names]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return scores.groupBy(REQ).agg(F.avg("p1").alias("confidence")).withColumn(
        "recommender", F.lit(recommender_name or "ensemble"))


def model_scores(requests: DataFrame, models: dict, items: str = "items") -> DataFrame:
    """Per (request, model) confidence — the batch API's per-recommender rows."""
    parts = [m.predict_proba(requests.select(REQ, items), REQ, items)
             .select(REQ, F.lit(n).alias("recommender"), F.col("p1").alias("confidence"))
             for n, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def applicable_bundles(requests: DataFrame, bundles: DataFrame, top_n: int = 5, items: str = "items") -> DataFrame:
    """Bundles sharing at least one item with the request, first ``top_n`` in bundle
    order (size, support desc, bundle).

    Only the first ``top_n`` bundles of an item can be among the first of a request that
    holds it, so the small bundle table is cut per item before the join.  Output:
    request_id, bundle_items (array), bundle (printed name), size, rank.
    """
    order = ["size", F.desc("support_count"), "bundle", "bundle_items"]
    bi = bundles.select(F.col("items").alias("bundle_items"), "bundle", "size", "support_count",
                        F.explode("items").alias("item"))
    first = (bi.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
               .filter(F.col("_r") <= top_n).drop("_r"))
    hits = (_req_items(requests, items).join(first, "item")
            .select(REQ, "bundle_items", "bundle", "size", "support_count").distinct())
    w = Window.partitionBy(REQ).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).drop("support_count")


def recommend_bundles(requests: DataFrame, conf: DataFrame, bundles: DataFrame, threshold: float = 0.5,
                      top_n: int = 5, items: str = "items") -> DataFrame:
    """When confidence >= threshold, the first ``top_n`` applicable bundles."""
    ok = conf.filter(F.col("confidence") >= threshold).select(REQ, "recommender", "confidence")
    picked = applicable_bundles(requests.join(ok.select(REQ), REQ, "left_semi"), bundles, top_n, items)
    return ok.join(picked, REQ)


def cross_sell(requests: DataFrame, bundles: DataFrame, top_n: int = 5, items: str = "items") -> DataFrame:
    """score(p) = Σ over bundles b ∋ p, p ∉ t of |b ∩ t| / |b|; top ``top_n``.

    The same sum by items: score(p) = Σ over i in t of W[i, p], where W[i, p] adds 1 / |b| over the
    bundles that hold both.  W comes from the bundles alone (a bundle has few items), and the
    requests are joined with it once.

    Requests with fewer than ``top_n`` positives are padded with zero-score bundle
    items in name order; the padding list is a scalar subquery bounded by
    2·top_n + the largest request, so no request × catalogue product is formed.
    """
    req = _req_items(requests, items)
    bi = bundles.select(F.col("items").alias("_b"), "size", F.explode("items").alias("item"))
    # Exact scores: integer numerators over the common denominator lcm(1..max size), so ties
    # do not depend on the order in which a sum of fractions is added up.
    max_size = int(bundles.agg(F.max("size")).first()[0] or 1)
    denom = math.lcm(*range(1, max_size + 1))
    if denom > 1 << 53:
        raise ValueError(f"bundles of {max_size} items are too large for exact scores")
    weights = (bi.select("item", "size", F.explode("_b").alias("product")).filter("item <> product")
               .groupBy("item", "product").agg(F.sum(F.expr(f"{denom}L div size")).alias("_w")))
    contrib = (req.join(weights, "item").groupBy(REQ, "product").agg(F.sum("_w").alias("_num"))
               .join(req.select(REQ, F.col("item").alias("product")), [REQ, "product"], "left_anti"))
    w = Window.partitionBy(REQ).orderBy(F.desc("_num"), "product")
    pos = (contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
           .withColumn("score", F.col("_num") / F.lit(denom)))
    max_req = requests.agg(F.max(F.size(F.array_distinct(items)))).first()[0] or 0
    k = 2 * top_n + int(max_req)
    pad_list = (bi.select("item").distinct().orderBy("item").limit(k)
                .agg(F.array_sort(F.collect_list("item"))).scalar())
    npos = pos.groupBy(REQ).agg(F.collect_list("product").alias("_pos"), F.count(F.lit(1)).alias("_p"))
    base = (requests.select(REQ, F.array_distinct(items).alias("_t")).join(npos, REQ, "left")
            .withColumn("_pad", pad_list)
            .withColumn("_p", F.coalesce("_p", F.lit(0)))
            .withColumn("_pos", F.coalesce("_pos", F.array().cast("array<string>"))))
    free = F.array_except(F.col("_pad"), F.array_union(F.coalesce("_t", F.array().cast("array<string>")), F.col("_pos")))
    pads = (base.filter(F.col("_p") < top_n)
            .select(REQ, "_p", F.posexplode(F.slice(free, 1, F.lit(top_n) - F.col("_p"))).alias("_i", "product"))
            .select(REQ, "product", F.lit(0.0).alias("score"), (F.col("_p") + F.col("_i") + 1).alias("rank")))
    return pos.select(REQ, "product", "score", "rank").unionByName(pads)


def suggestions(recs: DataFrame, request_items: DataFrame, top_n: int = 3) -> DataFrame:
    """Per product (≠ selected, case-insensitive) over recommended bundles × models:
    frequency and mean (3-dp) confidence; top ``top_n`` by confidence, then product."""
    exploded = recs.select(REQ, "recommender", "confidence", F.explode("bundle_items").alias("product"))
    sel = request_items.select(REQ, F.lower(F.col("selected")).alias("_sel"))
    agg = (exploded.join(sel, REQ).filter(F.lower("product") != F.col("_sel"))
           .groupBy(REQ, "product").agg(F.avg(F.round("confidence", 3)).alias("confidence"),
                                        F.count(F.lit(1)).alias("frequency")))
    w = Window.partitionBy(REQ).orderBy(F.desc("confidence"), "product")
    return agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
