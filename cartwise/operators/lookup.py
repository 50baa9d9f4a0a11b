"""A fitted engine as item-bucketed tables, for single requests and batches.

``save_lookup`` writes, once per training, one row per item with its weight in every model,
and each item's first bundles, both partitioned by a hash of the item.  A request then
reads the partitions of its own items alone: no model is fitted and no table is scanned.
Each model answers ``1 / (1 + exp(-(scale * (bias + sum of weights) + shift)))``: Naive Bayes
with its log odds, a linear SVM with its margin and Platt scaling.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.operators.models import NBModel, SVMModel

BUCKETS = 64
REQ = "request_id"


def item_bucket(item, buckets: int):
    """Bucket of an item column; ``bucket_of`` is the same for one text."""
    return F.pmod(F.conv(F.substring(F.md5(item), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def bucket_of(item: str, buckets: int) -> int:
    return int(hashlib.md5(item.encode()).hexdigest()[:8], 16) % buckets


def _terms(model) -> tuple[DataFrame, dict]:
    """(item, w) and the numbers bias, scale, shift; ``constant`` for a model that saw one class."""
    if isinstance(model, NBModel):
        base = model.base.first()
        constant = None if model.classes == [0, 1] else float(model.classes[0])
        bias = 0.0 if constant is not None else base["b1"] - base["b0"]
        return model.params.select("item", (F.col("w1") - F.col("w0")).alias("w")), {"bias": bias, "scale": 1.0, "shift": 0.0, "constant": constant}
    if isinstance(model, SVMModel):
        return model.weights, {"bias": model.intercept, "scale": model.a, "shift": model.b, "constant": None}
    raise ValueError("a lookup holds Naive Bayes and linear SVM models; kernel machines have no weight per item")


def save_lookup(models: dict, bundles: DataFrame, out: str, top_n: int = 5, buckets: int = BUCKETS) -> None:
    """Write the engine; ``top_n`` is the most bundles that a request can ask for."""
    spark, weights, numbers = bundles.sparkSession, None, {}
    for name, model in models.items():
        table, numbers[name] = _terms(model)
        table = table.select("item", F.lit(name).alias("model"), "w")
        weights = table if weights is None else weights.unionByName(table)
    (weights.withColumn("bucket", item_bucket("item", buckets)).repartition("bucket").sortWithinPartitions("item")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/weights"))
    order = Window.partitionBy("item").orderBy("size", F.desc("support_count"), "bundle", "bundle_items")
    first = (bundles.select(F.col("items").alias("bundle_items"), "bundle", "size", "support_count", F.explode("items").alias("item"))
             .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top_n).drop("n"))
    (first.withColumn("bucket", item_bucket("item", buckets)).repartition("bucket").sortWithinPartitions("item")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/bundles"))
    # Written last: a folder without it holds no whole engine.
    spark.createDataFrame([(json.dumps({"buckets": buckets, "top_n": top_n, "models": numbers}),)], "engine string").write.mode("overwrite").parquet(f"{out}/engine")


@dataclass
class Lookup:
    """An opened engine: its file lists are read once."""
    weights: DataFrame
    bundles: DataFrame
    buckets: int
    top_n: int
    models: dict

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Lookup:
        said = json.loads(spark.read.parquet(f"{path}/engine").first()["engine"])
        weights = spark.read.schema("item string, model string, w double, bucket int").parquet(f"{path}/weights")
        bundles = spark.read.schema("bundle_items array<string>, bundle string, size int, support_count bigint, item string, bucket int")
        return cls(weights, bundles.parquet(f"{path}/bundles"), said["buckets"], said["top_n"], said["models"])

    def _check(self, threshold: float, top_n: int) -> None:
        if not 0.0 <= threshold <= 1.0:
            raise ValueError(f"threshold must be in [0, 1], got {threshold}")
        if not 1 <= top_n <= self.top_n:
            raise ValueError(f"top_n must be 1 to {self.top_n}, got {top_n}")

    def _held(self, table: DataFrame, items: list[str]) -> DataFrame:
        return table.filter(F.col("bucket").isin(sorted({bucket_of(i, self.buckets) for i in items})) & F.col("item").isin(items))

    def one(self, items: list[str], threshold: float = 0.3, top_n: int = 5) -> dict:
        """Confidence of each model and their mean (3 places), and the first bundles if any model reaches the threshold.

        What comes back is bounded by the request: a row per item and model, ``top_n`` bundles per item.
        """
        self._check(threshold, top_n)
        items = sorted({i for i in items if i is not None})
        sums = dict.fromkeys(self.models, 0.0)
        for r in self._held(self.weights, items).select("model", "w").collect() if items else ():
            sums[r["model"]] += r["w"]
        p = {}
        for name, m in self.models.items():
            z = m["scale"] * (m["bias"] + sums[name]) + m["shift"]
            p[name] = m["constant"] if m["constant"] is not None else 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        shown = {}
        if items and max(p.values(), default=0.0) >= threshold:
            for r in self._held(self.bundles, items).collect():
                shown[tuple(r["bundle_items"])] = (r["size"], -r["support_count"], r["bundle"], r["bundle_items"])
        return {"confidence": {n: round(x, 3) for n, x in p.items()}, "ensemble_confidence": round(sum(p.values()) / len(p), 3) if p else 0.0,
                "bundles": [b[2] for b in sorted(shown.values())[:top_n]]}

    def batch(self, requests: DataFrame, threshold: float = 0.3, top_n: int = 5, items: str = "items") -> DataFrame:
        """R06 for a table of requests: request_id, recommender, confidence (3 places), rank, bundle."""
        self._check(threshold, top_n)
        held = requests.select(REQ, F.explode(F.array_distinct(items)).alias("item")).filter(F.col("item").isNotNull())
        names = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m["bias"]).alias("bias"), F.lit(m["scale"]).alias("scale"), F.lit(m["shift"]).alias("shift"),
                                             F.lit(m["constant"]).cast("double").alias("constant")) for n, m in self.models.items()]))
        sums = held.join(self.weights.drop("bucket"), "item").groupBy(REQ, "model").agg(F.sum("w").alias("sum"))
        each = requests.select(REQ).distinct().select(REQ, names.alias("m")).select(REQ, "m.*").join(sums, [REQ, "model"], "left")
        z = F.col("scale") * (F.col("bias") + F.coalesce("sum", F.lit(0.0))) + F.col("shift")
        scores = each.select(REQ, F.col("model").alias("recommender"), F.coalesce("constant", 1 / (1 + F.exp(-z))).alias("confidence")).filter(
            F.col("confidence") >= threshold)
        hits = held.join(self.bundles.drop("bucket"), "item").groupBy(REQ, "bundle_items", "bundle", "size", "support_count").agg(F.lit(1))
        order = Window.partitionBy(REQ).orderBy("size", F.desc("support_count"), "bundle", "bundle_items")
        first = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
        return scores.join(first, REQ).select(REQ, "recommender", F.round("confidence", 3).alias("confidence"), F.col("rank").cast("bigint").alias("rank"), "bundle")
