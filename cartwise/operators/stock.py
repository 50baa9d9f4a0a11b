"""Inventory (S06 logic), heuristic alternatives (R04) and out-of-stock repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.text import lower_strip, normalize_basic, tokens
from cartwise.session import cut_lineage

# Accepted header names and the truthy stock values.
ITEM_COLUMNS = ["description", "item", "product"]
STOCK_COLUMNS = ["in_stock", "available", "stock"]
TRUTHY = ["1", "true", "yes", "y", "in_stock", "available"]


def inventory_from_frame(df: DataFrame, order: str | None = None) -> DataFrame:
    """(item, in_stock); header matched case-insensitively, values lower/stripped,
    the last row of an item wins; missing columns → empty.  In stock is what is one of
    ``TRUTHY``, the number one in any spelling ('1.0') included; '2', '0.5' or null are not."""
    cols = {c.lower(): c for c in df.columns}
    item_c = next((cols[c] for c in ITEM_COLUMNS if c in cols), None)
    stock_c = next((cols[c] for c in STOCK_COLUMNS if c in cols), None)
    spark = df.sparkSession
    if item_c is None or stock_c is None:
        return spark.createDataFrame([], "item string, in_stock boolean")
    raw = lower_strip(F.col(stock_c).cast("string"))
    in_stock = F.coalesce(raw.isin(TRUTHY) | F.coalesce(raw.try_cast("double") == 1, F.lit(False)), F.lit(False))
    rows = df.select(lower_strip(F.col(item_c).cast("string")).alias("item"), in_stock.alias("in_stock"),
                     (F.col(order) if order else F.monotonically_increasing_id()).alias("_o"))
    rows = rows.filter(F.col("item").isNotNull() & (F.col("item") != ""))
    return rows.groupBy("item").agg(F.max_by("in_stock", "_o").alias("in_stock"))


HOT_TOKEN = 64      # candidates of a group that hold a token before it counts as hot
MAX_HOT = 10        # hot tokens of an item up to which its subsets of them are listed


def scored_alternatives(missing: DataFrame, candidates: DataFrame, group: str | None = None,
                        hot_token: int = HOT_TOKEN, max_hot: int = MAX_HOT) -> DataFrame:
    """Pairs among which each missing item's best candidate by token Jaccard is: [group,] item, alternative, score.

    Tokens are split by how many candidates (of the group) hold them.

    * Pairs that share a rare token, one of at most ``hot_token`` candidates, meet on it:
      at most ``hot_token`` rows per missing item and token.
    * Pairs that share hot tokens alone: their common tokens are a set S, and among the
      candidates that hold S the one with the fewest tokens scores best.  Candidates list
      the subsets of their hot tokens and each subset keeps one candidate (fewest tokens,
      then first name), so a missing item meets one row per subset of its own.  A
      subset's row may understate a pair that shares more; the larger set has it right.
    * Items with more than ``max_hot`` hot tokens would have too many subsets; such a
      missing item meets all candidates on its hot tokens, such a candidate all missing items.

    So no token, however frequent, makes all pairs of its items, and the best is exact.
    Both sides' tokens and the hot tokens are checkpointed: the parts above all read them.
    """
    g = [group] if group else []
    m = missing.select(*g, "item").distinct().withColumn("_mt", tokens("item")).filter(F.size("_mt") > 0)
    c = candidates.select(*g, F.col("item").alias("alternative")).distinct().withColumn("_ct", tokens("alternative"))
    m, c = cut_lineage(m), cut_lineage(c.filter(F.size("_ct") > 0))
    mt = m.select("*", F.explode("_mt").alias("_tok"))
    ct = c.select("*", F.explode("_ct").alias("_tok"))
    hot = cut_lineage(ct.groupBy(*g, "_tok").agg(F.count(F.lit(1)).alias("_df")).filter(F.col("_df") > hot_token).select(*g, "_tok"))
    shared = F.size(F.array_intersect("_mt", "_ct"))
    score = shared / (F.size("_mt") + F.size("_ct") - shared)

    def on_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, [*g, "_tok"]).select(*g, "item", "alternative", score.alias("score"))

    if hot.isEmpty():
        return on_tokens(mt, ct)
    rare = on_tokens(mt, ct.join(hot, [*g, "_tok"], "left_anti"))
    m_hot = mt.join(hot, [*g, "_tok"], "left_semi").groupBy(*g, "item", "_mt").agg(F.array_sort(F.collect_set("_tok")).alias("_hot"))
    c_hot = ct.join(hot, [*g, "_tok"], "left_semi").groupBy(*g, "alternative", "_ct").agg(F.array_sort(F.collect_set("_tok")).alias("_hot"))
    few = F.size("_hot") <= max_hot
    bits = F.sequence(F.lit(1), F.pow(F.lit(2), F.least(F.size("_hot"), F.lit(max_hot))).cast("int") - 1)
    subsets = F.explode(F.transform(bits, lambda b: _chosen("_hot", b))).alias("_set")
    top = c_hot.filter(few).select(*g, "alternative", F.size("_ct").alias("_nb"), subsets).groupBy(*g, "_set").agg(
        F.min(F.struct("_nb", "alternative")).alias("_top"))
    n, total = F.size("_set"), F.size("_mt") + F.col("_top._nb")
    by_set = m_hot.filter(few).select(*g, "item", "_mt", subsets).join(top, [*g, "_set"]).select(
        *g, "item", F.col("_top.alternative").alias("alternative"), (n / (total - n)).alias("score"))
    m_each, c_each = (x.withColumn("_tok", F.explode("_hot")).withColumn("_few", few).drop("_hot") for x in (m_hot, c_hot))
    many = on_tokens(m_each.filter(~F.col("_few")).drop("_few"), c_each.drop("_few")).unionByName(
        on_tokens(m_each.drop("_few"), c_each.filter(~F.col("_few")).drop("_few")))
    return rare.unionByName(by_set).unionByName(many)


def _chosen(array: str, bits):
    """The elements of an array at the set bits of a number."""
    return F.filter(array, lambda _, i: F.floor(bits / F.pow(F.lit(2.0), i)) % 2 == 1)


def best_alternatives(missing: DataFrame, candidates: DataFrame, group: str | None = None, min_score: float = 0.0) -> DataFrame:
    """For each missing item the candidate with the highest token Jaccard (> ``min_score``), found by ``scored_alternatives``.

    Ties go to the smaller candidate name.  Output: [group,] item, alternative, score, reason.
    """
    g = [group] if group else []
    best = scored_alternatives(missing, candidates, group).groupBy(*g, "item").agg(
        F.min(F.struct((-F.col("score")).alias("_s"), "alternative")).alias("_best"))
    return best.select(*g, "item", "_best.alternative", (-F.col("_best._s")).alias("score"),
                       F.lit("token-overlap").alias("reason")).filter(F.col("score") > min_score)


def repair_bundles(recs: DataFrame, inventory: DataFrame, min_score: float = 0.3, req: str = "request_id",
                   select=best_alternatives) -> DataFrame:
    """Replace out-of-stock items of each request's recommended bundles.

    ``recs``: (request_id, rank, bundle) and ``bundle_items``, the array of items; only a
    frame without that column has its printed names split at '|'.  An item is out of
    stock iff the inventory holds its normalized name as false (absent → in stock);
    candidates are the in-stock items of the same request's bundles and ``select(missing,
    candidates, req)`` chooses among them (R04, or E04 with a scorer).  Returns one
    row per (request, rank): original and resolved bundle and the substitutions.
    """
    inv = inventory.select(normalize_basic("item").alias("_key"), "in_stock").groupBy("_key").agg(
        F.min(F.col("in_stock").cast("int")).alias("_in"))
    held = F.col("bundle_items") if "bundle_items" in recs.columns else F.split("bundle", r"\|")
    items = recs.select(req, "rank", "bundle", F.posexplode(held).alias("pos", "item"))
    items = items.join(inv, normalize_basic("item") == F.col("_key"), "left").withColumn(
        "oos", F.coalesce(F.col("_in") == 0, F.lit(False))).drop("_key", "_in")
    cands = items.filter(~F.col("oos")).select(req, "item").distinct()
    missing = items.filter(F.col("oos")).select(req, "item").distinct()
    best = select(missing, cands, req).filter(F.col("score") >= min_score)
    joined = items.join(best, [req, "item"], "left")
    resolved = F.coalesce(F.col("alternative"), F.col("item"))
    sub = F.when(F.col("alternative").isNotNull(), F.struct(F.col("item").alias("missing_item"),
                                                            F.col("alternative").alias("alternative_item"),
                                                            "score", "reason"))
    return (joined.groupBy(req, "rank", "bundle").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", resolved.alias("r")))), lambda s: s["r"]), "|")
         .alias("resolved_bundle"),
        F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", sub.alias("s")))), lambda s: s["s"]),
                 lambda s: s.isNotNull()).alias("substitutions")))
