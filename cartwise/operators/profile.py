"""Column profiling (A01–A10, A13–A16) and value-frequency tables.

Each profile is **one** aggregate over the table (Catalyst fuses all metrics of a
type class into a single scan with map-side partial aggregation); wide one-row
results are unpivoted into one row per column with ``inline``.  Samples ("first
k values") are top-k rows by the table's order column, never a collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.ordering import global_row_number
from cartwise.functions.quantiles import iqr_fences, quantiles
from cartwise.functions.sketches import approximate_distinct, exact_distinct

# Text-pattern checks of the profiler (Python regex semantics;
# ``(?U)`` makes Java's classes Unicode-aware like Python's).
URL_PATTERN = r"http|www"
EMAIL_PATTERN = r"(?U)\w+@\w+"
DIGIT_PATTERN = r"(?U)\d"
NON_ALPHA_PATTERN = r"(?U)[^a-z\s]"
LONG_TEXT = 200


def pct(num, den) -> Column:
    """Percentage with 2 decimals: round(num·10000/den)/100 (one IEEE division, so every
    engine rounds the same double); null where there is nothing to divide by."""
    return F.round(F.try_divide(num * 10000.0, den), 0) / 100


def _unpivot(one_row: DataFrame, cols, build) -> DataFrame:
    return one_row.select(F.inline(F.array(*[build(c) for c in cols])))


# A01 / A06 ----------------------------------------------------------------------------
def duplicate_row_count(df: DataFrame) -> Column:
    """Rows minus distinct rows, as a scalar subquery (partial-aggregated group-by)."""
    dup = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1))
    return F.coalesce(dup.scalar(), F.lit(0)).cast("bigint")


def null_counts(df: DataFrame) -> DataFrame:
    """Per column null count and whether the column is entirely null."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _unpivot(agg, cols, lambda c: F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count"),
                                                  ((F.col(c) == F.col("_n")) & (F.col("_n") > 0)).alias("fully_null")))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows, number of fully-null columns (one row)."""
    nulls = null_counts(df)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"),
        duplicate_row_count(df).alias("duplicate_rows"),
        nulls.agg(F.count_if("fully_null")).scalar().alias("fully_null_columns"))


def column_stats(df: DataFrame, cols=None, approximate: bool = False) -> DataFrame:
    """Non-null, null, null % (2 dp), distinct (nulls excluded) per column.

    Exact: rows become (column, 128-bit digest) pairs that tasks count before one shuffle;
    counts and distinct counts come from the same pairs, so the table is read once and no row
    is copied per column.  ``approximate``: sketches in one aggregate.
    """
    cols = cols or df.columns
    if approximate:
        agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"{c}__nn") for c in cols],
                     *[approximate_distinct(F.col(f"`{c}`")).alias(f"{c}__d") for c in cols])
        found = _unpivot(agg, cols, lambda c: F.struct(F.lit(c).alias("column"), F.col(f"{c}__nn").alias("_nn"), F.col("_n"), F.col(f"{c}__d").alias("_d")))
    else:
        pairs = [F.struct(F.lit(i).alias("_i"), F.xxhash64(v).alias("_a"), F.xxhash64(F.lit(1), v).alias("_b"), v.isNotNull().alias("_held"))
                 for i, v in enumerate(_canonical(df, c) for c in cols)]
        counts = df.select(F.inline(F.array(*pairs))).groupBy("_i", "_a", "_b", "_held").agg(F.count(F.lit(1)).alias("n"))
        per = counts.groupBy("_i").agg(F.sum(F.when(F.col("_held"), F.col("n")).otherwise(0)).alias("_nn"), F.sum("n").alias("_n"),
                                       F.count_if("_held").alias("_d"))
        names = df.sparkSession.createDataFrame(list(enumerate(cols)), "_i int, column string")
        found = names.join(per, "_i", "left").fillna(0, ["_nn", "_n", "_d"])
    return found.select("column", F.col("_nn").alias("non_null_count"), (F.col("_n") - F.col("_nn")).alias("null_count"),
                        pct(F.col("_n") - F.col("_nn"), F.col("_n")).alias("null_percentage"), F.col("_d").cast("bigint").alias("unique_count"))


def _canonical(df: DataFrame, c: str) -> Column:
    """A column whose equal values print alike: minus zero is zero."""
    kind = df.schema[c].dataType.simpleString()
    return F.col(f"`{c}`") + F.lit(0.0).cast(kind) if kind in ("double", "float") else F.col(f"`{c}`")


# A08 ----------------------------------------------------------------------------------
def numeric_profile(df: DataFrame, cols, digits: int = 6, approximate: bool = False) -> DataFrame:
    """Five-number summary, mean, sample std, bias-corrected skewness / excess kurtosis.

    Spark's ``skewness`` / ``kurtosis`` are population moments g1, g2; pandas reports
    G1 = g1·sqrt(n(n-1))/(n-2) and G2 = ((n+1)·g2 + 6)·(n-1)/((n-2)(n-3)).
    ``approximate`` takes the quartiles from sketches.
    """
    five = quantiles(df, cols, (0.0, 0.25, 0.5, 0.75, 1.0), approximate)
    exprs = []
    for c in cols:
        v = F.col(c).cast("double")
        exprs += [F.avg(v).alias(f"{c}__mean"),
                  F.stddev_samp(v).alias(f"{c}__std"), F.skewness(v).alias(f"{c}__g1"),
                  F.kurtosis(v).alias(f"{c}__g2"), F.count(v).alias(f"{c}__n")]
    agg = df.agg(*exprs)

    def build(c):
        n = F.col(f"{c}__n").cast("double")
        g1, g2 = F.col(f"{c}__g1"), F.col(f"{c}__g2")
        q = [F.lit(x).cast("double") for x in five[c]]
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
        r = lambda e: F.round(e, digits)
        return F.struct(F.lit(c).alias("column"), r(q[0]).alias("min"), r(q[1]).alias("q1"),
                        r(q[2]).alias("median"), r(q[3]).alias("q3"), r(q[4]).alias("max"),
                        r(F.col(f"{c}__mean")).alias("mean"), r(F.col(f"{c}__std")).alias("std"),
                        r(skew).alias("skewness"), r(kurt).alias("kurtosis"))
    return _unpivot(agg, cols, build)


# A09 / A10 ----------------------------------------------------------------------------
def numeric_outliers(df: DataFrame, cols, multiplier: float = 1.5, approximate: bool = False) -> DataFrame:
    """IQR bounds, outlier count and % of non-null values per column, all columns in one aggregate."""
    fences = iqr_fences(df, cols, multiplier, approximate)
    exprs = []
    for c in cols:
        v, (low, high) = F.col(c).cast("double"), fences[c]
        exprs += [F.count_if((v < F.lit(low)) | (v > F.lit(high))).alias(f"{c}__out"), F.count(v).alias(f"{c}__n")]
    return _unpivot(df.agg(*exprs), cols, lambda c: F.struct(
        F.lit(c).alias("column"), F.round(F.lit(fences[c][0]).cast("double"), 6).alias("lower_bound"),
        F.round(F.lit(fences[c][1]).cast("double"), 6).alias("upper_bound"), F.col(f"{c}__out").alias("outlier_count"),
        pct(F.col(f"{c}__out"), F.col(f"{c}__n")).alias("outlier_percentage")))


def _samples(df: DataFrame, col: str, order: str, k: int, picked: Column) -> DataFrame:
    v = F.col(col).cast("double")
    return (df.filter(picked).orderBy(order).limit(k)
              .select(F.lit(col).alias("column"), F.col(order).alias("position"), v.alias("value")))


def outlier_samples(df: DataFrame, col: str, order: str, k: int = 10, multiplier: float = 1.5) -> DataFrame:
    """A09 samples: first k outliers in table order (top-k)."""
    low, high = iqr_fences(df, [col], multiplier)[col]
    v = F.col(col).cast("double")
    return _samples(df, col, order, k, (v < F.lit(low)) | (v > F.lit(high)))


def _far(df: DataFrame, col: str, z: float) -> Column:
    """|z-score| above ``z``; never where the deviation is 0 or null."""
    v = F.col(col).cast("double")
    stats = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    m, s = stats.select("m").scalar(), stats.select("s").scalar()
    return F.coalesce(F.when(s > 0, F.abs((v - m) / s) > z), F.lit(False))


def numeric_errors(df: DataFrame, cols, z: float = 5.0) -> DataFrame:
    """A10: negatives, zeros and |z| above ``z`` (only when std > 0) per column, in one aggregate."""
    exprs = []
    for c in cols:
        v = F.col(c).cast("double")
        exprs += [F.count_if(v < 0).alias(f"{c}__neg"), F.count_if(v == 0).alias(f"{c}__zero"),
                  F.count_if(_far(df, c, z)).alias(f"{c}__far")]
    return _unpivot(df.agg(*exprs), cols, lambda c: F.struct(
        F.lit(c).alias("column"), F.col(f"{c}__neg").alias("negative_values"), F.col(f"{c}__zero").alias("zero_values"),
        F.col(f"{c}__far").alias("extreme_values")))


def extreme_samples(df: DataFrame, col: str, order: str, k: int = 5, z: float = 5.0) -> DataFrame:
    """A10 samples: first k values with |z| above ``z`` in table order."""
    return _samples(df, col, order, k, _far(df, col, z))


def long_samples(df: DataFrame, col: str, order: str, k: int = 3, length: int = 200) -> DataFrame:
    """A15 samples: first k values longer than ``length`` characters in table order."""
    return (df.filter(F.char_length(col) > length).orderBy(order).limit(k)
              .select(F.lit(col).alias("column"), F.col(order).alias("position"), F.char_length(col).alias("length"),
                      F.col(col).alias("value")))


def negative_samples(df: DataFrame, col: str, order: str, k: int = 5) -> DataFrame:
    """A10 samples: first k negative values in table order."""
    return _samples(df, col, order, k, F.col(col).cast("double") < 0)


# A13–A15 ------------------------------------------------------------------------------
def text_profile(df: DataFrame, cols) -> DataFrame:
    """A13 lengths, A14 cleaning effect, A15 suspicious patterns; one row per column."""
    exprs = []
    for c in cols:
        t = F.col(c)
        ln = F.length(t)
        cleaned = F.regexp_replace(F.lower(t), NON_ALPHA_PATTERN, "")
        exprs += [F.min(ln).alias(f"{c}__min"), F.max(ln).alias(f"{c}__max"),
                  F.avg(ln).alias(f"{c}__mean"), F.count_if(ln == 0).alias(f"{c}__empty"),
                  F.count(t).alias(f"{c}__n"),
                  F.count_if(F.lower(t) != cleaned).alias(f"{c}__changed"),
                  F.count_if(ln > LONG_TEXT).alias(f"{c}__long"),
                  F.count_if(t.rlike(URL_PATTERN)).alias(f"{c}__url"),
                  F.count_if(t.rlike(EMAIL_PATTERN)).alias(f"{c}__email"),
                  F.count_if(t.rlike(DIGIT_PATTERN)).alias(f"{c}__digit"),
                  F.count_if(F.regexp_replace(t, r"(?U)^\s+|\s+$", "") == "").alias(f"{c}__blank")]
    agg = df.agg(*exprs)
    out = _unpivot(agg, cols, lambda c: F.struct(
        F.lit(c).alias("column"), F.col(f"{c}__min").alias("min_length"), F.col(f"{c}__max").alias("max_length"),
        F.round(F.col(f"{c}__mean"), 6).alias("mean_length"), F.col(f"{c}__empty").alias("empty_strings"),
        F.col(f"{c}__changed").alias("rows_with_non_alphanumeric"),
        pct(F.col(f"{c}__changed"), F.col(f"{c}__n")).alias("non_alphanumeric_percentage"),
        F.col(f"{c}__long").alias("very_long_values"), F.col(f"{c}__url").alias("contains_urls"),
        F.col(f"{c}__email").alias("contains_emails"), F.col(f"{c}__digit").alias("contains_numbers"),
        F.col(f"{c}__blank").alias("all_whitespace")))
    distinct = exact_distinct(df, {f"{s}|{c}": v for c in cols for s, v in (
        ("as is", F.col(c)), ("cleaned", F.regexp_replace(F.lower(F.col(c)), NON_ALPHA_PATTERN, "")))})
    unique = distinct.groupBy(F.substring_index("name", "|", -1).alias("of")).agg(
        *[F.max(F.when(F.startswith("name", F.lit(f"{s}|")), F.col("distinct"))).alias(n) for s, n in (("as is", "_u"), ("cleaned", "_uc"))])
    u, uc = (F.coalesce(n, F.lit(0)).cast("bigint") for n in ("_u", "_uc"))
    return out.join(unique, F.col("column") == F.col("of"), "left").select(
        *out.columns, u.alias("case_sensitive_unique"), uc.alias("case_insensitive_unique"), (u - uc).alias("unique_count_reduction"))


def first_distinct_values(df: DataFrame, col: str, order: str, k: int = 20) -> DataFrame:
    """A15 sample values: the first k distinct values by first appearance."""
    firsts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("first_seen"))
    return firsts.orderBy("first_seen").limit(k)


# A16 ----------------------------------------------------------------------------------
def datetime_profile(df: DataFrame, cols) -> DataFrame:
    """Min, max and whole days between them (floor of the interval)."""
    exprs = []
    for c in cols:
        exprs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    agg = df.agg(*exprs)
    return _unpivot(agg, cols, lambda c: F.struct(
        F.lit(c).alias("column"),
        F.date_format(F.col(f"{c}__min"), "yyyy-MM-dd HH:mm:ss").alias("min_date"),
        F.date_format(F.col(f"{c}__max"), "yyyy-MM-dd HH:mm:ss").alias("max_date"),
        F.floor((F.unix_micros(F.col(f"{c}__max").cast("timestamp"))
                 - F.unix_micros(F.col(f"{c}__min").cast("timestamp"))) / 86400000000).cast("int").alias("date_range_days")))


# S11 ----------------------------------------------------------------------------------
def value_frequencies(df: DataFrame, col: str) -> DataFrame:
    """Value, count, percent of non-null values (2 dp), rank by count desc.

    The total is a scalar subquery; the rank is a global ordering, computed on the
    grouped result (one row per distinct value).
    """
    data = df.filter(F.col(col).isNotNull())
    total = data.agg(F.count(F.lit(1))).scalar()
    counts = data.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    ranked = global_row_number(counts, [F.desc("count"), F.col(col)], "rank")
    return ranked.select(F.col(col).alias("value"), "count",
                         pct(F.col("count"), F.lit(total)).alias("percent"), "rank")
