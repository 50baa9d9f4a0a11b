"""Registered queries: mining and bundle statistics."""

from pyspark.sql import functions as F

from cartwise.operators import mining as M
from cartwise.operators.baskets import bundle_size_distribution, bundle_statistics, top_bundles
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import (BUNDLE_SUPPORT, MAX_BUNDLE_SIZE, RULE_CONFIDENCE, TRIPLE_SUPPORT, _memo, baskets,
                                    bundles, register)

_BUNDLE_COLS = "bundle, size, support_count, support"


@register("M01", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, body=f"""
SELECT item, count(*) AS item_count, round(count(*) / (SELECT n FROM nb), 9) AS support
FROM (SELECT unnest(item_list) AS item FROM baskets) GROUP BY item
HAVING count(*) / (SELECT n FROM nb) >= 0.05"""))
def m01(spark, sf):
    return M.frequent_items(baskets(spark, sf), 0.05)


@register("M02", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(BUNDLE_SUPPORT, MAX_BUNDLE_SIZE),
                             body=f"SELECT {_BUNDLE_COLS} FROM bundles"))
def m02(spark, sf):
    return bundles(spark, sf, BUNDLE_SUPPORT, MAX_BUNDLE_SIZE).select("bundle", "size", "support_count", "support")


@register("M02T", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(TRIPLE_SUPPORT, MAX_BUNDLE_SIZE),
                              body=f"SELECT {_BUNDLE_COLS} FROM bundles"))
def m02t(spark, sf):
    return bundles(spark, sf, TRIPLE_SUPPORT, MAX_BUNDLE_SIZE).select("bundle", "size", "support_count", "support")


def levelwise(spark, sf):
    return _memo(spark, (sf, "levelwise", TRIPLE_SUPPORT, MAX_BUNDLE_SIZE),
                 lambda: M.mine_bundles_levelwise(baskets(spark, sf), TRIPLE_SUPPORT, MAX_BUNDLE_SIZE))


@register("M03", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(TRIPLE_SUPPORT, MAX_BUNDLE_SIZE),
                             body=f"SELECT {_BUNDLE_COLS} FROM bundles"))
def m03(spark, sf):
    return levelwise(spark, sf).select("bundle", "size", "support_count", "support")


@register("M03L", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(TRIPLE_SUPPORT, MAX_BUNDLE_SIZE),
                              f"lv AS (SELECT CAST(unnest(range(2, {MAX_BUNDLE_SIZE + 1})) AS INTEGER) AS size)", body="""
SELECT l.size, CAST(coalesce(c.n, 0) AS BIGINT) AS n_itemsets FROM lv l
LEFT JOIN (SELECT size, count(*) AS n FROM bundles GROUP BY size) c ON l.size = c.size
WHERE l.size <= coalesce((SELECT min(size) FROM lv WHERE size NOT IN (SELECT size FROM bundles)), (SELECT max(size) FROM lv))"""))
def m03l(spark, sf):
    return M.level_counts(levelwise(spark, sf), MAX_BUNDLE_SIZE)


@register("M04", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(BUNDLE_SUPPORT, MAX_BUNDLE_SIZE), f"""
single AS (SELECT item, count(*) AS c FROM bi GROUP BY item),
rules AS (
  SELECT b.items[2] AS antecedent, b.items[1] AS consequent, b.support_count AS sc FROM bundles b WHERE b.size = 2
  UNION ALL
  SELECT b.items[1], b.items[2], b.support_count FROM bundles b WHERE b.size = 2)
""", body=f"""
SELECT r.antecedent, r.consequent, round(r.sc / s.c, 9) AS confidence,
       round((r.sc / s.c) / (t.c / (SELECT n FROM nb)), 6) AS lift,
       round(r.sc / (SELECT n FROM nb), 9) AS support
FROM rules r JOIN single s ON r.antecedent = s.item JOIN single t ON r.consequent = t.item
WHERE r.sc / s.c >= {RULE_CONFIDENCE}"""))
def m04(spark, sf):
    return M.association_rules(baskets(spark, sf), BUNDLE_SUPPORT, RULE_CONFIDENCE)


_SAMPLE_CTE = """
smp AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || InvoiceNo), InvoiceNo) AS rk FROM baskets)
        WHERE rk <= greatest(25, (SELECT n FROM nb) // 200)),
sbi AS (SELECT DISTINCT InvoiceNo, unnest(item_list) AS item FROM smp),
sn AS (SELECT count(*) AS n FROM smp)
"""


@register("M05", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, _SAMPLE_CTE, body=f"""
SELECT a.item || '|' || b.item AS bundle, 2 AS size, count(*) AS support_count,
       round(count(*) / (SELECT n FROM sn), 9) AS support
FROM sbi a JOIN sbi b ON a.InvoiceNo = b.InvoiceNo AND a.item < b.item
GROUP BY a.item, b.item HAVING count(*) >= 0.03 * (SELECT n FROM sn)"""))
def m05(spark, sf):
    return M.quick_mine(baskets(spark, sf), 0.03).select("bundle", "size", "support_count", "support")


@register("M05S", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, _SAMPLE_CTE,
                              body="SELECT InvoiceNo FROM smp"))
def m05s(spark, sf):
    b = baskets(spark, sf)
    return M.hash_sample(b, "InvoiceNo", M.quick_sample_size(b.count())).select("InvoiceNo")


@register("A20", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(TRIPLE_SUPPORT, MAX_BUNDLE_SIZE), body="""
SELECT count(*) AS total_bundles, min(size) AS min_size, max(size) AS max_size,
       round(avg(size), 6) AS avg_size, (SELECT n FROM nb) AS n_baskets FROM bundles"""))
def a20(spark, sf):
    b = baskets(spark, sf)
    stats = bundle_statistics(bundles(spark, sf, TRIPLE_SUPPORT))
    return stats.withColumn("n_baskets", F.lit(b.agg(F.count(F.lit(1))).scalar()))


@register("A20D", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(TRIPLE_SUPPORT, MAX_BUNDLE_SIZE),
                              body="SELECT size, count(*) AS n_bundles FROM bundles GROUP BY size"))
def a20d(spark, sf):
    return bundle_size_distribution(bundles(spark, sf, TRIPLE_SUPPORT, MAX_BUNDLE_SIZE))


@register("A20T", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(TRIPLE_SUPPORT, MAX_BUNDLE_SIZE), body=f"""
SELECT {_BUNDLE_COLS} FROM bundles ORDER BY size, support_count DESC, bundle LIMIT 10"""))
def a20t(spark, sf):
    return top_bundles(bundles(spark, sf, TRIPLE_SUPPORT, MAX_BUNDLE_SIZE)).select("bundle", "size", "support_count", "support")
