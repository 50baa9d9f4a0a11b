"""Registered queries: recommendation."""

import uuid

from pyspark.sql import functions as F

from cartwise.operators import models as MD
from cartwise.operators import recommend as R
from cartwise.operators.lookup import Lookup, save_lookup
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import bundles, register
from cartwise.plans.q_models import BASE, GNB, MNB, split, vocab_of
from cartwise.session import checkpoint_dir
from cartwise.sources.tables import table


def engine(spark, sf):
    """Both Naive Bayes recommenders fitted on the training split (SQL-checkable)."""
    data = split(spark, sf)
    vocab = vocab_of(spark, sf)
    train = data.filter(~F.col("is_test"))
    return {"nb": MD.fit_multinomial_nb(train, vocab, one_row_a_key=True), "gnb": MD.fit_gaussian_nb(train, vocab, one_row_a_key=True)}, data


def svm_engine(spark, sf):
    """The ensemble of Naive Bayes and the SVM (R01S, R06S, R07S; no SQL twin: an iterative fit)."""
    data = split(spark, sf)
    return MD.fit_all(data.filter(~F.col("is_test")), vocab_of(spark, sf), ("nb", "svm"), one_row_a_key=True), data


def basket_requests(data):
    return data.filter("is_test").select(F.col("InvoiceNo").alias("request_id"), F.col("Items").alias("items"))


def product_requests(spark, sf):
    """One request per part: its product name (lower-cased)."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"),
                                           F.array(F.lower("p_name")).alias("items"),
                                           F.lower("p_name").alias("selected"))


# -------------------------------------------------------------------- oracle CTEs
def req_scores_sql(req_cte):
    """Per (request, model) P(1) for both NB models over a request CTE (request_id, item)."""
    return f"""
rs AS (SELECT r.request_id, 'nb' AS recommender, 1.0 / (1.0 + exp((pri.b0 + coalesce(sum(prm.w0), 0)) - (pri.b1 + coalesce(sum(prm.w1), 0)))) AS confidence
       FROM (SELECT DISTINCT request_id FROM {req_cte}) r LEFT JOIN (SELECT DISTINCT request_id, item FROM {req_cte}) ri ON r.request_id = ri.request_id
       LEFT JOIN prm ON ri.item = prm.item, pri GROUP BY r.request_id, pri.b0, pri.b1
       UNION ALL
       SELECT r.request_id, 'gnb', 1.0 / (1.0 + exp((gpri.b0 + coalesce(sum(gl.w0), 0)) - (gpri.b1 + coalesce(sum(gl.w1), 0))))
       FROM (SELECT DISTINCT request_id FROM {req_cte}) r LEFT JOIN (SELECT DISTINCT request_id, item FROM {req_cte}) ri ON r.request_id = ri.request_id
       LEFT JOIN gl ON ri.item = gl.item, gpri GROUP BY r.request_id, gpri.b0, gpri.b1)"""


BREQ = "breq AS (SELECT InvoiceNo AS request_id, unnest(item_list) AS item FROM spl WHERE is_test)"
PREQ = "preq AS (SELECT p_partkey AS request_id, lower(p_name) AS item FROM part)"
MODEL_CTES = (*BASE, MNB, GNB)

APPL = """
hits AS (SELECT DISTINCT r.request_id, b.bundle, b.size, b.support_count FROM REQ r
         JOIN (SELECT bundle, size, support_count, unnest(items) AS item FROM bundles) b ON r.item = b.item),
appl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY size, support_count DESC, bundle) AS rank FROM hits)
         WHERE rank <= TOPN)
"""


@register("R01", S.with_ctes(*MODEL_CTES, BREQ, req_scores_sql("breq"), body="""
SELECT request_id, round(avg(confidence), 6) AS confidence, 'ensemble' AS recommender FROM rs GROUP BY request_id"""))
def r01(spark, sf):
    models, data = engine(spark, sf)
    c = R.confidence(basket_requests(data), models)
    return c.select("request_id", F.round("confidence", 6).alias("confidence"), "recommender")


@register("R01S")
def r01s(spark, sf):
    """R01 with the mean of Naive Bayes and SVM."""
    models, data = svm_engine(spark, sf)
    c = R.confidence(basket_requests(data), models)
    return c.select("request_id", F.round("confidence", 6).alias("confidence"), "recommender")


@register("R02", S.with_ctes(*MODEL_CTES, BREQ, req_scores_sql("breq"),
                             "ens AS (SELECT request_id, avg(confidence) AS confidence FROM rs GROUP BY request_id)",
                             APPL.replace("REQ", "breq").replace("TOPN", "5"), body="""
SELECT a.request_id, a.rank, a.bundle FROM appl a JOIN ens e ON a.request_id = e.request_id WHERE e.confidence >= 0.5"""))
def r02(spark, sf):
    return basket_recommendations(spark, sf).select("request_id", F.col("rank").cast("bigint").alias("rank"), "bundle")


def basket_recommendations(spark, sf):
    """R02 with the arrays of items, as R03 takes them."""
    models, data = engine(spark, sf)
    reqs = basket_requests(data)
    return R.recommend_bundles(reqs, R.confidence(reqs, models), bundles(spark, sf), 0.5, 5)


CROSS = """
bi2 AS (SELECT bundle, size, unnest(items) AS item FROM bundles),
rq AS (SELECT DISTINCT request_id, item FROM REQ),
ov AS (SELECT r.request_id, b.bundle, b.size, count(*) AS ov FROM rq r JOIN bi2 b ON r.item = b.item GROUP BY r.request_id, b.bundle, b.size),
cand AS (SELECT r.request_id, c.item AS product FROM (SELECT DISTINCT request_id FROM rq) r, (SELECT DISTINCT item FROM bi2) c
         WHERE NOT EXISTS (SELECT 1 FROM rq x WHERE x.request_id = r.request_id AND x.item = c.item)),
xs AS (SELECT cand.request_id, cand.product, CAST(coalesce(sum(ov.ov * (60 // ov.size)), 0) AS BIGINT) AS num,
              coalesce(sum(ov.ov * (60 // ov.size)), 0) / 60 AS score FROM cand
       LEFT JOIN bi2 ON bi2.item = cand.product LEFT JOIN ov ON ov.request_id = cand.request_id AND ov.bundle = bi2.bundle
       GROUP BY cand.request_id, cand.product),
xr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY num DESC, product) AS rank FROM xs) WHERE rank <= 5)
"""


@register("R05", S.with_ctes(*BASE, BREQ, CROSS.replace("REQ", "breq"), body="""
SELECT request_id, product, round(score, 9) AS score, rank FROM xr"""))
def r05(spark, sf):
    data = split(spark, sf)
    out = R.cross_sell(basket_requests(data), bundles(spark, sf), 5)
    return out.select("request_id", "product", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


R06_SQL = S.with_ctes(*MODEL_CTES, PREQ, req_scores_sql("preq"), APPL.replace("REQ", "preq").replace("TOPN", "5"), body="""
SELECT s.request_id, s.recommender, round(s.confidence, 3) AS confidence, a.rank, a.bundle
FROM rs s JOIN appl a ON s.request_id = a.request_id WHERE s.confidence >= 0.3""")


def lookup_engine(spark, sf):
    """The engine saved as item-bucketed tables and opened again."""
    at = f"{checkpoint_dir(spark)}/lookup-{uuid.uuid4().hex}"
    save_lookup(engine(spark, sf)[0], bundles(spark, sf), at)
    return Lookup.open(spark, at)


@register("R06L", R06_SQL)
def r06l(spark, sf):
    """R06 answered from the saved engine."""
    return lookup_engine(spark, sf).batch(product_requests(spark, sf))


@register("R06", R06_SQL)
def r06(spark, sf):
    return product_recommendations(spark, sf).select(
        "request_id", "recommender", "confidence", F.col("rank").cast("bigint").alias("rank"), "bundle")


@register("R06S")
def r06s(spark, sf):
    """R06 with the scores of Naive Bayes and SVM."""
    return product_recommendations(spark, sf, svm_engine).select(
        "request_id", "recommender", "confidence", F.col("rank").cast("bigint").alias("rank"), "bundle")


@register("R07S")
def r07s(spark, sf):
    """R07 with the mean of Naive Bayes and SVM."""
    return ensemble_scores(spark, sf, svm_engine)


def product_recommendations(spark, sf, engine=engine):
    """R06 with the arrays of items, as R09 takes them."""
    models, _ = engine(spark, sf)
    reqs = product_requests(spark, sf)
    scores = R.model_scores(reqs, models).filter(F.col("confidence") >= 0.3)
    appl = R.applicable_bundles(reqs.join(scores.select("request_id").distinct(), "request_id", "left_semi"),
                                bundles(spark, sf), 5)
    return scores.join(appl, "request_id").withColumn("confidence", F.round("confidence", 3))


@register("R07", S.with_ctes(*MODEL_CTES, PREQ, req_scores_sql("preq"), body="""
SELECT request_id, round(coalesce(avg(confidence), 0), 3) AS ensemble_confidence, count(*) AS total_models FROM rs GROUP BY request_id"""))
def r07(spark, sf):
    return ensemble_scores(spark, sf)


def ensemble_scores(spark, sf, engine=engine):
    models, _ = engine(spark, sf)
    s = R.model_scores(product_requests(spark, sf), models)
    return s.groupBy("request_id").agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("ensemble_confidence"),
                                       F.count(F.lit(1)).alias("total_models"))


@register("R08", S.with_ctes(*BASE, PREQ, CROSS.replace("REQ", "preq"), body="""
SELECT request_id, product, round(score, 3) AS affinity, rank FROM xr"""))
def r08(spark, sf):
    out = R.cross_sell(product_requests(spark, sf), bundles(spark, sf), 5)
    return out.select("request_id", "product", F.round("score", 3).alias("affinity"), F.col("rank").cast("bigint").alias("rank"))


@register("R09", S.with_ctes(*MODEL_CTES, PREQ, req_scores_sql("preq"), APPL.replace("REQ", "preq").replace("TOPN", "5"), """
recs AS (SELECT s.request_id, s.recommender, round(s.confidence, 3) AS confidence, a.bundle
         FROM rs s JOIN appl a ON s.request_id = a.request_id WHERE s.confidence >= 0.3),
ex AS (SELECT recs.request_id, recs.confidence, unnest(string_split(recs.bundle, '|')) AS product FROM recs),
ag AS (SELECT ex.request_id, ex.product, avg(ex.confidence) AS confidence, count(*) AS frequency FROM ex
       JOIN preq p ON p.request_id = ex.request_id WHERE lower(ex.product) <> lower(p.item) GROUP BY ex.request_id, ex.product)""", body="""
SELECT request_id, product, round(confidence, 6) AS confidence, frequency, rank
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, product) AS rank FROM ag) WHERE rank <= 3"""))
def r09(spark, sf):
    out = R.suggestions(product_recommendations(spark, sf), product_requests(spark, sf), 3)
    return out.select("request_id", "product", F.round("confidence", 6).alias("confidence"), "frequency",
                      F.col("rank").cast("bigint").alias("rank"))
