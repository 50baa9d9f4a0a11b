"""Registered queries: features, labels, splits, Naive Bayes, metrics."""

from pyspark.sql import functions as F

from cartwise.operators import features as X
from cartwise.operators import metrics as MT
from cartwise.operators import models as MD
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import BUNDLE_SUPPORT, MAX_BUNDLE_SIZE, baskets, bundles, register
from cartwise.sources.tables import table

N_SPLITS = 10

# ------------------------------------------------------------------ shared Spark inputs
def labelled(spark, sf):
    from cartwise.plans.catalog import _memo
    return _memo(spark, (sf, "labelled"),
                 lambda: X.label_baskets(baskets(spark, sf), bundles(spark, sf), one_row_a_key=True))


def split(spark, sf):
    return X.random_split(labelled(spark, sf), 0.2, 42)


def vocab_of(spark, sf):
    from cartwise.plans.catalog import _memo
    return _memo(spark, (sf, "vocab"), lambda: X.vocabulary(baskets(spark, sf)))


def nb_model(spark, sf, kind="multinomial"):
    data = split(spark, sf)
    vocab = vocab_of(spark, sf)
    train = data.filter(~F.col("is_test"))
    fit = MD.fit_multinomial_nb if kind == "multinomial" else MD.fit_gaussian_nb
    return fit(train, vocab, one_row_a_key=True), data


# ------------------------------------------------------------------ shared oracle CTEs
LABELS = """
lab AS (SELECT b.*, CASE WHEN h.InvoiceNo IS NULL THEN 0 ELSE 1 END AS label FROM baskets b LEFT JOIN
        (SELECT DISTINCT x.InvoiceNo FROM bi x JOIN (SELECT bundle, size, unnest(items) AS item FROM bundles) y
           ON x.item = y.item GROUP BY x.InvoiceNo, y.bundle, y.size HAVING count(*) = y.size) h
        ON b.InvoiceNo = h.InvoiceNo),
spl AS (SELECT *, CAST(('0x' || substr(md5('42|' || InvoiceNo), 1, 8)) AS BIGINT) / 4294967296 >= 0.8 AS is_test FROM lab),
vocab AS (SELECT DISTINCT item FROM bi),
trn AS (SELECT * FROM spl WHERE NOT is_test),
tc AS (SELECT bi.item, trn.label FROM bi JOIN trn ON bi.InvoiceNo = trn.InvoiceNo),
ci AS (SELECT vocab.item, count(tc.label) FILTER (WHERE tc.label = 0) AS c0,
              count(tc.label) FILTER (WHERE tc.label = 1) AS c1
       FROM vocab LEFT JOIN tc ON vocab.item = tc.item GROUP BY vocab.item),
cls AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM trn)
"""

MNB = """
prm AS (SELECT item, ln((c0 + 1) / (t.t0 + (SELECT count(*) FROM vocab))) AS w0,
               ln((c1 + 1) / (t.t1 + (SELECT count(*) FROM vocab))) AS w1
        FROM ci, (SELECT sum(c0) AS t0, sum(c1) AS t1 FROM ci) t),
pri AS (SELECT ln(n0 / (n0 + n1)) AS b0, ln(n1 / (n0 + n1)) AS b1 FROM cls),
sc AS (SELECT s.InvoiceNo, s.label, s.is_test, pri.b0 + coalesce(sum(prm.w0), 0) AS j0, pri.b1 + coalesce(sum(prm.w1), 0) AS j1
       FROM spl s LEFT JOIN bi ON s.InvoiceNo = bi.InvoiceNo LEFT JOIN prm ON bi.item = prm.item, pri
       GROUP BY s.InvoiceNo, s.label, s.is_test, pri.b0, pri.b1),
pred AS (SELECT InvoiceNo, label, is_test, 1.0 / (1.0 + exp(j0 - j1)) AS p1, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS prediction FROM sc)
"""

GNB = """
eps AS (SELECT 1e-9 * max(((c0 + c1) / (SELECT n0 + n1 FROM cls)) * (1 - (c0 + c1) / (SELECT n0 + n1 FROM cls))) AS e FROM ci),
g AS (SELECT item, c0 / (SELECT n0 FROM cls) AS m0, c1 / (SELECT n1 FROM cls) AS m1 FROM ci),
gv AS (SELECT item, m0, m1, m0 * (1 - m0) + (SELECT e FROM eps) AS v0, m1 * (1 - m1) + (SELECT e FROM eps) AS v1 FROM g),
gl AS (SELECT item, -0.5 * ln(2 * pi() * v0) - 0.5 * (m0 * m0) / v0 AS z0, -0.5 * ln(2 * pi() * v1) - 0.5 * (m1 * m1) / v1 AS z1,
              (-0.5 * ln(2 * pi() * v0) - 0.5 * ((1 - m0) * (1 - m0)) / v0) - (-0.5 * ln(2 * pi() * v0) - 0.5 * (m0 * m0) / v0) AS w0,
              (-0.5 * ln(2 * pi() * v1) - 0.5 * ((1 - m1) * (1 - m1)) / v1) - (-0.5 * ln(2 * pi() * v1) - 0.5 * (m1 * m1) / v1) AS w1 FROM gv),
gpri AS (SELECT ln(n0 / (n0 + n1)) + (SELECT sum(z0) FROM gl) AS b0, ln(n1 / (n0 + n1)) + (SELECT sum(z1) FROM gl) AS b1 FROM cls),
gsc AS (SELECT s.InvoiceNo, s.label, s.is_test, gpri.b0 + coalesce(sum(gl.w0), 0) AS j0, gpri.b1 + coalesce(sum(gl.w1), 0) AS j1
        FROM spl s LEFT JOIN bi ON s.InvoiceNo = bi.InvoiceNo LEFT JOIN gl ON bi.item = gl.item, gpri
        GROUP BY s.InvoiceNo, s.label, s.is_test, gpri.b0, gpri.b1),
gpred AS (SELECT InvoiceNo, label, is_test, 1.0 / (1.0 + exp(j0 - j1)) AS p1, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS prediction FROM gsc)
"""

BASE = (S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(BUNDLE_SUPPORT, MAX_BUNDLE_SIZE), LABELS)


def metrics_sql(src):
    return f"""SELECT round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 9) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 9) AS precision,
  round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1
FROM (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
      FROM {src})"""


@register("L01", S.with_ctes(*BASE, body="""SELECT bi.InvoiceNo, bi.item, v.idx AS index FROM bi
JOIN (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM vocab) v ON bi.item = v.item"""))
def l01(spark, sf):
    b = baskets(spark, sf)
    return X.encode(b, X.vocabulary(b)).select("InvoiceNo", "item", F.col("index").cast("bigint").alias("index"))


@register("L02", S.with_ctes(*BASE, body="SELECT InvoiceNo, label FROM lab"))
def l02(spark, sf):
    return labelled(spark, sf).select("InvoiceNo", "label")


@register("L03", S.with_ctes(*BASE, body="SELECT InvoiceNo, is_test FROM spl"))
def l03(spark, sf):
    return split(spark, sf).select("InvoiceNo", "is_test")


@register("L04", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, body="""SELECT InvoiceNo,
  CAST((row_number() OVER (ORDER BY md5('42|' || InvoiceNo), InvoiceNo) - 1) % 10 AS INTEGER) AS fold FROM baskets"""))
def l04(spark, sf):
    return X.kfold(baskets(spark, sf), 10, 42, one_row_a_key=True).select("InvoiceNo", "fold")


@register("L06", S.with_ctes(*BASE, MNB, body="SELECT InvoiceNo, label, round(p1, 6) AS p1, prediction FROM pred WHERE is_test"))
def l06(spark, sf):
    model, data = nb_model(spark, sf)
    return model.predict_proba(data.filter("is_test")).select("InvoiceNo", "label", F.round("p1", 6).alias("p1"), "prediction")


@register("L06P", S.with_ctes(*BASE, MNB, body="SELECT item, round(w0, 9) AS w0, round(w1, 9) AS w1 FROM prm"))
def l06p(spark, sf):
    model, _ = nb_model(spark, sf)
    return model.params.select("item", F.round("w0", 9).alias("w0"), F.round("w1", 9).alias("w1"))


@register("L07", S.with_ctes(*BASE, GNB, body="SELECT InvoiceNo, label, round(p1, 6) AS p1, prediction FROM gpred WHERE is_test"))
def l07(spark, sf):
    model, data = nb_model(spark, sf, "gaussian")
    return model.predict_proba(data.filter("is_test")).select("InvoiceNo", "label", F.round("p1", 6).alias("p1"), "prediction")


@register("L12", S.with_ctes(*BASE, MNB, body=metrics_sql("pred WHERE is_test")))
def l12(spark, sf):
    model, data = nb_model(spark, sf)
    return MT.binary_metrics(model.predict_proba(data.filter("is_test")))


CV_SQL = """
fl AS (SELECT *, CAST((row_number() OVER (ORDER BY md5('42|' || InvoiceNo), InvoiceNo) - 1) % 10 AS INTEGER) AS fold FROM lab),
fs AS (SELECT DISTINCT fold AS k FROM fl),
ftc AS (SELECT fs.k, bi.item, fl.label FROM fs JOIN fl ON fl.fold <> fs.k JOIN bi ON bi.InvoiceNo = fl.InvoiceNo),
fci AS (SELECT fs.k, vocab.item, count(ftc.label) FILTER (WHERE ftc.label = 0) AS c0, count(ftc.label) FILTER (WHERE ftc.label = 1) AS c1
        FROM fs CROSS JOIN vocab LEFT JOIN ftc ON ftc.k = fs.k AND ftc.item = vocab.item GROUP BY fs.k, vocab.item),
ftot AS (SELECT k, sum(c0) AS t0, sum(c1) AS t1 FROM fci GROUP BY k),
fprm AS (SELECT fci.k, item, ln((c0 + 1) / (t0 + (SELECT count(*) FROM vocab))) AS w0, ln((c1 + 1) / (t1 + (SELECT count(*) FROM vocab))) AS w1
         FROM fci JOIN ftot ON fci.k = ftot.k),
fpri AS (SELECT fs.k, ln(count(*) FILTER (WHERE fl.label = 0) / count(*)) AS b0, ln(count(*) FILTER (WHERE fl.label = 1) / count(*)) AS b1
         FROM fs JOIN fl ON fl.fold <> fs.k GROUP BY fs.k),
fsc AS (SELECT fl.InvoiceNo, fl.fold, fl.label, fpri.b0 + coalesce(sum(fprm.w0), 0) AS j0, fpri.b1 + coalesce(sum(fprm.w1), 0) AS j1
        FROM fl JOIN fpri ON fpri.k = fl.fold LEFT JOIN bi ON bi.InvoiceNo = fl.InvoiceNo
        LEFT JOIN fprm ON fprm.k = fl.fold AND fprm.item = bi.item
        GROUP BY fl.InvoiceNo, fl.fold, fl.label, fpri.b0, fpri.b1),
fcl AS (SELECT fs.k, count(*) FILTER (WHERE fl.label = 0) AS n0, count(*) FILTER (WHERE fl.label = 1) AS n1
        FROM fs JOIN fl ON fl.fold <> fs.k GROUP BY fs.k),
fmu AS (SELECT fci.k, fci.item, c0 / n0 AS m0, c1 / n1 AS m1, (c0 + c1) / (n0 + n1) AS pa FROM fci JOIN fcl ON fci.k = fcl.k),
fvar AS (SELECT k, item, m0, m1, m0 * (1 - m0) + 1e-9 * max(pa * (1 - pa)) OVER (PARTITION BY k) AS v0,
                m1 * (1 - m1) + 1e-9 * max(pa * (1 - pa)) OVER (PARTITION BY k) AS v1 FROM fmu),
fgl AS (SELECT k, item, -0.5 * ln(2 * pi() * v0) - 0.5 * m0 * m0 / v0 AS z0, -0.5 * ln(2 * pi() * v1) - 0.5 * m1 * m1 / v1 AS z1,
               0.5 * (m0 * m0 - (1 - m0) * (1 - m0)) / v0 AS w0, 0.5 * (m1 * m1 - (1 - m1) * (1 - m1)) / v1 AS w1 FROM fvar),
fgp AS (SELECT fgl.k, ln(any_value(n0) / (any_value(n0) + any_value(n1))) + sum(z0) AS b0,
               ln(any_value(n1) / (any_value(n0) + any_value(n1))) + sum(z1) AS b1 FROM fgl JOIN fcl ON fgl.k = fcl.k GROUP BY fgl.k),
fgs AS (SELECT fl.InvoiceNo, fl.fold, fl.label, fgp.b0 + coalesce(sum(fgl.w0), 0) AS j0, fgp.b1 + coalesce(sum(fgl.w1), 0) AS j1
        FROM fl JOIN fgp ON fgp.k = fl.fold LEFT JOIN bi ON bi.InvoiceNo = fl.InvoiceNo
        LEFT JOIN fgl ON fgl.k = fl.fold AND fgl.item = bi.item GROUP BY fl.InvoiceNo, fl.fold, fl.label, fgp.b0, fgp.b1),
fpred AS (SELECT 'nb' AS model, fold, label, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS prediction FROM fsc
          UNION ALL SELECT 'gnb', fold, label, CASE WHEN j1 > j0 THEN 1 ELSE 0 END FROM fgs),
fm AS (SELECT model, fold, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
              CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
              CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
              CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
       FROM (SELECT model, fold, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
             FROM fpred GROUP BY model, fold))
"""


@register("L13", S.with_ctes(*BASE, CV_SQL, body="""SELECT model,
  round(avg(accuracy), 9) AS accuracy, round(stddev_pop(accuracy), 9) AS std_accuracy,
  round(avg(precision), 9) AS precision, round(stddev_pop(precision), 9) AS std_precision,
  round(avg(recall), 9) AS recall, round(stddev_pop(recall), 9) AS std_recall,
  round(avg(f1), 9) AS f1, round(stddev_pop(f1), 9) AS std_f1, CAST(count(*) AS INTEGER) AS n_splits FROM fm GROUP BY model"""))
def l13(spark, sf):
    return MD.cross_validate(folds(spark, sf), vocab_of(spark, sf), N_SPLITS, one_row_a_key=True)


def folds(spark, sf):
    from cartwise.plans.catalog import _memo
    return _memo(spark, (sf, "folds", N_SPLITS), lambda: X.kfold(labelled(spark, sf), N_SPLITS, 42, one_row_a_key=True))


@register("L13M", S.with_ctes(*BASE, CV_SQL, body="SELECT item, round(w0, 9) AS w0, round(w1, 9) AS w1 FROM fprm WHERE k = 9"))
def l13m(spark, sf):
    return MD.fit_all_with_kfold(folds(spark, sf), vocab_of(spark, sf), N_SPLITS, one_row_a_key=True)[0]["nb"].params.select("item", F.round("w0", 9).alias("w0"), F.round("w1", 9).alias("w1"))


@register("L14", S.with_ctes(*BASE, MNB, GNB, body="SELECT 'nb' AS model, * FROM (" + metrics_sql("pred WHERE is_test")
                             + ") UNION ALL SELECT 'gnb', * FROM (" + metrics_sql("gpred WHERE is_test") + ")"))
def l14(spark, sf):
    return MD.fit_all_with_random_split(split(spark, sf), vocab_of(spark, sf), ("nb", "gnb"), one_row_a_key=True)[1]


@register("L09")
def l09(spark, sf):
    """Margin classes and Platt probabilities of the test baskets (no SQL twin: an iterative fit)."""
    data = split(spark, sf)
    svm = MD.fit_svm(data.filter(~F.col("is_test")), one_row_a_key=True)
    return svm.predict_proba(data.filter("is_test"), one_row_a_key=True).select("InvoiceNo", "label", F.round("p1", 6).alias("p1"), "prediction")


def _kernel_scores(spark, sf, kernel):
    """Classes and Platt probabilities of the test baskets by a kernel machine (no SQL twin: an approximate, iterative fit)."""
    data = split(spark, sf)
    svm = MD.fit_svm(data.filter(~F.col("is_test")), kernel=kernel)
    return svm.predict_proba(data.filter("is_test")).select("InvoiceNo", "label", F.round("p1", 6).alias("p1"), "prediction")


@register("L11")
def l11(spark, sf):
    return _kernel_scores(spark, sf, "rbf")


@register("L11P")
def l11p(spark, sf):
    return _kernel_scores(spark, sf, "poly")


@register("L11S")
def l11s(spark, sf):
    return _kernel_scores(spark, sf, "sigmoid")


@register("L17", S.with_ctes(*BASE, MNB, GNB, body="""SELECT p.InvoiceNo AS request_id, round(p.p1, 6) AS nb, round(g.p1, 6) AS gnb
FROM pred p JOIN gpred g ON p.InvoiceNo = g.InvoiceNo WHERE p.is_test"""))
def l17(spark, sf):
    return compared_scores(spark, sf, ("nb", "gnb"))


def compared_scores(spark, sf, names, ensemble=()):
    data = split(spark, sf)
    models = MD.fit_all(data.filter(~F.col("is_test")), vocab_of(spark, sf), names, one_row_a_key=True)
    scores = None
    for n, m in models.items():
        rows = m.predict_proba(data.filter("is_test"), one_row_a_key=True).select(
            F.col("InvoiceNo").alias("request_id"), F.lit(n).alias("model"), F.round("p1", 6).alias("confidence"))
        scores = rows if scores is None else scores.unionByName(rows)
    return MT.side_by_side(scores, models=list(names), ensemble=ensemble)


# The same with the SVM, which has no SQL twin (an iterative fit): L13S, L14S, L16S, L17S.
ALL_MODELS = ("nb", "gnb", "svm")


@register("L13S")
def l13s(spark, sf):
    return MD.cross_validate(folds(spark, sf), vocab_of(spark, sf), N_SPLITS, ALL_MODELS, one_row_a_key=True)


@register("L14S")
def l14s(spark, sf):
    return MD.fit_all_with_random_split(split(spark, sf), vocab_of(spark, sf), ALL_MODELS, one_row_a_key=True)[1]


@register("L16S")
def l16s(spark, sf):
    return MT.compare(l14s(spark, sf), l13s(spark, sf)).select("model", *_L16)


@register("L17S")
def l17s(spark, sf):
    """NB, Gaussian NB and SVM side by side; the ensemble is the mean of NB and SVM."""
    return compared_scores(spark, sf, ALL_MODELS, ensemble=("nb", "svm"))


@register("F08", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, body="""SELECT InvoiceNo,
  coalesce(len(item_list) > 0 AND NOT list_bool_or(list_transform(item_list, lambda x: x IS NULL)), false) AS valid FROM baskets"""))
def f08(spark, sf):
    return baskets(spark, sf).select("InvoiceNo", X.validate_transaction("Items").alias("valid"))


@register("F09", """SELECT o_orderkey, array_to_string(list_filter(list_transform(list(p_type ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice),
  lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: length(x) >= 6), '|') AS items
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey""")
def f09(spark, sf):
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    reqs = (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_type"))), lambda s: s["p_type"]).alias("raw")))
    return reqs.select("o_orderkey", F.array_join(X.filter_transaction("raw", 6), "|").alias("items"))


# Requests with unknown items: the items of cancelled orders plus their part types.
def requests(spark, sf):
    from cartwise.plans.catalog import lines
    from cartwise.functions.text import lower_strip
    lin = lines(spark, sf).filter(F.col("InvoiceNo").startswith("C") & F.col("Description").isNotNull())
    return (lin.groupBy(F.col("InvoiceNo").alias("request_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_order", lower_strip("Description").alias("d")))),
                    lambda s: s["d"]).alias("items")))


@register("F10", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(BUNDLE_SUPPORT, MAX_BUNDLE_SIZE), LABELS, """
rq AS (SELECT InvoiceNo AS request_id, lower(regexp_replace(Description, '^\\s+|\\s+$', '', 'g')) AS item,
              row_number() OVER (PARTITION BY InvoiceNo ORDER BY ord1, ord2, ord3, ord4, ord5) AS pos
       FROM lines WHERE starts_with(InvoiceNo, 'C') AND Description IS NOT NULL)""", body="""
SELECT rq.request_id, coalesce(array_to_string(list(rq.item ORDER BY rq.pos) FILTER (WHERE v.item IS NOT NULL), '|'), '') AS known_items,
       count(*) FILTER (WHERE v.item IS NULL) AS n_dropped
FROM rq LEFT JOIN vocab v ON rq.item = v.item GROUP BY rq.request_id"""))
def f10(spark, sf):
    vocab = X.vocabulary(baskets(spark, sf))
    out = X.filter_unknown(requests(spark, sf), vocab)
    return out.select("request_id", F.array_join("known_items", "|").alias("known_items"), "n_dropped")


_L16 = [f"{side}_{m}" for m in ("accuracy", "precision", "recall", "f1") for side in ("random", "kfold", "diff")]


@register("L16", S.with_ctes(*BASE, MNB, GNB, CV_SQL, f"""
rnd AS (SELECT 'nb' AS model, * FROM ({metrics_sql("pred WHERE is_test")}) UNION ALL SELECT 'gnb', * FROM ({metrics_sql("gpred WHERE is_test")})),
kf AS (SELECT model, round(avg(accuracy), 9) AS accuracy, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
              round(avg(f1), 9) AS f1 FROM fm GROUP BY model)""", body="SELECT r.model, " + ", ".join(
    f"r.{m} AS random_{m}, k.{m} AS kfold_{m}, round(abs(r.{m} - k.{m}), 9) AS diff_{m}" for m in ("accuracy", "precision", "recall", "f1"))
    + " FROM rnd r JOIN kf k ON r.model = k.model"))
def l16(spark, sf):
    return MT.compare(l14(spark, sf), l13(spark, sf)).select("model", *_L16)
