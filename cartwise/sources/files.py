"""File sources and sinks."""

from __future__ import annotations

import datetime as dt
import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.functions.text import normalize_basic
from cartwise.schema import RAW_LINES, ROW_ORDER
from cartwise.session import cut_lineage


def load_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, ISO-8859-1, explicit schema (keys stay text), splittable
    (no multiLine); a doubled quote inside quotes is a quote.  ``row_order`` = (file, block start, id): file order even when
    splits are packed across files."""
    df = (spark.read.schema(RAW_LINES).option("header", True).option("encoding", "ISO-8859-1").option("escape", '"')
          .option("mode", "PERMISSIVE").csv(path))
    return df.withColumn(ROW_ORDER, F.struct(F.col("_metadata.file_path").alias("f"),
                                             F.col("_metadata.file_block_start").alias("b"),
                                             F.monotonically_increasing_id().alias("i")))


# Text goes into files as it is: blanks at its ends stay, a quote is doubled.
PLAIN = {"sep": "\t", "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv_to_tsv(df: DataFrame, out: str) -> None:
    """Re-encode as UTF-8 TSV with header (a directory of part files)."""
    df.drop(ROW_ORDER).write.mode("overwrite").options(**PLAIN).csv(out)


def default_tsv_path(csv_path: str) -> str:
    return csv_path[:-4] + ".tsv" if csv_path.endswith(".csv") else csv_path + ".tsv"


def write_rejects(rejects: DataFrame, out: str) -> None:
    """One pass, one directory per reason (only non-empty reasons appear)."""
    rejects.drop(ROW_ORDER).write.mode("overwrite").partitionBy("reason").options(**PLAIN).csv(out)


def _stamp() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")


MANIFEST = "timestamp string, lines string, baskets string, bundles string"


def save_snapshot(out: str, lines: DataFrame | None, baskets, bundles, keep_lines: str | None = None) -> str:
    """Parquet per table and a TSV copy of the lines in a new version, then a manifest row that names them.

    Nothing is overwritten, so a snapshot may be derived from the one before and its readers
    are unaffected.  ``keep_lines`` names lines already saved (bundles-only runs).
    ``baskets`` and ``bundles`` are tables, or functions that make them from the saved lines
    and the saved baskets, so that no table is worked out again for the next.  Returns the
    timestamp.
    """
    stamp = _stamp()
    version = f"version-{stamp}"
    if keep_lines is None:
        spark = lines.sparkSession
        lines.write.parquet(f"{out}/{version}/lines")
        lines = spark.read.parquet(f"{out}/{version}/lines")
        csv_to_tsv(lines, f"{out}/{version}/lines_tsv")
    baskets = baskets(lines) if callable(baskets) else baskets
    baskets.write.parquet(f"{out}/{version}/baskets")
    bundles = bundles(baskets.sparkSession.read.parquet(f"{out}/{version}/baskets")) if callable(bundles) else bundles
    bundles.write.parquet(f"{out}/{version}/bundles")
    row = (stamp, keep_lines or f"{version}/lines", f"{version}/baskets", f"{version}/bundles")
    baskets.sparkSession.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{out}/_manifest")
    return stamp


def _missing(error: AnalysisException) -> bool:
    """True if the path is not there; permission, schema and parse errors must rise."""
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def load_snapshot(spark: SparkSession, path: str) -> dict:
    """The tables of the latest snapshot; a missing one raises FileNotFoundError."""
    try:
        man = spark.read.schema(MANIFEST).json(f"{path}/_manifest").orderBy(F.desc("timestamp")).first()
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no snapshot at {path}") from e
        raise
    return {**{t: spark.read.parquet(f"{path}/{man[t]}") for t in ("lines", "baskets", "bundles")},
            "timestamp": man["timestamp"], "lines_at": man["lines"]}


def load_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inventory CSV (all text) → (item, in_stock); missing file → empty."""
    from cartwise.operators.stock import inventory_from_frame
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if _missing(e):
            return spark.createDataFrame([], "item string, in_stock boolean")
        raise
    return inventory_from_frame(df.withColumn("_o", F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())), "_o")


def load_kv_cache(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The current version of a Parquet (key, value) cache; none saved yet → None.

    A pointer names the current version; an unreadable pointer or version fails.
    """
    try:
        version = spark.read.schema("saved string, version string").json(f"{path}/_current").orderBy(F.desc("saved")).first()
    except AnalysisException as e:
        if _missing(e):
            return None
        raise
    return spark.read.schema(schema).parquet(f"{path}/{version['version']}")


def save_kv_cache(cache: DataFrame, path: str) -> str:
    """Write a new version, then point to it (readers of the old one are unaffected)."""
    saved = _stamp()
    version = f"version-{saved}"
    cache.write.mode("errorifexists").parquet(f"{path}/{version}")
    cache.sparkSession.createDataFrame([(saved, version)], "saved string, version string").coalesce(1) \
        .write.mode("append").json(f"{path}/_current")
    return f"{path}/{version}"


BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(buckets)).cast("int").alias("bucket")


def _manifest(spark: SparkSession, path: str) -> list | None:
    """Current manifest rows (bucket, buckets, folder) of a bucketed cache: those saved last; none yet → None."""
    try:
        rows = spark.read.schema("saved string, bucket int, buckets int, folder string").json(f"{path}/_manifests")
        last = rows.agg(F.max("saved")).first()[0]
    except AnalysisException as e:
        if _missing(e):
            return None
        raise
    return None if last is None else rows.filter(F.col("saved") == last).collect()       # one row per bucket


def load_bucket_cache(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The current rows of a bucketed (key, value) cache; none saved yet → None."""
    rows = _manifest(spark, path)
    folders = [f"{path}/{r['folder']}" for r in rows or () if r["folder"]]
    if rows is None:
        return None
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_bucket_cache(new: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Merge ``new`` (key, value; new entries win) by rewriting only the buckets that received keys.

    Keys fall into ``buckets`` buckets by hash (the number is fixed by the first save).  A
    manifest names each bucket's folder; a merge writes new folders for the changed buckets
    and then a new manifest, so readers of the old one are unaffected and the other buckets'
    files stay.  Returns the buckets written.
    """
    spark, saved = new.sparkSession, _stamp()
    rows = _manifest(spark, path)
    current = {r["bucket"]: r["folder"] for r in rows or ()}
    buckets = rows[0]["buckets"] if rows else buckets
    new = cut_lineage(new.filter(F.col("key").isNotNull()).select("*", _bucket("key", buckets)))
    changed = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())       # at most ``buckets`` numbers
    held = [current[b] for b in changed if current.get(b)]
    merged = new
    if held:
        old = spark.read.schema(new.drop("bucket").schema).parquet(*[f"{path}/{f}" for f in held])
        old = old.join(new.select("key"), "key", "left_anti").select(*new.columns[:-1], _bucket("key", buckets))
        merged = new.unionByName(old)
    if changed:
        merged.repartition(len(changed), "bucket").write.partitionBy("bucket").parquet(f"{path}/version-{saved}")
    table = {b: current.get(b) for b in range(buckets)} | {b: f"version-{saved}/bucket={b}" for b in changed}
    spark.createDataFrame([(saved, b, buckets, f) for b, f in table.items()], "saved string, bucket int, buckets int, folder string") \
        .coalesce(1).write.mode("append").json(f"{path}/_manifests")
    return changed


def load_alias_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object alias → canonical, both sides normalized.

    Aliases that become equal by normalization: the last entry of the last file wins.  A
    file that is not a JSON object gives no aliases, and its name is logged as a warning.
    """
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except AnalysisException as e:
        if _missing(e):
            return spark.createDataFrame([], "alias string, canonical string")
        raise
    read = raw.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("map"))
    for r in read.filter(F.col("map").isNull()).select("file").take(20):
        logging.getLogger(__name__).warning("not a JSON object, no aliases taken from it: %s", r["file"])
    pairs = read.select("file", F.posexplode("map").alias("pos", "k", "v"))
    return pairs.groupBy(normalize_basic("k").alias("alias")).agg(
        F.max_by(normalize_basic("v"), F.struct("file", "pos")).alias("canonical"))


def save_nb_model(model, out: str) -> None:
    """Naive Bayes parameter tables as Parquet (+ class list)."""
    model.params.write.mode("overwrite").parquet(f"{out}/params")
    model.base.withColumn("kind", F.lit(model.kind)).withColumn(
        "classes", F.array(*[F.lit(c) for c in model.classes])).write.mode("overwrite").parquet(f"{out}/base")


def load_nb_model(spark: SparkSession, path: str):
    from cartwise.operators.models import NBModel
    base = spark.read.parquet(f"{path}/base")
    row = base.first()
    return NBModel(row["kind"], spark.read.parquet(f"{path}/params"), base.select("b0", "b1"), list(row["classes"]))


def save_svm_model(model, out: str) -> None:
    """An SVM, linear or kernel: item table (weights, or the map's scales) and one row of parameters."""
    from cartwise.operators.models import SVMModel
    numbers = {"intercept": model.intercept, "a": model.a, "b": model.b}
    if isinstance(model, SVMModel):
        spark, kind, table, rest = model.weights.sparkSession, "linear", model.weights, {}
    else:
        m, spark = model.features, SparkSession.getActiveSession()
        kind = getattr(m, "kind", "rbf")
        table = spark.createDataFrame(list(m.scale.items()), "item string, w double")
        rest = {"gamma": m.gamma, "size": m.size, "weights": model.weights.tolist()}
        rest |= {"seed": m.seed} if kind == "rbf" else {"degree": m.degree, "coef0": m.coef0, "landmarks": m.landmarks, "root": m.root.tolist()}
    table.write.mode("overwrite").parquet(f"{out}/items")
    said = json.dumps({"kind": kind, **numbers, **rest})
    spark.createDataFrame([(said,)], "model string").write.mode("overwrite").parquet(f"{out}/machine")


def load_svm_model(spark: SparkSession, path: str):
    import numpy as np

    from cartwise.operators.machines import FourierMap, LandmarkMap
    from cartwise.operators.models import KernelSVMModel, SVMModel
    m, table = json.loads(spark.read.parquet(f"{path}/machine").first()["model"]), spark.read.parquet(f"{path}/items")
    if m["kind"] == "linear":
        return SVMModel(table, m["intercept"], m["a"], m["b"], [0, 1])
    scale = {r["item"]: r["w"] for r in table.collect()}        # one row per item of the catalogue
    if m["kind"] == "rbf":
        features = FourierMap(scale, m["gamma"], m["size"], m["seed"])
    else:
        features = LandmarkMap(scale, m["gamma"], m["size"], m["kind"], m["degree"], m["coef0"], m["landmarks"], np.array(m["root"]))
    return KernelSVMModel(features, np.array(m["weights"]), m["intercept"], m["a"], m["b"], [0, 1])


def save_engine(models: dict, bundles: DataFrame, out: str, saved_at: str) -> None:
    """The fitted models by name, the bundles they were labelled by and the time of saving, in one folder."""
    from cartwise.operators.models import NBModel
    for name, model in models.items():
        (save_nb_model if isinstance(model, NBModel) else save_svm_model)(model, f"{out}/models/{name}")
    bundles.write.mode("overwrite").parquet(f"{out}/bundles")
    # Written last: a folder without it holds no whole engine.
    kinds = [(name, "nb" if isinstance(m, NBModel) else "svm", saved_at) for name, m in models.items()]
    bundles.sparkSession.createDataFrame(kinds, "name string, kind string, saved_at string").write.mode("overwrite").parquet(f"{out}/engine")


def load_engine(spark: SparkSession, path: str) -> tuple[dict, DataFrame, str]:
    """(models by name, bundles, time of saving)."""
    named = spark.read.parquet(f"{path}/engine").orderBy("name").collect()       # one row per model
    load = {"nb": load_nb_model, "svm": load_svm_model}
    return {r["name"]: load[r["kind"]](spark, f"{path}/models/{r['name']}") for r in named}, spark.read.parquet(f"{path}/bundles"), named[0]["saved_at"]
