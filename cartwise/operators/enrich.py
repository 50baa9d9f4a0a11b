"""Cache-first enrichment through a pluggable scorer.

The data work is Spark's: distinct keys, anti-join against the cache, batching
(``mapInPandas`` record batches), parsing and validating the replies (E08),
merging the cache and joining the results back.  The scorer itself is any
function ``pandas.DataFrame(key, text) -> pandas.DataFrame(key, raw, status)``;
``status`` is 'ok', 'error' or 'quota' (E06: failed keys stay out of the cache and
fall back to the caller's default).  A scorer that raises, or leaves keys out, gives
'error' rows; after a 'quota' reply a task calls the scorer no more and its other rows
are 'quota' too: the job degrades instead of aborting.

Keys are dealt to a set number of tasks and scored in waves (``score_in_waves``): a quota
reply ends the whole job's calls with its wave.  The replies are written once to the shared checkpoint folder; values, new cache and
quarantine are all read from there, so no key is scored twice and they agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartwise.functions.text import candidate_hash, normalize_basic
from cartwise.operators.stock import best_alternatives
from cartwise.session import checkpoint_dir, cut_lineage

RAW_SCHEMA = "key string, raw string, status string"
CATEGORY_SCHEMA = T.MapType(T.StringType(), T.StringType())
CONTEXT_SCHEMA = T.StructType([T.StructField("contexts", T.ArrayType(T.StructType([
    T.StructField("context", T.StringType()), T.StructField("confidence", T.DoubleType())])))])
ANOMALY_SCHEMA = T.StructType([T.StructField("anomaly_type", T.StringType()),
                               T.StructField("anomaly_reason", T.StringType())])
ALTERNATIVES_SCHEMA = T.StructType([T.StructField("alternatives", T.ArrayType(T.StructType([
    T.StructField("item", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("reason", T.StringType())])))])
# Anomaly labels a scorer may return.
ANOMALY_TYPES = ["bot-like", "mispriced", "invalid", "none"]


def run_scorer(todo: DataFrame, scorer, batch_rows: int = 10, partitions: int | None = None) -> DataFrame:
    """Apply ``scorer`` to (key, text) rows in Arrow batches of ``batch_rows``."""
    def _apply(it):
        import pandas as pd
        spent = False
        for pdf in it:
            for i in range(0, len(pdf), batch_rows):
                part = pdf.iloc[i:i + batch_rows].reset_index(drop=True)
                if spent:
                    yield part[["key"]].assign(raw=None, status="quota")
                    continue
                try:
                    reply = scorer(part)
                    if "status" not in reply:
                        reply = reply.assign(status="ok")
                    reply = reply[["key", "raw", "status"]].drop_duplicates("key")
                except Exception as e:  # noqa: BLE001 - whatever a scorer raises is a failed batch
                    reply = part[["key"]].assign(raw=f"{type(e).__name__}: {e}", status="error")
                out = part[["key"]].merge(reply, on="key", how="left")
                out["status"] = out["status"].fillna("error")
                out = out.astype(object).where(pd.notna(out), None)
                spent = bool((out["status"] == "quota").any())
                yield out
    if partitions:
        todo = todo.repartition(partitions, "key")
    return todo.select("key", "text").mapInPandas(_apply, RAW_SCHEMA)


WAVE_BATCHES = 100      # scorer calls of a task within a wave, unless ``wave_keys`` says otherwise


def score_in_waves(todo: DataFrame, scorer, batch_rows: int = 10, tasks: int | None = None, wave_keys: int | None = None) -> DataFrame:
    """Replies of ``scorer`` for all of ``todo`` (key, text; keys distinct), in waves; written once, then read.

    The keys of a wave are dealt to ``tasks`` tasks (default: the cluster's cores), a given
    number that adaptive execution does not lower, so few bytes of keys still occupy all
    tasks.  A wave has about ``wave_keys`` keys (by hash) and its replies are written before the next
    one starts: once a reply says 'quota', the scorer is called no more, by any task, and
    the keys of the later waves are 'quota' too.  So calls beyond the quota are at most the
    rest of one wave.
    """
    spark = todo.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    wave_keys = wave_keys or tasks * batch_rows * WAVE_BATCHES
    path = f"{checkpoint_dir(spark)}/scorer-replies/{uuid.uuid4().hex}"
    todo = cut_lineage(todo.select("key", "text"))
    waves = max(1, -(-todo.count() // wave_keys))
    dealt = todo.withColumn("_wave", F.pmod(F.xxhash64(F.lit("wave"), "key"), F.lit(waves)))
    paths = []
    for w in range(waves):
        paths.append(f"{path}/wave-{w}")
        run_scorer(dealt.filter(F.col("_wave") == w), scorer, batch_rows, tasks).write.parquet(paths[-1])
        replies = spark.read.schema(RAW_SCHEMA).parquet(paths[-1])
        if w + 1 < waves and not replies.filter(F.col("status") == "quota").isEmpty():
            paths.append(f"{path}/not-asked")
            dealt.filter(F.col("_wave") > w).select("key", F.lit(None).cast("string").alias("raw"), F.lit("quota").alias("status")).write.parquet(paths[-1])
            break
    return spark.read.schema(RAW_SCHEMA).parquet(*paths)


def keep_replies(raw: DataFrame) -> DataFrame:
    """Write the replies once to shared storage and read them back: later uses call no scorer."""
    spark = raw.sparkSession
    path = f"{checkpoint_dir(spark)}/scorer-replies/{uuid.uuid4().hex}"
    raw.write.parquet(path)
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def ingest(raw: DataFrame, schema, check=None):
    """Strip a fenced code block, parse JSON, validate → (valid, quarantine).

    A bare JSON array is accepted as ``{"alternatives": [...]}`` style payloads
    when the schema is a struct with a single array field.
    """
    body = F.coalesce(F.nullif(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")),
                      F.trim(F.col("raw")))
    if isinstance(schema, T.StructType) and len(schema.fields) == 1 and isinstance(schema.fields[0].dataType, T.ArrayType):
        body = F.when(body.startswith("["), F.concat(F.lit(f'{{"{schema.fields[0].name}": '), body, F.lit("}"))).otherwise(body)
    parsed = raw.withColumn("value", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    ok = (F.col("status") == "ok") & F.col("value").isNotNull()
    if isinstance(schema, T.StructType):  # required fields (PERMISSIVE yields a struct of NULLs)
        for f in schema.fields:
            ok = ok & F.col("value")[f.name].isNotNull()
    if check is not None:
        ok = ok & F.coalesce(check(F.col("value")), F.lit(False))
    valid = parsed.filter(ok).select("key", "value")
    quarantine = parsed.filter(~ok).select("key", "raw", "status")
    return valid, quarantine


def merge_cache(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """New entries win; old entries for other keys are kept."""
    if old is None:
        return new
    return new.unionByName(old.join(new.select("key"), "key", "left_anti"))


def cached_lookup(keys: DataFrame, cache: DataFrame | None, scorer, schema, check=None,
                  batch_rows: int = 10, force: bool = False, tasks: int | None = None, wave_keys: int | None = None):
    """Distinct keys → cached values + newly scored values; returns (values, new_cache, quarantine)."""
    keys = keys.select("key", "text").filter(F.col("key").isNotNull()).dropDuplicates(["key"])
    if cache is not None and not force:
        todo = keys.join(cache.select("key"), "key", "left_anti")
        hit = cache.join(keys.select("key"), "key", "left_semi")
    else:
        todo, hit = keys, None
    if scorer is None:
        fresh = todo.sparkSession.createDataFrame([], T.StructType([T.StructField("key", T.StringType()),
                                                                    T.StructField("value", schema)]))
        quarantine = todo.select("key", F.lit(None).cast("string").alias("raw"), F.lit("unavailable").alias("status"))
    else:
        fresh, quarantine = ingest(score_in_waves(todo, scorer, batch_rows, tasks, wave_keys), schema, check)
    values = fresh if hit is None else fresh.unionByName(hit.select("key", "value"))
    return values, merge_cache(cache, fresh), quarantine


def enrich_categories(df: DataFrame, scorer, fields=("category", "material", "size", "theme"),
                      cache: DataFrame | None = None, col: str = "Description", batch_rows: int = 10, force=False):
    """One column per configured field (NULL when unknown or unavailable)."""
    keys = df.select(F.col(col).alias("key"), F.col(col).alias("text"))
    values, new_cache, _ = cached_lookup(keys, cache, scorer, CATEGORY_SCHEMA, None, batch_rows, force)
    v = values.select(F.col("key").alias("_k"), *[F.nullif(F.nullif(F.col("value")[f], F.lit("NaN")), F.lit("")).alias(f)
                                                for f in fields])
    out = df.join(v, F.col(col) == F.col("_k"), "left").drop("_k")
    return out, new_cache


def extract_contexts(df: DataFrame, scorer, max_contexts: int = 3, min_confidence: float = 0.6,
                     cache: DataFrame | None = None, col: str = "Description", batch_rows: int = 10, force=False):
    """Up to ``max_contexts`` contexts with confidence >= ``min_confidence``, comma-joined; '' if none."""
    keys = df.select(F.col(col).alias("key"), F.col(col).alias("text"))
    check = lambda v: F.forall(v["contexts"], lambda c: c["confidence"].between(0.0, 1.0))
    values, new_cache, _ = cached_lookup(keys, cache, scorer, CONTEXT_SCHEMA, check, batch_rows, force)
    ctx = F.slice(F.col("value")["contexts"], 1, max_contexts)
    kept = F.transform(F.filter(ctx, lambda c: c["confidence"] >= min_confidence), lambda c: c["context"])
    v = values.select(F.col("key").alias("_k"), F.array_join(kept, ", ").alias("contexts"))
    out = df.join(v, F.col(col) == F.col("_k"), "left").drop("_k").withColumn("contexts", F.coalesce("contexts", F.lit("")))
    return out, new_cache


def label_anomalies(flagged: DataFrame, scorer, cache: DataFrame | None = None, batch_rows: int = 50, force=False):
    """Scorer labels for flagged rows keyed by the record key (P07); missing or
    invalid replies fall back to the heuristic label (A12).  Every candidate stays flagged."""
    from cartwise.operators.anomaly import with_record_key
    d = with_record_key(flagged, "_rk")
    cand = d.filter("check_anomaly")
    text = F.to_json(F.struct(*[F.col(c) for c in ("Description", "Quantity", "UnitPrice", "TransactionValue",
                                                   "CustomerID", "Country", "anomaly_reason") if c in d.columns]))
    keys = cand.select(F.col("_rk").alias("key"), text.alias("text"))
    check = lambda v: v["anomaly_type"].isin(ANOMALY_TYPES)
    values, new_cache, _ = cached_lookup(keys, cache, scorer, ANOMALY_SCHEMA, check, batch_rows, force)
    v = values.select(F.col("key").alias("_k"), F.col("value")["anomaly_type"].alias("_t"),
                      F.col("value")["anomaly_reason"].alias("_r"))
    out = (d.join(v, F.col("_rk") == F.col("_k"), "left")
             .withColumn("anomaly_type", F.when(F.col("check_anomaly"), F.coalesce("_t", "anomaly_type")))
             .withColumn("anomaly_reason", F.when(F.col("check_anomaly"), F.coalesce("_r", "anomaly_reason")))
             .drop("_k", "_t", "_r", "_rk"))
    return out, new_cache


def select_alternatives(missing: DataFrame, candidates: DataFrame, scorer, group: str, max_alternatives: int = 1,
                        max_candidates: int = 200, cache: DataFrame | None = None, batch_rows: int = 10, force=False):
    """An in-stock alternative per (``group``, item), chosen by the scorer.

    The scorer gets the text {"missing_item", "candidates"} with the group's first
    ``max_candidates`` candidates by name (the service's own limit; the window's limit is
    applied before the shuffle, so a large group is never collected) and replies with
    {item, score, reason} objects.  Of the first ``max_alternatives`` the best score wins,
    the earlier one on a tie.  Replies are cached by normalized item and candidate hash.
    Items without a valid reply get the token-overlap choice (R04) among all candidates.

    Returns (``group``, item, alternative, score, reason) and the new cache; items with no
    choice at all have no row, as have null or empty items.
    """
    named = lambda d: d.select(group, "item").filter("item <> ''").distinct()
    missing, candidates = named(missing), named(candidates)
    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("item")))
    lists = first.filter(F.col("_n") <= max_candidates).groupBy(group).agg(F.sort_array(F.collect_list("item")).alias("_c"))
    asked = missing.join(lists, group).select(
        group, "item", F.concat(normalize_basic("item"), F.lit("|"), candidate_hash("_c")).alias("key"),
        F.to_json(F.struct(F.col("item").alias("missing_item"), F.col("_c").alias("candidates"))).alias("text"))
    check = lambda v: F.forall(v["alternatives"], lambda a: (F.length(a["item"]) > 0) & a["score"].between(0.0, 1.0))
    values, new_cache, _ = cached_lookup(asked.groupBy("key").agg(F.min("text").alias("text")), cache, scorer,
                                         ALTERNATIVES_SCHEMA, check, batch_rows, force)
    offers = F.slice(F.col("value")["alternatives"], 1, max_alternatives)
    best = F.filter(offers, lambda a: a["score"] == F.array_max(F.transform(offers, lambda o: o["score"])))
    chosen = asked.join(values.select("key", F.get(best, F.lit(0)).alias("_a")), "key").filter(F.col("_a").isNotNull()).select(
        group, "item", F.col("_a")["item"].alias("alternative"), F.col("_a")["score"].alias("score"),
        F.coalesce(F.col("_a")["reason"], F.lit("")).alias("reason"))
    others = best_alternatives(missing.join(chosen.select(group, "item"), [group, "item"], "left_anti"), candidates, group)
    return chosen.unionByName(others), new_cache


def normalize_with_scorer(df: DataFrame, scorer, col: str = "Description", cache: DataFrame | None = None):
    """Scorer-normalized text; failure → the original text."""
    schema = T.StructType([T.StructField("normalized", T.StringType())])
    keys = df.select(F.col(col).alias("key"), F.col(col).alias("text"))
    values, new_cache, _ = cached_lookup(keys, cache, scorer, schema, lambda v: v["normalized"] != "")
    v = values.select(F.col("key").alias("_k"), F.col("value")["normalized"].alias("_n"))
    return df.join(v, F.col(col) == F.col("_k"), "left").withColumn(col, F.coalesce("_n", col)).drop("_k", "_n"), new_cache


# ---------------------------------------------------------------- rule scorers (tests)
def rule_category_scorer(pdf):
    """Deterministic stand-in for a hosted model: fields from the words of the text.
    Every third reply is wrapped in a fenced code block; texts containing 'bolt' get
    an invalid reply (exercises E08 quarantine)."""
    import json
    import pandas as pd
    raws = []
    for t in pdf["text"]:
        words = str(t).split()
        if "bolt" in words:
            raws.append("not json")
            continue
        body = json.dumps({"category": words[-1] if words else "", "theme": words[0] if words else "",
                           "size": str(len(words))})
        raws.append(f"```json\n{body}\n```" if len(str(t)) % 3 == 0 else body)
    return pd.DataFrame({"key": pdf["key"], "raw": raws, "status": ["ok"] * len(pdf)})
