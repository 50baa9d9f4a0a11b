"""The registered queries against their DuckDB twins or brute force, and the pipeline."""

import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from cartwise.llm import queries as Q
from cartwise.sources.tables import TABLES

from ..conftest import SF
from .test_operators import lowered, plain_components, plain_fingerprint, split_words

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))


def test_all_and_the_pipeline_are_registered():
    names = {re.match(r"op(\d+)_", k)[1] for k in Q.QUERIES}
    assert names == {str(i) for i in range(1, 14)}
    assert {*Q.QUERIES, "pipeline"} <= set(E.queries()) and set(Q.ORACLES) <= set(E.oracle_sql())
    assert "pipeline" not in E.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    from oracle_check import digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]


def test_line_rules_twin_where_documents_share_their_longest_line_or_a_host_is_large(spark, tmp_path):
    """Documents whose longest line is shared count each; a line of 1,000 documents goes whatever its share."""
    from oracle_check import digest
    notice = " ".join(f"n{k}" for k in range(120))
    rows = [(i, f"{notice}\nown {i}", "a") for i in range(30)] + [(100 + i, f"{notice}\nown {i}", "b") for i in range(10)]
    rows += [(1000 + i, "shared words here\n" + " ".join(f"t{i}x{k}" for k in range(55)), "big") for i in range(1000)]
    rows += [(10_000 + i, " ".join(f"u{i}x{k}" for k in range(2)), "big") for i in range(52_000)]
    rows += [(90_000, f"{notice}\nown 1", "a"), (90_001, None, "a"), (90_002, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df, con = Q.QUERIES["op3_line_rules"](spark, str(tmp_path)), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel, got = con.sql(Q.ORACLES["op3_line_rules"]), df.collect()
    assert digest(df.columns, [tuple(r) for r in got])[0] == digest(rel.columns, rel.fetchall())[0]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["lost_words"] == 120 and not by_id[5]["kept"] and by_id[105]["lost_words"] == 0
    assert by_id[1005]["lost_words"] == 3 and by_id[1005]["kept"]


def test_simhash_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, plain_components(fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.QUERIES["op10_simhash"](spark, SF).collect()} == want


@pytest.mark.parametrize("name,label,cut", [("op1_counterfactual_toxicity", "toxic", 0.5), ("op7_compression_quality", "quality", 0.3)])
def test_classifier_queries_on_held_out_rows(spark, name, label, cut):
    sf = SF.replace("0.001", "0.01")
    rows = Q.QUERIES[name](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= cut) and 0 <= r["score"] <= 1 for r in rows)
    marks = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_packing_query(spark):
    rows = Q.QUERIES["op5_best_fit_packing"](spark, SF).collect()
    lengths = {}
    for r in rows:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert max(lengths.values()) <= 2048
    assert len(lengths) <= -(-sum(lengths.values()) // 2048) * 1.02 + 1
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_language_query(spark):
    rows = Q.QUERIES["op2_evidence_language"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert np.mean([r["lang"] == r["declared"] for r in rows]) > 0.95


def test_pipeline_against_brute_force(spark):
    """Base rules, dedup and near-dedup recomputed plainly; mix and packing held to their contracts."""
    got = corpus_pipeline.run(spark, SF).collect()
    verdict = {r["doc_id"]: r["kept"] for r in Q.QUERIES["op3_line_rules"](spark, SF).collect()}
    docs = sorted((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    docs = [d for d in docs if verdict[d[0]]]
    last = {lowered(t): i for i, t, _ in docs}
    docs = [d for d in docs if last[lowered(d[1])] == d[0]]
    classes = plain_components([plain_fingerprint(t) for _, t, _ in docs])
    docs = [d for k, d in enumerate(docs) if classes[k] == k]
    sizes = {i: len(split_words(t)) for i, t, _ in docs}
    total = sum(sizes.values())
    first = [r for r in got if r["piece"] == 0]
    taken = sum(sizes[r["doc_id"]] for r in first)          # only documents that were kept
    assert total - max(sizes.values()) <= taken <= total
    assert max(np.unique([r["doc_id"] for r in first], return_counts=True)[1]) <= 3
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "source mix", "best-fit packing"]
