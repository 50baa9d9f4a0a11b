"""Lines that lie by their order: the same rows, without moving them again."""

from pyspark.sql import functions as F

from cartwise.operators.baskets import create_baskets
from cartwise.operators.clean import preprocess
from cartwise.sources.tables import PLACED_BY, retail_lines
from tests.conftest import SF


def _rows(df):
    return sorted(map(str, df.collect()))


def test_baskets_of_placed_lines_are_the_same_and_move_no_line_again(spark):
    plain = create_baskets(preprocess(retail_lines(spark, SF)))
    lines = preprocess(retail_lines(spark, SF, placed=True), placed_by=PLACED_BY)
    placed = create_baskets(lines, placed_by=PLACED_BY)
    assert placed.columns == plain.columns and _rows(placed) == _rows(plain)
    assert _rows(lines.drop(PLACED_BY)) == _rows(preprocess(retail_lines(spark, SF)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grouped = preprocess(retail_lines(spark, SF, placed=True), placed_by=PLACED_BY).groupBy(PLACED_BY, "InvoiceNo").agg(F.sum("Quantity"))
        plan = grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = plan[:plan.index("SortMergeJoin [l_orderkey")]
    assert "Aggregate" in above and "Exchange" not in above


def test_a_snapshot_is_made_from_the_tables_saved_before(spark, tmp_path):
    from cartwise.jobs import prepare
    loads = []

    def load():
        seen = spark.sparkContext.accumulator(0)
        loads.append(seen)
        return retail_lines(spark, SF).filter(F.udf(lambda x: seen.add(1) or True, "boolean")("InvoiceNo"))
    saved = prepare(spark, str(tmp_path / "s"), load)
    assert saved["baskets"].count() > 0 and loads[0].value <= retail_lines(spark, SF).count()      # the raw lines are read once


def test_levelwise_counts_in_parts_and_joins_no_bitmaps(spark, monkeypatch):
    from cartwise.operators import mining as M
    rows = [(str(i), [x for x in "abcdef" if (i * 7 + ord(x)) % 5 < 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "InvoiceNo string, Items array<string>")
    whole = {r["bundle"]: r["support_count"] for r in M.mine_bundles_levelwise(df, 0.05, 4, block_baskets=64).collect()}
    monkeypatch.setattr(M, "CANDIDATE_BYTES", 100)
    assert {r["bundle"]: r["support_count"] for r in M.mine_bundles_levelwise(df, 0.05, 4, block_baskets=64).collect()} == whole
    assert whole == {r["bundle"]: r["support_count"] for r in M.mine_bundles(df, 0.05, 4).collect()} and whole
    assert not hasattr(M, "_both")


def test_kernel_blocks_hold_positions_alone(spark):
    from cartwise.operators.machines import FourierMap, pack
    features = FourierMap({"a": 1.0, "b": 2.0, "c": 0.5}, 0.3, 16)
    df = spark.createDataFrame([(["a", "b"], 1, -1), ([], 0, -1), (["c", "z"], 0, 1), (None, 1, 1)], "Items array<string>, label int, left_out int").coalesce(1)
    row = pack(df, "Items", features, 1).collect()[0].asDict()
    assert "x" not in row and len(row["idx"]) == 3 * 4
    assert (features.decoder()(row) == features.features([["a", "b"], [], ["c", "z"], None]).astype("float32")).all()


def test_prefixes_of_all_levels_take_one_join(spark):
    from cartwise.llm import filter_audit
    df = spark.createDataFrame([("x" * 300 + str(i),) for i in range(64)], "text string")
    df = df.withColumn("whole", F.udf(lambda t: filter_audit.whole_level(len(t)), "int")("text"))
    plan = filter_audit.with_prefix(df, filter_audit.heavy_prefixes(df, 500), 5).drop("hot")._jdf.queryExecution().optimizedPlan().toString()
    assert plan[:plan.index("heavy") if "heavy" in plan else None].count("Join LeftOuter") == 1
