"""Inventory values, alias files and token alternatives: exactness and size of the work."""

import logging
import random

import pytest
from pyspark.sql import functions as F

from cartwise.operators import stock as ST


def plain_best(missing, candidates):
    out = {}
    for m in missing:
        a, best = set(m.split()), None
        for c in sorted(candidates):
            b = set(c.split())
            s = len(a & b) / len(a | b) if a | b else 0
            if s > 0 and (best is None or s > best[1]):
                best = (c, s)
        if best:
            out[m] = best
    return out


def catalogue(n, seed):
    rng = random.Random(seed)
    common, rare = ["set", "red", "box", "of"], [f"w{i}" for i in range(n)]
    name = lambda: " ".join(dict.fromkeys([t for t in common if rng.random() < 0.5] + rng.sample(rare, rng.randrange(0, 3))))
    return sorted({name() for _ in range(n)} - {""})


def items(spark, names):
    return spark.createDataFrame([(x,) for x in names], "item string")


@pytest.mark.parametrize("hot,most", [(64, 10), (3, 10), (3, 2), (1, 0)])
def test_best_alternative_is_exact_on_every_path(spark, hot, most):
    names = catalogue(500, 1)
    missing, have = names[::3], [x for k, x in enumerate(names) if k % 3]
    scored = ST.scored_alternatives(items(spark, missing), items(spark, have), hot_token=hot, max_hot=most)
    got = scored.groupBy("item").agg(F.min(F.struct((-F.col("score")).alias("s"), "alternative")).alias("b")).collect()
    want = plain_best(missing, have)
    assert {r["item"]: (r["b"]["alternative"], -r["b"]["s"]) for r in got} == want


def test_token_in_half_of_the_catalogue_makes_no_pairs(spark):
    n = 4000
    have, missing = [f"set a{i} b{i}" if i % 2 else f"a{i} b{i}" for i in range(n)], [f"set z{i}" for i in range(n)]
    scored = ST.scored_alternatives(items(spark, missing), items(spark, have)).cache()
    assert scored.count() <= 2 * n                      # an index on "set" alone would make n * n / 2 = 8 million
    best = {r["item"]: (r["alternative"], r["score"]) for r in ST.best_alternatives(items(spark, missing), items(spark, have)).collect()}
    assert len(best) == n and set(best.values()) == {("set a1 b1", 0.25)}


def test_only_the_listed_values_are_in_stock(spark):
    values = ["1", " TRUE", "yes", "Y", "in_stock", "Available ", "1.0", "2", "-1", "0.5", "no", "", None]
    df = spark.createDataFrame([(f"i{k}", v) for k, v in enumerate(values)], "Product string, STOCK string")
    got = {r["item"]: r["in_stock"] for r in ST.inventory_from_frame(df).collect()}
    assert [got[f"i{k}"] for k in range(len(values))] == [True] * 7 + [False] * 6


def test_invalid_alias_file_gives_no_aliases(spark, tmp_path, caplog):
    from cartwise.sources.files import load_alias_map
    (tmp_path / "a.json").write_text('{"Tea  Cup": "cup"}')
    (tmp_path / "b.json").write_text('{"broken": ')
    with caplog.at_level(logging.WARNING):
        got = {r["alias"]: r["canonical"] for r in load_alias_map(spark, str(tmp_path)).collect()}
        assert got == {"tea cup": "cup"} and "b.json" in caplog.text
        assert load_alias_map(spark, str(tmp_path / "b.json")).count() == 0
