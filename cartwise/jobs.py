"""The prepare job (S05): lines → baskets → bundles, kept as a snapshot that later runs reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from cartwise.operators.baskets import create_baskets
from cartwise.operators.clean import preprocess
from cartwise.operators.mining import mine_bundles
from cartwise.schema import JobParams
from cartwise.sources.files import load_snapshot, save_snapshot


def _save(out: str, lines: DataFrame, params: JobParams, keep_lines: str | None = None) -> None:
    kept = []

    def keep(made: DataFrame) -> DataFrame:
        kept.append(made.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]
    try:
        save_snapshot(out, lines, lambda saved: create_baskets(saved, keep=keep),
                      lambda baskets: mine_bundles(baskets, params.min_support, params.max_bundle_size), keep_lines)
    finally:
        for made in kept:
            made.unpersist()


def prepare(spark: SparkSession, out: str, load: Callable[[], DataFrame], params: JobParams = JobParams(),
            force: bool = False, placed_by: str | None = None) -> dict:
    """The snapshot at ``out``; made from the raw lines of ``load()`` if there is none or ``force`` is set.

    ``placed_by`` as in ``dedup_first``, for loaders whose lines lie by such a column; it is not saved.
    """
    if not force:
        try:
            return load_snapshot(spark, out)
        except FileNotFoundError:
            pass
    lines = preprocess(load(), params, placed_by=placed_by).drop(placed_by or "")
    _save(out, lines, params)
    return load_snapshot(spark, out)


def regenerate_bundles(spark: SparkSession, out: str, params: JobParams = JobParams()) -> dict:
    """New baskets and bundles from the saved lines alone; without a snapshot FileNotFoundError is raised."""
    saved = load_snapshot(spark, out)
    _save(out, saved["lines"], params, saved["lines_at"])
    return load_snapshot(spark, out)
