"""Helpers shared by the training-data operators: tables, the shared folder, held-out splits, components."""

from __future__ import annotations

import os
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normslice.functions.shared import remove as _remove
from normslice.functions.shared import shared_path, stored
from normslice.functions.shared import stored_at as _stored

__all__ = ["class_shares", "components", "crc_bucket", "fresh", "held", "id_type", "sampled_ids", "shared_path", "stored", "table", "under_share", "whole_ids"]

#: Rows of one Arrow batch, unless the session sets its own number.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, read by Spark (any store that Spark reads)."""
    _show_package(spark)
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster, ship it with ``--py-files``)."""
    environment = spark.sparkContext.environment
    environment["PYTHONPATH"] = _with_package(environment.get("PYTHONPATH", ""))


def _with_package(python_path: str) -> str:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in python_path.split(os.pathsep) if p]
    return os.pathsep.join(paths if root in paths else [*paths, root])


def _show_to_sessions() -> None:
    """On import, for frames that did not come from ``table``: a session that is there is told, a later one inherits the variable."""
    os.environ["PYTHONPATH"] = _with_package(os.environ.get("PYTHONPATH", ""))
    if (spark := SparkSession.getActiveSession()) is not None:
        _show_package(spark)


def _small_batches(spark: SparkSession) -> None:
    """Rows here are whole texts: Arrow batches of the default 10,000 rows would hold hundreds of MB where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    """The type of an id column, as a schema names it: ids of any type that can be ordered keep theirs."""
    return dict(df.dtypes)[column]


def whole_ids(df: DataFrame, column: str = "doc_id") -> None:
    """Refuses ids that are no whole numbers, where positions are computed with them."""
    if id_type(df, column) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be a whole number here, not {id_type(df, column)}")


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps over tasks: one object for all operators, so the tables of the last one go when another begins."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id hashes as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled_ids(labelled: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` ids of each class, the ones whose hash lies under the wanted share; all of a smaller class.

    A repeatable training sample: class sizes are counted, then every row decides for itself, so nothing is ranked or
    gathered. The number of ids of a class varies about ``per_class`` by its square root.
    """
    rows = labelled.select(id_col, class_col).where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull())
    return rows.join(class_shares(rows, class_col, per_class), class_col).where(under_share(id_col)).select(id_col, class_col)


def class_shares(rows: DataFrame, class_col: str, per_class: int) -> DataFrame:
    """``class, _share`` (of its rows that make about ``per_class``) for each class."""
    return rows.groupBy(class_col).agg(F.least(F.lit(1.0), F.lit(float(per_class)) / F.count(F.lit(1))).alias("_share"))


def under_share(id_col: str) -> Column:
    return F.xxhash64(id_col).cast("double") <= F.col("_share") * 2.0**64 - 2.0**63


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: ``(node, component)`` with the smallest node reachable.

    Rounds of minimum hooking and pointer jumping; every round is joins and grouped minima on the shuffle, its labels
    are written to the shared folder, and only two counts come to the driver. Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    both, edge_path = _stored(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u <> v")
        .transform(lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        .distinct(),
        "edges",
    )
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component"))
    labels, label_path = _stored(labels, "labels")
    for _ in range(max_rounds):
        seen = (
            both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("c").alias("near"))
        )
        step = labels.join(seen, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("c")
        )
        # hook: everything under an old label follows the smallest label that any of its nodes has met
        # (only labels that move are joined, so a settled giant component meets no row)
        hooks = step.groupBy(F.col("before").alias("root")).agg(F.min("c").alias("to")).where("to < root")
        step = step.join(hooks, F.col("before") == F.col("root"), "left").select(
            "node", "before", F.least("c", F.coalesce("to", "c")).alias("c")
        )
        # jump: follow the label of the label
        jump = labels.select(F.col("node").alias("root"), F.col("component").alias("to"))
        after, path = _stored(
            step.join(jump, F.col("c") == F.col("root"), "left").select(
                "node", "before", F.least("c", F.coalesce("to", "c")).alias("component")
            ),
            "labels",
        )
        moved = after.where("before <> component").limit(1).count()
        _remove(spark, label_path)  # nothing reads the round before any more
        labels, label_path = after.select("node", "component"), path
        if not moved:
            _remove(spark, edge_path)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


_show_to_sessions()
