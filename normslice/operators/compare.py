"""Comparing two tables as multisets of rows: digests without order, and the rows that differ.

``differing_rows`` sends no row that both tables have. Each side is summed into an invertible lookup table of a fixed number of cells:
a row's 64-bit key is added to three cells, the other side's is taken away, so equal rows cancel. Cells that hold one key (their sums
pass its check) are peeled off on the driver, until nothing is left; only rows of the peeled keys are then looked up and
counted exactly. If more rows differ than the cells can tell, peeling stalls and all rows are counted instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.errors import LogSchemaError
from normslice.functions.shared import stored
from normslice.operators.scoring import q

#: Cells of each of the three parts: told apart are up to about 2.4 times as many keys.
CELLS = 1 << 13
_PARTS = 3


def _key(columns: Sequence[str]) -> Column:
    """A row as one 64-bit number; NULL differs from every text."""
    return F.xxhash64(*(x for c in columns for x in (q(c).isNull(), q(c).cast("string"))))


def _alike(left: DataFrame, right: DataFrame) -> list[str]:
    if set(left.columns) != set(right.columns):
        raise LogSchemaError(f"the tables have different columns: {sorted(set(left.columns) ^ set(right.columns))}")
    return left.columns


def digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``n, total, mixed``: the same for the same rows in any order, repeated rows counted."""
    key = _key(sorted(columns or df.columns))
    return df.select(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("k").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("total"), F.coalesce(F.sum(F.xxhash64("k").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("mixed"))


def _check(key: int) -> int:
    return zlib.crc32(str(key).encode())


def _cells(key: int, cells: int) -> list[int]:
    return [p * cells + zlib.crc32(f"{p}:{key}".encode()) % cells for p in range(_PARTS)]


def peel(table: dict[int, list[int]], cells: int) -> dict[int, int] | None:
    """Keys and their surplus from the sums ``[rows, keys, checks]`` of each cell; None if that cannot be told."""
    found: dict[int, int] = {}
    ready = list(table)
    while ready:
        n, keys, checks = table.get(ready.pop(), (0, 0, 0))
        if not n or keys % n or checks % n or _check(keys // n) != checks // n:
            continue
        key = keys // n
        found[key] = found.get(key, 0) + n
        for cell in _cells(key, cells):
            left = table.setdefault(cell, [0, 0, 0])
            left[0] -= n
            left[1] -= n * key
            left[2] -= n * _check(key)
            ready.append(cell)
    if any(any(sums) for sums in table.values()):
        return None
    return {k: n for k, n in found.items() if n}


def lookup_table(left: DataFrame, right: DataFrame, cells: int = CELLS) -> DataFrame:
    """``cell, n, keys, checks`` of the left side less the right; cells that cancel are left out."""
    columns = sorted(_alike(left, right))
    both = left.select(_key(columns).alias("k"), F.lit(1).alias("s")).union(right.select(_key(columns), F.lit(-1)))
    text = F.col("k").cast("string")
    crc = lambda c: F.crc32(c.cast("binary"))
    places = F.array(*(F.lit(p * cells) + F.pmod(crc(F.concat(F.lit(f"{p}:"), text)), F.lit(cells)) for p in range(_PARTS)))
    signed = lambda c: F.sum(F.col("s") * c.cast("decimal(20,0)"))
    # keys that repeat within a task are folded first, so the three cells are told of each key once
    folded = both.groupBy("k").agg(F.sum("s").alias("s")).where("s <> 0")
    spread = folded.select("s", "k", crc(text).alias("c"), F.explode(places).alias("cell"))
    sums = spread.groupBy("cell").agg(F.sum("s").alias("n"), signed(F.col("k")).alias("keys"), signed(F.col("c")).alias("checks"))
    return sums.where("n <> 0 or keys <> 0 or checks <> 0")


def differing_rows(left: DataFrame, right: DataFrame, cells: int = CELLS) -> DataFrame:
    """The rows that the tables do not have equally often, with ``surplus``: how often more (negative: less) the left one has it."""
    columns = _alike(left, right)
    sides = left.select(*map(q, columns), F.lit(1).alias("surplus")).unionByName(right.select(*map(q, columns), F.lit(-1).alias("surplus")))
    exact = lambda df: df.groupBy(*map(q, columns)).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")
    rows = lookup_table(left, right, cells).collect()  # at most three times ``cells``
    found = peel({r["cell"]: [int(r["n"]), int(r["keys"]), int(r["checks"])] for r in rows}, cells)
    if found is None:
        return exact(sides)
    spark = left.sparkSession
    keys = stored(spark.createDataFrame([(k,) for k in found], "__key long"), "differing-keys")
    return exact(sides.withColumn("__key", _key(sorted(columns))).join(F.broadcast(keys), "__key").drop("__key"))  # as many keys as the cells can tell
