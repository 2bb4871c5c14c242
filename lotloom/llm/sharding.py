"""Sharding: a Feistel permutation over global row numbers deals rows to shards and slots.

Row r of n, in the order of the keys, goes to place p = permutation(r): shard p mod shards, slot p div shards.
So shard sizes differ by one at most, slots have no gaps, and both can be computed for a row, or a row for a
place, without the data (see `place` and `row_at`).

Global row numbers come from one range partitioning, written to the shared folder with each row's partition and
place in it; a sum over the few partition counts gives the offsets. No window and no task sees all rows. The
tie-breaker that spreads a repeated key over partitions separates rows equal in every key only, and those
exchange places with one another at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, ROW_BITS, quoted, written
from lotloom.llm.feistel import Permutation


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    p = int(Permutation(n, seed).forward([row])[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number at a shard's slot."""
    return int(Permutation(n, seed).inverse([slot * shards + shard])[0])


def numbered(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """df with a gapless 0-based row number in the order of the keys (nulls first), and the number of rows."""
    tie, where = f"{OWN}tie", f"{OWN}where"
    order = [F.col(quoted(k)) for k in keys]
    sorted_ = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col(tie))
        .sortWithinPartitions(*order, F.col(tie))
        .drop(tie)
        .withColumn(where, F.monotonically_increasing_id())
    )
    table = written(sorted_, "numbered")
    part = F.shiftright(F.col(where), ROW_BITS)
    counts = {r[0]: r[1] for r in table.groupBy(part).count().collect()}  # a row for each partition
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    if not total:
        return table.withColumn(name, F.lit(0).cast("long")).drop(where), 0
    first = [0] * (max(starts) + 1)
    for p, s in starts.items():
        first[p] = s
    offset: Column = F.element_at(F.lit(np.array(first, dtype="int64")), (part + 1).cast("int"))
    return table.withColumn(name, offset + F.col(where).bitwiseAND((1 << ROW_BITS) - 1)).drop(where), total


def shard_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """df with row_number, shard and slot.

    keys order the rows before the shuffle; choose keys that identify a row. Every row stays, whatever its nulls,
    repeats or text. Rows equal in all keys are interchangeable. An empty table gives an empty result. Input
    columns named row_number, shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    kept = [c for c in df.columns if c.lower() not in ("row_number", "shard", "slot")]
    rows, n = numbered(df.select(*[F.col(quoted(c)) for c in kept]), keys, "row_number")

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = Permutation(n, seed)
        for x in batches:
            yield pd.Series(p.forward(x.to_numpy()))

    p = F.col(f"{OWN}p")
    return (
        rows.withColumn(f"{OWN}p", permuted("row_number"))
        .withColumn("shard", (p % shards).cast("int"))
        .withColumn("slot", F.expr(f"`{OWN}p` div {shards}"))
        .drop(f"{OWN}p")
    )
