"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source gets a target in words, apportioned as whole blocks of BLOCK_WORDS words by highest quotients
target / (2 i + 1), first among the sources, then for each source among its hash shards. A shard's documents of a
source lie end to end in an order drawn by the seed; its quota is a run of blocks from a seeded start, once around
and on again if the quota is larger than what is there. So whole documents are taken but for those at the two ends
of a run, and no document is taken more often than the cap allows.

The quotients that can win lie in a band around each party's share: with S parties and M blocks a party with share
p gets between p (M - S/2) - 1/2 and p (M + S/2) + 1/2. Blocks below the band are given at once and quotients are
ranked inside it only, S of them in order of size, not M. Shards grow with the root of the rows, so that neither a
(source, shard) cell nor a source's list of shards gets large. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, quoted, text_or_empty, written

BLOCK_WORDS = 8
WORD = r"[^\x20\x09-\x0D]+"

SOURCE, SHARD, SIZE, ID, DRAW = f"{OWN}source", f"{OWN}shard", f"{OWN}size", f"{OWN}id", f"{OWN}draw"


def drawn(seed: int, *what: Column) -> Column:
    """A seeded 128-bit number in hexadecimal, the same in any engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *what).cast("binary"))


def upper_32(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """A row for each source (the key column SOURCE): source_size, target. Targets are filled like water.

    Sorted by the level at which they are full, sources before a given one are full; the level is the largest of
    the levels that the rest would reach.
    """
    per = sizes.groupBy(SOURCE).agg(F.sum(SIZE).alias("source_size"))
    by_source, all_ = Window.orderBy(SOURCE), Window.partitionBy()
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1)
    )
    full = F.col("source_size") * F.lit(float(cap))
    by_level = Window.orderBy("level", SOURCE)
    return (
        per.withColumn("w", w)
        .withColumn("full", full)
        .withColumn("level", F.col("full") / F.col("w"))
        .withColumn("before", F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(all_) * F.lit(float(share)))
        .withColumn("rise", F.max((F.col("total") - F.col("before")) / F.col("open")).over(all_))
        .select(SOURCE, "source_size", F.least(F.col("full"), F.col("rise") * F.col("w")).alias("target"))
    )


def apportion(parties: DataFrame, within: list[str], order: list[str], claim: str, seats: str, most: str) -> DataFrame:
    """parties with won: Sainte-Lague seats for each group of `within`, ties to the first in `order`.

    claim (double), seats (long, the group's number) and most (long, the party's limit) are columns. Parties without
    a claim get none.
    """
    group = Window.partitionBy(*within)
    claims = parties.where(F.col(claim) > 0)
    banded = (
        claims.withColumn("s", F.count(F.lit(1)).over(group))
        .withColumn("p", F.col(claim) / F.sum(claim).over(group))
        .withColumn(
            "low",
            F.least(F.col(most), F.greatest(F.lit(0), F.floor(F.col("p") * (F.col(seats) - F.col("s") / 2) - 1)).cast("long")),
        )
        .withColumn("high", F.least(F.col(most), F.ceil(F.col("p") * (F.col(seats) + F.col("s") / 2) + 1).cast("long")))
        .withColumn("left", F.col(seats) - F.sum("low").over(group))
    )
    ranked = banded.where("high > low").withColumn("i", F.explode(F.expr("sequence(low, high - 1)"))).withColumn(
        "rank",
        F.row_number().over(Window.partitionBy(*within).orderBy((F.col(claim) / (2 * F.col("i") + 1)).desc(), *order, "i")),
    )
    keys = list(dict.fromkeys(within + order))
    more = ranked.where(F.col("rank") <= F.col("left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("more"))
    return (
        parties.join(banded.select(*keys, "low"), keys, "left")
        .join(more, keys, "left")
        .withColumn("won", F.coalesce(F.col("low"), F.lit(0)) + F.coalesce(F.col("more"), F.lit(0)))
        .drop("low", "more")
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 0,
    block_words: int = BLOCK_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each row of df: its id, the `keep` columns, size, source_size, target (double) and taken (long).

    size counts words; a null text has none. Sources in code point order, null last, take the weights in turn and
    share `share` times all words; a source stops at `cap` times its words and the rest is shared anew by weight.
    taken is between 0 and cap times the size. Rows without words take 0; a table without words has targets 0; an
    empty table gives an empty result. Repeated ids are rows of their own; those equal in id, source and size are
    interchangeable. Rows without id are drawn by their text. Results depend on rows and seed alone, not on partitions or order.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col(quoted(source_col)).cast("string")), F.lit("t"))
    rows = written(
        df.select(
            *[F.col(quoted(c)).alias(f"{OWN}keep_{c}") for c in keep],
            F.col(quoted(id_col)).alias(ID),
            source.alias(SOURCE),
            F.regexp_count(text_or_empty(quoted(text_col)), F.lit(WORD)).cast("long").alias(SIZE),
            drawn(seed, F.coalesce(F.col(quoted(id_col)).cast("string"), F.concat(F.lit("null:"), F.md5(text_or_empty(quoted(text_col)).cast("binary"))))).alias(DRAW),
        ),
        "sizes",
    )
    shards = max(1, int(-(-(rows.count() ** 0.5) // 4)))
    rows = rows.withColumn(SHARD, upper_32(F.col(DRAW)) % shards)
    cells = written(rows.groupBy(SOURCE, SHARD).agg(F.sum(SIZE).alias(SIZE)), "cells")
    targets = source_targets(cells, list(weights), share, cap)
    blocks = F.ceil(F.col(SIZE) / block_words).cast("long")
    per_source = cells.groupBy(SOURCE).agg((F.sum(blocks) * cap).alias("most"))
    total = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    # each step is written, so that no plan holds the windows of those before it
    claims = written(targets.join(per_source, SOURCE).withColumn("all", F.lit(0)).withColumn("seats", total), "targets")
    sources = written(apportion(claims, ["all"], [SOURCE], "target", "seats", "most").select(SOURCE, "source_size", "target", F.col("won").alias("seats")), "sources")
    claims = cells.join(sources, SOURCE).withColumn("blocks", blocks).withColumn("claim", F.col("blocks").cast("double")).withColumn("most", F.col("blocks") * cap)
    quotas = apportion(written(claims, "claims"), [SOURCE], [SHARD], "claim", "seats", "most")
    quotas = quotas.select(SOURCE, SHARD, "source_size", "target", "blocks", F.col("won").alias("quota"))
    there = F.greatest("blocks", F.lit(1))
    runs = written(
        quotas.withColumn("rounds", F.expr("quota div greatest(blocks, 1)"))
        .withColumn("run", F.col("quota") % there)
        .withColumn("begin", upper_32(drawn(seed, F.col(SOURCE), F.col(SHARD).cast("string"))) % there * block_words)
        .withColumn("end", F.col("begin") + F.col("run") * block_words)
        .withColumn("around", F.col("end") - there * block_words)
        .drop("run", "blocks", "quota"),
        "runs",
    )
    in_cell = Window.partitionBy(SOURCE, SHARD).orderBy(DRAW, ID, SIZE)
    b = F.sum(SIZE).over(in_cell.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("b", b).withColumn("a", F.col("b") - F.col(SIZE)).join(runs, [SOURCE, SHARD])
    in_run = F.greatest(F.lit(0), F.least("b", "end") - F.greatest("a", "begin"))
    in_wrap = F.greatest(F.lit(0), F.least("b", "around") - F.col("a"))
    return placed.select(
        F.col(ID).alias(id_col),
        *[F.col(f"{OWN}keep_{c}").alias(c) for c in keep],
        F.col(SIZE).alias("size"),
        "source_size",
        "target",
        (F.col("rounds") * F.col(SIZE) + in_run + in_wrap).cast("long").alias("taken"),
    )


def repeat_by_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """df with each row as many times as the mix takes its words, to the nearest whole number (a half counts up).

    `how` goes to `mix`, whose rules for nulls, ties and empty tables hold. Rows without words are not taken. df is
    read twice and must give the same rows. Only
    documents at the two ends of a run are taken in part, so rounding moves a shard's words by one document or two.
    """
    text = text_or_empty(quoted(text_col))
    keys = [f"{OWN}k{i}" for i in range(4)]
    own = [F.col(quoted(id_col)), F.col(quoted(source_col)), F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)]
    keyed = df.withColumns(dict(zip(keys, own, strict=True)))
    taken = mix(keyed, id_col, text_col, source_col, keep=tuple(keys), **how)
    times = taken.select(*keys, F.when(F.col("size") > 0, F.expr("int((2 * taken + size) div (2 * size))")).otherwise(0).alias("times"))
    # rows alike in id, source and text share their times: the first ones by their other columns get the odd ones
    times = times.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.sum("times").alias(f"{OWN}times"), F.count(F.lit(1)).alias(f"{OWN}rows"))
    times = written(times.where(f"{OWN}times > 0"), "times")
    out = keyed.join(times, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    columns = [F.col(quoted(c)) for c in df.columns]
    sequence = lambda n: F.explode(F.sequence(F.lit(1), n)).alias(f"{OWN}copy")
    single = out.where(f"{OWN}rows = 1").select(*columns, sequence(F.col(f"{OWN}times"))).drop(f"{OWN}copy")
    if times.where(f"{OWN}rows > 1").isEmpty():
        return single
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.to_json(F.struct(*columns))))
    mine = F.expr(f"int({OWN}times div {OWN}rows)") + (F.col(f"{OWN}place") <= F.col(f"{OWN}times") % F.col(f"{OWN}rows")).cast("int")
    several = out.where(f"{OWN}rows > 1").withColumn(f"{OWN}place", place).withColumn(f"{OWN}mine", mine).where(f"{OWN}mine > 0")
    return single.unionByName(several.select(*columns, sequence(F.col(f"{OWN}mine"))).drop(f"{OWN}copy"))
