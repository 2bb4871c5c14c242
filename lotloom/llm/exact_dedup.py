"""Exact dedup with a heavy-hitter split.

Spark's frequent-items sketch (approx_top_k, a mergeable Misra-Gries summary) names the most frequent digests.
Their winners are found exactly by a partial aggregation over their own rows and broadcast; there are HEAVY of them
at most, whatever the input. Rows of those digests meet their winner in the map task. All other digests are aggregated
in one ordinary shuffle, and those of several rows are joined back. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, WHITE_SPACE, quoted, rows_without, text_or_empty, written

#: Frequent digests that are broadcast at most, and counters of the sketch. A digest with more than about
#: 3.5 / COUNTERS of all rows can't be missed as long as it is among the HEAVY largest.
HEAVY, COUNTERS = 512, 16384

DIGEST, CHARS, ID, ROW, K1, K2 = f"{OWN}digest", f"{OWN}chars", f"{OWN}id", f"{OWN}row", f"{OWN}k1", f"{OWN}k2"


def without_white_space(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    text = text_or_empty(quoted(text_col))
    return {ID: F.col(quoted(id_col)), K1: F.xxhash64(F.lit(1), text), K2: F.xxhash64(F.lit(2), text)}


def _fingerprints(df: DataFrame, id_col: str, text_col: str, with_keys: bool) -> DataFrame:
    """The written table of digests: its row numbers are then the same for every later step."""
    text = text_or_empty(quoted(text_col))
    own = _keys(id_col, text_col) if with_keys else {ID: F.col(quoted(id_col))}
    own |= {
        DIGEST: F.sha2(without_white_space(text), 256),
        CHARS: F.char_length(text).cast("long"),
        ROW: F.monotonically_increasing_id(),
    }
    return written(df.select(*[v.alias(k) for k, v in own.items()]), "digests")


def _decide(prints: DataFrame) -> DataFrame:
    """prints with keep_row, keep_id and group_size."""
    # the row that stays has most code points, then the least id (null last), then is the first in the table
    best = F.struct(
        (-F.col(CHARS)).alias("c"), F.col(ID).isNull().alias("n"), F.col(ID).alias("i"), F.col(ROW).alias("r")
    )
    frequent = prints.agg(F.expr(f"approx_top_k({DIGEST}, {HEAVY}, {COUNTERS})").alias("top")).select(
        F.explode(F.expr("transform(filter(top, x -> x.count > 1), x -> x.item)")).alias(DIGEST)
    )
    winners = (
        prints.select(DIGEST, CHARS, ID, ROW)
        .join(F.broadcast(frequent), DIGEST)
        .groupBy(DIGEST)
        .agg(F.min(best).alias(f"{OWN}best"), F.count(F.lit(1)).alias(f"{OWN}size"))
    )
    winners = written(winners, "winners")  # HEAVY rows at most, used twice
    marked = prints.join(F.broadcast(winners), DIGEST, "left")
    heavy = marked.where(F.col(f"{OWN}size").isNotNull())
    rest = prints.join(F.broadcast(winners.select(DIGEST)), DIGEST, "left_anti")
    several = rest.groupBy(DIGEST).agg(F.min(best).alias(f"{OWN}best"), F.count(F.lit(1)).alias(f"{OWN}size")).where(f"{OWN}size > 1")
    rest = rest.join(several, DIGEST, "left").withColumns(
        {f"{OWN}best": F.coalesce(f"{OWN}best", best), f"{OWN}size": F.coalesce(f"{OWN}size", F.lit(1).cast("long"))}
    )
    return (
        heavy.unionByName(rest)
        .withColumn("group_size", F.col(f"{OWN}size"))
        .withColumn("keep_id", F.col(f"{OWN}best.i"))
        .withColumn("kept", F.col(f"{OWN}best.r") == F.col(ROW))
        .drop(f"{OWN}size", f"{OWN}best")
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal if they are so without white space; null counts as empty, and empty texts are one group. The
    row with most code points stays, of those the one with the least id; a null id comes last, and of rows alike in
    all this one stays. Repeated ids are rows of their own. An empty table gives an empty result. No other column
    of df is read.
    """
    return _decide(_fingerprints(df, id_col, text_col, False)).select(
        F.col(ID).alias(id_col), "keep_id", "group_size", "kept", F.col(DIGEST).alias("text_sha256")
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns; the rules are those of exact_groups.

    Decisions are made on narrow rows. Texts are not shuffled unless more than BROADCAST_ROWS rows go. df is read
    twice and must give the same rows. Of rows that repeat the id and text that stay, one stays, whichever the other
    columns put first.
    """
    found = written(_decide(_fingerprints(df, id_col, text_col, True)).select(ID, K1, K2, "kept"), "kept")
    return rows_without(df, lambda d: d.withColumns(_keys(id_col, text_col)), [ID, K1, K2], found, "kept")
