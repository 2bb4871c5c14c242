"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded and keyed by 128 bits of hash of their normalised form; distinct documents are counted for each
key in two partial aggregations, so that a line in every document costs a row for each task. The lines of keys over
the threshold are joined back by key, those of the most frequent keys in the map tasks (there are HEAVY of them at
most, as each is in that share of all lines), gathered as dropped positions for each row, and cut out by position.
Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, UPPER, WHITE_SPACE, quoted, text_or_empty, written

SEPARATOR = "\n"
#: Keys in at least this part of all lines are broadcast; there can't be more than so many.
HEAVY = 4096


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case.

    lower() is many times as fast as translate(), and the same where no other capitals stand.
    """
    bare = F.trim(line, F.lit(WHITE_SPACE))
    plain = (F.octet_length(bare) == F.char_length(bare)) | ~bare.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), key).alias(f"{OWN}h{i}") for i in (1, 2)]


def drop_shared_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """df with text_col freed of shared lines, and n_lines and n_dropped as long.

    Lines end at \\n; a null or empty text is one empty line and comes out as an empty text. Keys of min_chars code
    points or more that min_docs ids or more hold lose all their lines, except in rows of the largest id that holds
    the key. Rows that repeat an id count as one document and are treated alike; rows without id count together as
    one document, smaller than all others. Every row stays. Input columns named n_lines or n_dropped are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    own_id, text, row, pos = f"{OWN}id", f"{OWN}text", f"{OWN}row", f"{OWN}pos"
    docs = df.select(*[F.col(quoted(c)) for c in kept]).withColumns(
        {own_id: F.col(quoted(id_col)), text: text_or_empty(quoted(text_col))}
    )
    rows = docs.select(own_id, text).withColumn(row, F.xxhash64(F.lit(3), text))
    lines = written(
        rows.select(own_id, row, F.posexplode(F.split(text, SEPARATOR, -1)).alias(pos, f"{OWN}line"))
        .withColumn(f"{OWN}key", line_key(F.col(f"{OWN}line")))
        .where(F.char_length(f"{OWN}key") >= min_chars)
        .select(own_id, row, pos, *_hashes(F.col(f"{OWN}key"))),
        "lines",
    )
    hashes = [f"{OWN}h1", f"{OWN}h2"]
    shared = written(
        lines.groupBy(*hashes, own_id)
        .agg(F.lit(1).alias("one"))
        .groupBy(*hashes)
        .agg(F.count(F.lit(1)).alias(f"{OWN}n"), F.max(own_id).alias(f"{OWN}keeper"))
        .where(F.col(f"{OWN}n") >= min_docs),
        "shared",
    )
    is_heavy = F.col(f"{OWN}n") * HEAVY >= lines.count()
    heavy, light = shared.where(is_heavy).drop(f"{OWN}n"), shared.where(~is_heavy).drop(f"{OWN}n")
    rest = lines.join(F.broadcast(heavy.select(*hashes)), hashes, "left_anti")
    found = lines.join(F.broadcast(heavy), hashes).unionByName(rest.join(light, hashes))
    dropped = (
        found.where(~F.col(own_id).eqNullSafe(F.col(f"{OWN}keeper")))
        .groupBy(F.col(own_id).alias(f"{OWN}id2"), F.col(row).alias(f"{OWN}row2"))
        .agg(F.collect_set(pos).alias(f"{OWN}out"))
    )
    cut = F.coalesce(F.col(f"{OWN}out"), F.array().cast("array<int>"))
    split = F.split(F.col(text), SEPARATOR, -1)
    joined = docs.withColumn(row, F.xxhash64(F.lit(3), text)).join(
        dropped,
        F.col(own_id).eqNullSafe(F.col(f"{OWN}id2")) & (F.col(row) == F.col(f"{OWN}row2")),
        "left",
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), cut)
    text_out = F.when(F.size(cut) == 0, F.col(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(split, i)), SEPARATOR)
    )
    return joined.withColumns(
        {
            "n_lines": F.size(split).cast("long"),
            "n_dropped": F.size(cut).cast("long"),
            f"{OWN}new": text_out,
        }
    ).select(
        *[F.col(f"{OWN}new").alias(c) if c == text_col else F.col(quoted(c)) for c in kept], "n_lines", "n_dropped"
    )
