"""MinHash near-dedup with ProbMinHash signatures.

A document is its 5-word shingles, each weighted by its count. Shingle d with weight w sends arrivals of a Poisson
process of rate w to random registers; a register keeps the shingle that arrives first. Arrivals are made up to a time
by which every register has most likely been reached, and to twice that time if one has not; none later can be first.
Two documents agree in a register with their probability Jaccard similarity
J_P = sum over d of 1 / sum over e of max(a_e / a_d, b_e / b_d).

Documents alike word for word share a digest and are one representative from then on. Representatives that agree in
all registers of a band meet in a bucket, and every pair of a bucket is a candidate. Pairs are never written out:

1. Buckets are joined into components over narrow rows, and each component's texts go to one block, which one task
   compares exactly: candidates not yet in one class, by exact similarity. A component of more than BLOCK_ROWS members
   or BLOCK_BYTES of text is dealt to several blocks, like texts (by the leader of most of their buckets) together.
2. Only where components were dealt to several blocks can candidates have been apart. There each bucket's least member
   meets the least member of each other class of the bucket, in tiles of TILE rows.
3. What then are still candidates of different classes and blocks meet in tiles of two blocks.

So every candidate pair is compared or already in one class, whatever the size of its group, and no task holds more
than two blocks. Links are joined into classes by large-star and small-star steps, all in written tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, Table, give_back, quoted, rows_without, small_batches, text_or_empty, written
from lotloom.llm.words import blocks, mix, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: With similarity 0.8 a pair shares none of the 24 bands with probability (1 - 0.8**5)**24 = 7e-5.
BANDS, BAND_ROWS = 24, 5
#: Members of a block and bytes of their texts, on average; members that meet a leader in a tile, on average.
BLOCK_ROWS, BLOCK_BYTES, TILE = 4096, 16 << 20, 1024
#: Similarities that differ from the threshold by rounding count as reaching it.
ROUNDING = 1e-9
#: Keys (a number each) that are broadcast at most to pick texts out; beyond that texts meet them in a shuffle.
BROADCAST_KEYS = 1 << 20

_U = np.uint64
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

ID, ROW, TEXT, K1, K2 = f"{OWN}id", f"{OWN}row", f"{OWN}text", f"{OWN}k1", f"{OWN}k2"


def shingle_counts(texts: list[bytes], width: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes and their counts for each text; A-Z in lower case.

    A text of fewer words than the width has one shingle of all its words, a text without words none.
    """
    hashes, of, _, _, _ = word_hashes(texts, lower=True)
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        for i in range(len(texts)):
            h = hashes[at[i] : at[i + 1]]
            n = len(h)
            if not n:
                out.append((np.empty(0, np.uint64), np.empty(0)))
                continue
            size = min(width, n)
            s = np.zeros(n - size + 1, np.uint64)
            for j in range(size):
                s += h[j : n - size + 1 + j] * (_STEP[j % len(_STEP)] + _U(2 * (j // len(_STEP))))
            values, counts = np.unique(mix(s + _U(size)), return_counts=True)
            out.append((values, counts.astype(np.float64)))
    return out


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, registers: int, seed: int = 0) -> np.ndarray:
    """The element that arrives first at each register. There must be elements, with positive weights."""
    keys = mix(elements ^ _U((seed * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF))
    until = registers * (math.log(registers) + 3) / weights.sum()
    while True:
        times, first = np.full(registers, np.inf), np.zeros(registers, np.uint64)
        t, made, active = np.zeros(len(elements)), np.zeros(len(elements), np.uint64), np.arange(len(elements))
        while active.size:
            # as many arrivals as each element is likely to send until then; the rest in the next turn
            each = np.clip(np.ceil(weights[active] * (until - t[active])), 1, 4096).astype(np.int64)
            of, ends = np.repeat(np.arange(active.size), each), np.cumsum(each)
            begins = ends - each
            with np.errstate(over="ignore"):
                turn = made[active][of] + (np.arange(len(of)) - begins[of]).astype(np.uint64)
                r = mix(keys[active][of] + turn * _STEP[0])
            wait = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active][of]
            run = np.cumsum(wait)
            at = run - (run[begins] - wait[begins])[of] + t[active][of]
            soon = np.flatnonzero(at <= until)
            to = (mix(r[soon]) % _U(registers)).astype(np.int64)
            np.minimum.at(times, to, at[soon])
            hit = at[soon] == times[to]
            first[to[hit]] = elements[active][of[soon[hit]]]
            made[active] += each.astype(np.uint64)
            t[active] = at[ends - 1]
            active = active[t[active] <= until]
        if np.isfinite(times).all():
            return first  # all arrivals up to then were made, so none later can be first
        until *= 2


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets. Sets without elements are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not common.size:
        return 0.0
    wa, wb = a[1][i], b[1][j]
    # sum over e of max(a_e / a_d, b_e / b_d): e with a_e / b_e above that of d count by a, the others by b
    ratio = wa / wb
    order = np.argsort(ratio)
    ra, rb, ratio = wa[order], wb[order], ratio[order]
    above = np.concatenate((np.cumsum(ra[::-1])[::-1], [0])) + (a[1].sum() - wa.sum())
    below = np.concatenate(([0], np.cumsum(rb))) + (b[1].sum() - wb.sum())
    cut = np.searchsorted(ratio, ratio, side="right")
    return float((1 / (above[cut] / ra + below[cut] / rb)).sum())


def _normal_digest(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _signed(docs: DataFrame) -> DataFrame:
    """ID and keys of each row of docs (ID, TEXT, K1, K2), its bytes, the digest of its words and its bands' buckets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {n: batch.column(i) for i, n in enumerate((ID, K1, K2))}
            for first, run in blocks(batch.column(3).to_pylist()):
                at, found = [0], []
                for values, counts in shingle_counts(run):
                    if len(values):  # a text without words has no buckets
                        with np.errstate(over="ignore"):
                            got = prob_min_hash(values, counts, BANDS * BAND_ROWS).reshape(BANDS, BAND_ROWS)
                            found.append(mix((got * _STEP[:BAND_ROWS]).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[5]))
                    at.append(len(found) * BANDS)
                flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {n: c.slice(first, len(run)) for n, c in kept.items()}
                    | {
                        "bytes": pa.array([len(t) for t in run], pa.int64()),
                        "digest": pa.array([_normal_digest(t) for t in run], pa.binary()),
                        "bands": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
                    }
                )
        give_back()

    small_batches(docs.sparkSession)
    kind = docs.schema[ID].dataType.simpleString()
    return docs.select(ID, K1, K2, TEXT).mapInArrow(sign, f"{ID} {kind}, {K1} long, {K2} long, bytes long, digest binary, bands array<long>")


class Block:
    """Texts that one task compares: each with its row, the buckets it is in, its class so far and its part."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.texts: list[str] = []
        self.buckets: list[list[int]] = []
        self.roots: list[int] = []
        self.parts: list[int] = []
        self._seen: set[int] = set()

    def add(self, row: int, text: str, buckets: list[int], root: int, part: int) -> None:
        """A row that is there already (its id and text were repeated) is left out."""
        if row not in self._seen:
            self._seen.add(row)
            self.rows.append(row)
            self.texts.append(text)
            self.buckets.append(buckets)
            self.roots.append(root)
            self.parts.append(part)

    def links(self, threshold: float) -> tuple[list[int], list[int]]:
        """Links from the least row of each class to its others, after comparing all pairs of different classes and
        parts that share a bucket."""
        n = len(self.rows)
        if n < 2:
            return [], []
        sets = [x for _, run in blocks(self.texts) for x in shingle_counts(run)]
        sizes = np.array([len(v) for v, _ in sets])
        begin = np.concatenate(([0], np.cumsum(sizes)))
        code = np.unique(np.concatenate([v for v, _ in sets]), return_inverse=True)[1]
        share = np.concatenate([c / c.sum() if len(c) else c for _, c in sets])
        single = np.array([bool((c == 1).all()) for _, c in sets])
        of_pivot = np.zeros(int(code.max(initial=0)) + 1)
        owner = np.repeat(np.arange(n), [len(b) for b in self.buckets])
        bucket = np.unique(np.concatenate([np.array(b, np.int64) for b in self.buckets]), return_inverse=True)[1]
        order = np.argsort(bucket, kind="stable")
        members = np.split(owner[order], np.flatnonzero(np.diff(bucket[order])) + 1)
        own = np.split(bucket, np.cumsum([len(b) for b in self.buckets])[:-1])
        label, part = np.unique(self.roots, return_inverse=True)[1], np.unique(self.parts, return_inverse=True)[1]
        least, begun = threshold - ROUNDING, label.copy()
        for i in range(n):
            mask = np.zeros(n, bool)
            for b in own[i]:
                mask[members[b]] = True
            mask[: i + 1] = False
            mask &= (label != label[i]) & (part != part[i]) & (sizes > 0)
            if single[i]:
                mask &= ~single | (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]))
            mates = np.flatnonzero(mask)
            if not mates.size:
                continue
            mine = slice(begin[i], begin[i + 1])
            ends = np.cumsum(sizes[mates])
            starts = ends - sizes[mates]
            place = np.repeat(begin[mates] - starts, sizes[mates]) + np.arange(ends[-1])
            of_pivot[code[mine]] = share[mine]
            common = of_pivot[code[place]]
            of_pivot[code[mine]] = 0
            # a register is drawn by each text's shares, so agreement is no likelier than what the shares have in common
            bound = np.add.reduceat(np.minimum(common, share[place]), starts)
            same = np.add.reduceat((common > 0).astype(np.int64), starts)
            plain = single[mates] & single[i]
            alike = plain & (same >= least * (sizes[i] + sizes[mates] - same))
            for at in np.flatnonzero(alike | ~plain & (bound >= least)):
                j = mates[at]
                if label[j] != label[i] and (alike[at] or prob_jaccard(sets[i], sets[j]) >= least):
                    label[label == label[j]] = label[i]
        a, b = [], []
        rows = np.array(self.rows)
        for one in np.unique(label[label != begun]):  # classes that grew
            class_ = rows[label == one]
            a += [int(class_.min())] * len(class_)
            b += class_.tolist()
        return a, b


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among rows (tile, ROW, TEXT, buckets, root, part)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, block = None, Block()

        def found() -> pa.RecordBatch:
            a, b = block.links(threshold)
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            for t, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if t != tile:
                    yield found()
                    tile, block = t, Block()
                block.add(*row)
        yield found()
        give_back()

    dealt = rows.select("tile", ROW, TEXT, "buckets", "root", "part").repartition("tile").sortWithinPartitions("tile", ROW)
    return dealt.mapInArrow(compare, "a long, b long").where("a != b").distinct()


def _blocks(met: DataFrame, reps: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """ROW, ID, K1, K2, buckets, block and split for each representative in met (bucket, ROW, leader).

    split tells whether the component has several blocks.
    """
    joined = components(met.select(F.col("leader").alias("a"), F.col(ROW).alias("b"))).withColumnRenamed("node", ROW)
    members = met.groupBy(ROW).agg(F.collect_list("bucket").alias("buckets"), F.mode("leader", True).alias("leader"))
    members = members.join(joined, ROW).join(reps.select(ROW, ID, K1, K2, "bytes"), ROW)
    members = written(members, "members")
    parts = F.ceil(F.greatest(F.sum("bytes") / block_bytes, F.count(F.lit(1)) / block_rows))
    large = members.groupBy("root").agg(parts.alias("parts")).where("parts > 1")
    hot = members.join(large, "root", "left_semi").groupBy("root", "leader").agg(parts.alias("own_parts")).where("own_parts > 1")
    dealt = members.join(large, "root", "left").join(hot, ["root", "leader"], "left")
    block = (
        F.when(F.col("parts").isNull(), F.xxhash64("root"))
        .when(F.col("own_parts").isNull(), F.xxhash64("root", F.pmod(F.xxhash64("leader"), F.col("parts"))))
        .otherwise(F.xxhash64("root", "leader", F.pmod(F.xxhash64(ROW), F.col("own_parts"))))
    )
    return dealt.select(ROW, ID, K1, K2, "buckets", block.alias("block"), F.col("parts").isNotNull().alias("split"))


def _with_text(need: DataFrame, members: DataFrame, docs: DataFrame, known: int) -> DataFrame:
    """need (with ROW) with TEXT, found in docs by keys and id; a repeated row gives a row for each time."""
    if known <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(members.select(K1).distinct()), K1, "left_semi")
    keys = need.join(members.select(ROW, F.col(ID).alias("i"), K1, K2), ROW)
    return keys.join(docs, [K1, K2]).where(F.col("i").eqNullSafe(F.col(ID))).drop("i", ID, K1, K2)


def _links(reps: DataFrame, docs: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, root) for every representative in a class of several; reps: ROW, ID, K1, K2, bytes, bands."""
    exploded = reps.select(F.explode("bands").alias("bucket"), ROW)
    shared = exploded.groupBy("bucket").agg(F.min(ROW).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = written(exploded.join(shared, "bucket"), "met")
    members = written(_blocks(met, reps, block_rows, block_bytes), "blocks")
    known = members.count()
    first = members.select(F.col("block").alias("tile"), ROW, "buckets", F.col(ROW).alias("root"), F.col(ROW).alias("part"))
    links = written(_compared(_with_text(first, members, docs, known), threshold), "links")
    split = members.where("split")
    if split.isEmpty():  # each class lies in a block, and its links all start from its least row
        return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    apart = split.select(ROW, "block", F.explode("buckets").alias("bucket"))

    def open_() -> tuple[DataFrame, DataFrame]:
        """Classes, and members of buckets with several classes and blocks (bucket, ROW, block, root)."""
        classes = written(components(links), "classes")
        of = written(apart.join(classes.withColumnRenamed("node", ROW), ROW, "left").withColumn("root", F.coalesce("root", ROW)), "apart")
        several = of.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min("block").alias("b"), F.max("block").alias("c")).where("r < s and b < c")
        return classes, written(of.join(several.select("bucket"), "bucket", "left_semi"), "open")

    _, left = open_()
    least = left.groupBy("bucket", "root").agg(F.min(ROW).alias(ROW))
    pairs = least.join(least.groupBy("bucket").agg(F.min(F.struct(ROW, "root")).alias("leader")), "bucket").where(F.col(ROW) != F.col(f"leader.{ROW}"))
    pairs = pairs.select("leader", ROW, "root").distinct()
    parts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    tiled = pairs.join(parts, "leader").withColumn("tile", F.xxhash64(f"leader.{ROW}", F.pmod(F.xxhash64(ROW), F.col("parts"))))
    both = tiled.select("tile", ROW, "root", F.lit(1).cast("long").alias("part")).unionByName(
        tiled.select("tile", f"leader.{ROW}", "leader.root", F.lit(0).cast("long").alias("part")).distinct()
    )
    both = both.withColumn("buckets", F.array(F.lit(0).cast("long")))
    links = written(links.unionByName(_compared(_with_text(both, members, docs, known), threshold)), "links-of-leaders")
    classes, left = open_()
    of_block = left.select("bucket", "block").distinct()
    tiles = of_block.join(of_block.withColumnRenamed("block", "to"), "bucket").where("block < to").withColumn("tile", F.xxhash64("block", "to"))
    sides = tiles.select("bucket", "tile", "block").unionByName(tiles.select("bucket", "tile", F.col("to").alias("block")))
    cross = left.join(sides, ["bucket", "block"]).groupBy("tile", ROW, "root", F.col("block").alias("part")).agg(F.collect_set("bucket").alias("buckets"))
    links = written(links.unionByName(_compared(_with_text(cross, members, docs, known), threshold)), "all-links")
    return components(links)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), the root being the component's least node.

    Each step of large star and small star is two joins with a least neighbour for each node; it ends when a step
    changes nothing. Nodes with many neighbours are only ever aggregated or joined, which can be split.
    """
    edges = Table(links.select("a", "b").where("a != b").distinct(), "edges")
    while True:
        both = edges.df.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = Table(both.join(least, "u").where("v > u and v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-star")
        down = large.df.groupBy("b").agg(F.min("a").alias("m"))
        small = large.df.join(down, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a != b").distinct()
        new = Table(small, "small-star")
        same = new.df.count() == edges.df.count() and new.df.join(edges.df, ["a", "b"], "left_anti").isEmpty()
        edges.drop()
        large.drop()
        edges = new
        if same:
            break
    roots = edges.df.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _classes(docs: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ROW, ID, K1, K2, class_id, class_size, kept for every row of docs (ID, TEXT, K1, K2)."""
    signed = written(_signed(docs).withColumn(ROW, F.monotonically_increasing_id()), "signatures")
    first = F.struct(F.col(ID).isNull().alias("no_id"), ID, ROW, K1, K2, "bytes", "bands")
    copies = written(signed.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")), "copies")
    roots = _links(copies.select("first.*"), docs, threshold, block_rows, block_bytes)
    rep = copies.select("digest", "copies", f"first.{ROW}", F.struct("first.no_id", f"first.{ID}", f"first.{ROW}").alias("first"))
    rep = written(rep.join(roots.withColumnRenamed("node", ROW), ROW, "left").withColumn("root", F.coalesce("root", ROW)), "roots")
    whole = rep.groupBy("root").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size"))
    of_digest = rep.select("digest", "root").join(whole, "root").select("digest", "best", "class_size")
    return signed.select(ROW, ID, K1, K2, "digest").join(of_digest, "digest").select(
        ROW, ID, K1, K2, F.col(f"best.{ID}").alias("class_id"), "class_size", (F.col(f"best.{ROW}") == F.col(ROW)).alias("kept")
    )


def _keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = text_or_empty(quoted(text_col))
    return df.select(*more, F.col(quoted(id_col)).alias(ID), text.alias(TEXT), F.xxhash64(F.lit(1), text).alias(K1), F.xxhash64(F.lit(2), text).alias(K2))


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """A row for each row of df: its id, class_id, class_size and kept.

    Texts alike word for word (A-Z in lower case) are copies and in one class; so are all texts without words, null
    included. Representatives of copies whose similarity is the threshold or more are linked, and linked ones are in
    one class. class_id is the class's least id (null only if none has an id); the first row with that id is kept.
    Repeated ids are rows of their own. An empty table gives an empty result; other columns are not read. df is read
    several times and must give the same rows each time. Sizes of blocks change the work, not the result.
    """
    got = _classes(_keyed(df, id_col, text_col), threshold, block_rows, block_bytes)
    return got.select(F.col(ID).alias(id_col), "class_id", "class_size", "kept")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that near_classes keeps, one of each class, with df's columns.

    Of rows that repeat the kept id and text one stays, whichever the other columns put first.
    """
    found = written(_classes(_keyed(df, id_col, text_col), threshold).select(ID, K1, K2, "kept"), "kept")
    return rows_without(df, lambda d: _keyed(d, id_col, text_col, "*").drop(TEXT), [ID, K1, K2], found, "kept")
