"""Exact top-k search by integer inner product with dual cover trees.

The upper level of the tree is global: centres from a farthest-first walk over a bounded sample, any prefix of which
is a cover of its own, coarser than the whole. Rows are dealt to their nearest centre and queries to the nearest of
the first few, and a cover tree is built for each block once, so that no task holds more than two blocks.

A pair of nodes with centres q, p and covering radii r, s can score no more than <q, p> + r |p| + s |q| + r s. Each
query block first meets the data of its own centre. Pairs of blocks whose bound is below the worst k-th score found
there are left out before any tree is copied. The other data blocks come to the query block in at most STRIPS
streams, best bounds first. There both trees are walked together, and node pairs are skipped by the same bound
against the worst k-th score of the node's queries so far. So a query leaves STRIPS + 1 times k rows at most for the
final ranking, however many rows there are.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotloom.llm.common import quoted, small_batches, written

#: Rows of a data block and of a query block on average, and of a leaf at most.
DATA_BLOCK, QUERY_BLOCK, LEAF = 2048, 2048, 48
#: Centres, and rows they are drawn from, at most; streams of data blocks that a query block meets at most.
CENTRES, SAMPLE, STRIPS = 1024, 8192, 16
#: Scores below this are exact in doubles, with room for a tie-breaker.
EXACT = 1 << 50


class CoverTree:
    """Nodes in arrays: centre (a row number), covering radius, children, and rows (leaves hold them)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        x = vectors.astype(np.float64)
        self.norm = np.sqrt((x * x).sum(1))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        square = self.norm**2
        # all distances of one block; a block's size is bounded
        self._distance = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0))
        all_ = np.arange(len(x))
        self._build(all_, int(np.argmin(self._distance.sum(1))) if len(x) else 0)
        del self._distance

    def _build(self, rows: np.ndarray, centre: int) -> int:
        node = len(self.centre)
        away = self._distance[centre, rows]
        radius = float(away.max(initial=0))
        self.centre.append(centre)
        # a little more than measured, for rounding
        self.radius.append(radius * (1 + 1e-9) + 1e-6)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= LEAF or radius == 0:
            return node
        groups, left, c = [], rows, centre
        while left.size:
            near = self._distance[c, left] <= radius / 2
            near |= left == c
            groups.append((c, left[near]))
            left = left[~near]
            if left.size:
                c = int(left[0])  # farther than radius / 2 from every centre so far
            if len(groups) > max(8, len(rows) // 2):
                return node  # the data have no smaller clusters here: splitting on would only cost
        self.children[node] = [self._build(r, c) for c, r in groups]
        return node


def dual_tree_top_k(
    queries: CoverTree, query_rows: np.ndarray, data: CoverTree, data_rows: np.ndarray, rank: np.ndarray, k: int, least: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best data rows of each query, as (scores, positions), -1 where there are fewer; and scores computed.

    query_rows and data_rows are row numbers: a query does not meet its own row. rank orders data rows at equal
    scores. Scores below a query's `least` need not be found.
    """
    nq, nd, computed = len(queries.vectors), len(data.vectors), 0
    least = np.full(nq, -np.inf) if least is None else least
    limit = float(queries.norm.max(initial=0) * data.norm.max(initial=0)) + 1
    if limit * (nd + 1) >= 1 << 62:
        raise ValueError("scores do not fit 64 bits")
    number = np.float64 if limit < EXACT else np.int64
    a, b = queries.vectors.astype(number), data.vectors.astype(number)
    ac, bc = queries.vectors.astype(np.float64), data.vectors.astype(np.float64)
    none = np.int64(-(1 << 62))
    best = np.full((nq, k), none)  # score * (nd + 1) - rank, in no order
    slack = 1e-9 * limit + 1e-3

    def worst(q: int) -> float:
        low = best[queries.rows[q]].min(1)
        return float(np.maximum(np.where(low == none, -np.inf, low // (nd + 1)), least[queries.rows[q]]).min())

    def bound(q: int, p: int) -> float:
        i, j = queries.centre[q], data.centre[p]
        r, s = queries.radius[q], data.radius[p]
        return float(ac[i] @ bc[j]) + r * data.norm[j] + s * queries.norm[i] + r * s + slack

    heap = [(-bound(0, 0), 0, 0)] if nq and nd else []
    while heap:
        high, q, p = heapq.heappop(heap)
        if -high < worst(q):
            continue
        qc, pc = queries.children[q], data.children[p]
        if not qc and not pc:
            i, j = queries.rows[q], data.rows[p]
            computed += len(i) * len(j)
            score = np.rint(a[i] @ b[j].T).astype(np.int64)
            key = score * (nd + 1) - rank[j][None, :]
            key[query_rows[i][:, None] == data_rows[j][None, :]] = none
            both = np.concatenate([best[i], key], axis=1)
            best[i] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        elif qc and (not pc or queries.radius[q] >= data.radius[p]):
            for c in qc:
                heapq.heappush(heap, (-bound(c, p), c, p))
        else:
            for c in pc:
                heapq.heappush(heap, (-bound(q, c), q, c))
    best = -np.sort(-best, axis=1)
    by_rank = np.argsort(rank)
    low = (-best) % (nd + 1)
    return np.where(best == none, 0, -((-best) // (nd + 1))), np.where(best == none, -1, by_rank[np.minimum(low, nd - 1)] if nd else -1), computed


def farthest_first(vectors: np.ndarray, count: int) -> list[int]:
    """Row numbers of up to `count` distinct vectors, each the farthest from all before it; the first is row 0."""
    x = vectors.astype(np.float64)
    square = (x * x).sum(1)
    chosen, away = [], np.full(len(x), np.inf)
    at = 0
    while len(chosen) < min(count, len(x)) and away[at] > 0:
        chosen.append(at)
        away = np.minimum(away, np.maximum(square + square[at] - 2 * (x @ x[at]), 0))
        away[at] = 0
        at = int(away.argmax())
    return chosen


def _vectors(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(rows, -1)


def _centres(rows: DataFrame, seed: int = 0) -> dict[int, np.ndarray]:
    """Centres for each length of vectors, CENTRES at most in all but one for each length in the sample."""
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(CENTRES).collect()}
    all_ = max(1, sum(counts.values()))

    def walk(table: pa.Table) -> pa.Table:
        v = _vectors(table["v"], table.num_rows)
        n = counts.get(v.shape[1], 1)
        at = farthest_first(v, max(1, min(-(-n // DATA_BLOCK), CENTRES * n // all_)))
        return pa.table({"dim": pa.array([v.shape[1]] * len(at), pa.int32()), "place": pa.array(range(len(at)), pa.int32()), "v": pa.array(v[at].tolist(), pa.list_(pa.int64()))})

    sample = rows.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(SAMPLE)
    out: dict[int, list] = {}
    for r in sample.select("dim", "v").groupBy("dim").applyInArrow(walk, "dim int, place int, v array<long>").orderBy("dim", "place").collect():
        out.setdefault(r.dim, []).append(r.v)  # CENTRES vectors and one for each other length in the sample at most
    return {d: np.array(v, np.float64) for d, v in out.items()}


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
) -> DataFrame:
    """Each query's k best rows: query_id, rank (int, from 1), id (as id_col), score (long), all as long.

    A component x counts as floor(scale * x). Vectors that are null or hold null or non-finite components take no
    part, nor do rows without id; a query meets vectors of its own length only. Every row but the query's own is a candidate, repeats of
    its id included; repeated rows are candidates and queries of their own. Equal scores go to the smaller id, then
    the earlier row. Fewer candidates give fewer rows, an empty table none. Other columns are not read. Vectors so
    long that a score might not fit 62 bits with room for a block's rows are an error.
    """
    vector = F.col(quoted(vector_col))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = written(
        df.where(vector.isNotNull() & fine & F.col(quoted(id_col)).isNotNull()).select(
            F.col(quoted(id_col)).cast("long").alias("id"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("v"),
            F.size(vector).alias("dim"),
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
        ),
        "vectors",
    )

    small_batches(df.sparkSession)
    centres = _centres(rows)
    n_queries = rows.where("query").count()

    def indexed(of: DataFrame, block: int, most: int, name: str) -> DataFrame:
        """dim, centre, block, rows, and tree with its root's vector, radius and norm: a row for each block."""
        near = {d: c[: max(1, most)] for d, c in centres.items()}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array(batch.column("dim"))
                centre = np.zeros(len(dims), np.int32)
                for d in np.unique(dims):
                    if d in near:
                        at = np.flatnonzero(dims == d)
                        x = _vectors(batch.column("v").take(pa.array(at)), len(at)).astype(np.float64)
                        centre[at] = ((near[d] ** 2).sum(1) - 2 * (x @ near[d].T)).argmin(1)
                yield batch.append_column("centre", pa.array(centre, pa.int32()))

        def build(table: pa.Table) -> pa.Table:
            table = table.sort_by([("id", "ascending"), ("row", "ascending")])  # positions are ranks
            v = _vectors(table["v"], table.num_rows)
            small = np.abs(v).max(initial=0) < 1 << 15
            tree = CoverTree(v.astype(np.int16) if small else v)
            got = pickle.dumps((table["id"].to_numpy(), table["row"].to_numpy(), tree))
            own = {"vector": pa.array([v[tree.centre[0]].astype(float).tolist()], pa.list_(pa.float64())), "radius": [tree.radius[0]], "norm": [float(tree.norm[tree.centre[0]])], "rows": pa.array([len(v)], pa.int64())}
            return pa.table({n: table[n][:1] for n in ("dim", "centre", "block")} | own | {"tree": pa.array([got], pa.binary())})

        dealt = written(of.select("id", "v", "dim", "row").mapInArrow(deal, "id long, v array<long>, dim int, row long, centre int"), f"{name}-dealt")
        parts = dealt.groupBy("dim", "centre").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
        dealt = dealt.join(parts, ["dim", "centre"])
        dealt = dealt.withColumn("block", F.xxhash64("dim", "centre", F.pmod(F.xxhash64("row"), F.col("parts"))))
        trees = dealt.select("id", "v", "dim", "row", "centre", "block").groupBy("dim", "centre", "block")
        return written(trees.applyInArrow(build, "dim int, centre int, block long, vector array<double>, radius double, norm double, rows long, tree binary"), name)

    data = indexed(rows, DATA_BLOCK, CENTRES, "data-trees")
    queries = indexed(rows.where("query"), QUERY_BLOCK, -(-n_queries // QUERY_BLOCK), "query-trees")
    brief = ["dim", "centre", "block", "vector", "radius", "norm"]
    # narrow rows: a pair for each query block and data block
    pairs = queries.select("dim", *[F.col(c).alias(f"q_{c}") for c in brief[1:]]).join(data.select(brief), "dim")
    dot = F.aggregate(F.zip_with("q_vector", "vector", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    bound = dot + F.col("q_radius") * F.col("norm") + F.col("radius") * F.col("q_norm") + F.col("q_radius") * F.col("radius")
    own = F.min(F.when(F.col("q_centre") == F.col("centre"), F.col("block"))).over(Window.partitionBy("q_block"))
    pairs = written(pairs.select("q_block", "block", (bound * (1 + 1e-9) + 1e-3).alias("bound"), F.coalesce(F.col("block") == own, F.lit(False)).alias("own")), "pairs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q_id, q_row, q_tree, best, least = None, None, None, None, None, None

        def found() -> pa.RecordBatch:
            of, place = np.nonzero(best[2] >= 0)
            score, ids, places = (x[of, place] for x in best)
            return pa.RecordBatch.from_pydict({"q_block": np.full(len(of), at[0]), "query_id": q_id[of], "query_row": q_row[of], "vec_id": ids, "vec_row": places, "score": score})

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("q_block")[i].as_py(), batch.column("strip")[i].as_py())
                got = pickle.loads(batch.column("tree")[i].as_py())
                if key != at:  # the query block comes before its data blocks
                    if at is not None:
                        yield found()
                    at, (q_id, q_row, q_tree) = key, got
                    best = [np.full((len(q_id), k), x, np.int64) for x in (-(1 << 62), 0, -1)]
                    known = {x["row"]: x["score"] for x in batch.column("least")[i].as_py() or []}
                    least = np.array([known.get(r, -np.inf) for r in q_row.tolist()])
                    continue
                d_id, d_row, d_tree = got
                score, place, _ = dual_tree_top_k(q_tree, q_row, d_tree, d_row, np.arange(len(d_id)), k, least)
                none = (place < 0) | (score < least[:, None])
                new = (np.where(none, -(1 << 62), score), np.where(none, 0, d_id[place]), np.where(none, -1, d_row[place]))
                both = [np.concatenate(x, axis=1) for x in zip(best, new, strict=True)]
                order = np.lexsort((both[2], both[1], -both[0]), axis=1)[:, :k]
                best = [np.take_along_axis(x, order, axis=1) for x in both]
                least = np.maximum(least, np.where(best[2][:, -1] >= 0, best[0][:, -1], -np.inf))
        if at is not None:
            yield found()

    kind = "q_block long, query_id long, query_row long, vec_id long, vec_row long, score long"

    def searched(chosen: DataFrame, known: DataFrame | None) -> DataFrame:
        """What the queries of chosen (q_block, block, bound, strip) find; known: q_block, least (pairs of row and score)."""
        kinds = "array<struct<row:long,score:double>>"
        mine = chosen.select("q_block", "strip").distinct().join(queries.select(F.col("block").alias("q_block"), "tree"), "q_block")
        mine = mine.join(known.select("q_block", "least"), "q_block", "left") if known is not None else mine.withColumn("least", F.lit(None).cast(kinds))
        theirs = chosen.join(data.select("block", "tree"), "block")
        both = mine.select("q_block", "strip", F.lit(float("-inf")).alias("order"), "tree", "least").unionByName(
            theirs.select("q_block", "strip", (-F.col("bound")).alias("order"), "tree", F.lit(None).cast(kinds).alias("least"))
        )
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = both.repartition(parts, "q_block", "strip").sortWithinPartitions("q_block", "strip", "order")
        return dealt.mapInArrow(search, kind)

    first = written(searched(pairs.where("own").withColumn("strip", F.lit(0).cast("long")), None), "first")
    full = first.groupBy("q_block", "query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("score")).where(F.col("n") >= k)
    known = full.groupBy("q_block").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"), F.collect_list(F.struct(F.col("query_row").alias("row"), "score")).alias("least"))
    known = written(known, "known")
    # a block's worst is known if all its queries found k rows
    worst = known.join(queries.select(F.col("block").alias("q_block"), "rows"), "q_block").where("n = rows").select("q_block", "worst")
    rest = pairs.where("not own").join(worst, "q_block", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst")))
    rest = rest.withColumn("strip", 1 + F.pmod(F.xxhash64("block"), F.lit(STRIPS)))
    found = first.unionByName(searched(rest, known))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
    )
