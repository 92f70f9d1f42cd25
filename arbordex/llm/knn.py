"""Exact top-k search by inner product with a KD-tree per shard (operator 7).

Shards are spatial: the medians of a bounded sample split space into cells (a KD-tree on the driver), every vector goes
to its cell's shard, and a cell of many vectors (equal ones, say) is dealt to several shards by hash. In each shard a
KD-tree splits at the median of its widest axis, and every node keeps the tight box of its own points; the root's box is
the shard's. For a query, a box bounds the inner product from above (per axis, the better corner), nodes are visited
best bound first, and the visit ends where the bound falls below the k-th best score known.

Queries come in blocks of one cell. A block first meets boxes only: they bound what any of its queries can find in each
shard, before a vector moves. Then the block's shards are searched best first, in rounds of 1, 4, 16, ... shards. After
each round the k-th score of every query is its floor: the block goes on to a shard only if the shard's bound reaches the
least of its floors, and in there each query visits nothing under its own (a bound that equals a floor is visited, so ties
stay). In a task a shard's vectors come once, then the blocks that ask it, some at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbordex.llm._common import if_small, partitions, release, small_batches, table, written

SHARD_ROWS = 4096
BLOCK_ROWS = 512
LEAF_ROWS = 128
#: The tree over shards is split by the medians of at most so many vectors (those of the smallest hash of their id).
SAMPLE_ROWS = 8192
#: Shards' boxes that meet a query block in one row; query blocks that meet a shard in one task at a time.
CHUNK_BOXES = 1024
TASK_BLOCKS = 32
#: A query block's shards are searched best bound first, and so many times more of them in each round.
GROWTH = 4


class KDTree:
    """A KD-tree over integer vectors for the largest inner products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.rows)
            if parent >= 0:
                pair = list(self.children[parent] or (0, 0))
                pair[side] = node
                self.children[parent] = (pair[0], pair[1])
            points = vectors[rows]
            lo, hi = points.min(axis=0), points.max(axis=0)
            low.append(lo)
            high.append(hi)
            axis = int(np.argmax(hi - lo))
            if len(rows) <= leaf_rows or hi[axis] == lo[axis]:
                self.rows.append(rows)
                self.children.append(None)
                continue
            order = np.argpartition(points[:, axis], len(rows) // 2)
            self.rows.append(None)
            self.children.append((0, 0))
            todo += [(rows[order[: len(rows) // 2]], node, 0), (rows[order[len(rows) // 2 :]], node, 1)]
        self.ids, self.vectors, self.low, self.high = ids, vectors, np.array(low), np.array(high)

    def set_type(self, kind: type) -> None:
        """Compute in doubles (where every inner product is exact in them) or in Python integers."""
        self.vectors, self.low, self.high = (x.astype(kind) for x in (self.vectors, self.low, self.high))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, own: int, floor: float) -> list[tuple[int, int]]:
        """(score, -id) of the k best points but those of id `own`; points under `floor` may be missing."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            rows = self.rows[node]
            if rows is None:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            scores = self.vectors[rows] @ query
            for i in np.flatnonzero(scores >= floor):
                entry = (int(scores[i]), -int(self.ids[rows[i]]))
                if entry[1] == -own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(__id, __v array<bigint>): floor(scale * x) of each component, as double.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows with a null id.
    """
    v = vectors[vector_col]
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.filter(v.isNotNull() & (F.size(v) > 0) & finite & vectors[id_col].isNotNull())
    return kept.select(vectors[id_col].cast("long").alias("__id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("__v"))


def split_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (axis, threshold, left, right) by medians of the widest axis; a leaf has axis -1 and its number on the left.

    Vectors with at most the threshold go left. Cells of equal vectors are not split.
    """
    nodes: list[tuple[int, int, int, int]] = []
    cells = 0
    todo = [(np.arange(len(sample)), leaves, -1, 0)]
    while todo:
        rows, want, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            axis, at, left, right = nodes[parent]
            nodes[parent] = (axis, at, left, here) if side else (axis, at, here, right)
        points = sample[rows]
        if want < 2 or len(rows) < 2 or not (points.max(axis=0) > points.min(axis=0)).any():
            nodes.append((-1, 0, cells, 0))
            cells += 1
            continue
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        at = int(np.partition(points[:, axis], (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
        if at == points[:, axis].max():
            at = int(points[:, axis][points[:, axis] < at].max())
        low = points[:, axis] <= at
        nodes.append((axis, at, 0, 0))
        todo += [(rows[low], want // 2, here, 0), (rows[~low], want - want // 2, here, 1)]
    return nodes


def cell_of(nodes: list[tuple[int, int, int, int]], vectors: np.ndarray) -> np.ndarray:
    table_ = np.array(nodes, dtype=np.int64).reshape(-1, 4)
    at = np.zeros(len(vectors), np.int64)
    while (open_ := np.flatnonzero(table_[at, 0] >= 0)).size:
        axis, threshold, left, right = table_[at[open_]].T
        at[open_] = np.where(vectors[open_, axis] <= threshold, left, right)
    return table_[at, 2]


def _celled(trees: dict[int, list], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__id, __v) with dim and cell, and in binary form; lengths that the sample doesn't have are one cell each."""
    for b in batches:
        dims = np.diff(b["__v"].offsets.to_numpy()).astype(np.int64)
        flat, cuts = b["__v"].flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dims)))
        cell = np.zeros(b.num_rows, np.int64)
        for dim in np.unique(dims).tolist():
            if dim in trees:
                rows = np.flatnonzero(dims == dim)
                cell[rows] = cell_of(trees[dim], flat[cuts[rows][:, None] + np.arange(dim)])
        data = [flat[i:j].astype("<i8").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b["__id"], pa.array(dims, pa.int32()), pa.array(cell), pa.array(data, pa.binary())], ["id", "dim", "cell", "v"])


def _pack(rows_per: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, cell, part, id, v) sorted by the first three, into packed rows of at most rows_per vectors with their box."""
    mark, ids, vectors = None, [], []

    def out() -> pa.RecordBatch:
        points = np.frombuffer(b"".join(vectors), "<i8").reshape(len(ids), -1)
        box = [x.astype("<i8").tobytes() for x in (points.min(axis=0), points.max(axis=0))]
        return pa.RecordBatch.from_arrays(
            [pa.array([mark[0]], pa.int32()), pa.array([mark[1]], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([points.tobytes()], pa.binary()), *(pa.array([x], pa.binary()) for x in box)],
            ["dim", "cell", "ids", "vectors", "low", "high"],
        )

    for b in batches:
        for at, i, v in zip(zip(*(b[c].to_pylist() for c in ("dim", "cell", "part")), strict=True), b["id"].to_pylist(), b["v"].to_pylist(), strict=True):
            if ids and (at != mark or len(ids) == rows_per):
                yield out()
                ids, vectors = [], []
            mark = at
            ids.append(i)
            vectors.append(v)
    if ids:
        yield out()


def _packed(celled: DataFrame, rows_per: int, name: str) -> DataFrame:
    """Packed rows with a number each. A cell of more rows than one packed row takes is dealt to several by hash."""
    sizes = if_small(celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / rows_per).cast("int").alias("parts")))
    parts = celled.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    n = partitions(celled.sparkSession)
    packed = parts.repartition(n, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part").mapInArrow(lambda it: _pack(2 * rows_per, it), "dim int, cell long, ids binary, vectors binary, low binary, high binary")
    return written(packed.withColumn("number", F.monotonically_increasing_id()), name)


def _ints(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, dim, vectors, boxes) to (block, shard, bound): what any query of the block finds in the shard at most.

    In doubles, with more added than rounding can take off.
    """
    for b in batches:
        for r in b.to_pylist():
            queries = _ints(r["vectors"], r["dim"]).astype(np.float64)
            low, high = (np.stack([_ints(x[c], r["dim"])[0] for x in r["boxes"]]).astype(np.float64) for c in ("low", "high"))
            bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
            bounds += 1 + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(low), pa.int64()), pa.array([x["number"] for x in r["boxes"]], pa.int64()), pa.array(bounds.max(axis=0))], ["block", "shard", "bound"])


_FOUND = "block long, place int, query_id long, vec_id long, score long"


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part, block), a shard's own (block -1) first, to the k best of each query in each shard."""
    tree, mark, top, as_double = None, None, 0, None
    for b in batches:
        for r in b.to_pylist():
            dim = r["dim"]
            if r["block"] < 0:
                vectors = _ints(r["vectors"], dim)
                tree, mark, top, as_double = KDTree(np.frombuffer(r["ids"], "<i8"), vectors), (r["shard"], r["part"]), int(np.abs(vectors).max(initial=0)), None
                continue
            if mark != (r["shard"], r["part"]):
                raise ValueError("a query block came without its shard")
            queries, ids = _ints(r["vectors"], dim), np.frombuffer(r["ids"], "<i8")
            floors = np.full(len(ids), -np.inf)
            for x in r["floors"] or ():
                floors[x["place"]] = x["floor"]
            wide = top * int(np.abs(queries).max(initial=0)) * dim >= 1 << 53
            if as_double is None or as_double == wide:
                as_double = not wide
                tree.set_type(np.float64 if as_double else object)
            exact = queries.astype(np.float64 if as_double else object)
            bounds = tree.bounds(exact)
            rows = []
            for i in np.flatnonzero(bounds[:, 0] >= floors).tolist():
                own = int(ids[i])
                rows += [(r["block"], i, own, -neg, score) for score, neg in tree.search(exact[i], bounds[i], k, own, floors[i])]
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], ["block", "place", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products, ties to the smaller vec_id.

    queries: which rows ask (a condition on vectors). Candidates are all rows but those with the query's own id; only
    vectors of one length meet. Repeated rows are candidates each; a query repeated with its vector asks once. Fewer
    than k candidates give fewer rows, an empty table none; a score beyond 64 bits fails the job. See quantised() for the vectors that take no part.
    """
    spark = small_batches(vectors.sparkSession)
    rows = written(quantised(vectors, id_col, vector_col, scale), "knn-rows")
    n_rows = rows.count()
    sample = rows.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_ROWS).collect()  # SAMPLE_ROWS rows
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["__v"]), []).append(r["__v"])
    trees = {}
    for dim, some in by_dim.items():
        leaves = min(len(some), -(-n_rows * len(some) // (len(sample) * SHARD_ROWS)))
        if leaves > 1 and max(abs(x) for v in some for x in v) < 1 << 62:
            trees[dim] = split_tree(np.array(some, np.int64), leaves)

    def celled(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda it: _celled(trees, it), "id long, dim int, cell long, v binary")

    shards = _packed(celled(rows), SHARD_ROWS, "knn-shards")
    blocks = _packed(celled(quantised(vectors.filter(queries), id_col, vector_col, scale).distinct()), BLOCK_ROWS, "knn-blocks").withColumnRenamed("number", "block")
    n_chunks = max(1, -(-shards.count() // CHUNK_BOXES))
    boxes = shards.select(F.pmod(F.xxhash64("number"), F.lit(n_chunks)).alias("chunk"), "dim", F.struct("number", "low", "high").alias("box"))
    boxes = boxes.groupBy("chunk", "dim").agg(F.collect_list("box").alias("boxes"))  # about CHUNK_BOXES
    asked = blocks.select("block", "dim", "vectors", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<bigint>")).alias("chunk"))
    pairs = asked.join(boxes, ["chunk", "dim"]).select("block", "dim", "vectors", "boxes").mapInArrow(_bounded, "block long, shard long, bound double")
    pairs = written(pairs.withColumn("turn", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("bound"), "shard"))), "knn-pairs")
    last = pairs.agg(F.max("turn")).first()[0] or 0
    found, first, step = None, 1, 1
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    while first <= last:
        live = pairs.filter(F.col("turn").between(first, first + step - 1)).select("block", "shard", "bound")
        asking = blocks.select("block", "dim", "ids", "vectors")
        if found is None:
            asking = asking.withColumn("floors", F.lit(None).cast("array<struct<place:int,floor:double>>"))
        else:  # at most BLOCK_ROWS floors a block
            kth = found.groupBy("block", "place").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            kth = kth.groupBy("block").agg(F.collect_list(F.struct("place", F.col("floor").cast("double").alias("floor"))).alias("floors"), F.min("floor").alias("least"))
            asking = asking.join(kth, "block", "left")
            asking = asking.withColumn("least", F.when(F.size("floors") == F.octet_length("ids") / 8, F.col("least")))
            live = live.join(asking.select("block", "least"), "block").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("block", "shard", "bound")
            asking = asking.drop("least")
        live = written(live, "knn-live")
        counts = live.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_BLOCKS).cast("int").alias("parts"))
        dealt = live.join(counts, "shard").select("block", "shard", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"))
        asks = dealt.join(asking, "block").select("shard", "part", "block", "dim", "ids", "vectors", "floors")
        own = shards.withColumnRenamed("number", "shard").join(dealt.select("shard", "part").distinct(), "shard").select("shard", "part", F.lit(-1).cast("long").alias("block"), "dim", "ids", "vectors", F.lit(None).cast("array<struct<place:int,floor:double>>").alias("floors"))
        both = own.unionByName(asks).repartition(partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", "block")
        more = both.mapInArrow(lambda it: _search(k, it), _FOUND)
        all_ = more if found is None else found.unionByName(more)
        new = written(all_.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "knn-found")
        if found is not None:
            release(found)
        release(live)
        found, first, step = new, first + step, step * GROWTH
    release(rows, pairs, shards)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = {
    "op7_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
}
QUERIES = {"op7_top_k": op7_top_k}
