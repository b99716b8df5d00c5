"""Exact top-k by inner product with a dual-tree search over cover trees.

Data points y get one more coordinate, sqrt(M^2 - |y|^2), and queries get 0 there, so
that a larger inner product is a smaller distance. Both sides are indexed; a pair of
nodes is skipped when the bound from its centres' distance and covering radii is below
the worst kth score of the queries under the query node.

The top of both trees is shared: the centres of a cover tree over a bounded sample of
rows are pivots, and every row, query or not, goes under its nearest one, so a pivot's
cell is a node over real rows with their covering radius. Cells are cut into blocks of
bounded size, in which the tree goes on.

1. Every group of queries of one cell searches one block of the nearest data cell: this
   gives each query a kth score to start from, and each group its worst one.
2. Groups meet the cells: a cell whose bound is below the group's worst kth score is
   skipped, and its rows are not sent there. The blocks of the others get the group's
   queries, with their kth scores, and are searched by the rest of the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import map_arrow, written

SCALE = 64
K = 20
#: The largest square of a vector's length: scores, their sums on the way and components then fit their integers.
MOST_NORM = 2.0**61
#: Points of a leaf, about, and of a node that is no more divided.
LEAF, SMALL = 128, 32
#: Rows of a block of data and of a group of queries, fewer where vectors are long (NUMBERS in all): they bound a task's memory.
BLOCK_ROWS, GROUP_ROWS, NUMBERS = 4096, 2048, 1 << 22
#: Groups of queries that a copy of a data block serves.
GROUPS = 16
#: Rows on which the shared top of the trees is fitted, and pivots that it has, at most.
SAMPLE, PIVOTS = 4096, 1024
#: Tasks among which pairs of blocks and groups are dealt at most.
TASKS = 20_000


class _Node:
    """A node over points around a centre. A leaf may bind several small nodes: parts are where each one's points begin, with its own centre and radius."""

    __slots__ = ("center", "radius", "points", "children", "centers", "radii", "parts", "part_centers", "part_radii")

    def __init__(self, center: int, radius: float, points: np.ndarray, children: list[_Node], parts: list[tuple[int, int, float]] | None = None):
        self.center, self.radius, self.points, self.children = center, radius, points, children
        self.centers, self.radii = np.array([c.center for c in children], np.int64), np.array([c.radius for c in children])
        sizes, centers, radii = zip(*(parts or [(len(points), center, radius)]), strict=True)
        self.parts, self.part_centers, self.part_radii = np.cumsum([0, *sizes])[:-1], np.array(centers), np.array(radii)


def build(x: np.ndarray) -> _Node:
    """A cover tree over the rows of x: a node at scale i has children at scale i - 1 whose centres are more than 2**(i-1) apart and cover its points to within that; a child holds the point of its parent.

    Children of few points, of which there are many where all points are far apart, are
    bound together into leaves of about LEAF points; a leaf keeps their centres and radii,
    so that a search still skips them one by one.
    """
    squares = np.einsum("ij,ij->i", x, x)

    def distances(points: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[points] + squares[c] - 2 * (x[points] @ x[c]), 0))

    def node(points: np.ndarray, c: int, d: np.ndarray) -> _Node:
        radius = float(d.max())
        if len(points) <= SMALL or radius == 0:
            return _Node(c, radius, points, [])
        reach = 2.0 ** (math.ceil(math.log2(radius)) - 1)
        children, small = [], []
        rest, center, near, own = points, c, d, d
        while True:
            inside = near <= reach
            if inside.sum() > SMALL:
                children.append(node(rest[inside], center, near[inside]))
            else:
                small.append((rest[inside], center, float(near[inside].max()), float(own[inside].max())))
            rest, own = rest[~inside], own[~inside]
            if not len(rest):
                break
            center = int(rest[0])
            near = distances(rest, center)
            near[0] = 0.0
        small.sort(key=lambda s: s[3])
        held: list[tuple] = []
        for i, part in enumerate(small):
            held.append(part)
            if sum(len(p[0]) for p in held) >= LEAF or i == len(small) - 1:
                children.append(_Node(c, max(p[3] for p in held), np.concatenate([p[0] for p in held]), [], [(len(p[0]), p[1], p[2]) for p in held]))
                held = []
        return _Node(c, radius, points, children)

    every = np.arange(len(x))
    # Rounding in the distances is covered by widening every radius a little where it is used.
    return node(every, 0, distances(every, 0))


class Search:
    """Top-k of queries against blocks of data, by (score descending, id ascending), without the query's own row.

    kth: scores below which nothing is wanted, one for each query; m2: the largest squared norm of all data.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, m2: float | None = None):
        self.k, self.rows, self.ids, self.d = k, rows, ids, data
        plain = data.astype(np.float64)
        norms = np.einsum("ij,ij->i", plain, plain)
        self.m2 = float(norms.max(initial=0)) if m2 is None else m2
        self.far = np.hstack([plain, np.sqrt(np.maximum(self.m2 - norms, 0))[:, None]])
        self.tree = build(self.far) if len(data) else None
        self.pairs = self.skipped = 0

    def run(self, query_rows: np.ndarray, queries: np.ndarray, kth: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scores and places in data of what each query finds, best first."""
        exact = max(np.abs(queries).max(initial=0), np.abs(self.d).max(initial=0)) ** 2 * max(1, self.d.shape[1]) < 2**53
        self.query_rows, self.q = query_rows, queries.astype(np.float64) if exact else queries
        self.data = self.far[:, :-1] if exact else self.d
        self.near = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
        self.q2 = np.einsum("ij,ij->i", self.near, self.near)
        self.slack = 1e-9 * (self.m2 + float(self.q2.max(initial=0)) + 1)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        self.kth = np.full(len(queries), -np.inf) if kth is None else kth.astype(np.float64)
        if len(queries) and self.tree is not None:
            self._pair(build(self.near), self.tree)
        return self.scores, self.found

    def _bounds(self, centers: np.ndarray, radii: np.ndarray, far: np.ndarray, far_radii: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products under pairs of nodes; top: the largest squared norm of the queries."""
        return upper_bound(np.sqrt(np.square(self.near[centers] - self.far[far]).sum(axis=1)) - radii - far_radii, top, self.m2) + self.slack

    def _pair(self, a: _Node, b: _Node) -> None:
        stack = [(np.inf, a, b)]
        while stack:
            bound, a, b = stack.pop()
            self.pairs += 1
            worst = self.kth[a.points].min()
            if bound < worst:
                self.skipped += 1
                continue
            if not a.children and not b.children:
                self._leaves(a, b)
                continue
            if b.children and (not a.children or b.radius >= a.radius):
                bounds = self._bounds(np.full(len(b.children), a.center), a.radius, b.centers, b.radii, self.q2[a.points].max())
                pairs = [(x, a, c) for x, c in zip(bounds.tolist(), b.children, strict=True)]
            else:
                top = np.array([self.q2[c.points].max() for c in a.children])
                bounds = self._bounds(a.centers, a.radii, np.full(len(a.children), b.center), b.radius, top)
                pairs = [(x, c, b) for x, c in zip(bounds.tolist(), a.children, strict=True)]
            stack += sorted(pairs, key=lambda x: x[0])

    def _leaves(self, a: _Node, b: _Node) -> None:
        qs, ds = a.points, b.points
        if (len(a.parts) > 1 or len(b.parts) > 1) and (a.part_radii.any() or b.part_radii.any()):
            # The same bound for every pair of parts at once; between single points it would be the score itself.
            x, y = self.near[a.part_centers], self.far[b.part_centers]
            gap = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * (x @ y.T), 0)) - a.part_radii[:, None] - b.part_radii
            may = upper_bound(gap, np.maximum.reduceat(self.q2[qs], a.parts)[:, None], self.m2) + self.slack >= np.minimum.reduceat(self.kth[qs], a.parts)[:, None]
            self.pairs += may.size
            self.skipped += may.size - int(may.sum())
            qs = qs[np.repeat(may.any(axis=1), np.diff(a.parts, append=len(qs)))]
            ds = ds[np.repeat(may.any(axis=0), np.diff(b.parts, append=len(ds)))]
            if not len(qs) or not len(ds):
                return
        scores = self.q[qs] @ self.data[ds].T
        own = self.query_rows[qs][:, None] == self.rows[ds]
        hit = (scores >= self.kth[qs][:, None]) & ~own
        for i in np.flatnonzero(hit.any(axis=1)):
            q, c = qs[i], ds[hit[i]]
            s = np.concatenate([self.scores[q], scores[i][hit[i]].astype(np.int64)])
            f = np.concatenate([self.found[q], c])
            order = np.lexsort((self.rows[f], self.ids[f], -s))[: self.k]
            self.scores[q], self.found[q] = s[order], f[order]
            if len(order) == self.k:
                self.kth[q] = max(self.kth[q], s[order[-1]])


def upper_bound(gap: np.ndarray, top: np.ndarray | float, m2: float) -> np.ndarray:
    """The largest inner product at a distance of gap or more, of queries of squared norm top or less."""
    gap = np.maximum(gap - 1e-7 * (1 + np.abs(gap)), 0.0)
    return (top + m2 - gap * gap) / 2


class Pivots:
    """The shared top of the trees: centres, and what lies under them. data and asks: rows, and covering radius of each cell's; top: largest squared norm of each cell's queries."""

    def __init__(self, sample: np.ndarray, m2: float, wanted: int):
        plain = sample.astype(np.float64)
        norms = np.einsum("ij,ij->i", plain, plain)
        far = np.hstack([plain, np.sqrt(np.maximum(m2 - norms, 0))[:, None]])
        nodes = [build(far)]
        centers = {nodes[0].center}
        while len(centers) < min(wanted, PIVOTS):  # the widest node gives way to its children
            node = max((x for x in nodes if x.children), key=lambda x: (x.radius, -x.center), default=None)
            if node is None:
                break
            nodes.remove(node)
            nodes += node.children
            centers |= {x.center for x in node.children}
        self.m2 = m2
        self.centers = far[sorted(centers)[:PIVOTS]]
        self.squares = np.einsum("ij,ij->i", self.centers, self.centers)
        self.asks_rows = self.data_rows = np.zeros(len(self.centers), np.int64)
        self.asks_radius = self.data_radius = self.top = np.zeros(len(self.centers))

    def nearest(self, x: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and distance of each row's nearest pivot."""
        x = np.hstack([x.astype(np.float64), extra[:, None]])
        at = (self.squares - 2 * (x @ self.centers.T)).argmin(axis=1)
        return at, np.sqrt(np.square(x - self.centers[at]).sum(axis=1))

    def first(self) -> np.ndarray:
        """The nearest cell with data of each cell's queries."""
        far = np.array([np.sqrt(np.square(self.centers - c).sum(axis=1)) for c in self.centers])
        far[:, self.data_rows == 0] = np.inf
        return far.argmin(axis=1)

    def open(self, cell: int, worst: float) -> np.ndarray:
        """The cells that may hold a score of `worst` or more for some query of the cell."""
        gap = np.sqrt(np.square(self.centers - self.centers[cell]).sum(axis=1)) - self.asks_radius[cell] - self.data_radius
        slack = 1e-9 * (self.m2 + self.top[cell] + 1)
        return np.flatnonzero((upper_bound(gap, self.top[cell], self.m2) + slack >= worst) & (self.data_rows > 0))


_FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("qcell", pa.int32()), ("qgroup", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SCHEMA = "query_id long, query_row long, qcell int, qgroup int, vec_id long, score long"
_NO_ID = np.int64(2**63 - 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, is_query, k: int = K, vector: str = "embedding", vec_id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): the k rows of largest integer inner product with each row for which is_query (a Column) is true, its own row left out.

    A component x becomes floor(scale * x), computed as double. Where the square of a
    vector's length passes MOST_NORM a score could pass what is exact: that raises and
    names the vec_id. Vectors that are null, or hold null or non-finite components, take no part. A
    shorter vector counts as filled up with zeros. Ties go to the smaller vec_id, null
    ones last. Rows with equal ids are separate rows, queries and candidates alike. No
    rows or no queries: no result; other columns of vectors are not read.
    """
    spark = vectors.sparkSession
    v, finite = F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ints = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"), is_query.alias("is_query")).where(v.isNotNull() & F.forall(v, finite))
    rows = written(ints.select("vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"), F.coalesce("is_query", F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row")), "vectors")
    norm = F.expr("aggregate(v, 0D, (s, x) -> s + cast(x AS double) * x)")
    n, q, m2, width = rows.agg(F.count("*"), F.count_if("is_query"), F.max(norm), F.max(F.size("v"))).first()
    if not n or not q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if m2 > MOST_NORM:
        raise ValueError(f"vec_id {rows.where(norm > MOST_NORM).first()['vec_id']}: components so large that scores would not be exact")
    most = max(1, NUMBERS // max(width, 1))
    block_rows, group_rows = min(BLOCK_ROWS, most), min(GROUP_ROWS, most)
    sample = rows.select("v", "row").orderBy(F.xxhash64("row"), "row").limit(min(SAMPLE, most)).toArrow()
    pivots = Pivots(_matrix(sample.column("v"), width), m2, math.ceil(n / block_rows))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = _matrix(part.column("v"), width).astype(np.float64)
                norms = np.einsum("ij,ij->i", x, x)
                asks = part.column("is_query").to_numpy(zero_copy_only=False)
                cell, far = pivots.nearest(x, np.sqrt(np.maximum(m2 - norms, 0)))
                qcell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
                if asks.any():
                    qcell[asks], near[asks] = pivots.nearest(x[asks], np.zeros(asks.sum()))
                new = [pa.array(cell.astype(np.int32)), pa.array(far), pa.array(qcell.astype(np.int32)), pa.array(near), pa.array(norms)]
                # No component is larger than the square root of MOST_NORM.
                same = [c.cast(pa.list_(pa.int32())) if name == "v" else c for name, c in zip(part.schema.names, part.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, *new], names=[*part.schema.names, "cell", "far", "qcell", "near", "norm"])

    dealt = written(map_arrow(rows, assign, "vec_id long, v array<int>, is_query boolean, row long, cell int, far double, qcell int, near double, norm double"), "vectors")
    # At most PIVOTS rows each.
    under = dealt.groupBy("cell").agg(F.count("*"), F.max("far")).collect()
    asking = dealt.where("is_query").groupBy("qcell").agg(F.count("*"), F.max("near"), F.max("norm")).collect()
    size = len(pivots.centers)
    count = lambda got, i: np.array([dict((r[0], r[i]) for r in got).get(c, 0) for c in range(size)])
    pivots.data_rows, pivots.data_radius = count(under, 1), count(under, 2).astype(float)
    pivots.asks_rows, pivots.asks_radius, pivots.top = count(asking, 1), count(asking, 2).astype(float), count(asking, 3).astype(float)
    blocks, groups = (np.maximum(1, -(-x // y)) for x, y in ((pivots.data_rows, block_rows), (pivots.asks_rows, group_rows)))
    before = np.cumsum(blocks) - blocks
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values.tolist())), F.col(c) + 1)
    part = lambda parts, c, seed: F.pmod(F.xxhash64("row", F.lit(seed)), of(parts, c)).cast("int")
    data = dealt.select("row", "vec_id", "v", "cell", part(blocks, "cell", 1).alias("block"))
    asks = dealt.where("is_query").select("row", "vec_id", "v", "qcell", part(groups, "qcell", 2).alias("qgroup"))

    def search(data: DataFrame, asks: DataFrame, chunks: int) -> DataFrame:
        unit = (((of(before, "cell") + F.col("block")) * chunks + F.col("chunk")) % F.lit(TASKS)).cast("int").alias("unit")
        none = lambda kind: F.lit(None).cast(kind)
        both = data.select(unit, "cell", "block", "chunk", F.lit(False).alias("asks"), none("int").alias("qcell"), none("int").alias("qgroup"), "row", "vec_id", "v", none("double").alias("kth"))
        both = both.unionByName(asks.select(unit, "cell", "block", "chunk", F.lit(True).alias("asks"), "qcell", "qgroup", "row", "vec_id", "v", "kth"))
        both = both.repartitionById(min(int(blocks.sum()) * chunks, TASKS), "unit").sortWithinPartitions("cell", "block", "chunk", "asks", "qcell", "qgroup")
        return map_arrow(both, lambda batches: _searched(batches, k, m2, width), _FOUND_SCHEMA)

    # One block for each group to start from.
    first = pivots.first()
    start = written(search(data.where("block = 0").withColumn("chunk", F.lit(0)), asks.select("*", of(first, "qcell").cast("int").alias("cell"), F.lit(0).alias("block"), F.lit(0).alias("chunk"), F.lit(float("-inf")).alias("kth")), 1), "found")
    kth = start.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).cast("double").alias("kth"))
    asks = written(asks.join(kth, F.col("row") == F.col("query_row"), "left").select("row", "vec_id", "v", "qcell", "qgroup", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")), "asks")
    chunks = math.ceil(int(groups[pivots.asks_rows > 0].sum()) / GROUPS)
    pairs = written(surviving(asks, pivots, blocks, chunks), "pairs")
    wanted = pairs.select("cell", "block", "chunk").distinct()
    rest = search(data.join(wanted, ["cell", "block"]), asks.join(pairs, ["qcell", "qgroup"]), chunks)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return start.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def surviving(asks: DataFrame, pivots: Pivots, blocks: np.ndarray, chunks: int) -> DataFrame:
    """qcell, qgroup, chunk, cell, block: the blocks, but for that of the start, which may hold something for some query of the group."""
    first = pivots.first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qcell, qgroup, worst in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = pivots.open(qcell, worst)
                cell = np.repeat(cells, blocks[cells])
                block = np.arange(len(cell)) - np.repeat(np.cumsum(blocks[cells]) - blocks[cells], blocks[cells])
                fresh = (cell != first[qcell]) | (block != 0)
                cell, block = cell[fresh].astype(np.int32), block[fresh].astype(np.int32)
                same = np.ones(len(cell), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(qcell * same), pa.array(qgroup * same), pa.array((qcell * 7919 + qgroup) % chunks * same), pa.array(cell), pa.array(block)], names=["qcell", "qgroup", "chunk", "cell", "block"])

    worst = asks.groupBy("qcell", "qgroup").agg(F.min("kth").alias("worst"))
    return map_arrow(worst, run, "qcell int, qgroup int, chunk int, cell int, block int")


def _searched(batches: Iterator[pa.RecordBatch], k: int, m2: float, width: int) -> Iterator[pa.RecordBatch]:
    """What the groups of each block find there. Rows come by block, its data first, then its groups."""
    at, held, search = None, [], None

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal search
        if not held:
            return
        t = pa.Table.from_batches(held)
        row, x = t.column("row").to_numpy(), _matrix(t.column("v"), width)
        ids = t.column("vec_id").combine_chunks()
        if not at[3]:
            search = Search(row, ids.fill_null(_NO_ID).to_numpy(), x, k, m2)
            search.names = ids
        elif search is not None:
            scores, found = search.run(row, x, t.column("kth").to_numpy())
            n = [len(f) for f in found]
            if sum(n):
                again = pa.array(np.repeat(np.arange(len(row)), n))
                yield pa.RecordBatch.from_arrays([ids.take(again), pa.array(np.repeat(row, n)), *(t.column(c).combine_chunks().take(again) for c in ("qcell", "qgroup")), search.names.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], schema=_FOUND)

    for batch in batches:
        keys = [batch.column(c) for c in ("cell", "block", "chunk", "asks", "qcell", "qgroup")]
        new = np.zeros(batch.num_rows, bool)
        for c in keys:
            c = c.cast(pa.int32()).fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            key = tuple(c[lo].as_py() for c in keys)
            if key != at:
                yield from ended()
                if at is not None and key[:3] != at[:3]:
                    search = None
                at, held = key, []
            held.append(batch.slice(lo, hi - lo))
    yield from ended()
