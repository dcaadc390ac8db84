"""Approximate nearest neighbours: vantage-point trees per shard.

Nearness is the largest inner product. One more component turns that into a metric: with M the
largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), so the Euclidean distance
is sqrt(|q|^2 + M^2 - 2 q.x), which falls as the inner product grows.

Rows are dealt by nearness into cells, each around one of at most MAX_CELLS vantage points drawn from the
rows, and a cell that is large into shards by hash, so a shard has a bounded size. A query goes to its
nearest cell first. Its k-th best there is a bound that travels with it: by the triangle inequality a cell
with vantage point v and radius r holds nothing better unless |q - v| - r is below that bound's distance,
and the query goes only to the cells that are left open. In a shard a task builds the vantage-point tree
and takes one block of queries down it together: at a node the side nearer to a query comes first, the
other only where the triangle inequality says that it may hold something nearer than the query's k-th
best. `factor` divides that distance, for cells and nodes alike: 1 is exact search, more prunes more.

Equal vectors are one point of the index with their k + 1 smallest ids, which is all that any answer
can show of them, so a hot vector weighs as much as another; equal query vectors are searched once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without id; vectors of other lengths than the query's are no candidates; ties go
to the smaller id; rows of one id and one vector count once; all rows with the query's own id are left
out; an empty table gives no rows; only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import map_batches, schema_of, settle

#: Points of a shard and queries of a block, about; points of a leaf; cells, which bounds what goes to every task.
SHARD_ROWS, BLOCK_QUERIES, LEAF, MAX_CELLS = 4096, 4096, 128, 1024


class Tree:
    """Vantage-point tree over the rows of a matrix; nodes are (vantage, low, high, near, far) or leaves."""

    def __init__(self, points: np.ndarray, norm: float, seed: int = 0) -> None:
        self.points, self.norm2 = points, norm * norm
        self.lift = np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", points, points), 0.0))
        self.random = np.random.default_rng(seed)
        self.root = self.build(np.arange(len(points)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return np.sort(rows)
        v = rows[self.random.integers(len(rows))]
        dots = self.points[rows] @ self.points[v] + self.lift[rows] * self.lift[v]
        distance = np.sqrt(np.maximum(2 * (self.norm2 - dots), 0.0))
        order = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return v, float(distance[near[-1]]), float(distance[far[0]]), self.build(rows[near]), self.build(rows[far])

    def search(self, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows), both queries x k, best first, smaller row first on ties; row -1 where there are fewer.

        least: scores that each query has k of elsewhere; what is worse need not be found.
        """
        self.queries, self.factor, self.k = queries, factor, k
        self.square = np.einsum("ij,ij->i", queries, queries)
        self.scores = np.full((len(queries), k), -np.inf)
        if least is not None:  # a little lower, so that what ties with it is found
            self.scores[:] = (least - 1e-9 * (1 + np.abs(least)))[:, None]
        self.found = np.full((len(queries), k), -1, dtype=np.int64)
        self.visit(self.root, np.arange(len(queries)))
        return self.scores, self.found

    def radius(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[q] + self.norm2 - 2 * self.scores[q, -1], 0.0)) / self.factor

    def visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self.scan(node, q)
            return
        v, low, high, near, far = node
        distance = np.sqrt(np.maximum(self.square[q] + self.norm2 - 2 * (self.queries[q] @ self.points[v]), 0.0))
        inside = distance < (low + high) / 2
        for mine, first, second in ((inside, near, far), (~inside, far, near)):
            own, d = q[mine], distance[mine]
            self.visit(first, own)
            gap = high - d if second is far else d - low
            slack = 1e-9 * (1 + d)
            self.visit(second, own[gap <= self.radius(own) + slack])

    def scan(self, rows: np.ndarray, q: np.ndarray) -> None:
        dots = self.queries[q] @ self.points[rows].T
        better = (dots >= self.scores[q, -1][:, None]).any(axis=1)
        q, dots = q[better], dots[better]
        if not len(q):
            return
        scores = np.concatenate([self.scores[q], dots], axis=1)
        found = np.concatenate([self.found[q], np.broadcast_to(rows, dots.shape)], axis=1)
        order = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[q], self.found[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _search_shard(k: int, factor: float, norm: float):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["_q1", "_q2", "score", "ids"]
        if not points.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.int64()))], names=names)
        points = points.sort_by([("first_id", "ascending"), ("_k1", "ascending")])
        x, q = _matrix(points.column("vector")), _matrix(queries.column("vector"))
        least = queries.column("_least").to_numpy().astype(np.float64)
        scores, found = Tree(x, norm).search(q, k, factor, np.where(np.isnan(least), -np.inf, least))
        at, place = np.nonzero(found >= 0)
        row = found[at, place]
        exact = np.einsum("ij,ij->i", q[at], x[row])
        index = pa.array(at)
        return pa.table([queries.column("_k1").combine_chunks().take(index), queries.column("_k2").combine_chunks().take(index), pa.array(exact), points.column("ids").combine_chunks().take(pa.array(row))], names=names)

    return run


class Cells:
    """Vantage points of the cells; rows of a length that none of them has are in cell -1."""

    def __init__(self, vectors: list[np.ndarray], norm: float) -> None:
        self.norm2, self.of = norm * norm, {}
        for length in sorted({len(v) for v in vectors}):
            own = [i for i, v in enumerate(vectors) if len(v) == length]
            x = np.stack([vectors[i] for i in own])
            self.of[length] = np.array(own), x, np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", x, x), 0.0))

    def distances(self, x: np.ndarray, point: bool) -> tuple[np.ndarray, np.ndarray]:
        """(cells, distances rows x cells) of rows of one length, lifted as points or as queries."""
        cells, v, lift = self.of.get(x.shape[1], (np.zeros(0, np.int64), np.zeros((0, x.shape[1])), np.zeros(0)))
        square = np.einsum("ij,ij->i", x, x)
        dots = x @ v.T
        if point:
            dots += np.sqrt(np.maximum(self.norm2 - square, 0.0))[:, None] * lift
            square = np.full(len(x), self.norm2)
        return cells, np.sqrt(np.maximum(square[:, None] + self.norm2 - 2 * dots, 0.0))


def _by_length(batch: pa.RecordBatch):
    """(rows, matrix) for each length of vector in a batch."""
    length = batch.column("_dim").to_numpy()
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        yield at, _matrix(pa.chunked_array([batch.column("vector").take(pa.array(at))]))


def _home_cells(cells: Cells, point: bool):
    def rows(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        home, reach = np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows)
        for at, x in _by_length(batch):
            names, distance = cells.distances(x, point)
            if len(names):
                best = distance.argmin(axis=1)
                home[at], reach[at] = names[best], distance[np.arange(len(at)), best]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(reach)], names=[*batch.schema.names, "_cell", "_reach"])

    return rows


def _open_cells(cells: Cells, radii: dict[int, float], norm: float, factor: float):
    """A row for each query and cell, but for its home, that may hold something better than its bound."""

    def rows(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        home, least = batch.column("_cell").to_numpy(), batch.column("_least").to_numpy(zero_copy_only=False).astype(np.float64)
        for at, x in _by_length(batch):
            names, distance = cells.distances(x, point=False)
            square = np.einsum("ij,ij->i", x, x)
            bound = np.where(np.isnan(least[at]), np.inf, np.sqrt(np.maximum(square + norm * norm - 2 * np.nan_to_num(least[at]), 0.0)) / factor)
            reach = np.array([radii.get(int(c), -np.inf) for c in names])
            row, column = np.nonzero((distance - reach <= bound[:, None] + 1e-9 * (1 + distance)) & (names[None, :] != home[at][:, None]) & np.isfinite(reach))
            if len(row):
                part = batch.take(pa.array(at[row]))
                yield part.set_column(batch.schema.get_field_index("_cell"), "_cell", pa.array(names[column].astype(np.int32)))

    return rows


def usable(vector: str) -> Column:
    """True for vectors that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int, factor: float, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), <id_column>, score: the k nearest found of every query row."""
    plain = rows.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{vector}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("_ask"))
    sound = plain.where(F.col("_id").isNotNull() & usable("vector")).select("*", F.xxhash64(F.lit("a"), "vector").alias("_k1"), F.xxhash64(F.lit("b"), "vector").alias("_k2"))
    first_ids = Window.partitionBy("_k1", "_k2").orderBy("_id")
    fewest = sound.select("_k1", "_k2", "_id").distinct().withColumn("_at", F.row_number().over(first_ids)).where(F.col("_at") <= k + 1)
    listed = settle(fewest.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list("_id")).alias("ids")), "ids")
    vectors = sound.groupBy("_k1", "_k2").agg(F.first("vector").alias("vector"))
    points = settle(vectors.join(listed, ["_k1", "_k2"]).withColumn("first_id", F.col("ids")[0]).withColumn("_dim", F.size("vector")), "points")
    asked = sound.where("_ask").select("_k1", "_k2", F.col("_id").alias("query_id")).distinct()
    queries = settle(points.drop("ids", "first_id").join(asked.select("_k1", "_k2").distinct(), ["_k1", "_k2"]), "queries")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    size = points.agg(F.count("*").alias("n"), F.max(square).alias("square")).first()
    norm = float(np.sqrt(size["square"] or 0.0)) * (1 + 1e-12)
    count = int(min(MAX_CELLS, max(1, size["n"] // SHARD_ROWS)))
    drawn = points.orderBy("_k2", "_k1").limit(count).select("vector").toArrow().column("vector") if size["n"] else pa.chunked_array([pa.array([], pa.list_(pa.float64()))])
    cells = Cells([np.array(v.as_py(), dtype=np.float64) for v in drawn], norm)
    placed = settle(map_batches(points, _home_cells(cells, True), schema_of(points, ("_cell", "int"), ("_reach", "double"))), "placed")
    asking = settle(map_batches(queries, _home_cells(cells, False), schema_of(queries, ("_cell", "int"), ("_reach", "double"))).drop("_reach"), "asking")
    held = {r["_cell"]: r for r in placed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_reach").alias("reach")).collect()}  # one row per cell

    def number_of(rows: dict[int, int], each: int) -> Column:
        parts = [x for c, n in rows.items() for x in (F.lit(c), F.lit(max(1, -(-n // each))))]
        return F.coalesce(F.try_element_at(F.create_map(*parts), F.col("_cell")), F.lit(1)) if parts else F.lit(1)

    shards = number_of({c: r["n"] for c, r in held.items()}, SHARD_ROWS)

    def met(left: DataFrame) -> DataFrame:
        """The best of each query in the cells that its rows name."""
        asked_in = {r["_cell"]: r["n"] for r in left.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
        blocks = number_of(asked_in, BLOCK_QUERIES)
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        shard, block = F.pmod("_k2", shards).cast("int"), F.pmod("_k2", blocks).cast("int")
        visited = placed.where(F.col("_cell").isin(list(asked_in))) if asked_in else placed.limit(0)
        key = ["_dim", "_cell", "_shard", "_block"]
        mine = visited.withColumn("_shard", shard).withColumn("_block", every(blocks)).groupBy(*key)
        theirs = left.withColumn("_block", block).withColumn("_shard", every(shards)).groupBy(*key)
        return settle(mine.cogroup(theirs).applyInArrow(_search_shard(k + 1, factor, norm), "_q1 long, _q2 long, score double, ids array<bigint>"), "met")

    best = Window.partitionBy("_q1", "_q2").orderBy(F.col("score").desc(), F.col("ids")[0])
    ranked = lambda rows: rows.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k + 1)
    at_home = met(asking.withColumn("_least", F.lit(None).cast("double")))
    found = ranked(at_home)
    if len(held) > 1:
        bound = found.where(F.col("_at") == k + 1).select(F.col("_q1").alias("_k1"), F.col("_q2").alias("_k2"), F.col("score").alias("_least"))
        bounded = asking.join(bound, ["_k1", "_k2"], "left")
        radii = {c: r["reach"] for c, r in held.items()}
        abroad = settle(map_batches(bounded, _open_cells(cells, radii, norm, factor), bounded.schema), "open")
        found = ranked(at_home.unionByName(met(abroad)))
    classes = found
    each = classes.select("_q1", "_q2", "score", F.explode("ids").alias("_id"))
    ordered = Window.partitionBy("_q1", "_q2").orderBy(F.col("score").desc(), "_id")
    kept = each.withColumn("_at", F.row_number().over(ordered)).where(F.col("_at") <= k + 1)
    answer = kept.groupBy("_q1", "_q2").agg(F.array_sort(F.collect_list(F.struct("_at", "_id", "score"))).alias("_best"))
    joined = asked.join(answer, (asked["_k1"] == answer["_q1"]) & (asked["_k2"] == answer["_q2"]))
    others = F.slice(F.filter("_best", lambda b: b["_id"] != F.col("query_id")), 1, k)
    out = joined.select("query_id", F.posexplode(others).alias("_at", "_b"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_b._id").alias(id_column), F.col("_b.score").alias("score"))
