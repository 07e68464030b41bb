"""Approximate nearest neighbours with learned partitions.

The k-nearest-neighbour graph of a bounded sample is cut into equally large partitions with few edges between them. A
small classifier (multinomial logistic regression) learns, from the partitions of each sample row's neighbours, how
probable it is that a vector's neighbours lie in a partition. Every row of the table is indexed under its most
probable partition; a query searches its several most probable ones and ranks their rows by exact distance. How many
is calibrated on held-out rows of the sample, whose neighbours in the sample are farther away, so harder to find,
than those in the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordaudit.llm.hashing import lean
from recordaudit.llm.vectors import block_rows, finite, matrix, packed, parts, usable
from recordaudit.session import ship, written

NEIGHBOURS = 10
#: The bound of the fitted sample, in rows and in components.
SAMPLE_ROWS = 16_384
SAMPLE_VALUES = 1 << 21
#: Rows of the sample that calibrate the number of searched partitions, and are not fitted on.
HELD_OUT = 1_024
#: Partitions: at most so many, of at least so many fitted rows each.
PARTITIONS = 64
PARTITION_ROWS = 128
#: Edges of a sample row in the neighbour graph.
EDGES = 10
#: How much a partition may exceed an equal share of the sample.
SLACK = 1.1
#: Share of the held-out rows' neighbours that the searched partitions hold.
RECALL = 0.95
#: Most queries and rows of a cell that one task compares.
CELL_QUERIES = 1_024
CELL_ROWS = 32_768

FOUND = "query_key long, query_id long, id long, score double"


@dataclass
class Router:
    """The fitted classifier (a weight per component and partition) and the number of partitions to search."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """A monotone image of each partition's probability; directions are classified, whatever the vectors' lengths."""
        return directions(vectors) @ self.weights + self.bias


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; first divided by the largest component, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places of the k nearest rows of each query; ``own`` has the row to leave out."""
    out, size = [], (rows ** 2).sum(axis=1)
    for a in range(0, len(queries), 512):
        gap = size[None] - 2 * queries[a:a + 512] @ rows.T
        if own is not None:
            gap[np.arange(len(gap)), own[a:a + 512]] = np.inf
        out.append(np.argpartition(gap, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _deal(votes: np.ndarray, most: int) -> np.ndarray:
    """The partition with most votes for every row, at most ``most`` rows each: the surest first, the others go to their next choice."""
    votes, n = votes.copy(), len(votes)
    dealt, left, room = np.full(n, -1), np.arange(n), np.full(votes.shape[1], most)
    while len(left):
        choice = votes[left].argmax(axis=1)
        sure = votes[left, choice]
        order = np.lexsort((-sure, choice))
        place = np.arange(len(left)) - np.searchsorted(choice[order], choice[order])  # rank among those with the same choice
        taken = order[place < room[choice[order]]]
        dealt[left[taken]] = choice[taken]
        room -= np.bincount(choice[taken], minlength=len(room))
        votes[:, room == 0] = -np.inf
        left = left[dealt[left] < 0]
    return dealt


def cut_graph(rows: np.ndarray, edges: np.ndarray, count: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Partitions of the graph's rows, at most ``SLACK`` equal shares large, with most edges inside.

    Rows start with the nearest of ``count`` random ones and then go, all at once, where most of their neighbours and
    their neighbours' neighbours are, as far as there is room, until few change.
    """
    draw = np.random.default_rng(seed)
    n, k = edges.shape
    most = int(np.ceil(SLACK * n / count))
    where = _deal(rows @ rows[draw.choice(n, count, replace=False)].T, most)
    start, end = np.repeat(np.arange(n), k), edges.ravel()
    both, other = np.concatenate([start, end]), np.concatenate([end, start])
    order = np.argsort(both, kind="stable")
    both, other = both[order], other[order]
    first = np.searchsorted(both, np.arange(n))  # every row has edges of its own
    degree = np.bincount(both, minlength=n)[:, None]
    for _ in range(rounds):
        own = np.zeros((n, count))
        np.add.at(own, (both, where[other]), 1.0)
        share = own / degree
        new = _deal(own + np.add.reduceat(share[other], first), most)
        changed = np.count_nonzero(new != where)
        where = new
        if changed * 1000 <= n:
            break
    return where


def _edges(spark: SparkSession, rows: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other sample rows of each; the search runs in tasks, the bounded sample is shipped to them."""
    shipped, n = spark.sparkContext.broadcast(rows), len(rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(0))
            found = nearest(shipped.value[at], shipped.value, k, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.list_(pa.int32()))], ["id", "near"])

    found = spark.range(0, n, 1, parts(spark, n, 4096)).mapInArrow(lean(search), "id long, near array<int>").collect()
    edges = np.empty((n, k), np.int64)
    for r in found:
        edges[r["id"]] = r["near"]
    return edges


def fit(spark: SparkSession, sample: np.ndarray, neighbours: int = NEIGHBOURS, partitions: int = PARTITIONS, recall: float = RECALL,
        seed: int = 1) -> Router:
    """A router fitted on sample vectors (none zero, no two equal)."""
    dims = sample.shape[1]
    unit = directions(sample)
    held = min(HELD_OUT, len(unit) // 8)
    fitted, waiting = unit[held:], unit[:held]
    count = min(partitions, len(fitted) // PARTITION_ROWS)
    if count < 2 or not held:
        return Router(np.zeros((dims, 1)), np.zeros(1), 1)
    edges = _edges(spark, fitted, min(EDGES, len(fitted) - 1))
    where = cut_graph(fitted, edges, count, seed)
    # A row stands for itself and its neighbours: each is one example of the partition it lies in.
    goals = np.concatenate([where[:, None], where[edges]], axis=1)
    goals.sort(axis=1)
    shipped = spark.sparkContext.broadcast((fitted, goals))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, aims = shipped.value
        for batch in batches:
            at = np.asarray(batch.column(0))
            aim = aims[at]
            new = np.concatenate([np.ones((len(at), 1), bool), aim[:, 1:] != aim[:, :-1]], axis=1)
            starts = np.flatnonzero(new.ravel())
            weight = np.diff(np.append(starts, aim.size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[at[starts // aim.shape[1]]].tolist(), pa.list_(pa.float64())), pa.array(aim.ravel()[starts].astype(float)),
                 pa.array(weight.astype(float))], ["vector", "label", "weight"])

    rows = written(spark.range(0, len(fitted), 1, parts(spark, len(fitted), 4096)).mapInArrow(
        lean(examples), "vector array<double>, label double, weight double"))
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", standardization=False,
                               regParam=1e-5, maxIter=60).fit(rows.select(array_to_vector("vector").alias("features"), "label", "weight"))
    weights, bias = model.coefficientMatrix.toArray().T, model.interceptVector.toArray()
    # Partitions as the index will have them, and the places of those that the held-out rows' neighbours are in.
    router = Router(weights, bias, 1)
    there = router.scores(fitted).argmax(axis=1)[nearest(waiting, fitted, min(neighbours, len(fitted)))]
    order = np.argsort(-router.scores(waiting), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    caught = np.sort(np.take_along_axis(place, there, axis=1).ravel())
    router.probes = int(caught[min(len(caught) - 1, int(np.ceil(recall * len(caught))) - 1)]) + 1
    return router


def _sample(rows: DataFrame, n: int, dims: int, seed: int) -> np.ndarray:
    """A bounded sample of different vectors, by hash: the same rows give the same sample."""
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dims))
    spot = F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30))
    share = int((1 << 30) * min(1.0, 1.2 * bound / n))
    drawn = rows.select("vector", spot.alias("spot")).filter(F.col("spot") < share).distinct().orderBy("spot", "vector").limit(bound).toArrow()
    return matrix(drawn["vector"], dims)


def _index(rows: DataFrame, router: Router, dims: int) -> DataFrame:
    """(part, n, ids, vectors): rows in blocks of one partition each."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = block_rows(dims)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(part: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(part)))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([packed(vectors)], pa.binary())], ["part", "n", "ids", "vectors"])

        waiting = 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                own = batch.slice(a, most)
                ids, vectors = np.asarray(own.column(0)), matrix(own.column(1), dims)
                of = router.scores(vectors).argmax(axis=1)
                for part in np.unique(of).tolist():
                    held.setdefault(part, []).append((ids[of == part], vectors[of == part]))
                    if sum(len(x) for x, _ in held[part]) >= most:
                        waiting -= sum(len(x) for x, _ in held[part][:-1])
                        yield block(part)
                    else:
                        waiting += len(held[part][-1][0])
                if waiting >= 8 * most:  # bounded memory however many partitions wait
                    for part in sorted(held):
                        yield block(part)
                    waiting = 0
        for part in sorted(held):
            yield block(part)

    return rows.select("id", "vector").mapInArrow(lean(assign), "part int, n long, ids array<long>, vectors binary")


def _routed(queries: DataFrame, router: Router, sizes: np.ndarray, dims: int, k: int) -> DataFrame:
    """(query_key, id, vector, part): each query with its most probable partitions, further ones until they hold k other rows."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-router.scores(matrix(batch.column(2), dims)), axis=1, kind="stable")
            reach = np.cumsum(sizes[order], axis=1)
            enough = np.maximum(router.probes, (reach < k + 1).sum(axis=1) + 1)
            chosen = [o[:e].tolist() for o, e in zip(order, enough)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], ["query_key", "id", "vector", "probed"])

    routed = queries.select("query_key", "id", "vector").mapInArrow(lean(route), "query_key long, id long, vector array<double>, probed array<int>")
    return routed.withColumn("part", F.explode("probed")).drop("probed")


def distance(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added dimension by dimension."""
    total = np.zeros(len(rows))
    with np.errstate(over="ignore"):
        for d in range(rows.shape[1]):
            total += (rows[:, d] - query[d]) ** 2
    return np.sqrt(total)


def closest(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, size: np.ndarray, k: int) -> list[tuple[int, float]]:
    """(id, distance) of the k nearest rows with another id, ties by smaller id.

    Inner products choose the rows that can be among them, the distance itself decides.
    """
    rows = np.flatnonzero(ids != own)
    if not len(rows):
        return []
    with np.errstate(over="ignore", invalid="ignore"):
        gap = (size - 2 * (vectors @ query))[rows]
        slack = 1e-9 * (2 * size.max() + query @ query)
        if len(rows) > k and np.isfinite(gap).all() and np.isfinite(slack):
            rows = rows[gap <= np.partition(gap, k - 1)[k - 1] + slack]
    score = distance(query, vectors[rows])
    order = np.lexsort((ids[rows], score))[:k]
    return [(int(ids[rows[i]]), float(score[i])) for i in order]


def _compared(routed: DataFrame, index: DataFrame, of_part: dict[int, tuple[int, int]], dims: int, k: int) -> DataFrame:
    """The k nearest rows of every query in each cell: one group of a partition's queries, one shard of its rows."""
    last = max(of_part) + 1
    groups, shards = (F.element_at(F.array(*[F.lit(of_part.get(p, (1, 1))[i]) for p in range(last)]), F.col("part") + 1) for i in (0, 1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = routed.withColumn("group", F.pmod(F.xxhash64("query_key"), groups).cast("int")).withColumn("shard", every(shards))
    right = index.withColumn("shard", F.pmod(F.xxhash64("ids"), shards).cast("int")).withColumn("group", every(groups))

    def cell(own: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and there.num_rows:
            ids = np.asarray(there["ids"].combine_chunks().flatten())
            vectors = np.frombuffer(b"".join(there["vectors"].to_pylist())).reshape(-1, dims)
            with np.errstate(over="ignore"):
                size = (vectors ** 2).sum(axis=1)
            for key, query_id, query in zip(own["query_key"].to_pylist(), own["id"].to_pylist(), matrix(own["vector"], dims)):
                out += [(key, query_id, *found) for found in closest(query, query_id, ids, vectors, size, k)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                                    names=["query_key", "query_id", "id", "score"])

    keys = ("part", "group", "shard")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, FOUND)


def search(rows: DataFrame, query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
           recall: float = RECALL, partitions: int = PARTITIONS, seed: int = 1) -> DataFrame:
    """(query_id, rank, neighbour_id, score): about the k nearest other rows of every ``query`` row, nearest first.

    ``score`` is the Euclidean distance of the original vectors in doubles; ties go to the smaller id. All rows are indexed
    and every query gets k rows, or all others if there are fewer. Rows with a null id, rows whose vector is null, zero or
    holds null or non-finite components, and vectors of another length than the most common take no part. A query never
    finds a row with its own id; rows that repeat an id are searched and found one by one. Equal vectors lie in one
    partition, which is split over tasks by its size. Distances beyond a double are infinite. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                        F.coalesce(query, F.lit(False)).alias("is_query"))
    holds = F.col("id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0)
    given, n, dims = usable(given, "vector", holds)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, score double")
    router = fit(spark, _sample(given, n, dims, seed), k, partitions, recall, seed)
    index = written(_index(given.repartition(parts(spark, n, block_rows(dims))), router, dims))
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row per partition
    sizes = np.array([held.get(p, 0) for p in range(len(router.bias))])
    queries = given.filter("is_query").withColumn("query_key", F.monotonically_increasing_id())
    routed = written(_routed(queries, router, sizes, dims, k))
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    of_part = {p: (-(-asked.get(p, 1) // CELL_QUERIES), -(-held[p] // CELL_ROWS)) for p in held}
    found = _compared(routed, index, of_part, dims, k)
    order = Window.partitionBy("query_key").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("neighbour_id"), "score")
