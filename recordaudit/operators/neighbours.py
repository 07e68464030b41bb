"""Exact nearest neighbours between two tables of points.

The points are cut into boxes by trees of axis splits learnt from a sample: one tree for up to
``REGIONS`` boxes; beyond that its leaves are regions, and every region is split into boxes by a
tree of its own, kept as rows of a table. Every query first searches the box it falls in; the
distance found there rules out most other boxes, and the query visits only those whose nearest
corner is not farther. The answer does not depend on the sample, only the work does. Work is done
in groups of at most a few thousand points and queries: large boxes are cut into chunks, and boxes
asked by many queries are repeated. The driver holds regions, never boxes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from recordaudit.session import written

#: Leaves of the first tree. More boxes than its square make it grow with their square root.
REGIONS = 4096
SAMPLE_PER_BOX = 16
GROUP_ROWS = 2048
#: Boxes are cut by a sample, so about half hold more than ``GROUP_ROWS``; a group may have this many times as much before
#: its points are cut into chunks (which copies the queries) or its queries are dealt out (which copies the points).
GROUP_SLACK = 2
#: Rows of one region that are placed, or compared with its boxes' edges, in one task.
REGION_ROWS = 65536
CELLS_AT_ONCE = 2_000_000
#: Squares of one block of queries and a group's points, few enough for a core's cache.
BLOCK_CELLS = 1 << 17
DIGITS = 9
#: Error of a square taken from a matrix product, as a share of both lengths; rounding alone stays under (features + 4) * 2.3e-16.
SLACK = 1e-12


NODE = "axis int, cut double, low int, high int, box int, depth int"


class SplitTree:
    """Axis splits as arrays; ``place`` finds the box number of many points at once."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.axis, self.cut, self.low, self.high, self.box = [], [], [], [], []
        self.count = 0
        self.depth = 0
        self._grow(sample, boxes, 0)
        for name in ("axis", "cut", "low", "high", "box"):
            setattr(self, name, np.array(getattr(self, name)))

    def _grow(self, rows: np.ndarray, boxes: int, depth: int) -> int:
        node = len(self.axis)
        self.depth = max(self.depth, depth)
        for column, empty in ((self.axis, 0), (self.cut, 0.0), (self.low, node), (self.high, node), (self.box, -1)):
            column.append(empty)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        axis = int(np.argmax(spread))
        if boxes > 1 and spread[axis] > 0:
            cut = float(np.median(rows[:, axis]))
            below = rows[:, axis] < cut
            if not below.any():  # the median is the smallest value
                cut = float(rows[rows[:, axis] > cut, axis].min())
                below = rows[:, axis] < cut
            self.axis[node], self.cut[node] = axis, cut
            self.low[node] = self._grow(rows[below], boxes // 2, depth + 1)
            self.high[node] = self._grow(rows[~below], boxes - boxes // 2, depth + 1)
        else:
            self.box[node] = self.count
            self.count += 1
        return node

    def nodes(self) -> pd.DataFrame:
        """The tree as rows, numbered by ``node``."""
        return pd.DataFrame({"node": range(len(self.axis)), "axis": self.axis, "cut": self.cut, "low": self.low,
                             "high": self.high, "box": self.box, "depth": self.depth})

    @classmethod
    def of(cls, nodes: pd.DataFrame) -> SplitTree:
        """The tree that ``nodes`` gave."""
        tree = cls.__new__(cls)
        nodes = nodes.sort_values("node")
        for name in ("axis", "cut", "low", "high", "box"):
            setattr(tree, name, nodes[name].to_numpy())
        tree.depth = int(nodes["depth"].iloc[0])
        return tree

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=int)
        each = np.arange(len(points))
        for _ in range(self.depth):
            below = points[each, self.axis[node]] < self.cut[node]
            node = np.where(below, self.low[node], self.high[node])
        return self.box[node]


def _in_regions(rows: DataFrame, table: DataFrame, key: str, work, schema: str) -> DataFrame:
    """``work`` on the (written) rows of every region, in chunks of about ``REGION_ROWS``, with the region's rows of ``table``."""
    chunks = written(rows.groupBy("region").agg(F.ceil(F.count("*") / REGION_ROWS).cast("int").alias("chunks")))
    left = rows.join(chunks, "region").withColumn("chunk", F.pmod(F.xxhash64(key), "chunks").cast("int")).drop("chunks")
    right = table.join(chunks, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return left.groupBy("region", "chunk").cogroup(right.groupBy("region", "chunk")).applyInPandas(work, schema)


def _with_box(df: DataFrame, key: str, features: list[str], tree: SplitTree, trees: DataFrame | None) -> DataFrame:
    """Adds ``region``, the leaf of the first tree, and ``box``, the leaf of the region's own tree (0 without one)."""
    @F.pandas_udf("int")
    def place(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.place(rows.to_numpy(dtype=float)).astype("int32"))

    rows = df.withColumn("region", F.coalesce(place(F.struct(*features)), F.lit(0)))
    if trees is None:
        return rows.withColumn("box", F.lit(0))

    def inside(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        rows = rows[[key, *features, "region"]].copy()
        rows["box"] = SplitTree.of(nodes).place(rows[features].to_numpy(dtype=float)) if len(nodes) and len(rows) else 0
        return rows

    return _in_regions(written(rows), trees, key, inside, f"{_schema(key, features)}, region int, box int")


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rounded distances, features on the last axis; the others are matched as numpy does."""
    square = np.zeros(np.broadcast_shapes(queries.shape[:-1], points.shape[:-1]))
    for axis in range(points.shape[-1]):
        square += (queries[..., axis] - points[..., axis]) ** 2
    return np.round(np.sqrt(square), DIGITS)


def _in_question(block: np.ndarray, points: np.ndarray, length: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of queries and points that may be among the k closest, ties after rounding included.

    Squares come from one matrix product, |q|² + |p|² - 2qp, and are off by less than ``slack``; so are the limits.
    """
    mine = np.einsum("ij,ij->i", block, block)
    square = block @ (-2.0 * points.T)
    square += length
    square += mine[:, None]
    slack = SLACK * (mine + length.max())
    if own is not None:
        here = np.flatnonzero(own >= 0)
        square[here, own[here]] = np.inf
    k = min(k, len(points))
    limit = square.min(axis=1) if k == 1 else np.partition(square, k - 1, axis=1)[:, k - 1]
    reach = (np.sqrt(np.maximum(limit + slack, 0)) + 2 * 10.0 ** -DIGITS) ** 2 + slack
    q, p = np.divmod(np.flatnonzero(square <= reach[:, None]), len(points))
    known = np.isfinite(square[q, p])  # all but a query's own point
    return q[known], p[known]


def _closest(queries: np.ndarray, points: np.ndarray, k: int, own: np.ndarray | None):
    """Row numbers of queries and points and distances of the k closest points per query.

    Points are in key order, so ties fall to the smaller key. Pairs that can't be an answer are ruled out by bounds;
    the distances of the others are computed term by term.
    """
    found = []
    step = max(1, BLOCK_CELLS // max(1, len(points)))
    middle = points.mean(axis=0)
    near_points, near_queries = points - middle, queries - middle
    length = np.einsum("ij,ij->i", near_points, near_points)
    bounded = np.isfinite(length).all() and np.isfinite(np.einsum("ij,ij->i", near_queries, near_queries)).all()
    for start in range(0, len(queries), step):
        block = queries[start:start + step]
        mine = None if own is None else own[start:start + step]
        if bounded:
            q, p = _in_question(near_queries[start:start + step], near_points, length, k, mine)
        else:  # infinite or unknown values leave no bounds
            full = _distances(block[:, None], points[None])
            if mine is not None:
                here = np.flatnonzero(mine >= 0)
                full[here, mine[here]] = np.inf
            last = min(k, len(points)) - 1
            q, p = np.nonzero((full <= np.partition(full, last, axis=1)[:, last, None]) & np.isfinite(full))
        distance = _distances(block[q], points[p])
        known = np.isfinite(distance)
        q, p, distance = q[known], p[known], distance[known]
        order = np.lexsort((p, distance, q))
        q, p, distance = q[order], p[order], distance[order]
        position = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = position < k
        found.append((q[keep] + start, p[keep], distance[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _parts(rows: str):
    """Number of groups that ``rows`` rows of one box are dealt to."""
    return F.ceil(F.col(rows) / (GROUP_SLACK * GROUP_ROWS)).cast("int")


def _search(asked: DataFrame, index: BoxIndex, k: int, exclude_self: bool, carry: list[str], schema: str, answer) -> DataFrame:
    """What ``answer`` makes of the k closest points in every asked box chunk.

    ``answer`` gets a chunk's queries (key, features, region, box, chunks and ``carry``) with the row numbers of queries,
    neighbours and distances that were found. A box without points is one chunk in which nothing is found.
    """
    key, features, box = index.key, index.features, ["region", "box"]
    plan = written(asked.groupBy(*box).agg(F.count("*").alias("asked")).join(
        index.edges.select(*box, "n"), box, "left").select(
            *box, _parts("asked").alias("repeats"), F.coalesce(_parts("n"), F.lit(1)).alias("chunks")))

    def numbers(name):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    left = asked.join(plan, box).withColumn(
        "repeat", F.pmod(F.xxhash64(key), "repeats").cast("int")).withColumn("chunk", numbers("chunks"))
    right = index.placed.join(plan, box).withColumn(
        "chunk", F.pmod(F.xxhash64(key), "chunks").cast("int")).withColumn("repeat", numbers("repeats"))
    group = [*box, "chunk", "repeat"]

    def closest(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        q, neighbours, distance = np.zeros(0, dtype=int), np.zeros(0, dtype=object), np.zeros(0)
        if len(queries) and len(points):
            points = points.sort_values(key, ignore_index=True)
            own = pd.Index(points[key]).get_indexer(queries[key]) if exclude_self else None
            q, p, distance = _closest(queries[features].to_numpy(dtype=float),
                                      points[features].to_numpy(dtype=float), k, own)
            neighbours = points[key].to_numpy()[p]
        return answer(queries, q, neighbours, distance)

    return (
        left.select(*group, key, *features, "chunks", *carry).groupBy(*group)
        .cogroup(right.select(*group, key, *features).groupBy(*group))
        .applyInPandas(closest, schema)
    )


def _at_home(queries: DataFrame, index: BoxIndex, k: int, exclude_self: bool) -> DataFrame:
    """The (placed) queries with ``best``, what they find in their own box, and ``reach``, the k-th distance (null: fewer found).

    A query comes out of its task as it is, with its features; only those of boxes with several chunks are put together.
    """
    key, features = index.key, index.features
    columns = [key, *features, "region", "box"]

    def answer(rows: pd.DataFrame, q, neighbours, distance) -> pd.DataFrame:
        ends = np.searchsorted(q, np.arange(len(rows)), side="right")
        starts = np.concatenate([[0], ends])[:len(rows)]
        return rows[[*columns, "chunks"]].assign(
            distances=[distance[a:b] for a, b in zip(starts, ends)], neighbours=[neighbours[a:b] for a, b in zip(starts, ends)])

    schema = f"{_schema(key, features)}, region int, box int, chunks int, distances array<double>, neighbours array<string>"
    found = written(_search(queries, index, k, exclude_self, [], schema, answer))
    one = found.select(*columns, "chunks", F.arrays_zip(F.col("distances").alias("distance"), F.col("neighbours").alias("neighbour")).alias("best"))
    many = one.where("chunks > 1").groupBy(*columns).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    best = one.where("chunks = 1").drop("chunks").unionByName(many)
    return best.withColumn("reach", F.when(F.size("best") >= k, F.element_at("best", k)["distance"]))


def _improved(asked: DataFrame, index: BoxIndex, k: int, exclude_self: bool) -> DataFrame:
    """(key, neighbour, distance) of the points in the asked boxes that may be among the k closest: within the query's ``reach``."""
    key = index.key

    def answer(rows: pd.DataFrame, q, neighbours, distance) -> pd.DataFrame:
        near = distance <= rows["reach"].fillna(np.inf).to_numpy(dtype=float)[q]
        return pd.DataFrame({key: rows[key].to_numpy()[q[near]], "neighbour": neighbours[near], "distance": distance[near]}).astype(
            {key: object, "neighbour": object, "distance": float})

    return _search(asked, index, k, exclude_self, ["reach"], f"{key} string, neighbour string, distance double", answer)


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    """Keep the k best per query, of its own box's and those that other boxes gave within reach."""
    entry = F.struct("distance", "neighbour")
    if k == 1:
        return found.groupBy(key).agg(F.array(F.min(entry)).alias("best"))
    return found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))


def _distinct_points(points: DataFrame, key: str, features: list[str], keep: int) -> DataFrame:
    """At most ``keep`` rows, those with the smallest keys, per distinct point.

    Equal points tie in distance and ties fall to the smaller key, so the others cannot be among
    the answers. Spark limits each group already before the shuffle.
    """
    place = F.row_number().over(W.partitionBy(*features).orderBy(key))
    return points.withColumn("_copy", place).where(F.col("_copy") <= keep).drop("_copy")


@dataclass
class BoxIndex:
    """Points in boxes, for any number of searches.

    ``trees`` are the nodes of the regions' own trees (None while regions are boxes), ``placed`` the points with region
    and box, ``edges`` the boxes with their number of points and extent; all three are written tables. The driver
    has the first tree and, in ``regions``, one row of extents per leaf of it.
    """

    key: str
    features: list[str]
    keep: int
    tree: SplitTree
    trees: DataFrame | None
    placed: DataFrame
    edges: DataFrame
    regions: pd.DataFrame


def _columns(key: str, features) -> list:
    return [F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in features]]


def _schema(key: str, features) -> str:
    return f"{key} string, {', '.join(f'`{c}` double' for c in features)}"


def _extent(features: list[str], low: str = "{}", high: str = "{}") -> list:
    return [*[F.min(low.format(c)).alias(f"{c}_low") for c in features], *[F.max(high.format(c)).alias(f"{c}_high") for c in features]]


def _in_reach(rows: pd.DataFrame, boxes: pd.DataFrame, features: list[str]):
    """Row numbers of rows and boxes where the box's nearest corner is within the row's ``reach`` (null: any box), in blocks."""
    limit = rows["reach"].fillna(np.inf).to_numpy()
    step = max(1, CELLS_AT_ONCE // max(1, len(boxes)))
    for start in range(0, len(rows), step):
        part = rows[start:start + step]
        square = np.zeros((len(part), len(boxes)))
        for c in features:
            value = part[c].to_numpy(dtype=float)[:, None]
            square += np.maximum(np.maximum(boxes[f"{c}_low"].to_numpy() - value, value - boxes[f"{c}_high"].to_numpy()), 0) ** 2
        q, b = np.nonzero(np.round(np.sqrt(square), DIGITS) <= limit[start:start + step, None])
        yield q + start, b


def box_index(points: DataFrame, key: str, features, keep: int = 1) -> BoxIndex:
    """The points' boxes. ``keep`` is the most answers a search may ask for, one more if a point must not find itself."""
    features = list(features)
    points = written(_distinct_points(points.select(_columns(key, features)), key, features, keep))
    total = points.count()
    boxes = max(1, math.ceil(total / GROUP_ROWS))
    regions = min(boxes, max(REGIONS, math.isqrt(boxes)))

    def drawn(rows: DataFrame, leaves: int) -> DataFrame:
        """Rows below a hash threshold that follows the count: no task gathers candidates for the sample."""
        return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(max(total, 1))) < SAMPLE_PER_BOX * leaves)

    sample = drawn(points, regions).select(features).toPandas()
    if sample.empty:
        sample = points.select(features).limit(1).toPandas()
    tree = SplitTree(sample.to_numpy(dtype=float), regions)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        own = SplitTree(rows[features].to_numpy(dtype=float), math.ceil(len(rows) / SAMPLE_PER_BOX)).nodes()
        return own.assign(region=rows["region"].iloc[0])

    trees = None
    if regions < boxes:
        trees = written(_with_box(drawn(points, boxes), key, features, tree, None).groupBy("region").applyInPandas(
            grow, f"region int, node int, {NODE}"))
    placed = written(_with_box(points, key, features, tree, trees))
    edges = written(placed.groupBy("region", "box").agg(F.count("*").alias("n"), *_extent(features)))
    extents = edges.groupBy("region").agg(F.count("*").alias("boxes"), *_extent(features, "{}_low", "{}_high")).orderBy("region").toPandas()
    return BoxIndex(key, features, keep, tree, trees, placed, edges, extents)


def _elsewhere(bounded: DataFrame, index: BoxIndex) -> DataFrame:
    """(key, features, reach, region, box): boxes other than its own that a query with this ``reach`` must visit."""
    key, features, extents = index.key, index.features, index.regions
    schema = f"{_schema(key, features)}, reach double, own_region int, own_box int, region int"

    def regions_in_reach(batches):
        numbers = extents["region"].to_numpy()
        for batch in batches:
            batch = batch.rename(columns={"region": "own_region", "box": "own_box"})
            for q, b in _in_reach(batch, extents, features):
                out = batch.iloc[q][[key, *features, "reach", "own_region", "own_box"]].copy()
                out["region"] = numbers[b].astype("int32")
                yield out

    own = (F.col("region") == F.col("own_region")) & (F.col("box") == F.col("own_box"))
    away = bounded.mapInPandas(regions_in_reach, schema)
    if index.trees is None:
        away = away.withColumn("box", F.lit(0))
    else:
        def boxes_in_reach(rows: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
            columns = [key, *features, "reach", "own_region", "own_box", "region"]
            if rows.empty or boxes.empty:
                return pd.DataFrame({c: [] for c in [*columns, "box"]})
            found = [rows.iloc[q][columns].assign(box=boxes["box"].to_numpy()[b]) for q, b in _in_reach(rows, boxes, features)]
            return pd.concat(found, ignore_index=True)

        edges = index.edges.select("region", "box", *[f"{c}_{end}" for end in ("low", "high") for c in features])
        away = _in_regions(written(away), edges, key, boxes_in_reach, f"{schema}, box int")
    return away.where(~own).select(key, *features, "reach", "region", "box")


def nearest(queries: DataFrame, points: DataFrame | BoxIndex, key: str, features, k: int = 1,
            exclude_self: bool = False) -> DataFrame:
    """(key, rank 1…k, neighbour, distance) by Euclidean distance, exact, ties by neighbour key.

    Features are null-free numbers; keys are strings, unique in each table. With ``exclude_self``
    a point with the query's own key is skipped. ``points`` may be an index that several searches share.
    """
    features = list(features)
    index = points if isinstance(points, BoxIndex) else box_index(points, key, features, k + int(exclude_self))
    if (index.key, index.features) != (key, features) or index.keep < k + int(exclude_self):
        raise ValueError("the index was built for another key, other features or fewer answers")
    queries = written(_with_box(queries.select(_columns(key, features)), key, features, index.tree, index.trees))
    home = _at_home(queries, index, k, exclude_self)
    found = home.select(key, F.explode("best").alias("entry")).select(key, "entry.neighbour", "entry.distance")
    if index.regions["boxes"].sum() > 1:
        asked = written(_elsewhere(home.select(key, *features, "reach", "region", "box"), index))
        found = found.unionByName(_improved(asked, index, k, exclude_self))
    return _best(found, key, k).select(key, F.posexplode("best").alias("rank", "entry")).select(
        key, (F.col("rank") + 1).alias("rank"), "entry.neighbour", "entry.distance")
