"""Near-duplicate documents by a MinHash LSH forest with exact confirmation.

A document's set is its distinct five-word shingles. Equal sets become one node. Every tree of the forest sorts the
nodes by its own order of the signature's values; nodes with a common prefix of ``BASE_DEPTH`` values form a region,
and their partners there are candidates. A region that is too full is split by longer prefixes until it fits, which
joins most of its nodes; then those still apart are compared with all others of the region, block by block, so that
no candidate is lost by a split. Candidates are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordaudit.llm.hashing import Words, chunks, grams, lean, mix
from recordaudit.session import ship, written

SHINGLE = 5
#: Least similarity of a link in percent, unless the caller sets another.
THRESHOLD = 85
HASHES = 64
BASE_DEPTH, STEP, LAST_DEPTH = 4, 2, 16
#: Regions up to this many nodes emit their likely pairs; fuller ones are compared where they are.
SMALL = 32
#: Regions beyond this are split by longer prefixes.
FULL = 1024
#: Bounds on the chance that a pair at the threshold shares no region of independent trees, and that its signatures
#: have fewer equal values than are asked for.
FOREST_MISS, LIKELY_MISS = 4e-7, 1 / 300_000
#: The side of nodes that are compared with all others of their group.
ALL = 2

_rng = np.random.default_rng(1789)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_after_factors = _rng.bit_generator.state


@cache
def tree_orders(threshold: int) -> np.ndarray:
    """Orders of the signature's values, one row per tree: as many trees as FOREST_MISS needs at the threshold."""
    met = (threshold / 100) ** BASE_DEPTH
    trees = math.ceil(math.log(FOREST_MISS) / math.log1p(-met)) if met < 1 else 1
    rng = np.random.default_rng()
    rng.bit_generator.state = _after_factors
    return np.array([rng.permutation(HASHES)[:LAST_DEPTH] for _ in range(trees)])


@cache
def least_equal(threshold: int) -> int:
    """Equal signature values a pair needs to be compared: a pair at the threshold has fewer with a chance of LIKELY_MISS at most."""
    p, k, below = threshold / 100, 0, 0.0
    while k < HASHES and (below := below + math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)) <= LIKELY_MISS:
        k += 1
    return k


def _sets(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, shingle hashes, offsets per text) chunk by chunk."""
    for a, b in chunks(texts):
        hashes, offset = grams(Words(texts[a:b]), SHINGLE)
        yield a, hashes, offset


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a contiguous 2-d array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The values of a binary column of equal widths as a 2-d array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set: two sums over its elements, each after its own mixing."""
    with np.errstate(over="ignore"):
        return np.array([mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)]).tobytes()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        counts, nodes, signatures = np.zeros(len(texts), np.int64), [None] * len(texts), np.zeros((len(texts), HASHES), np.uint32)
        for first, hashes, offset in _sets(texts):
            full = np.flatnonzero(np.diff(offset))
            for j, factor in enumerate(_FACTORS if len(full) else ()):
                signatures[first + full, j] = np.minimum.reduceat(hashes * factor, offset[:-1][full]) >> np.uint64(32)
            for i in full:
                unique = np.unique(hashes[offset[i]:offset[i + 1]])
                counts[first + i], nodes[first + i] = len(unique), _fingerprint(unique)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts), pa.array(nodes, pa.binary()), _binary(signatures), batch.column(2)],
            ["doc_id", "n_shingles", "node", "signature", "nameless"])


def nameless() -> Column:
    """What tells rows without a doc_id apart: a hash of the text; null for rows that have one."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, signature, nameless) per document; node is null for an empty set."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", nameless().alias("nameless")).mapInArrow(
        lean(_describe), "doc_id long, n_shingles long, node binary, signature binary, nameless long")


def _keys(depth: int, orders: np.ndarray) -> Callable:
    """Maps (node, signature, tree or null) to (node, tree, key): key stands for the tree and its first ``depth`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            signature = _matrix(batch.column(1), np.uint32, HASHES).astype(np.uint64)
            only = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
            for tree in range(len(orders)):
                rows = np.arange(len(batch)) if only is None else np.flatnonzero(only == tree)
                if not len(rows):
                    continue
                key = np.full(len(rows), tree + 1, np.uint64)
                for place in orders[tree][:depth]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[rows, place])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), tree, np.int32)), pa.array(key.view(np.int64))],
                    ["node", "tree", "key"])

    return run


def _sized(keys: DataFrame) -> DataFrame:
    """Members of regions with two or more nodes, with the region's size."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return keys.join(sizes, "key")


def regions(nodes: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, node, members): regions of all trees, split by longer prefixes while they have more than FULL nodes.

    The second table (key, node) has the regions that were split, whole: nodes that part at a longer prefix lose each
    other there, so ``across`` compares what the splits have not joined.
    """
    keyed, orders = "node binary, tree int, key long", tree_orders(threshold)
    current = written(_sized(nodes.select("node", "signature").mapInArrow(lean(_keys(BASE_DEPTH, orders)), keyed)))
    parts = [current.filter(F.col("members") <= FULL)]
    depth = BASE_DEPTH
    over = crowded = current.filter(F.col("members") > FULL)
    while depth < LAST_DEPTH and not over.isEmpty():
        depth += STEP
        deeper = over.select("node", "tree").join(nodes.select("node", "signature"), "node").select("node", "signature", "tree")
        current = written(_sized(deeper.mapInArrow(lean(_keys(depth, orders)), keyed)))
        parts.append(current.filter(F.col("members") <= FULL))
        over = current.filter(F.col("members") > FULL)
    if not over.isEmpty():
        # Nodes that agree in LAST_DEPTH values of one order are alike many times over: parts of them by hash, other
        # ones in every tree, join most of them before all that is still apart is compared.
        part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("members") * 2 / FULL))
        parts.append(over.withColumn("key", F.xxhash64("key", part)).withColumn("members", F.lit(FULL).cast("long")))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result.select("key", "node", "members"), crowded.select("key", "node")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in which no run of equal keys is cut, from batches sorted by key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        edge = np.flatnonzero(keys[1:] != keys[:-1])
        if rest and rest[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if len(edge):
            cut = int(edge[-1]) + 1
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _likely(threshold: int) -> Callable:
    """Pairs of small regions whose signatures and sizes allow a link; rows are (key, node, n_shingles, signature)."""

    likely = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            rows = rows.combine_chunks()
            keys, sizes = rows.column(0).to_numpy(), rows.column(2).to_numpy()
            nodes = rows.column(1).to_pylist()
            signature = _matrix(rows.column(3).combine_chunks(), np.uint32, HASHES)
            left, right = [], []
            for d in range(1, SMALL):
                first = np.flatnonzero(keys[d:] == keys[:-d]) if d < len(keys) else np.empty(0, int)
                if not len(first):
                    break
                small, large = np.minimum(sizes[first], sizes[first + d]), np.maximum(sizes[first], sizes[first + d])
                first = first[small * 100 >= large * threshold]
                equal = (signature[first] == signature[first + d]).sum(1)
                for i in first[equal >= likely]:
                    a, b = nodes[i], nodes[i + d]
                    left.append(min(a, b))
                    right.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sets (sorted, unique) reach the threshold."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * threshold:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _compare_regions(threshold: int) -> Callable:
    """Links of fuller regions: each is compared in one place and gives a spanning forest of its links, not all of them.

    Rows are (key, node, signature, shingles, label, side). Nodes with a common label are joined already; nodes of
    side 0 are compared with those of side 1, or all with each other.
    """

    likely = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            rows = rows.combine_chunks()
            keys = rows.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            left, right = [], []
            for start, end in zip(edges, edges[1:]):
                part = rows.slice(start, end - start)
                nodes, sets = part.column(1).to_pylist(), [np.frombuffer(s, np.uint64) for s in part.column(3).to_pylist()]
                signature = _matrix(part.column(2).combine_chunks(), np.uint32, HASHES)
                codes: dict[bytes, int] = {}
                label = np.array([codes.setdefault(x, len(codes)) for x in part.column(4).to_pylist()])
                side = part.column(5).to_numpy()
                if side[0] == ALL:
                    work = ((i, np.arange(i + 1, len(nodes))) for i in range(len(nodes)))
                else:
                    second = np.flatnonzero(side == 1)
                    work = ((i, second) for i in np.flatnonzero(side == 0).tolist())
                for i, others in work:
                    others = others[label[others] != label[i]]
                    equal = (signature[others] == signature[i]).sum(1)
                    for j in others[equal >= likely].tolist():
                        if label[i] != label[j] and linked(sets[i], sets[j], threshold):
                            label[label == label[j]] = label[i]
                            left.append(min(nodes[i], nodes[j]))
                            right.append(max(nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, nodes = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0).to_pylist()
        for first, hashes, offset in _sets(texts):
            found = [np.unique(hashes[offset[i]:offset[i + 1]]) for i in range(len(offset) - 1)]
            # Rows that share a doc_id may have different texts: the set must be the node's.
            own = [(nodes[first + i], f.tobytes()) for i, f in enumerate(found) if _fingerprint(f) == nodes[first + i]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], pa.binary()) for k in (0, 1)], ["node", "shingles"])


def _confirm(threshold: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yes = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in sets], pa.bool_())
            yield batch.select(["a", "b"]).filter(yes)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of links (a, b), by alternating large and small stars.

    Each round is two group-bys and joins over the links, and the rounds grow with the logarithm of the largest
    component. Links never leave the executors; a hub's links are split by the adaptive skew join.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.filter("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").filter("v > u" if large else "v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a != b").distinct()

    def state(edges: DataFrame) -> tuple:
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = written(links.filter("a != b").distinct())
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = written(star(star(edges, True), False))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def across(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, label, side): blocks of crowded regions (key, node), in pairs that cover all nodes still apart.

    ``found`` (node, root) are the components so far. A region's largest one is not compared with itself: the others
    are, and with it. Blocks have about FULL / 2 nodes, so that no task has more than a full region.
    """
    labelled = written(crowded.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    apart = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
    apart = apart.filter("labels > 1").select("key", F.col("main.label").alias("main"), F.ceil(F.col("main.n") * 2 / FULL).alias("mains"),
                                              F.ceil((F.col("all") - F.col("main.n")) * 2 / FULL).alias("rests"))
    within, is_main = F.xxhash64("node", "key"), F.col("label") == F.col("main")
    placed = labelled.join(apart, "key").select(
        "key", "node", "label", F.when(is_main, F.col("rests") + F.pmod(within, "mains")).otherwise(F.pmod(within, "rests")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") + F.when(is_main, 0).otherwise(F.col("mains")) - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), ALL).otherwise((F.col("block") > F.col("other")).cast("int"))
    return placed.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "label", side.alias("side"))


def _texts_without_id(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, text) of the nodes that no row with an id has, each once however often the text is repeated."""
    own = docs.filter("doc_id is null").select("text", F.xxhash64("text").alias("nameless"))
    return own.join(chosen, "nameless").groupBy("node").agg(F.first("text").alias("text"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and kept, per row of ``docs``.

    Documents are linked if 100 * common shingles >= threshold * shingles of either. Words are runs of bytes other
    than 0x20 and 0x09-0x0D with A-Z lower-cased; fewer than five words count as one shingle. Null, empty or blank
    texts have no shingles, are linked with nothing and are kept. Repeated rows are linked with each other and are
    all kept or all dropped, as they share their doc_id. A null doc_id never names a component: kept is true for it
    only if no row of its component has an id. Other columns are ignored; an empty table gives an empty result.
    """
    return _judged(docs, threshold).drop("nameless")


def _judged(docs: DataFrame, threshold: int) -> DataFrame:
    """``near_duplicates`` with the column ``nameless``."""
    described = written(describe(docs))
    nodes = written(described.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"),
        F.min("nameless").alias("nameless")))
    members, crowded = regions(nodes, threshold)
    members = written(members)
    wanted = members.select("node").unionByName(crowded.select("node")).distinct()
    # One text per node that is in a region; the smallest id is enough to find it, or else the text's hash.
    wanted = nodes.join(wanted, "node", "left_semi")
    chosen = wanted.filter("least is not null").select(F.col("least").alias("doc_id"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("node", "text")
    texts = texts.unionByName(_texts_without_id(docs, wanted.filter("least is null").select("nameless", "node")))
    sets = written(texts.mapInArrow(lean(_full_sets), "node binary, shingles binary"))

    pair = "a binary, b binary"
    sparse = members.filter(F.col("members") <= SMALL).join(nodes, "node").select("key", "node", "n_shingles", "signature")
    pairs = sparse.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_likely(threshold)), pair).distinct()
    confirmed = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(lean(_confirm(threshold)), pair)
    )

    def compared(groups: DataFrame) -> DataFrame:
        rows = groups.join(nodes, "node").join(sets, "node").select("key", "node", "signature", "shingles", "label", "side")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_compare_regions(threshold)), pair)

    dense = members.filter(F.col("members") > SMALL).select("key", "node", F.col("node").alias("label"), F.lit(ALL).alias("side"))
    links = confirmed.unionByName(compared(dense))
    roots = written(components(links))
    if not crowded.isEmpty():
        rest = written(compared(across(crowded, roots)))
        if not rest.isEmpty():
            # A component's links to its root stand for it.
            roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)))

    named = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("linked_id"))
    linked_ids = roots.join(named, "root").select("node", "linked_id")
    own = nodes.select("node", "least").join(linked_ids, "node", "left").select("node", F.coalesce("linked_id", "least").alias("found"))
    return described.select("doc_id", "n_shingles", "node", "nameless").join(own, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("found", "doc_id")).alias("kept"), "nameless")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id; all columns.

    Rows without shingles are no duplicates of anything and stay. Of rows that repeat doc_id and text, one stays;
    rows that share a doc_id but not the text are one document in two versions and stay or go together. Rows without
    an id are told apart by their text: one goes if its component has an id, else all different ones stay.
    """
    judged = written(_judged(docs, threshold))
    dropped = judged.filter(~F.col("kept")).select("doc_id", "nameless").distinct()
    again = judged.filter("n_shingles > 0").groupBy("doc_id", "nameless").count().filter("count > 1").select("doc_id", "nameless")

    def same(rows: DataFrame, other: DataFrame) -> Column:
        own = F.when(rows["doc_id"].isNull(), F.xxhash64(rows["text"]))
        return rows["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & own.eqNullSafe(other["nameless"])

    rest = docs.join(dropped, same(docs, dropped), "left_anti")
    if again.isEmpty():  # no repeated rows: the texts are joined once
        return rest
    once = rest.join(again, same(rest, again), "left_anti")
    repeated = rest.join(again, same(rest, again), "left_semi")
    blank = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    return once.unionByName(repeated.filter(blank)).unionByName(repeated.filter(~blank).dropDuplicates(["doc_id", "text"]))
