"""Exact substring deduplication: run-length indexes over the repetitive parts of the corpus.

Every string of ``WIDTH`` bytes is named by the smallest hash of the ``ANCHOR``-byte strings in it. A run of strings
that follow each other with the same name is a record, and its bytes are a span. Equal strings have equal names, so
copies meet in the bucket of their name:

1. Per bucket, records with equal name and span are settled by hashes: the earliest stays, the others are copies.
2. Where a name still has several spans (or a span may repeat within itself), the earliest record of each span gives
   its bytes. They form a repetitive text; parts that no two spans share are cut off, a run-length index is built per
   block of names, the spans are streamed through it, and a string whose earliest occurrence is elsewhere is a copy.
3. Per document, copies are joined into removed runs.

What the tasks exchange are blobs of packed arrays: few rows, bounded in size, with their own bucket or group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordaudit.llm.hashing import _TABLE, chunks, lean, mix, powers, prefix, sliding_max, sliding_min, windows
from recordaudit.llm.run_index import RunIndex
from recordaudit.session import ship, written

WIDTH, ANCHOR = 100, 32
_NAMES = WIDTH - ANCHOR + 1
#: Bytes of text per bucket of names, and per group of documents.
BUCKET_BYTES, GROUP_BYTES = 32 << 20, 8 << 20
#: Records gathered in a task before they are sent, and bytes of spans per index.
FLUSH_RECORDS, INDEX_BYTES = 1 << 19, 1 << 20
#: A name with more spans than this is settled string by string, spread over all buckets.
CROWDED = 1 << 16

_A, _R, _C, _K, _W = 0, 1, 2, 3, 4  # records, copies, requests, spans, single strings


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a blob: byte planes, so that equal high bytes compress to nothing."""
    n = len(arrays[0])
    return n.to_bytes(8, "little") + b"".join(
        np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T).tobytes() for a in arrays)


def unpack(blob: bytes, types: tuple[type, ...]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for t in types:
        width = np.dtype(t).itemsize
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * width
    return out


A_TYPES = (np.uint64, np.uint64, np.int64, np.uint32, np.uint32, np.uint8)  # name, span, document, start, strings, within
R_TYPES = (np.int64, np.uint32, np.uint32)  # document, start, strings
C_TYPES = (np.uint64, np.int64, np.uint32, np.uint32, np.uint8)  # name, document, start, strings, 1 within / 2 crowded
K_TYPES = (np.uint64, np.int64, np.uint32, np.uint32, np.uint8)  # the same with their bytes behind
W_TYPES = (np.uint64, np.uint64, np.int64, np.uint32)  # two hashes, document, start


def group_of(document: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(document ^ (document >> 11) ^ (document >> 23), groups)


def _group_column(groups: int) -> Column:
    d = F.col("document")
    return F.pmod(d.bitwiseXOR(F.shiftright(d, 11)).bitwiseXOR(F.shiftright(d, 23)), F.lit(groups)).cast("int")


def records(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, name, span, start, strings, within) of all records of some texts, computed over their joined bytes."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    empty = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.uint8))
    if len(joined) < WIDTH:
        return empty
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size) - size
    sums = prefix(_TABLE[joined])
    hashes = mix(windows(sums, ANCHOR))
    least = sliding_min(hashes, _NAMES)
    # Strings that would cross into the next text don't count.
    edge = np.zeros(len(joined) + 1, np.int32)
    long = size >= WIDTH
    np.add.at(edge, first[long], 1)
    np.add.at(edge, first[long] + size[long] - WIDTH + 1, -1)
    valid = np.cumsum(edge[:len(least)]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return empty
    new = np.concatenate([[True], (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])])
    text = np.searchsorted(first, at, side="right") - 1
    new[1:] |= text[1:] != text[:-1]
    start = at[new]
    strings = np.diff(np.append(np.flatnonzero(new), len(at)))
    end = start + strings + WIDTH - 1
    span = mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + strings.astype(np.uint64))
    # A span can hold a string twice only if its name occurs twice in it, at most _NAMES apart.
    pad = np.zeros(_NAMES - 1, np.uint64)
    lowest = np.where(valid, least, np.uint64(0))
    chosen = np.flatnonzero(sliding_max(np.concatenate([pad, lowest, pad]), _NAMES) == hashes)
    order = np.lexsort((chosen, hashes[chosen]))
    q, value = chosen[order], hashes[chosen[order]]
    twice = np.unique(value[1:][(value[1:] == value[:-1]) & (np.diff(q) <= _NAMES)])
    within = np.isin(least[start], twice) if len(twice) else np.zeros(len(start), bool)
    owner = text[new]
    return owner, least[start], span, start - first[owner], strings, within.astype(np.uint8)


def _split(kind: int, key: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(key, kind, blob) per distinct key."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(key[part[0]]), kind, pack(*[a[part] for a in arrays])


def _settle(name, span, document, start, strings, within):
    """Sorted by (name, span, document, start): mask of each class's first record, and the order."""
    order = np.lexsort((start, document, span, name))
    n, s = name[order], span[order]
    new = np.concatenate([[True], (n[1:] != n[:-1]) | (s[1:] != s[:-1])])
    return order, new


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["key", "kind", "blob"])


BLOBS = "key int, kind int, blob binary"


def _send(buckets: int, gathered: list[tuple[np.ndarray, ...]], count: int) -> pa.RecordBatch:
    """Records of a part of a task, by bucket; copies within the part are settled here, so hot spans shrink first."""
    name, span, document, start, strings, within = (np.concatenate(c) for c in zip(*gathered))
    name, span = name >> np.uint64(16), span >> np.uint64(16)
    order, new = _settle(name, span, document, start, strings, within)
    kept, copies = order[new], order[~new]
    rows = list(_split(_A, (name[kept] % np.uint64(buckets)).astype(np.int64), [
        name[kept], span[kept], document[kept], start[kept].astype(np.uint32), strings[kept].astype(np.uint32), within[kept]]))
    if len(copies):
        spread = (np.arange(len(copies)) >> 14) + count
        rows += _split(_R, spread % buckets, [document[copies], start[copies].astype(np.uint32), strings[copies].astype(np.uint32)])
    return _rows(rows)


def _find(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, total, flushes = [], 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                owner, name, span, start, strings, within = records([t or b"" for t in texts[a:b]])
                gathered.append((name, span, ids[a:b][owner], start, strings, within))
                total += len(name)
                if total >= FLUSH_RECORDS:
                    yield _send(buckets, gathered, flushes)
                    gathered, total, flushes = [], 0, flushes + 1
        if total:
            yield _send(buckets, gathered, flushes)

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Blobs by key and kind, from batches sorted by key."""
    current, found = None, {}
    for batch in batches:
        for key, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if key != current:
                if found:
                    yield current, found
                current, found = key, {}
            found.setdefault(kind, []).append(blob)
    if found:
        yield current, found


def _joined(blobs: list[bytes], types: tuple[type, ...]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(unpack(b, types) for b in blobs))]


def _settle_buckets(groups: int):
    """Per bucket: copies by equal spans, and requests for the bytes of spans that have to be compared; by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_key(batches):
            rows = []
            for blob in found.get(_R, ()):
                document, start, strings = unpack(blob, R_TYPES)
                rows += _split(_R, group_of(document, groups), [document, start, strings])
            if _A in found:
                name, span, document, start, strings, within = _joined(found.pop(_A), A_TYPES)
                order, new = _settle(name, span, document, start, strings, within)
                copies, firsts = order[~new], order[new]
                rows += _split(_R, group_of(document[copies], groups), [document[copies], start[copies], strings[copies]])
                n = name[firsts]
                edge = np.concatenate([[True], n[1:] != n[:-1]])
                spans = np.diff(np.append(np.flatnonzero(edge), len(n)))[np.cumsum(edge) - 1]
                asked = firsts[(spans > 1) | (within[firsts] > 0)]
                crowded = (spans > CROWDED)[(spans > 1) | (within[firsts] > 0)]
                rows += _split(_C, group_of(document[asked], groups), [
                    name[asked], document[asked], start[asked], strings[asked], np.where(crowded, 2, within[asked]).astype(np.uint8)])
            yield _rows(rows)

    return run


def _answer(buckets: int, groups: int):
    """Per group of documents: the bytes of the requested spans, by bucket."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        blobs = asked.column("blob").to_pylist()
        if blobs and len(docs):
            name, document, start, strings, how = _joined(blobs, C_TYPES)
            texts = {}
            for d, t in zip(docs.column("document").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist()):
                texts[d] = t
            bucket = (name % np.uint64(buckets)).astype(np.int64)
            plain = np.flatnonzero(how < 2)
            order = plain[np.argsort(bucket[plain], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    pieces = [texts[d][s:s + n + WIDTH - 1] for d, s, n in zip(document[part].tolist(), start[part].tolist(), strings[part].tolist())]
                    head = pack(name[part], document[part], start[part], strings[part], how[part])
                    rows.append((int(bucket[part[0]]), _K, head + b"".join(pieces)))
            crowded = np.flatnonzero(how == 2)
            if len(crowded):
                parts = []
                for i in crowded:
                    d, s, n = int(document[i]), int(start[i]), int(strings[i])
                    values = np.frombuffer(texts[d][s:s + n + WIDTH - 1], np.uint8)
                    one, two = windows(prefix(_TABLE[values]), WIDTH), windows(prefix(mix(_TABLE[values])), WIDTH)
                    parts.append((mix(one), mix(two), np.full(n, d), np.arange(s, s + n).astype(np.uint32)))
                arrays = [np.concatenate(c) for c in zip(*parts)]
                rows += _split(_W, (arrays[0] % np.uint64(buckets)).astype(np.int64), arrays)
        return pa.Table.from_batches([_rows(rows)])

    return run


def _shared_part(name: np.ndarray, strings: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per span, the first string and the number of strings that another span of its name could hold too.

    Spans of a name are aligned at the name's place. Sorted by what follows it, neighbours share the most of it;
    the same holds for what precedes it. Strings that reach beyond both are unique.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size) - size
    hashes = mix(windows(prefix(_TABLE[joined]), ANCHOR))
    hashes = np.append(hashes, np.zeros(ANCHOR, np.uint64))[:len(joined)]
    # The name's place: the first smallest hash among the span's anchors.
    inside = np.repeat(first, size) + size.repeat(size) - ANCHOR >= np.arange(len(joined))
    masked = np.where(inside, hashes, np.uint64(2**64 - 1))
    least = np.minimum.reduceat(masked, first)
    hit = np.flatnonzero(masked == np.repeat(least, size))
    owner = np.searchsorted(first, hit, side="right") - 1
    place = np.empty(len(texts), np.int64)
    place[owner[::-1]] = hit[::-1]
    place -= first

    def reach(parts: list[bytes]) -> np.ndarray:
        """Length of the longest prefix that each part shares with another of the same name."""
        filled = np.array(parts, dtype=f"S{WIDTH}")
        # numpy drops trailing zero bytes; lengths below bound what is shared.
        length = np.array([len(p) for p in parts])
        order = np.lexsort((filled, name))
        rows = filled[order].view(np.uint8).reshape(len(parts), WIDTH)
        same = rows[1:] == rows[:-1]
        common = np.where(same.all(1), WIDTH, same.argmin(1))
        common = np.minimum(common, np.minimum(length[order[1:]], length[order[:-1]]))
        common = np.where(name[order[1:]] == name[order[:-1]], common, 0)
        out = np.zeros(len(parts), np.int64)
        out[order[1:]] = common
        out[order[:-1]] = np.maximum(out[order[:-1]], common)
        return out

    right = reach([t[p:p + WIDTH] for t, p in zip(texts, place.tolist())])
    left = reach([t[max(0, p - WIDTH):p][::-1] for t, p in zip(texts, place.tolist())])
    low = np.maximum(place - left, 0)
    high = np.minimum(place + right - WIDTH, strings - 1)
    return low, np.maximum(high - low + 1, 0)


def copies_in_spans(name, document, start, strings, how, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, strings) of strings with an earlier occurrence among these spans; all spans of a name are here."""
    low, count = _shared_part(name, strings, texts)
    low, count = np.where(how > 0, 0, low), np.where(how > 0, strings, count)
    useful = np.flatnonzero(count > 0)
    if not len(useful):
        return tuple(np.empty(0, t) for t in R_TYPES)
    begin = start.astype(np.int64) + low
    order = useful[np.lexsort((begin[useful], document[useful]))]
    cut = [texts[i][low[i]:low[i] + count[i] + WIDTH - 1] for i in order]
    length = np.array([len(c) for c in cut])
    index = RunIndex(np.frombuffer(b"".join(cut), np.uint8), length, WIDTH)
    found = index.earliest()
    copied = np.flatnonzero((found >= 0) & (found != np.arange(len(found))))
    of = np.searchsorted(index.starts, copied, side="right") - 1
    at = begin[order][of] + copied - index.starts[of]
    whose = document[order][of]
    new = np.concatenate([[True], (np.diff(copied) > 1) | (of[1:] != of[:-1])]) if len(copied) else np.empty(0, bool)
    runs = np.flatnonzero(new)
    return whose[runs], at[runs].astype(np.uint32), np.diff(np.append(runs, len(copied))).astype(np.uint32)


def _compare(groups: int):
    """Per bucket: copies among requested spans, block of names by block, and among single strings; by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_key(batches):
            rows = []
            if _W in found:
                one, two, document, start = _joined(found.pop(_W), W_TYPES)
                order, new = _settle(one, two, document, start, None, None)
                copies = order[~new]
                rows += _split(_R, group_of(document[copies], groups), [document[copies], start[copies], np.ones(len(copies), np.uint32)])
            heads, texts = [], []
            for blob in found.pop(_K, ()):
                head = unpack(blob, K_TYPES)
                heads.append(head)
                at = 8 + len(head[0]) * sum(np.dtype(t).itemsize for t in K_TYPES)
                for n in head[3].tolist():
                    texts.append(blob[at:at + n + WIDTH - 1])
                    at += n + WIDTH - 1
            if heads:
                name, document, start, strings, how = (np.concatenate(c) for c in zip(*heads))
                order = np.argsort(name, kind="stable")
                filled = np.cumsum(strings[order].astype(np.int64) + WIDTH)
                edge = np.concatenate([[True], name[order][1:] != name[order][:-1]])
                # A block ends at the first new name after every INDEX_BYTES.
                begins = np.flatnonzero(edge)
                block = filled[begins] // INDEX_BYTES
                cuts = begins[1:][block[1:] != block[:-1]]
                for part in np.split(order, cuts):
                    copied = copies_in_spans(name[part], document[part], start[part], strings[part].astype(np.int64), how[part], [texts[i] for i in part])
                    rows += _split(_R, group_of(copied[0], groups), list(copied))
            yield _rows(rows)

    return run


def _finish(docs: pa.Table, copies: pa.Table) -> pa.Table:
    """Per document of a group: removed runs and what is left."""
    blobs = copies.column("blob").to_pylist()
    of: dict[int, tuple[int, int]] = {}
    start = strings = None
    if blobs:
        document, start, strings = _joined(blobs, R_TYPES)
        order = np.argsort(document, kind="stable")
        start, strings = start[order].astype(np.int64), strings[order].astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(document[order])) + 1, len(order))
        begin = 0
        for end in cuts.tolist():
            of[int(document[order[begin]])] = (begin, end)
            begin = end
    sizes, removed, left = [], [], []
    for d, text in zip(docs.column("document").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist()):
        text = text or b""
        sizes.append(len(text))
        if d not in of or not len(text):
            removed.append([])
            left.append(text)
            continue
        a, b = of[d]
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, start[a:b], 1)
        np.add.at(change, start[a:b] + strings[a:b] + WIDTH - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        removed.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
        left.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([docs.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(left, pa.binary())],
                    ["doc_id", "n_bytes", "removed", "kept"])


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``document``: a number per distinct (doc_id, text) in that order. Only for tables that repeat a doc_id."""
    keys = written(rows.select("doc_id", "tag").distinct().repartitionByRange("doc_id", "tag").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = keys.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tag"))
    numbers = keys.withColumn("inside", inside).join(offsets, "part").select(
        F.col("doc_id").alias("k_id"), F.col("tag").alias("k_tag"), (F.col("offset") + F.col("inside")).alias("document"))
    return rows.join(numbers, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tag") == F.col("k_tag"))).drop("k_id", "k_tag")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of byte ranges) and kept (the remaining bytes) per row of ``docs``.

    A byte is removed if a string of WIDTH bytes that covers it also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. Strings are judged on the input. Null and empty texts have no bytes.
    Rows that repeat a doc_id with the same text are one document and get the same result; with different texts they
    are ordered by the text's hash, and a null doc_id comes before all others. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = int(total // BUCKET_BYTES) + 4, int(total // GROUP_BYTES) + 4
    repeats = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if repeats.isEmpty():
        rows = rows.withColumn("document", F.col("doc_id"))
        once = rows
    else:
        rows = written(_numbered(rows.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))))
        once = rows.dropDuplicates(["document"])
    found = once.select("document", "text").mapInArrow(lean(_find(buckets)), BLOBS)
    settled = written(found.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(lean(_settle_buckets(groups)), BLOBS))
    grouped = rows.withColumn("key", _group_column(groups))
    asked = settled.filter(F.col("kind") == _C)
    answers = grouped.select("key", "document", "text").groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(_answer(buckets, groups), BLOBS)
    compared = written(answers.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(lean(_compare(groups)), BLOBS))
    copies = settled.filter(F.col("kind") == _R).unionByName(compared)
    return grouped.groupBy("key").cogroup(copies.groupBy("key")).applyInArrow(
        _finish, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
