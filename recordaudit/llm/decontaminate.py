"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance confirms them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recordaudit.llm.hashing import Words, chunks, lean, mix, prefix, windows
from recordaudit.session import ship, written

#: Word edits (changed, missing or added words) an item may differ by, as a share of its words.
ERROR_RATE = 0.2
#: Shorter items have no edits to spare: with some, they would meet clean text by chance. They are searched verbatim.
MIN_WORDS = 8
#: Items are searched in blocks of about this many bytes; each block is one pass over the documents.
BLOCK_BYTES = 16 << 20

FOUND = StructType([StructField("item_id", StringType()), StructField("distance", LongType()),
                    StructField("first_word", LongType()), StructField("last_word", LongType())])


def budget(n_words: int, rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> int:
    return int(n_words * rate + 1e-9) if n_words >= min_words else 0


def cuts(n_words: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 pieces of nearly equal length: with that many errors one piece is untouched."""
    edges = [n_words * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(edges, edges[1:]))


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the (first) last position of such a stretch.

    Bit-parallel: one integer holds a column of the dynamic programme, so a text symbol costs a few operations.
    """
    m = len(pattern)
    top, every = 1 << (m - 1), (1 << m) - 1
    where: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        where[symbol] = where.get(symbol, 0) | (1 << i)
    plus, minus, score, best, at = every, 0, m, m, -1
    for j, symbol in enumerate(text):
        eq = where.get(symbol, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(across | plus) & every), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & every, (down << 1) & every  # a match may begin anywhere: no carry into the first row
        vertical = eq | minus
        plus, minus = down | (~(vertical | up) & every), up & vertical
        if score < best:
            best, at = score, j
    return best, at


@dataclass
class Index:
    """Items of one block: their words, error budgets, and the sorted hashes of their pieces by piece length."""

    ids: list[str]
    words: list[np.ndarray]
    errors: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: hashes, items, offsets


def build(items: list[tuple[str, str]], rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> Index:
    parsed = [(i, Words([t.encode()]).hashes) for i, t in items]
    parsed = [(i, w) for i, w in parsed if len(w)]
    index = Index([i for i, _ in parsed], [w for _, w in parsed], [budget(len(w), rate, min_words) for _, w in parsed], {})
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, w in enumerate(index.words):
        sums = prefix(w)
        for a, b in cuts(len(w), index.errors[k]):
            found.setdefault(b - a, []).append((int(mix(windows(sums, b - a)[a:a + 1])[0]), k, a))
    for length, rows in found.items():
        rows.sort()
        index.pieces[length] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return index


def _hits(index: Index, words: Words) -> Iterator[tuple[int, int, int]]:
    """(text, item, word where the item would begin) of every piece that occurs in a chunk of texts."""
    sums = prefix(words.hashes)
    for length, (hashes, items, offsets) in index.pieces.items():
        seen = mix(windows(sums, length))
        low = np.searchsorted(hashes, seen)
        candidates = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == seen)
        text = np.searchsorted(words.first, candidates, side="right") - 1
        inside = candidates + length <= words.first[text + 1]
        for at, of in zip(candidates[inside], text[inside]):
            k = low[at]
            while k < len(hashes) and hashes[k] == seen[at]:
                yield int(of), int(items[k]), int(at - offsets[k])
                k += 1


def search(index: Index, texts: list[bytes | None]) -> list[list[tuple[str, int, int, int]]]:
    """Per text the items found: (item id, distance, first and last word of the stretch searched and matched)."""
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
    if not index.pieces:
        return out
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        starts: dict[tuple[int, int], set[int]] = {}
        for text, item, start in _hits(index, words):
            starts.setdefault((text, item), set()).add(start)
        for (text, item), places in sorted(starts.items()):
            pattern, errors = index.words[item].tolist(), index.errors[item]
            low, high = int(words.first[text]), int(words.first[text + 1])
            # Overlapping stretches are searched once: the work is linear in the text however often a piece occurs.
            stretches: list[list[int]] = []
            for start in sorted(places):
                left, right = max(low, start - errors), min(high, start + len(pattern) + errors)
                if stretches and left <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], right)
                else:
                    stretches.append([left, right])
            best = (errors + 1, 0, 0)
            for left, right in stretches:
                distance, last = myers(pattern, words.hashes[left:right].tolist())
                best = min(best, (distance, left - low, left - low + last))
            if best[0] <= errors:
                out[a + text].append((index.ids[item], *best))
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """Items (item_id, text) in blocks of a bounded size, one at a time on the driver, each with whether it is the last."""
    known = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(2 * total // block_bytes) + 1
    for k in range(count):
        part = known if count == 1 else known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield k == count - 1, [(r["item_id"], r["text"]) for r in part.distinct().toLocalIterator()]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _row_texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(0).field("text").cast(pa.binary()).to_pylist()


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, first_word, last_word): items within their error budget of a stretch of a document.

    Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased, compared by 64-bit hashes. One
    row per document row and item, with the least distance. Items of fewer than ``min_words`` words are searched verbatim.
    Null or empty texts hold nothing; items without words aren't searched; repeated items count once; other columns are ignored; empty tables give no rows.
    Documents are read in one pass without a shuffle per block of items. Blocks have a bounded size and are run one
    after the other: what a block finds is written and its broadcast dropped before the next one is built, so neither
    the driver nor a task ever has more than one. Only the last block is left to the action on the result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id string, distance long, first_word long, last_word long"
    result = spark.createDataFrame([], schema)
    for last, block in _blocks(items, block_bytes):
        shipped = spark.sparkContext.broadcast(build(block, rate, min_words))

        def look(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, *m) for i, found in zip(ids, search(shipped.value, _texts(batch))) for m in found]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "item_id", "distance", "first_word", "last_word"])

        found = rows.mapInArrow(lean(look), schema)
        if not last:
            found = written(found)
            shipped.destroy()
        result = result.unionByName(found)
    return result


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all columns; see ``find_leaks``.

    Rows stay in number and as they are: null and empty texts hold nothing, repeated rows stay or go together, and an
    empty table gives an empty result. The texts that a block other than the last finds are written as hashes of 128 bits.
    """
    spark = docs.sparkSession
    ship(spark)
    row, hashes = F.struct("*").alias("row"), (F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("leak"), "text").alias("h2"))
    gone = None
    for last, block in _blocks(items, block_bytes):
        shipped = spark.sparkContext.broadcast(build(block, rate, min_words))

        def split(batches: Iterator[pa.RecordBatch], texts_of, found: bool, shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = search(shipped.value, texts_of(batch))
                yield batch.filter(pa.array([bool(hit) == found for hit in hits], pa.bool_()))

        if last:
            rows = docs.select(row)
            if gone is not None:
                rows = docs.select(row, *hashes).join(gone.distinct(), ["h1", "h2"], "left_anti").select("row")
            kept = rows.mapInArrow(lean(partial(split, texts_of=_row_texts, found=False)), rows.schema)
        else:
            texts = docs.select(*hashes, "text")
            leaky = written(texts.mapInArrow(lean(partial(split, texts_of=_texts, found=True)), texts.schema).select("h1", "h2"))
            gone = leaky if gone is None else gone.unionByName(leaky)
            shipped.destroy()
    return kept.select("row.*")
