"""Secrets: known formats, and tokens that a battery of randomness tests tells from the corpus's own structured strings."""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordaudit.session import ship, written

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_GUARDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens that the tests look at: 20 or more characters. Below that the tests tell too little apart.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_WORD, _NUMBER = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,14}(?![A-Za-z0-9+/_-])"), re.compile(r"(?<![0-9])[0-9]{1,4}(?![0-9])")

#: Alphabets from the narrowest: the first that holds a token is its encoding.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
_UPPER, _LOWER, _DIGITS = ENCODINGS[4][1][10:], ENCODINGS[3][1][10:], ENCODINGS[0][1][:10]
_CLASS = {c: i for i, letters in enumerate((_DIGITS, _UPPER, _LOWER, "+/-_")) for c in letters}


#: Letters as words use them: vowels, frequent consonants, and the rest as their classes' remaining part.
_FREQUENT = ("aeiou", "cdhlmnrst")


def _part(c: str) -> int:
    return _CLASS[c] * 3 + next((i for i, letters in enumerate(_FREQUENT) if c.lower() in letters), 2)


#: Per encoding: place and class of each symbol, and the partitions of its alphabet that uniformity is tested over.
_TABLES = tuple((name, {c: i for i, c in enumerate(letters)}, np.array([_CLASS[c] for c in letters]),
                 tuple((np.array(by), np.bincount(by)) for by in ([_part(c) for c in letters], [_CLASS[c] for c in letters])))
                for name, letters in ENCODINGS)

#: False-discovery rate, within each length class, of reporting a structured token.
RATE = 0.05
#: First lengths of the length classes. Structured strings look the less random the longer they are, so all longer ones share the last.
LENGTHS = (20, 24, 32, 48, 64)
#: p-values are counted in bins of the decimal logarithm, this many per decade, down to 10 ** -LOWEST.
BINS_PER_DECADE, LOWEST = 8, 30
#: An encoding with fewer structured strings of a length class than this takes the class's strings of all encodings.
LEAST_STRUCTURED = 200
#: Words that give structured strings where a corpus has hardly any, and how many strings they give per length class.
WORDS = ("page number section value record result table index client server account order report update version module "
         "handler service default option request response template message window session project release image file").split()
BUILT_IN = 400
TESTED = "struct<start:int,end:int,encoding:string,length_class:int,p:double>"
STRUCTURED = "struct<encoding:string,length_class:int,p:double>"


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom, by the Wilson-Hilferty cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def battery(token: str) -> tuple[str, float]:
    """Encoding of a token and its combined p-value under "drawn evenly from the encoding's alphabet".

    Uniformity: chi-squared over the classes of characters, and over these with their letters as words use them.
    Runs: number of runs of characters of one class (of one half of the alphabet where there is one class only).
    Order: serial correlation at lag one. All are combined by Cauchy's rule, which holds for dependent tests. A low
    value means structure (words, counters, paths); a high one looks random.
    """
    body = token.rstrip("=")
    for name, places, classes, partitions in _TABLES:
        try:
            x = np.array([places[c] for c in body])
        except KeyError:
            continue
        break
    else:
        return "none", 0.0
    n, size = len(x), len(places)
    if n < 2:
        return name, 0.0
    tests = []
    for part, sizes in partitions:
        used = np.flatnonzero(sizes)
        expected = sizes[used] * (n / size)
        counted = np.bincount(part[x], minlength=len(sizes))[used]
        tests.append(_chi_tail(float((((counted - expected) ** 2) / expected).sum()), len(used) - 1))
    group = classes[x]
    if group.min() == group.max():
        group = (x * 2 >= size).astype(int)
    count = np.bincount(group).astype(float)
    squares, cubes = float((count ** 2).sum()), float((count ** 3).sum())
    variance = (squares * (squares + n * (n + 1)) - 2 * n * cubes - n ** 3) / (n * n * (n - 1))
    switches = 1 + int((group[1:] != group[:-1]).sum())
    tests.append(_normal_tail((switches - 1 - (n * n - squares) / n) / math.sqrt(variance)) if variance > 1e-9 else 2.0 ** (1 - n))
    centred = x - x.mean()
    square = float((centred ** 2).sum())
    tests.append(_normal_tail((float((centred[1:] * centred[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square else 0.0)
    # A test that fits too well must not outweigh one that doesn't fit at all.
    cauchy = sum(math.tan((0.5 - min(max(p, 1e-15), 0.95)) * math.pi) for p in tests) / len(tests)
    return name, min(max(0.5 - math.atan(cauchy) / math.pi, 10.0 ** -LOWEST), 1.0)


def length_class(n: int) -> int:
    return LENGTHS[bisect.bisect_right(LENGTHS, n) - 1]


def structured(words: list[str], numbers: list[str], seed: int) -> list[tuple[str, float, int]]:
    """(encoding, length class, p) of one string of each length class, put together of words and numbers as identifiers and paths are.

    The words follow each other as in the text, from a place that depends on ``seed``, over and over until the
    class's least length is reached (at which they look the most random); style and numbers depend on it too.
    """
    found = []
    for k, least in enumerate(LENGTHS):
        draw = zlib.crc32(b"%d %d" % (seed, k))
        style, number, at, draw = draw % 6, draw // 6 % 4, draw // 24 % len(words), draw // 24
        token, separator, j = "", ("-", "_", "/", "", "", "")[style], 0
        while len(token) < least:
            word = words[(at + j) % len(words)]
            word = word.upper() if style == 5 else word[:1].upper() + word[1:].lower() if style == 3 else word.lower()
            if number and j % 3 == number - 1:
                word += separator + numbers[(draw + j) % len(numbers)]
            token += word + separator
            j += 1
        encoding, p = battery(token[:least])
        found.append((encoding, least, p))
    return found


def scan_text(text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Spans of known formats as (start, kind's place, kind, end), and the fields of ``TESTED`` and ``STRUCTURED``."""
    spans = []
    lowered = text.lower()
    if any(g in lowered for g in _GUARDS):
        spans += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    spans.sort()
    starts, ends = [x[0] for x in spans], list(accumulate((x[3] for x in spans), max))
    tested = []
    for m in _TOKEN.finditer(text):
        before = bisect.bisect_right(starts, m.start())
        if not before or ends[before - 1] < m.end():
            encoding, p = battery(m.group())
            tested.append((m.start(), m.end(), encoding, length_class(m.end() - m.start()), p))
    words = _WORD.findall(text)
    return spans, tested, structured(words, _NUMBER.findall(text) or ["2024"], zlib.crc32(text.encode("utf-8", "replace"))) if words else []


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [scan_text(t or "") for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"],
            "known": [[{"start": s, "place": o, "kind": k, "end": e} for s, o, k, e in known] for known, _, _ in found],
            "tested": [[{"start": s, "end": e, "encoding": c, "length_class": n, "p": p} for s, e, c, n, p in tested] for _, tested, _ in found],
            "structured": [[{"encoding": c, "length_class": n, "p": p} for c, n, p in own] for _, _, own in found],
        })


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, known, tested, structured) per document: spans of known formats, tested tokens that none of them covers,
    and structured strings made of the document's words, with their p-values."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        _scan, f"doc_id long, known array<struct<start:int,place:int,kind:string,end:int>>, tested array<{TESTED}>, structured array<{STRUCTURED}>")


def _bin(p: Column) -> Column:
    return F.floor(-F.log10(F.greatest(p, F.lit(10.0 ** -LOWEST))) * BINS_PER_DECADE).cast("int")


def _counts(scanned: DataFrame, column: str) -> dict[tuple[str, int], dict[int, int]]:
    """Strings per (encoding, length class) and p-value bin: at most 7 x 5 x 241 numbers, whatever the corpus."""
    rows = scanned.select(F.explode(column).alias("t")).groupBy("t.encoding", "t.length_class", _bin(F.col("t.p")).alias("bin")).count().collect()
    found: dict[tuple[str, int], dict[int, int]] = {}
    for r in rows:
        found.setdefault((r["encoding"], r["length_class"]), {})[r["bin"]] = r["count"]
    return found


def _bin_of(p: float) -> int:
    return math.floor(-math.log10(max(p, 10.0 ** -LOWEST)) * BINS_PER_DECADE)


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[tuple[str, int], int]:
    """Per (encoding, length class), the last p-value bin whose tokens are reported.

    The hypothesis is "structured": a token's level is the share of structured strings of its encoding and length
    class, from all documents and ``BUILT_IN`` ones, that look at least as random. Benjamini-Hochberg runs over the
    levels of all tested tokens of a length class, so that at most ``rate`` of those reported are expected to be structured.
    """
    tokens, strings = _counts(scanned, "tested"), _counts(scanned, "structured")
    for seed in range(BUILT_IN):
        for encoding, size, p in structured(WORDS, [str(1 + seed * 37 % 2999)], seed):
            bins = strings.setdefault((encoding, size), {})
            bins[_bin_of(p)] = bins.get(_bin_of(p), 0) + 1
    cut = {}
    for size in LENGTHS:
        pooled: dict[int, int] = {}
        for (_, n), bins in strings.items():
            if n == size:
                for b, count in bins.items():
                    pooled[b] = pooled.get(b, 0) + count
        levels = []
        for (encoding, n), bins in tokens.items():
            if n != size:
                continue
            own = strings.get((encoding, size), {})
            own = own if sum(own.values()) >= LEAST_STRUCTURED else pooled
            total = sum(own.values())
            levels += [((1 + sum(c for k, c in own.items() if k <= b)) / (1 + total), encoding, b, count) for b, count in bins.items()]
        levels.sort()
        asked, seen, accepted = sum(x[3] for x in levels), 0, 0
        for i, (level, _, _, count) in enumerate(levels):
            seen += count
            if level * asked <= rate * seen:
                accepted = i + 1
        for _, encoding, b, _ in levels[:accepted]:
            cut[encoding, size] = max(cut.get((encoding, size), 0), b)
    return cut


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, spans) per document; spans are (start, place, kind, end), by start, then kind in the order of KINDS.

    Known formats are always kept. A token of 20 or more characters that no known span covers is added as kind
    ``random`` if the battery tells it from structured strings at the false-discovery rate of its length class.
    Offsets are code points, the end exclusive. A null or empty text has no spans; an empty table gives no rows;
    repeated rows get the same spans; other columns are ignored.
    """
    scanned = written(scan(docs))
    cut = thresholds(scanned, rate)

    def random(t: Column) -> Column:
        last = F.lit(-1)
        for (encoding, size), b in sorted(cut.items()):
            last = F.when((t["length_class"] == size) & (t["encoding"] == encoding), F.lit(b)).otherwise(last)
        return _bin(t["p"]) <= last

    added = F.transform(F.filter("tested", random), lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("place"), F.lit("random").alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", F.array_sort(F.concat("known", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
