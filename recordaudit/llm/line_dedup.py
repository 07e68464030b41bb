"""Repeated runs of lines: suffix ranks over line-ID sequences by distributed prefix doubling.

A document is its sequence of line IDs (hashes of its non-blank lines without outer white space). Doubling gives every
suffix the rank of its first 1, 2, 4, ... lines in lexicographic order; suffixes of equal rank are an interval of the
suffix array with that common prefix. In each interval the earliest suffix stays and the others are later copies;
together the later copies' prefixes cover exactly the maximal repeated runs that are long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordaudit.session import written

BLANK = " \t\n\x0b\x0c\r"
#: A repeated run is deleted if it has this many lines, or this many words in fewer lines.
MIN_LINES, MIN_WORDS = 3, 20


def text_key() -> Column:
    """Distinguishes rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def id_key() -> Column:
    """doc_id for joins; null ids come before all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63)))


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n, line, h1, h2, words): non-blank lines, n counting them, line their place in the text."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x, F.lit(BLANK)).alias("x"))),
        lambda s: s["x"] != "")
    rows = docs.select(id_key().alias("doc_id"), text_key().alias("tag"), F.posexplode(lines).alias("n", "s"))
    return rows.select(
        "doc_id", "tag", "n", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit("line"), "s.x").alias("h2"),
        F.size(F.split("s.x", r"[\x20\x09-\x0D]+")).alias("words"))


def _ranked(classes: DataFrame, by: list[str]) -> DataFrame:
    """Classes (with ``members``) and their rank: suffixes in smaller classes, by range parts and then within each."""
    parted = written(classes.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    parts = parted.groupBy("part").agg(F.sum("members").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return parted.withColumn("inside", F.coalesce(F.sum("members").over(inside), F.lit(0))).join(offsets, "part").select(
        *by, "members", "first", (F.col("offset") + F.col("inside")).alias("rank"))


def _shared(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """Suffixes with their class's rank and first member, without those that are alone in their class."""
    place = F.struct("doc_id", "tag", "n")
    classes = suffixes.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.min(place).alias("first")).filter("members > 1")
    return suffixes.join(_ranked(classes, by), by).drop(*by, "members")


def _ahead(column: str, steps: int) -> Column:
    """The value ``steps`` lines further if all lines up to there are still shared with other suffixes, else null."""
    order = Window.partitionBy("doc_id", "tag").orderBy("n")
    return F.when(F.lead("n", steps).over(order) == F.col("n") + steps, F.lead(column, steps).over(order))


def suffix_ranks(lines: DataFrame, depth: int) -> dict[int, DataFrame]:
    """Shared suffixes by length of the common prefix: 1, 2, 4, ... below ``depth``, and ``depth`` itself.

    Each has doc_id, tag, n, line, words (of the whole prefix), rank and first (the earliest suffix of the class).
    A suffix that is alone at one length is alone at all greater ones, so the rounds shrink. A length between two
    powers is named by its first and last 2**k lines, which overlap.
    """
    found = {1: written(_shared(lines, ["h1", "h2"]))}
    have = 1
    while have < depth:
        step = min(have, depth - have)
        pairs = found[have].withColumns({
            "r1": F.col("rank"), "r2": _ahead("rank", step),
            # The last ``have`` lines begin ``step`` lines further; words of the lines before them are added.
            "words": F.col("words") + _ahead("words", step),
        }).filter("r2 is not null").drop("rank", "first")
        have += step
        found[have] = written(_shared(pairs, ["r1", "r2"]))
    return found


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tag, lines): places in the text of lines inside a later copy of a repeated run, sorted.

    A run counts if it has ``min_lines`` lines, or fewer with ``min_words`` words together. Order is by doc_id, then
    text, then line. A row that repeats doc_id and text of another is the same document here.
    """
    rows = docs.select("doc_id", "text")
    lines = line_ids(rows)
    again = rows.groupBy(id_key().alias("doc_id"), text_key().alias("tag")).count().filter("count > 1")
    if not again.isEmpty():
        lines = lines.dropDuplicates(["doc_id", "tag", "n"])
    lines = written(lines)
    covered = None
    for length, shared in suffix_ranks(lines, min_lines).items():
        if length > min_lines:
            continue
        copies = shared.filter(F.struct("doc_id", "tag", "n") != F.col("first"))
        if length < min_lines:
            copies = copies.filter(F.col("words") >= min_words)
        part = copies.select("doc_id", "tag", F.explode(F.sequence(F.col("n"), F.col("n") + length - 1)).alias("n"))
        covered = part if covered is None else covered.unionByName(part)
    same = lines.select("doc_id", "tag", "n", "line").join(covered.distinct(), ["doc_id", "tag", "n"], "left_semi")
    return same.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_line, last_line): the maximal deleted runs, by places in the text; blank lines may lie between."""
    place = F.col("lines")
    breaks = later_copies(docs, min_lines, min_words).select(
        "doc_id", "tag", F.posexplode(place).alias("k", "line")).withColumn("run", F.col("line") - F.col("k"))
    return breaks.groupBy("doc_id", "tag", "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).select(
        "doc_id", "first_line", "last_line")


def _without(lines: Column, gone: Column) -> Column:
    """Lines without those at the (sorted) places ``gone``: the slices between them, so the work is linear."""
    after = lambda j: F.coalesce(F.get(gone, j - 1) + 1, F.lit(0))
    piece = lambda j: F.slice(lines, after(j) + 1, F.coalesce(F.get(gone, j), F.size(lines)) - after(j))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), piece))


def drop_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``; adds ``lines_removed``.

    Rows stay as they are and in number; a null text stays null. Texts without repeats are unchanged, others are
    their remaining lines joined by newlines (blank lines stay). Null doc_ids are a document each text. Repeated
    rows lose the same lines. An empty table gives an empty result. A column ``lines_removed`` is replaced.
    """
    gone = later_copies(docs, min_lines, min_words).select(
        F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag"), F.col("lines").alias("gone_lines"))
    rows = docs.select(F.struct("*").alias("row"), id_key().alias("id"), text_key().alias("key"), "text")
    joined = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("key") == F.col("gone_tag")), "left")
    lines = F.split("text", "\n")
    text = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(_without(lines, F.col("gone_lines")), "\n"))
    removed = F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long")
    row = F.col("row").withField("text", text).withField("lines_removed", removed)
    return joined.select(row.alias("row")).select("row.*")
