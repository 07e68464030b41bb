"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows read to estimate costs and selectivities; the order they give never changes a verdict.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a bad text; ``cost`` estimates its work in elements visited. Both may use ``metrics``."""

    name: str
    rejects: Column
    cost: Column


def _without(column: Column, characters: str) -> Column:
    return F.translate(column, characters, "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: _without(x, BLANK) != "")


def metrics(docs: DataFrame) -> DataFrame:
    """Adds text measures as columns starting with ``m_``; a null text is an empty one. Keeps all columns and rows.

    Words in 3-word windows found twice or more: windows are hashed; if a text has equal hashes, each hash is put
    above its place in one number, so that a sort of plain numbers brings equal windows together. Neighbours
    are compared by their whole hashes. Every step is linear or a sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("m_words", F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    windows = F.transform(F.sequence(F.lit(0), F.size("m_words") - 3),
                          lambda i: F.xxhash64(F.get("m_words", i), F.get("m_words", i + 1), F.get("m_words", i + 2)))
    df = df.withColumns({
        "m_n_words": F.size("m_words").cast("long"),
        "m_word_chars": F.length(_without(text, BLANK)).cast("long"),
        "m_n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "m_lines": _lines(text),
        "m_hashes": F.when(F.size("m_words") >= 4, windows),
        "m_bits": F.ceil(F.log2(F.size("m_words") + 1)).cast("int"),
    })
    df = df.withColumn("m_repeats", F.size(F.array_distinct("m_hashes")) < F.size("m_hashes"))
    placed = F.transform("m_hashes", lambda h, i: F.call_function("shiftleft", h, F.col("m_bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("m_sorted", F.when(F.col("m_repeats"), F.sort_array(placed)))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m_bits")) - 1).cast("int")
    whole = lambda x: F.get("m_hashes", place(x))
    same = lambda x, i: (whole(x) == whole(F.get("m_sorted", i - 1))) | (whole(x) == whole(F.get("m_sorted", i + 1)))
    df = df.withColumns({
        "m_n_lines": F.size("m_lines").cast("long"),
        "m_n_dup_lines": (F.size("m_lines") - F.size(F.array_distinct("m_lines"))).cast("long"),
        "m_places": F.sort_array(F.transform(F.filter("m_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), place)),
    })
    covered = F.aggregate(
        F.transform("m_places", lambda p, i: F.least(F.lit(3), F.get("m_places", i + 1) - p)), F.lit(0), lambda a, x: a + x)
    return df.withColumn("m_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "m_hashes", "m_bits", "m_repeats", "m_sorted", "m_places", "m_lines")


def base_failed() -> Column:
    """Under 50 words, or more than half of the words in repeated 3-word windows."""
    return (F.col("m_n_words") < 50) | (F.col("m_n_repeat_words") * 100 > F.col("m_n_words") * 50)


def default_rules() -> list[Rule]:
    """Published web-text heuristics, stated on the measures; costs are elements that each rule has to visit."""
    words, text = F.col("m_words"), F.coalesce(F.col("text"), F.lit(""))
    letters = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    return [
        Rule("symbols", F.col("m_n_symbols") * 10 > F.col("m_n_words"), F.lit(1.0)),
        # A share says little about a few lines: three repeats at least.
        Rule("duplicate lines", (F.col("m_n_dup_lines") >= 3) & (F.col("m_n_dup_lines") * 10 > F.col("m_n_lines") * 3), F.lit(1.0)),
        Rule("word length", (F.col("m_word_chars") < F.col("m_n_words") * 3) | (F.col("m_word_chars") > F.col("m_n_words") * 12), F.lit(1.0)),
        Rule("shouting", F.length(_without(text, "".join(map(chr, range(65, 91))))) * 2 < F.length(text), F.length(text).cast("double")),
        Rule("words without letters", letters * 10 < F.col("m_n_words") * 7, F.col("m_word_chars").cast("double")),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per unit of cost on about ``sample_rows`` rows; ties by name.

    The measures are made for the sampled rows only. Only the order depends on them; the verdict is a
    conjunction and has the same value in any order.
    """
    rows = docs.select("doc_id").count()
    sample = metrics(docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=7))
    row = sample.agg(*[
        c for i, r in enumerate(rules) for c in (
            F.avg(F.coalesce(r.rejects, F.lit(False)).cast("double")).alias(f"r{i}"), F.avg(r.cost).alias(f"c{i}"))
    ]).first()
    gain = {r.name: (row[f"r{i}"] or 0.0) / max(row[f"c{i}"] or 1.0, 1e-9) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, null if none does; later rules aren't evaluated."""
    verdict = None
    for rule in rules:
        verdict = F.when(rule.rejects, rule.name) if verdict is None else verdict.when(rule.rejects, rule.name)
    return verdict if verdict is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents with measures, ``m_base_failed`` and ``m_rejected_by`` (null: keep).

    The base rules come first, as they need no further work; the others follow in the sampled order and are
    evaluated only for texts that none before rejected. Row by row, without a shuffle. A null text counts as
    empty and fails; repeated rows get the same verdict; an empty table gives an empty result. Columns of the
    input that start with ``m_`` are replaced, all others are kept.
    """
    measured = metrics(docs)
    chosen = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    first = Rule("base", base_failed(), F.lit(0.0))
    return measured.withColumn("m_base_failed", base_failed()).withColumn("m_rejected_by", cascade([first, *chosen]))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with the columns of ``docs``.

    A generator drops the rows: a filter would be pushed below the measures and compute them again inside it.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    kept = F.when(F.col("m_rejected_by").isNull(), F.array("row"))
    return judge(rows).select(F.inline(kept))
