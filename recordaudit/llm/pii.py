"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters around a span in which context words count.
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``pattern`` matches leftmost and non-overlapping; ``valid`` drops matches (it gets the text).

    ``guard`` is a character without which the pattern can't match, ``score`` the confidence of a valid match,
    ``raised`` and ``lowered`` are beginnings of lower-case context words that move it by 0.2.
    """

    name: str
    pattern: str
    valid: object
    guard: str | None
    score: float
    raised: str
    lowered: str
    base: bool = True


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits: from the right, every second one doubled."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    weighed = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 mod 97-10 as account numbers use it: first four characters to the end, letters as 10 to 35, rest 1."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    code = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    step = lambda a, i: F.when(code(i) < 58, a * 10 + code(i) - 48).otherwise(a * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _valid_ip(match: Column) -> Column:
    # Leading zeros go first, so that a part of any length can be read as a number.
    plain = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(match, "\\."), lambda p: (F.length(plain(p)) <= 3) & (
        F.concat(F.lit("0"), F.substring(plain(p), 1, 3)).cast("int") <= 255))


def _valid_card(match: Column) -> Column:
    return F.when(F.length(_digits(match)).between(12, 19), luhn(_digits(match))).otherwise(False)


# The patterns are those of the contract, written so that Java's matcher stays linear and iterative: possessive
# where what follows can't start with the repeated class, and no attempt inside a run that the run's start has
# already failed (\G allows one after a match that ends within a run).
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "@", 0.8,
         "e?mail|contact|write|reach|address", "example|noreply"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _valid_ip, ".", 0.6, "ip(?![a-z])|host|server|address|login", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", _valid_card, None, 0.7, "card|visa|master|credit|payment|expir", "order|serial|isbn|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), "+", 0.6, "phone|call|tel(?:ephone)?(?![a-z])|mobile|fax|contact", "score|total"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
         lambda m: F.when(F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34), mod97(F.replace(m, F.lit(" "), F.lit("")))).otherwise(False), None, 0.9,
         "iban|account|bank|konto|cuenta|compte", "serial", base=False),
)


#: Code points of the chunks from which parts of a long text are read.
CHUNK = 1024


def _blocked(n: Column, kind: str, step) -> Column:
    """Array of ``n`` elements of type ``kind`` by a running sum: ``step(at, i)`` is the element and the next ``at``.

    An aggregate copies its state for every element; so the elements are made in blocks of about sqrt(n).
    """
    state = f"struct<at:int,found:array<{kind}>>"
    width = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")

    def block(done: Column, b: Column) -> Column:
        seed = F.struct(F.element_at(done, -1)["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("found")).cast(state)

        def inner(s: Column, i: Column) -> Column:
            element, at = step(s["at"], i)
            return F.struct(at.cast("int").alias("at"), F.concat(s["found"], F.array(element).cast(f"array<{kind}>")).alias("found")).cast(state)

        return F.concat(done, F.array(F.aggregate(F.sequence(b * width, F.least(n, (b + 1) * width) - 1), seed, inner)))

    first = F.array(F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found")).cast(state))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), first, block)
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda s: s["found"]))).otherwise(F.array().cast(f"array<{kind}>"))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` code points from the place ``start`` (from 0) on, read from the chunks they lie in alone."""
    first = F.floor(start / CHUNK).cast("int")
    wide = F.floor((start + length) / CHUNK).cast("int") - first + 1
    return F.when(length > 0, F.substring(F.array_join(F.slice(chunks, first + 1, wide), ""), start - first * CHUNK + 1, length)).otherwise("")


def _located(pieces: Column, matches: Column) -> Column:
    """Start and text of each match: the pieces between matches and the matches alternate."""

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        start, match = at + F.length(F.get(pieces, i)), F.get(matches, i)
        return F.struct(start.alias("start"), match.alias("match")), start + F.length(match)

    return _blocked(F.size(matches), "struct<start:int,match:string>", step)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Documents with ``pii``: array of (start, end, kind, score), by start, then kind in the order of ``kinds``.

    Offsets are code points, the end exclusive. Row by row and without a shuffle. A null or empty text has no
    spans; an empty table gives an empty result; repeated rows get the same spans. All columns are kept except
    that ``pii`` and columns starting with ``pii_`` are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs
    pieces = {k: F.split(text, k.pattern, -1) for k in kinds}
    df = df.withColumns({f"pii_p_{k.name}": F.when(F.contains(text, F.lit(k.guard)), pieces[k]) if k.guard else pieces[k] for k in kinds})
    df = df.withColumns({f"pii_m_{k.name}": F.when(F.size(f"pii_p_{k.name}") > 1, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))) for k in kinds})
    df = df.withColumns({
        f"pii_f_{k.name}": F.when(F.col(f"pii_m_{k.name}").isNotNull(), _located(F.col(f"pii_p_{k.name}"), F.col(f"pii_m_{k.name}"))) for k in kinds})
    df = df.withColumn("pii_chunks", F.when(F.coalesce(*[F.col(f"pii_f_{k.name}") for k in kinds]).isNotNull(), _chunks(text)))
    chunks = F.col("pii_chunks")

    def scored(place: int, k: Kind) -> Column:
        kept = F.col(f"pii_f_{k.name}")
        if k.valid is not None:
            kept = F.filter(kept, lambda s: k.valid(s["match"]))

        def span(s: Column) -> Column:
            end = s["start"] + F.length(s["match"])
            near = F.lower(F.concat(
                _part(chunks, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), F.least(s["start"], F.lit(CONTEXT_CHARS))), F.lit(" "),
                _part(chunks, end, F.lit(CONTEXT_CHARS))))
            word = lambda words: near.rlike(rf"(?<![a-z])(?:{words})")
            score = k.score + F.when(word(k.raised), 0.2).otherwise(0.0) - F.when(word(k.lowered), 0.2).otherwise(0.0)
            return F.struct(s["start"].alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(k.name).alias("kind"),
                            F.least(score, F.lit(1.0)).alias("score"))

        empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,score:double>>")
        return F.coalesce(F.transform(kept, span), empty)

    spans = F.array_sort(F.concat(*[scored(i, k) for i, k in enumerate(kinds)]))
    used = [f"pii_{x}_{k.name}" for k in kinds for x in "pmf"] + ["pii_chunks"]
    return df.withColumn("pii", F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["score"]))).drop(*used)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, names: list[str]) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, [s["kind"] == n for n in names]))


def mask(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Replaces spans with a score of at least ``least`` by [kind]; where spans overlap, the first one wins.

    Rows and columns stay as they are, without ``pii`` and columns starting with ``pii_``. Null and empty texts are unchanged; repeated rows get the same text.
    """
    found = find(docs).withColumn("pii", F.filter("pii", lambda s: s["score"] >= least)).withColumn(
        "pii_chunks", F.when(F.size("pii") > 0, _chunks(F.col("text"))))

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        s = F.get(F.col("pii"), i)
        later = s["start"] >= at
        before = F.concat(_part(F.col("pii_chunks"), at, s["start"] - at), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(later, before).otherwise("").alias("text"), F.when(later, s["end"]).otherwise(at).alias("at")), \
            F.when(later, s["end"]).otherwise(at)

    found = found.withColumn("pii_out", _blocked(F.size("pii"), "struct<text:string,at:int>", step))
    masked = F.concat(F.array_join(F.transform("pii_out", lambda s: s["text"]), ""),
                      F.substring(F.col("text"), F.get("pii_out", F.size("pii_out") - 1)["at"] + 1, F.length("text")))
    whole = found.withColumn("text", F.when(F.size("pii") > 0, masked).otherwise(F.col("text")))
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns if c != "pii" and not c.startswith("pii_")])
