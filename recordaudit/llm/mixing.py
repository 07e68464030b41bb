"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

There may be as many sources as documents (hosts, say): ranks and prefix sums over sources and seats go by range
parts, so that no window holds all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordaudit.session import written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
EPOCHS = 3
BLOCK = 4
SHARDS = 8
SEED = "mix-1"
#: Leading hex digits of the seeded key cut a source into parts for the prefix sums: enough for this many rows a part.
PART_ROWS = 4096


def _with_sums(rows: DataFrame, by: list[Column], sums: dict[str, Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sums over all rows before this one in the order ``by`` (no ties; ``within`` comes first in it).

    Rows are cut into range parts; a part's sums are added to the sums inside it. The result is a written table.
    """
    parted = written(rows.repartitionByRange(*[F.col(c) for c in within], *by).withColumn("range_part", F.spark_partition_id()))
    before_part = Window.partitionBy(*within).orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    before_row = Window.partitionBy("range_part", *within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("range_part", *within).agg(*[F.sum(c).alias(f"{name}_of_part") for name, c in sums.items()]).select(
        "range_part", *within, *[F.coalesce(F.sum(f"{name}_of_part").over(before_part), F.lit(0)).alias(f"{name}_at") for name in sums])
    inside = parted.select("*", *[F.coalesce(F.sum(c).over(before_row), F.lit(0)).alias(f"{name}_in") for name, c in sums.items()])
    added = inside.join(parts, ["range_part", *within]).withColumns({name: F.col(f"{name}_at") + F.col(f"{name}_in") for name in sums})
    return written(added.drop("range_part", *[f"{name}_{end}" for name in sums for end in ("at", "in")]))


def _long(value) -> Column:
    return F.lit(value or 0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Target words per source: a weighted share of all words, stopped at ``epochs`` times the source's size.

    ``sizes`` has one row per source (source, source_size). Sources by code point, null last, weigh ``weights``
    in turn. What a stopped source cannot take is shared among the others by weight, until none is above its
    limit: with sources in the order of limit / weight, the stopped ones come first, so one pass finds them.
    """
    ranked = _with_sums(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], {"ahead": F.lit(1)})
    sources = (
        ranked.withColumn("rank", F.col("ahead") + 1)
        .withColumn("weight", F.element_at(F.lit(list(weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("limit", F.col("source_size") * epochs).withColumn("reached_at", F.col("limit") / F.col("weight"))
    )
    summed = _with_sums(sources, [F.col("reached_at"), F.col("rank")], {"limits": F.col("limit"), "weights": F.col("weight")})
    every = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    found = (
        summed.withColumn("rest", _long(every["size"]) - F.col("limits")).withColumn("shares", _long(every["weight"]) - F.col("weights"))
        .withColumn("stopped", F.col("limit") * F.col("shares") <= F.col("rest") * F.col("weight"))
    )
    free = found.filter(~F.col("stopped")).agg(F.min(F.struct("reached_at", "rank", "rest", "shares")).alias("least")).first()["least"]
    rest, shares = (free["rest"], free["shares"]) if free else (0, 1)
    return found.select(
        "source", "source_size", "rank",
        F.when(F.col("stopped"), F.col("limit").cast("double"))
        .otherwise((_long(rest) * F.col("weight")).cast("double") / _long(shares).cast("double")).alias("target"),
    )


def quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Blocks each source has given after each shard: (shard, source, rank, ..., blocks so far).

    Seat k of a source has the quotient target / (2k - 1); the first m seats by quotient (then by source) are
    the apportionment of m blocks. Seats far from m * target / total are certain, so only those around it are
    ranked: four to six per source on average, however many blocks there are. Since m seats are always among
    the first m + 1, the blocks of shard i are the difference of two of these numbers, each an integer.
    """
    sources = written(sources)
    every = sources.agg(F.sum(F.col("target").cast("decimal(38,6)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n")).first()
    total = round(every["total"] or 0.0, 3)  # targets share a whole number of words
    all_blocks = math.floor(total / block + 0.5)
    seats = (
        sources.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("m", F.floor(_long(all_blocks) * F.col("shard") / shards))
        .withColumn("share", F.col("target") / F.lit(total) if total > 0 else F.lit(0.0))
        .withColumn("about", F.floor(F.col("m") * F.col("share") + 0.5))
        .withColumn("spread", F.ceil(2 * _long(every["n"]) * F.col("share")) + 2)
        .withColumn("certain", F.greatest(F.col("about") - F.col("spread"), F.lit(0)))
    )
    taken = {r["shard"]: r["m"] - r["certain"] for r in seats.groupBy("shard", "m").agg(F.sum("certain").alias("certain")).collect()}  # a row per shard
    left = F.element_at(F.lit([taken.get(shard, 0) for shard in range(1, shards + 1)]).cast("array<long>"), F.col("shard"))
    open_seats = seats.withColumn("seat", F.explode(F.sequence(F.col("certain") + 1, F.col("about") + F.col("spread")))).withColumn(
        "below", -(F.col("target") / (2 * F.col("seat") - 1)))
    ranked = _with_sums(open_seats, [F.col("below"), F.col("rank"), F.col("seat")], {"ahead": F.lit(1)}, within=("shard",))
    return ranked.groupBy("shard", "source", "rank", "source_size", "target").agg(
        (F.min("certain") + F.sum(F.when((F.col("ahead") < left) & (F.col("target") > 0), 1).otherwise(0))).alias("blocks")
    )


def _up_to(x: Column, length: Column, start: Column, size: Column) -> Column:
    """Words of [start, start + size) among the first x words of a stream that repeats after ``length``."""
    return F.floor(x / length) * size + F.least(F.greatest(x % length - start, F.lit(0)), size)


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
        seed: str = SEED) -> DataFrame:
    """Words each document gives to the mix.

    ``docs`` needs doc_id, text and source; other columns are ignored. A source's documents, in a seeded order,
    form a stream of words that repeats; it is cut into blocks of ``block`` words from a seeded start, and the
    shards take the source's quota of blocks one after the other. Returns one row per input row: doc_id, source,
    size, source_size, target, taken (words, repeats counted) and shard_words (array of shard and words).

    Nulls: a null text has size 0, null is a source of its own, null doc_ids are ordered by their size. Repeated
    rows are taken as often as they occur. An empty table gives an empty result; a source of size 0 gives none.
    No word is taken more than ``epochs`` times. The result depends on rows and seed only, not on partitions.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = written(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), key.alias("key")))
    digits = max(1, math.ceil(math.log(max(1, sized.count() / PART_ROWS), 16)))
    sized = sized.withColumn("part", F.substring("key", 1, digits))

    # Prefix sums in two levels: parts of a source, then rows of a part, so that no window holds a source.
    parts = written(sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).select(
        F.col("source").alias("p_source"), F.col("part").alias("p_part"), "part_start")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    given = quotas(sources, block, shards).withColumn("taken_so_far", F.least(F.col("blocks") * block, F.col("source_size") * epochs))
    plan = given.groupBy(F.col("source").alias("q_source"), "source_size", "target").agg(
        F.array_sort(F.collect_list(F.struct("shard", "taken_so_far"))).alias("steps"))
    # The seeded start is a whole block of the source's stream.
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("q_source", F.lit("")))), 1, 12), 16, 10).cast("long"),
                   F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)))
    plan = plan.withColumn("origin", start * block)

    row_before = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("in_part", F.coalesce(F.sum("size").over(row_before), F.lit(0)))
        .join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
        .join(plan, F.col("source").eqNullSafe(F.col("q_source")))
        .withColumn("at", F.col("part_start") + F.col("in_part"))
    )
    upto = lambda x: _up_to(F.col("origin") + x, F.greatest(F.col("source_size"), F.lit(1)), F.col("at"), F.col("size"))
    sums = placed.withColumn("sums", F.transform("steps", lambda s: F.struct(
        s["shard"].alias("shard"), (upto(s["taken_so_far"]) - upto(F.lit(0))).cast("long").alias("words"))))
    return sums.select(
        "doc_id", "source", "size", "source_size", "target",
        F.element_at("sums", -1)["words"].alias("taken"),
        F.filter(F.transform("sums", lambda s, i: F.struct(
            s["shard"].alias("shard"), (s["words"] - F.coalesce(F.get("sums", i - 1)["words"], F.lit(0))).alias("words"))),
            lambda s: s["words"] > 0).alias("shard_words"),
    )
