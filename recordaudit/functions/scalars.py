"""Column expressions: time parts, minute arithmetic, labels, names and small formulas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LATE_MINUTES = 15
DATETIME_TYPES = ("timestamp", "timestamp_ntz")


def quarter(ts) -> Column:
    return F.quarter(ts)


def iso_weekday(ts) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(ts) + 1


def plus_minutes(ts, minutes) -> Column:
    """Timestamp plus a possibly fractional number of minutes; null if either is null."""
    zero = F.lit(0)
    return F.col(ts) + F.make_dt_interval(zero, zero, zero, F.col(minutes) * 60)


def delay_label(delta) -> Column:
    """1.0 when at least 15 minutes late, 0.0 when less, null when unknown."""
    delta = F.col(delta)
    return F.when(delta >= LATE_MINUTES, 1.0).when(delta.isNotNull(), 0.0)


def epoch_seconds(ts) -> Column:
    """Seconds since 1970 in UTC, floored toward minus infinity."""
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def epoch_micros(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def as_number(name: str, data_type: str) -> Column:
    """Numeric or datetime column as a double (datetimes as epoch seconds with fraction)."""
    if data_type in DATETIME_TYPES:
        return epoch_micros(name) / F.lit(1e6)
    return F.col(name).cast("double")


def round_pct(part, whole) -> Column:
    """Percentage with one decimal, ties to even."""
    return F.bround(part / whole * 100, 1)


def display_name(name) -> Column:
    """Plot label of a model name: default and optimised variants, plain GC and real."""
    name = F.col(name) if isinstance(name, str) else name
    return (
        F.when(name.startswith("Default "),
               F.concat(F.lit("$"), F.replace(name, F.lit("Default "), F.lit("")), F.lit("$")))
        .when(name.startswith("Optimal "),
              F.concat(F.lit("$"), F.replace(name, F.lit("Optimal "), F.lit("")), F.lit("_{opt.}$")))
        .when(name.isin("GC", "real"), F.concat(F.lit("$"), name, F.lit("$")))
        .otherwise(name)
    )


def is_optimised(name) -> Column:
    return F.col(name).startswith("Optimal")


def speed_score(epochs, embedding_dim) -> Column:
    return F.lit(1.0) / (F.col(epochs) * F.col(embedding_dim) / F.lit(10000.0))


def normalised_mcc(mcc) -> Column:
    """Move a correlation from [-1, 1] to [0, 1]."""
    return (F.col(mcc) + 1) / 2


def variant_type(name) -> Column:
    """``synthesizer_TVAE_diversions_optimal_V0`` → ``tvae``."""
    return F.lower(F.split(F.col(name), "_").getItem(1))


def variant_state(name) -> Column:
    return F.lower(F.split(F.col(name), "_").getItem(3))


HASH_BITS = 52


def hash_bits(seed, *parts) -> Column:
    """The first 52 bits of an md5 of the parts and the seed.

    Depends on the row's own values only, so any partitioning and any retry gives the same number.
    """
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_uniform(seed, *parts) -> Column:
    """The same bits as a uniform number in [0, 1)."""
    return hash_bits(seed, *parts) / F.lit(float(2 ** HASH_BITS))
