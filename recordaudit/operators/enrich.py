"""Dimensions taken from history, and the columns that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordaudit.functions.scalars import delay_label, iso_weekday, plus_minutes, quarter
from recordaudit.operators.prep import project_order
from recordaudit.session import written
from recordaudit.sources.schema import Relations

PLACE = "place_id"


def route_dimension(history: DataFrame, rel: Relations) -> DataFrame:
    """Distinct (origin, destination, distance)."""
    return history.select(rel.origin, rel.destination, rel.distance).distinct()


def route_distance_unique(history: DataFrame, rel: Relations) -> DataFrame:
    """One row: does every route have exactly one (known) distance?"""
    per_route = route_dimension(history, rel).groupBy(rel.origin, rel.destination).agg(
        F.count(rel.distance).alias("n"))
    return per_route.agg(F.count("*").alias("routes"), F.bool_and(F.col("n") == 1).alias("is_unique"))


def place_columns(df: DataFrame, rel: Relations, prefix: str, id_column: str) -> DataFrame:
    """Rename one role's columns to role-neutral names."""
    return df.withColumnsRenamed(
        {id_column: PLACE, **{rel.place_column(prefix, a): a for a in rel.place_attributes}})


def airport_dimension(history: DataFrame, rel: Relations) -> DataFrame:
    """One row per place from origins and destinations; origin rows win, then the smallest text.

    Both sides come from one scan. ``distinct`` shrinks the history to a few rows per place on the map side (hash aggregation),
    so the pick of the first row works on a small table.
    """
    sides = [
        F.struct(F.lit(rank).alias("_side"), F.col(id_column).alias(PLACE),
                 *[F.col(rel.place_column(prefix, a)).alias(a) for a in rel.place_attributes])
        for rank, (prefix, id_column) in enumerate(
            ((rel.origin_prefix, rel.origin), (rel.destination_prefix, rel.destination)))]
    versions = history.select(F.inline(F.array(*sides))).distinct()
    first = F.min(F.struct("_side", *rel.place_attributes)).alias("place")
    return versions.groupBy(PLACE).agg(first).select(PLACE, "place.*").drop("_side")


def join_routes(df: DataFrame, routes: DataFrame, rel: Relations) -> DataFrame:
    """Add the distance; a route with several distances gives several rows."""
    return df.join(routes, [rel.origin, rel.destination], "left")


def join_places(df: DataFrame, places: DataFrame, rel: Relations, prefix: str, id_column: str) -> DataFrame:
    """Add one role's place attributes."""
    role = places.withColumnsRenamed(
        {PLACE: id_column, **{a: rel.place_column(prefix, a) for a in rel.place_attributes}})
    return df.join(role, id_column, "left")


def valid_routes(df: DataFrame, routes: DataFrame, rel: Relations) -> DataFrame:
    """Rows whose route occurs in history."""
    known = routes.where(F.col(rel.distance).isNotNull()).select(rel.origin, rel.destination).distinct()
    return df.join(known, [rel.origin, rel.destination], "left_semi")


def novel_routes(df: DataFrame, routes: DataFrame, rel: Relations) -> DataFrame:
    """Rows whose route never occurred."""
    known = routes.where(F.col(rel.distance).isNotNull()).select(rel.origin, rel.destination).distinct()
    return df.join(known, [rel.origin, rel.destination], "left_anti")


def add_calendar(df: DataFrame, rel: Relations) -> DataFrame:
    return df.withColumns({rel.quarter: quarter(rel.scheduled), rel.weekday: iso_weekday(rel.scheduled)})


def add_timeline(df: DataFrame, rel: Relations) -> DataFrame:
    """Later points in time, each a start plus minutes, in declared order."""
    for name, start, minutes in rel.timeline:
        df = df.withColumn(name, plus_minutes(start, minutes))
    return df


def add_delay_labels(df: DataFrame, rel: Relations) -> DataFrame:
    return df.withColumns({name: delay_label(delta) for name, delta in rel.delay_labels})


def history_dimensions(history: DataFrame, is_route_history: Column, rel: Relations):
    """Routes (from the rows that qualify) and places, from one scan of the history.

    The distinct versions of a route with its place attributes are written once; both dimensions
    are then taken from that small table and written, so joins see their true size.
    """
    names = [rel.origin, rel.destination, rel.distance]
    names += [rel.place_column(p, a) for p in (rel.origin_prefix, rel.destination_prefix)
              for a in rel.place_attributes]
    versions = written(history.select(*names, is_route_history.alias("_flown")).distinct())
    return (written(route_dimension(versions.where("_flown"), rel)), written(airport_dimension(versions, rel)))


def enrich(df: DataFrame, routes: DataFrame, places: DataFrame, rel: Relations, keep=()) -> DataFrame:
    """All related columns in declared order; rows keep an unknown distance as null."""
    full = add_calendar(df, rel)
    full = join_routes(full, routes, rel)
    full = join_places(full, places, rel, rel.origin_prefix, rel.origin)
    full = join_places(full, places, rel, rel.destination_prefix, rel.destination)
    full = add_delay_labels(add_timeline(full, rel), rel)
    return project_order(full, [*keep, *rel.output])


def enrich_and_clean(df: DataFrame, routes: DataFrame, places: DataFrame, rel: Relations,
                     keep=()) -> DataFrame:
    """Enrich, then drop rows whose route has no known distance."""
    return enrich(df, routes, places, rel, keep).dropna(subset=[rel.distance])
