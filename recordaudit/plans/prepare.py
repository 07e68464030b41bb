"""From the raw history to the prepared tables, and from a fitted copula to cleaned candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from recordaudit.operators import enrich as en
from recordaudit.operators.copula import Copula, multi_size_sample
from recordaudit.operators.prep import rare_class, simplify
from recordaudit.operators.realism import realism_pct
from recordaudit.operators.similarity import data_validity, quality_before_after
from recordaudit.session import written
from recordaudit.sources.schema import Relations, Spec


@dataclass
class Prepared:
    """All flown rows; rare rows as generated; rare rows with related columns on known routes."""

    flown: DataFrame
    rare_generated: DataFrame
    rare_enriched: DataFrame
    routes: DataFrame
    places: DataFrame


def prepare_tables(raw: DataFrame, is_route_history: Column, generated, dropped, rel: Relations, spec: Spec) -> Prepared:
    flown = written(simplify(raw, spec.label, dropped))
    rare = rare_class(flown, spec.label).select(spec.key, *generated)
    routes, places = en.history_dimensions(raw, is_route_history, rel)
    return Prepared(flown, rare, en.enrich_and_clean(rare, routes, places, rel, [spec.key]), routes, places)


@dataclass
class Sampled:
    """Cleaned candidates of every size, with the checks made on the way."""

    cleaned: DataFrame
    realism: DataFrame
    validity: DataFrame
    quality: DataFrame


def sample_enrich_clean(copula: Copula, real: DataFrame, routes: DataFrame, places: DataFrame, rel: Relations,
                        generated: Spec, spec: Spec, sizes, seed, name: str = "GC") -> Sampled:
    """Draw, check, enrich, clean and score several sizes of one model in one go.

    Sizes are told apart through the model column (``GC 300``), so all are scored together.
    """
    spark = real.sparkSession
    drawn = written(multi_size_sample(spark, copula, sizes, seed).withColumn(
        spec.model, F.concat_ws(" ", F.lit(name), F.col("size").cast("string"))))
    columns = [spec.key, spec.model, *generated.scored()]
    cleaned = written(en.enrich_and_clean(drawn, routes, places, rel, [spec.key, spec.model, "size"]))
    return Sampled(cleaned, realism_pct(drawn.select(columns), routes, rel, spec.model),
                   data_validity(real, drawn.select(columns), generated),
                   quality_before_after(real, drawn.select(columns), cleaned, generated, spec))
