"""Column roles of a record table, read from a metadata document or declared in code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

# Semantic types that carry location text and are left out of quality scores.
LOCATION_TYPES = ("city", "state", "state_abbr")


@dataclass(frozen=True)
class Spec:
    """Which column plays which role. All operators take names from here."""

    key: str
    model: str
    label: str
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    datetime: tuple[str, ...]
    location: tuple[str, ...] = ()

    def scored(self) -> tuple[str, ...]:
        return self.categorical + self.datetime + self.numeric

    def only(self, columns) -> "Spec":
        """The same roles restricted to the given columns."""
        keep = set(columns)

        def cut(names):
            return tuple(n for n in names if n in keep)

        return Spec(self.key, self.model, self.label, cut(self.categorical), cut(self.numeric),
                    cut(self.datetime), cut(self.location))


@dataclass(frozen=True)
class Relations:
    """How related columns follow from the generated ones."""

    origin: str
    destination: str
    distance: str
    scheduled: str
    place_attributes: tuple[str, ...]
    origin_prefix: str
    destination_prefix: str
    timeline: tuple[tuple[str, str, str], ...]
    delay_labels: tuple[tuple[str, str], ...]
    output: tuple[str, ...]
    quarter: str = "quarter"
    weekday: str = "day_of_week"
    place_renames: dict = field(default_factory=dict)

    def place_column(self, prefix: str, attribute: str) -> str:
        return self.place_renames.get((prefix, attribute), f"{prefix}_{attribute}")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata JSON → one row per column: table_name, column_name, sdtype, pii."""
    column = "struct<sdtype:string, datetime_format:string, pii:boolean>"
    schema = f"tables map<string, struct<columns: map<string, {column}>>>"
    document = spark.read.schema(schema).json(path, multiLine=True)
    return (
        document.select(F.explode("tables").alias("table_name", "body"))
        .select("table_name", F.explode("body.columns").alias("column_name", "info"))
        .select("table_name", "column_name", "info.sdtype", "info.pii")
    )


def spec_from_metadata(registry: DataFrame, key: str, model: str, label: str) -> Spec:
    """Build the roles from a metadata table (one row per column of the schema)."""
    rows = registry.select("column_name", "sdtype").collect()
    kinds = {kind: tuple(r.column_name for r in rows if r.sdtype == kind)
             for kind in ("categorical", "numerical", "datetime")}
    location = tuple(r.column_name for r in rows if r.sdtype in LOCATION_TYPES)
    known = ("categorical", "numerical", "datetime", *LOCATION_TYPES)
    unknown = sorted({r.sdtype for r in rows if r.sdtype not in known}, key=str)
    if unknown:
        raise ValueError(f"unknown semantic types: {unknown}")
    return Spec(key, model, label, kinds["categorical"], kinds["numerical"], kinds["datetime"], location)


def tag_schema(df: DataFrame, spec: Spec) -> DataFrame:
    """Attach the semantic type to each field's metadata."""
    kinds = {**{c: "categorical" for c in spec.categorical}, **{c: "numerical" for c in spec.numeric},
             **{c: "datetime" for c in spec.datetime}, **{c: "location" for c in spec.location}}
    return df.select(*[
        F.col(c).alias(c, metadata={"sdtype": kinds[c], "exclude_from_quality": c in spec.location})
        if c in kinds else F.col(c) for c in df.columns])
