"""Reading and writing whole tables, variant sets, result folders and trial logs."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

VARIANT_KEYS = ("model", "state", "size")
#: The scheme of a path and the slashes after it.
SCHEME = r"^([A-Za-z0-9+.-]+:)?/+"
SCORES = ("realism", "overall_sim", "fidelity", "utility")


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sink_table(df: DataFrame, path: str, partition_by=VARIANT_KEYS, mode: str = "errorifexists") -> None:
    """Write a table; variant sets are partitioned so that one variant is read by pruning."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def scan_variants(spark: SparkSession, path: str, models=None, states=None, sizes=None) -> DataFrame:
    """Read candidate sets by model, state and size; names that do not exist raise.

    The names are those of the partition folders, taken from the paths of the table's files: nothing is read.
    """
    table = spark.read.parquet(path)
    kinds = dict(table.dtypes)
    known_names: dict[str, set] = {name: set() for name in VARIANT_KEYS}
    for file in table.inputFiles():
        for part in unquote(file).split("/"):
            name, _, value = part.partition("=")
            if name in known_names:
                known_names[name].add(int(value) if kinds[name] in ("int", "bigint") else value)
    for name, wanted in zip(VARIANT_KEYS, (models, states, sizes)):
        if wanted is None:
            continue
        known = known_names[name]
        unknown = sorted(set(wanted) - known, key=str)
        if unknown:
            raise ValueError(f"unknown {name} values: {unknown}; known: {sorted(known, key=str)}")
        table = table.where(F.col(name).isin(list(wanted)))
    return table


def scan_result_dir(spark: SparkSession, folder: str) -> DataFrame:
    """Read a folder of results as one table, stacked by column name; ``file_no`` is each result's place in name order.

    A result is a Parquet file in the folder or a folder of part files. There is one scan however many results there are;
    its listing gives the names, the file's metadata column tells the rows apart. A column that a result lacks is null.
    """
    table = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(folder)
    plain = lambda path: re.sub(SCHEME, "", unquote(path)).strip("/")  # noqa: E731  listed paths have a scheme, the given one may not
    files = {plain(file) for file in table.inputFiles()}
    own = {file: file.split(plain(folder) + "/", 1)[-1].split("/")[0] for file in files}
    place = {name: i for i, name in enumerate(sorted(set(own.values())))}
    numbers = spark.createDataFrame([(file, place[name]) for file, name in own.items()], "_file string, file_no int")
    # One row per file; Spark joins it as its size asks for. A plus sign in a path is no space.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return table.withColumn("_file", F.regexp_replace(path, SCHEME, "")).join(numbers, "_file").drop("_file")


def scan_trials(trials: DataFrame, value: str = "value", scores=SCORES) -> DataFrame:
    """Finished trials only; a score that was not logged counts as 0."""
    done = trials.where(F.col(value).isNotNull())
    return done.withColumns({s: F.coalesce(F.col(s), F.lit(0.0)) for s in scores})


def export_per_model(df: DataFrame, path: str, model: str = "model", mode: str = "errorifexists") -> None:
    """One CSV folder per model."""
    df.write.mode(mode).partitionBy(model).csv(path, header=True)
