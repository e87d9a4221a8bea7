"""Joins with a dictionary of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_lookup(rows: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """D2. Add ``<name>_id`` from the dictionary (name, id); an unknown name fails the job.

    Of several entries of a name the one with the largest id counts, so that rows never multiply.
    """
    pairs = dictionary.groupBy(F.col("name").alias(name)).agg(F.max("id").alias("_id"))
    message = F.concat(F.lit(f"unknown {name}: "), F.coalesce(F.col(name), F.lit("NULL")))
    known = F.when(F.col("_id").isNull(), F.raise_error(message)).otherwise(F.col("_id"))
    return rows.join(pairs, name, "left").withColumn(f"{name}_id", known).drop("_id")


def unknown_names(rows: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """D2. The rows that ``strict_lookup`` would reject."""
    return rows.join(dictionary.select(F.col("name").alias(name)), name, "left_anti")
