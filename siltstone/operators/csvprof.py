"""Profiles of tables of strings: rows, nulls, distinct values and types of every column."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER, FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def value_type(v: Column) -> Column:
    """null, integer, float or string of one trimmed value."""
    return F.when(v == "", "null").when(v.rlike(INTEGER), "integer").when(v.rlike(FLOAT), "float").otherwise("string")


def column_type(integers: Column, floats: Column, strings: Column) -> Column:
    return F.when(strings > 0, "string").when(floats > 0, "float").when(integers > 0, "integer").otherwise("null")


def profile(table: DataFrame, approximate: bool = False) -> DataFrame:
    """(column_name, column_type, row_count, null_count, unique_count): a row for each column.

    Values are taken as strings, nulls as empty; an empty value is a value of its own among the distinct
    ones. One pass unpivots the columns; the distinct values are found by grouping on (column,
    value), so a frequent value is one partial row for each task. ``approximate`` counts by sketch instead.
    """
    columns = table.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("v")) for c in columns]))
    long = table.select(cells.alias("x")).select("x.*")

    def count(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))

    if approximate:
        long = long.withColumn("kind", value_type(F.col("v"))).withColumn("n", F.lit(1))
        unique = F.approx_count_distinct("v")
    else:
        long = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", value_type(F.col("v")))
        unique = F.count(F.lit(1))
    return long.groupBy("column_name").agg(
        column_type(count("integer"), count("float"), count("string")).alias("column_type"),
        F.sum("n").cast("bigint").alias("row_count"), count("null").cast("bigint").alias("null_count"), unique.cast("bigint").alias("unique_count"),
    )


def summary(table: DataFrame) -> DataFrame:
    """One row: column_count and row_count."""
    return table.agg(F.lit(len(table.columns)).cast("bigint").alias("column_count"), F.count(F.lit(1)).alias("row_count"))


def first_rows(table: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return table.orderBy(*order).limit(n)


def long_cells(table: DataFrame, most: int) -> DataFrame:
    """(column_name, n_long): cells of more than so many characters."""
    sums = [F.sum(F.when(F.length(F.col(f"`{c}`").cast("string")) > most, 1).otherwise(0)).alias(c) for c in table.columns]
    one = table.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias("n_long")) for c in table.columns])).alias("x")).select("x.*")


def limits(size_bytes: Column, rows: Column) -> Column:
    """reject, warn or ok for a table file."""
    from siltstone import registry as R

    mb = size_bytes / (1024 * 1024)
    return F.when((mb > R.CSV_HARD_MB) | (rows > R.CSV_HARD_ROWS), "reject").when((mb > R.CSV_SOFT_MB) | (rows > R.CSV_SOFT_ROWS), "warn").otherwise("ok")


def xml_records(text: str) -> tuple[list[str], list[list[str]]]:
    """Columns (those of the first record) and rows of an XML table."""
    try:
        records = list(ET.fromstring(text))
    except ET.ParseError:
        return [], []
    if not records:
        return [], []
    columns = list(dict.fromkeys(c.tag for c in records[0]))
    return columns, [[(r.findtext(c) or "").strip() for c in columns] for r in records]
