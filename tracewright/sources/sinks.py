"""What is exported from drawings: CSV files as spreadsheets read them, one file a drawing, and a JSON report for each drawing. Spark's writers commit whole folders, so a lost executor leaves no half file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_rules import csv_cell

BOM = "﻿"


def write_csv(rows: DataFrame, cells: list[str], header: list[str], drawings: DataFrame, path: str) -> None:
    """Write one file for each of ``drawings`` (doc) below ``path``/doc=...: a byte order mark, the header and the ``cells`` of its ``rows`` (doc, place, ...) in the order of place,
    quoted where needed, each line ended by CR and LF. Null cells are empty, a drawing without rows has the header only, rows of no drawing are left out; rows with equal places go by their line.
    A drawing's lines are sorted in one task, as they end in one file; drawings are dealt over the tasks."""
    line = F.concat_ws(",", *[csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells])
    lines = rows.select("doc", F.col("place").cast("long").alias("place"), line.alias("value")).join(drawings.select("doc").distinct(), "doc", "left_semi")
    top = drawings.select("doc").distinct().select("doc", F.lit(None).cast("long").alias("place"), F.lit(BOM + ",".join(header)).alias("value"))
    # by a hash of its own: a shuffle by doc itself may be left out, as the union's sides are dealt by doc, before one of them is replaced by a broadcast join
    lines = lines.unionByName(top).repartition(F.xxhash64("doc")).sortWithinPartitions("doc", F.col("place").asc_nulls_first(), "value")
    lines.select("doc", "value").write.partitionBy("doc").option("lineSep", "\r\n").text(path)


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc, content): the bytes of the files that ``write_csv`` left."""
    return spark.read.format("binaryFile").load(path).select(F.col("doc").cast("long").alias("doc"), "content")


def _ordered(place: str, *of: Column) -> Column:
    """The structs of a group in the order of ``place``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.struct(*of).alias("x")))), lambda r: r["x"])


def _pages(c: str) -> Column:
    """Page numbers joined by blanks, as an array."""
    return F.transform(F.filter(F.split(F.col(c), " "), lambda p: p != ""), lambda p: p.cast("long"))


def reports(drawings: DataFrame, nets: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, report): for each of ``drawings`` (doc, file) a JSON object of its file, nets and components. ``nets`` (doc, place, net, type, labels, pages) and ``parts`` (doc, place, ref, values, pages)
    come as the lists hold them, values an array. A drawing without nets or parts has empty lists. A report is gathered by the drawing's key; no drawing reaches the driver."""
    n = nets.groupBy("doc").agg(_ordered("place", F.col("net").alias("name"), (F.col("type") == "power").alias("power"), F.col("labels").alias("labelCount"), _pages("pages").alias("pages")).alias("nets"))
    c = parts.groupBy("doc").agg(_ordered("place", "ref", "values", _pages("pages").alias("pages")).alias("components"))
    j = drawings.select("doc", "file").join(n, "doc", "left").join(c, "doc", "left")
    empty = lambda df, col: F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType))
    return j.select("doc", F.to_json(F.struct("file", empty(n, "nets").alias("nets"), empty(c, "components").alias("components"))).alias("report"))


def write_reports(report: DataFrame, path: str, files: int = 0) -> None:
    """Write ``report`` as JSON lines, one drawing a line, in as many files as tasks, or in ``files`` of them."""
    (report.repartition(files, "doc") if files else report).select("report").write.text(path)
