"""Parquet tables: plain scan and sink, immutable revisions, runs, round-trip check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canvass.scale import prefix_sums


def read_source(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def round_trip(source: DataFrame, path: str) -> DataFrame:
    """Copy a table and report rows and columns of both sides in one row."""
    write_parquet(source, path)
    copy = source.sparkSession.read.parquet(path)
    counts = source.agg(F.count(F.lit(1)).alias("source_rows")).join(
        copy.agg(F.count(F.lit(1)).alias("result_rows"))
    )
    return counts.select(
        "source_rows", "result_rows",
        F.lit(len(source.columns)).alias("source_columns"), F.lit(len(copy.columns)).alias("result_columns"),
    )


class DuplicateResponses(ValueError):
    """A capture holds the same response id twice."""


class EmptyCapture(ValueError):
    """A first import without responses."""


def repeated_responses(responses: DataFrame) -> DataFrame:
    return responses.groupBy("response_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def append_revision(
    responses: DataFrame, root: str, project_id: str, revision_id: str, *, first_import: bool = False
) -> None:
    """Write one immutable capture and then its pointer row.

    Rows land in their own ``revision_id=`` folder, which must not exist yet, so a failed write
    or a repeated id never changes what readers see: they follow the pointer written last.
    """
    if first_import and responses.isEmpty():
        raise EmptyCapture(f"{project_id}: the capture has no responses")
    if not repeated_responses(responses).isEmpty():
        raise DuplicateResponses(f"{project_id}: response ids are not unique")
    spark = responses.sparkSession
    write_parquet(responses, f"{root}/responses/project_id={project_id}/revision_id={revision_id}")
    pointer = spark.range(1).select(
        F.lit(project_id).alias("project_id"), F.lit(revision_id).alias("revision_id"),
        F.current_timestamp().alias("written_at"),
    )
    write_parquet(pointer, f"{root}/revisions", mode="append")


def revisions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/revisions")


def current_revision(spark: SparkSession, root: str) -> DataFrame:
    """The revision each project points at: the pointer written last."""
    return revisions(spark, root).groupBy("project_id").agg(
        F.max_by("revision_id", F.struct("written_at", "revision_id")).alias("revision_id")
    )


def read_revision(spark: SparkSession, root: str, project_id: str, revision_id: str) -> DataFrame:
    """Only the folder of this revision is listed and read."""
    return spark.read.parquet(f"{root}/responses/project_id={project_id}/revision_id={revision_id}")


def list_responses(responses: DataFrame) -> DataFrame:
    """Order for a sink: (submitted_at, response_id)."""
    return responses.orderBy("submitted_at", "response_id")


def persist_run(rows: DataFrame, root: str, run_id: str) -> None:
    """Rows with their position in export order, then the header that makes the run visible."""
    indexed = prefix_sums(rows, ["submitted_at", "response_id"], {"row_index": F.lit(1)}).withColumn(
        "row_index", F.col("row_index") - 1
    )
    write_parquet(indexed, f"{root}/run_rows/run_id={run_id}")
    stored = rows.sparkSession.read.parquet(f"{root}/run_rows/run_id={run_id}")
    header = stored.agg(
        F.count(F.lit(1)).alias("final_count"), F.count_if(F.col("origin") == "synthetic").alias("synthetic_count")
    ).withColumn("run_id", F.lit(run_id))
    write_parquet(header, f"{root}/runs", mode="append")


def read_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Run rows by position; a row with an unknown origin fails the read."""
    rows = spark.read.parquet(f"{root}/run_rows/run_id={run_id}")
    checked = F.when(F.col("origin").isin("original", "synthetic"), F.col("origin")).otherwise(
        F.raise_error(F.lit("run row has an invalid origin")).cast("string")
    )
    return rows.withColumn("origin", checked).orderBy("row_index")
