"""Writing records, and keeping state between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.functions.text import indent_json


def record_json(columns: list[Column], indent: bool = False, ascii_only: bool = True) -> Column:
    options = {"ignoreNullFields": "true"}
    if ascii_only:
        options["writeNonAsciiCharacterAsCodePoint"] = "true"
    if indent:
        options["pretty"] = "true"
    return F.to_json(F.struct(*columns), options)


def write_products(products: DataFrame, path: str, indent: bool = False, ascii_only: bool = True,
                   record: Column | None = None) -> int:
    """Append one JSON object per line (or indented); returns the number of records.

    The count rides along with the write, there is no second pass.
    """
    seen = Observation()
    if record is None:
        record = record_json([F.col(c) for c in products.columns], indent, ascii_only)
    lines = products.select(record.alias("value")).observe(seen, F.count("*").alias("n"))
    lines.write.mode("append").text(path)
    return seen.get["n"]


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number: ``file, line_no, value``.

    Files may be split among tasks: a line's number is its rank within its split
    plus the lines in the splits before it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value")
    counts = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("file", "_block").orderBy("_row"))
    return lines.withColumn("_rank", rank).join(offsets, ["file", "_block"]) \
        .select("file", (F.col("_before") + F.col("_rank")).alias("line_no"), "value")


def check_json_lines(lines: DataFrame, number: str = "line_no", value: str = "value") -> DataFrame:
    """Adds ``valid`` and ``report``: the number with the readable object, or a complaint."""
    parsed = F.try_parse_json(F.col(value))
    valid = parsed.isNotNull() & (F.trim(F.col(value)) != "")
    head = F.concat(F.lit("Line "), F.col(number).cast("string"), F.lit(": "))
    # texts that Spark accepts are laid out from their normal form
    pretty = indent_json(F.when(valid, F.to_json(parsed)))
    return lines.withColumns({
        "valid": F.coalesce(valid, F.lit(False)),
        "report": F.concat(head, F.when(valid, pretty).otherwise(F.lit("is not valid JSON"))),
    })


def custom_output(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Any writer as the sink of a stream: called with each batch and its number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def save_run(df: DataFrame, folder: str, run: int) -> None:
    """Keep a table as it is after a run, beside those of other runs: a run that is
    started again replaces its own part and no other."""
    df.write.mode("overwrite").parquet(f"{folder}/run={run}")


def read_run(spark: SparkSession, folder: str, schema: str, run: int | None = None) -> DataFrame:
    """The table as a run left it, the last one by default. Runs are a partition
    column: the others are not read."""
    rows = spark.read.schema(f"{schema}, run INT").parquet(folder)
    if run is None:
        run = rows.agg(F.max("run")).head()[0]
    return rows.filter(F.col("run") == F.lit(run)).drop("run")
