"""LOAD DATA and logical export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_data(spark: SparkSession, path: str, schema: str, sep: str = ",", quote: str = '"', skip: int = 0, escape: str = "\\", lines: str | None = None) -> DataFrame:
    """Delimited lines: ``\\N`` and ``NULL`` are null, and so is a field that its type cannot read. The first ``skip``
    lines of each file are left out. ``quote``, ``escape`` and ``lines`` are ENCLOSED, ESCAPED and LINES TERMINATED BY."""
    reader = spark.read.option("sep", sep).option("quote", quote).option("escape", escape).option("nullValue", "\\N").option("mode", "PERMISSIVE").option("header", "false")
    if lines:
        reader = reader.option("lineSep", lines)
    if skip == 1:
        reader = reader.option("header", "true").option("enforceSchema", "true")
    elif skip:
        raise ValueError("one header line at most")
    rows = reader.schema(schema).csv(path)
    return rows.select(*[F.when(F.col(c) == "NULL", None).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def export(df: DataFrame, path: str, sep: str = ",", quote: str = '"', lines: str = "\n", quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("sep", sep).option("quote", quote).option("lineSep", lines).option("quoteAll", quote_all).option("nullValue", "\\N").csv(path)


def optimize(df: DataFrame, path: str, rows_per_file: int = 5_000_000, by: tuple[str, ...] = ()) -> None:
    """Rewrite a table into as few files as ``rows_per_file`` allows, as many as the rows need; with ``by``, in the order of these
    columns, so that each file and row group has a narrow range of them and scans skip the others."""
    n = max(1, -(-df.count() // rows_per_file))
    (df.repartitionByRange(n, *by).sortWithinPartitions(*by) if by else df.repartition(n)).write.mode("overwrite").parquet(path)


def checksum(df: DataFrame) -> DataFrame:
    """(n, checksum): of all columns of all rows, in any order."""
    row = F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("checksum"))
