"""The CSV output: sink, and reading back what is already there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from ..operators.clean import clean_records, distinct_records, new_records

# The encoding that asks for a byte order mark.
MARKED_ENCODING = "utf-8-sig"
BOM = "\ufeff"


def csv_options(encoding: str) -> dict[str, str]:
    name = "UTF-8" if encoding.lower() == MARKED_ENCODING else encoding
    return {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "encoding": name}


def with_bom(df: DataFrame, encoding: str) -> DataFrame:
    """The mark goes in front of the first column name, so every part starts with it."""
    if encoding.lower() != MARKED_ENCODING:
        return df
    return df.withColumnRenamed(df.columns[0], BOM + df.columns[0])


def read_output(spark: SparkSession, path: str, fields: Sequence[str], encoding: str = MARKED_ENCODING) -> DataFrame:
    """Rows written earlier: absent columns and nulls are empty, values trimmed."""
    try:
        # The header decides the columns; a quoted value may span lines.
        stored = spark.read.options(**csv_options(encoding), multiLine="true").csv(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], ", ".join(f"`{name}` string" for name in fields))
    return clean_records(stored.toDF(*(name.removeprefix(BOM) for name in stored.columns)), fields)


def write_records(
    df: DataFrame,
    path: str,
    fields: Sequence[str],
    encoding: str = MARKED_ENCODING,
    deduplicate: bool = True,
    append: bool = False,
) -> None:
    """Clean ``df`` and write it as a folder of CSV parts.

    Appending with ``deduplicate`` leaves out rows the target already has;
    without it the target is not looked at.
    """
    rows = clean_records(df, fields)
    if deduplicate and append:
        rows = new_records(rows, read_output(df.sparkSession, path, fields, encoding), fields)
    elif deduplicate:
        rows = distinct_records(rows, fields)
    writer: DataFrameWriter = with_bom(rows, encoding).write.mode("append" if append else "overwrite")
    writer.options(**csv_options(encoding)).csv(path)
