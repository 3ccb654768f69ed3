"""Chunk tables as JSON lines and CSV files, and back.

Both are written by the tasks that hold the rows, one file each, into a folder that must
not exist yet, so a lost run leaves no half export behind a good one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# A cell keeps its blanks, breaks and quotes; null is nothing, an empty text is "".
CSV = {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per line; columns that are null are left out of a row's object."""
    rows.write.mode("errorifexists").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a named schema; a line that isn't an object of it ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows of plain columns; nested ones are to be turned into text first."""
    rows.write.mode("errorifexists").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a named schema. Cells may hold line breaks, so a file is read by one task."""
    # The reader's name for nothing has to differ from every text, the empty one included.
    nothing = uuid.uuid4().hex
    return spark.read.schema(schema).options(**CSV, multiLine=True, mode="FAILFAST", nullValue=nothing).csv(path)
