"""Plain documents and workbooks from files: text of TXT files, rows of all sheets of XLSX files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .packages import register


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row_number, values (map), links (map): rows of every sheet of every workbook under a path; a workbook beyond the limits is refused."""
    register(spark)
    return spark.read.format("workbook").load(path)


@F.pandas_udf(StringType())
def decoded_text(contents: pd.Series) -> pd.Series:
    """Text of a TXT file: UTF-8, else Latin-1; line ends as \\n."""

    def one(data):
        if data is None:
            return None
        try:
            text = bytes(data).decode("utf-8-sig")
        except UnicodeDecodeError:
            text = bytes(data).decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n").strip()

    return contents.map(one)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every TXT file under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", decoded_text("content").alias("text"))
