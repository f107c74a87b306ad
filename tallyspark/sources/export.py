"""Exports (operators A6, A7): CSV with header and JSON lines.

Writers are distributed (one file per partition) and go to a folder the
caller names; ``export_*_roundtrip`` writes under the shared checkpoint folder
and reads the result back with an explicit schema (used by tests and
queries).  Dates and timestamps are written in ISO form.

CSV keeps every text: quotes are doubled, blanks at the ends, line breaks and
backslashes stay, NULL is an empty field and the empty text a pair of quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


# What reading takes for NULL; it stands for an empty field.
_READ_NULL = "\ufffe\ufffeNULL\ufffe\ufffe"
_CSV = {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        "timestampFormat": ISO_TS, "timestampNTZFormat": ISO_TS, "dateFormat": "yyyy-MM-dd"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    null = "" if len(df.columns) > 1 else _READ_NULL      # a line of one empty field would be no line
    df.write.mode(mode).options(**_CSV, nullValue=null, emptyValue='""').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("timestampFormat", ISO_TS).option("timestampNTZFormat", ISO_TS)
     .option("dateFormat", "yyyy-MM-dd").option("ignoreNullFields", False).json(path))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV, multiLine=True, nullValue=_READ_NULL, emptyValue="").csv(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("timestampFormat", ISO_TS).option("timestampNTZFormat", ISO_TS)
            .option("dateFormat", "yyyy-MM-dd").json(path))


def export_csv_roundtrip(df: DataFrame, name: str = "export-csv") -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


def export_json_roundtrip(df: DataFrame, name: str = "export-json") -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write_json(df, path)
    return read_json(spark, path, df.schema)
