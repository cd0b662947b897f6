"""Whole result sets as CSV or JSON files that others can read.

An export is a folder of files of bounded size and, written last, a row in the table of
manifests: format, columns, number of rows and a checksum over them. A reader goes by the
newest manifest, so an export that broke off, or one that is still written, is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType

FORMATS = ("csv", "json")
#: Rows of a file at most.
FILE_ROWS = 500_000
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_CSV = _TIMES | {
    "header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "emptyValue": '""', "nullValue": "", "lineSep": "\n",
}
_MANIFEST = "run string, at timestamp, format string, schema string, rows long, checksum string"


class NoExport(LookupError):
    """No finished export lies in the folder."""


@dataclass(frozen=True)
class Manifest:
    run: str
    format: str
    schema: StructType
    rows: int
    checksum: str


def _nested(kind: DataType) -> bool:
    return isinstance(kind, ArrayType | MapType | StructType)


def flat_columns(schema: StructType, within: str = "") -> list[tuple[str, DataType]]:
    """Names and types of the leaves: members of structs by their path, lists and maps as they are."""
    out = []
    for f in schema.fields:
        name = f"{within}{f.name}"
        out += flat_columns(f.dataType, f"{name}.") if isinstance(f.dataType, StructType) else [(name, f.dataType)]
    return out


def flattened(frame: DataFrame) -> DataFrame:
    """A column for each leaf; lists and maps as JSON text, bytes as base64. A null struct has null leaves."""

    def leaf(path: str, kind: DataType) -> Column:
        column = None
        for part in path.split("."):
            column = F.col(f"`{part}`") if column is None else column.getField(part)
        column = F.to_json(column) if _nested(kind) else F.base64(column) if isinstance(kind, BinaryType) else column
        return column.alias(path)

    return frame.select(*[leaf(n, k) for n, k in flat_columns(frame.schema)])


def _checksum(frame: DataFrame) -> DataFrame:
    """Rows and a sum of row hashes, which no order of rows changes."""
    text = F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]) if frame.columns else F.lit(0).cast("long")
    return frame.agg(F.count("*").alias("rows"), F.coalesce(F.sum(text.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def _load(spark: SparkSession, folder: str, run: str, form: str, schema: StructType) -> DataFrame:
    """The rows of a run as they were exported; CSV gives them flat."""
    if form == "json":
        return spark.read.schema(schema).options(**_TIMES).json(f"{folder}/data/{run}")
    leaves = flat_columns(schema)
    texts = StructType()
    for name, kind in leaves:
        texts = texts.add(name, "string" if _nested(kind) or isinstance(kind, BinaryType) else kind)
    # Quoted line breaks need whole files, whose size is bounded. Quoted nothing is an empty text, nothing is null.
    empty = uuid.uuid4().hex
    rows = spark.read.schema(texts).options(**_CSV, multiLine="true").option("emptyValue", empty).csv(f"{folder}/data/{run}")

    def typed(name: str, kind: DataType) -> Column:
        column = F.col(f"`{name}`")
        if texts[name].dataType.typeName() == "string":
            column = F.when(column == empty, "").otherwise(column)
        column = F.from_json(column, kind.simpleString()) if _nested(kind) else F.unbase64(column) if isinstance(kind, BinaryType) else column
        return column.alias(name)

    return rows.select(*[typed(n, k) for n, k in leaves])


def export(frame: DataFrame, folder: str, form: str = "csv", order: Sequence[Column] = (), file_rows: int = FILE_ROWS) -> Manifest:
    """Write all rows, in files that follow ``order`` if one is given, then the manifest.

    The files are read back and counted before the manifest is written, so it tells what lies there.
    """
    if form not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    spark, run = frame.sparkSession, uuid.uuid4().hex
    rows = frame.orderBy(*order) if order else frame
    rows = flattened(rows) if form == "csv" else rows
    options = _CSV if form == "csv" else _TIMES | {"ignoreNullFields": "false"}
    rows.write.options(**options).option("maxRecordsPerFile", file_rows).format(form).save(f"{folder}/data/{run}")
    facts = _checksum(_texts(_load(spark, folder, run, form, frame.schema))).first()
    row = spark.createDataFrame([(run, form, frame.schema.json(), facts["rows"], facts["checksum"])], "run string, format string, schema string, rows long, checksum string")
    row.select("run", F.current_timestamp().alias("at"), "format", "schema", "rows", "checksum").coalesce(1).write.mode("append").parquet(f"{folder}/manifests")
    return Manifest(run, form, frame.schema, facts["rows"], facts["checksum"])


def _texts(frame: DataFrame) -> DataFrame:
    """Nested columns as text, so that maps can be hashed too."""
    return frame.select(*[(F.to_json(F.col(f"`{f.name}`")) if _nested(f.dataType) else F.col(f"`{f.name}`")).alias(f.name) for f in frame.schema.fields])


def manifest(spark: SparkSession, folder: str) -> Manifest:
    """The newest finished export."""
    try:
        row = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifests").orderBy(F.desc("at"), F.desc("run")).first()
    except AnalysisException as absent:
        raise NoExport(folder) from absent
    if row is None:
        raise NoExport(folder)
    return Manifest(row.run, row.format, StructType.fromJson(json.loads(row.schema)), row.rows, row.checksum)


def read_export(spark: SparkSession, folder: str, check: bool = False) -> DataFrame:
    """The rows of the newest finished export; with ``check``, only if number and checksum hold."""
    newest = manifest(spark, folder)
    rows = _load(spark, folder, newest.run, newest.format, newest.schema)
    if check:
        facts = _checksum(_texts(rows)).first()
        if (facts["rows"], facts["checksum"]) != (newest.rows, newest.checksum):
            raise ValueError(f"files of {folder} were changed after the export")
    return rows
