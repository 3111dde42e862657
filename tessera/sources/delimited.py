"""Delimited text: finds the delimiter, refuses ragged rows, infers the narrowest of the dialect's types."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaintenanceError

DELIMITERS = (",", ";", "\t", "|")
MAX_COLUMNS = 32
_INTEGER, _FLOAT, _BOOLEAN = r"^[+-]?\d{1,19}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^(?i:true|false)$"
_CASTS = {"INTEGER": "bigint", "FLOAT": "double", "BOOLEAN": "boolean", "VARCHAR": "string"}


@dataclass
class Preview:
    columns: list[tuple[str, str]]
    frame: DataFrame


def delimiter(line: str) -> str:
    """The delimiter that cuts the header into most fields; the first listed wins a tie."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def _types(name: str) -> Column:
    c = F.trim(F.col(f"`{name}`"))
    whole = c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull()
    return F.struct(F.bool_and(whole).alias("i"), F.bool_and(c.rlike(_FLOAT) & c.try_cast("double").isNotNull()).alias("f"), F.bool_and(c.rlike(_BOOLEAN)).alias("b"))


def read_delimited(spark: SparkSession, path: str) -> Preview:
    """A typed frame of all rows. Empty fields are empty strings; a column of nothing but numbers becomes INTEGER or FLOAT."""
    first = spark.read.text(path).first()
    if first is None:
        raise MaintenanceError("the file is empty")
    mark = delimiter(first[0])
    names = next(csv.reader([first[0]], delimiter=mark))
    if len(names) > MAX_COLUMNS or len(set(names)) < len(names) or any(not n.strip() for n in names):
        raise MaintenanceError("column names repeat, are blank or too many")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).csv(path, header=True, sep=mark, mode="FAILFAST", nullValue="\0", emptyValue="", enforceSchema=False, multiLine=True)
    raw = raw.na.fill("")
    found = raw.agg(*[_types(n).alias(n) for n in names]).first()
    kinds = {n: "INTEGER" if found[n]["i"] else "FLOAT" if found[n]["f"] else "BOOLEAN" if found[n]["b"] else "VARCHAR" for n in names}
    trimmed = lambda n: F.trim(F.col(f"`{n}`")) if kinds[n] != "VARCHAR" else F.col(f"`{n}`")
    return Preview([*kinds.items()], raw.select(*[trimmed(n).cast(_CASTS[kinds[n]]).alias(n) for n in names]))
