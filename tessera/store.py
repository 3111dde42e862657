"""Versioned tables: immutable Parquet parts, and one catalog file that says which parts make up each table.

A change writes new parts and then replaces the catalog by an atomic rename; readers of the old state keep it. INSERT adds
a part with one row; when a table has ``MOST_PARTS`` parts they are rewritten as one. DELETE and UPDATE rewrite the table.
``__rid`` numbers rows by arrival and settles the order of equal sort keys. A table with an index is rewritten in order of
the column of its first index, so that Parquet's row group statistics let a condition on it skip the others. A catalog
has a version; a driver that changes one which another driver has replaced meanwhile is refused.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TransactionError

ARRIVAL, MOST_PARTS = "__rid", 16
#: Seconds after which a version that was marked but not published may be marked again.
ABANDONED = 60
_KINDS = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "VARCHAR": T.StringType()}


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.catalog = self._read()

    def _read(self) -> dict:
        if not self._fs.exists(self._path(f"{self.folder}/catalog.json")):
            return {"tables": {}, "indexes": {}}
        rows = self.spark.read.text(f"{self.folder}/catalog.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def publish(self, catalog: dict) -> None:
        """Make ``catalog`` the state everyone sees. The marker of a version can be made once, so one driver alone gets to follow a version."""
        catalog["version"] = self.catalog.get("version", 0) + 1
        self._fs.mkdirs(self._path(f"{self.folder}/.versions"))
        try:
            self._fs.create(self._path(f"{self.folder}/.versions/{catalog['version']}"), False).close()
        except Py4JJavaError as e:
            marker = self._fs.getFileStatus(self._path(f"{self.folder}/.versions/{catalog['version']}"))
            abandoned = time.time() - marker.getModificationTime() / 1000 > ABANDONED  # its driver died before the rename
            if not abandoned or self._read().get("version", 0) != catalog["version"] - 1:
                raise TransactionError("another driver has changed these tables") from e
        new, old = self._path(f"{self.folder}/.catalog-{uuid.uuid4().hex}"), self._path(f"{self.folder}/catalog.json")
        self._fs.mkdirs(self._path(self.folder))
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(catalog).encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), old.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), options)
        self.catalog = catalog

    @staticmethod
    def schema(table: dict) -> T.StructType:
        return T.StructType([T.StructField(c["name"], _KINDS[c["type"]]) for c in table["columns"]] + [T.StructField(ARRIVAL, T.LongType())])

    def read(self, table: dict) -> DataFrame:
        if not table["parts"]:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(*table["parts"])

    def write(self, df: DataFrame, name: str) -> str:
        part = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(part)
        return part

    def appended(self, table: dict, name: str, rows: DataFrame, n: int) -> dict:
        """The table with ``rows`` (its columns, and __rid counting from its ``next``) added."""
        out = {**table, "parts": [*table["parts"], self.write(rows, name)], "next": table["next"] + n}
        if len(out["parts"]) > MOST_PARTS:
            out["parts"] = [self.write(self._in_order(self.read(out), out), name)]
        return out

    def rewritten(self, table: dict, name: str, df: DataFrame) -> dict:
        rows = df.select(*[F.col(f"`{f.name}`") for f in self.schema(table)])
        return {**table, "parts": [self.write(self._in_order(rows, table), name)]}

    def sorted(self, table: dict, name: str, column: str) -> dict:
        """The table with its rows in order of ``column``, and rewritten so from now on."""
        table = {**table, "sorted": column}
        return self.rewritten(table, name, self.read(table)) if table["parts"] else table

    @staticmethod
    def _in_order(rows: DataFrame, table: dict) -> DataFrame:
        key = table.get("sorted")
        return rows.repartitionByRange(f"`{key}`").sortWithinPartitions(f"`{key}`", ARRIVAL) if key else rows
