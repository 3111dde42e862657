"""The engine: tables, sessions and statements."""

from __future__ import annotations

import copy
import re
import threading
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval
from .errors import DuplicateError, MaintenanceError, SqlBindingError, SqlQueryError, SqlUnknownColumnError, SqlUnknownTableError, TransactionError
from .functions import geo
from .locks import Locks
from .operators import vectors
from .operators.text import TextIndex
from .plans.explain import run, tree
from .sources.delimited import read_delimited
from .sql import compiler
from .sql import parser as ast
from .store import ARRIVAL, Store


@dataclass
class Result:
    """kind: ROWS, COMMAND, DEFINITION or EXPLANATION."""

    kind: str
    frame: DataFrame | None = None
    columns: list[tuple[str, str]] = field(default_factory=list)
    affected: int = 0
    text: str = ""

    def fetchall(self, limit: int) -> list[tuple]:
        """All rows; refuses results of more than ``limit`` rows rather than cutting them."""
        rows = self.frame.limit(limit + 1).collect() if self.frame is not None else []
        if len(rows) > limit:
            raise SqlQueryError(f"the result has more than {limit} rows")
        return [tuple(r) for r in rows]


# Names and endings of registered media, by kind.
MEDIA_KEY, LONGEST_KEY = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*"), 128
MEDIA_ENDINGS = {"image": (".jpg", ".jpeg", ".png"), "audio": (".wav", ".mp3")}


def media_kind(key: str, expected: str | None = None) -> str:
    """image or audio; refuses keys that are not plain file names of the kind expected."""
    if len(key) > LONGEST_KEY or not MEDIA_KEY.fullmatch(key) or ".." in key:
        raise SqlBindingError(f"a media key is a file name of at most {LONGEST_KEY} letters, digits, '.', '_' and '-', without '..'")
    kind = next((k for k, endings in MEDIA_ENDINGS.items() if key.lower().endswith(endings)), None)
    if kind is None or expected not in (None, kind):
        raise SqlBindingError(f"media {key} is not {expected or 'image or audio'}")
    return kind


@dataclass
class Media:
    """Vectors of a media table: (id, vector) and a media key per row of ``keys`` (key, id). Indexes are built once, in ``folder`` if given."""

    id_column: str
    vectors: DataFrame
    keys: DataFrame
    kind: str | None = None
    folder: str | None = None
    indexes: dict = field(default_factory=dict)

    def index(self, kind: str, metric: str) -> vectors.IvfIndex | vectors.HnswIndex:
        if (kind, metric) not in self.indexes:
            at = self.folder and f"{self.folder}/{kind}-{metric}-{uuid.uuid4().hex}"
            if kind == "HNSW":
                built = vectors.HnswIndex.build(self.vectors, metric, at)
            else:
                built = vectors.IvfIndex.build(self.vectors, metric)
                built = built.save(at) if at else replace(built, rows=built.rows.persist())
            self.indexes[kind, metric] = built
        return self.indexes[kind, metric]

    def search(self, w: ast.Similar, limit: int) -> DataFrame:
        media_kind(w.key, self.kind)
        row = self.keys.where(F.col("key") == w.key).join(self.vectors, "id").select("vector").first()
        if row is None:
            raise SqlBindingError(f"media {w.key} is not registered")
        index = self.index(w.index, w.metric)
        return index.search_exactly(row["vector"], limit) if w.index == "IVF" else index.search(row["vector"], limit)


class Engine:
    """Registered tables are read-only; tables made by CREATE TABLE live in ``folder`` and can be changed."""

    def __init__(self, spark: SparkSession, folder: str | None = None, lock_timeout: float = 30.0) -> None:
        self.spark = spark
        self.store = Store(spark, folder) if folder else None
        self.registered: dict[str, compiler.Relation] = {}
        self.locks = Locks(lock_timeout)
        self.publishing = threading.Lock()

    def register(self, name: str, df: DataFrame, key: str | None = None, location: tuple[str, str, str] | None = None) -> None:
        """key: a unique column, which settles the order of equal sort keys. location: id, latitude and longitude columns."""
        if location is None and {"id", "latitud", "longitud"} <= set(df.columns) and "ubicacion" not in df.columns:
            location = ("id", "latitud", "longitud")
        self.registered[name] = compiler.Relation(name, df, key, location)

    def publish_text(self, table: str, id_column: str, text_column: str, path: str | None = None, exact: bool = False) -> TextIndex:
        """Build a text index; with ``path``, write it, so that searches read the postings of their words only."""
        index = TextIndex.build(self.registered[table].frame, id_column, text_column, exact, path)
        self.registered[table].text[text_column] = (index, id_column)
        return index

    def publish_media(self, table: str, id_column: str, vector_rows: DataFrame, key_column: str = "media_key", kind: str | None = None) -> None:
        """vector_rows: (id, vector). The table's ``key_column`` names the media of a row, all of one ``kind`` (image, audio) if given.

        An index is built when a search first asks for it, and kept: in the engine's folder, or in memory where it has none.
        """
        vectors.check_collection(vector_rows)
        keys = self.registered[table].frame.select(F.col(key_column).alias("key"), F.col(id_column).alias("id"))
        endings = [e for k, group in MEDIA_ENDINGS.items() if kind in (None, k) for e in group]
        named = F.col("key").rlike(f"^{MEDIA_KEY.pattern}$") & ~F.col("key").contains("..") & (F.char_length("key") <= LONGEST_KEY)
        wrong = keys.where(~F.coalesce(named & F.lower("key").rlike("(" + "|".join(map(re.escape, endings)) + ")$"), F.lit(False))).first()
        if wrong is not None:
            media_kind(wrong["key"] or "", kind)
        folder = f"{self.store.folder}/.indexes/{table}" if self.store else None
        self.registered[table].media = Media(id_column, vector_rows, keys, kind, folder)

    def vector_search(self, table: str, query: list[float] | str, k: int, index: str = "EXACT", metric: str = "cosine") -> DataFrame:
        """(id, score) nearest to a vector or to the media of a key; index: EXACT, IVF or HNSW."""
        media = self.registered[table].media
        if media is None:
            raise SqlBindingError(f"{table} is not a media collection")
        if isinstance(query, str):
            row = media.keys.where(F.col("key") == query).join(media.vectors, "id").select("vector").first()
            if row is None:
                raise SqlBindingError(f"media {query} is not registered")
            query = row["vector"]
        return vectors.exact(media.vectors, query, k, metric) if index == "EXACT" else media.index(index, metric).search(query, k)

    def retrieve(self, chunk_table: str, paper_table: str, question: str, top: int = retrieval.TOP) -> DataFrame:
        """Passages for a question from a table (chunk_id, paper_id, position, content) whose text is published, with their paper's columns."""
        index, _ = self.registered[chunk_table].text["content"]
        return retrieval.retrieve(index, self.registered[chunk_table].frame, self.registered[paper_table].frame, question, top)

    def session(self) -> Session:
        return Session(self)

    def sql(self, text: str, parameters: dict[str, tuple[float, float]] | None = None, strategy: str = "AUTO") -> Result:
        """One statement, on its own."""
        return self.session().sql(text, parameters, strategy)

    def text_search(self, table: str, column: str, query: str, model: str = "BM25", limit: int | None = 10, order: str = "score_desc") -> DataFrame:
        """(id, score); order: score_desc, score_asc (ties by id), id_asc or id_desc."""
        if order not in ("score_desc", "score_asc", "id_asc", "id_desc"):
            raise SqlBindingError(f"no order {order}")
        index, _ = self.registered[table].text[column]
        if order == "score_desc":
            return index.search(query, model, limit)
        by, way = order.split("_")
        rows = index.search(query, model).orderBy(F.col(by).asc() if way == "asc" else F.col(by).desc(), "id")
        return rows.limit(limit) if limit is not None else rows

    def _place(self, table: str) -> tuple[DataFrame, str, Column, Column]:
        r = self.registered[table]
        if not r.location:
            raise SqlBindingError(f"{table} has no location")
        return r.frame, r.location[0], F.col(f"`{r.location[1]}`"), F.col(f"`{r.location[2]}`")

    def spatial_radius(self, table: str, point: geo.Point, radius: float, metric: str = "haversine") -> DataFrame:
        """Rows within ``radius`` metres, by id."""
        df, identity, lat, lon = self._place(table)
        point = geo.checked(point)
        return df.where(geo.near(lat, lon, point, radius, metric)).withColumn("distancia", geo.METRICS[metric](lat, lon, point)).where(F.col("distancia") <= radius).orderBy(identity)

    def spatial_knn(self, table: str, point: geo.Point, k: int, metric: str = "haversine") -> DataFrame:
        df, identity, lat, lon = self._place(table)
        return df.withColumn("distancia", geo.METRICS[metric](lat, lon, geo.checked(point))).orderBy("distancia", identity).limit(k)

    def spatial_polygon(self, table: str, points: list[geo.Point]) -> DataFrame:
        df, identity, lat, lon = self._place(table)
        return df.where(geo.within(lat, lon, [geo.checked(p) for p in points])).orderBy(identity)


class Session:
    """Statements in order. Between BEGIN and END changes are seen here only; ROLLBACK, or an error, undoes them all."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.open, self.failed = engine, False, False
        self.mine: dict | None = None
        self.changed: set[str] = set()
        self._busy = threading.Lock()

    def sql(self, text: str, parameters: dict[str, tuple[float, float]] | None = None, strategy: str = "AUTO") -> Result:
        if not self._busy.acquire(blocking=False):
            raise TransactionError("the session runs another statement")
        try:
            return self._run(text, parameters, strategy)
        finally:
            self._busy.release()

    def _run(self, text: str, values: dict | None, strategy: str) -> Result:
        try:
            statement = ast.parse(text)
        except SqlQueryError:
            self._undo() if self.open else None
            raise
        if isinstance(statement, ast.Control):
            return self._control(statement)
        try:
            statement = compiler.parameters(statement, values or {})
            out = getattr(self, f"_{type(statement).__name__.lower()}")(statement, **({"strategy": strategy} if isinstance(statement, (ast.Select, ast.Explain)) else {}))
            if not self.open:
                self._commit()
            return out
        except BaseException:
            self._undo()
            raise

    def _control(self, c: ast.Control) -> Result:
        if (c.action == "BEGIN") == self.open:
            raise TransactionError("a transaction is open" if self.open else "no transaction is open")
        if c.action == "BEGIN":
            self.open = True
        elif c.action == "END":
            self._commit()
        else:
            self._undo()
        return Result("COMMAND", text=c.action)

    def _commit(self) -> None:
        engine = self.engine
        try:
            if self.mine is not None and self.changed:
                with engine.publishing:
                    catalog = copy.deepcopy(engine.store.catalog)
                    for name in self.changed:
                        if name in self.mine["tables"]:
                            catalog["tables"][name] = self.mine["tables"][name]
                        else:
                            catalog["tables"].pop(name, None)
                        catalog["indexes"] = {k: v for k, v in catalog["indexes"].items() if v["table"] != name} | {k: v for k, v in self.mine["indexes"].items() if v["table"] == name}
                    engine.store.publish(catalog)
        finally:
            self._undo()

    def _undo(self) -> None:
        self.mine, self.open = None, False
        self.changed = set()
        self.engine.locks.release(self)

    @property
    def catalog(self) -> dict:
        if self.mine is None:
            self.mine = copy.deepcopy(self.engine.store.catalog) if self.engine.store else {"tables": {}, "indexes": {}}
        return self.mine

    def _table(self, name: str, mode: str) -> dict:
        self.engine.locks.acquire(self, name, mode)
        if self.engine.store and name not in self.changed:  # what others published before the lock was ours
            self.catalog["tables"].pop(name, None)
            if name in self.engine.store.catalog["tables"]:
                self.catalog["tables"][name] = copy.deepcopy(self.engine.store.catalog["tables"][name])
        if name not in self.catalog["tables"]:
            if name in self.engine.registered:
                raise MaintenanceError(f"{name} is read-only")
            raise SqlUnknownTableError(f"unknown table {name}")
        return self.catalog["tables"][name]

    def _relation(self, t: ast.Table) -> compiler.Relation:
        if t.name in self.engine.registered:
            return self.engine.registered[t.name]
        try:
            table = self._table(t.name, "S")
        except SqlUnknownTableError:
            raise SqlUnknownTableError(f"unknown table {t.name}") from None
        key = next((c["name"] for c in table["columns"] if c["primary"]), None)
        names = {c["name"]: c["type"] for c in table["columns"]}
        location = ("id", "latitud", "longitud") if "ubicacion" not in names and [names.get(n) for n in ("id", "latitud", "longitud")] == ["INTEGER", "FLOAT", "FLOAT"] else None
        return compiler.Relation(t.name, self.engine.store.read(table), key, location)

    def _select(self, s: ast.Select, strategy: str) -> Result:
        plan = compiler.compile_select(s, self._relation, strategy)
        return Result("ROWS", plan.frame, plan.columns)

    def _explain(self, e: ast.Explain, strategy: str) -> Result:
        plan = compiler.compile_select(e.select, self._relation, strategy)
        if not e.analyze:
            return Result("EXPLANATION", text=tree(plan))
        rows, text = run(plan)
        return Result("EXPLANATION", affected=rows, text=text)

    def _createtable(self, c: ast.CreateTable) -> Result:
        if not self.engine.store:
            raise MaintenanceError("this engine has no folder for tables")
        self.engine.locks.acquire(self, c.name, "X")
        names = [x.name for x in c.columns]
        primary = [x for x in c.columns if x.primary]
        if c.name in self.engine.registered or c.name in self.catalog["tables"]:
            raise SqlBindingError(f"table {c.name} exists")
        if len(set(names)) < len(names) or ARRIVAL in names:
            raise SqlBindingError("column names repeat or are reserved")
        if len(primary) > 1 or primary and primary[0].type not in ("INTEGER", "VARCHAR"):
            raise SqlBindingError("one INTEGER or VARCHAR column can be the primary key")
        self.catalog["tables"][c.name] = {"columns": [{"name": x.name, "type": x.type, "length": x.length, "primary": x.primary} for x in c.columns], "parts": [], "next": 0}
        if primary:
            self.catalog["indexes"][f"__pk__{c.name}"] = {"table": c.name, "column": primary[0].name, "unique": True}
        self.changed.add(c.name)
        return Result("DEFINITION", text=f"table {c.name}")

    def _createindex(self, c: ast.CreateIndex) -> Result:
        table = self._table(c.table, "X")
        if c.name in self.catalog["indexes"]:
            raise SqlBindingError(f"index {c.name} exists")
        if c.column not in [x["name"] for x in table["columns"]]:
            raise SqlUnknownColumnError(f"unknown column {c.column}")
        if c.unique:
            self._unique(self.engine.store.read(table), [c.column])
        self.catalog["indexes"][c.name] = {"table": c.table, "column": c.column, "unique": c.unique}
        if "sorted" not in table:  # the table's first index sorts its rows, so that conditions on the column skip row groups
            self.catalog["tables"][c.table] = self.engine.store.sorted(table, c.table, c.column)
        self.changed.add(c.table)
        return Result("DEFINITION", text=f"index {c.name}")

    def _drop(self, d: ast.Drop) -> Result:
        if d.kind == "TABLE":
            self._table(d.name, "X")
            del self.catalog["tables"][d.name]
            self.catalog["indexes"] = {k: v for k, v in self.catalog["indexes"].items() if v["table"] != d.name}
            self.changed.add(d.name)
        else:
            index = self.catalog["indexes"].get(d.name)
            if index is None or d.name.startswith("__pk__"):
                raise SqlBindingError(f"no index {d.name} that can be dropped")
            table = self._table(index["table"], "X")
            del self.catalog["indexes"][d.name]
            if table.get("sorted") == index["column"]:
                del table["sorted"]
            self.changed.add(index["table"])
        return Result("DEFINITION", text=f"dropped {d.name}")

    def _uniques(self, name: str) -> list[str]:
        return sorted({v["column"] for v in self.catalog["indexes"].values() if v["table"] == name and v["unique"]})

    @staticmethod
    def _unique(df: DataFrame, columns: list[str]) -> None:
        for c in columns:
            if df.groupBy(f"`{c}`").count().where("count > 1").limit(1).count():
                raise DuplicateError(f"{c} would hold a value twice")

    def _checked(self, table: dict, name: str, value: object) -> object:
        column = next((c for c in table["columns"] if c["name"] == name), None)
        if column is None:
            raise SqlUnknownColumnError(f"unknown column {name}")
        kind = {bool: "BOOLEAN", int: "INTEGER", float: "FLOAT", str: "VARCHAR"}[type(value)]
        if kind != column["type"]:
            raise SqlBindingError(f"{name} takes {column['type']}, not {kind}")
        if kind == "VARCHAR" and (len(value) > column["length"] or column["primary"] and len(value.encode()) > 255):
            raise MaintenanceError(f"the value of {name} is too long")
        return value

    def _in_domain(self, table: dict, row: dict) -> None:
        names = {c["name"]: c["type"] for c in table["columns"]}
        if "ubicacion" not in names and [names.get(n) for n in ("id", "latitud", "longitud")] == ["INTEGER", "FLOAT", "FLOAT"]:
            try:
                geo.checked((row["latitud"], row["longitud"]))
            except SqlBindingError as e:
                raise MaintenanceError(str(e)) from None

    def _insert(self, i: ast.Insert) -> Result:
        table, store = self._table(i.table, "X"), self.engine.store
        names = [c["name"] for c in table["columns"]]
        given = list(i.columns or names)
        if len(given) != len(i.values) or sorted(given) != sorted(names):
            unknown = [n for n in given if n not in names]
            raise SqlUnknownColumnError(f"unknown column {unknown[0]}") if unknown else SqlBindingError("INSERT gives every column one value")
        row = {n: self._checked(table, n, v.value) for n, v in zip(given, i.values, strict=True)}
        self._in_domain(table, row)
        for c in self._uniques(i.table):
            if store.read(table).where(F.col(f"`{c}`") == F.lit(row[c])).limit(1).count():
                raise DuplicateError(f"{c} holds {row[c]!r} already")
        frame = self.engine.spark.createDataFrame([(*[row[n] for n in names], table["next"])], store.schema(table))
        self.catalog["tables"][i.table] = store.appended(table, i.table, frame.coalesce(1), 1)
        self.changed.add(i.table)
        return Result("COMMAND", affected=1, text="INSERT")

    def load(self, name: str, df: DataFrame) -> int:
        """Append the rows of ``df``, whose columns are the table's, in one change. Refuses nulls, over-long and repeated values."""
        table, store = self._table(name, "X"), self.engine.store
        columns = [c["name"] for c in table["columns"]]
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in store.schema(table) if f.name != ARRIVAL])
        bad = F.lit(False)
        for c in table["columns"]:
            bad = bad | F.col(f"`{c['name']}`").isNull()
            if c["type"] == "VARCHAR":
                bad = bad | (F.char_length(F.col(f"`{c['name']}`")) > c["length"])
        if rows.where(bad).limit(1).count():
            raise MaintenanceError("a row has a null or an over-long value")
        numbered = rows.select(*[F.col(f"`{c}`") for c in columns], (F.monotonically_increasing_id() + table["next"]).alias(ARRIVAL))
        part = store.write(numbered, name)
        added = self.engine.spark.read.schema(store.schema(table)).parquet(part)
        self._unique(store.read({**table, "parts": [*table["parts"], part]}), self._uniques(name))
        n, last = added.agg(F.count(F.lit(1)), F.max(ARRIVAL)).first()
        self.catalog["tables"][name] = {**table, "parts": [*table["parts"], part], "next": (last + 1) if n else table["next"]}
        self.changed.add(name)
        if not self.open:
            self._commit()
        return n

    def load_delimited(self, name: str, path: str, primary: str | None = None) -> int:
        """Make a table of a delimited file: its columns and types as ``read_delimited`` infers them, texts as long as the longest."""
        found = read_delimited(self.engine.spark, path)
        texts = [c for c, kind in found.columns if kind == "VARCHAR"]
        longest = found.frame.agg(F.lit(1).alias("one"), *[F.max(F.char_length(F.col(f"`{c}`"))).alias(c) for c in texts]).first()
        columns = tuple(ast.ColumnDefinition(c, kind, max(1, longest[c] or 1) if c in texts else None, c == primary) for c, kind in found.columns)
        if primary is not None and primary not in dict(found.columns):
            raise SqlUnknownColumnError(f"unknown column {primary}")
        try:
            self._createtable(ast.CreateTable(name, columns))
            return self.load(name, found.frame)
        except BaseException:
            self._undo()
            raise

    def _where(self, name: str, table: dict, where: object | None) -> tuple[DataFrame, Column, compiler.Scope]:
        relation = self._relation(ast.Table(name, name))
        scope = compiler.Scope({name: relation})
        frame = scope.frame(name)
        return frame, compiler.condition(where, scope) if where is not None else F.lit(True), scope

    def _delete(self, d: ast.Delete) -> Result:
        table, store = self._table(d.table, "X"), self.engine.store
        frame, hit, _ = self._where(d.table, table, d.where)
        n = frame.where(hit).count()
        kept = frame.where(~hit).toDF(*[c.split(".", 1)[1] for c in frame.columns])
        self.catalog["tables"][d.table] = store.rewritten(table, d.table, kept)
        self.changed.add(d.table)
        return Result("COMMAND", affected=n, text="DELETE")

    def _update(self, u: ast.Update) -> Result:
        table, store = self._table(u.table, "X"), self.engine.store
        frame, hit, scope = self._where(u.table, table, u.where)
        changes = {}
        for name, value in u.changes:
            column = next((c for c in table["columns"] if c["name"] == name), None)
            if column is None:
                raise SqlUnknownColumnError(f"unknown column {name}")
            if name in changes:
                raise SqlBindingError(f"{name} is set twice")
            if isinstance(value, ast.Literal):
                self._checked(table, name, value.value)
            bound = scope.value(value)
            if bound.type != column["type"]:
                raise SqlBindingError(f"{name} takes {column['type']}, not {bound.type}")
            changes[name] = bound.column
        n = frame.where(hit).count()
        pick = lambda c: F.when(hit, changes[c]).otherwise(F.col(f"`{u.table}.{c}`")) if c in changes else F.col(f"`{u.table}.{c}`")
        new = store.rewritten(table, u.table, frame.select(*[pick(c.split(".", 1)[1]).alias(c.split(".", 1)[1]) for c in frame.columns]))
        after = store.read(new)
        for c in table["columns"]:
            if c["type"] == "VARCHAR" and c["name"] in changes and after.where(F.char_length(F.col(f"`{c['name']}`")) > c["length"]).limit(1).count():
                raise MaintenanceError(f"a value of {c['name']} is too long")
        self._unique(after, [c for c in self._uniques(u.table) if c in changes])
        self.catalog["tables"][u.table] = new
        self.changed.add(u.table)
        return Result("COMMAND", affected=n, text="UPDATE")
