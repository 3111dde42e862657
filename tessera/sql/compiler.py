"""Bound SELECT statements as DataFrames.

Names and types are checked here, before any job starts: identifiers keep their case, nothing is converted implicitly, and
every construct outside the dialect is refused. What is left is declared to Catalyst in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlBindingError, SqlUnknownColumnError, SqlUnsupportedError
from ..functions import geo
from ..operators.text import TextIndex
from . import parser as ast

STRATEGIES = {"AUTO": None, "GRACE_HASH": "shuffle_hash", "HASH": "broadcast", "MERGE": "merge", "NESTED_LOOP": "shuffle_replicate_nl"}
ARRIVAL = "__rid"


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "INTEGER"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "FLOAT"
    return {T.BooleanType: "BOOLEAN", T.StringType: "VARCHAR"}.get(type(kind), "OTHER")


@dataclass
class Relation:
    """What a table offers to a query. location: id, latitude and longitude columns of the pseudo-column ``ubicacion``."""

    name: str
    frame: DataFrame
    key: str | None = None
    location: tuple[str, str, str] | None = None
    text: dict = field(default_factory=dict)
    media: object | None = None

    @property
    def types(self) -> dict[str, str]:
        return {f.name: type_name(f.dataType) for f in self.frame.schema if f.name != ARRIVAL}


@dataclass(frozen=True)
class Bound:
    column: Column
    type: str
    name: str


class Scope:
    def __init__(self, relations: dict[str, Relation]) -> None:
        self.relations = relations

    def frame(self, alias: str) -> DataFrame:
        """The table with columns named ``alias.column``; integers and floats get the dialect's width."""
        df = self.relations[alias].frame
        wide = {"INTEGER": "long", "FLOAT": "double"}
        return df.select(*[(F.col(f"`{f.name}`").cast(wide[t]) if (t := type_name(f.dataType)) in wide else F.col(f"`{f.name}`")).alias(f"{alias}.{f.name}") for f in df.schema])

    def bind(self, name: ast.Name) -> Bound:
        owners = [a for a, r in self.relations.items() if name.table in (None, a) and name.column in r.types]
        if not owners:
            raise SqlUnknownColumnError(f"unknown column {name.table + '.' if name.table else ''}{name.column}")
        if len(owners) > 1:
            raise SqlBindingError(f"column {name.column} is ambiguous")
        return self.of(owners[0], name.column)

    def of(self, alias: str, column: str) -> Bound:
        shared = sum(column in r.types for r in self.relations.values()) > 1
        return Bound(F.col(f"`{alias}.{column}`"), self.relations[alias].types[column], f"{alias}.{column}" if shared else column)

    def star(self, star: ast.Star) -> list[Bound]:
        if star.table is not None and star.table not in self.relations:
            raise SqlBindingError(f"unknown relation {star.table}")
        return [self.of(a, c) for a, r in self.relations.items() if star.table in (None, a) for c in r.types]

    def distance(self, d: ast.Distance) -> Bound:
        if len(self.relations) > 1:
            raise SqlUnsupportedError("distances in a join are not part of this dialect")
        (alias, relation), point = next(iter(self.relations.items())), d.point
        if d.location.column != "ubicacion" or d.location.table not in (None, alias) or not relation.location:
            raise SqlBindingError(f"{d.location.column} is not a location of {relation.name}")
        if isinstance(point, str):
            raise SqlBindingError(f"parameter {point} has no value")
        if d.metric not in geo.METRICS:
            raise SqlBindingError(f"unknown metric {d.metric}")
        latitude, longitude = (F.col(f"`{alias}.{c}`") for c in relation.location[1:])
        return Bound(geo.METRICS[d.metric](latitude, longitude, geo.checked(point)), "FLOAT", "distancia")

    def value(self, value: object) -> Bound:
        if isinstance(value, ast.Name):
            return self.bind(value)
        if isinstance(value, ast.Distance):
            return self.distance(value)
        if isinstance(value, ast.Literal):
            kind = {bool: "BOOLEAN", int: "INTEGER", float: "FLOAT", str: "VARCHAR"}[type(value.value)]
            return Bound(F.lit(value.value).cast({"INTEGER": "long", "FLOAT": "double"}.get(kind, "string" if kind == "VARCHAR" else "boolean")), kind, "")
        raise SqlBindingError("scores can't be compared")


def _no_nan(b: Bound) -> Column:
    return F.when(F.isnan(b.column), F.raise_error(F.lit("NaN can't be compared"))).otherwise(F.lit(True))


def condition(node: object, scope: Scope) -> Column:
    """A predicate. The NaN guard stands beside the comparison, so that the comparison still reaches the file scan."""
    if isinstance(node, ast.Logic):
        parts = [condition(p, scope) for p in node.parts]
        if node.operator == "NOT":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.operator == "AND" else out | p
        return out
    if not isinstance(node, ast.Comparison):
        raise SqlUnsupportedError("MATCH and SIMILAR_TO must be the whole WHERE")
    sides = [scope.value(node.left), scope.value(node.right)]
    for i, (mine, other) in enumerate(((node.left, node.right), (node.right, node.left))):
        if isinstance(other, ast.Distance) and isinstance(mine, ast.Literal) and sides[i].type == "INTEGER":
            sides[i] = scope.value(ast.Literal(float(mine.value)))
    if sides[0].type != sides[1].type or sides[0].type == "OTHER":
        raise SqlBindingError(f"{sides[0].type} and {sides[1].type} can't be compared")
    a, b = sides[0].column, sides[1].column
    out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.operator]
    for side, source in zip(sides, (node.left, node.right), strict=True):
        if side.type == "FLOAT" and isinstance(source, ast.Name):
            out = out & _no_nan(side)
    return out


def conjuncts(node: object | None) -> list[object]:
    return [] if node is None else [x for p in node.parts for x in conjuncts(p)] if isinstance(node, ast.Logic) and node.operator == "AND" else [node]


def parameters(node: object, values: dict[str, tuple[float, float]]) -> object:
    """The statement with point parameters put in."""
    if isinstance(node, ast.Distance):
        if isinstance(node.point, str):
            if node.point not in values:
                raise SqlBindingError(f"parameter {node.point} has no value")
            return replace(node, point=tuple(map(float, values[node.point])))
        return node
    if isinstance(node, tuple):
        return tuple(parameters(x, values) for x in node)
    if hasattr(node, "__dataclass_fields__"):
        return replace(node, **{f: parameters(getattr(node, f), values) for f in node.__dataclass_fields__})
    return node


def aggregate(a: ast.Aggregate, scope: Scope) -> tuple[Column, str]:
    """The aggregate as an expression, and its default name."""
    if a.argument is None:
        return F.count(F.lit(1)), "count"
    b = scope.bind(a.argument)
    name = f"{a.function.lower()}_{a.argument.column}"
    if a.function == "COUNT":
        return F.count(F.lit(1)), name
    if a.function in ("SUM", "AVG") and b.type not in ("INTEGER", "FLOAT"):
        raise SqlBindingError(f"{a.function} needs numbers, not {b.type}")
    if b.type == "OTHER":
        raise SqlBindingError(f"{a.function} can't take this type")
    if a.function == "SUM":
        return F.coalesce(F.sum(b.column), F.lit(0).cast("long" if b.type == "INTEGER" else "double")), name
    if a.function == "AVG":  # the total of integers stays exact, as avg() of long would not
        mean = F.sum(b.column.cast("decimal(38,0)")).cast("double") / F.count(F.lit(1)) if b.type == "INTEGER" else F.avg(b.column)
    else:
        mean = F.min(b.column) if a.function == "MIN" else F.max(b.column)
    return F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit(f"{a.function} of no rows"))).otherwise(mean), name


@dataclass
class Plan:
    frame: DataFrame
    columns: list[tuple[str, str]]
    steps: list[str]


def compile_select(s: ast.Select, lookup, strategy: str = "AUTO") -> Plan:
    """lookup: a table's Relation by name."""
    relations = {s.table.alias: lookup(s.table)}
    if s.join:
        if s.join.alias == s.table.alias:
            raise SqlBindingError(f"relation {s.join.alias} twice; use an alias")
        relations[s.join.alias] = lookup(s.join)
    scope = Scope(relations)
    if isinstance(s.where, (ast.Match, ast.Similar)):
        return _ranked(s, scope)
    if any(isinstance(i.value, ast.Score) for i in s.items):
        raise SqlBindingError("scores need MATCH or SIMILAR_TO")
    df, steps = scope.frame(s.table.alias), [f"TableScan {s.table.name}"]
    if s.join:
        df, step = _join(s, scope, df, strategy)
        steps.append(step)
    aggregates = [i for i in s.items if isinstance(i.value, ast.Aggregate)]
    grouped = bool(s.group or aggregates)
    if grouped and any(isinstance(x, ast.Distance) for x in [*(i.value for i in s.items), *(o.value for o in s.order)]):
        raise SqlUnsupportedError("distances in a grouped query are not part of this dialect")
    if s.where is not None:
        df, step = _filter(s, scope, df)
        steps.append(step)
    if grouped:
        return _grouped(s, scope, df, steps)
    bound = [b for i in s.items for b in (scope.star(i.value) if isinstance(i.value, ast.Star) else [_renamed(scope.value(i.value), i.alias)])]
    _distinct([b.name for b in bound])
    by_name = {b.name: b for b in bound}
    keys, done = [], set()
    for o in s.order:
        if isinstance(o.value, ast.Name) and o.value.table is None and o.value.column in by_name:
            b = by_name[o.value.column]
        elif isinstance(o.value, (ast.Name, ast.Distance)):
            b = scope.value(o.value)
        else:
            raise SqlUnsupportedError("ORDER BY takes columns and distances")
        if b.type == "OTHER":
            raise SqlBindingError("this type has no order")
        if b.column._jc.toString() in done:
            continue  # the first direction of a column holds
        done.add(b.column._jc.toString())
        keys.append(b.column.asc() if o.ascending else b.column.desc())
        if o.ascending and isinstance(o.value, ast.Distance) or (b.name == "distancia" and o.ascending) or _is_distance(o.value, s.items) and o.ascending:
            keys.append(F.col(f"`{s.table.alias}.{relations[s.table.alias].location[0]}`").asc())
    if keys:
        for alias, r in relations.items():  # sorting is stable: arrival or the key settles ties
            extra = ARRIVAL if ARRIVAL in r.frame.columns else r.key
            keys += [F.col(f"`{alias}.{extra}`").asc()] if extra else []
        df = df.orderBy(*keys)
        steps.append("ExternalSort " + ", ".join(_text(o.value) for o in s.order))
    df = df.select(*[b.column.alias(b.name) for b in bound])
    steps.append("Projection " + ", ".join(b.name for b in bound))
    return _limited(s, Plan(df, [(b.name, b.type) for b in bound], steps))


def _is_distance(value: object, items: tuple[ast.Item, ...]) -> bool:
    return isinstance(value, ast.Name) and value.table is None and any(isinstance(i.value, ast.Distance) and (i.alias or "distancia") == value.column for i in items)


def _text(value: object) -> str:
    return f"{value.table + '.' if value.table else ''}{value.column}" if isinstance(value, ast.Name) else type(value).__name__.lower()


def _renamed(b: Bound, alias: str | None) -> Bound:
    return replace(b, name=alias) if alias else b


def _distinct(names: list[str]) -> None:
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise SqlBindingError(f"output names repeat: {', '.join(sorted(twice))}")


def _limited(s: ast.Select, plan: Plan) -> Plan:
    if s.limit is None:
        return plan
    return Plan(plan.frame.limit(s.limit), plan.columns, [*plan.steps, f"Limit {s.limit}"])


def _filter(s: ast.Select, scope: Scope, df: DataFrame) -> tuple[DataFrame, str]:
    step = "Filter"
    if len(scope.relations) == 1:
        (alias, relation), box = next(iter(scope.relations.items())), None
        for c in conjuncts(s.where):
            if not isinstance(c, ast.Comparison):
                continue
            sides = (c.left, c.right) if isinstance(c.left, ast.Distance) else (c.right, c.left)
            inward = c.operator in (("<", "<=") if isinstance(c.left, ast.Distance) else (">", ">="))
            if isinstance(sides[0], ast.Distance) and isinstance(sides[1], ast.Literal) and inward and type(sides[1].value) in (int, float):
                scope.distance(sides[0])
                latitude, longitude = (F.col(f"`{alias}.{x}`") for x in relation.location[1:])
                box = geo.near(latitude, longitude, sides[0].point, max(0.0, float(sides[1].value)), sides[0].metric)
                df, step = df.where(box), "SpatialIndexScan radius"
    return df.where(condition(s.where, scope)), step


def _join(s: ast.Select, scope: Scope, left: DataFrame, strategy: str) -> tuple[DataFrame, str]:
    pairs = 0
    for c in conjuncts(s.on):
        if isinstance(c, ast.Comparison) and c.operator == "=" and isinstance(c.left, ast.Name) and isinstance(c.right, ast.Name):
            a, b = scope.bind(c.left), scope.bind(c.right)
            if a.type != b.type:
                raise SqlBindingError(f"join columns have types {a.type} and {b.type}")
            owner = lambda n: n.table or next(x for x, r in scope.relations.items() if n.column in r.types)
            pairs += owner(c.left) != owner(c.right)
    if not pairs:
        raise SqlBindingError("a join needs an equality between its tables")
    right = scope.frame(s.join.alias)
    if strategy not in STRATEGIES:
        raise SqlBindingError(f"unknown join strategy {strategy}")
    if STRATEGIES[strategy]:
        right = right.hint(STRATEGIES[strategy])
    return left.join(right, condition(s.on, scope), "inner"), f"{'GraceHashJoin' if strategy in ('AUTO', 'GRACE_HASH') else strategy.title().replace('_', '') + 'Join'} {s.table.name} x {s.join.name}"


def _grouped(s: ast.Select, scope: Scope, df: DataFrame, steps: list[str]) -> Plan:
    if not any(isinstance(i.value, ast.Aggregate) for i in s.items):
        raise SqlBindingError("GROUP BY needs an aggregate")
    keys = [scope.bind(g) for g in s.group]
    texts = [k.column._jc.toString() for k in keys]
    if len(set(texts)) != len(texts):
        raise SqlBindingError("GROUP BY repeats a column")
    inner, outputs, columns = [], [], []
    kind_of = {"COUNT": "INTEGER", "AVG": "FLOAT"}
    for n, i in enumerate(s.items):
        if isinstance(i.value, ast.Star):
            raise SqlBindingError("* can't be grouped")
        if isinstance(i.value, ast.Aggregate):
            value, name = aggregate(i.value, scope)
            inner.append(value.alias(f"__a{n}"))
            outputs.append((F.col(f"__a{n}"), i.alias or name))
            columns.append((i.alias or name, kind_of.get(i.value.function) or scope.bind(i.value.argument).type))
        else:
            b = scope.value(i.value)
            if b.column._jc.toString() not in texts:
                raise SqlBindingError(f"{b.name} is neither grouped nor aggregated")
            outputs.append((F.col(f"__k{texts.index(b.column._jc.toString())}"), i.alias or b.name))
            columns.append((i.alias or b.name, b.type))
    _distinct([name for _, name in outputs])
    guarded = df
    for k in keys:
        if k.type == "FLOAT":
            guarded = guarded.where(_no_nan(k))
    out = guarded.groupBy(*[k.column.alias(f"__k{j}") for j, k in enumerate(keys)]).agg(*inner)
    steps = [*steps, "ExternalHashGroup " + ", ".join(_text(g) for g in s.group)]
    by_name = {name: value for value, name in outputs}
    order, done = [], set()
    for o in s.order:
        if isinstance(o.value, ast.Name) and o.value.table is None and o.value.column in by_name:
            value, mark = by_name[o.value.column], o.value.column
        elif isinstance(o.value, ast.Name) and (text := scope.bind(o.value).column._jc.toString()) in texts:
            value, mark = F.col(f"__k{texts.index(text)}"), text
        else:
            raise SqlBindingError("a grouped query is ordered by its keys and aggregates")
        if mark not in done:
            done.add(mark)
            order.append(value.asc() if o.ascending else value.desc())
    if order:
        out = out.orderBy(*order, *[F.col(f"__k{j}") for j in range(len(keys))])
        steps.append("ExternalSort " + ", ".join(_text(o.value) for o in s.order))
    out = out.select(*[value.alias(name) for value, name in outputs])
    return _limited(s, Plan(out, columns, [*steps, "Projection " + ", ".join(name for _, name in outputs)]))


def _ranked(s: ast.Select, scope: Scope) -> Plan:
    """MATCH and SIMILAR_TO: the ranking is a small table that the rows join."""
    if s.join or s.group or any(isinstance(i.value, ast.Aggregate) for i in s.items):
        raise SqlUnsupportedError("ranked search takes one table, without groups")
    (alias, relation), w = next(iter(scope.relations.items())), s.where
    text = isinstance(w, ast.Match)
    function, default = ("SCORE", "score") if text else ("SIMILARITY_SCORE", "similarity_score")
    if any(isinstance(i.value, ast.Score) and i.value.function != function for i in s.items):
        raise SqlBindingError(f"this search has {function}()")
    if text:
        column = scope.bind(w.column)
        published = w.column.column in relation.text
        if column.type != "VARCHAR" or not published and relation.key is None:
            raise SqlBindingError(f"{w.column.column} is not text that can be searched: it needs a published index or its table a key")
        # Without an index the texts are split for this statement, with the same scores.
        index, id_column = relation.text[w.column.column] if published else (TextIndex.build(relation.frame, relation.key, w.column.column), relation.key)
        limit = s.limit
    else:
        if relation.media is None:
            raise SqlBindingError(f"{relation.name} is not a media collection")
        id_column, limit = relation.media.id_column, min(w.k, s.limit) if s.limit is not None else w.k
    score = Bound(F.col("__score"), "FLOAT", default)
    names = {i.alias or default for i in s.items if isinstance(i.value, ast.Score)} | {default}
    keys = []
    for o in s.order:
        if isinstance(o.value, ast.Score) or isinstance(o.value, ast.Name) and o.value.column in names:
            keys.append(("score", o.ascending))
        elif isinstance(o.value, ast.Name) and o.value.column == id_column:
            keys.append(("id", o.ascending))
        else:
            raise SqlBindingError("ranked search is ordered by score and id")
    allowed = [[("score", False)], [("score", False), ("id", True)]] + ([[("score", True)], [("score", True), ("id", True)], [("id", True)], [("id", False)]] if text else [])
    if keys and keys not in allowed:
        raise SqlBindingError("this order is not offered by ranked search")
    by_score = not keys or keys[0] == ("score", False)
    hits = index.search(w.query, w.model, limit if by_score else None) if text else relation.media.search(w, limit)
    hits = hits.select(F.col("id").alias("__id"), F.col("score").alias("__score"))
    df = scope.frame(alias).join(hits, F.col(f"`{alias}.{id_column}`") == F.col("__id"))
    bound = [b for i in s.items for b in (scope.star(i.value) if isinstance(i.value, ast.Star) else [_renamed(score if isinstance(i.value, ast.Score) else scope.value(i.value), i.alias)])]
    _distinct([b.name for b in bound])
    order = keys or [("score", False)]
    by = [(F.col("__score") if k == "score" else F.col("__id")) for k, _ in order]
    df = df.orderBy(*[c.asc() if up else c.desc() for c, (_, up) in zip(by, order, strict=True)], F.col("__id").asc())
    steps = [f"{('TextIndexScan' if published else 'TextScan') if text else 'VectorIndexScan'} {relation.name} {w.model if text else w.index}", "Projection " + ", ".join(b.name for b in bound)]
    plan = Plan(df.select(*[b.column.alias(b.name) for b in bound]), [(b.name, b.type) for b in bound], steps)
    return Plan(plan.frame.limit(limit), plan.columns, [*steps, f"Limit {limit}"]) if limit is not None else plan
