"""Text to statements of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import SqlLexicalError, SqlLimitError, SqlSyntaxError, SqlUnsupportedError

MAX_CHARACTERS, MAX_DEPTH = 65_536, 128
_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*)|(?P<number>\d+(?:\.\d+)?(?![\w.]))|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^']|'')*')|(?P<mark><>|!=|<=|>=|[=<>(),.*;+-])")
_WORDS = set("SELECT FROM WHERE GROUP BY ORDER ASC DESC LIMIT AS INNER JOIN ON AND OR NOT TRUE FALSE INSERT INTO VALUES DELETE UPDATE SET CREATE DROP TABLE UNIQUE INDEX PRIMARY KEY EXPLAIN ANALYZE BEGIN END TRANSACTION ROLLBACK".split())
#: Known to SQL, outside this dialect.
_OUTSIDE = set("DISTINCT HAVING OFFSET FETCH UNION INTERSECT EXCEPT WITH LEFT RIGHT FULL OUTER CROSS NATURAL OVER BETWEEN IN IS LIKE NULL CASE CAST EXISTS ALTER COMMIT RETURNING TRUNCATE MERGE".split())
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int


@dataclass(frozen=True)
class Literal:
    value: int | float | bool | str
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Star:
    table: str | None = None
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Name | None  # None: COUNT(*)
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Distance:
    location: Name
    point: tuple[float, float] | str  # a string names a parameter
    metric: str = "haversine"
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Score:
    function: str  # SCORE or SIMILARITY_SCORE
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Comparison:
    operator: str
    left: object
    right: object
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Logic:
    operator: str  # AND, OR, NOT
    parts: tuple


@dataclass(frozen=True)
class Match:
    column: Name
    query: str
    model: str
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Similar:
    key: str
    k: int
    index: str
    metric: str
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Item:
    value: object
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Order:
    value: object
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: Table
    join: Table | None = None
    on: object | None = None
    where: object | None = None
    group: tuple[Name, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class ColumnDefinition:
    name: str
    type: str
    length: int | None = None
    primary: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDefinition, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool


@dataclass(frozen=True)
class Drop:
    kind: str
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, object], ...]
    where: object | None


@dataclass(frozen=True)
class Explain:
    select: Select
    analyze: bool


@dataclass(frozen=True)
class Control:
    action: str  # BEGIN, END, ROLLBACK


def tokens(text: str) -> list[Token]:
    if len(text) > MAX_CHARACTERS:
        raise SqlLexicalError(f"a statement has at most {MAX_CHARACTERS} characters")
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlLexicalError("unterminated string" if text[at] == "'" else "malformed number" if text[at].isdigit() else "unexpected character", text, at)
        kind, value = m.lastgroup, m.group()
        if kind == "name":
            upper = value.upper()
            kind, value = ("word", upper) if upper in _WORDS | _OUTSIDE else ("name", value)
        elif kind == "string":
            value = value[1:-1].replace("''", "'")
        elif value == "!=":
            value = "<>"
        if kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def parse(text: str) -> object:
    return _Parser(text).statement()


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.all, self.i, self.depth = text, tokens(text), 0, 0

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def wrong(self, what: str, token: Token | None = None) -> SqlSyntaxError | SqlUnsupportedError:
        token = token or self.now
        if token.kind == "word" and token.value in _OUTSIDE:
            return SqlUnsupportedError(f"{token.value} is not part of this dialect", self.text, token.at)
        return SqlSyntaxError(f"expected {what}", self.text, token.at)

    def take(self, *values: str) -> Token | None:
        """The token, if it is one of these words or marks."""
        if self.now.kind in ("word", "mark") and self.now.value in values:
            self.i += 1
            return self.all[self.i - 1]
        return None

    def need(self, *values: str) -> Token:
        return self.take(*values) or self._fail(" or ".join(values))

    def _fail(self, what: str) -> Token:
        raise self.wrong(what)

    def of(self, kind: str, what: str) -> Token:
        if self.now.kind != kind:
            raise self.wrong(what)
        self.i += 1
        return self.all[self.i - 1]

    def call(self, *names: str) -> Token | None:
        """A function name with its opening parenthesis."""
        after = self.all[min(self.i + 1, len(self.all) - 1)]
        if self.now.kind == "name" and self.now.value.upper() in names and after.value == "(" and after.kind == "mark":
            self.i += 2
            return self.all[self.i - 2]
        return None

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def name(self, what: str = "a name") -> str:
        return self.of("name", what).value

    def statement(self) -> object:
        start = self.need("SELECT", "EXPLAIN", "INSERT", "DELETE", "UPDATE", "CREATE", "DROP", "BEGIN", "END", "ROLLBACK")
        out = getattr(self, f"_{start.value.lower()}")()
        self.take(";")
        if self.now.kind != "end":
            for word in ("FROM", "WHERE", "GROUP", "ORDER", "LIMIT", "JOIN"):
                if self.now.value == word and self.now.kind == "word":
                    what = "more than one JOIN is not part of this dialect" if word == "JOIN" else f"{word} twice or out of place"
                    raise (SqlUnsupportedError if word == "JOIN" else SqlSyntaxError)(what, self.text, self.now.at)
            raise self.wrong("the end of the statement")
        return out

    def _begin(self) -> Control:
        self.need("TRANSACTION")
        return Control("BEGIN")

    def _end(self) -> Control:
        self.need("TRANSACTION")
        return Control("END")

    def _rollback(self) -> Control:
        return Control("ROLLBACK")

    def _explain(self) -> Explain:
        analyze = bool(self.take("ANALYZE"))
        self.need("SELECT")
        return Explain(self._select(), analyze)

    def _select(self) -> Select:
        items = self.listed(self.item)
        self.need("FROM")
        if self.now.value == "(":
            raise SqlUnsupportedError("subqueries are not part of this dialect", self.text, self.now.at)
        table = self.table()
        join = on = where = limit = None
        group: tuple = ()
        order: tuple = ()
        if self.take("INNER"):
            self.need("JOIN")
            join = self.table()
        elif self.take("JOIN"):
            join = self.table()
        if join:
            self.need("ON")
            on = self.condition()
        if self.take("INNER", "JOIN"):
            raise SqlUnsupportedError("more than one JOIN is not part of this dialect", self.text, self.now.at)
        if self.take("WHERE"):
            where = self.condition()
        if self.take("GROUP"):
            self.need("BY")
            group = self.listed(self.column)
        if self.take("ORDER"):
            self.need("BY")
            order = self.listed(self.order_item)
        if self.take("LIMIT"):
            token = self.of("number", "a whole number")
            if "." in token.value:
                raise SqlSyntaxError("LIMIT needs a whole number", self.text, token.at)
            limit = int(token.value)
        return Select(items, table, join, on, where, group, order, limit)

    def table(self) -> Table:
        token = self.of("name", "a table name")
        alias = self.alias() or token.value
        return Table(token.value, alias, token.at)

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name("an alias")
        if self.now.kind == "name":
            self.i += 1
            return self.all[self.i - 1].value
        return None

    def item(self) -> Item:
        at = self.now.at
        if self.take("*"):
            return Item(Star(None, at))
        if self.now.kind == "name" and [t.value for t in self.all[self.i + 1 : self.i + 3]] == [".", "*"]:
            token = self.now
            self.i += 3
            return Item(Star(token.value, at))
        if found := self.call(*AGGREGATES):
            function = found.value.upper()
            if function == "COUNT" and self.take("*"):
                argument = None
            else:
                argument = self.column()
            self.need(")")
            return Item(Aggregate(function, argument, at), self.alias())
        value = self.special() or self.column()
        return Item(value, self.alias())

    def special(self) -> Distance | Score | None:
        at = self.now.at
        if found := self.call("SCORE", "SIMILARITY_SCORE"):
            self.need(")")
            return Score(found.value.upper(), at)
        if not self.call("DISTANCIA", "DISTANCE"):
            if self.now.kind == "name" and self.all[self.i + 1].value == "(":
                raise SqlUnsupportedError(f"function {self.now.value} is not part of this dialect", self.text, at)
            return None
        location = self.column()
        self.need(",")
        if self.call("POINT"):
            latitude = self.signed()
            self.need(",")
            longitude = self.signed()
            self.need(")")
            point: tuple[float, float] | str = (float(latitude.value), float(longitude.value))
        else:
            point = self.name("POINT or a parameter")
        metric = self.of("string", "a metric").value.lower() if self.take(",") else "haversine"
        self.need(")")
        return Distance(location, point, metric, at)

    def column(self) -> Name:
        first = self.of("name", "a column")
        if self.take("."):
            return Name(self.name("a column"), first.value, first.at)
        return Name(first.value, None, first.at)

    def signed(self) -> Literal:
        at = self.now.at
        sign = self.take("+", "-")
        token = self.of("number", "a number")
        value = float(token.value) if "." in token.value else int(token.value)
        value = -value if sign and sign.value == "-" else value
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            raise SqlLexicalError("an INTEGER has 64 bits", self.text, token.at)
        return Literal(value, at)

    def literal(self) -> Literal:
        at = self.now.at
        if self.now.kind == "string":
            self.i += 1
            return Literal(self.all[self.i - 1].value, at)
        if word := self.take("TRUE", "FALSE"):
            return Literal(word.value == "TRUE", at)
        return self.signed()

    def value(self) -> object:
        if self.now.kind == "name":
            return self.special() or self.column()
        return self.literal()

    def order_item(self) -> Order:
        if self.now.kind == "number":
            raise SqlUnsupportedError("ORDER BY takes columns, not positions", self.text, self.now.at)
        at = self.now.at
        value = self.value()
        if isinstance(value, Score) and value.function == "SCORE":
            raise SqlUnsupportedError("order by the score's name, not by SCORE()", self.text, at)
        direction = self.take("ASC", "DESC")
        return Order(value, not direction or direction.value == "ASC")

    def condition(self) -> object:
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Logic("OR", tuple(parts))

    def conjunction(self) -> object:
        parts = [self.negation()]
        while self.take("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Logic("AND", tuple(parts))

    def negation(self) -> object:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise SqlLimitError(f"conditions nest at most {MAX_DEPTH} deep", self.text, self.now.at)
        try:
            if self.take("NOT"):
                return Logic("NOT", (self.negation(),))
            if self.take("("):
                inside = self.condition()
                self.need(")")
                return inside
            return self.comparison()
        finally:
            self.depth -= 1

    def comparison(self) -> object:
        at = self.now.at
        if self.call("MATCH"):
            column = self.column()
            self.need(",")
            query = self.of("string", "the words to find").value
            self.need(")")
            self._word("USING")
            model = self.name("TF_IDF or BM25").upper()
            if model not in ("TF_IDF", "BM25"):
                raise SqlSyntaxError("expected TF_IDF or BM25", self.text, self.all[self.i - 1].at)
            return Match(column, query, model, at)
        if self.call("SIMILAR_TO"):
            key = self.of("string", "a media key").value
            self.need(",")
            self._word("K")
            self.need("=")
            k = self.signed()
            self.need(")")
            self._word("USING")
            index = self.name("IVF or HNSW").upper()
            if self.now.value == "WITH":
                self.i += 1
            self._word("METRIC")
            self.need("=")
            metric = self.name("a metric").lower()
            if index not in ("IVF", "HNSW") or metric not in ("euclidean", "cosine", "dot") or not isinstance(k.value, int) or k.value < 1:
                raise SqlSyntaxError("expected k >= 1, IVF or HNSW, and euclidean, cosine or dot", self.text, at)
            return Similar(key, k.value, index, metric, at)
        left = self.value()
        operator = self.need(*COMPARISONS)
        return Comparison(operator.value, left, self.value(), at)

    def _word(self, word: str) -> None:
        if self.now.kind != "name" or self.now.value.upper() != word:
            raise self.wrong(word)
        self.i += 1

    def _insert(self) -> Insert:
        self.need("INTO")
        table = self.name("a table name")
        columns = None
        if self.take("("):
            columns = self.listed(self.name)
            self.need(")")
        if self.now.value == "SELECT":
            raise SqlUnsupportedError("INSERT takes VALUES", self.text, self.now.at)
        self.need("VALUES")
        self.need("(")
        values = self.listed(self.literal)
        self.need(")")
        if self.now.value == ",":
            raise SqlUnsupportedError("INSERT takes one row", self.text, self.now.at)
        return Insert(table, columns, values)

    def _delete(self) -> Delete:
        self.need("FROM")
        table = self.name("a table name")
        return Delete(table, self.condition() if self.take("WHERE") else None)

    def _update(self) -> Update:
        table = self.name("a table name")
        self.need("SET")

        def change() -> tuple[str, object]:
            column = self.name("a column")
            self.need("=")
            return column, self.value()

        changes = self.listed(change)
        return Update(table, changes, self.condition() if self.take("WHERE") else None)

    def _create(self) -> CreateTable | CreateIndex:
        if self.take("TABLE"):
            name = self.name("a table name")
            self.need("(")
            columns = self.listed(self.definition)
            self.need(")")
            return CreateTable(name, columns)
        unique = bool(self.take("UNIQUE"))
        self.need("INDEX")
        name = self.name("an index name")
        self.need("ON")
        table = self.name("a table name")
        self.need("(")
        column = self.name("a column")
        if self.now.value == ",":
            raise SqlUnsupportedError("an index has one column", self.text, self.now.at)
        self.need(")")
        return CreateIndex(name, table, column, unique)

    def definition(self) -> ColumnDefinition:
        name, token = self.name("a column"), self.of("name", "a type")
        kind = {"INT": "INTEGER"}.get(token.value.upper(), token.value.upper())
        if kind not in ("INTEGER", "FLOAT", "BOOLEAN", "VARCHAR"):
            raise SqlUnsupportedError(f"type {token.value} is not part of this dialect", self.text, token.at)
        length = None
        if kind == "VARCHAR":
            self.need("(")
            n = self.of("number", "a length")
            if "." in n.value or not 1 <= int(n.value) <= 4075:
                raise SqlSyntaxError("VARCHAR lengths go from 1 to 4075", self.text, n.at)
            length = int(n.value)
            self.need(")")
        primary = bool(self.take("PRIMARY"))
        if primary:
            self.need("KEY")
        return ColumnDefinition(name, kind, length, primary)

    def _drop(self) -> Drop:
        kind = self.need("TABLE", "INDEX").value
        return Drop(kind, self.name())
