"""Front end of the SQL dialect: text to statements, with byte offsets in errors.

Six statements over one table each. AND and OR do not mix, there are no parentheses and no
NOT, a sign belongs to its number, and a quoted word is an identifier.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

INT_MIN, INT_MAX = -(2**63), 2**63 - 1


class SqlError(ValueError):
    """A statement that can't be read or run; ``offset`` is a byte offset into its text."""

    def __init__(self, message: str, offset: int | None = None):
        super().__init__(message if offset is None else f"{message} at byte {offset}")
        self.offset = offset


@dataclass(frozen=True)
class Literal:
    kind: str  # int, float, text, null
    value: object = None


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    literal: Literal


@dataclass(frozen=True)
class Filter:
    joiner: str  # and, or
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str = ""
    primary_key: bool = False
    not_null: bool = False


@dataclass(frozen=True)
class Statement:
    kind: str
    table: str

    @property
    def is_mutation(self) -> bool:
        return self.kind != "select"


@dataclass(frozen=True)
class CreateTable(Statement):
    columns: tuple[ColumnDef, ...] = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable(Statement):
    if_exists: bool = False


@dataclass(frozen=True)
class Insert(Statement):
    columns: tuple[str, ...] = ()
    rows: tuple[tuple[Literal, ...], ...] = ()


@dataclass(frozen=True)
class Select(Statement):
    columns: tuple[str, ...] = ()  # none: all
    where: Filter | None = None
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Update(Statement):
    assignments: tuple[tuple[str, Literal], ...] = ()
    where: Filter | None = None


@dataclass(frozen=True)
class Delete(Statement):
    where: Filter | None = None


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, int, float, text, op, end
    value: object
    offset: int
    end: int = field(default=0, compare=False)


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
      | (?P<float>[+-]?\d+\.\d+)
      | (?P<int>[+-]?\d+)
      | (?P<text>'(?:[^']|'')*')
      | (?P<quoted>"[^"]*")
      | (?P<word>[^\W\d]\w*)
      | (?P<op><>|!=|<=|>=|[=<>(),*;.])""",
    re.VERBOSE,
)


def tokenize(sql: str) -> list[Token]:
    out: list[Token] = []
    at = byte = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            c = sql[at]
            what = {"'": "unterminated string", '"': "unterminated quoted identifier"}.get(c, f"unexpected character {c!r}")
            what = "unterminated comment" if sql.startswith("/*", at) else what
            raise SqlError(what, byte)
        kind, raw = m.lastgroup, m[0]
        value: object = raw
        if kind == "int":
            value = int(raw)
            if not INT_MIN <= value <= INT_MAX:
                raise SqlError(f"integer out of range: {raw}", byte)
        elif kind == "float":
            value = float(raw)
        elif kind == "text":
            value = raw[1:-1].replace("''", "'")
        elif kind == "quoted":
            value = raw[1:-1]
            if not value:
                raise SqlError("empty identifier", byte)
        elif kind == "op" and raw == "!=":
            value = "<>"
        width = len(raw.encode())
        if kind != "skip":
            out.append(Token(kind, value, byte, byte + width))
        at, byte = m.end(), byte + width
    out.append(Token("end", None, byte, byte))
    return out


class Parser:
    def __init__(self, sql: str):
        self.tokens = tokenize(sql)
        self.at = 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str) -> SqlError:
        got = "end of statement" if self.now.kind == "end" else repr(self.now.value)
        return SqlError(f"expected {wanted}, found {got}", self.now.offset)

    def is_word(self, word: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return t.kind == "word" and str(t.value).upper() == word

    def take_word(self, word: str) -> bool:
        if self.is_word(word):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take_word(w):
                raise self.fail(w)

    def take_op(self, op: str) -> bool:
        if self.now.kind == "op" and self.now.value == op:
            self.at += 1
            return True
        return False

    def need_op(self, op: str) -> None:
        if not self.take_op(op):
            raise self.fail(f"'{op}'")

    def name(self, what: str) -> str:
        if self.now.kind not in ("word", "quoted"):
            raise self.fail(what)
        self.at += 1
        return str(self.tokens[self.at - 1].value)

    def literal(self) -> Literal:
        t = self.now
        if t.kind in ("int", "float", "text"):
            self.at += 1
            return Literal(t.kind, t.value)
        if t.kind in ("word", "quoted") and str(t.value).upper() == "NULL":
            self.at += 1
            return Literal("null")
        raise self.fail("a literal")

    def listed(self, item) -> tuple:
        out = [item()]
        while self.take_op(","):
            out.append(item())
        return tuple(out)

    def in_parens(self, item) -> tuple:
        self.need_op("(")
        out = self.listed(item)
        self.need_op(")")
        return out

    def where(self) -> Filter | None:
        if not self.take_word("WHERE"):
            return None
        parts, joiner = [self.predicate()], None
        while self.is_word("AND") or self.is_word("OR"):
            word = str(self.now.value).lower()
            if joiner not in (None, word):
                raise SqlError("AND and OR in one WHERE are ambiguous", self.now.offset)
            joiner = word
            self.at += 1
            parts.append(self.predicate())
        return Filter(joiner or "and", tuple(parts))

    def predicate(self) -> Predicate:
        column = self.name("a column")
        if self.now.kind != "op" or self.now.value not in ("=", "<>", "<", "<=", ">", ">="):
            raise self.fail("a comparison")
        op = str(self.now.value)
        self.at += 1
        return Predicate(column, op, self.literal())

    def column_def(self) -> ColumnDef:
        name, kind, pk, nn = self.name("a column"), "", False, False
        if self.now.kind in ("word", "quoted") and not (self.is_word("PRIMARY") or self.is_word("NOT")):
            kind = self.name("a type")
            if self.now.kind == "op" and self.now.value == "(":
                self.in_parens(self.width)
        while True:
            if self.take_word("PRIMARY"):
                self.need("KEY")
                pk = True
            elif self.take_word("NOT"):
                self.need("NULL")
                nn = True
            else:
                return ColumnDef(name, kind, pk, nn or pk)

    def width(self) -> int:
        if self.now.kind != "int":
            raise self.fail("a width")
        self.at += 1
        return self.tokens[self.at - 1].value

    def statement(self) -> Statement:
        if self.take_word("CREATE"):
            self.need("TABLE")
            quiet = self.take_word("IF")
            if quiet:
                self.need("NOT", "EXISTS")
            table = self.name("a table")
            out: Statement = CreateTable("create", table, self.in_parens(self.column_def), quiet)
        elif self.take_word("DROP"):
            self.need("TABLE")
            quiet = self.take_word("IF")
            if quiet:
                self.need("EXISTS")
            out = DropTable("drop", self.name("a table"), quiet)
        elif self.take_word("INSERT"):
            self.need("INTO")
            table = self.name("a table")
            has = self.now.kind == "op" and self.now.value == "("
            columns = self.in_parens(lambda: self.name("a column")) if has else ()
            self.need("VALUES")
            out = Insert("insert", table, columns, self.listed(lambda: self.in_parens(self.literal)))
        elif self.take_word("SELECT"):
            columns = () if self.take_op("*") else self.listed(lambda: self.name("a column"))
            self.need("FROM")
            table, where = self.name("a table"), self.where()
            order, down, limit = None, False, None
            if self.take_word("ORDER"):
                self.need("BY")
                order = self.name("a column")
                down = self.take_word("DESC") or (self.take_word("ASC") and False)
            if self.take_word("LIMIT"):
                if self.now.kind != "int" or self.now.value < 0:
                    raise self.fail("a limit of 0 or more")
                limit = self.now.value
                self.at += 1
            out = Select("select", table, columns, where, order, down, limit)
        elif self.take_word("UPDATE"):
            table = self.name("a table")
            self.need("SET")
            out = Update("update", table, self.listed(self.assignment), self.where())
        elif self.take_word("DELETE"):
            self.need("FROM")
            out = Delete("delete", self.name("a table"), self.where())
        else:
            raise self.fail("a statement")
        self.take_op(";")
        if self.now.kind != "end":
            raise self.fail("the end of the statement")
        return out

    def assignment(self) -> tuple[str, Literal]:
        column = self.name("a column")
        self.need_op("=")
        return column, self.literal()


def parse(sql: str) -> Statement:
    return Parser(sql).statement()
