"""CREATE TABLE statements: typed columns, one PRIMARY KEY, string properties."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Declared type -> Spark type. DECIMAL without digits is a double, with them an exact decimal.
TYPES = {
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DECIMAL": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DATE": T.DateType(),
    "BOOLEAN": T.BooleanType(),
    "FLOAT": T.FloatType(),
    "SMALLINT": T.ShortType(),
}
_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|('(?:[^']|'')*')|`([^`]+)`|\"([^\"]+)\"|([A-Za-z_][\w$]*)|(\d+)|([(),;=.])", re.S)


class DdlError(ValueError):
    pass


@dataclass
class Table:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    properties: dict[str, str] = field(default_factory=dict)
    if_not_exists: bool = False

    @property
    def path(self) -> str | None:
        return self.properties.get("path")

    @property
    def cardinality(self) -> int:
        return int(self.properties.get("cardinality", 0))


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise DdlError(f"unexpected {text[at : at + 20]!r}")
            at = m.end()
            string, back, double, word, number, mark = m.groups()
            if string is not None:
                self.tokens.append(("string", string[1:-1].replace("''", "'")))
            elif back or double:
                self.tokens.append(("name", back or double))
            elif word:
                self.tokens.append(("word", word))
            elif number:
                self.tokens.append(("number", number))
            elif mark:
                self.tokens.append((mark, mark))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def accept(self, *words: str) -> bool:
        """Take these key words or marks if they come next."""
        ahead = self.tokens[self.at : self.at + len(words)]
        if len(ahead) == len(words) and all((k == "word" and v.upper() == w) or k == w for (k, v), w in zip(ahead, words, strict=True)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise DdlError(f"expected {' '.join(words)} before {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.take()
        if kind not in ("word", "name"):
            raise DdlError(f"expected a name before {value!r}")
        return value

    def separated(self, item) -> list:
        out = [item()]
        while self.accept(","):
            out.append(item())
        return out


def _type(r: _Reader) -> T.DataType:
    name = r.name().upper()
    args = []
    if r.accept("("):
        args = [int(x) for x in r.separated(lambda: r.take()[1])]
        r.expect(")")
    if name == "DECIMAL" and args:
        return T.DecimalType(*args)
    if name not in TYPES and name != "CHAR":
        raise DdlError(f"unknown type {name}")
    return TYPES.get(name, T.StringType())


def _table(r: _Reader) -> Table:
    r.expect("CREATE", "TABLE")
    lenient = r.accept("IF", "NOT", "EXISTS")
    name = r.name()
    r.expect("(")
    fields, keys = [], []

    def element() -> None:
        if r.accept("CONSTRAINT"):
            r.name()
            r.expect("PRIMARY", "KEY")
        elif not r.accept("PRIMARY", "KEY"):
            column, kind = r.name(), _type(r)
            nullable = not r.accept("NOT", "NULL")
            fields.append(T.StructField(column, kind, nullable))
            if r.accept("PRIMARY", "KEY"):
                keys.append((column,))
            return
        r.expect("(")
        keys.append(tuple(r.separated(r.name)))
        r.expect(")")

    r.separated(element)
    r.expect(")")
    properties = {}
    if r.accept("WITH"):
        r.expect("(")

        def pair() -> None:
            (k1, key), _, (k2, value) = r.take(), r.expect("="), r.take()
            if k1 != "string" or k2 != "string":
                raise DdlError("properties are 'key' = 'value'")
            properties[key] = value

        r.separated(pair)
        r.expect(")")
    names = [f.name.lower() for f in fields]
    if len(keys) > 1:
        raise DdlError(f"{name} has more than one primary key")
    if len(set(names)) < len(names):
        raise DdlError(f"{name} repeats a column")
    for c in keys[0] if keys else ():
        if c.lower() not in names:
            raise DdlError(f"primary key column {c} isn't in {name}")
    return Table(name, T.StructType(fields), keys[0] if keys else (), properties, lenient)


def parse(text: str) -> list[Table]:
    """The tables of one or several statements, separated by semicolons."""
    r, out = _Reader(text), []
    while r.peek()[0] != "end":
        if r.accept(";"):
            continue
        out.append(_table(r))
        if r.peek()[0] not in (";", "end"):
            raise DdlError(f"unexpected {r.peek()[1]!r}")
    return out
