"""Table containers: CSV, JSON, JSON lines, SQL dumps and SQLite, read and written through Spark."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Order of the type lattice: bool and int are INTEGER, any float makes REAL, anything else TEXT.
INTEGER, REAL, TEXT = "INTEGER", "REAL", "TEXT"


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Every value a string; the separator follows the extension. A quoted empty cell is the empty string, a missing or bare one null."""
    return spark.read.option("header", True).option("sep", sep or ("\t" if path.endswith(".tsv") else ",")).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\x00").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON text, nulls as nothing."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]).write.option("header", True).option("escape", '"').option("nullValue", "").csv(path)


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A list of objects is one table; an object of lists is one table each; a scalar is a `value` column."""
    df = spark.read.option("multiLine", True).json(path)
    lists = [f for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists and len(lists) == len(df.schema):
        return {f.name: df.select(F.inline(f.name)) for f in lists}
    return {"data": df}


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One record a line; blank lines are passed over, bad ones dropped, or fatal if strict."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(F.ltrim(F.regexp_replace("value", "^﻿", "")).alias("value"))
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def sql_literal(c) -> F.Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")))


def insert_lines(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement a row."""
    number = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    one = [F.coalesce(F.col(f.name).cast("string"), F.lit("NULL")) if isinstance(f.dataType, number) else F.coalesce(F.col(f.name).cast("int").cast("string"), F.lit("NULL")) if isinstance(f.dataType, T.BooleanType) else sql_literal(F.col(f.name)) for f in df.schema]
    names = ", ".join(df.columns)
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), F.concat_ws(", ", *one), F.lit(");")).alias("value"))


def tokens_of(statement: str) -> Iterator[tuple[str, object]]:
    """Tokens of an INSERT's value list: ('(' | ')' | ',' | 'value', payload)."""
    i, n = 0, len(statement)
    while i < n:
        c = statement[i]
        if c in "(),":
            yield c, None
            i += 1
        elif c in "'\"":
            out, i = [], i + 1
            while i < n:
                if statement[i] == "\\" and c == "'" and i + 1 < n:
                    out.append({"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(statement[i + 1], statement[i + 1]))
                    i += 2
                elif statement[i] == c and statement[i + 1 : i + 2] == c:
                    out.append(c)
                    i += 2
                elif statement[i] == c:
                    i += 1
                    break
                else:
                    out.append(statement[i])
                    i += 1
            yield "value", "".join(out)
        elif c.isspace() or c == ";":
            i += 1
        else:
            j = i
            while j < n and statement[j] not in "(), ;\n\t":
                j += 1
            word = statement[i:j]
            i = j
            low = word.upper()
            if low in ("NULL", "TRUE", "FALSE"):
                yield "value", {"NULL": None, "TRUE": True, "FALSE": False}[low]
            else:
                try:
                    yield "value", int(word)
                except ValueError:
                    try:
                        yield "value", float(word)
                    except ValueError:
                        yield "value", word


def statements(text: str) -> Iterator[str]:
    """Statements, cut at semicolons outside quotes."""
    start, quote, i = 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c == ";":
            yield text[start:i].strip()
            start = i + 1
        i += 1
    if text[start:].strip():
        yield text[start:].strip()


def dump_rows(text: str) -> Iterator[tuple[str, dict]]:
    """(table, row) of every INSERT; columns come from the statement, else CREATE TABLE, else c0, c1 ...; surplus values are _extra_values."""
    import re

    columns: dict[str, list[str]] = {}
    for s in statements(text):
        if m := re.match(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?(\w+)[`\"]?\s*\((.*)\)", s):
            parts, depth, own = [], 0, ""
            for c in m[2] + ",":
                depth += (c == "(") - (c == ")")
                if c == "," and not depth:
                    parts.append(own.strip())
                    own = ""
                else:
                    own += c
            columns[m[1]] = [p.split()[0].strip('`"') for p in parts if p and p.split()[0].upper() not in ("PRIMARY", "UNIQUE", "KEY", "CONSTRAINT", "FOREIGN", "CHECK", "INDEX")]
        elif m := re.match(r"(?is)insert\s+(?:or\s+\w+\s+|ignore\s+)?into\s+[`\"]?(\w+)[`\"]?\s*(\([^)]*\))?\s*values\s*(.*)", s):
            names = [x.strip().strip('`"') for x in m[2][1:-1].split(",")] if m[2] else columns.get(m[1])
            row: list | None = None
            for kind, v in tokens_of(m[3]):
                if kind == "(":
                    row = []
                elif kind == ")" and row is not None:
                    own = names or [f"c{k}" for k in range(len(row))]
                    out = dict(zip(own, row, strict=False))
                    if len(row) > len(own):
                        out["_extra_values"] = row[len(own) :]
                    yield m[1], out
                    row = None
                elif kind == "value" and row is not None:
                    row.append(v)


def parse_dumps(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(table, row) of whole dump texts, row as JSON; a text is parsed where it lies."""

    def run(batches):
        import json

        for pdf in batches:
            for text in pdf[text_col]:
                rows = [(t, json.dumps(r, ensure_ascii=False)) for t, r in dump_rows(text or "")]
                yield pd.DataFrame(rows, columns=["table", "row"])

    return df.select(text_col).mapInPandas(run, "table string, row string")


def infer_type(values) -> str:
    """The lattice's least type that holds all values."""
    found = {type(v) for v in values if v is not None}
    if not found:
        return TEXT
    if found <= {bool, int}:
        return INTEGER
    return REAL if found <= {bool, int, float} else TEXT


def sqlite_bytes(tables: dict[str, list[dict]]) -> bytes:
    """A SQLite file of small tables."""
    con = sqlite3.connect(":memory:")
    for name, rows in tables.items():
        cols = list(dict.fromkeys(k for r in rows for k in r))
        con.execute(f'CREATE TABLE "{name}" (' + ", ".join(f'"{c}" {infer_type([r.get(c) for r in rows])}' for c in cols) + ")")
        con.executemany(f'INSERT INTO "{name}" VALUES (' + ", ".join("?" * len(cols)) + ")", [[r.get(c) for c in cols] for r in rows])
    con.commit()
    out = con.serialize()
    con.close()
    return out


def sqlite_rows(content: bytes) -> Iterator[tuple[str, dict]]:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    con.row_factory = sqlite3.Row
    names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    for name in names:
        for r in con.execute(f'SELECT * FROM "{name}"'):
            yield name, dict(r)
    con.close()


class _Table(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")]
        con.close()
        return [_Table(n) for n in names] or [_Table(None)]

    def read(self, partition):
        import json

        if partition.value is None:
            return
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        con.row_factory = sqlite3.Row
        for r in con.execute(f'SELECT * FROM "{partition.value}"'):
            yield partition.value, json.dumps({k: v.hex() if isinstance(v, bytes) else v for k, v in dict(r).items()}, ensure_ascii=False)
        con.close()


class SqliteSource(DataSource):
    """spark.read.format("sqlite").load(path): (table, row as JSON), one partition per table of a file that executors can open."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        return "table string, row string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


#: Formats by name: (write(df, path), read(spark, path, schema)).
FORMATS = {
    "csv": (write_csv, lambda spark, path, schema: read_csv(spark, path)),
    "json": (lambda df, path: df.write.json(path), lambda spark, path, schema: spark.read.schema(schema).json(path)),
    "jsonl": (lambda df, path: df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path), lambda spark, path, schema: read_jsonl(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))),
    "parquet": (lambda df, path: df.write.parquet(path), lambda spark, path, schema: spark.read.schema(schema).parquet(path)),
}
