"""Comments, strings and code of source texts, by one table of languages.

What isn't nested is one regular expression made from the table, so it is removed without leaving the JVM; nested comments are followed by their depth, in Arrow batches.
A string that ends with its line ends there even without its closing quote; a comment or a string of several lines that isn't closed goes on to the end of the text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Language:
    """Marks that open a comment to the end of the line, pairs around comments, quotes of one line and of several. escape: a backslash, or nothing where quotes are doubled."""

    line: tuple[str, ...] = ()
    blocks: tuple[tuple[str, str], ...] = ()
    quotes: tuple[str, ...] = ()
    long_quotes: tuple[str, ...] = ()
    escape: str = "\\"
    nested: bool = False
    #: What is named at the start of a line: (kind, pattern with the name as its group).
    names: tuple[tuple[str, str], ...] = ()


_C = Language(("//",), (("/*", "*/"),), ('"', "'"), names=(("class", r"(?:class|struct|enum)[ \t]+(\w+)"), ("constant", r"#define[ \t]+([A-Z_][A-Z0-9_]*)\b"), ("function", r"[A-Za-z_][\w \t*&<>:,]*?[ \t*&](\w+)[ \t]*\([^;]*$")))
LANGUAGES = {
    "python": Language(("#",), (), ('"', "'"), ('"""', "'''"), names=(("function", r"(?:async[ \t]+)?def[ \t]+(\w+)"), ("class", r"class[ \t]+(\w+)"), ("constant", r"([A-Z_][A-Z0-9_]*)[ \t]*=(?!=)"))),
    "shell": Language(("#",), (), ('"', "'"), names=(("function", r"(?:function[ \t]+)?(\w+)[ \t]*\(\)"), ("constant", r"(?:readonly[ \t]+)?([A-Z_][A-Z0-9_]*)="))),
    "c": _C,
    "java": Language(_C.line, _C.blocks, _C.quotes, ('"""',), names=(("class", r"(?:(?:public|abstract|final|sealed)[ \t]+)*(?:class|interface|enum|record)[ \t]+(\w+)"),)),
    "javascript": Language(_C.line, _C.blocks, _C.quotes, ("`",), names=(("function", r"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t*]+(\w+)"), ("class", r"(?:export[ \t]+)?(?:default[ \t]+)?class[ \t]+(\w+)"), ("constant", r"(?:export[ \t]+)?const[ \t]+([A-Z_][A-Z0-9_]*)\b"))),
    "go": Language(_C.line, _C.blocks, ('"', "'"), ("`",), names=(("function", r"func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)"), ("class", r"type[ \t]+(\w+)"), ("constant", r"const[ \t]+(\w+)"))),
    "css": Language((), _C.blocks, _C.quotes),
    "sql": Language(("--",), _C.blocks, ('"', "'"), escape="", names=(("class", r"(?i:create[ \t]+table[ \t]+)(\w+)"), ("function", r"(?i:create[ \t]+(?:or[ \t]+replace[ \t]+)?function[ \t]+)(\w+)"))),
    "html": Language((), (("<!--", "-->"),)),
    "lua": Language(("--",), (("--[[", "]]"),), ('"', "'"), ("[[",), names=(("function", r"(?:local[ \t]+)?function[ \t]+([\w.:]+)"),)),
    "ini": Language(("#", ";")),
    "rust": Language(_C.line, _C.blocks, ('"',), nested=True, names=(("function", r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|const[ \t]+|unsafe[ \t]+)*fn[ \t]+(\w+)"), ("class", r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:struct|enum|trait)[ \t]+(\w+)"), ("constant", r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:const|static)[ \t]+(\w+)[ \t]*:"))),
    "haskell": Language(("--",), (("{-", "-}"),), ('"',), nested=True, names=(("class", r"(?:data|newtype|class)[ \t]+(\w+)"),)),
}


def _quoted(mark: str, escape: str, long: bool) -> str:
    """A string between two marks: runs of other characters, escaped ones, and parts of the mark that aren't all of it."""
    close = re.escape({"[[": "]]"}.get(mark, mark))
    first = re.escape({"[[": "]"}.get(mark, mark[0]))
    end = "" if long else "\\n"
    inner = f"[^{first}{re.escape(escape)}{end}]++"
    if escape:
        inner += rf"|\\[\s\S]" if long else r"|\\[^\n]"
    elif not long:
        inner += f"|{close}{close}"
    if len(mark) > 1:
        inner += "".join(f"|{first}{{{k}}}(?!{first})" for k in range(1, len(mark)))
    return f"{re.escape(mark)}(?:{inner})*+(?:{close}|\\z)" if long else f"{re.escape(mark)}(?:{inner})*+{close}?"


@functools.cache
def strings_pattern(name: str) -> str:
    own = LANGUAGES[name]
    return "|".join([_quoted(m, own.escape, True) for m in own.long_quotes] + [_quoted(m, own.escape, False) for m in own.quotes])


@functools.cache
def comments_pattern(name: str) -> str:
    own = LANGUAGES[name]
    blocks = [rf"{re.escape(a)}[\s\S]*?(?:{re.escape(b)}|\z)" for a, b in own.blocks]
    return "|".join(blocks + [rf"{re.escape(m)}[^\n]*+" for m in own.line])


def without_comments(source: Column, name: str) -> Column:
    """Source without its comments; strings stay as they are."""
    if LANGUAGES[name].nested:
        return stripper(name)(source)
    if not strings_pattern(name):
        return F.regexp_replace(source, comments_pattern(name), "")
    return F.regexp_replace(source, f"({strings_pattern(name)})|{comments_pattern(name)}", "$1")


@functools.cache
def _scanner(name: str) -> tuple[re.Pattern, re.Pattern | None]:
    own, python = LANGUAGES[name], lambda p: p.replace(r"\z", r"\Z")
    strings = strings_pattern(name)
    if not own.nested:
        return re.compile(python(f"(?P<s>{strings})|" * bool(strings) + f"(?P<c>{comments_pattern(name)})")), None
    marks = [re.escape(x) for pair in own.blocks for x in pair]
    line = "|".join(rf"{re.escape(m)}[^\n]*+" for m in own.line)
    return re.compile(python(f"(?P<s>{strings})|(?P<c>{line})|(?P<o>{'|'.join(marks[::2])})")), re.compile(f"(?P<o>{'|'.join(marks[::2])})|{'|'.join(marks[1::2])}")


def parts(source: str, name: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all strings ('s') and comments ('c')."""
    scan, marks = _scanner(name)
    at = 0
    while found := scan.search(source, at):
        kind, start, at = found.lastgroup, found.start(), found.end()
        if kind == "o":
            depth = 1
            while depth:
                mark = marks.search(source, at)
                if mark is None:
                    at = len(source)
                    break
                depth, at = depth + (1 if mark.lastgroup == "o" else -1), mark.end()
        yield "s" if kind == "s" else "c", start, at


def stripped(source: str, name: str) -> str:
    out, at = [], 0
    for kind, start, end in parts(source, name):
        if kind == "c":
            out.append(source[at:start])
            at = end
    return "".join([*out, source[at:]])


def named(source: str, name: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of what is defined at the starts of lines, outside comments and strings."""
    out, at = [], 0
    blank = re.compile(r"[^\n]")
    for _, start, end in parts(source, name):
        out += [source[at:start], blank.sub(" ", source[start:end])]
        at = end
    patterns = [(kind, re.compile(p)) for kind, p in LANGUAGES[name].names]
    found = []
    for k, line in enumerate("".join([*out, source[at:]]).split("\n"), 1):
        hit = next(((m[1], kind, k) for kind, p in patterns if (m := p.match(line))), None)
        found += [hit] if hit else []
    return found


def stripper(name: str) -> Callable:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else stripped(x, name))

    return run


def names(name: str) -> Callable:
    """A function of source: an array of (name, kind, line)."""

    @F.pandas_udf(T.ArrayType(T.StructType().add("name", T.StringType()).add("kind", T.StringType()).add("line", T.IntegerType())))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else named(x, name))

    return run
