"""Secret scan in DataFrame functions alone: patterns, and sliding-window Shannon entropy over candidate strings.

A pattern's matches and the gaps between them give every match's place in code points. Candidate strings are maximal
runs of [A-Za-z0-9+/_=-] of at least WINDOW characters with a letter and a digit, or with letters of both cases. A window of
WINDOW characters slides over each: of the counts, packed in a few 64-bit numbers, the one of the character that enters
and the one of the character that leaves change, and with them the sum of c*log2(c), kept in fixed point so that it never
drifts; entropy is log2(w) - sum/w. The class of the candidate (hexadecimal, base-64, letters) sets the threshold.
Windows above it merge into `entropy` spans. The allow-list suppresses candidates of a harmless shape, and windows that
overlap a placeholder; the patterns' own spans always stay. Blocks of a candidate are
scanned each on its own, WINDOW places early, and spans that touch are joined, so time is linear in a text, however long its candidates and however many their spans are.
All of it is projection: no shuffle, no Python, so hot sources can't skew it.

Cases: a null or empty text has no spans. A very long text, or one that is a single candidate, costs time and memory in
proportion to its length. Repeated documents each get a row. Spans of different kinds may overlap; a window whose entropy
equals the threshold counts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns: what matches, the group that must be long enough, and how long.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A cheaper pattern that every kept match contains.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])(?:(?=[A-Za-z+/_=-]*+[0-9])|(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z]))[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "base64": 3.8, "letters": 4.0}
#: Whole candidates of these shapes are no secrets: identifiers and words put together.
SHAPES = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]++(?:[-_/=][A-Za-z]++)*+[-_/=]?[0-9]{1,4}$",
    r"^(?:[A-Za-z]{2,}+[-_/=])++[A-Za-z0-9]{0,8}$",
)
#: Windows that overlap one of these, in either case, are no secrets: placeholders and runs of the alphabet.
PLACEHOLDERS = ("example", "sample", "placeholder", "dummy", "changeme", "redacted", "xxxxx", "abcdefgh", "0123456789", "qwertyuiop")
#: c*log2(c) is kept in units of 2**-UNIT.
UNIT = 40
#: Matches whose places are summed up together.
BLOCK = 512
#: Places over which a window slides in one go.
STEPS = 256

_SPAN = "array<struct<a:int,k:int,b:int>>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(text: Column, pattern: str, group: int, keep, make, kind: str) -> Column:
    """make(start, end, match) of every match for which keep(match, group) holds, as an array<kind>.

    Places are sums of the lengths of gaps and matches: within blocks of BLOCK matches, then over the blocks, so that no
    array grows by one at a time.
    """
    none = F.from_json(F.lit("[]"), "array<struct<a:int,b:int,m:string>>")
    # gap, match and group; behind the last match is a gap alone
    matches = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def step(acc, x):
        a = acc["p"] + F.char_length(x["g"])
        b = a + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.array(F.struct(a.alias("a"), b.alias("b"), x["m"].alias("m")))
        return F.struct(b.alias("p"), F.when(x["m"].isNotNull() & keep(x["m"], x["v"]), F.concat(acc["s"], one)).otherwise(acc["s"]).alias("s"))

    def blocks(m):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda j: F.aggregate(F.slice(m, j * BLOCK + 1, BLOCK), F.struct(F.lit(0).alias("p"), none.alias("s")), step))

    def moved(r):
        # where each block starts; an accumulator is copied at each step, so it holds no more than a number a block
        starts = F.aggregate(r, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["p"])))
        return _let(starts, lambda at: F.flatten(F.transform(r, lambda x, j: F.transform(x["s"], lambda y: make(y["a"] + F.get(at, j), y["b"] + F.get(at, j), y["m"])))))

    return _let(_let(matches, blocks), moved)


def _spans(kind: str, text: Column) -> Column:
    pattern, group, least = PATTERNS[kind]
    make = lambda a, b, m: F.struct(a.alias("a"), F.lit(KINDS.index(kind)).alias("k"), b.alias("b"))
    found = _placed(text, pattern, group, lambda m, v: F.char_length(v) >= least, make, "struct<a:int,k:int,b:int>")
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.from_json(F.lit("[]"), _SPAN))


def candidates(text: Column, shapes: tuple = SHAPES) -> Column:
    """Array of (a, v): where a candidate starts and its characters, without those of a harmless shape."""

    def keep(m, v):
        out = F.lit(True)
        for p in shapes:
            out = out & ~m.rlike(p)
        return out

    kind = "struct<a:int,v:string>"
    found = _placed(text, CANDIDATE, 0, keep, lambda a, b, m: F.struct(a.alias("a"), m.alias("v")), kind)
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.from_json(F.lit("[]"), f"array<{kind}>"))


def _fixed(c: int) -> int:
    return round(c * math.log2(c) * 2**UNIT) if c else 0


def _most(threshold: float, window: int) -> int:
    """The greatest sum of c*log2(c) of a window whose entropy is at least the threshold."""
    return math.floor((math.log2(window) - threshold) * window * 2**UNIT) + window


def _entropy_expression(window: int, thresholds: dict[str, float], placeholders: tuple) -> str:
    """SQL for the merged windows above the threshold of every candidate in column `candidates`."""
    bits = window.bit_length()
    held = 63 // bits  # counts in one number
    words = -(-len(ALPHABET) // held)
    gains = "array(" + ", ".join(f"{_fixed(c + 1) - _fixed(c)}L" for c in range(window + 1)) + ")"
    masked = "y.v"
    for p in placeholders:
        masked = f"regexp_replace({masked}, '(?i){p}', '{'~' * len(p)}')"
    # codes count from 0; a masked character has -1, as has the end that is put behind the last character
    codes = f"concat(transform(split({masked}, ''), c -> instr({_quoted(ALPHABET)}, c) - 1), array(-1))"
    most = f"case when y.v rlike '^[0-9a-fA-F]+$' then {_most(thresholds['hex'], window)}L when y.v rlike '[0-9]' then {_most(thresholds['base64'], window)}L else {_most(thresholds['letters'], window)}L end"
    ready = f"transform(candidates, y -> named_struct('a', y.a, 'h', {most}, 'c', {codes}))"
    chars = f"transform(transform(t.c, (k, i) -> named_struct('i', i, 'k', k, 'g', if(i >= {window}, t.c[i - {window}], -1))), x -> named_struct('i', x.i, 'k', x.k, 'g', x.g, 'kw', if(x.k < 0, -1, x.k div {held}), 'kq', {bits} * (x.k % {held}), 'gw', if(x.g < 0, -1, x.g div {held}), 'gq', {bits} * (x.g % {held})))"
    # A block of STEPS places starts WINDOW places early, with nothing counted, so it needs nothing of the one before it; an accumulator is copied at each step, so it holds one block's spans.
    # acc: n packed counts and s the sum, of the window that ends before x; z the last masked place; spans d, and the span a to b that is open
    low = f"greatest(0, j * {STEPS} - {window})"
    leaves = f"(x.g >= 0 and x.i - {window} >= {low})"
    count = lambda w, q: f"cast(shiftright(acc.n[{w}], {q}) & {(1 << bits) - 1} as int)"
    counted = f"if({leaves} and x.k = x.g, acc.n, transform(acc.n, (v, k) -> v + if(k = x.kw, shiftleft(1L, x.kq), 0L) - if({leaves} and k = x.gw, shiftleft(1L, x.gq), 0L)))"
    summed = f"if({leaves} and x.k = x.g, acc.s, acc.s + if(x.k < 0, 0L, {gains}[{count('x.kw', 'x.kq')}]) - if({leaves}, {gains}[{count('x.gw', 'x.gq')} - 1], 0L))"
    high = f"(acc.s <= t.h and x.i - {window} >= acc.z)"
    start, end = f"(t.a + x.i - {window})", "(t.a + x.i)"
    span = "array(named_struct('a', acc.a, 'k', 3, 'b', acc.b))"
    step = (
        f"named_struct('n', {counted}, 's', {summed}, 'z', if(x.k < 0, x.i + 1, acc.z), "
        f"'d', if({high} and acc.b >= 0 and acc.b < {start}, concat(acc.d, {span}), acc.d), "
        f"'a', if({high} and acc.b < {start}, {start}, acc.a), 'b', if({high}, {end}, acc.b))"
    )
    zero = f"named_struct('n', array_repeat(0L, {words}), 's', 0L, 'z', {low}, 'd', cast(array() as {_SPAN}), 'a', -1, 'b', -1)"
    finish = f"acc -> if(acc.b >= 0, concat(acc.d, {span}), acc.d)"
    block = f"aggregate(slice(r, {low} + 1, (j + 1) * {STEPS} - {low}), {zero}, (acc, x) -> {step}, {finish})"
    cut = f"transform(array({chars}), r -> flatten(transform(sequence(0, (size(r) - 1) div {STEPS}), j -> {block})))[0]"
    # spans of neighbouring blocks that touch are one
    firsts, lasts = "filter(d, (y, i) -> i = 0 or get(d, i - 1).b < y.a)", "filter(d, (y, i) -> i = size(d) - 1 or y.b < get(d, i + 1).a)"
    whole = f"transform(array({cut}), d -> zip_with({firsts}, {lasts}, (y, z) -> named_struct('a', y.a, 'k', 3, 'b', z.b)))[0]"
    return f"flatten(transform({ready}, t -> {whole}))"


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, thresholds: dict = THRESHOLDS, shapes: tuple = SHAPES, placeholders: tuple = PLACEHOLDERS) -> DataFrame:
    """(doc_id, assign, access, hex, entropy): arrays of (a, k, b), a span's start, kind and end in code points."""
    source = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    found = source.select("doc_id", *(_spans(k, t).alias(k) for k in KINDS[:3]), candidates(t, shapes).alias("candidates"))
    return found.select("doc_id", *KINDS[:3], F.expr(f"if(size(candidates) = 0, cast(array() as {_SPAN}), {_entropy_expression(window, thresholds, placeholders)})").alias("entropy"))


def _joined(*kinds: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*kinds)), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(*KINDS[:3]), 256).alias("base_sha256"), _joined(*KINDS).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents")))


def brute_force(text: str | None) -> tuple:
    """One text's (n_assign, n_access, n_hex, base_sha256, spans) by plain Python."""
    text = text or ""
    spans = []
    for kind, (pattern, group, least) in PATTERNS.items():
        for m in re.finditer(pattern, text, re.A):
            if len(m[group]) >= least:
                spans.append((m.start(), KINDS.index(kind), m.end()))
    counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
    own = []
    for m in re.finditer(CANDIDATE, text, re.A):
        v = m[0]
        if any(re.search(p, v) for p in SHAPES):
            continue
        limit = THRESHOLDS["hex" if re.fullmatch("[0-9a-fA-F]+", v) else "base64" if re.search("[0-9]", v) else "letters"]
        for p in PLACEHOLDERS:
            v = re.sub(p, "~" * len(p), v, flags=re.I)
        for i in range(len(v) - WINDOW + 1):
            w = v[i : i + WINDOW]
            if "~" in w:
                continue
            entropy = math.log2(WINDOW) - sum((c := w.count(x)) * math.log2(c) for x in set(w)) / WINDOW
            if entropy >= limit - 1e-10:
                a, b = m.start() + i, m.start() + i + WINDOW
                if own and own[-1][0] >= m.start() and own[-1][2] >= a:
                    own[-1] = (own[-1][0], 3, b)
                else:
                    own.append((a, 3, b))
    join = lambda s: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
    return (*counts, hashlib.sha256(join(spans).encode()).hexdigest(), join(spans + own))
