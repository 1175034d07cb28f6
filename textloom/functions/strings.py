"""String functions as Column expressions, and Arrow functions where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import breaks, documents, fuzzy, signatures
from textloom.functions.breaks import break_line, repeated_keys


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\r\t]]", "")


def strip_unprintable(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x20-\x7E\n\r\t]", "")


def normal_white(c: Column) -> Column:
    """Zero-width characters go, other Unicode spaces become plain ones."""
    return F.regexp_replace(F.regexp_replace(c, "[​-‍﻿]", ""), "[   -   　]", " ")


def clean_stem(c: Column) -> Column:
    c = F.regexp_replace(c, r"_[0-9]+$", "")
    c = F.regexp_replace(c, r" ?\([0-9]+\)$", "")
    return F.translate(F.trim(c), " ", "_")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def format_size(n: Column) -> Column:
    """Bytes with one decimal in units of 1024."""
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024.0**k)).otherwise(out)
    return out


def parse_size(c: Column) -> Column:
    """Megabytes of strings like `1.5 GiB`."""
    n = F.regexp_extract(c, r"([0-9.]+)\s*([KMGT]?)i?B", 1).cast("double")
    unit = F.regexp_extract(c, r"([0-9.]+)\s*([KMGT]?)i?B", 2)
    return n * F.when(unit == "K", 1 / 1024.0).when(unit == "M", 1.0).when(unit == "G", 1024.0).when(unit == "T", 1024.0 * 1024).otherwise(1 / 1048576.0)


def ascii_ratio(c: Column) -> Column:
    letters = F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.try_divide(F.char_length(F.regexp_replace(c, "[^A-Za-z]", "")), letters)


def sentences(c: Column) -> Column:
    # runs that end with . or !; cut by look-behind, as a search for such runs would be quadratic where none ends
    return F.filter(F.split(c, "(?<=[.!])"), lambda x: (F.char_length(x) > 1) & x.rlike("[.!]$"))


def hsv(c: Column) -> Column:
    """Hue, saturation and value, rounded, of `#rrggbb`."""
    r, g, b = (F.conv(F.substring(c, k, 2), 16, 10).cast("int") / 255.0 for k in (2, 4, 6))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct(F.round(hue * 60, 4).alias("h"), F.round(F.when(top == 0, 0.0).otherwise(d / top), 4).alias("s"), F.round(top, 4).alias("v"))


@F.pandas_udf(T.StringType())
def normalize_line(s: pd.Series) -> pd.Series:
    """NFKC, printable characters, no punctuation, case folded, words joined by `_`."""

    def one(x):
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFKC", x) if c.isprintable())
        x = "".join(" " if unicodedata.category(c)[0] == "P" else c for c in x)
        return "_".join(x.casefold().split())

    return s.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap_sentences(s: pd.Series) -> pd.Series:
    """Sentences, those above 120 characters broken at their last sign before it."""
    return s.map(lambda x: [p for y in re.findall(r"[^.!]+[.!]?", x or "") if y.strip() for p in break_line(y.strip(), 120)])


def chunk_chars(c: Column, most: int = 4990, late: int = 4900) -> Column:
    """Chunks of at most `most` characters, cut behind the last sentence end after `late`, else the last space, else hard."""
    # each chunk is the longest of the first shape that fits where the one before ended
    shapes = rf"(?s).{{1,{most}}}\z|.{{{late},{most - 1}}}[.!?]|.{{1,{most - 1}}} |.{{1,{most}}}"
    return F.regexp_extract_all(c, F.lit(shapes), F.lit(0))


VOWELS = "[aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüýÿ]+"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
COUNTS = ("sentences", "words", "syllables", "letters", "long_words", "hard_words")
#: Published readability formulas over the counts of a text, by name; `flesch` is the English reading ease, and three are its Spanish, one its Italian form.
FORMULAS = {
    "flesch": lambda n, w, syl, c, lw, hw: 206.835 - 1.015 * w / n - 84.6 * syl / w,
    "kincaid": lambda n, w, syl, c, lw, hw: 0.39 * w / n + 11.8 * syl / w - 15.59,
    "smog": lambda n, w, syl, c, lw, hw: 1.043 * F.sqrt(30.0 * hw / n) + 3.1291,
    "coleman_liau": lambda n, w, syl, c, lw, hw: 5.88 * c / w - 29.6 * n / w - 15.8,
    "automated": lambda n, w, syl, c, lw, hw: 4.71 * c / w + 0.5 * w / n - 21.43,
    "fog": lambda n, w, syl, c, lw, hw: 0.4 * (w / n + 100.0 * hw / w),
    "linsear": lambda n, w, syl, c, lw, hw: (w + 2.0 * hw) / n / 2 - F.when((w + 2.0 * hw) / n <= 20, 1).otherwise(0),
    "lix": lambda n, w, syl, c, lw, hw: w / n + 100.0 * lw / w,
    "fernandez_huerta": lambda n, w, syl, c, lw, hw: 206.84 - 60.0 * syl / w - 1.02 * w / n,
    "szigriszt": lambda n, w, syl, c, lw, hw: 206.835 - 62.3 * syl / w - w / n,
    "gutierrez": lambda n, w, syl, c, lw, hw: 95.2 - 9.7 * c / w - 0.35 * w / n,
    "crawford": lambda n, w, syl, c, lw, hw: -0.205 * 100 * n / w + 0.049 * 100 * syl / w - 3.407,
    "gulpease": lambda n, w, syl, c, lw, hw: 89 + (300.0 * n - 10.0 * c) / w,
}


def readability(c: Column) -> Column:
    """Counts and formulas; syllables are runs of vowels, hard words have three or more, long ones seven letters. Formulas are rounded to four places, half up, and null for a text without words."""

    def measured(words: Column) -> Column:
        return F.transform(F.array(F.transform(words, lambda x: F.greatest(F.lit(1), F.regexp_count(x, F.lit(VOWELS))))), lambda syl: counted(words, syl))[0]

    def counted(words: Column, syl: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
        letters = F.transform(words, F.char_length)
        values = F.greatest(F.lit(1), F.regexp_count(c, F.lit("[.!?]+"))), F.size(words), total(syl), total(letters), F.size(F.filter(letters, lambda x: x >= 7)), F.size(F.filter(syl, lambda x: x >= 3))
        return F.struct(*(v.cast("long").alias(k) for k, v in zip(COUNTS, values, strict=True)))

    # an array of one holds what several expressions read
    counts = F.transform(F.array(F.regexp_extract_all(F.lower(c), F.lit(LETTERS), F.lit(0))), measured)
    scored = lambda x: F.struct(*(x[k].alias(k) for k in COUNTS), *(F.when(x["words"] > 0, F.floor(f(*(x[k].cast("double") for k in COUNTS)) * 10000 + 0.5) / 10000).alias(k) for k, f in FORMULAS.items()))
    return F.transform(counts, scored)[0]


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8 where they are that, else as ISO-8859-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


@F.pandas_udf(T.StringType())
def strip_python(s: pd.Series) -> pd.Series:
    """Python source without comments and docstrings; what doesn't parse stays as it is."""
    import ast

    def one(x):
        try:
            tree = ast.parse(x or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return x
        for node in ast.walk(tree):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node, False) is not None:
                node.body = node.body[1:] or [ast.Pass()]
        return ast.unparse(tree)

    return s.map(one)


@F.pandas_udf(T.StringType())
def markdown_html(s: pd.Series) -> pd.Series:
    """A small Markdown subset as HTML: headings, emphasis, code, links, lists and paragraphs."""
    import html

    def inline(x):
        x = html.escape(x, False)
        for pattern, to in ((r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"), (r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>')):
            x = re.sub(pattern, to, x)
        return x

    def one(x):
        out = []
        for block in re.split(r"\n\s*\n", (x or "").strip()):
            rows = block.split("\n")
            if m := re.match(r"(#{1,6})\s+(.*)", block):
                out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            elif all(re.match(r"[-*+]\s", r) for r in rows):
                out.append("<ul>" + "".join(f"<li>{inline(r[2:].strip())}</li>" for r in rows) + "</ul>")
            elif block:
                out.append(f"<p>{inline(' '.join(rows))}</p>")
        return "\n".join(out)

    return s.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_repeated_keys(s: pd.Series) -> pd.Series:
    """Keys that occur twice in one JSON object; null where it isn't JSON."""

    def one(x):
        try:
            return None if x is None else repeated_keys(x)
        except (ValueError, RecursionError):
            return None

    return s.map(one)


def merged_objects(left: dict, right: dict) -> dict:
    """Both objects in one, at every depth: of two values that aren't both objects the right one stays."""
    out = dict(left)
    todo = [(out, right)]
    while todo:
        into, more = todo.pop()
        for k, v in more.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                into[k] = dict(into[k])
                todo.append((into[k], v))
            else:
                into[k] = v
    return out


@F.pandas_udf(T.StringType())
def deep_merge(left: pd.Series, right: pd.Series) -> pd.Series:
    """Two JSON texts in one: objects at every depth, lists one after the other, of a null the other one; null where one isn't JSON or they are of two types."""
    import json

    def one(a, b):
        if a is None or b is None:
            return b if a is None else a
        try:
            x, y = json.loads(a), json.loads(b)
            if isinstance(x, dict) and isinstance(y, dict):
                both = merged_objects(x, y)
            elif isinstance(x, list) and isinstance(y, list):
                both = x + y
            else:
                return None
            return json.dumps(both, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("digest", T.StringType())])))
def definitions(s: pd.Series) -> pd.Series:
    """Functions, classes and constants of Python source, with a digest of their normalised form."""
    import ast
    import hashlib

    def one(x):
        try:
            body = ast.parse(x or "").body
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        out = []
        for node in body:
            kind = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}.get(type(node))
            name = getattr(node, "name", None)
            if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and node.targets[0].id.isupper():
                kind, name = "constant", node.targets[0].id
            if kind:
                out.append({"name": name, "kind": kind, "first": node.lineno, "last": node.end_lineno, "digest": hashlib.sha256(ast.dump(node).encode()).hexdigest()})
        return out

    return s.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def imported_modules(s: pd.Series) -> pd.Series:
    """Top-level modules that Python source imports, sorted."""
    import ast

    def one(x):
        try:
            tree = ast.parse(x or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        found = set()
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                found |= {a.name.split(".")[0] for a in node.names}
            elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
                found.add(node.module.split(".")[0])
        return sorted(found)

    return s.map(one)


@F.pandas_udf(T.StringType())
def remove_elements(s: pd.Series) -> pd.Series:
    """HTML without its script, style, meta and nav elements, nested ones too."""
    from html.parser import HTMLParser

    gone, void = {"script", "style", "nav"}, {"meta"}

    class Keep(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out, self.depth = [], 0

        def handle_starttag(self, tag, attrs):
            if tag in gone:
                self.depth += 1
            elif not self.depth and tag not in void:
                self.out.append(self.get_starttag_text())

        def handle_endtag(self, tag):
            if tag in gone:
                self.depth = max(0, self.depth - 1)
            elif not self.depth:
                self.out.append(f"</{tag}>")

        def handle_data(self, data):
            if not self.depth:
                self.out.append(data)

        def handle_entityref(self, name):
            self.handle_data(f"&{name};")

        def handle_charref(self, name):
            self.handle_data(f"&#{name};")

    def one(x):
        if x is None:
            return None
        p = Keep()
        p.feed(x)
        p.close()
        return "".join(p.out)

    return s.map(one)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings, 0 to 100."""
    from difflib import SequenceMatcher

    return pd.Series([round(100 * SequenceMatcher(None, x or "", y or "", False).ratio(), 4) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def xxh64(s: pd.Series) -> pd.Series:
    """Seed-0 xxh64 as hex."""
    import xxhash

    return s.map(lambda x: None if x is None else xxhash.xxh64(x.encode() if isinstance(x, str) else x).hexdigest())


@F.pandas_udf(T.StringType())
def blake2b(s: pd.Series) -> pd.Series:
    import hashlib

    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode() if isinstance(x, str) else x).hexdigest())


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash_signature(s: pd.Series) -> pd.Series:
    """128 least hashes of 5-byte shingles; null for shorter texts."""
    block = signatures.scratch()
    return s.map(lambda x: signatures.minhash_slots(x, block))


@F.pandas_udf(T.LongType())
def simhash_signature(s: pd.Series) -> pd.Series:
    """64-bit majority signature of 3-byte shingles; null for shorter texts."""
    return pd.Series([signatures.simhash(x) for x in s], dtype="Int64")


@F.pandas_udf(T.StringType())
def ctph(s: pd.Series) -> pd.Series:
    """Context-triggered piecewise hash."""
    return s.map(fuzzy.ctph)


@F.pandas_udf(T.DoubleType())
def ctph_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(fuzzy.ctph_score(x, y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.BinaryType())
def bucket_hash(s: pd.Series) -> pd.Series:
    """Locality-sensitive bucket hash; null for texts under 50 bytes or of few byte triplets."""
    return s.map(fuzzy.bucket_hash)


@F.pandas_udf(T.LongType())
def bucket_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy.bucket_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.StringType())
def lexrank(s: pd.Series) -> pd.Series:
    """The five sentences that most others resemble."""
    return s.map(documents.lexrank)


@F.pandas_udf(T.StringType())
def textrank(s: pd.Series) -> pd.Series:
    """The five sentences that share most words with others."""
    return s.map(documents.textrank)


@F.pandas_udf(T.StringType())
def lsa(s: pd.Series) -> pd.Series:
    """The five sentences that hold most of a text's strongest topics."""
    return s.map(documents.lsa)


def frequent_sentences(stop: list[str]):
    """Places of the three tenths of lower-case sentences whose words, but for `stop`, are most frequent in all of them."""
    words = frozenset(stop)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(s: pd.Series) -> pd.Series:
        return s.map(lambda found: None if found is None else documents.frequent(list(found), words))

    return places


@F.pandas_udf(T.StringType())
def flat_json(s: pd.Series) -> pd.Series:
    """JSON as a flat list of parts, each named once."""
    import json

    return s.map(lambda x: None if x is None else documents.flatten(json.loads(x)))


@F.pandas_udf(T.StringType())
def pickle_json(s: pd.Series) -> pd.Series:
    """Pickles of plain values as JSON; null for others."""
    return s.map(lambda x: None if x is None else breaks.pickle_json(x))


@F.pandas_udf(T.BinaryType())
def json_pickle(s: pd.Series) -> pd.Series:
    """JSON as a pickle of its value."""
    import json
    import pickle

    return s.map(lambda x: None if x is None else pickle.dumps(json.loads(x)))


@F.pandas_udf(T.StringType())
def nested_json(s: pd.Series) -> pd.Series:
    """The JSON that a flat list of parts stands for."""
    import json

    return s.map(lambda x: None if x is None else json.dumps(documents.unflatten(x), ensure_ascii=False, separators=(",", ":")))


def composite(*scores: Column, always: int) -> Column:
    """Mean of scores from 0 to 100: the first `always` count in any case, the others where they are above 0."""
    kept = F.concat(F.array(*scores[:always]), F.filter(F.array(*scores[always:]), lambda x: x > 0))
    return F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept), 2)


def token_share(a: Column, b: Column) -> Column:
    """Jaccard similarity of word sets, 0 to 100."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    inner = F.size(F.array_intersect(words(a), words(b)))
    return F.round(F.coalesce(F.try_divide(inner * 100.0, F.size(words(a)) + F.size(words(b)) - inner), F.lit(0.0)), 2)


def _slots(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) * 100.0 / signatures.PERMUTATIONS, F.lit(0.0))


#: Similarity algorithms by name: (signature of a string, score of two signatures from 0 to 100).
SIMILARITIES = {
    "exact": (lambda c: F.sha2(c, 256), lambda a, b: F.when(a == b, 100.0).otherwise(0.0)),
    "minhash": (minhash_signature, _slots),
    "simhash": (simhash_signature, lambda a, b: F.coalesce(100 - F.bit_count(a.bitwiseXOR(b)) * 100.0 / 64, F.lit(0.0))),
    "sequence": (lambda c: c, sequence_ratio),
    "pieces": (ctph, ctph_score),
    "buckets": (bucket_hash, lambda a, b: F.coalesce(F.greatest(F.lit(0.0), 100 - bucket_distance(a, b) / 2.0), F.lit(0.0))),
}
