"""Near strings, leaders, languages and merges against brute force."""

import datetime
import difflib
import json
import math
import random
import re
import statistics
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import documents, fuzzy, lexing, perceptual, strings, times, urls
from textloom.operators import edits, joins, languages, similarity
from textloom.operators import lines as L
from textloom.sources import tables
from textloom.staging import stage
from textloom.streaming import streams


@pytest.fixture(scope="module")
def cut(spark):
    return lambda df: stage(spark, df, "test")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, most):
    for _ in range(rng.randrange(most + 1)):
        k = rng.randrange(len(s) + 1)
        s = rng.choice([s[:k] + rng.choice("abé") + s[k:], s[:k] + s[k + 1 :], s[:k] + rng.choice("abé") + s[k + 1 :]])
    return s


@pytest.mark.parametrize("d, hot", [(1, 1 << 20), (2, 1 << 20), (2, 3), (3, 10)])
def test_edit_pairs(spark, cut, d, hot):
    """All pairs, also where every key is hot and is cut again, with empty and very short strings."""
    rng = random.Random(d * 100 + hot)
    seeds = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 30))) for _ in range(12)]
    strings = sorted({"", "a", "b", "ab", "ba", "aaaa", "aaaaa", *("https://www.example.com/" + edited(rng, s, 2) for s in seeds), *(edited(rng, rng.choice(seeds), 3) for _ in range(90))})
    got = edits.edit_pairs(spark.createDataFrame(list(enumerate(strings)), "id long, s string"), d, cut, hot=hot)
    want = {(i, j, n) for i, x in enumerate(strings) for j, y in enumerate(strings) if i < j and (n := distance(x, y)) <= d}
    rows = [(r.a, r.b, r.distance) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_edit_pairs_of_nothing(spark, cut):
    assert edits.edit_pairs(spark.createDataFrame([], "id long, s string"), 2, cut).collect() == []


def test_candidates(spark, cut):
    """The nearest known words by distance, count and spelling; also of words longer than the prefix."""
    rng = random.Random(3)
    known = {"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 22))): rng.randrange(1, 6) for _ in range(120)}
    words = sorted({edited(rng, rng.choice(sorted(known)), 3).replace("é", "e") for _ in range(150)} - known.keys() - {""})
    got = {r.word: (r.correction, r.candidates) for r in edits.candidates(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(known.items()), "word string, n long"), cut).collect()}
    want = {}
    for w in words:
        near = {v: n for v in known if (n := distance(w, v)) <= 2}
        best = sorted((v for v in near if near[v] == min(near.values())), key=lambda v: (-known[v], v))[:5]
        if best:
            want[w] = (best[0], best)
    assert got == want and len(want) > 50


def test_misspellings(spark, cut):
    docs = spark.createDataFrame([(1, "The hause, a_b café HAUSE x house2 Hose"), (2, None), (3, "")], "doc_id long, text string")
    known = spark.createDataFrame([("the", 9), ("house", 5), ("horse", 7)], "word string, n long")
    got = sorted(tuple(r) for r in edits.misspellings(docs, known, cut).collect())
    assert got == [(1, "HAUSE", 20, 25, "house", ["house"]), (1, "Hose", 35, 39, "horse", ["horse", "house"]), (1, "hause", 4, 9, "house", ["house"])]


# ---- languages ----


def test_grams():
    """Every letter with its neighbours in the text's runs of letters between single blanks."""
    rng = random.Random(4)
    texts = [None, "", "  ", "a", "Éa-b", *("".join(rng.choice("aB ,\né1ßК") for _ in range(rng.randrange(40))) for _ in range(60))]
    code, of = languages.grams(texts)
    got = sorted((int(k), "".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0))) for c, k in zip(code, of, strict=True))
    want = []
    for k, t in enumerate(texts):
        low = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t or "").split()) + " "
        want += [(k, low[i - 1 : i + 2]) for i in range(1, len(low) - 1) if low[i] != " "]
    assert got == sorted(want)


def test_held_out_languages(spark, sf):
    """Trained on four fifths of the documents: right on the rest, also on its lines where it is sure; unsure lines are wrong more often than sure ones."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    rest = docs.filter("fold = 0")
    lines = L.lines(rest, "doc_id", "text", "lang").filter("length(line) >= 3").withColumn("a.b", F.lit(1))
    model = languages.calibrated(languages.train(docs.filter("fold <> 0")), lines, "line")
    whole = languages.detect(rest, model, "text", "doc_id", "lang").toPandas()
    assert len(whole) == rest.count() and (whole.guess == whole.lang).mean() > 0.95
    each = languages.detect(lines, model, "line", "a.b", "lang").toPandas()
    each = each[each.guess != "und"]
    sure = each[each.confidence >= 0.6]
    assert list(each.columns) == ["a.b", "lang", "guess", "confidence", "cost"] and len(sure) > 0.9 * len(each) and (sure.guess == sure.lang).mean() > 0.97
    assert abs((each.guess == each.lang).mean() - each.confidence.mean()) < 0.03  # what it says of itself is so


def test_languages_of_nothing(spark):
    model = languages.train(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string"))
    assert model.languages == [] and model.detect(["abc"])[0] == ["und"]
    model = languages.train(spark.createDataFrame([("der die das", "de"), ("the of and", "en")], "text string, lang string"))
    got = languages.detect(spark.createDataFrame([(1, None), (2, ""), (3, "12 -"), (4, "the and"), (5, "die")], "id long, t string"), model, "t", "id")
    assert [(r.id, r.guess) for r in got.orderBy("id").collect()] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")]


# ---- streams ----


def test_marked_batches(spark, tmp_path):
    """A batch that is killed between its rows and its mark is written once in the end; a run without a checkpoint goes on above the mark."""
    src, sink = f"file://{tmp_path}/src", f"file://{tmp_path}/sink"
    write = lambda a, b: spark.range(a, b).selectExpr("id", "id * 10 AS at").repartition(3).write.mode("append").parquet(src)
    run = lambda apply, mark: streams.upsert_batches(streams.watch(spark, src, "id long, at long", per_trigger=1), apply, f"file://{tmp_path}/{mark}")
    write(0, 30)
    good, seen = streams.mark_batches(sink, "a", "at"), []

    def dying(batch, n):
        seen.append(n)
        if n == 1:
            batch.limit(2).write.mode("overwrite").parquet(f"{sink}/rows/run=a/batch=1")  # some rows, no mark
            raise RuntimeError("killed")
        good(batch, n)

    with pytest.raises(Exception, match="killed"):
        run(dying, "one")
    assert streams.marked(spark, sink, "id long, at long").count() == 10
    run(good, "one")
    good(spark.createDataFrame([(999, 9990)], "id long, at long"), 2)  # a repeated batch changes nothing
    assert sorted(r.id for r in streams.marked(spark, sink, "id long, at long").collect()) == list(range(30))
    write(25, 50)
    run(streams.mark_batches(sink, "b", "at"), "two")
    rows = sorted((r.id, r.run) for r in streams.marked(spark, sink, "id long, at long").collect())
    assert rows == [(i, "a") for i in range(30)] + [(i, "b") for i in range(30, 50)]


def test_runs_over_batches(spark, tmp_path):
    """Runs that go on over several batches, out of order within the delay; all come out, as the batch operator has them."""
    rng, src = random.Random(6), f"file://{tmp_path}/src"
    rows = [(k % 3, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=5 * k + rng.randrange(4)), rng.choice("aab")) for k in range(150)]
    schema = "k long, ts timestamp, v string"
    full = lambda df: df.withColumn("s", F.unix_micros("ts") / 1e6).withColumn("t", F.col("s") + 2)
    seen = []
    for n in range(3):
        part = rows[n * 50 : n * 50 + 50]
        rng.shuffle(part)
        df = full(spark.createDataFrame(part, schema))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = streams.runs(streams.watch(spark, src, df.schema), "k", "ts", "s", "t", "v", 14.0, "10 seconds")
        streams.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/mark")
        seen.append(spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").count())
    streams.flush(spark, src, df.schema, "ts")
    streams.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/mark")
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").collect())
    want = times.merge_gaps(full(spark.createDataFrame(rows, schema)), "k", "s", "t", "v", 14.0).select("k", "v", "s", "t", "n").collect()
    assert got == sorted(tuple(r) for r in want) and 0 < seen[0] < seen[1] < seen[2] < len(got)


# ---- leaders, ratios, hashes, merges ----


def sequential(nodes, pairs):
    """The loop itself: the first unassigned node leads and takes all unassigned ones that it is paired with."""
    leader = {}
    for a in sorted(nodes):
        if a not in leader:
            leader[a] = a
            for b in sorted(nodes):
                if b > a and b not in leader and (a, b) in pairs:
                    leader[b] = a
    return {b: a for b, a in leader.items() if a != b}


@pytest.mark.parametrize("n, m", [(40, 0), (40, 60), (60, 500), (30, -1)])
def test_leaders(spark, cut, n, m):
    """Random pairs, and a row of nodes each paired with the next."""
    rng = random.Random(n + m)
    pairs = {(k, k + 1) for k in range(n - 1)} if m < 0 else {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    got = similarity.leaders(spark.createDataFrame([*pairs, *list(pairs)[:3]], "a long, b long"), cut).collect()
    assert {r.id: r.leader for r in got} == sequential(range(n), pairs) and len({r.id for r in got}) == len(got)


@pytest.mark.parametrize("least", [70.0, 90.0, 100.0])
def test_ratio_pairs(spark, cut, least):
    rng = random.Random(int(least))
    seeds = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(3, 25))) for _ in range(15)]
    strings = sorted({"", "a", "b", "ab", "ba", "aab", *(edited(rng, rng.choice(seeds), 4) for _ in range(90))})
    ratio = lambda x, y: 100 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    want = {(i, j): r for i, x in enumerate(strings) for j, y in enumerate(strings) if i < j and (r := ratio(x, y)) >= least}
    rows = edits.ratio_pairs(spark.createDataFrame(list(enumerate(strings)), "id long, s string"), least, cut).collect()
    assert {(r.a, r.b): r.score for r in rows} == want and len(rows) == len(want) and (want or least == 100)


def test_perceptual_hashes(spark):
    """By sums written out; odd sizes, constants, nulls."""
    rng = random.Random(8)
    squares = [[rng.random() for _ in range(n * n)] for n in (8, 8, 4, 3, 10)] + [[1.0] * 16, [2.0], [1.0] * 5, [], None, [1.0, None, 2.0, 3.0]]
    got = {r.id: r.h for r in spark.createDataFrame(list(enumerate(squares)), "id long, v array<double>").select("id", perceptual.hashes("v").alias("h")).collect()}
    text = lambda values, least: "".join("1" if v > least else "0" for v in values)
    for k, v in enumerate(squares[:5]):
        n = int(len(v) ** 0.5)
        x = [v[r * n : r * n + n] for r in range(n)]
        assert got[k].average == text(v, sum(v) / len(v))
        assert got[k].gradient == "".join("1" if x[r][c + 1] > x[r][c] else "0" for r in range(n) for c in range(n - 1))
        scale = lambda a: (1 / n if a == 0 else 2 / n) ** 0.5  # noqa: E731, B023
        wave = lambda a, r: math.cos(math.pi * a * (2 * r + 1) / (2 * n))  # noqa: E731, B023
        low = [scale(a) * scale(b) * sum(x[r][c] * wave(a, r) * wave(b, c) for r in range(n) for c in range(n)) for a in range(min(n, 8)) for b in range(min(n, 8))]
        assert got[k].cosine == text(low, statistics.median(low))
        mean = sum(v) / len(v)  # without its first coefficient a square has lost its mean
        assert got[k].haar == (text([y - mean for y in v], statistics.median(y - mean for y in v)) if n & (n - 1) == 0 else None)
    assert got[5].average == "0" * 16 and got[6].gradient == "" and all(got[k].average is None for k in (7, 8, 9, 10))


def test_deep_merge(spark):
    def merge(a, b):
        return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    rng = random.Random(9)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([1, "x", None, True, [1, {"a": 2}], {}, 2.5])
        return {rng.choice("abcde"): tree(depth - 1) for _ in range(rng.randrange(4))}

    both = [({**{"k": 1}, **(x if isinstance(x := tree(5), dict) else {})}, y if isinstance(y := tree(5), dict) else {}) for _ in range(200)]
    a = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(both)] + [(900, '{"only":1}'), (901, "[1]"), (902, "[1]"), (903, "{"), (904, None)], "k long, j string")
    b = spark.createDataFrame([(i, json.dumps(y)) for i, (_, y) in enumerate(both)] + [(901, "[2,{}]"), (902, "{}"), (903, "{}"), (904, '{"r":1}'), (905, '{"right":1}')], "k long, j string")
    got = {r.k: r.j for r in joins.merge_deep(a, b, "k", "j").collect()}
    assert len(got) == 206 and all(json.loads(got[i]) == merge(x, y) for i, (x, y) in enumerate(both))
    assert [got[k] for k in range(900, 906)] == ['{"only":1}', "[1,2,{}]", None, None, '{"r":1}', '{"right":1}']


def test_urls_keep_what_they_say():
    cases = {
        "HTTP://User:Pw@Example.COM:80/a//b/../c/?b=2&a=1&b=1&&x=#Frag%7E": "http://User:Pw@example.com/a/c/?b=2&a=1&b=1&x#Frag~",
        "example.com/%7euser/ä?q=ü&": "https://example.com/~user/%C3%A4?q=%C3%BC",
        "//bücher.de:0443": "https://xn--bcher-kva.de/", "http://x/#!a": "http://x/?_escaped_fragment_=a", "/just/a/path": "/just/a/path", "": "", None: None, "http://[bad": "http://[bad", "ws://x:81/.": "ws://x:81/",
    }
    assert {u: urls.normal_url(u) for u in cases} == cases
    assert urls.normal_url("https://www.google.com/search?utm=1&q=a+b&ie=utf&q=c", only=urls.PARAMETERS) == "https://www.google.com/search?q=a+b&ie=utf&q=c"
    assert urls.normal_url("https://x.org/?q=1", only=urls.PARAMETERS) == "https://x.org/"


def test_quotes_of_dumps():
    got = list(tables.tokens_of('(1, "x, y", \'it\'\'s \\n\', "say ""a\\b""", NULL)'))
    assert [v for kind, v in got if kind == "value"] == [1, "x, y", "it's \n", 'say "a\\b"', None]


def test_repeated_keys_of_long_and_broken_objects(spark):
    long = '{"a":1,"b":"' + "x" * 50_000 + '","a":2}'
    got = spark.createDataFrame([(long,), ("{",), (None,), ("{}",)], "j string").select(strings.json_repeated_keys("j").alias("r")).collect()
    assert [r.r for r in got] == [["a"], None, None, []]


# ---- source texts ----

SOURCES = [
    ("python", "x = '#no' # yes\n'''a # b\n# c''' # d\ns = \"it's # in\" #", "x = '#no' \n'''a # b\n# c''' \ns = \"it's # in\" "),
    ("python", "don't # stop\nx # y", "don't # stop\nx "),
    ("python", "a = 'q\\' # in' # out\n\"\"\"open # to the end", "a = 'q\\' # in' \n\"\"\"open # to the end"),
    ("c", 'char *s = "// no /* no */"; // yes\nint a; /* b\n"c" */ int d; \'"\' // e', 'char *s = "// no /* no */"; \nint a;  int d; \'"\' '),
    ("c", "a /* /* */ b */ c /* open", "a  b */ c "),
    ("javascript", "f(`// ${x}\n// no`) // yes", "f(`// ${x}\n// no`) "),
    ("sql", "SELECT 'it''s -- in', \"a--b\" -- out\n/* c */ FROM t", "SELECT 'it''s -- in', \"a--b\" \n FROM t"),
    ("sql", "SELECT 'a\\' -- out", "SELECT 'a\\' "),
    ("html", "<p>a<!-- b\n--c --></p><!-- d", "<p>a</p>"),
    ("lua", "x = [[ -- in\n]] -- out\n--[[ all\nof it ]] y", "x = [[ -- in\n]] \n y"),
    ("css", "a{b:'/*'}/* c */d{}", "a{b:'/*'}d{}"),
    ("rust", 'let s = "/* no"; /* a /* b */ c */ let t = 1; // d /* e\nfn f() {} /* /* open */', 'let s = "/* no"; '[:-1] + "  let t = 1; \nfn f() {} "),
    ("haskell", "f x = {- a {- b -} -- c -} x -- d\ng = \"-- e\"", "f x =  x \ng = \"-- e\""),
    ("ini", "a=1 ; b\n# c\nd='e'", "a=1 \n\nd='e'"),
]


@pytest.mark.parametrize("name, source, want", SOURCES)
def test_comments(spark, name, source, want):
    assert lexing.stripped(source, name) == want
    got = spark.createDataFrame([(source,), (None,), ("",)], "s string").select(lexing.without_comments(F.col("s"), name).alias("t")).collect()
    assert [r.t for r in got] == [want, None, ""]


def test_comments_by_either_way(spark):
    """The expression and the scan agree on any mixture of marks, quotes and lines, long strings too."""
    rng = random.Random(10)
    bits = ["'", '"', '"""', "'''", "`", "\\", "#", "//", "/*", "*/", "--", "--[[", "[[", "]]", "<!--", "-->", ";", "\n", " ", "a", "é", "{-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["x = '" + "y" * 200_000 + "' # z", '"""' + "a b\n" * 50_000, "/*" + "*" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").cache()
    for name, own in lexing.LANGUAGES.items():
        if not own.nested:
            got = {r.id: r.t for r in df.select("id", lexing.without_comments(F.col("s"), name).alias("t")).collect()}
            bad = [(texts[i], t, lexing.stripped(texts[i], name)) for i, t in got.items() if t != lexing.stripped(texts[i], name)]
            assert not bad, (name, bad[0])


def test_names_of_sources():
    assert lexing.named("import a\n# def no():\ndef f(x):\n    def g(): pass\n'''\nclass No:\n'''\nclass C(D):\n  pass\nasync def h(): 1\nLIMIT = 3\nLIMIT == 4\n", "python") == [("f", "function", 3), ("C", "class", 8), ("h", "function", 10), ("LIMIT", "constant", 11)]
    assert lexing.named("export async function f() {}\n/* class No {}\n*/\nexport default class A {}\nconst MAX = 1, b = `\nfunction no() {}`\n", "javascript") == [("f", "function", 1), ("A", "class", 4), ("MAX", "constant", 5)]
    assert lexing.named("/* a /* fn no() */\nfn no() {} */\npub(crate) async fn f() {}\npub struct S;\nconst N: u8 = 1;\n", "rust") == [("f", "function", 3), ("S", "class", 4), ("N", "constant", 5)]
    assert lexing.named("#define MAX 3\nstatic int f(int a,\n  int b) {\nstruct s {\nint g;\n", "c") == [("MAX", "constant", 1), ("f", "function", 2), ("s", "class", 4)]
    assert lexing.named("func (r *T) Do() {\ntype T struct {\n", "go") == [("Do", "function", 1), ("T", "class", 2)]


# ---- summaries ----


def made_text(rng, n):
    words = [f"w{k}" for k in range(40)]
    return [" ".join(rng.choice(words[: rng.randrange(5, 40)]) for _ in range(rng.randrange(3, 12))) + "." for _ in range(n)]


def dense(found):
    """The matrix of words and sentences, counts."""
    words = [re.findall(r"[^\W_]+", s.lower()) for s in found]
    names = sorted(set().union(*words))
    return np.array([[w.count(x) for x in names] for w in words], float)


def stationary(edges):
    n = len(edges)
    p = np.full(n, 1 / n)
    for _ in range(1000):
        step = 0.15 / n + 0.85 * (p @ edges)
        step += (1 - step.sum()) / n
        if abs(step - p).max() < 1e-6 / n:
            break
        p = step
    return step


@pytest.mark.parametrize("cells, words", [(1 << 23, 1 << 22), (300, 50)])
def test_sentence_ranks(monkeypatch, cells, words):
    """By matrices of all sentences, in one block and in many."""
    monkeypatch.setattr(documents, "BLOCK_CELLS", cells)
    monkeypatch.setattr(documents, "BLOCK_WORDS", words)
    rng = random.Random(11)
    for n in (2, 7, 60):
        found = made_text(rng, n) + ["... -- ???"]
        c = dense(found)
        n = len(found)
        x = c / np.maximum(1, c.max(1, keepdims=True)) * np.log(1 + n / (c > 0).sum(0))
        x /= np.maximum(1e-12, np.sqrt((x**2).sum(1, keepdims=True)))
        edges = (x @ x.T > documents.THRESHOLD).astype(float)
        assert np.allclose(documents.ranks(found), stationary(edges / np.maximum(1, edges.sum(1, keepdims=True))), atol=1e-6)
        length = np.log(np.maximum(1, c.sum(1)))
        both = length[:, None] + length[None, :]
        share = np.where(both > 0, ((c > 0).astype(float) @ (c > 0).T) / np.maximum(both, 1e-12), 0)
        np.fill_diagonal(share, 0)
        assert np.allclose(documents.overlaps(found), stationary(share / np.where(share.sum(1) > 0, share.sum(1), 1)[:, None]), atol=1e-6)
        _, s, v = np.linalg.svd((c * np.log(1 + n / (c > 0).sum(0))).T, full_matrices=False)
        assert np.allclose(documents.topics(found), np.sqrt(((v[: documents.TOPICS].T * s[: documents.TOPICS]) ** 2).sum(1)), atol=1e-3)


def test_summaries_of_long_texts():
    """Memory doesn't hold all sentences by all others."""
    rng = random.Random(12)
    text = " ".join(made_text(rng, 6000))
    tracemalloc.start()
    for make in (documents.lexrank, documents.lsa):
        assert make(text).count(".") == 5
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # one matrix of all pairs would have 144 MB in single precision
    for make in (documents.lexrank, documents.lsa, documents.textrank):
        assert make(None) == "" and make("one two three.") == "one two three." and make("a b c. " * 6).count("a b c.") == 5


def test_decoding_falls_back(spark):
    raw = [("é ß".encode(),), ("é ß".encode("iso-8859-1"),), (b"plain",), (b"",), (None,), (bytes([0xFF, 0xFE, 65]),)]
    got = [r.t for r in spark.createDataFrame(raw, "b binary").select(strings.decoded(F.col("b")).alias("t")).collect()]
    assert got == ["é ß", "é ß", "plain", "", None, "ÿþA"]


# ---- functions without SQL ----


def one(spark, function, *values):
    return [r.v for r in spark.createDataFrame(list(enumerate(values)), "id int, s string").select("id", function(F.col("s")).alias("v")).orderBy("id").collect()]


def test_human_urls():
    cases = {
        "https://xn--bcher-kva.de/%C3%A4/a%2Fb%20c?q=%C3%BC&x%3Dy=%26#%C3%B6": "https://bücher.de/ä/a/b c?q=ü&x%3Dy=%26#ö",
        "HTTP://Example.com:80": "http://example.com/", "http://u%40:p@h:81/%FF?%FF=1": "http://u%40:p@h:81/%FF?%FF=1", "": "", None: None, "/path%20": "/path%20",
    }
    got = {u: urls.human_url(u) for u in cases}
    assert all(urls.normal_url(v) == urls.normal_url(u) for u, v in got.items())
    assert got["HTTP://Example.com:80"] == "http://example.com/" and got[None] is None and got["/path%20"] == "/path%20"
    assert got["https://xn--bcher-kva.de/%C3%A4/a%2Fb%20c?q=%C3%BC&x%3Dy=%26#%C3%B6"].startswith("https://bücher.de/ä/") and "q=ü" in got["https://xn--bcher-kva.de/%C3%A4/a%2Fb%20c?q=%C3%BC&x%3Dy=%26#%C3%B6"]


def test_lines_and_sentences(spark):
    assert one(spark, strings.normalize_line, "  Straße,  ﬁn!​ Ⅳ x_y ", "", None, "a.b") == ["strasse_fin_iv_x_y", "", None, "a_b"]
    long = "word " * 20 + "end, " + "more " * 20 + "done."
    short, none, wrapped = one(spark, strings.wrap_sentences, "One. Two! Three", None, long)
    assert short == ["One.", "Two!", "Three"] and none == [] and len(wrapped) == 2 and wrapped[0].endswith("end,") and " ".join(wrapped) == long


def test_elements_go(spark):
    got = one(spark, strings.remove_elements, "<p>a<nav>b<nav>c</nav>d</nav>e</p><meta x=1><script>f</script>g<style>h", None)
    assert got[0].replace("</meta>", "") == "<p>ae</p>g" and got[1] in (None, "")


def test_shuffled_rows(spark, sf):
    """Every row once, in an order that isn't the old one and is the same again."""
    from textloom.plans.all_queries import QUERIES

    rows = [[r.doc_id for r in QUERIES["sample_shuffle"](spark, sf).collect()] for _ in range(2)]
    assert rows[0] == rows[1] and sorted(rows[0]) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()) and rows[0] != sorted(rows[0])


def test_definitions_are_compared_without_layout(spark):
    same = ["def f(x):\n    return x+1\n", "def f(x): # note\n\n    return x + 1\n"]
    a, b, c, broken = one(spark, strings.definitions, *same, "def f(x):\n    return x + 2\n", "def (")
    assert a[0].digest == b[0].digest != c[0].digest and (a[0].name, a[0].kind) == ("f", "function") and broken == []


def test_greedy_texts(spark, tmp_path):
    """Edited copies, equal texts and texts without a hash, against the loop over all pairs of documents."""
    from textloom.plans.all_queries import QUERIES

    rng = random.Random(17)
    words = [f"w{rng.getrandbits(30)}" for _ in range(300)]
    base = [rng.choices(words, k=250) for _ in range(3)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.01 * (k % 5) else w for w in base[k % 3]) for k in range(40)] + [" ".join(base[0])] * 3 + ["", None, " ".join(base[1])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.leader for r in QUERIES["cluster_greedy_texts"](spark, f"file://{tmp_path}").collect()}
    signs = {k: s for k, t in enumerate(texts) if (s := fuzzy.ctph(t)) is not None}
    pairs = {(a, b) for a in signs for b in signs if a < b and (signs[a] == signs[b] or fuzzy.ctph_score(signs[a], signs[b]) >= 70)}
    follows = sequential(signs, pairs)
    assert got == {k: follows.get(k, k) for k in signs} and 0 < len(set(got.values())) < len(got)


def test_folder_signature_is_of_sorted_lines(spark):
    import hashlib

    from textloom.operators import dedup

    rows = [("a", "10:x"), ("b", "1:y"), ("a", "9:x"), (None, "2:z"), ("a", "1:w")]
    got = {r.source: (r.signature, r.files) for r in dedup.signatures(spark.createDataFrame(rows, "source string, h string"), "source", "h").collect()}
    want = {k: sorted(h for s, h in rows if s == k) for k in ("a", "b", None)}
    assert got == {k: (hashlib.sha256("\n".join(v).encode()).hexdigest(), len(v)) for k, v in want.items()}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_meet_by_equality(spark, tmp_path):
    """Sizes within two, each pair once, null and equal keys left out; the join brings no pair of other sizes."""
    from textloom.plans.all_queries import QUERIES

    rng = random.Random(5)
    rows = [(k, rng.choice(["b", None, "c"]), "t", rng.choice([None, 2**31 - 1, *range(-3, 9)])) for k in [None, *range(80), 3, 4]]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"file://{tmp_path}/part.parquet")
    df = QUERIES["join_pairwise_theta"](spark, f"file://{tmp_path}")
    want = sorted((a, b) for a, p, _, x in rows for b, q, _, y in rows if None not in (a, b, p, x, y) and p == q and a < b and abs(x - y) <= 2)
    assert sorted(tuple(r) for r in df.collect()) == want and want
    assert re.search(r"Join Inner, .*size", plan_of(df)) and "abs(" not in plan_of(df)


def test_frequent_sentences_without_shuffle(spark, sf):
    from textloom.plans.all_queries import QUERIES

    plan = plan_of(QUERIES["str_summarize_freq"](spark, sf))
    assert not re.search("Join|Aggregate|Window|Repartition", plan)
    assert documents.frequent(["the", "b b", "a b", "", "b"], frozenset(["the"])) == [1] and documents.frequent(["a"] * 7, frozenset()) == [0, 1]


def test_topics_are_exact():
    """Also where singular values lie close to one another."""
    rng = random.Random(8)
    for _ in range(20):
        found = made_text(rng, 30)
        c = np.zeros((30, 0))
        number: dict = {}
        for i, s in enumerate(found):
            for w in re.findall(r"[^\W_]+", s.lower()):
                if w not in number:
                    number[w] = len(number)
                    c = np.hstack([c, np.zeros((30, 1))])
                c[i, number[w]] += 1
        _, s, v = np.linalg.svd((c * np.log(1 + 30 / (c > 0).sum(0))).T, full_matrices=False)
        assert np.allclose(documents.topics(found), np.sqrt(((v[: documents.TOPICS].T * s[: documents.TOPICS]) ** 2).sum(1)), atol=1e-8)


def test_hot_keys_bring_no_more_rows(spark):
    """What is staged grows with the strings, however many share their keys."""
    staged = []

    def cut(df):
        rows = df.collect()
        staged.append(len(rows))
        return spark.createDataFrame(rows, df.schema)

    strings = [(k, f"https://www.example.com/en/{k:06}.html") for k in range(0, 999000, 8321)]
    got = {(r.a, r.b) for r in edits.edit_pairs(spark.createDataFrame(strings, "id long, s string"), 3, cut, hot=100).collect()}
    assert got == {(i, j) for i, x in strings for j, y in strings if i < j and distance(x, y) <= 3} and sum(staged) < 30 * len(strings)


def test_long_strings_meet(spark, cut):
    """Also beyond the characters that are compared within a cell, and where the bounds are met exactly."""
    rng = random.Random(21)
    seeds = ["".join(rng.choice("abcdefé/") for _ in range(n)) for n in (62, 64, 66, 90, 200)]
    strings = list(enumerate(sorted({edited(rng, s, k) for s in seeds for k in (0, 1, 2, 3, 3, 4)})))
    frame = spark.createDataFrame(strings, "id long, s string")
    got = {(r.a, r.b, r.distance) for r in edits.edit_pairs(frame, 3, cut).collect()}
    assert got == {(i, j, n) for i, x in strings for j, y in strings if i < j and (n := distance(x, y)) <= 3} and got


def test_ratio_pairs_are_sieved_in_cells(spark, cut):
    """No pair becomes a row before bags and common subsequences allow it; long strings too."""
    rng = random.Random(22)
    seeds = ["".join(rng.choice("abcdefé/") for _ in range(n)) for n in (40, 63, 66, 120)]
    strings = list(enumerate(sorted({edited(rng, s, k) for s in seeds for k in (0, 1, 2, 3, 4, 6)})))
    df = edits.ratio_pairs(spark.createDataFrame(strings, "id long, s string"), 95.0, cut)
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    assert {(r.a, r.b) for r in df.collect()} == {(i, j) for i, x in strings for j, y in strings if i < j and ratio(x, y) >= 0.95}
    assert "array_intersect" not in plan_of(df)  # bags used to be compared pair by pair


def test_spelling_keys_are_not_broadcast(spark):
    words, known = spark.createDataFrame([("hause",)], "word string"), spark.createDataFrame([("house", 5)], "word string, n long")
    near = edits.near_words(words, known, 2)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 1


def test_word_places_in_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab c " * 70000), (2, None), (3, "é1 x")], "doc_id long, text string").coalesce(1)
    got = edits.word_places(docs)
    assert got.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 140000), (3, 1)]
    assert got.filter("doc_id = 3").collect() == [(3, "x", 3, 4)]
