"""Edge cases of the library's operators on hand-made rows."""

import base64
import difflib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom import staging
from textloom.functions import breaks, documents, fuzzy, signatures
from textloom.functions import strings as ST
from textloom.functions import times as TM
from textloom.functions import urls as U
from textloom.operators import dedup as D
from textloom.operators import joins as J
from textloom.operators import lines as L
from textloom.operators import similarity as S
from textloom.plans import all_queries
from textloom.sources import files as FI
from textloom.sources import tables as TB


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts(df):
    return [r.text for r in df.orderBy("doc_id").collect()]


def test_lines_drop_last_empty(spark):
    got = [(r.doc_id, r.pos, r.line) for r in L.lines(docs(spark, "a\nb\n", "", None, "x\r\ny")).orderBy("doc_id", "pos").collect()]
    assert got == [(0, 1, "a"), (0, 2, "b"), (3, 1, "x"), (3, 2, "y")]


@pytest.mark.parametrize("text, left", [("line1\n\nline2\n  \nline3\n", "line1\nline2\nline3"), ("a\nb", "a\nb"), ("\n  \n\n   \n", ""), ("", ""), ("سلام\n\n  دنیا\n", "سلام\n  دنیا")])
def test_blank_lines_go(spark, text, left):
    assert texts(L.map_lines(docs(spark, text), lambda x: ~L.is_blank(x))) == [left]


def test_squeeze_blank(spark):
    assert texts(L.squeeze_blank(docs(spark, "a\n\n\nb\n\n", "\n\n", None, "\n\na"))) == ["a\n\nb", "", "", "\na"]


def test_adjacent_pairs_do_not_chain(spark):
    df = docs(spark, "x\nx\nx", "x\nx\nx\nx", "a\n\n\nb")
    assert [r.t for r in df.orderBy("doc_id").select(F.array_join(D.adjacent(L.split_lines(F.col("text"))), "\n").alias("t")).collect()] == ["x\nx", "x\nx", "a\n\n\nb"]


def test_minus_keeps_repeats(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "line string") for s in ("xxy", "y"))
    assert [r.line for r in J.minus_bag(a, b, "line").collect()] == ["x", "x"]


def test_repeated_char(spark):
    assert [r.line for r in L.lines(docs(spark, "----\n-\nab")).filter(~F.col("line").rlike(r"(?s)^(.)\1+$")).orderBy("pos").collect()] == ["-", "ab"]


def test_prune_descendants(spark):
    df = spark.createDataFrame([(x,) for x in ("h/a", "h/a/b", "h/ab", "k")], "p string")
    assert sorted(r.p for r in J.prune_descendants(df, "p").collect()) == ["h/a", "h/ab", "k"]


def test_compare_and_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k long, v string")
    assert dict(J.compare(a, b, "k", "v").collect()) == {1: "only_left", 2: "changed", 3: "same", 4: "only_right"}
    assert dict(J.merge_right(a, b, "k", "v").collect()) == {1: "x", 2: "z", 3: None, 4: "w"}
    assert dict(J.upsert(a, b, "k").collect()) == {1: "x", 2: "z", 3: None, 4: "w"}


def test_merge_gaps(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 2.0, 3.0, "a"), (1, 4.01, 5.0, "a"), (1, 5.0, 6.0, "b")], "k long, s double, t double, v string")
    assert sorted((r.v, r.s, r.t, r.n) for r in TM.merge_gaps(df, "k", "s", "t", "v", 1.0).collect()) == [("a", 0.0, 3.0, 2), ("a", 4.01, 5.0, 1), ("b", 5.0, 6.0, 1)]


def test_srt(spark):
    df = spark.createDataFrame([("00:01:01,500",), ("00:00:00,100",)], "t string")
    assert [r[0] for r in df.select(TM.shift_srt(F.col("t"), -500)).collect()] == ["00:01:01,000", "00:00:00,000"]


def test_jalali(spark):
    df = spark.sql("SELECT explode(array(date'2024-03-20', date'2024-03-19', date'1979-02-11', date'2025-03-20')) AS d")
    got = {str(r.d): tuple(r.j) for r in df.select("d", TM.jalali(F.col("d")).alias("j")).collect()}
    assert got == {"2024-03-20": (1403, 1, 1), "2024-03-19": (1402, 12, 29), "1979-02-11": (1357, 11, 22), "2025-03-20": (1403, 12, 30)}


def test_chunks_hold_the_limit(spark):
    df = docs(spark, "aaaa\nbb\ncc\n" + "x" * 30 + "\nd", "", None)
    got = [(r.doc_id, r.chunk, r.first, r.last, r["size"]) for r in L.chunk_pack(df, 8).orderBy("doc_id", "chunk").collect()]
    assert got == [(0, 1, 1, 2, 7), (0, 2, 3, 3, 2), (0, 3, 4, 4, 30), (0, 4, 5, 5, 1)]


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://Ex.COM:80/a/b/?q=1#f",)], "u string")
    r = df.select(U.normal_basic(F.col("u")), U.root(F.col("u"), 2), U.normal_full("u")).first()
    assert tuple(r) == ("http://ex.com/a/b?q=1", "ex.com/a/b", "http://ex.com/a/b/?q=1#f")


def test_sql_dump_literals():
    rows = list(TB.dump_rows("CREATE TABLE t (a INT, b TEXT, PRIMARY KEY (a)); INSERT INTO t VALUES (1, 'it''s; (x)'), (-2, NULL); INSERT INTO u VALUES (TRUE, 1e3, 'a', 2); INSERT INTO t (a) VALUES (3, 4);"))
    assert rows == [("t", {"a": 1, "b": "it's; (x)"}), ("t", {"a": -2, "b": None}), ("u", {"c0": True, "c1": 1000.0, "c2": "a", "c3": 2}), ("t", {"a": 3, "_extra_values": [4]})]


@pytest.mark.parametrize("values, kind", [([1, True], "INTEGER"), ([1, 2.5, None], "REAL"), ([1, "a"], "TEXT"), ([None], "TEXT"), ([], "TEXT"), ([True], "INTEGER")])
def test_type_lattice(values, kind):
    assert TB.infer_type(values) == kind


def test_sqlite_round_trip(spark, tmp_path):
    content = TB.sqlite_bytes({"a": [{"x": 1, "y": "s"}, {"x": 2.5}], "b": [{"z": None}]})
    assert list(TB.sqlite_rows(content)) == [("a", {"x": 1.0, "y": "s"}), ("a", {"x": 2.5, "y": None}), ("b", {"z": None})]
    path = tmp_path / "f.db"
    path.write_bytes(content)
    TB.register(spark)
    assert spark.read.format("sqlite").load(str(path)).count() == 3


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "", "x\ny")], "k long, a string, b string")
    TB.write_csv(df, f"{tmp_path}/c")
    assert sorted((r.k, r.a) for r in TB.read_csv(spark, f"{tmp_path}/c").collect()) == [("1", 'a "q", b'), ("2", "")]


def test_balanced_bins():
    assert sorted(FI.balanced_bins([("a", 5), ("b", 4), ("c", 3)], 2)) == [("a", 0), ("b", 1), ("c", 1)]


def test_connected(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 6)], "a long, b long")
    got = {r.id: r.label for r in S.connected(pairs, checkpoint=lambda df: df.checkpoint()).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def test_token_pairs_are_exact(spark):
    sets = {0: "abcde", 1: "abcdf", 2: "abcdefgh", 3: "xyz", 4: "xyz", 5: ""}
    df = spark.createDataFrame([(i, list(t)) for i, t in sets.items()], "i long, t array<string>")
    want = sorted((a, b) for a in sets for b in sets if a < b and (u := len(set(sets[a]) | set(sets[b]))) and len(set(sets[a]) & set(sets[b])) >= 0.6 * u)
    assert sorted((r.a, r.b) for r in S.token_pairs(df, "i", "t", 0.6).collect()) == want


@pytest.mark.parametrize("hot", [1 << 14, 9])
def test_token_pairs_of_families(spark, monkeypatch, hot):
    """Also what is dealt into chunks, and copies; candidates that are shuffled don't outgrow the pairs."""
    monkeypatch.setattr(S.cells, "HOT", hot)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    base = [rng.sample(words, k) for k in (3, 9, 40, 150, 420)]
    sets = {i: [w for w in base[i % 5] if rng.random() > 0.05 * (i % 6)] + rng.sample(words, rng.randrange(1 + len(base[i % 5]) // 5)) for i in range(250)} | {i: base[2] for i in range(250, 270)}
    df = spark.createDataFrame([(i, t) for i, t in sets.items()], "i long, t array<string>")
    sets = {i: set(t) for i, t in sets.items()}
    want = {(a, b): round(k * 100 / u, 2) for a in sets for b in sets if a < b and (k := len(sets[a] & sets[b])) >= 0.6 * (u := len(sets[a] | sets[b])) and u}
    got = S.token_pairs(df, "i", "t", 0.6).collect()
    assert len(got) == len(want) > 2000 and all(abs(want[r.a, r.b] - r.score) < 0.011 for r in got)


def test_token_pairs_count_what_rounds_up(spark):
    """2401 of 4002 tokens are 59.995 per cent, 60.0 in SQL; the tokens that aren't shared come first."""
    shared = [f"s{k}" for k in range(2401)]
    sets = [shared + [f"a{k}" for k in range(800)], shared + [f"b{k}" for k in range(801)], shared]
    df = spark.createDataFrame(list(enumerate(sets)), "i long, t array<string>")
    assert sorted((r.a, r.b, r.score) for r in S.token_pairs(df, "i", "t", 0.6).collect()) == [(0, 1, 60.0), (0, 2, 75.01), (1, 2, 74.98)]


@pytest.mark.parametrize("bits", [3, 19])
def test_simhash_pairs(spark, bits):
    """3 bits are a score of 95, 19 bits one of 70."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    sigs = {v - (1 << 64) if v >> 63 else v for i in range(300) for v in [base[i % 4] ^ sum(1 << k for k in rng.sample(range(64), i % 13))]}
    want = sorted((x, y) for x in sigs for y in sigs if x < y and ((x ^ y) & (2**64 - 1)).bit_count() <= bits)
    got = S.simhash_pairs(spark.createDataFrame([(x,) for x in sigs], "sig long"), bits)
    assert want and sorted((r.x, r.y) for r in got.collect()) == want


def test_minhash_pairs(spark):
    rng = random.Random(6)
    sigs = {}
    for i in range(120):  # families around the threshold; every signature has the same first slots
        keep = rng.sample(range(128), 80 + i % 30)
        sigs[i] = [k if k < 9 or k in keep and i % 3 else rng.getrandbits(60) for k in range(128)]
    same = lambda a, b: sum(v == w for v, w in zip(sigs[a], sigs[b], strict=True))
    want = sorted((a, b) for a in sigs for b in sigs if a < b and same(a, b) >= 64)
    got = S.minhash_pairs(spark.createDataFrame(list(sigs.items()), "cls long, sig array<long>"), 64)
    assert 100 < len(want) < 6000 and sorted((r.x, r.y) for r in got.collect()) == want


def test_minhash_keys_go_in_packs(spark, monkeypatch):
    """No row for each of a class's 67 keys is staged; copies, and what is dealt into chunks, lose nothing."""
    rows = []
    monkeypatch.setattr(S.cells, "HOT", 20)
    rng = random.Random(9)
    base = [[rng.getrandbits(60) for _ in range(128)] for _ in range(5)]
    sigs = {i: [v if rng.random() < 0.6 + 0.02 * (i % 20) else rng.getrandbits(60) for v in base[i % 5]] for i in range(150)}
    same = lambda a, b: sum(v == w for v, w in zip(sigs[a], sigs[b], strict=True))
    want = sorted((a, b, round(same(a, b) * 100 / 128, 2)) for a in sigs for b in sigs if a < b and same(a, b) >= 64)
    got = S.minhash_pairs(spark.createDataFrame(list(sigs.items()) + [(3, sigs[3])] * 30, "cls long, sig array<long>"), 64, lambda df: (rows.append(df.count()), df)[1])
    assert len(want) > 500 and sorted((r.x, r.y) for r in got.collect()) == [(a, b) for a, b, _ in want]
    assert all(abs(r.score - s) < 0.011 for r, (_, _, s) in zip(sorted(got.collect()), want, strict=True))
    assert max(rows) < 20 * 180


@pytest.mark.parametrize(("name", "sign", "score", "least"), [
    ("sim_simhash", signatures.simhash, lambda a, b: 100 - round((a ^ b & (2**64 - 1)).bit_count() * 100 / 64), 95),
    ("sim_minhash", signatures.minhash, lambda a, b: sum(v == w for v, w in zip(a, b, strict=True)) * 100 / 128, 50),
])
def test_similar_texts(spark, tmp_path, name, sign, score, least):
    """Classes, pairs of classes and members stand for every pair that brute force finds."""
    rng = random.Random(7)
    words = [f"w{rng.getrandbits(30)}" for _ in range(400)]
    base = [rng.choices(words, k=300) for _ in range(3)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.02 * (i % 4) else w for w in base[i % 3]) for i in range(60)] + [" ".join(base[0])] * 3 + ["", "ab"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.score for r in all_queries.QUERIES[name](spark, str(tmp_path)).collect()}
    signed = {i: s for i, t in rows if (s := sign(t)) is not None}
    first = {i: min(j for j in signed if signed[j] == s) for i, s in signed.items()}
    unsigned = (lambda v: v & (2**64 - 1)) if name == "sim_simhash" else (lambda v: v)
    pair = lambda i, j: score(unsigned(signed[i]), unsigned(signed[j])) >= least
    want = {(i, j) for i in signed for j in signed if i < j and first[i] == i and (first[j] == i or first[j] == j and pair(i, j))}
    assert want and set(got) == want


@pytest.mark.parametrize(("name", "table", "rows", "order"), [
    ("sort_lines", "documents", 1205, lambda r: (r.line.lower(), r.doc_id, r.pos)),
    ("sort_lines_by_value_part", "documents", 1202, lambda r: (r.v, r.doc_id, r.pos)),
    ("sort_count_then_key", "documents", 602, lambda r: (-r.cnt, r.word)),
    ("sort_csv_numeric", "lineitem", 600, lambda r: (-r.q, r.l_orderkey, r.l_linenumber)),
    ("sort_csv_score", "customer", 600, lambda r: (-r.c_acctbal, r.c_custkey)),
    ("sort_hue", "part", 600, lambda r: (r.h, r.s, r.v, r.p_partkey)),
])
def test_full_sorts(spark, tmp_path, name, table, rows, order):
    """Every row comes, in order, past the first 500 or 1000."""
    letters = lambda k: "".join("abcdefghij"[int(x)] for x in f"{k:03d}")
    made = {
        "documents": ([(i, f"{letters(i)}: {i % 7} = x\nB{i}=c{i % 5} ", "en", "s") for i in range(600)] + [(600, "k:v\n\nZeta\nzeta=1\nnone", "en", "s")], "doc_id long, text string, lang string, source string"),
        "lineitem": ([(i, 1, "N", float(i % 50)) for i in range(600)], "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double"),
        "customer": ([(i, float(i * 37 % 101)) for i in range(600)], "c_custkey long, c_acctbal double"),
        "part": ([(i,) for i in range(600)], "p_partkey long"),
    }[table]
    spark.createDataFrame(*made).write.parquet(f"{tmp_path}/{table}.parquet")
    got = all_queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == rows and got == sorted(got, key=order)
    if name == "sort_lines_by_value_part":
        assert (600, "v") in {(r.doc_id, r.v) for r in got}


def test_blob_of_whole_text(spark, tmp_path):
    texts = ["", "short", "é/+~" * 500, "line\n" * 400]
    docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: json.loads(r.value)["__blob_base64"] for r in all_queries.QUERIES["json_blob_encode"](spark, str(tmp_path)).collect()}
    assert {i: base64.b64decode(v, validate=True).decode() for i, v in got.items()} == dict(enumerate(texts))


def test_signatures():
    a, b = "the quick brown fox jumps over the lazy dog " * 3, "the quick brown fox jumps over the lazy cat " * 3
    same = sum(x == y for x, y in zip(signatures.minhash(a), signatures.minhash(b), strict=True))
    assert signatures.minhash("") is None and 60 < same < 128
    assert (signatures.simhash(a) ^ signatures.simhash(b)).bit_count() < 20


def test_breaks():
    assert breaks.break_line("a" * 130, 120) == ["a" * 120, "a" * 10]
    assert breaks.repeated_keys('{"a": 1, "a": 2, "b": {"c": 1, "c": 2}}') == ["a", "c"]


def test_python_functions(spark):
    src = 'import os\nfrom a.b import c\nX = 1\ndef f():\n    """doc"""\n    return 1  # one\n'
    df = spark.createDataFrame([(0, src), (1, "not python ("), (2, None)], "i long, s string").orderBy("i")
    assert [r[0] for r in df.select(ST.imported_modules("s")).collect()] == [["a", "os"], [], []]
    assert '"""' not in df.select(ST.strip_python("s")).first()[0]
    assert [x.name for x in df.select(ST.definitions("s")).first()[0]] == ["X", "f"]


def test_entry_works_without_the_subpackage(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['textloom.llm'] = None\nimport __spark_entry__ as e\nassert e._llm is None and 'agg_word_count' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    import os

    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_piecewise_hashes():
    """The digests and the score of two published strings."""
    a = fuzzy.ctph("Also called fuzzy hashes, Ctph can match inputs that have homologies.")
    b = fuzzy.ctph("Also called fuzzy hashes, CTPH can match inputs that have homologies.")
    assert (a, b) == ("3:AXGBicFlgVNhBGcL6wCrFQEv:AXGHsNhxLsr2C", "3:AXGBicFlIHBGcL6wCrFQEv:AXGH6xLsr2C") and fuzzy.ctph_score(a, b) == 22
    assert fuzzy.ctph("") == "3::" and fuzzy.ctph(None) is None and fuzzy.ctph_score(a, None) == 0 and fuzzy.ctph_score(a, a) == 100
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ijkl") for _ in range(9000))
    other = "".join(rng.choice("abcdefgh ijkl") for _ in range(9000))
    assert fuzzy.ctph_score(fuzzy.ctph(text), fuzzy.ctph(text[:4000] + "changed" + text[4100:])) > 80
    assert fuzzy.ctph_score(fuzzy.ctph(text), fuzzy.ctph(other)) < 30


def test_bucket_hashes():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ijkl") for _ in range(3000))
    near, far = text[:1500] + "some other words" + text[1510:], "".join(rng.choice("MNOPQ rstuvw.") for _ in range(3000))
    h = [fuzzy.bucket_hash(t) for t in (text, near, far)]
    assert fuzzy.bucket_distance(h[0], h[0]) == 0 and fuzzy.bucket_distance(h[0], h[1]) < 40 < 100 < fuzzy.bucket_distance(h[0], h[2])
    assert fuzzy.bucket_hash("short") is None and fuzzy.bucket_hash("a" * 500) is None and fuzzy.bucket_distance(None, h[0]) is None
    assert len(fuzzy.bucket_hash(text)) == 4 + 128 and fuzzy.bucket_hash(text, fuzzy.table(9)) != h[0]


def test_piece_pairs(spark):
    """Pairs by keys against all pairs."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ijkl") for _ in range(2000)) for _ in range(4)]
    texts = [b[: rng.randrange(1200, 2000)] + "x" * rng.randrange(3) + b[rng.randrange(300) :] for b in base for _ in range(8)]
    digests = sorted({fuzzy.ctph(t) for t in texts})
    classes = spark.createDataFrame(list(enumerate(digests)), "cls long, sig string")
    got = {(r.x, r.y): r.score for r in S.piece_pairs(classes, 40).collect()}
    every = {(i, j): fuzzy.ctph_score(digests[i], digests[j]) for i in range(len(digests)) for j in range(i + 1, len(digests))}
    assert got == {k: v for k, v in every.items() if v >= 40} and len(got) > 10


def test_lexrank():
    text = "Cats sleep on warm roofs. Dogs bark at the gate. Cats sleep on warm stones. Cats sleep on cold roofs too. Rain fell. A train left the old station late. Cats like warm roofs to sleep on."
    got = documents.lexrank(text, 3)
    assert got.count("Cats") >= 2 and len(documents.sentences(got)) == 3 and documents.lexrank("One two three. Four five six.") == "One two three. Four five six." and documents.lexrank(None) == ""
    p = documents.ranks(documents.sentences(text))
    assert abs(p.sum() - 1) < 1e-6 and (p > 0).all()


def test_flat_json():
    shared, loop = ["x", 1, None], {"name": "loop"}
    loop["self"] = loop
    for value in ({"a": shared, "b": {"c": "x", "d": []}, "e": True}, [shared, [1.5, "é"]], "text", 7, None, {}):
        assert documents.unflatten(documents.flatten(value)) == value
    back = documents.unflatten(documents.flatten({"p": shared, "q": shared}))
    assert back["p"] is back["q"] and documents.unflatten(documents.flatten(loop))["self"]["self"]["name"] == "loop"
    assert documents.flatten({"a": ["x"], "b": "x"}) == '[{"a":"1","b":"2"},["2"],"x"]'


def test_sizes_are_dealt_as_one_balance():
    rng = random.Random(4)
    for n, most, bins in ((1, 5, 3), (500, 50, 8), (300, 3, 7), (40, 1000, 6), (10, 1, 4)):
        sizes = [(k, rng.randrange(most + 1)) for k in range(n)]
        want = [0] * bins
        for i, b in FI.balanced_bins(sizes, bins):
            want[b] += sizes[i][1]
        counts = Counter(x for _, x in sizes)
        got, seen = [0] * bins, Counter()
        for size, first, until, turn in FI.dealt_sizes(list(counts.items()), bins):
            for r in range(first, until):
                got[turn[(r - first) % len(turn)]] += size
                seen[size] += 1
        assert sorted(got) == sorted(want) and seen == counts


def test_composite_scores(spark):
    rows = [("same", "same"), ("green tea pot", "green tea cup"), ("abc", "xyz"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(ST.composite(ST.sequence_ratio("a", "b"), ST.token_share(F.col("a"), F.col("b")), ST.ctph_score(ST.ctph("a"), ST.ctph("b")), always=2)).collect()]
    def want(a, b):
        x, y = set(a.split()), set(b.split())
        first = [round(100 * difflib.SequenceMatcher(None, a, b, False).ratio(), 4), round(100 * len(x & y) / len(x | y), 2) if x | y else 0.0]
        third = fuzzy.ctph_score(fuzzy.ctph(a), fuzzy.ctph(b))
        return round(sum([*first, *[third] * (third > 0)]) / (2 + (third > 0)), 2)

    assert got == pytest.approx([want(*r) for r in rows], abs=0.01)


def test_chunks_of_characters(spark):
    rng = random.Random(5)

    def want(x):
        out, at = [], 0
        while len(x) - at > 50:
            part = x[at : at + 50]
            cut = max((part.rfind(c, 40) for c in ".!?"), default=-1) + 1
            cut = cut or part.rfind(" ", 1) + 1 or 50
            out.append(part[:cut])
            at += cut
        return [*out, x[at:]] if x[at:] else out

    texts = ["", "short", "a" * 120, " " * 60, "é" * 51] + ["".join(rng.choice("ab é\n. ") for _ in range(rng.randrange(400))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string").orderBy("i")
    assert [r[0] for r in df.select(ST.chunk_chars(F.col("s"), 50, 40)).collect()] == [want(t) for t in texts]


def test_staged_tables_go_with_their_scope(spark):
    with staging.passing(spark) as kept:
        a, b = (staging.stage(spark, spark.range(3), k) for k in "ab")
        kept.append(b)
    assert b.count() == 3 and b.staged_at in staging._all
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a.staged_at)
    staging.drop(spark, b)
    assert b.staged_at not in staging._all


def test_pickles_run_nothing(spark):
    """Plain values come as JSON; what names a function, is broken or null gives null."""
    import pickle

    class Call:
        def __reduce__(self):
            return print, ("ran",)

    raw = [pickle.dumps({"a": [1, 2.5, None, "é"], "b": (True, {"c": 1})}), pickle.dumps(Call()), b"no", b"", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "i int, x binary")
    got = [r[0] for r in df.orderBy("i").select(ST.pickle_json("x")).collect()]
    assert got == ['{"a":[1,2.5,null,"é"],"b":[true,{"c":1}]}', None, None, None, None]


def test_letters_follow_only_shared_keys(spark):
    """A key of one row is never sent with its letters; bits give the same scores as the table of all prefixes."""
    from textloom.functions import fuzzy

    staged = []

    def cut(df):
        rows = df.collect()
        staged.append(len(rows))
        return spark.createDataFrame(rows, df.schema)

    sigs = ["3:ABCDEFGHIJ:KLMNOPQ", "3:ABCDEFGHIK:RSTUVWX", "6:abcdefgh:ijklmnop", "3::A"]
    got = S.piece_pairs(spark.createDataFrame(list(enumerate(sigs)), "cls long, sig string"), 1, cut).collect()
    assert [(r.x, r.y, r.score) for r in got] == [(0, 1, fuzzy.ctph_score(sigs[0], sigs[1]))] and max(staged) == 6
    assert sorted(fuzzy.gram_codes(["", "ABCDEFGH"])[0].tolist()) == [1, 1]


def test_large_files_are_told_by_their_heads(spark, tmp_path):
    """Files of more than 2 GB, odd names, and a NUL behind the head."""
    from textloom.plans.all_queries import QUERIES

    folder = tmp_path / "a b%20"
    folder.mkdir()
    (folder / "text").write_bytes(b"x" * 8192 + bytes(9))
    (folder / "nul é").write_bytes(b"x" * 8191 + bytes(1))
    (folder / "large").write_bytes(b"abc")
    with open(folder / "large", "r+b") as f:
        f.truncate(3 << 30)  # takes no room
    got = {r.name: r.binary for r in QUERIES["filter_is_binary"](spark, str(tmp_path)).collect()}
    assert got == {"text": False, "nul é": True, "large": True}


def test_leaders_are_not_broadcast(spark):
    from textloom.operators import similarity

    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = similarity.leaders(pairs, lambda df: spark.createDataFrame(df.collect(), df.schema))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(2, 1), (4, 3)]


def test_files_of_few_text_bytes_are_binary(spark, tmp_path):
    """Over three tenths of bytes that are no text in the first 8192 make a file binary without any NUL."""
    from textloom.plans.all_queries import QUERIES

    rng = random.Random(3)
    text = bytes(range(32, 127)) + b"\n\r\t\b"
    files = {"text": text, "utf8": "naïve café au lait".encode(), "greek": "αβγδ".encode(), "three tenths": b"\xff" * 3 + b"a" * 7, "more": b"\xff" * 4 + b"a" * 7, "controls": b"\x01\x1b\x7f" * 9 + b"a", "nul": b"a\0" + b"a" * 50}
    files |= {"behind": b"a" * 8192 + b"\xff" * 9000, "before": b"\xff" * 8192 + b"a" * 90000, "every byte": bytes(range(1, 256))}
    files |= {f"dealt {k}": bytes(rng.choice(text) if rng.random() * 60 > k else rng.randrange(1, 256) for _ in range(200)) for k in range(0, 60, 3)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)

    def rule(chunk):
        return bool(chunk) and (0 in chunk or sum(b not in text for b in chunk) / len(chunk) > 0.3)

    want = {name: rule(data[:8192]) for name, data in files.items()}
    assert {r.name: r.binary for r in QUERIES["filter_is_binary"](spark, str(tmp_path)).collect()} == want
    assert want["greek"] and want["more"] and want["controls"] and want["before"] and not (want["three tenths"] or want["behind"] or want["utf8"])
    empty = spark.createDataFrame([(b"",), (b"\xff",)], "content binary")  # Spark lists no empty files
    assert [r.b for r in empty.select(FI.is_binary(F.col("content")).alias("b")).collect()] == [False, True]


def test_texts_are_signed_once(spark, tmp_path, monkeypatch):
    """A filter on a signature made each twice; texts without one are still left out."""
    from textloom.plans import table_queries

    plans, stage = [], staging.stage
    monkeypatch.setattr(table_queries, "staged", lambda spark, df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), stage(spark, df, label))[1])
    rows = [(0, "abcd"), (1, None), (2, ""), (3, "éé"), (4, "éé!"), (5, "éé!"), (6, "abcde")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in all_queries.QUERIES["sim_minhash"](spark, str(tmp_path)).collect()]
    assert got == [(4, 5, 100.0)]
    assert [p.count("ArrowEvalPython") for label, p in plans if label == "minhash"] == [1]


@pytest.mark.parametrize(("few", "hot"), [(48, 1 << 14), (3, 1 << 14), (3, 20), (48, 20)])
def test_frequent_slots_make_no_candidates(spark, monkeypatch, few, hot):
    """All signatures agree in 42 slots; only what agrees in about 64 is compared in full, in small and in large groups, in chunks too."""
    monkeypatch.setattr(S.cells, "FEW", few)
    monkeypatch.setattr(S.cells, "HOT", hot)
    monkeypatch.setattr(S.cells, "SIDE", 8)
    rng = random.Random(11)
    base = [[s if s < 42 else rng.getrandbits(60) for s in range(128)] for _ in range(9)]
    own = rng.sample(range(42, 128), 86)
    sigs = {i: [v if s < 42 or s in own[: 20 + i % 7] and i < 120 else rng.getrandbits(60) for s, v in enumerate(base[i % 9])] for i in range(300)}
    same = lambda a, b: sum(v == w for v, w in zip(sigs[a], sigs[b], strict=True))
    want = {(a, b): same(a, b) for a in sigs for b in sigs if a < b and same(a, b) >= 64}
    rows = []
    got = S.minhash_pairs(spark.createDataFrame(list(sigs.items()), "cls long, sig array<long>"), 64, lambda df: (rows.append(df.count()), df)[1])
    assert 100 < len(want) < 1000 and {(r.x, r.y): round(r.score * 1.28) for r in got.collect()} == want
    assert rows[0] < 4 * len(want)
