"""Operators 11 to 13 against brute force on small tables with nulls, empties, ties, repeats and clashing extra columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from textloom.llm import byte_bpe, decontaminate, exact_dedup, html_extract, near_dedup, packing, quality_knn, repeated_spans, secret_scan, source_audit, spelling, token_file, tokens, warc_zip
from textloom.llm.common import new_path

AUDIT = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def frame(spark, rows):
    """Documents with extra columns of clashing names, one with a dot."""
    return spark.createDataFrame([(*r, 1, "x", 2.0, 3) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, `a.b` double, word int")


# ---- 11 ----


def audited(rows, least, top):
    docs = [(lang or "", source or "", AUDIT.findall(lowered(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(10, 10), (2, 3), (1, 1)])
def test_source_audit(spark, least, top):
    rng = random.Random(least)
    words = ["Alpha", "beta", "éta", "ÉTA", "x1y", "the", "The", "日本", "gamma", "a", "zz", "ﬁn", "k\x00l", "𝒳"]
    rows = [(k % 40, " ".join(rng.choice(words[: rng.randrange(1, 15)]) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "S1", None, "日"])) for k in range(120)]
    rows += [(1, None, "en", "only"), (None, "", "en", "blank"), (2, "a b c", "xx", "alone"), (3, "1 2 3", "yy", "p"), (4, None, "yy", "q"), (5, "word " * 20000, "en", "s1")] + [rows[0]] * 12
    assert sorted(tuple(r) for r in source_audit.audit(frame(spark, rows), min_docs=least, top=top).collect()) == audited(rows, least, top)


def test_source_audit_of_nothing(spark):
    assert source_audit.audit(frame(spark, []).limit(0)).collect() == []
    assert source_audit.audit(frame(spark, [(1, None, None, None)])).collect() == []


def test_shares_are_exact(spark):
    """Counts whose product with the scale doesn't fit a long."""
    big = 9_100_000_000_000_000
    got = spark.createDataFrame([(big, 3 * big + 7), (5, 17), (0, 0), (source_audit.LONG_COUNT, source_audit.LONG_COUNT + 3)], "n long, of long").select(source_audit.share(source_audit.F.col("n"), source_audit.F.col("of")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (big + 2) // (3 * big + 7), 1 + 10**9 * 7 // 17, 1, 1 + 10**9 * (source_audit.LONG_COUNT + 2) // (source_audit.LONG_COUNT + 3)]


# ---- 12 ----


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(byte_bpe.vocabulary_path())


@pytest.fixture(scope="module")
def own(ranks):
    return byte_bpe.tables(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(own):
    """Every token has a slot of its own, and there are no others."""
    assert sorted(own.slots.tolist()) == list(range(len(own.ids)))
    assert np.array_equal(own.find(own.hashes), np.arange(len(own.ids)))
    for n in (0, 1, 2, 3, 7, 100):
        hashes = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        moves, slots = byte_bpe.perfect(hashes)
        assert sorted(slots.tolist()) == list(range(n))


def odd_texts():
    rng = random.Random(12)
    bits = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "'re", "'x", "1", "22", "!", "?'", " '", "\t", "é", "中", " ", " ", "S", "the", " and", "'ve ", "\r\n", "🙂", "٣", "ª", "²", "<|endoftext|>", "\x00", "é"]
    letters = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    return [
        "", " ", "'", "''", "'s", " 's", "a's's", "x'", "\n 's", "a" * 3000, " " * 999, "ab" * 2000 + "  ", "word " * 5000,
        *("".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)),
        *("".join(map(chr, rng.choices(letters, k=30))) for _ in range(500)),
        *("".join(map(chr, rng.choices(range(32, 127), k=60))) for _ in range(500)),
    ]


def encoded(own, texts):
    out = []
    for a, b, ids, count in byte_bpe.encode_column(own, pa.array(texts, pa.string())):
        edge = np.concatenate([[0], np.cumsum(count)])
        out += [ids[edge[k] : edge[k + 1]].tolist() for k in range(b - a)]
    return out


def test_ids_are_the_librarys(own, library):
    texts = odd_texts()
    assert encoded(own, [None, *texts]) == [[], *map(library.encode_ordinary, texts)]


def test_slices_and_cache(own, library, monkeypatch):
    """Long texts cut into slices, texts that can't be cut, and a cache that is cleared all the time."""
    monkeypatch.setattr(byte_bpe, "SLICE", 40)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    rng = random.Random(13)
    texts = ["".join(rng.choice(["word", " other", " x", "'s", "  ", "\n", "é", " Zyxq"]) for _ in range(300)) for _ in range(20)] + ["1 2 " * 200, "q" * 500, "ab cd" * 3]
    assert encoded(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_heap_is_the_merge(ranks):
    """Against merging the least rank, leftmost first, one pair at a time."""
    small = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate([b"ab", b"bc", b"abc", b"aa", b"aaaa", b"abab", b"ca", b"aab"])}
    own, rng = byte_bpe.tables(small), random.Random(14)
    for _ in range(400):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while found := min(((small[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in small), default=None):
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert np.frombuffer(byte_bpe.learn(own, [piece])[0], np.uint32).tolist() == [small[p] for p in parts]


def test_byte_bpe_query(spark, library):
    path = byte_bpe.vocabulary_path()
    texts = [None, *odd_texts()[:400], *odd_texts()[:2]]
    docs = frame(spark, [(None if k == 3 else k // 2, t, "en", "s") for k, t in enumerate(texts)])
    got = sorted(map(tuple, byte_bpe.digest(byte_bpe.encode(docs, path), path).collect()), key=repr)
    want = []
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((None if k == 3 else k // 2, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for t in texts)
    assert byte_bpe.digest(byte_bpe.encode(docs.limit(0), path), path).collect() == []


# ---- 13 ----


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def varied(counts, ratio=5):
    near = {w: [v for v in counts if v != w and one_apart(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()), key=repr)


def test_variants(spark):
    """Repeated letters, insertions at ends, replacements, chains of forms, ties, a very long word and its variants."""
    rng = random.Random(15)
    words = {"", "a"} | {"".join(rng.choice("abé") for _ in range(rng.randrange(2, 9))) for _ in range(300)}
    long = "".join(rng.choice("xyz") for _ in range(3000))
    words |= {"aaaaaa", "aaaaa", "aaaabaa", "baaaaa", long, long[:1000] + long[1001:], long[:-1] + "q", "日本語文字列", "日本語文字", "日本語文列列"}
    counts = {w: rng.choice([5, 5, 6, 25, 30, 125, 700, 5000]) for w in words}
    got = spelling.variants(spark.createDataFrame([w for w in counts.items() if w[0]], "word string, n long"))
    counts.pop("")
    assert sorted(map(tuple, got.collect()), key=repr) == varied(counts)


def test_colliding_keys_join_nothing(spark, monkeypatch):
    """All hashes fall on three values: strings decide."""
    real = spelling.deletion_keys
    counts = {"abcdef": 100, "abcdeg": 10, "abcdefg": 5, "zzzzzz": 50, "abdef": 9, "qqqqqqq": 6}
    monkeypatch.setattr(spelling, "deletion_keys", lambda ids, chars, bounds: (lambda key, own, kind: (key % np.uint64(3), own, kind))(*real(ids, chars, bounds)))
    ids, words = np.arange(len(counts)), sorted(counts)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words)], names=["id", "word"])
    rows = pa.Table.from_batches(spelling._keyed([batch])).sort_by("key")
    met = [r for b in spelling._shared(rows.to_batches(max_chunksize=7)) for r in b.to_pylist()]
    assert len({r["key"] for r in met}) <= 3 and len(met) > 20
    monkeypatch.setattr(spelling, "candidates", lambda numbers: numbers.sparkSession.createDataFrame([(r["key"], r["id"], r["kind"]) for r in met], spelling.KEYS))
    got = spelling.near(spark.createDataFrame([(i, w, counts[w]) for i, w in enumerate(words)], "id long, word string, n long")).collect()
    want = {i: sum(one_apart(w, v) for v in words if v != w) for i, w in enumerate(words)}
    assert {r.id: r.n_near for r in got} == {i: n for i, n in want.items() if n}


def test_spelling_words(spark):
    run = re.compile("[A-Za-zÀ-ÿ]+")
    rng = random.Random(16)
    texts = [None, "", "Straße STRASSE ÉCOLE École naïve×word a1bcdefgh", "abcdefghij " * 3000, "x" * 20000] + [" ".join(rng.choice(["Letters", "letters", "garden_gardens", "Überall", "12garden"]) for _ in range(60)) for _ in range(40)]
    rows = [(None if k == 7 else k % 30, t, "en", "s") for k, t in enumerate(texts)]
    want = collections.Counter()
    for i, t, _, _ in rows:
        for r in run.findall(t or ""):
            r = lowered(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 7 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            want[r] += len(r) >= 6
    got = spelling.words(frame(spark, rows), dropped=7).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if n >= 5}
    out = spelling.variants(spelling.words(frame(spark, rows), dropped=7))
    assert sorted(map(tuple, out.collect()), key=repr) == varied({w: n for w, n in want.items() if n >= 5})
    assert spelling.variants(spelling.words(frame(spark, rows).limit(0))).collect() == []


# ---- all: names of columns ----


def test_names_with_dots(spark):
    """Text and id columns, and others beside them, whose names have a dot."""
    texts = ["some words of a text that goes on for a while so that it is one, token=abcdef123", "some words of a text that goes on for a while so that it is one, token=abcdef123", None, "other"]
    docs = spark.createDataFrame([(k, t, 1.5, "x", 7) for k, t in enumerate(texts)], "`my.id` long, `my.text` string, `a.b` double, c1 string, text long")
    plain = docs.select(docs["`my.id`"].alias("doc_id"), docs["`my.text`"].alias("text"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    names = {"doc_id": "my.id", "text": "my.text"}
    for one in (repeated_spans.remove, exact_dedup.mark, near_dedup.groups, lambda d, **k: secret_scan.report(secret_scan.scan(d, **k))):
        assert rows(one(docs, **names)) == rows(one(plain))
    for one in (exact_dedup.keep, near_dedup.keep):
        assert one(docs, **names).columns == docs.columns and one(docs, **names).count() == 3
    path = tokens.vocabulary_path()
    assert rows(packing.pack(docs, path, **names).drop("sequence_id", "offset")) == rows(packing.pack(plain, path).drop("sequence_id", "offset"))
    for place, df, more in (("x", docs, names), ("y", plain, {})):
        token_file.write(df, f"{new_path(spark, 'dots')}/{place}", path, **more)
    bench = spark.createDataFrame([(1, "a text that goes on for a while so that it is one")], "item_id long, text string")
    assert rows(decontaminate.scan(docs, bench, "my.text", ("my.id", "a.b"))) == [(r[0], 1.5, *r[1:]) for r in rows(decontaminate.scan(plain, bench))]
    assert rows(decontaminate.remove_documents(docs, bench, "my.text")) == [(2, None, 1.5, "x", 7), (3, "other", 1.5, "x", 7)]
    assert rows(decontaminate.remove_spans(docs, bench, **names)) == rows(decontaminate.remove_spans(plain, bench))
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, quality int")
    good = quality_knn.keep_good(plain.withColumns({"a.b": plain.doc_id, "score": plain.doc_id, "c0": plain.text}), labels)
    assert good.columns == ["doc_id", "text", "a.b", "score", "c0"] and good.count() <= 4
    pages = spark.createDataFrame([(1, "http://x", "<p>Hello.</p>", 2)], "`p.id` long, `u.rl` string, `ht.ml` string, page_id int")
    assert html_extract.extract(pages, "p.id", "u.rl", "ht.ml").count() == 1
    assert warc_zip.read(warc_zip.write(pages, new_path(spark, "warc"), "p.id", "u.rl", "ht.ml")).count() == 1
    got = source_audit.audit(docs.withColumnRenamed("c1", "la.ng"), "my.text", "la.ng", "a.b", min_docs=1)
    assert got.count() == 0  # one source, whose words are its language's
    assert spelling.words(docs, "my.id", "my.text", least_count=1, dropped=1 << 40).count() > 0
    assert rows(byte_bpe.encode(docs, byte_bpe.vocabulary_path(), "my.id", "my.text")) == rows(byte_bpe.encode(plain, byte_bpe.vocabulary_path()))


def test_pipeline_with_other_columns(spark, sf, tmp_path):
    """Extra columns with dots, and of names that the stages use, are dropped."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs.withColumns({"a.b": docs.doc_id, "score": docs.lang, "c0": docs.text}).write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0


def test_near_copies_of_very_long_texts(spark):
    """A family whose sets fill many blocks, with shorter texts that are linked among themselves only."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(3000)}" for _ in range(12_000)]

    def copy(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(k, copy(base, 300)) for k in range(12)] + [(20 + k, copy(base, 900)) for k in range(6)] + [(40 + k, copy(base[:400], 10)) for k in range(6)] + [(60, " ".join(base[:9000]))]
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.groups(frame(spark, [(i, t, "en", "s") for i, t in rows]), weight=1 << 13).collect()}
    assert got == near_dedup.brute_force(rows)


def test_one_doc_id_fills_many_shards(spark):
    """Rows without an id, or all of one, aren't one shard, and still lie without gaps."""
    for name in (None, 7):
        path = new_path(spark, "one-id")
        docs = spark.createDataFrame([(name, f"text number {k} " * (k % 5)) for k in range(600)], "doc_id long, text string")
        token_file.write(docs, path, tokens.vocabulary_path(), shards=4)
        assert token_file.blocks(spark, path).select("shard").distinct().count() == 4
        at = 0
        for r in sorted(token_file.digest(spark, path).collect(), key=lambda r: r.start):
            assert r.start == at and r.doc_id == name
            at += r.n_tokens
