"""Spelling variant grouping: words that differ by one character, found by rolling-hash deletions, and the form that each is a variant of.

Words are counted by Spark and numbered in code-point order. Prefix and suffix sums of a polynomial hash give, as integers, the hash of a word without
any one of its characters, so a word of k characters costs k steps, however long it is. Two words differ by a replacement if their hashes
without one same place agree, and by an insertion if one's hash without a place is the other's whole hash. The keys are dealt by their leading digits
(`repartitionById`), sorted in each partition, and runs of equal keys that can hold two near words are given out. Only these are then verified on strings: they are grouped and joined by
the strings themselves, so a collision of hashes joins nothing.

Nothing is all pairs: of words that differ at one place (at most one a character of the alphabet) a group gives each its number of others and the best of them.
Members of a group lie in a run of at most (characters of the alphabet) x (length + 1) rows. Forms are followed by doubling: a form
has at least `ratio` times the count, so chains are short.

Cases: a null or empty text has no runs. A null doc_id is written as ''. Repeated rows count as often as they stand there. Among near words of equal count the smallest in code-point
order is the form. Very long runs are words like any other. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.common import partitions, passing, stage, table
from textloom.llm.source_audit import folded

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: One run in so many, by its hash, loses a character before it is counted.
DROPPED = 199
RUN = "[A-Za-zÀ-ÿ]"
#: Kinds of keys: the whole word; places from 0 on are replacements, those below WHOLE deletions of place WHOLE - 1 - kind.
WHOLE = -1
_KIND = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("kind", pa.int32())])
KEYS = "key long, id long, kind int"


def words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int = DROPPED) -> DataFrame:
    """(word, n) of runs of letters with A-Z lower-cased; one run in `dropped`, by the hash of document and run, without the character that the hash names."""
    read = documents.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = read.select("doc", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run")).select("doc", folded(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    said = hashed.select(F.when(F.col("h") % dropped == 0, shorter).otherwise(F.col("run")).alias("word"))
    return said.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def numbered(counts: DataFrame) -> DataFrame:
    """(id, word, n), ids ascending with words."""
    ordered = counts.repartitionByRange(partitions(counts.sparkSession), "word").sortWithinPartitions("word")
    return ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n")


def _values(chars: np.ndarray) -> np.ndarray:
    """An odd 64-bit value of every character."""
    return ts.mix(chars.astype(np.uint64) + np.uint64(ts.SEED)) | np.uint64(1)


def deletion_keys(ids: np.ndarray, chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, kind) of words that stand end to end, without empty ones: whole, without each place, and without each place at that place."""
    size = np.diff(bounds)
    start, end = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    place = np.arange(len(chars))
    powers, inverse = ts._table(ts.BASE, len(chars) + 1), ts._table(ts.INVERSE, len(chars) + 1)
    upto = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(_values(chars) * powers[: len(chars)], dtype=np.uint64, out=upto[1:])
    less = ((upto[place] - upto[start]) + (upto[end] - upto[place + 1]) * inverse[1]) * inverse[start]
    left = (end - start - 1).astype(np.uint64)
    without = ts.mix(less + left)
    whole = ts.mix((upto[bounds[1:]] - upto[bounds[:-1]]) * inverse[bounds[:-1]] + size.astype(np.uint64))
    at = (place - start).astype(np.int32)
    fresh = np.ones(len(chars), bool)  # of equal neighbours only the first is left out
    fresh[1:] = (chars[1:] != chars[:-1]) | (at[1:] == 0)
    instead = ts.mix(without + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(ts.BASE))
    every = np.repeat(ids, size)
    return (
        np.concatenate([whole, without[fresh], instead]),
        np.concatenate([ids, every[fresh], every]),
        np.concatenate([np.full(len(ids), WHOLE, np.int32), WHOLE - 1 - at[fresh], at]),
    )


def _keyed(batches):
    for batch in batches:
        data, offsets = ts.string_buffers(batch.column(1))
        ids = batch.column(0).to_numpy()
        for i, j in ts.chunks(offsets, ts.CHUNK >> 3):
            part = data[offsets[i] : offsets[j]]
            upto = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            bounds = upto[offsets[i : j + 1] - offsets[i]]
            full = np.diff(bounds) > 0
            key, own, kind = deletion_keys(ids[i:j][full], np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32), np.append(bounds[:-1][full], bounds[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(kind)], schema=_KIND)


def _shared(batches):
    """Rows of sorted keys that may be near another one: replacements of one key, a whole word and deletions of one key."""
    held: list[np.ndarray] = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]

    def found(key, own, kind):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        run = np.cumsum(new) - 1
        total, whole, gone = (np.bincount(run, weights=w, minlength=len(run))[run] for w in (np.ones(len(key)), kind == WHOLE, kind < WHOLE))
        mask = ((kind >= 0) & (total - whole - gone > 1)) | ((kind < 0) & (whole > 0) & (gone > 0))
        return pa.RecordBatch.from_arrays([pa.array(key[mask]), pa.array(own[mask]), pa.array(kind[mask])], schema=_KIND)

    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
        if cut:
            yield found(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield found(*held)


def candidates(numbers: DataFrame) -> DataFrame:
    """(key, id, kind) of all that shares a key."""
    n = partitions(numbers.sparkSession)
    # the digit: a key's leading 24 bits, spread over the partitions
    digit = F.floor(F.call_function("shiftrightunsigned", "key", F.lit(40)) * n / (1 << 24)).cast("int")
    dealt = numbers.select("id", "word").mapInArrow(_keyed, KEYS).repartitionById(n, digit)
    return dealt.sortWithinPartitions("key").mapInArrow(_shared, KEYS)


def _better(n: str, i: str) -> Column:
    """Orders near words: the largest count, then the smallest word."""
    return F.struct(F.col(n).alias("n"), (-F.col(i)).alias("m"))


def near(numbers: DataFrame) -> DataFrame:
    """(id, n_near, best) of all words (id, word, n) that have a near one; best is (n, m), -m its id."""
    spark = numbers.sparkSession
    met = stage(spark, candidates(numbers).select("id", "kind").join(numbers, "id"), "candidates")
    cut = lambda at: F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    # of one place's replacements there are as many as the alphabet has characters
    alike = met.filter("kind >= 0").groupBy("kind", cut(F.col("kind")).alias("rest")).agg(F.sort_array(F.collect_list(_better("n", "id")), asc=False).alias("all")).filter(F.size("all") > 1)
    swapped = alike.select(F.explode(F.transform("all", lambda x, i: F.struct((-x["m"]).alias("id"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(i == 0, F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0))).alias("best")))).alias("e")).select("e.*")
    longer = met.filter(F.col("kind") < WHOLE).select(cut(WHOLE - 1 - F.col("kind")).alias("word"), F.col("id").alias("long_id"), F.col("n").alias("long_n"))
    shorter = met.filter(F.col("kind") == WHOLE).select("word", F.col("id").alias("short_id"), F.col("n").alias("short_n"))
    links = longer.join(shorter, "word")
    one = F.lit(1).cast("long").alias("n_near")
    sides = F.array(F.struct(F.col("long_id").alias("id"), one, _better("short_n", "short_id").alias("best")), F.struct(F.col("short_id").alias("id"), one, _better("long_n", "long_id").alias("best")))
    every = swapped.unionByName(links.select(F.explode(sides).alias("e")).select("e.*"))
    return every.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, root): every root's own root in its place, until none has one."""
    spark = forms.sparkSession
    while True:
        onward = forms.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stage(spark, forms.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forms = step.select("id", "root")
        if not step.filter("moved").limit(1).count():
            return forms


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n) without empty ones."""
    spark = counts.sparkSession
    with passing(spark) as stay:
        numbers = stage(spark, numbered(counts), "words")
        best = numbers.join(near(numbers), "id", "left")
        fits = F.col("best.n") >= F.col("n") * ratio
        formed = stage(spark, best.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, -F.col("best.m")).alias("form_id"), F.when(fits, F.col("best.n")).alias("form_n")), "forms")
        roots = followed(formed.filter("form_id is not null").select("id", F.col("form_id").alias("root")))
        named = formed.join(numbers.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id", "left").join(roots, "id", "left")
        named = named.join(numbers.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root", "left")
        out = stage(spark, named.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"), "variants")
        stay.append(out)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents")))


SQL = rf"""WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || list_transform(range(8), lambda k: 0), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {0xEDB88320}) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS doc, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST_LENGTH},}}')) AS run FROM documents),
l AS (SELECT doc, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT run, n, xor({0xFFFFFFFF}, list_reduce([{0xFFFFFFFF}] || flatten(list_transform(string_split(doc || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS h FROM l, crc),
w AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
k AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS k FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.k = b.k AND a.less = b.less AND a.word <> b.word UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.less UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.less),
f AS (SELECT w.word, w.n, count(p.other) AS n_near, first(p.other ORDER BY p.n DESC, p.other) AS form, max(p.n) AS form_n FROM w LEFT JOIN p USING (word) GROUP BY w.word, w.n),
g AS (SELECT word, n, n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n FROM f),
c AS (SELECT word, coalesce(form, word) AS root FROM g UNION SELECT c.word, g.form FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n FROM g JOIN c USING (word) JOIN g e ON e.word = c.root WHERE e.form IS NULL"""
