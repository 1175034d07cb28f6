"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are what its bytes look like, whatever its language: trigrams of byte classes, word lengths, words
that repeat the ones before and repeated word trigrams. The space is a truncated singular value decomposition of
the weighted terms of a bounded sample of labelled texts. Its vectors, `sample` times `dims` numbers, are broadcast. Every
text is scored by exact products with all of them, block by block, and its nearest neighbours' labels are averaged
with weights that grow with similarity. Scoring is one pass without a shuffle.

The sample is the `sample` labelled rows, out of those whose crc32(doc_id as text) mod 5 is not 0, that come first by a
hash of their id; it does not grow with the corpus. Everything else covers all rows.

Cases: a null, empty or blank text has no terms and gets the sample's mean label. A very long text is scored whole. Repeated rows each get a
row; of rows that repeat a labelled id, one, by its terms, is in the sample. Neighbours that are as near as the last of the NEIGHBOURS all
vote, so ties have one result. Null labels and ids in `labels` are passed over; without any label every score is 0.5. A null doc_id is
not held out. An empty table gives no rows. `score` passes the columns in `keep` through, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.common import column, fresh, table

SAMPLE = 3000
DIMS = 48
NEIGHBOURS = 15
SHARPNESS = 8
CUT = 0.3
FOLDS = 5
TRIGRAMS = 1024
LENGTHS = 16
EXTRA = 8
SEED = 5

# classes of bytes: lower-case and all non-ASCII bytes, upper case, digits, space, line ends, each other sign
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_signs = [c for c in range(128) if chr(c).isprintable() and not chr(c).isalnum() and c != 32]
for _k, _c in enumerate(_signs):
    _CLASS[_c] = 5 + _k % 27
_fold_rng = np.random.default_rng(SEED)
_FOLD = _fold_rng.integers(0, TRIGRAMS, 1 << 15)
_SPACES = np.ones(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = False
WIDTH = TRIGRAMS + LENGTHS + EXTRA


def terms(column: pa.Array) -> np.ndarray:
    """Square roots of term shares, one row per text."""
    data, offsets = ts.string_buffers(column)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for i, j in ts.chunks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        start, end, text = ts.word_spans(part, at, _SPACES)
        if not len(start):
            continue
        words = np.bincount(text, minlength=n).astype(np.float64)
        size = np.diff(at)
        kind = _CLASS[part]
        doc = np.repeat(np.arange(n), size)
        if len(part) > 2:
            code = _FOLD[(kind[:-2] << 10) | (kind[1:-1] << 5) | kind[2:]]
            own = doc[:-2] == doc[2:]
            tri = np.bincount(doc[:-2][own] * TRIGRAMS + code[own], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS).astype(np.float64)
        else:
            tri = np.zeros((n, TRIGRAMS))
        length = np.bincount(text * LENGTHS + np.minimum(end - start, LENGTHS) - 1, minlength=n * LENGTHS).reshape(n, LENGTHS)
        h = ts.word_hashes(part, start, end)
        extra = np.zeros((n, EXTRA))
        for k in (1, 2):
            if len(h) > k:
                same = (h[k:] == h[:-k]) & (text[k:] == text[:-k])
                share = np.bincount(text[k:][same], minlength=n) / np.maximum(1, words)
                extra[:, 2 * k - 2], extra[:, 2 * k - 1] = share, 1 - share
        grams = ts.gram_hashes(h, 3)
        if len(grams):
            own = text[2:] == text[:-2]
            key = np.stack([text[:-2][own].astype(np.uint64), grams[own]])
            order = np.lexsort(key[::-1])
            k0, k1 = key[0][order], key[1][order]
            again = (k0[1:] == k0[:-1]) & (k1[1:] == k1[:-1])
            share = np.bincount(k0[1:][again].astype(np.int64), minlength=n) / np.maximum(1, np.bincount(k0.astype(np.int64), minlength=n))
            extra[:, 4], extra[:, 5] = share, 1 - share
        distinct = np.zeros(n)
        order = np.lexsort((h, text))
        t0, h0 = text[order], h[order]
        fresh = np.ones(len(h0), bool)
        fresh[1:] = (t0[1:] != t0[:-1]) | (h0[1:] != h0[:-1])
        distinct = np.bincount(t0[fresh], minlength=n) / np.maximum(1, np.minimum(words, 50 + np.sqrt(words)))
        extra[:, 6], extra[:, 7] = np.minimum(1, distinct), 1 - np.minimum(1, distinct)
        extra[words == 0] = 0
        tri /= np.maximum(1, tri.sum(1, keepdims=True))
        shares = np.concatenate([tri, length / np.maximum(1, words)[:, None], extra], 1)
        out[i:j] = np.sqrt(shares)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.sqrt((x * x).sum(1, keepdims=True)))


class Model:
    """Term weights, the projection, and the sample's unit vectors with their labels."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        x = shares.astype(np.float64)
        seen = (x > 0).sum(0)
        self.weight = np.log((1 + len(x)) / (1 + seen)) + 0.3
        self.weight[TRIGRAMS + LENGTHS :] = 2.0
        x = x * self.weight
        dims = max(1, min(dims, *x.shape))
        q = np.random.default_rng(SEED).standard_normal((x.shape[1], min(x.shape[1], dims + 16)))
        for _ in range(4):  # subspace iteration
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.project = (q @ v.T)[:, :dims] * self.weight[:, None]
        self.project = self.project.astype(np.float32)
        self.vectors = _unit(shares @ self.project).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.mean = float(labels.mean())

    def score(self, shares: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        out = np.full(len(shares), self.mean)
        k = min(neighbours, len(self.labels))
        for i in range(0, len(shares), block):
            x = shares[i : i + block]
            # rounded, so that equal texts tie however the products are summed up
            cos = np.round(_unit(x @ self.project) @ self.vectors.T, 5)
            last = np.partition(cos, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            row, near = np.nonzero(cos >= last[:, None])
            weight = np.maximum(0, cos[row, near]).astype(np.float64) ** SHARPNESS
            total = np.bincount(row, weight, len(x))
            vote = np.bincount(row, weight * self.labels[near], len(x)) / np.maximum(1e-12, total)
            some = (total > 1e-12) & (x.any(1))
            out[i : i + block][some] = vote[some]
        return np.clip(out, 0, 1)


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", sample: int = SAMPLE, dims: int = DIMS) -> Model | None:
    """Learns from the labelled sample; at most `sample` rows reach the driver, as term shares of fixed width."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = usable.select("doc_id", F.col(label).cast("double").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = documents.select(F.col("doc_id").alias("doc_id"), column(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in terms(batch.column(0))], pa.binary()), batch.column(1), batch.column(2)], names=["shares", "label", "doc_id"])

    marked = rows.mapInArrow(run, f"shares binary, label double, doc_id {documents.schema['doc_id'].dataType.simpleString()}")
    got = marked.groupBy("doc_id", "label").agg(F.min("shares").alias("shares")).toArrow().to_pylist()  # a row a label, however often an id is repeated
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["shares"]))
    shares = np.stack([np.frombuffer(r["shares"], np.float32) for r in got])
    return Model(shares, np.array([r["label"] for r in got]), dims)


def score(documents: DataFrame, model: Model | None, text: str = "text", keep: tuple = ("doc_id",), name: str = "score") -> DataFrame:
    """Adds the score, by that name, to the columns in keep."""
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    source = documents.select(column(text).cast("string").alias("text"), *[column(c).alias(f"c{i}") for i, c in enumerate(keep)])

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in batches:
            parts = []
            for i in range(0, batch.num_rows, 256):
                column = batch.column(0).slice(i, 256)
                parts.append(own.score(terms(column)) if own else np.full(len(column), 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*batch.schema.names[1:], "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(run, f"{kinds}, score double").toDF(*keep, name)


def report(scored: DataFrame) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever their names."""
    name = fresh(documents, "score")
    return score(documents, fit(documents, labels, text=text), text, tuple(documents.columns), name).filter(column(name) >= CUT).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return report(score(documents, fit(documents, table(spark, sf_dir, "labels"))))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def brute_force(sample: list[tuple], texts: list[str | None], neighbours: int = NEIGHBOURS) -> list[float]:
    """Scores of texts by plain Python, from a sample of (text, label) and the same projection; ties as in `Model.score`."""
    shares = terms(pa.array([t for t, _ in sample], pa.string()))
    model = Model(shares, np.array([float(v) for _, v in sample]))
    known, out = model.vectors.astype(float).tolist(), []
    for x in terms(pa.array(texts, pa.string())):
        if not x.any():
            out.append(model.mean)
            continue
        v = (x @ model.project).astype(float)
        size = sum(c * c for c in v.tolist()) ** 0.5
        cos = [round(sum(a * b for a, b in zip(v.tolist(), w, strict=True)) / size, 5) for w in known]
        last = sorted(cos, reverse=True)[min(neighbours, len(cos)) - 1]
        votes = [(max(0, c) ** SHARPNESS, label) for c, (_, label) in zip(cos, sample, strict=True) if c >= last]
        total = sum(w for w, _ in votes)
        out.append(sum(w * label for w, label in votes) / total if total > 1e-12 else model.mean)
    return out
