"""Language of texts by a character n-gram model that Spark trains from labelled rows.

A text is lower-cased and its runs of letters stand between single blanks; its n-grams are every three characters whose middle one is a letter. A model keeps, of each language, its `keep` most frequent
n-grams, so it holds keep * languages numbers at most, whatever the corpus: -10,000 times the natural logarithm of each one's smoothed share, as integers, so that scores are sums without rounding.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP = 2000
#: Languages that a model may have; more labels than this are an error.
MOST_LANGUAGES = 200
UNIT = 10_000
#: Characters that are cut into n-grams at once.
CHUNK = 1 << 20
#: What one unit of difference in score counts for: neighbouring n-grams say much the same, so their evidence isn't added up in full. `calibrated` fits it.
WEIGHT = 0.1
LEAST_CHARS = 20
UNKNOWN = "und"


@functools.cache
def _alphabet() -> np.ndarray:
    """Every code point lower-cased, a blank for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(s := chr(c))[0] == "L":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code, text number) of every n-gram; a code holds three code points."""
    joined = "\n".join(["", *(t or "" for t in texts), ""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([1, *(len(t or "") + 1 for t in texts)])
    chars = _alphabet()[raw]
    blank = chars == 32
    stay = np.flatnonzero(~(blank[1:] & blank[:-1])) + 1
    kept = np.concatenate([[0], stay])
    chars = chars[kept].astype(np.int64)
    middle = np.flatnonzero(chars[1:-1] != 32) + 1
    return chars[middle - 1] << 42 | chars[middle] << 21 | chars[middle + 1], np.searchsorted(bounds, kept[middle], side="right") - 1


def _chunks(column: pa.Array) -> Iterator[tuple[int, list]]:
    """(first, texts) of consecutive texts, up to CHUNK characters together or one longer text."""
    first, size, held = 0, 0, []
    for k, t in enumerate(column.to_pylist()):
        if held and size + len(t or "") > CHUNK:
            yield first, held
            first, size, held = k, 0, []
        held.append(t)
        size += len(t or "")
    if held:
        yield first, held


def counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """(lang, gram, n) of all n-grams; each batch is counted before anything is shuffled."""

    def count(batches):
        for batch in batches:
            label, total = batch.column(1).to_pylist(), {}
            for first, texts in _chunks(batch.column(0)):
                code, of = grams(texts)
                names = label[first : first + len(texts)]
                for lang in set(names) - {None}:
                    mine = np.array([x == lang for x in names])
                    total.setdefault(lang, []).append(code[mine[of]])
            for lang, parts in total.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages, the n-grams that any of them keeps, and by language what one costs and what one that it doesn't keep costs."""

    languages: list[str]
    codes: np.ndarray
    cost: np.ndarray
    other: np.ndarray
    weight: float = WEIGHT

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(costs by text and language, n-grams by text)."""
        code, of = grams(texts)
        n = np.bincount(of, minlength=len(texts))
        out = n[:, None] * self.other[None, :]
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            at, of = at[hit], of[hit]
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(of, weights=self.cost[k, at] - self.other[k], minlength=len(texts)).astype(np.int64)
        return out, n

    def detect(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, confidence, cost) by text: the least cost, the first name of equal ones, and that language's share among exp(-weight * cost); without a letter: und, 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        cost, n = self.scores(texts)
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(texts)), best]
        share = 1 / np.exp(-self.weight * (cost - least[:, None]) / UNIT).sum(axis=1)
        return [self.languages[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, share, 0.0), least


def train(df: DataFrame, text: str = "text", label: str = "lang", keep: int = KEEP, weight: float = WEIGHT) -> Model:
    """A model of the rows' labels; rows without one are left out."""
    by_lang = counts(df, text, label)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    totals = {r.lang: r.total for r in by_lang.groupBy("lang").agg(F.sum("n").alias("total")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} labels")
    best = by_lang.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("lang", "gram", "n").toArrow()
    names = sorted(totals)
    codes = np.unique(best.column("gram").to_numpy()) if best.num_rows else np.zeros(0, np.int64)
    of = np.array([totals[x] + keep for x in names], np.float64)
    other = np.round(-UNIT * np.log(1 / of)).astype(np.int64)
    cost = np.repeat(other[:, None], len(codes), axis=1)
    row = np.array([names.index(x) for x in best.column("lang").to_pylist()], np.int64)
    cost[row, np.searchsorted(codes, best.column("gram").to_numpy())] = np.round(-UNIT * np.log((best.column("n").to_numpy() + 1) / of[row])).astype(np.int64)
    return Model(names, codes, cost, other, weight)


def calibrated(model: Model, rows: DataFrame, text: str = "text", label: str = "lang", grid: tuple = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)) -> Model:
    """The model with the weight of a grid at which labelled rows that it wasn't trained on are likeliest. The loss of each weight is summed by Spark."""
    shared, names = rows.sparkSession.sparkContext.broadcast(model), model.languages

    def losses(batches):
        for batch in batches:
            label, total = batch.column(1).to_pylist(), np.zeros(len(grid))
            for first, texts in _chunks(batch.column(0)):
                cost, n = shared.value.scores(texts)
                at = np.array([names.index(x) if x in names else -1 for x in label[first : first + len(texts)]])
                ok = (at >= 0) & (n > 0)
                gap = (cost[ok] - cost[ok, at[ok]][:, None]) / UNIT
                total += [np.logaddexp.reduce(-w * gap, axis=1).sum() for w in grid]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["loss"])

    each = rows.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).mapInArrow(losses, "loss array<double>")
    sums = each.select(F.posexplode("loss").alias("k", "loss")).groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    best = min(((r.loss, r.k) for r in sums), default=(0.0, grid.index(WEIGHT) if WEIGHT in grid else 0))[1]
    return Model(model.languages, model.codes, model.cost, model.other, grid[best])


def detect(df: DataFrame, model: Model, text: str, *keep: str) -> DataFrame:
    """(keep..., guess, confidence, cost) of every row."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    inner = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(inner, keep, strict=True)], F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for first, texts in _chunks(batch.column(len(inner))):
                guess, confidence, cost = shared.value.detect(texts)
                own = [batch.column(k).slice(first, len(texts)) for k in range(len(inner))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(guess, pa.string()), pa.array(confidence), pa.array(cost.astype(np.int64))], names=[*inner, "guess", "confidence", "cost"])

    types = "".join(f"{k} {f.dataType.simpleString()}, " for k, f in zip(inner, source.schema.fields, strict=False))
    return source.mapInArrow(run, f"{types}guess string, confidence double, cost long").toDF(*keep, "guess", "confidence", "cost")
