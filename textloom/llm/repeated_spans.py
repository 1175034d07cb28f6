"""Repeated byte strings by a depth-limited radix sort of suffixes.

The key of a window of LENGTH bytes is its bytes in a fixed order of places: first the GRAM bytes at its anchor, then the
bytes behind them, then those before the anchor, backwards. The anchor is the window's GRAM-byte string with the least hash,
the leftmost of equals, so equal windows have it at the same place, and neighbouring windows share it: one record, a suffix
that begins at an anchor, stands for the run of windows around it, about one record in 35 bytes. Suffixes are put in order by
most-significant-digit passes, only through the bytes of their windows, and only while they tie:

1. Counting pass. Records are sorted by a 64-bit name of the first digit, the anchor's GRAM bytes, and a digit that only one record has
   goes: its windows are unlike all others. Copies within a batch are settled before the shuffle, byte by byte.
2. Suffix pass. What is left is range-partitioned and sorted by the suffixes' own bytes, doc and place, and read as a stream. Suffixes that
   tie to the end are neighbours: all but the earliest are repeated throughout.
3. Window passes. Records that share a first digit but not everything are compared window by window, 8 bytes a pass; groups of one
   drop out after each pass, and groups that tie to the end are exactly the repeated windows. A first digit with more than HOT
   records, or one that a range boundary cuts, gives its windows to one more range-partitioned sort by all their bytes.
Of windows that tie to the end all but the earliest are repeated, and the bytes that these cover are removed.

Hashes only choose anchors and bring records together; every verdict is an equality of bytes. No task holds more than a
few thousand records; doc and place are the last sort key, so a hot group spreads over ranges.

Every byte string is judged on the input. Earlier means a smaller doc_id, or an earlier start in one document.

Cases: a null text is empty; texts below LENGTH bytes have no windows and lose nothing; very long texts are cut into overlapping
pieces of about a megabyte while records are made, with the same result. Where doc_ids repeat or are null, rows
are ordered by (doc_id, text), null first, and rows equal in both count as one document: each gets its figures. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.common import column, partitions, passing, stage, table

LENGTH = 100
GRAM = 32
HOT = 4096
#: Records that the first pass holds at once, and records whose windows are compared or copied at once.
HELD, CUT = 250_000, 4096
#: at: the anchor's place in the buffer that the record was made from; pos: its place in its text; the run's windows begin high to low bytes before it.
RECORD = np.dtype([("digit", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("pos", "<i8"), ("low", "<i8"), ("high", "<i8")])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    n = len(v)
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    forward = np.minimum.accumulate(x, axis=1).ravel()
    backward = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return np.minimum(backward[:m], forward[w - 1 : w - 1 + m])


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Intervals of each document, those that touch put together."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    run = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    reach = stop.copy()
    shift = np.zeros(len(doc), np.int64)
    shift[run] = 1
    group = np.cumsum(shift)
    big = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * big) - group * big
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def records(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """One record per run of windows with a common anchor."""
    w = length - gram + 1
    if len(data) < length:
        return np.zeros(0, RECORD)
    prefix = ts.prefix_sums(data, ts.BYTE_VALUES)
    at = np.arange(len(data) - gram + 1)
    grams = ts.mix(ts.span_hash(prefix, at, at + gram))
    place = _sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), w) & np.uint64(0xFFFFFFFF)
    place = place.astype(np.int64)
    own = np.repeat(np.arange(len(docs)), np.diff(offsets))
    start = np.flatnonzero(own[: len(place)] == own[length - 1 :])
    if not len(start):
        return np.zeros(0, RECORD)
    p, d = place[start], own[start]
    new = np.ones(len(start), bool)
    new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    out = np.zeros(len(first), RECORD)
    p, d, s, e = p[first], d[first], start[first], start[last]
    out["digit"], out["doc"], out["at"], out["pos"] = grams[p], docs[d], p, p - offsets[d]
    out["low"], out["high"] = p - e, p - s
    out["context"] = ts.mix(ts.span_hash(prefix, s, e + length) + out["low"].astype(np.uint64) * ts.GRAM_FACTORS[0] + out["high"].astype(np.uint64) * ts.GRAM_FACTORS[1])
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int, gram: int, chunk: int = ts.CHUNK):
    """(bytes, records) of groups of short texts, and of overlapping pieces of long ones."""
    for i, j in ts.chunks(offsets, chunk):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) <= chunk + length:
            yield part, records(part, at, docs[i:j], length, gram)
            continue
        for a in range(0, len(part) - length + 1, chunk):  # one long text
            piece = part[a : a + chunk + length - 1]
            found = records(piece, np.array([0, len(piece)]), docs[i:j], length, gram)
            found["pos"] += a
            yield piece, found


def _suffixes_of(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Rows of 2 * length - gram bytes: from the anchor on, then backwards from it; zero where no window of the run reaches."""
    columns = np.concatenate([np.arange(length), -1 - np.arange(length - gram)])
    inside = (columns[None, :] < length - low[:, None]) & (columns[None, :] >= -high[:, None])
    return np.where(inside, data[np.clip(at[:, None] + columns[None, :], 0, len(data) - 1)], 0).astype(np.uint8)


def _settle(data: np.ndarray, r: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Sorts r and tells which of its records equal an earlier one of the same batch, byte by byte."""
    order = np.lexsort((r["pos"], r["doc"], r["context"], r["digit"]))
    r[:] = r[order]
    same = np.zeros(len(r), bool)
    same[1:] = (r["digit"][1:] == r["digit"][:-1]) & (r["context"][1:] == r["context"][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(r))))
    late = np.flatnonzero(same)
    for a in range(0, len(late), CUT):
        k = late[a : a + CUT]
        x, y = (_suffixes_of(data, r["at"][i], r["low"][i], r["high"][i], length, gram) for i in (k, head[k]))
        same[k] = (x == y).all(1) & (r["low"][k] == r["low"][head[k]]) & (r["high"][k] == r["high"][head[k]])
    return same


_MARKS = "digit long, doc long, pos int, low int, high int"
_SUFFIXES = "suffix binary, low int, high int, doc long, pos int"
_FOUND = "doc long, start long, stop long, window binary"
_EDGES = "doc long, start long, stop long, window binary, pending boolean"


def _named(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _intervals(doc, start, stop) -> pa.RecordBatch:
    doc, start, stop = _merged(doc, start, stop)
    return _named(_FOUND, doc, start, stop, pa.nulls(len(doc), pa.binary()))


def _first_digits(length: int, gram: int):
    """Texts -> marks: one per record, and, with pos -1, intervals low to high that repeat something of the same batch."""

    def settled(parts):
        data = np.concatenate([d for d, _ in parts])
        base = np.concatenate([[0], np.cumsum([len(d) for d, _ in parts])])
        for (_, r), at in zip(parts, base.tolist(), strict=False):
            r["at"] += at
        r = np.concatenate([r for _, r in parts])
        late = _settle(data, r, length, gram)
        early, gone = r[~late], r[late]
        doc, start, stop = _merged(gone["doc"], gone["pos"] - gone["high"], gone["pos"] - gone["low"] + length)
        digit = np.concatenate([early["digit"], ts.mix(doc.astype(np.uint64))]).view(np.int64)
        join = lambda a, b: np.concatenate([a, b])
        return _named(_MARKS, digit, join(early["doc"], doc), join(early["pos"], np.full(len(doc), -1)), join(early["low"], start), join(early["high"], stop))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(1))
            for piece, found in _pieces(data, offsets, batch.column(0).to_numpy(), length, gram):
                if not len(found):
                    continue
                parts.append((piece, found))
                held += len(found)
                if held >= HELD:
                    yield settled(parts)
                    parts, held = [], 0
        if held:
            yield settled(parts)

    return run


def _several(batches):
    """Marks sorted by digit -> the intervals, and the records whose digit another record has too."""
    carry, seen = None, False  # the last record, not given out yet, and whether the one before has its digit
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        record = np.asarray(batch.column(2)) >= 0
        yield batch.filter(pa.array(~record))
        rows = whole.filter(pa.array(record))
        if carry is not None:
            rows = pa.concat_tables([carry, rows])
        if not rows.num_rows:
            continue
        digit = rows.column(0).to_numpy()
        same = digit[1:] == digit[:-1]
        before = np.concatenate([[seen], same])
        keep = before[:-1] | same  # all but the last
        yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(keep)).combine_chunks().to_batches()
        carry, seen = rows.slice(rows.num_rows - 1), bool(before[-1])
    if carry is not None and seen:
        yield from carry.combine_chunks().to_batches()


def _suffix_rows(length: int, gram: int):
    """Texts with the records that go on -> their suffixes."""

    def run(batches):
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(1))
            docs, asks = batch.column(0).to_numpy(), batch.column(2)
            count = np.diff(np.asarray(asks.offsets)) if len(asks) else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(count)), count)
            flat = asks.flatten()
            pos, low, high = (flat.field(k).to_numpy().astype(np.int64) for k in ("pos", "low", "high"))
            for a in range(0, len(own), CUT):
                k = slice(a, a + CUT)
                yield _named(_SUFFIXES, _binary(_suffixes_of(data, offsets[own[k]] + pos[k], low[k], high[k], length, gram)), low[k], high[k], docs[own[k]], pos[k])

    return run


def _tied(r: dict, group: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, back, late) of all windows of some records: windows of one group are put in order 8 bytes a pass, and late ones tie to the end with an earlier one."""
    count = r["high"] - r["low"] + 1
    row = np.repeat(np.arange(len(count)), count)
    back = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + r["low"][row]
    late = np.zeros(len(row), bool)
    rest = length - gram  # bytes of a window beyond the first digit
    alive, tie = np.arange(len(row)), group[row] * (rest + 1) + back
    for digit in range(-(-rest // 8) + 1):
        if digit:
            place = (digit - 1) * 8 + np.arange(8)
            forward = rest - back[alive][:, None]  # bytes that stand behind the first digit
            column = np.where(place[None, :] < forward, gram + place[None, :], length + place[None, :] - forward)
            part = np.where(place[None, :] < rest, r["suffix"][row[alive][:, None], np.minimum(column, r["suffix"].shape[1] - 1)], 0).astype(np.uint8)
            value = np.ascontiguousarray(part).view(">u8")[:, 0].astype(np.uint64)
            order = np.lexsort((value, tie))
            value = value[order]
        else:
            order, value = np.argsort(tie, kind="stable"), None
        alive, tie = alive[order], tie[order]
        new = np.ones(len(alive), bool)
        new[1:] = tie[1:] != tie[:-1]
        if value is not None:
            new[1:] |= value[1:] != value[:-1]
        tie = np.cumsum(new)
        keep = np.bincount(tie)[tie] > 1
        alive, tie = alive[keep], tie[keep]
        if not len(alive):
            return row, back, late
    start, doc = (r["pos"][row] - back)[alive], r["doc"][row[alive]]
    order = np.lexsort((start, doc, tie))
    again = np.zeros(len(order), bool)
    again[1:] = tie[order][1:] == tie[order][:-1]
    late[alive[order[again]]] = True
    return row, back, late


def _ordered(length: int, gram: int, hot: int):
    """Suffixes in order -> intervals that repeat something, and the windows that other ranges or many records may share."""
    fields = ("suffix", "low", "high", "doc", "pos")

    def read(batch):
        n = batch.num_rows
        data, _ = ts.string_buffers(batch.column(0))
        r = {k: batch.column(i).to_numpy().astype(np.int64) for i, k in enumerate(fields) if i}
        return {"suffix": data.reshape(n, 2 * length - gram), **r}

    def take(r, k):
        return {f: r[f][k] for f in fields}

    def joined(parts):
        return {f: np.concatenate([p[f] for p in parts]) for f in fields}

    def spans(r, row, back):
        start = r["pos"][row] - back
        return _intervals(r["doc"][row], start, start + length)

    def settled(r, group, give: bool):
        """Compares the windows of whole first digits, or, to give them on, of a part of one."""
        for a in range(0, len(group), CUT):
            part, own = (take(r, slice(a, a + CUT)), group[a : a + CUT]) if give else (r, group)
            row, back, late = _tied(part, own, length, gram)
            if late.any():
                yield spans(part, row[late], back[late])
            if not give:
                return
            row, back = row[~late], back[~late]
            for k in range(0, len(row), 4 * CUT):
                i, b = row[k : k + 4 * CUT], back[k : k + 4 * CUT]
                place = np.arange(length)[None, :] - b[:, None]
                window = part["suffix"][i[:, None], np.where(place < 0, length - 1 - place, place)]
                start = part["pos"][i] - b
                yield _named(_FOUND, part["doc"][i], start, pa.nulls(len(i), pa.int64()), _binary(window))

    def groups(r):
        """Number of the first digit of every record."""
        new = np.ones(len(r["doc"]), bool)
        new[1:] = (r["suffix"][1:, :gram] != r["suffix"][:-1, :gram]).any(1)
        return np.cumsum(new) - 1

    def run(batches):
        open_ = None  # earliest records of the digit that is being read; its last one heads the ties that are being read
        given = 0  # how many of them went to the window sort already
        edge = True  # whether another range may have this digit too
        for batch in batches:
            if not batch.num_rows:
                continue
            r = read(batch)
            skip = 0
            if open_ is not None:
                skip = len(open_["doc"])
                r = joined([open_, r])
            same = np.zeros(len(r["doc"]), bool)
            same[1:] = (r["suffix"][1:] == r["suffix"][:-1]).all(1) & (r["low"][1:] == r["low"][:-1]) & (r["high"][1:] == r["high"][:-1])
            same[:skip] = False
            late = np.flatnonzero(same)
            if len(late):
                yield _intervals(r["doc"][late], r["pos"][late] - r["high"][late], r["pos"][late] - r["low"][late] + length)
            r = take(r, ~same)
            group = groups(r)
            last = np.searchsorted(group, group[-1])
            if group[-1]:  # digits that end here
                end = np.searchsorted(group, 1)
                if edge or given:
                    yield from settled(take(r, slice(given, end)), group[given:end], True)
                    begin = end
                else:
                    begin = 0
                edge, given = False, 0
                many = np.bincount(group)[group] > 1
                many[:begin] = many[last:] = False
                k = np.flatnonzero(many)
                size = np.bincount(group)
                if len(k) and size[group[k]].max() > hot:
                    big = k[size[group[k]] > hot]
                    yield from settled(take(r, big), group[big], True)
                    k = k[size[group[k]] <= hot]
                cut = np.flatnonzero(np.diff(group[k], prepend=-1))
                heads, at = np.append(cut, len(k)), 0
                while at < len(heads) - 1:
                    to = max(at + 1, int(np.searchsorted(heads, heads[at] + CUT, side="right")) - 1)
                    own = k[heads[at] : heads[to]]
                    yield from settled(take(r, own), group[own], False)
                    at = to
                r = take(r, slice(last, None))
            open_ = r
            n = len(open_["doc"])
            if n > hot:  # only the head of the current ties has to stay
                yield from settled(take(open_, slice(given, n)), np.zeros(n - given, np.int64), True)
                open_, given = take(open_, slice(n - 1, n)), 1
        if open_ is not None:  # the last digit may go on in the next range
            n = len(open_["doc"])
            yield from settled(take(open_, slice(given, n)), np.zeros(n - given, np.int64), True)

    return run


def _neighbours(length: int):
    """Windows in order -> those that equal the one before, and, for the other ranges, the first one (pending) and the first that equals the last one."""

    def run(batches):
        head = None  # of the current ties: (window, doc, start)
        first = True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            data, _ = ts.string_buffers(batch.column(0))
            w, doc, start = data.reshape(n, length), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            same = np.zeros(n, bool)
            same[1:] = (w[1:] == w[:-1]).all(1)
            same[0] = head is not None and bool((w[0] == head[0]).all())
            found = _merged(doc[same], start[same], start[same] + length)
            m = len(found[0])
            yield _named(_EDGES, *found, pa.nulls(m, pa.binary()), pa.nulls(m, pa.bool_()))
            if first:
                yield _named(_EDGES, doc[:1], start[:1], start[:1] + length, _binary(w[:1]), [True])
                first = False
            heads = np.flatnonzero(~same)
            if len(heads):
                head = w[heads[-1]].copy(), doc[heads[-1] : heads[-1] + 1].copy(), start[heads[-1] : heads[-1] + 1].copy()
        if head is not None:
            yield _named(_EDGES, head[1], head[2], head[2] + length, _binary(head[0][None, :]), [False])

    return run


def intervals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, spans) of (doc, text) rows with distinct, non-null doc: byte intervals, not yet merged, that repeat something earlier."""
    spark = documents.sparkSession
    n = partitions(spark)
    with passing(spark) as kept:
        marks = documents.mapInArrow(_first_digits(length, gram), _MARKS).repartition(n, "digit").sortWithinPartitions("digit")
        several = stage(spark, marks.mapInArrow(_several, _MARKS).drop("digit"), "several")
        asks = several.filter("pos >= 0").groupBy("doc").agg(F.collect_list(F.struct("pos", "low", "high")).alias("asks"))
        suffixes = stage(spark, documents.join(asks, "doc").select("doc", "text", "asks").mapInArrow(_suffix_rows(length, gram), _SUFFIXES), "suffixes")
        key = ["suffix", "low", "high", "doc", "pos"]
        ordered = stage(spark, suffixes.repartitionByRange(n, *key).sortWithinPartitions(*key).select(*key).mapInArrow(_ordered(length, gram, hot), _FOUND), "ordered")
        key = ["window", "doc", "start"]
        windows = ordered.filter("window is not null").select(*key)
        last = stage(spark, windows.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(_neighbours(length), _EDGES), "windows")
        kept += [several, ordered, last]
    # at most two rows a range: a range's first window is repeated if an earlier range ends with its equal
    edges = last.filter("window is not null").groupBy("window").agg(F.min(F.struct("doc", "start")).alias("least"), F.collect_set(F.when(F.col("pending"), F.struct("doc", "start", "stop"))).alias("x"))
    edges = edges.select("least", F.explode("x").alias("x")).filter("struct(x.doc, x.start) != least").select("x.doc", "x.start", "x.stop")
    own = several.filter("pos < 0").select("doc", F.col("low").cast("long").alias("start"), F.col("high").cast("long").alias("stop"))
    spans = own.unionByName(ordered.filter("window is null").select("doc", "start", "stop")).unionByName(last.filter("window is null").select("doc", "start", "stop")).unionByName(edges)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


_FIGURES = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(1))
            raw = memoryview(data)
            out = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                own = raw[offsets[i] : offsets[i + 1]]
                digest, at, removed, runs, kept = hashlib.sha256(), 0, 0, 0, []
                for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if s[0] > at or not runs:
                        digest.update(own[at : s[0]])
                        kept.append(bytes(own[at : s[0]]) if with_text else b"")
                        runs, removed, at = runs + 1, removed + s[1] - s[0], s[1]
                    elif s[1] > at:
                        removed, at = removed + s[1] - at, s[1]
                digest.update(own[at:])
                kept.append(bytes(own[at:]) if with_text else b"")
                out.append((len(own), removed, runs, digest.hexdigest(), b"".join(kept)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if with_text else 5], names=names[: 6 if with_text else 5])

    return run


def remove(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes if asked for, of every row."""
    spark = documents.sparkSession
    rows = documents.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if odd:
        distinct = rows.distinct().repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.xxhash64("text"))
        source = stage(spark, distinct.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.xxhash64("text")).withColumn("doc", F.monotonically_increasing_id()), "numbered")
    else:
        source = rows.withColumn("doc", F.col("doc_id"))
    plain = source.select("doc", "text")
    figures = plain.join(intervals(plain, length, gram, hot), "doc", "left").select("doc", "text", "spans").mapInArrow(_cut(with_text), "doc long, " + _FIGURES + (", kept binary" if with_text else ""))
    if not odd:
        return figures.withColumnRenamed("doc", "doc_id")
    names = source.select("doc", F.col("doc_id").alias("__id"), F.sha2("text", 256).alias("__sha"))
    named = names.join(figures, "doc").drop("doc").withColumnRenamed("__sha", "__sha2")
    out = rows.select("doc_id", F.sha2("text", 256).alias("__sha")).join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sha2")))
    return out.drop("__id", "__sha", "__sha2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))


def brute_force(documents: list[tuple], length: int = LENGTH) -> dict:
    """doc_id: the contract's other columns, from plain Python on a small list of (id, text) with distinct ids."""
    seen: set = set()
    out = {}
    for i, t in sorted(documents):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out
