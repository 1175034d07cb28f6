"""All pairs of the rows that share a bucket, in cells of bounded size.

Small buckets are packed together; a bucket of more than CELL rows is dealt into chunks, and every two chunks meet in one cell.
No pair becomes a row: the comparison runs inside the cell and gives out what it keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 4096
SMALL = 64
TILE = 512
PACK = 1 << 20
HOT = 1 << 14
SLOTS = 1 << 18
BITS = 1 << 22
BLOCK = 1 << 18


def compare(rows: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str, cell: int = CELL, weight: str | None = None) -> DataFrame:
    """function over cells of rows (bucket long, id long, more); it gets bucket, chunk, i and j with them. rows should be staged: they are counted first.

    A chunk holds about `cell` rows, or rows whose column `weight` adds up to that.
    """
    own = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    n = rows.groupBy("bucket").agg(F.count("*").alias("bucket_rows"), F.sum(own).alias("bucket_weight")).filter("bucket_rows > 1")
    total = rows.agg(F.sum(own)).first()[0] or 0
    packs = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // cell + 1)
    chunks = F.ceil(F.col("bucket_weight") / cell)
    dealt = rows.join(n, "bucket").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("chunks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("chunk"), o).alias("i"), F.greatest(F.col("chunk"), o).alias("j")))
    sub = F.when(F.col("chunks") > 1, F.col("bucket")).otherwise(F.pmod(F.col("bucket"), F.lit(packs)))
    met = dealt.withColumn("sub", sub).withColumn("m", F.explode(meets)).select(*rows.columns, "chunk", "sub", "m.i", "m.j")
    return met.groupBy("sub", "i", "j").applyInArrow(function, schema)


def _runs(sorted_codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_codes[1:] != sorted_codes[:-1])) if len(sorted_codes) else np.zeros(0, np.int64)


def _once(batches):
    """The rows of a task whose id, their first column, it hasn't seen: copies have one id."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        new = [k for k, v in enumerate(ids) if not (v in seen or seen.add(v))]
        if new:
            yield batch if len(new) == len(ids) else batch.take(pa.array(new, pa.int64()))


def pack(items: DataFrame, keyed: Callable, fields: str, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """function over packs of keys: in each, a row (id, more fields, keys, ranks) for every item that has keys there, so that an id and its sketch go once to a pack and not once to a key.

    items: (id long, more), staged, as it is read twice; rows of one id are copies. keyed(batch) gives the owner (a row of the batch), key and rank of every key, and a function that gives the
    fields' columns of owners. A pack takes about PACK keys. Keys of more than HOT owners, by counts in SLOTS slots that are never too small, are dealt into chunks, and every two chunks meet in a cell.
    """
    spark = items.sparkSession

    def tally(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in _once(batches):
            n += np.bincount(keyed(batch)[1] & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    counted = items.mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    total, hot = counted.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > HOT, F.struct("slot", "n")))).first()
    packs = max(2 * spark.sparkContext.defaultParallelism, (total or 0) // PACK + 1)
    chunks_of = np.ones(SLOTS, np.int32)
    for slot, n in hot:
        chunks_of[slot] = min(4095, -(-n // HOT))
    shared = spark.sparkContext.broadcast(chunks_of)

    def deal(batches):
        for batch in _once(batches):
            owner, key, rank, columns = keyed(batch)
            slot = key & (SLOTS - 1)
            chunks = shared.value[slot].astype(np.int64)
            own = (batch.column(0).to_numpy() * np.int64(-7046029254386353131) >> 20)[owner] % chunks
            at = np.repeat(np.arange(len(key)), chunks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            own, hot = own[at], chunks[at] > 1
            sub = np.where(hot, packs + slot[at], (key[at] >> 18) % packs)
            code = sub << 24 | np.minimum(own, other) << 12 | np.maximum(own, other)
            order = np.lexsort((code, owner[at]))
            at, code, own = at[order], code[order], own[order]
            first = _runs(owner[at] * np.int64(1 << 45) + code)
            ends = pa.array(np.append(first, len(at)).astype(np.int32))
            who = owner[at[first]]
            for lo in range(0, len(first), 1 << 15):
                part = slice(lo, lo + (1 << 15))
                lists = [pa.ListArray.from_arrays(ends[lo : lo + (1 << 15) + 1], pa.array(v[at])) for v in (key, rank)]
                yield pa.RecordBatch.from_arrays([pa.array(code[first[part]]), pa.array(own[first[part]].astype(np.int16)), batch.column(0).take(pa.array(who[part])), *columns(who[part]), *lists], names=names)

    head = f"cell long, chunk short, id long, {fields}, keys array<long>, ranks array<int>"
    names = [f.split()[0] for f in head.split(", ")]

    def met(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks().to_numpy()
        one = np.unique(ids, return_index=True)[1]
        return function((table if len(one) == len(ids) else table.take(pa.array(one))).combine_chunks())

    return items.mapInArrow(deal, head).groupBy("cell").applyInArrow(met, schema)


def steps(items: DataFrame, tokens: Callable, slots: int) -> np.ndarray:
    """How often tokens are, in a quarter of a power of two, by counts in hash slots. tokens(batch) gives the hashes of a batch of items."""

    def tally(batches):
        n = np.zeros(slots, np.int64)
        for batch in _once(batches):
            n += np.bincount((tokens(batch) & np.uint64(slots - 1)).view(np.int64), minlength=slots)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    step = F.least(F.lit(127), F.floor(F.log2("n") * 4)).cast("byte")
    counted = items.mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).select("slot", step.alias("step")).toArrow()
    out = np.zeros(slots, np.uint8)
    out[counted.column("slot").to_numpy()] = counted.column("step").to_numpy()
    return out


ROWS = 2048
KEYS = 1 << 21
FEW = 48
SIDE = 64


def pack_sketches(items: DataFrame, keyed: Callable, function: Callable, schema: str) -> DataFrame:
    """`pack` for keys of 32 bits and sketches of one length: function(ids, sketches, met) over packs of about KEYS keys, met(like) being `meetings_like` of the pack.

    keyed(batch) gives the owner (a row of the batch, in order) and the key of every key, and a sketch (bytes) of every row.
    """
    spark = items.sparkSession

    def parts(batches):
        for batch in _once(batches):
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield part.column(0).to_numpy(), *keyed(part)

    def tally(batches):
        n = np.zeros(SLOTS, np.int64)
        for _, _, key, _ in parts(batches):
            n += np.bincount(key & np.uint32(SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    counted = items.mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    total, hot = counted.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > HOT, F.struct("slot", "n")))).first()
    packs = max(2 * spark.sparkContext.defaultParallelism, (total or 0) // KEYS + 1)
    chunks_of = np.ones(SLOTS, np.int32)
    for slot, n in hot:
        chunks_of[slot] = min(4095, -(-n // HOT))
    shared = spark.sparkContext.broadcast(chunks_of)

    def binary(data, ends):
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    def deal(batches):
        for ids, owner, key, sketch in parts(batches):
            slot = (key & np.uint32(SLOTS - 1)).astype(np.int64)
            chunks = shared.value[slot].astype(np.int64)
            own = (ids * np.int64(-7046029254386353131) >> 20)[owner] % chunks
            at = np.repeat(np.arange(len(key)), chunks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            own, hot = own[at], chunks[at] > 1
            sub = np.where(hot, packs + slot[at], (key[at] * np.int64(0x9E3779B1) >> 18 & 0xFFFFFFF) % packs)
            code = sub << 24 | np.minimum(own, other) << 12 | np.maximum(own, other)
            order = np.lexsort((code, owner[at]))
            at, code, own = at[order], code[order], own[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[at[1:]] != owner[at[:-1]]))) if len(at) else np.zeros(0, np.int64)
            ends, who = np.append(first, len(at)), owner[at[first]]
            for lo in range(0, len(first), 1 << 15):
                now, e = slice(lo, lo + (1 << 15)), ends[lo : lo + (1 << 15) + 1]
                inner, w = at[e[0] : e[-1]], who[now]
                yield pa.RecordBatch.from_arrays([pa.array(code[first[now]]), pa.array(own[first[now]].astype(np.int16)), pa.array(ids[w]), binary(sketch[w], np.arange(len(w) + 1) * sketch.shape[1]), binary(key[inner], (e - e[0]) * 4)], names=names)

    head = "cell long, chunk short, id long, sketch binary, keys binary"
    names = [f.split()[0] for f in head.split(", ")]

    def column(table, name, kind):
        c = table.column(name).combine_chunks()
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        return np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize

    def met(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        one = np.unique(ids, return_index=True)[1]
        if len(one) < len(ids):
            table = table.take(pa.array(one))
            ids = table.column("id").to_numpy()
        keys, n = column(table, "keys", np.uint32)
        sketches = column(table, "sketch", np.uint8)[0].reshape(len(ids), -1)
        chunk, cell = table.column("chunk").to_numpy(), table.column("cell")[0].as_py()
        return function(ids, sketches, lambda like: meetings_like(keys, np.repeat(np.arange(len(ids)), n), chunk if cell >> 12 & 4095 != cell & 4095 else None, like))

    return items.mapInArrow(deal, head).groupBy("cell").applyInArrow(met, schema)


def meetings_like(keys: np.ndarray, owner: np.ndarray, chunk: np.ndarray | None, like: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, key) of the owners that share a key, in blocks, of different chunks where these are given, and for which like(x, y) holds. x and y broadcast against each other: keys of many owners are compared in squares."""
    order = np.argsort(keys)
    keys = keys[order]
    start = _runs(keys)
    size = np.diff(np.append(start, len(keys)))
    some = size > 1
    start, size = start[some], size[some]
    owner = owner[order]
    few = size <= FEW
    end, here = np.repeat((start + size)[few], size[few]), np.repeat(start[few] - np.cumsum(size[few]) + size[few], size[few])
    at = np.arange(len(here)) + here
    count = end - at - 1
    before = np.append(0, np.cumsum(count))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + BLOCK, "right")) - 1)
        n = count[lo:hi]
        p = np.repeat(at[lo:hi], n)
        q = p + 1 + np.arange(len(p)) - np.repeat(before[lo:hi] - before[lo], n)
        x, y = owner[p], owner[q]
        good = like(x, y)
        if chunk is not None:
            good &= chunk[x] != chunk[y]
        if good.any():
            yield x[good], y[good], keys[p[good]]
        lo = hi
    for s, n in zip(start[~few].tolist(), size[~few].tolist(), strict=True):
        for r in range(s, s + n, SIDE):
            x = owner[r : min(r + SIDE, s + n), None]
            for c in range(r, s + n, 8 * SIDE):
                y = owner[None, c : min(c + 8 * SIDE, s + n)]
                i, j = np.nonzero(like(x, y))
                keep = i + r < j + c
                i, j = i[keep], j[keep]
                p, q = x[i, 0], y[0, j]
                if chunk is not None:
                    keep = chunk[p] != chunk[q]
                    p, q, i = p[keep], q[keep], i[keep]
                if len(p):
                    yield p, q, np.full(len(p), keys[s])


def meetings(table: pa.Table, size: np.ndarray, reach: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, rank of x, rank of y) of the rows of a pack that share a key, size[x] <= size[y], in blocks; only those with size[y] <= reach(size of x, rank of x)."""
    lists = table.column("keys").combine_chunks()
    owner, keys = np.repeat(np.arange(len(table), dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    rank, chunk, cell = table.column("ranks").combine_chunks().flatten().to_numpy(), table.column("chunk").to_numpy(), table.column("cell")[0].as_py()
    order = np.lexsort((size[owner], keys))
    owner, rank, keys = owner[order], rank[order], keys[order]
    del order, lists
    run = np.cumsum(np.append(0, keys[1:] != keys[:-1])) << 32
    at = np.arange(len(owner))
    most = np.full(len(owner), (1 << 32) - 1) if reach is None else np.clip(reach(size[owner], rank), 0, (1 << 32) - 1)
    count = np.maximum(np.searchsorted(run + size[owner], run + most, "right") - at - 1, 0)
    before = np.cumsum(count) - count
    del run, most, keys
    lo = 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + BLOCK)))
        n = count[lo:hi]
        x = np.repeat(at[lo:hi], n)
        y = x + 1 + np.arange(len(x)) - np.repeat(before[lo:hi] - before[lo], n)
        if cell >> 12 & 4095 != cell & 4095:
            across = chunk[owner[x]] != chunk[owner[y]]
            x, y = x[across], y[across]
        if len(x):
            yield owner[x].astype(np.int64), owner[y].astype(np.int64), rank[x], rank[y]
        lo = hi


def confirm(found: DataFrame, items: DataFrame, count: Callable, cut) -> DataFrame:
    """(x, y, score) of pairs (x, y) with score = count(values, x, y), a double of lists of longs. items: (id long, v array<long>), staged; rows of one id are copies. cut(df) stages a table.

    Items meet in cells by their first value, which is mostly one for like items, so that a list goes to few cells however many pairs it is in. What is in no pair is left where it is,
    by a bit for a hash of each id; large groups of one first value are dealt by id.
    """
    spark = items.sparkSession
    found = cut(found.select("x", "y").distinct())
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(BITS)).cast("int")
    ends = found.select(F.explode(F.array("x", "y")).alias("id"))
    bits = np.zeros(BITS, np.bool_)
    bits[ends.select(slot("id").alias("s")).distinct().toArrow().column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def needed(batches):
        for batch in _once(batches):
            s = batch.column(2).to_numpy()
            if len(at := np.flatnonzero(shared.value[s >> 3] >> (7 - (s & 7)) & 1)):
                yield batch.select([0, 1]).take(pa.array(at))

    kept = cut(items.select("id", "v", slot("id").alias("s")).mapInArrow(needed, "id long, v array<long>"))
    total = kept.agg(F.sum(F.size("v"))).first()[0] or 0
    groups = max(4, total // PACK + 1)
    group = F.pmod(F.xxhash64(F.col("v")[0]), F.lit(groups)).cast("int")
    weights = {r["g"]: min(4095, r["w"] // PACK + 1) for r in kept.groupBy(group.alias("g")).agg(F.sum(F.size("v")).alias("w")).collect()}
    parts = F.array(*[F.lit(weights.get(g, 1)) for g in range(groups)])[group]
    place = kept.select("id", (group.cast("long") * 4096 + F.pmod(F.xxhash64(F.lit(5), "id"), parts)).alias("p")).distinct()
    px, py = place.withColumnsRenamed({"id": "x", "p": "px"}), place.withColumnsRenamed({"id": "y", "p": "py"})
    placed = cut(found.join(px, "x").join(py, "y").select(F.struct(F.least("px", "py").alias("i"), F.greatest("px", "py").alias("j")).alias("c"), "x", "y").select("c.i", "c.j", "x", "y"))
    sent = placed.select("i", "j", F.explode(F.array("x", "y")).alias("id")).distinct().join(kept, "id")

    def met(pairs: pa.Table, lists: pa.Table) -> pa.Table:
        ids, first = np.unique(lists.column("id").to_numpy(), return_index=True)
        if not len(pairs):
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        values = lists.column("v").combine_chunks().take(pa.array(first))
        x, y = pairs.column("x").to_numpy(), pairs.column("y").to_numpy()
        return pa.table({"x": pa.array(x), "y": pa.array(y), "score": pa.array(count(values, np.searchsorted(ids, x), np.searchsorted(ids, y)).astype(np.float64))})

    return placed.groupBy("i", "j").cogroup(sent.select(F.col("i").alias("at_i"), F.col("j").alias("at_j"), "id", "v").groupBy("at_i", "at_j")).applyInArrow(met, "x long, y long, score double")


def jaccard(values: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the sets x and y, per cent."""
    start, n = values.offsets.to_numpy()[:-1].astype(np.int64), np.diff(values.offsets.to_numpy()).astype(np.int64)
    start -= start[0] if len(start) else 0
    codes = np.unique(values.flatten().to_numpy(), return_inverse=True)[1].ravel()
    mark, out = np.zeros(codes.max(initial=0) + 1, np.bool_), np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    first = np.append(_runs(x[order]), len(x))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = x[order[lo]]
        mark[mine := codes[start[own] : start[own] + n[own]]] = True
        for p in range(lo, hi, 1024):
            at = order[p : min(hi, p + 1024)]
            size = n[y[at]]
            ends = np.cumsum(size)
            hit = np.append(0, np.cumsum(mark[codes[np.repeat(start[y[at]] - ends + size, size) + np.arange(ends[-1])]]))
            out[at] = hit[ends] - hit[ends - size]
        mark[mine] = False
    return out * 100.0 / (n[x] + n[y] - out)


def equal_slots(values: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places the lists x and y, all of one length, are equal."""
    v = values.flatten().to_numpy().reshape(len(values), -1)
    return np.concatenate([(v[x[k : k + 8192]] == v[y[k : k + 8192]]).sum(1) for k in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): indexes of the rows of a cell to be compared, each pair of a bucket at least once; x and y broadcast against each other. A row may meet itself."""
    bucket, chunk = table.column("bucket").to_numpy(), table.column("chunk").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1))
    ends = np.append(starts[1:], len(order))
    if i == j:
        small = ends - starts <= SMALL
        end = np.repeat(np.where(small, ends, 0), ends - starts)
        count = np.maximum(end - np.arange(len(order)) - 1, 0)
        x = np.repeat(np.arange(len(order)), count)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        if len(x):
            yield order[x], order[y]
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        own = order[lo:hi]
        if i == j and hi - lo <= SMALL:
            continue
        left, right = (own, own) if i == j else (own[chunk[own] == i], own[chunk[own] == j])
        for r in range(0, len(left), TILE):
            for c in range(r if i == j else 0, len(right), TILE):
                yield left[r : r + TILE, None], right[None, c : c + TILE]


def agreeing(slots: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the slots (slot, row), 255 at most, are equal between rows x and y."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.uint8)
    for s in slots:
        out += s[x] == s[y]
    return out


def spread(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs under a mask, as two lists of indexes."""
    at = np.nonzero(mask)
    return np.broadcast_to(x, mask.shape)[at], np.broadcast_to(y, mask.shape)[at]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A part of the edges that connects the same nodes."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    kept = [(v, w) for v, w in sorted(set(zip(a.tolist(), b.tolist(), strict=True))) if (p := find(v)) != (q := find(w)) and (parent.update({q: p}) or True)]
    return [v for v, _ in kept], [w for _, w in kept]
