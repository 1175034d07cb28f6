"""Near-duplicate groups by HyperMinHash.

1. Each text becomes the set of its word shingles; equal sets are one class, with a number of its own and the row of its smallest doc_id to
   stand for it. A class keeps its compressed registers.
2. Bands of registers are keys. A key's members are tied to one of them, chosen afresh per key: linear in the members.
   Ties whose collision-corrected estimate is far below the threshold go; what stays connected is a family. Members of one key
   that are left in several families are compared with each other by their registers, in blocks, all pairs whose sizes can fit.
3. Families are cut into blocks of about BLOCK classes, or fewer whose sets hold about BLOCK_SHINGLES shingles together. Within a block all pairs are compared exactly, as products of
   incidence matrices of the full shingle sets. That settles every family of one block.
4. Larger families: the most central classes of their blocks, PIVOTS a family at most, meet every block and are compared exactly.
   Where that leaves several components, the family's sets meet in cells of two chunks of about SHINGLES shingles. Of a pair of two components
   only the shingles that another component has too can be shared; pairs for which these, the sizes and the registers allow a
   link are compared exactly, and once two components are linked they are not compared again. So loosely alike families, such as
   filled-in forms, ship each set once per chunk, and few of their pairs are looked at; cells give out no pairs but links that connect.
Links are confirmed by 100 * intersection >= 75 * union on full sets; components come by contraction.

Candidates: two texts of similarity s share none of the BANDS keys with chance (1 - s**ROWS)**BANDS, 5e-6 at 0.75. Two that share
one are compared, whoever else is in it; at 0.75 58 or more of 128 independent registers differ, an estimate below FLOOR, with chance
5e-7. Registers of small sets are borrowed, not independent: their estimates scatter more, and both chances are higher; the tests
measure how many pairs at the threshold both steps keep, by size.

Cases: a null, empty or blank text has no shingles and is linked with nothing. Fewer words than a shingle are one
shingle. A very long text costs what its set does, and is a block with few others. Rows that repeat a doc_id are members like any other, each by its own text, and name the
same component where their texts are linked; a null doc_id is in no class, its component is null and it is kept.
An empty table gives no rows. Other columns are not read; `keep` passes them through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import minhash as mh
from textloom.llm import textscan as ts
from textloom.llm.bloom import thin
from textloom.llm.common import fresh, passing, stage, table
from textloom.llm.components import components
from textloom.operators import cells

SHARE = 75
FLOOR = 0.55
#: Base of the size bins: above 100 / SHARE, so that sizes that fit are in one bin or in neighbours.
STEP = 1.34
BLOCK = 64
PIVOTS = 8
COLUMNS = 1 << 16
SHINGLES = 1 << 19
#: Shingles of a block's classes together, about; a longer text is a block with few others.
BLOCK_SHINGLES = 1 << 18


def signatures(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, name, n_shingles, set_id, registers): name is a hash of the text, set_id a 128-bit digest of the full set, null for an empty one."""

    def run(batches):
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(2))
            n, names, rows = [], [], []
            for i, j in ts.chunks(offsets):
                for s in mh.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    n.append(len(s))
                    names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    rows.append(mh.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "name", "n_shingles", "set_id", "registers"])

    own = F.col(f"`{text}`").cast("string")
    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("name"), own.alias("text")).mapInArrow(run, "doc_id long, name long, n_shingles long, set_id binary, registers binary")


def classes_of(marked: DataFrame) -> DataFrame:
    """(id, set_id, n_shingles, registers, doc_id, name) of every distinct set: id is a number of its own, doc_id and name tell the row that stands for it."""
    rows = marked.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.min(F.struct("doc_id", "name")).alias("row"))
    return stage(marked.sparkSession, rows.select(F.monotonically_increasing_id().alias("id"), "set_id", "n_shingles", "registers", "row.doc_id", "row.name"), "classes")


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, id): BANDS rows per class."""

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, mh.REGISTERS)
            keys = mh.band_keys(raw).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), mh.BANDS))], names=["key", "id"])

    return classes.select("id", "registers").mapInArrow(run, "key long, id long")


def keyed(bands: DataFrame) -> DataFrame:
    """(key, id, first, n): every member of a key of n with the one member that stands for the key, but that one itself."""
    first = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("h"), F.col("id").alias("id"))).alias("m"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("key", F.col("m.id").alias("first"), "n")
    return bands.join(first, "key").filter("id != first")


def ties(shared: DataFrame) -> DataFrame:
    """(a, b): every member of a key with the one that stands for it."""
    return shared.select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()


def likely(edges: DataFrame, classes: DataFrame, floor: float = FLOOR) -> DataFrame:
    """The ties whose estimated similarity is at least floor."""
    a = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("registers").alias("r"))
    b = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("registers").alias("s"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            r, s = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, mh.REGISTERS) for k in (4, 5))
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            # sizes alone can rule a link out
            fits = np.minimum(n, m) * 100 >= SHARE * np.maximum(n, m)
            ok = pa.array(fits & (mh.estimate(r, s, n, m) >= floor))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return edges.join(a, "a").join(b, "b").select("a", "b", "n", "m", "r", "s").mapInArrow(run, "a long, b long")


def _alike(table_: pa.Table) -> pa.Table:
    """Families of a cell that some pair of one bucket ties together: pairs of two labels whose sizes fit are all estimated."""
    label, n, side = (table_.column(k).to_numpy() for k in ("label", "n_shingles", "side"))
    raw = np.frombuffer(b"".join(table_.column("registers").to_pylist()), np.uint16).reshape(-1, mh.REGISTERS)
    slots = np.ascontiguousarray(raw.T)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in cells.pairs(table_):
        open_ = (label[x] != label[y]) & (side[x] + side[y] < 2) & (np.minimum(n[x], n[y]) * 100 >= SHARE * np.maximum(n[x], n[y]))
        if x.ndim == 1 or open_.mean() < 0.05:
            x, y = cells.spread(x, y, open_)
            open_ = np.ones(len(x), bool)
        # the correction only lowers an estimate
        x, y = cells.spread(x, y, open_ & (cells.agreeing(slots, x, y) >= FLOOR * mh.REGISTERS))
        if len(x):
            ok = mh.estimate(raw[x], raw[y], n[x], n[y]) >= FLOOR
            u, v = cells.forest(label[x[ok]], label[y[ok]])
            a.append(np.array(u, np.int64))
            b.append(np.array(v, np.int64))
    u, v = cells.forest(np.concatenate(a), np.concatenate(b))
    return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})


def untied(shared: DataFrame, family: DataFrame, classes: DataFrame, cell: int = cells.CELL) -> DataFrame:
    """(a, b): labels of families, or of classes without one, that a pair under one key ties together though no tie with the key's first member does.

    The first member has met its whole key. The others of a key that are not of one family are compared by their registers, all
    pairs whose sizes can fit: members in one size bin of base STEP, and those of the next bin as visitors (side 1).
    """
    spark = shared.sparkSession
    rest = shared.filter("n > 2").select("key", "id").join(family, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    rest = stage(spark, rest, "rest")
    apart = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    size = classes.select("id", "n_shingles")
    k = F.floor(F.log("n_shingles") / math.log(STEP))
    binned = rest.join(apart, "key").join(size, "id").select("id", "label", "n_shingles", "key", F.explode(F.array(F.struct(k.alias("k"), F.lit(0).alias("side")), F.struct((k - 1).alias("k"), F.lit(1).alias("side")))).alias("s"))
    binned = stage(spark, binned.select(F.xxhash64("key", "s.k").alias("bucket"), "id", "label", "n_shingles", "s.side"), "binned")
    open_ = binned.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("side").alias("side")).filter("lo < hi and side = 0").select("bucket")
    rows = stage(spark, binned.join(open_, "bucket").join(classes.select("id", "registers"), "id"), "open")
    return cells.compare(rows, _alike, "a long, b long", cell)


def families(candidates: DataFrame, shared: DataFrame, classes: DataFrame, cell: int = cells.CELL) -> DataFrame:
    """(id, label) of the classes that likely pairs connect."""
    spark = candidates.sparkSession
    family = stage(spark, components(candidates), "families")
    more = stage(spark, untied(shared, family, classes, cell), "untied")
    if not more.limit(1).count():
        return family
    whole = stage(spark, components(more), "wholes").select(F.col("id").alias("label"), F.col("label").alias("whole"))
    alone = whole.select(F.col("label").alias("id"), "label").join(family.select("id"), "id", "left_anti")
    return stage(spark, family.unionByName(alone).join(whole, "label", "left").select("id", F.coalesce("whole", "label").alias("label")), "families")


# ---- exact comparison within blocks -------------------------------------------------------------------------------------


def _sets(texts: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    data, offsets = ts.string_buffers(texts)
    out = []
    for i, j in ts.chunks(offsets):
        out += mh.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of sets[rows] with sets[cols]; memory is bounded by COLUMNS columns at a time."""
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    f, o = flat[order], own[order]
    first = np.ones(len(f), bool)
    first[1:] = f[1:] != f[:-1]
    number = np.cumsum(first) - 1
    count = np.bincount(number)
    multi = count > 1
    rename = np.cumsum(multi) - 1
    keep = multi[number]
    o, column = o[keep], rename[number[keep]]
    total = int(multi.sum())
    out = np.zeros((len(rows), len(cols)), np.float32)
    for c in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, total - c)), np.float32)
        m[o[lo:hi], column[lo:hi] - c] = 1
        out += m[rows] @ m[cols].T
    return out


def _linked(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, similarity) between two lists of sets."""
    size = np.array([len(s) for s in sets], np.float64)
    inner = shared_counts(sets, rows, cols).astype(np.float64)
    union = size[rows][:, None] + size[cols][None, :] - inner
    return inner * 100 >= SHARE * union, inner / union


def _local(table_: pa.Table) -> pa.Table:
    """All pairs of one block: each class's least connected id, and how central it is to its component."""
    ids = table_.column("id").to_numpy()
    order = np.argsort(ids)
    table_, ids = table_.take(pa.array(order)), ids[order]
    n = len(ids)
    every = np.arange(n)
    links, similar = _linked(_sets(table_.column("text")), every, every)
    label = every.copy()
    while True:
        least = np.where(links, label[None, :], n).min(1)
        least = np.minimum(least, label)
        least = least[least]
        if (least == label).all():
            break
        label = least
    same = label[:, None] == label[None, :]
    return pa.table({
        "family": table_.column("family"), "block": table_.column("block"), "id": pa.array(ids), "label": pa.array(ids[label]), "size": pa.array(same.sum(1)), "central": pa.array((similar * same).sum(1)),
    })


def _against(table_: pa.Table) -> pa.Table:
    """Links of a block's classes (side 0) with the classes that visit it (side 1): per visitor and component of the block, one."""
    side = table_.column("side").to_numpy()
    ids, labels = table_.column("id").to_numpy(), table_.column("label").to_numpy()
    rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = [], []
    if len(rows) and len(cols):
        links, _ = _linked(_sets(table_.column("text")), rows, cols)
        links &= labels[rows][:, None] != labels[cols][None, :]
        i, j = np.nonzero(links)
        pairs = {(int(labels[rows[x]]), int(labels[cols[y]])): (int(ids[rows[x]]), int(ids[cols[y]])) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
        a, b = [p[0] for p in pairs.values()], [p[1] for p in pairs.values()]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _visits(members: DataFrame, visitors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links between visitors (family, id, label, text), a few a family, and the members (family, block, id, label, text) of every block of their family."""
    here = members.join(visitors.select("family").distinct(), "family").select("family", "block", "id", "label", "text", F.lit(0).alias("side"))
    there = visitors.join(blocks, "family").select("family", "block", "id", "label", "text", F.lit(1).alias("side"))
    return here.unionByName(there).groupBy("family", "block").applyInArrow(_against, "a long, b long")


# ---- exact comparison across the components of a family -----------------------------------------------------------------


def _shingled(batches):
    for batch in batches:
        sets = _sets(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["bucket", "id", "label", "n_shingles", "shingles"])


def _open(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """How many shingles of each set another label of the cell has too."""
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    of = label[own[order]]
    several = np.minimum.reduceat(of, head) < np.maximum.reduceat(of, head)
    return np.bincount(own[order][np.repeat(several, np.diff(np.append(head, len(flat))))], minlength=len(sets))


def _across(table_: pa.Table) -> pa.Table:
    """Links of a cell between components of one family, as many as connect what is linked. Pairs whose sizes, open shingles and registers allow a link are compared exactly."""
    ids, label, n = (table_.column(k).to_numpy() for k in ("id", "label", "n_shingles"))
    raw = np.frombuffer(b"".join(table_.column("registers").to_pylist()), np.uint16).reshape(-1, mh.REGISTERS)
    slots = np.ascontiguousarray(raw.T)
    sets = [np.frombuffer(x, np.uint64) for x in table_.column("shingles").to_pylist()]
    common = _open(sets, label)
    parent = {v: v for v in np.unique(label).tolist()}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    a, b = [], []
    for x, y in cells.pairs(table_):
        most = np.minimum(common[x], common[y])  # what two components can share at most
        open_ = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= SHARE * np.maximum(n[x], n[y])) & (most * 100 >= SHARE * (n[x] + n[y] - most))
        x, y = cells.spread(x, y, open_)
        keep = cells.agreeing(slots, x, y) >= FLOOR * mh.REGISTERS
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        starts = np.flatnonzero(np.diff(x, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            i, root = int(x[lo]), find(int(label[x[lo]]))
            others = [j for j in y[lo:hi].tolist() if find(int(label[j])) != root]
            if not others:
                continue
            every = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            both = np.bincount(np.repeat(np.arange(len(others)), n[others])[sets[i][at] == every], minlength=len(others))
            for k in np.flatnonzero(both * 100 >= SHARE * (n[i] + n[others] - both)).tolist():
                p, q = find(int(label[i])), find(int(label[others[k]]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(int(ids[i]))
                    b.append(int(ids[others[k]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def across(labelled: DataFrame, classes: DataFrame, cell: int = SHINGLES) -> DataFrame:
    """(a, b): links between classes of one family (family, id, label, text) that connect all labels between which there is a link."""
    sets = labelled.select("family", "id", "label", "text").mapInArrow(_shingled, "bucket long, id long, label long, n_shingles long, shingles binary")
    rows = stage(labelled.sparkSession, sets.join(classes.select("id", "registers"), "id"), "sets")
    return cells.compare(rows, _across, "a long, b long", cell, "n_shingles")


def link_families(family: DataFrame, classes: DataFrame, documents: DataFrame, doc_id: str, text: str, block: int = BLOCK, pivots: int = PIVOTS, weight: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, label) of the classes in families: the least id of the component of exact links. A block has about `block` classes, or fewer that have about `weight` shingles."""
    spark = documents.sparkSession
    sizes = family.join(classes.select("id", "n_shingles"), "id").groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / weight)).alias("blocks"))
    dealt = family.join(sizes, "label").select(F.col("label").alias("family"), "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    dealt = stage(spark, dealt.join(classes.select("id", F.col("doc_id").alias("row"), "name"), "id"), "dealt")
    own = F.col(f"`{text}`").cast("string")
    texts = documents.select(F.col(f"`{doc_id}`").cast("long").alias("row"), own.alias("text"))
    texts = thin(texts, "row", dealt, "row", dealt.count()).withColumn("name", F.xxhash64("text"))  # else the join would shuffle every text
    members = stage(spark, texts.join(dealt, ["row", "name"]).groupBy("family", "blocks", "block", "id").agg(F.min("text").alias("text")), "members")
    local = stage(spark, members.select("family", "block", "id", "text").groupBy("family", "block").applyInArrow(_local, "family long, block long, id long, label long, size long, central double"), "local")
    several = stage(spark, members.filter("blocks > 1").select("family", "block", "id", "text").join(local.select("id", "label", "size", "central"), "id"), "several")
    single = local.select("id", "label")
    if not several.limit(1).count():
        return single
    blocks = several.select("family", "block").distinct()
    within = several.select(F.col("id").alias("a"), F.col("label").alias("b"))
    # the most central classes of the largest local components
    rank = F.struct("size", "central", "id", "label")
    best = several.groupBy("family", F.pmod(F.xxhash64(F.lit(1), "label"), F.lit(pivots)).alias("slot")).agg(F.max(rank).alias("top")).select("family", F.col("top.id").alias("id"))
    pivot = several.join(best.select("id"), "id", "left_semi").select("family", "id", "label", "text")
    links = stage(spark, within.unionByName(_visits(several, pivot, blocks)), "links")
    joined = stage(spark, components(links), "joined")
    labelled = several.drop("label").join(joined, "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = stage(spark, labelled.select("family", "id", "label", "text"), "labelled")
    apart = labelled.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("family")
    more = stage(spark, links.unionByName(across(labelled.join(apart, "family"), classes)), "more")
    final = components(more)
    return single.join(final.withColumnRenamed("label", "whole"), "id", "left").select("id", F.coalesce("whole", "label").alias("label"))


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, pivots: int = PIVOTS, weight: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = documents.sparkSession
    with passing(spark) as kept:
        marked = stage(spark, signatures(documents, doc_id, text), "signatures")
        classes = classes_of(marked)
        shared = stage(spark, keyed(band_rows(classes)), "shared")
        candidates = stage(spark, likely(ties(shared), classes), "candidates")
        family = families(candidates, shared, classes)
        linked = stage(spark, link_families(family, classes, documents, doc_id, text, block, pivots, weight), "linked")
        kept += [marked, classes, linked]
    # a component is named by the smallest doc_id of its classes
    label = classes.select("set_id", "id", "doc_id").join(linked, "id", "left").select("set_id", "doc_id", F.coalesce("label", "id").alias("label"))
    least = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = marked.select("doc_id", "n_shingles", "set_id").join(label.drop("doc_id").join(least, "label").drop("label"), "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns; a null doc_id stays, and rows that repeat a doc_id stay if one of them does."""
    marked = groups(documents, doc_id, text)
    name = fresh(documents, "dropped")
    drop = marked.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("doc_id").alias(name))
    return documents.join(drop, F.col(f"`{doc_id}`") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def brute_force(documents: list[tuple]) -> dict:
    """doc_id: (n_shingles, component_id, kept), from plain Python on a small list of (id, text)."""
    import re

    sets = {}
    for i, t in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    index: dict = {}
    for i in ids:
        near: dict = {}
        for s in sets[i]:
            for j in index.setdefault(s, []):
                near[j] = near.get(j, 0) + 1
            index[s].append(i)
        for j, n in near.items():
            if 100 * n >= SHARE * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
