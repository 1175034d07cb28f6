"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from textloom.llm import decontaminate, near_dedup
from textloom.llm.common import stage, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    for name, function in P.STAGES:
        rows = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, function(spark, docs, sf), "stage")
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= set(rows)
        if name == "exact dedup":
            best = {}
            for i, t in rows.items():
                best.setdefault("".join((t or "").split(" ")).translate({c: None for c in (9, 10, 11, 12, 13)}), []).append((-len(t or ""), i))
            assert kept == {min(v)[1] for v in best.values()}
        elif name == "MinHash near-dedup":
            assert kept == {i for i, v in near_dedup.brute_force(list(rows.items())).items() if v[2]}
        elif name == "benchmark decontamination":
            assert kept == {i for i, v in decontaminate.brute_force(list(rows.items()), bench).items() if not v[4]}
        elif name == "best-fit packing":
            assert kept == set(rows)
        if name != "best-fit packing":
            assert out.columns == list(P.COLUMNS)
        docs = out


def odd_tables(spark, folder, rows):
    """Tables with extra columns of clashing names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("score", "norm", "dropped", "n_hit", "n_shingles", "__text")})
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k != 7), 0) for k in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    bench = spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(12))), (2, None), (None, "")], "item_id long, text string")
    bench.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


def test_odd_tables(spark, tmp_path):
    """Nulls, empty, white and very long texts, repeated rows, near copies, a benchmark passage, a null id and clashing columns."""
    say = lambda tag, n: " ".join(f"{tag}{k % 97}{tag}" for k in range(n))
    a, long = say("Some words ", 60), say("word ", 30_000)
    rows = [(1, a), (1, a), (2, a + "  "), (3, a + " more"), (4, None), (5, ""), (6, " \n"), (8, long), (9, "X " + " ".join(f"bench{k}" for k in range(12))), (None, say("other ", 40)), (10, say("last ", 50)), (10, say("last ", 50))]
    folder = f"file://{tmp_path}"
    odd_tables(spark, folder, [(i, t, None, None, None) for i, t in rows])
    out = P.run(spark, folder).collect()
    left = {r.doc_id for r in out}
    assert len({1, 2, 3} & left) == 1 and 8 in left and 9 not in left and 10 in left and None in left and len({4, 5, 6} & left) == 1
    assert len([r for r in out if r.doc_id == 10]) == 1 and len({(r.doc_id, r.piece) for r in out}) == len(out)
    odd_tables(spark, folder, [])
    assert P.run(spark, folder).count() == 0


def test_intermediates_go(spark, sf, tmp_path, monkeypatch):
    from textloom import staging

    monkeypatch.setattr(staging, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = P.run(spark, sf)
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["benchmark-decontamination", "pieces"] and out.count() > 0


def test_quality_stage_equals_brute_force(spark, sf):
    """The stage keeps what plain Python scores at the cut or above, from the same sample."""
    from textloom.llm import quality_knn as q

    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    labels = sorted({(r.doc_id, r.quality) for r in table(spark, sf, "labels").collect() if r.doc_id in docs and not q.held_out(r.doc_id)})
    scores = dict(zip(docs, q.brute_force([(docs[i], v) for i, v in labels], list(docs.values())), strict=True))
    kept = {r.doc_id for r in P.quality(spark, table(spark, sf, "documents"), sf).collect()}
    sure = {i for i, v in scores.items() if abs(v - q.CUT) > 1e-3}
    assert kept & sure == {i for i in sure if scores[i] >= q.CUT} and len(sure) > len(scores) * 0.95


def test_rejects_only_bad(spark, sf):
    docs = table(spark, sf, "documents")
    kept = P.quality(spark, docs, sf)
    labels = table(spark, sf, "labels").filter("quality = 1").select("doc_id").distinct()
    assert labels.join(kept, "doc_id", "left_anti").count() <= 0.02 * labels.count() + 1
    assert kept.agg(F.count("*")).first()[0] < docs.count()
