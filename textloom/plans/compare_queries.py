"""Queries that compare, merge and deduplicate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import dedup as D
from textloom.operators import joins as J
from textloom.operators import lines as L
from textloom.plans.catalog import load, query
from textloom.plans.text_queries import ARR, BLANK, BLINES, LINES, STRIP, WORDS, all_lines, docs

T = "coalesce(text, '')"


def bench_lines(spark, d):
    return L.lines(load(spark, d, "benchmark"), "item_id")


@query("join_antiset_lines", f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM {LINES} WHERE line NOT IN (SELECT line FROM {BLINES})")
def _(spark, d):
    return J.minus_bag(all_lines(spark, d), bench_lines(spark, d), "line").select("doc_id", "pos", "line")


@query("join_semiset_lines", f"SELECT line, min((doc_id, pos))[1] AS doc_id FROM {LINES} WHERE line IN (SELECT line FROM {BLINES}) GROUP BY line")
def _(spark, d):
    return J.common(bench_lines(spark, d), all_lines(spark, d), "line", "doc_id", "pos").select("line", "first.doc_id")


@query("contamination_line_overlap", f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE line IN (SELECT line FROM {BLINES}) GROUP BY doc_id")
def _(spark, d):
    return all_lines(spark, d).join(bench_lines(spark, d).select("line").distinct(), "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


HALVES = f"a AS (SELECT doc_id AS k, sha256({T}) AS h, length({T}) AS n FROM documents), b AS (SELECT item_id AS k, sha256({T}) AS h, length({T}) AS n FROM benchmark)"


def halves(spark, d):
    t = F.coalesce("text", F.lit(""))
    one = lambda df, k: df.select(F.col(k).alias("k"), F.sha2(t, 256).alias("h"), F.char_length(t).cast("long").alias("n"))
    return one(docs(spark, d), "doc_id"), one(load(spark, d, "benchmark"), "item_id")


@query(
    "join_full_outer_diff",
    f"WITH {HALVES} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k",
)
def _(spark, d):
    return J.compare(*halves(spark, d), "k", "h")


@query("join_inner_common_names", f"WITH {HALVES} SELECT a.k, a.n = b.n AS same_size FROM a JOIN b ON a.k = b.k")
def _(spark, d):
    a, b = halves(spark, d)
    return a.join(b.select("k", F.col("n").alias("m")), "k").select("k", (F.col("n") == F.col("m")).alias("same_size"))


THREE = f"x AS (SELECT DISTINCT line FROM {LINES}), y AS (SELECT DISTINCT line FROM {BLINES})"


@query("join_lines_three_way", f"WITH {THREE} SELECT count(*) FILTER (WHERE y.line IS NULL) AS only_first, count(*) FILTER (WHERE x.line IS NULL) AS only_second, count(*) FILTER (WHERE x.line = y.line) AS both FROM x FULL JOIN y ON x.line = y.line")
def _(spark, d):
    x, y = all_lines(spark, d).select("line").distinct(), bench_lines(spark, d).select("line").distinct()
    a = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), "line", "full_outer")
    return a.agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


BWORDS = WORDS.replace("FROM documents", "FROM (SELECT item_id AS doc_id, NULL AS lang, text FROM benchmark)")


@query("join_name_conflict", f"SELECT word AS name, count(*) AS cnt FROM {WORDS} WHERE word IN (SELECT word FROM {BWORDS}) GROUP BY word HAVING count(*) > 1")
def _(spark, d):
    c = L.counts(L.words(docs(spark, d)), "word").filter("cnt > 1").withColumnRenamed("word", "name")
    return c.join(L.words(load(spark, d, "benchmark"), "alpha", "item_id").select(F.col("word").alias("name")).distinct(), "name", "left_semi")


@query("join_stem_pair", "SELECT DISTINCT regexp_replace(url, '[?].*$', '') AS stem FROM pages WHERE url LIKE '%?%' AND regexp_replace(url, '[?].*$', '') IN (SELECT url FROM pages)")
def _(spark, d):
    p = load(spark, d, "pages").select("url")
    stem = p.filter(F.col("url").contains("?")).select(F.regexp_replace("url", r"[?].*$", "").alias("stem")).distinct()
    return stem.join(p.select(F.col("url").alias("stem")).distinct(), "stem", "left_semi")


VOCAB = f"(SELECT word FROM {WORDS} GROUP BY word HAVING count(DISTINCT doc_id) >= 20)"


@query("join_dictionary_lookup", f"SELECT doc_id, count(*) AS n, count(v.word) AS known FROM {WORDS} w LEFT JOIN {VOCAB} v USING (word) GROUP BY doc_id")
def _(spark, d):
    w = L.words(docs(spark, d))
    vocab = w.select("word", "doc_id").distinct().groupBy("word").agg(F.count("*").alias("n")).filter("n >= 20").select("word", F.lit(1).alias("in"))
    per = w.groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    return per.join(vocab, "word", "left").groupBy("doc_id").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("in") == 1, F.col("c"))), F.lit(0)).alias("known"))


@query("join_cache_lookup", "SELECT o_orderkey, s_name, s_suppkey IS NOT NULL AS hit FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey")
def _(spark, d):
    cache = load(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"), "s_name")
    return load(spark, d, "orders").select("o_orderkey", "o_custkey").join(cache, "o_custkey", "left").select("o_orderkey", "s_name", F.col("s_name").isNotNull().alias("hit"))


@query("join_defs_vs_uses", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def _(spark, d):
    uses = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, d, "part").select("p_partkey").join(uses, "p_partkey", "left_anti")


@query("join_orphan_files", "SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'item', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    l = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return o.join(l, "id", "left_anti").select(F.lit("order").alias("kind"), "id").unionByName(l.join(o, "id", "left_anti").select(F.lit("item").alias("kind"), "id"))


@query(
    "join_length_band",
    "SELECT a.s_suppkey AS a, b.p_partkey AS b FROM supplier a JOIN part b ON substr(a.s_name, -2) = substr(b.p_name, -2) AND length(b.p_name) BETWEEN ceil(length(a.s_name) * 4 / 5.0) AND floor(length(a.s_name) * 5 / 4.0)",
)
def _(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.substring("s_name", -2, 2).alias("t"), F.char_length("s_name").alias("n"))
    b = load(spark, d, "part").select(F.col("p_partkey").alias("b"), F.substring("p_name", -2, 2).alias("t"), F.char_length("p_name").alias("m"))
    band = a.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * 4 / 5).cast("int"), F.floor(F.col("n") * 5 / 4).cast("int"))))
    return band.join(b, ["t", "m"]).select("a", "b")


PATHS = "(SELECT DISTINCT rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS p FROM pages)"


def page_paths(spark, d):
    return load(spark, d, "pages").select(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/+$", "").alias("p"))


@query("join_prefix_containment", f"SELECT p FROM (SELECT p, string_split(p, '/')[1:2] AS k FROM {PATHS}) x WHERE NOT EXISTS (SELECT 1 FROM {PATHS} y WHERE y.p <> x.p AND starts_with(x.p, y.p || '/'))")
def _(spark, d):
    return J.prune_descendants(page_paths(spark, d), "p")


MAPS = "a AS (SELECT c_custkey AS k, c_name AS v FROM customer), b AS (SELECT s_suppkey AS k, s_name AS v FROM supplier)"


def maps(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))


@query("join_merge_shallow", f"WITH {MAPS} SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v FROM a FULL JOIN b ON a.k = b.k")
def _(spark, d):
    return J.merge_right(*maps(spark, d), "k", "v")


DEEP = f"""WITH {MAPS}, l AS (SELECT k, '{{"id":' || k || ',"name":"' || v || '","in":{{"at":{{"left":' || k || ',"both":"l"}},"tags":["a"]}},"flat":{{"x":1}}}}' AS j FROM a),
r AS (SELECT k, '{{"name":"' || v || '","in":{{"at":{{"both":"r","right":[1,{{"y":2}}],"more":{{"z":{{}}}}}},"tags":["b","c"]}},"flat":7}}' AS j FROM b)
SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN CAST(json_merge_patch(l.j, r.j) AS VARCHAR) ELSE coalesce(l.j, r.j) END AS j FROM l FULL JOIN r ON l.k = r.k"""


@query("join_merge_deep", DEEP)
def _(spark, d):
    a, b = maps(spark, d)
    left = F.concat(F.lit('{"id":'), F.col("k").cast("string"), F.lit(',"name":"'), "v", F.lit('","in":{"at":{"left":'), F.col("k").cast("string"), F.lit(',"both":"l"},"tags":["a"]},"flat":{"x":1}}'))
    right = F.concat(F.lit('{"name":"'), "v", F.lit('","in":{"at":{"both":"r","right":[1,{"y":2}],"more":{"z":{}}},"tags":["b","c"]},"flat":7}'))
    return J.merge_deep(a.select("k", left.alias("j")), b.select("k", right.alias("j")), "k", "j")


@query("join_merge_conflicts", f"WITH {MAPS}, u AS (SELECT k, v, 0 AS n FROM a UNION ALL SELECT k, v, 1 FROM b) SELECT k AS key, count(*) AS cnt, count(DISTINCT v) AS vals, arg_min(v, n) AS first FROM u GROUP BY k HAVING count(*) > 1")
def _(spark, d):
    a, b = maps(spark, d)
    return J.conflicts({"a": a, "b": b}, "k", "v")


@query("sink_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    updates = load(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return J.upsert(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), updates, "c_custkey")


@query("sink_insert_or_replace", "SELECT p_partkey, coalesce(s_name, p_name) AS p_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)")
def _(spark, d):
    return J.upsert(load(spark, d, "part").select("p_partkey", "p_name"), load(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_name")), "p_partkey")


# ---- sets ----


@query("set_union_distinct", f"SELECT line FROM {LINES} UNION SELECT line FROM {BLINES}")
def _(spark, d):
    return all_lines(spark, d).select("line").union(bench_lines(spark, d).select("line")).distinct()


@query("set_union_all", f"SELECT doc_id AS id, line, NULL::BIGINT AS item FROM {LINES} UNION ALL SELECT NULL, line, item_id FROM {BLINES}")
def _(spark, d):
    return all_lines(spark, d).select(F.col("doc_id").alias("id"), "line").unionByName(bench_lines(spark, d).select("line", F.col("item_id").alias("item")), allowMissingColumns=True)


@query("set_intersect", f"SELECT line FROM {LINES} INTERSECT SELECT line FROM {BLINES}")
def _(spark, d):
    return all_lines(spark, d).select("line").intersect(bench_lines(spark, d).select("line"))


@query("set_difference", f"SELECT line FROM {LINES} EXCEPT SELECT line FROM {BLINES}")
def _(spark, d):
    return all_lines(spark, d).select("line").subtract(bench_lines(spark, d).select("line"))


@query("set_symdiff", f"WITH {THREE} SELECT coalesce(x.line, y.line) AS line, x.line IS NOT NULL AS in_first FROM x FULL JOIN y ON x.line = y.line WHERE x.line IS NULL OR y.line IS NULL")
def _(spark, d):
    x, y = all_lines(spark, d).select("line").distinct(), bench_lines(spark, d).select("line").distinct()
    return x.join(y, "line", "left_anti").select("line", F.lit(True).alias("in_first")).unionByName(y.join(x, "line", "left_anti").select("line", F.lit(False).alias("in_first")))


# ---- dedup ----


@query("dedup_sort_uniq", f"SELECT DISTINCT {STRIP.format('line')} AS line FROM {LINES} WHERE NOT {BLANK.format('line')}")
def _(spark, d):
    return all_lines(spark, d).select(L.strip(F.col("line")).alias("line")).filter("line <> ''").distinct().sort("line")


@query("dedup_keep_first", f"SELECT line, min((doc_id, pos))[1] AS doc_id, CAST(min((doc_id, pos))[2] AS INT) AS pos FROM {LINES} GROUP BY line")
def _(spark, d):
    return D.first_by(all_lines(spark, d), "line", "doc_id", "pos")


@query(
    "dedup_adjacent",
    f"""WITH l AS (SELECT doc_id, pos, line, pos - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS g FROM {LINES}),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, g ORDER BY pos) AS k FROM l)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS text FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT * FROM r WHERE line = '' OR k % 2 = 1) USING (doc_id) GROUP BY doc_id""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(D.adjacent(L.split_lines(F.col("text"))), "\n").alias("text"))


@query("dedup_json_by_key", "SELECT user_id, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY user_id")
def _(spark, d):
    return D.first_by(load(spark, d, "events").select("user_id", "event_id", "props"), "user_id", "event_id")


@query("dedup_quotes", f"SELECT lower(trim(line)) AS k, min((lower(source), doc_id, pos))[1] AS author FROM {LINES} WHERE line <> '' GROUP BY 1")
def _(spark, d):
    q = all_lines(spark, d, "source").filter("line <> ''").select(F.lower(F.trim("line")).alias("k"), F.lower("source").alias("author"), "doc_id", "pos")
    return D.first_by(q, "k", "author", "doc_id", "pos").select("k", "author")


@query("dedup_css_rules", "SELECT p_brand AS selector, arg_max(p_name, p_partkey) AS body, min(p_partkey) AS first FROM part GROUP BY p_brand")
def _(spark, d):
    return load(spark, d, "part").groupBy(F.col("p_brand").alias("selector")).agg(F.max_by("p_name", "p_partkey").alias("body"), F.min("p_partkey").alias("first"))


@query("dedup_exact_hash", f"SELECT sha256({T}) AS digest, count(*) AS cnt, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return D.groups(docs(spark, d), F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id")


@query("dedup_exact_tiered", f"SELECT doc_id, sha256({T}) AS digest FROM documents WHERE sha256({T}) IN (SELECT sha256({T}) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):
    return D.tiered(docs(spark, d), "doc_id", "text")


@query("dedup_keep_policy", f"SELECT sha256({T}) AS digest, arg_min(doc_id, (n_chars, source, doc_id)) AS doc_id FROM documents GROUP BY 1")
def _(spark, d):
    x = docs(spark, d).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "n_chars", "source", "doc_id")
    return D.first_by(x, "digest", "n_chars", "source", "doc_id").select("digest", "doc_id")


@query("dedup_incremental_cache", f"SELECT doc_id, sha256({T}) AS digest, doc_id IN (SELECT doc_id FROM labels) AS cached FROM documents")
def _(spark, d):
    x = docs(spark, d).select("doc_id", F.col("n_chars").alias("size"), F.coalesce("text", F.lit("")).alias("t"))
    cache = x.join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "size", F.sha2("t", 256).alias("known"))
    return x.join(cache, ["doc_id", "size"], "left").select("doc_id", F.coalesce("known", F.sha2("t", 256)).alias("digest"), F.col("known").isNotNull().alias("cached"))


@query("dedup_dir_signature", f"SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS signature, count(*) AS files FROM (SELECT source, CAST(doc_id AS VARCHAR) || ':' || sha256({T}) AS h FROM documents) GROUP BY source")
def _(spark, d):
    """A folder's signature: the digest of all its files' names and digests, sorted."""
    x = docs(spark, d).select("source", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    return D.signatures(x, "source", "h")


@query("dedup_block", rf"WITH b AS (SELECT doc_id, a[i] || chr(10) || a[i + 1] AS block FROM (SELECT doc_id, a, unnest(range(1, len(a))) AS i FROM (SELECT doc_id, {ARR} AS a FROM documents))) SELECT block, count(DISTINCT doc_id) AS docs FROM b WHERE length(block) >= 10 GROUP BY block HAVING count(DISTINCT doc_id) > 1")
def _(spark, d):
    pairs = F.transform(F.filter(L.neighbours(L.split_lines(F.col("text"))), lambda p: p["next"].isNotNull()), lambda p: F.concat_ws("\n", p["line"], p["next"]))
    b = docs(spark, d).select("doc_id", F.explode(F.array_distinct(pairs)).alias("block")).filter(F.char_length("block") >= 10)
    return b.groupBy("block").agg(F.count("*").alias("docs")).filter("docs > 1")
