"""Queries over table containers, listings, similarity and clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import lexing as X
from textloom.functions import strings as ST
from textloom.operators import lines as L
from textloom.operators import similarity as S
from textloom.sources import files as FI
from textloom.sources import tables as TB
from textloom.plans.catalog import load, query
from textloom.plans.text_queries import LINES, all_lines, docs
from textloom.staging import new_path as scratch
from textloom.staging import stage as staged

TX = "coalesce(text, '')"


# ---- containers ----


@query("scan_csv_header", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(spark, d):
    path = scratch(spark, "csv")
    TB.write_csv(load(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), path)
    return TB.read_csv(spark, path)


@query("sink_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, '[\"' || c_mktsegment || '\"]' AS tags FROM customer")
def _(spark, d):
    path = scratch(spark, "csv")
    TB.write_csv(load(spark, d, "customer").select("c_custkey", "c_name", F.array("c_mktsegment").alias("tags")), path)
    return TB.read_csv(spark, path)


NINE = "s_suppkey, s_name, 'http://x/' || s_suppkey AS url, 'n' || s_nationkey AS country, ['a' || s_nationkey, 'b'] AS languages, s_nationkey % 2 = 0 AS subscription"


@query("scan_delimited_typed", f"SELECT {NINE} FROM supplier")
def _(spark, d):
    s = load(spark, d, "supplier")
    raw = s.select(F.concat_ws("||", F.col("s_suppkey").cast("string"), "s_name", F.concat(F.lit("http://x/"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("a"), F.col("s_nationkey"), F.lit(", b")), (F.col("s_nationkey") % 2 == 0).cast("string"), F.lit("c"), F.lit("d"), F.lit("e")).alias("value"))
    p = raw.select(F.split("value", r"\|\|").alias("p")).filter(F.size("p") == 9)
    g = lambda k: F.get("p", F.lit(k))
    return p.select(
        F.expr("try_cast(get(p, 0) as long)").alias("s_suppkey"), g(1).alias("s_name"), g(2).alias("url"), g(3).alias("country"), F.transform(F.split(g(4), ","), lambda x: F.trim(x)).alias("languages"), F.expr("try_cast(get(p, 5) as boolean)").alias("subscription")
    )


@query("scan_json", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = scratch(spark, "json")
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    n.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nation"))).alias("value")).write.text(path)  # 25 rows
    return TB.read_json(spark, path)["nation"].select("n_nationkey", "n_name")


@query("sink_json", "SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS value FROM region")
def _(spark, d):
    r = load(spark, d, "region").select("r_regionkey", "r_name")  # five rows make one array
    return r.groupBy().agg(F.to_json(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))


@query("scan_jsonl", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type NOT IN ('error', 'signup')")
def _(spark, d):
    path = scratch(spark, "jsonl")
    e = load(spark, d, "events")
    good = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    e.select(F.when(F.col("event_type") == "signup", F.lit("   ")).when(F.col("event_type") == "error", F.lit('{"event_id": broken')).otherwise(good).alias("value")).write.text(path)
    return TB.read_jsonl(spark, path, "event_id long, k long")


@query("sink_jsonl", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    path = scratch(spark, "jsonl")
    load(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.json(path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(path)


@query("udf_registry_loader", "SELECT unnest(['csv', 'json', 'jsonl', 'parquet']) AS format, count(*) AS rows FROM nation GROUP BY 1")
def _(spark, d):
    """One table through every registered pair of writer and reader."""
    n, out = load(spark, d, "nation").select("n_nationkey", "n_name"), None
    for name, (write, read) in TB.FORMATS.items():
        path = scratch(spark, name)
        write(n, path)
        one = read(spark, path, n.schema).agg(F.count("*").alias("rows")).select(F.lit(name).alias("format"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_jsonl_keyed", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = load(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("m")).select("conv_id", "m.*")


@query("sink_sql_dump", "SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' AS value FROM nation")
def _(spark, d):
    return TB.insert_lines(load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")


@query("scan_sql_dump", "SELECT 'part' AS \"table\", p_partkey, p_name || ' it''s; (x)' AS p_name FROM part")
def _(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" it's; (x)")).alias("p_name"))
    # a dump text of about a hundred statements, as many as that takes
    groups = F.lit(p.count() // 100 + 1)
    texts = TB.insert_lines(p, "part").withColumn("g", F.pmod(F.xxhash64("value"), groups)).groupBy("g").agg(F.array_join(F.collect_list("value"), "\n").alias("text"))
    r = TB.parse_dumps(texts)
    return r.select("table", F.from_json("row", "p_partkey long, p_name string").alias("r")).select("table", "r.*")


@query("scan_sql_dump_stream", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_name")
    r = TB.parse_dumps(TB.insert_lines(s, "supplier").withColumnRenamed("value", "text"))
    return r.select(F.from_json("row", "s_suppkey long, s_name string").alias("r")).select("r.*")


@query("scan_sqlite", "SELECT 'nation' AS \"table\", CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{"n_nationkey": int(a), "n_name": b} for a, b in zip(pdf.n_nationkey, pdf.n_name, strict=True)]
        return pd.DataFrame({"content": [TB.sqlite_bytes({"nation": rows})]})

    def read(batches):
        for pdf in batches:
            for c in pdf.content:
                rows = [(t, r["n_nationkey"], r["n_name"]) for t, r in TB.sqlite_rows(c)]
                yield pd.DataFrame(rows, columns=["table", "n_nationkey", "n_name"])

    return n.groupBy("n_regionkey").applyInPandas(write, "content binary").mapInPandas(read, "table string, n_nationkey long, n_name string")


@query("sink_sqlite", "SELECT r_regionkey % 2 AS half, count(*) AS rows FROM region GROUP BY 1")
def _(spark, d):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        c = TB.sqlite_bytes({"region": [{"k": int(k), "name": n} for k, n in zip(pdf.r_regionkey, pdf.r_name, strict=True)]})
        return pd.DataFrame({"half": pdf.half[:1].astype("int32"), "rows": [len(list(TB.sqlite_rows(c)))]})

    r = load(spark, d, "region").withColumn("half", F.pmod("r_regionkey", F.lit(2)).cast("int"))
    return r.groupBy("half").applyInPandas(write, "half int, rows long")


@query("scan_magic_rules", "SELECT r_name AS section, n_name AS rule, CAST(n_nationkey AS INT) AS off FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    rows = r.select("r_regionkey", F.lit(-1).alias("k"), F.concat(F.lit("["), "r_name", F.lit("]")).alias("line")).unionByName(n.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("k"), F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), "n_name").alias("line")))
    w = Window.partitionBy("r_regionkey").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one file, here one a region
    f = rows.withColumn("section", F.last(F.when(F.col("line").startswith("["), F.regexp_extract("line", r"^\[(.*)\]$", 1)), True).over(w))
    return f.filter(~F.col("line").startswith("[")).select("section", F.regexp_extract("line", "^[0-9]+ (.*)$", 1).alias("rule"), F.regexp_extract("line", "^([0-9]+)", 1).cast("int").alias("off"))


@query("win_section_ffill", f"SELECT doc_id, CAST(pos AS INT) AS pos, section FROM (SELECT doc_id, pos, last_value(CASE WHEN line LIKE 'The%' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM {LINES}) WHERE section IS NOT NULL")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return all_lines(spark, d).select("doc_id", "pos", F.last(F.when(F.col("line").startswith("The"), F.col("line")), True).over(w).alias("section")).filter("section is not null")


@query("scan_markdown_sections", "SELECT p_name AS name, p_brand AS code, 'type ' || p_type AS what FROM part")
def _(spark, d):
    p = load(spark, d, "part")
    md = p.select(F.concat(F.lit("# "), "p_name", F.lit(" ("), "p_brand", F.lit(")\n\n## What it does\ntype "), "p_type", F.lit("\n\n## Example\nnone\n")).alias("t"))
    return md.select(F.regexp_extract("t", r"(?m)^# (.*) \(([^)]*)\)$", 1).alias("name"), F.regexp_extract("t", r"(?m)^# (.*) \(([^)]*)\)$", 2).alias("code"), F.regexp_extract("t", r"(?m)^## What it does\n(.*)$", 1).alias("what"))


@query("scan_markdown_fences", "SELECT p_partkey, unnest(['sql', 'py']) AS lang, unnest(['select ' || p_partkey, p_name]) AS code FROM part")
def _(spark, d):
    p = load(spark, d, "part")
    md = p.select("p_partkey", F.concat(F.lit("text\n```sql\nselect "), F.col("p_partkey").cast("string"), F.lit("\n```\nmore\n```py\n"), "p_name", F.lit("\n```\n")).alias("t"))
    fence = F.lit(r"(?s)```([a-z]+)\n(.*?)\n```")
    both = F.arrays_zip(F.regexp_extract_all("t", fence, F.lit(1)).alias("lang"), F.regexp_extract_all("t", fence, F.lit(2)).alias("code"))
    return md.select("p_partkey", F.inline(both))


@query("scan_chat_export", "SELECT conv_id, string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), F.coalesce(x["text"], F.lit("")))), "\n").alias("markdown"))


@query("scan_pip_freeze", "SELECT p_name AS name, '1.' || p_size AS version FROM part")
def _(spark, d):
    v = load(spark, d, "part").select(F.concat("p_name", F.lit("==1."), F.col("p_size").cast("string")).alias("v"))
    return v.select(F.split_part("v", F.lit("=="), F.lit(1)).alias("name"), F.split_part("v", F.lit("=="), F.lit(2)).alias("version"))


@query("scan_xml_mime", "SELECT p_partkey, 'type/' || p_size AS mime, unnest(['a' || p_size, 'b']) AS ext FROM part")
def _(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat(F.lit('<mime-type><type>type/'), "p_size", F.lit("</type><glob>a"), "p_size", F.lit("</glob><glob>b</glob></mime-type>")).alias("x"))
    return p.select("p_partkey", F.from_xml("x", "type string, glob array<string>").alias("m")).select("p_partkey", F.col("m.type").alias("mime"), F.explode("m.glob").alias("ext"))


@query("scan_html_entry", "SELECT p_name AS word, 'n.' AS part_of_speech, p_type || chr(10) || p_brand AS senses, CAST(p_size AS VARCHAR) AS quotes FROM part")
def _(spark, d):
    """Senses and quotes are given with a line each."""
    entry = F.concat(F.lit("<h1>"), "p_name", F.lit("</h1><pos>n.</pos><def>"), "p_type", F.lit("</def><def>"), "p_brand", F.lit("</def><q>"), F.col("p_size").cast("string"), F.lit("</q>"))
    grab = lambda tag: F.regexp_extract_all("e", F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1))
    return load(spark, d, "part").select(entry.alias("e")).select(F.get(grab("h1"), F.lit(0)).alias("word"), F.get(grab("pos"), F.lit(0)).alias("part_of_speech"), F.array_join(grab("def"), "\n").alias("senses"), F.array_join(grab("q"), "\n").alias("quotes"))


@query("scan_archive_members", f"SELECT 'src' || (doc_id % 8) AS path, doc_id || '.txt' AS member, strlen({TX}) AS size FROM documents")
def _(spark, d):
    def zipped(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, t in zip(pdf.doc_id, pdf.text, strict=True):
                z.writestr(f"{i}.txt", t or "")
        return pd.DataFrame({"path": pdf.path[:1], "content": [out.getvalue()]})

    # archives of a bounded number of documents each
    x = docs(spark, d).select("doc_id", "text", F.concat(F.lit("src"), F.pmod("doc_id", F.lit(8))).alias("path"), F.floor(F.col("doc_id") / 512).alias("g"))
    archives = x.groupBy("path", "g").applyInPandas(zipped, "path string, content binary")
    return FI.archive_members(archives).select("path", "member", F.length("data").cast("long").alias("size"))


# ---- listings ----


@query("scan_dir_walk")
def _(spark, d):
    return FI.listing(spark, d, "*.parquet").select("name", "length")


@query("scan_dir_walk_native")
def _(spark, d):
    f = FI.listing(spark, d)
    base = f.agg(F.min("depth").alias("base"))
    return f.join(F.broadcast(base)).select("name", (F.col("depth") - F.col("base")).alias("depth"), "length").filter("depth <= 2")


@query("scan_text_nonbinary", "SELECT 'csv' AS ext, CAST(sum(strlen(CAST(n_nationkey AS VARCHAR)) + strlen(n_name) + 2) AS BIGINT) AS bytes FROM nation")
def _(spark, d):
    path = scratch(spark, "mixed")
    n = load(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1)
    n.write.csv(path)
    n.write.mode("append").parquet(path)
    f = FI.contents(spark, path, "part-*").filter(~FI.is_binary(F.col("content")))
    return f.groupBy(F.element_at(F.split("path", r"\."), -1).alias("ext")).agg(F.sum("length").alias("bytes"))


@query("filter_is_binary")
def _(spark, d):
    return FI.heads(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("name"), FI.is_binary(F.col("content")).alias("binary"))


@query("filter_size_gt0_nodot")
def _(spark, d):
    return FI.listing(spark, d).filter((F.col("length") > 0) & ~F.col("path").rlike(r"/\.git/")).select("name")


@query("filter_media_listing", "SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type ORDER BY p_type LIMIT 2) AND p_size < 30")
def _(spark, d):
    p = load(spark, d, "part")
    kinds = p.select("p_type").distinct().orderBy("p_type").limit(2)
    return p.filter("p_size < 30").join(F.broadcast(kinds), "p_type", "left_semi").select("p_partkey")


FOLDERS = "(SELECT unnest(list_transform(range(1, greatest(1, len(s) - 1) + 1), lambda n: array_to_string(s[1:n], '/'))) AS folder, n FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s, strlen(html) AS n FROM pages))"


@query("agg_dir_size", f"SELECT folder, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS files FROM {FOLDERS} GROUP BY folder")
def _(spark, d):
    p = load(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("n"))
    return FI.directory_sizes(p, "path", "n")


@query("agg_topn_other", f"WITH c AS (SELECT source, sum(strlen({TX})) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rn FROM c) SELECT CASE WHEN rn <= 5 THEN source ELSE 'Other' END AS source, CAST(sum(n) AS BIGINT) AS n, round(sum(n) * 100.0 / (SELECT sum(n) FROM c), 6) AS pct FROM r GROUP BY 1")
def _(spark, d):
    c = docs(spark, d).groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("n"))
    return FI.top_with_other(c, "source", "n", 5)


@query("agg_group_by_size", f"SELECT strlen({TX}) AS size, doc_id, count(*) OVER (PARTITION BY strlen({TX})) AS cnt FROM documents QUALIFY cnt > 1")
def _(spark, d):
    """Rows of the sizes that several documents have: a row each, so that no size gathers its documents."""
    x = docs(spark, d).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return x.join(x.groupBy("size").agg(F.count("*").alias("cnt")).filter("cnt > 1"), "size").select("size", "doc_id", "cnt")


@query("agg_extension_set", "SELECT DISTINCT p_brand AS ext FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 2)")
def _(spark, d):
    p = load(spark, d, "part")
    return p.select(F.col("p_brand").alias("ext")).distinct().join(p.filter("p_size < 2").select(F.col("p_brand").alias("ext")), "ext", "left_anti")


@query("agg_filename_frequency", "SELECT p_name AS stem, count(*) AS cnt FROM part GROUP BY 1 HAVING count(*) > 2 ORDER BY cnt DESC, stem LIMIT 100")
def _(spark, d):
    return L.top(L.counts(load(spark, d, "part").select(F.col("p_name").alias("stem")), "stem").filter("cnt > 2"), 100, F.desc("cnt"), "stem")


@query("agg_sql_group", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt, max(o_orderdate) AS last FROM orders GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 100")
def _(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS cnt, max(o_orderdate) AS last FROM orders GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 100")


@query("agg_latest_per_key", "SELECT p_brand, max((p_size, p_retailprice, p_partkey))[3] AS p_partkey FROM part GROUP BY p_brand")
def _(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.max(F.struct("p_size", "p_retailprice", "p_partkey")).alias("m")).select("p_brand", "m.p_partkey")


@query("agg_compression_stats", "SELECT count(*) FILTER (WHERE l_discount > 0) AS ok, round(sum(l_extendedprice), 2) AS original, round(sum(l_extendedprice * l_discount), 2) AS saved, round(sum(l_extendedprice * l_discount) * 100 / sum(l_extendedprice), 4) AS pct FROM lineitem")
def _(spark, d):
    saved = F.sum(F.col("l_extendedprice") * F.col("l_discount"))
    return load(spark, d, "lineitem").agg(F.count_if(F.col("l_discount") > 0).alias("ok"), F.round(F.sum("l_extendedprice"), 2).alias("original"), F.round(saved, 2).alias("saved"), F.round(saved * 100 / F.sum("l_extendedprice"), 4).alias("pct"))


@query("agg_size_buckets", "SELECT CAST(floor(least(p_size, 49) / 10) AS INT) AS bucket, count(*) AS cnt FROM part GROUP BY 1")
def _(spark, d):
    return load(spark, d, "part").groupBy(F.floor(F.least("p_size", F.lit(49)) / 10).cast("int").alias("bucket")).agg(F.count("*").alias("cnt"))


@query("agg_balanced_bins")
def _(spark, d):
    """One balance of the whole table: the driver sees how many rows each size has, and deals the sizes; rows find their bin by their rank within their size."""
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"))
    dealt = FI.dealt_sizes([tuple(r) for r in p.groupBy("size").count().collect()], 8)
    plan = spark.createDataFrame(dealt, "size int, first long, until long, bins array<int>")
    ranked = p.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy("p_partkey")) - 1)
    hit = ranked.join(F.broadcast(plan), "size").filter("r >= first and r < until")  # a few rows a distinct size
    return hit.select("p_partkey", F.expr("bins[cast((r - first) % size(bins) as int)]").alias("bin"))


@query("topk_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def _(spark, d):
    return L.top(load(spark, d, "events").select("event_id", "ts"), 20, F.desc("ts"), "event_id")


@query("topk_largest_heap", f"SELECT doc_id, length({TX}) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 11")
def _(spark, d):
    return L.top(docs(spark, d).select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")), 11, F.desc("n"), "doc_id")


@query("sort_csv_numeric", "SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(l_returnflag AS INT), CAST(l_quantity AS INT)) AS q FROM lineitem")
def _(spark, d):
    q = F.coalesce(F.expr("try_cast(l_returnflag as int)"), F.col("l_quantity").cast("int"))
    return L.sort_all(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q")), F.desc("q"), F.asc("l_orderkey"), F.asc("l_linenumber"))


@query("sort_csv_score", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, d):
    return L.sort_all(load(spark, d, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), F.asc("c_custkey"))


# ---- partitioned sinks ----


@query("sink_partition_by_letter", f"SELECT CASE WHEN regexp_matches(lower(substr(ltrim(line), 1, 1)), '[a-z]') THEN lower(substr(ltrim(line), 1, 1)) END AS letter, count(*) AS cnt FROM {LINES} GROUP BY 1")
def _(spark, d):
    path, first = scratch(spark, "letters"), F.lower(F.substring(F.ltrim("line"), 1, 1))
    all_lines(spark, d).select("line", F.when(first.rlike("^[a-z]$"), first).alias("letter")).write.partitionBy("letter").parquet(path)
    return spark.read.parquet(path).groupBy("letter").agg(F.count("*").alias("cnt"))


CLASS = "CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'digit' WHEN regexp_full_match(w, '[A-Z]+') THEN 'upper' WHEN regexp_full_match(w, '[a-z]+') THEN 'lower' WHEN regexp_full_match(w, '[A-Za-z]+') THEN 'alpha' WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN 'alnum' ELSE 'rest' END"


@query("sink_partition_by_class", f"SELECT {CLASS} AS class, count(*) AS cnt FROM (SELECT unnest(string_split({TX}, ' ')) AS w FROM documents) GROUP BY 1")
def _(spark, d):
    path, w = scratch(spark, "classes"), F.col("w")
    kind = F.when(w.rlike("^[0-9]+$"), "digit").when(w.rlike("^[A-Z]+$"), "upper").when(w.rlike("^[a-z]+$"), "lower").when(w.rlike("^[A-Za-z]+$"), "alpha").when(w.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("rest")
    docs(spark, d).select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w")).select("w", kind.alias("class")).write.partitionBy("class").parquet(path)
    return spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("cnt"))


@query("sink_split_n", f"SELECT doc_id, CAST(pos AS INT) AS pos, CAST(least(4, (pos - 1) // greatest(1, n // 4) + 1) AS INT) AS part FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n FROM {LINES})")
def _(spark, d):
    n = F.size(L.split_lines(F.col("text")))
    x = L.lines(docs(spark, d).withColumn("n", n), "doc_id", "text", "n")
    return x.select("doc_id", "pos", F.least(F.lit(4), F.floor((F.col("pos") - 1) / F.greatest(F.lit(1), F.floor(F.col("n") / 4))) + 1).cast("int").alias("part"))


@query("sink_merge_parts", f"SELECT doc_id, {TX} AS text FROM documents")
def _(spark, d):
    t = F.coalesce("text", F.lit(""))
    parts = docs(spark, d).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.char_length(t) / 1000).cast("int")), lambda k: F.substring(t, k * 1000 + 1, F.lit(1000)))).alias("num", "chunk"))
    m = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("num", "chunk"))).alias("p"))
    return m.select("doc_id", F.array_join(F.transform("p", lambda x: x["chunk"]), "").alias("text"))


@query("sink_atomic_file", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return staged(spark, load(spark, d, "nation").select("n_nationkey", "n_name"), "atomic")


# ---- similarity ----

TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))"


def token_sets(spark, d):
    t = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))
    return docs(spark, d).select("doc_id", t.alias("t"))


SHARED = f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), n AS (SELECT doc_id, len(t) AS n FROM d), e AS (SELECT doc_id, unnest(t) AS w FROM d),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, round(k * 100.0 / (x.n + y.n - k), 2) AS score FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE round(k * 100.0 / (x.n + y.n - k), 2) >= 60"""


@query("sim_jaccard_tokens", SHARED)
def _(spark, d):
    return S.token_pairs(token_sets(spark, d), "doc_id", "t", 0.6, lambda df: staged(spark, df, "tokens"))


@query("join_pairwise_theta", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 2")
def _(spark, d):
    """A size meets itself and the next two by equality, so that all that is joined but half of those of one size is a result."""
    p = load(spark, d, "part").filter("p_partkey is not null").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("long").alias("size"))
    x = p.withColumnRenamed("p_partkey", "x").withColumn("more", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("size", F.col("size") + F.col("more"))
    met = x.join(p.withColumnRenamed("p_partkey", "y"), ["p_brand", "p_type", "size"]).filter("x < y or (more > 0 and x > y)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def by_doc(pairs, classes, score):
    """(a, b, score) of pairs of classes (x, y), by the classes' least ids."""
    x, y = classes.select(F.col("cls").alias("x"), F.col("doc").alias("p"), F.col("sig").alias("s")), classes.select(F.col("cls").alias("y"), F.col("doc").alias("q"), F.col("sig").alias("t"))
    return pairs.join(x, "x").join(y, "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), score(F.col("s"), F.col("t")).alias("score"))


@query("sim_minhash")
def _(spark, d):
    """Pairs of classes of equal signatures, and at score 100 each other member with its class: two texts score 50 or more if their classes are one or a pair."""
    long = docs(spark, d).filter(F.octet_length("text") > 4)  # what has a signature; a filter on the signature would make each twice
    s = staged(spark, long.select("doc_id", ST.minhash_signature("text").alias("sig")).withColumn("cls", F.xxhash64("sig")), "minhash")
    classes = staged(spark, s.groupBy("cls").agg(F.min("doc_id").alias("doc")), "classes")
    rest = s.select("cls", F.col("doc_id").alias("b")).join(classes, "cls").filter("doc <> b").select(F.col("doc").alias("a"), "b", F.lit(100.0).alias("score")).distinct()
    x, y = classes.select(F.col("cls").alias("x"), F.col("doc").alias("p")), classes.select(F.col("cls").alias("y"), F.col("doc").alias("q"))
    pairs = S.minhash_pairs(s, S.PERMUTATIONS // 2, lambda df: staged(spark, df, "keys")).join(x, "x").join(y, "y")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "score").unionByName(rest)


@query("sim_simhash")
def _(spark, d):
    """Pairs of classes of equal signatures, and at score 100 each other member with its class: two texts score 95 or more if their classes are one or a pair."""
    s = staged(spark, docs(spark, d).select("doc_id", ST.simhash_signature("text").alias("sig")).filter("sig is not null").withColumn("cls", F.col("sig")), "simhash")
    classes, rest = S.members(s, "doc_id")
    classes = staged(spark, classes, "classes")
    return by_doc(S.simhash_pairs(classes, 3), classes, S.simhash_score).unionByName(rest)


@query("sim_sequence_ratio")
def _(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", ST.sequence_ratio("p_name", "p_type").alias("score"))


@query("udf_registry_similarity")
def _(spark, d):
    """Every registered algorithm's mean score over one pair of columns."""
    p, out = load(spark, d, "part"), None
    for name, (sign, compare) in ST.SIMILARITIES.items():
        one = p.select(sign(F.col("p_name")).alias("a"), sign(F.col("p_type")).alias("b")).agg(F.round(F.avg(compare(F.col("a"), F.col("b"))), 4).alias("score")).select(F.lit(name).alias("algorithm"), "score")
        out = one if out is None else out.unionByName(one)
    return out


@query("sim_ssdeep")
def _(spark, d):
    """Pairs of classes of equal piecewise hashes, and at score 100 each other member with its class: two texts score 70 or more if their classes are one or a pair."""
    s = staged(spark, docs(spark, d).select("doc_id", ST.ctph("text").alias("sig")).filter("sig is not null").withColumn("cls", F.xxhash64("sig")), "pieces")
    classes, rest = S.members(s, "doc_id")
    classes = staged(spark, classes, "classes")
    x, y = classes.select(F.col("cls").alias("x"), F.col("doc").alias("p")), classes.select(F.col("cls").alias("y"), F.col("doc").alias("q"))
    pairs = S.piece_pairs(classes, 70, lambda df: staged(spark, df, "pieces")).join(x, "x").join(y, "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "score")
    return pairs.unionByName(rest)


@query("sim_tlsh")
def _(spark, d):
    """Every document's distance from the first one of its source, and the score 100 - distance, 0 at least; texts without a hash have neither."""
    h = staged(spark, docs(spark, d).select("doc_id", "source", ST.bucket_hash("text").alias("h")), "buckets")
    first = h.filter("h is not null").groupBy("source").agg(F.min(F.struct("doc_id", "h")).alias("m"))
    far = h.join(first, "source").select("doc_id", ST.bucket_distance("h", "m.h").alias("distance"))
    return far.select("doc_id", "distance", F.greatest(F.lit(0), 100 - F.col("distance")).alias("score"))


BITS = "list_transform(embedding, lambda z: CAST(z AS DOUBLE) > list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) / len(embedding))"


@query("sim_perceptual_hash", f"WITH h AS (SELECT vec_id, label, {BITS} AS b FROM embeddings), f AS (SELECT label, arg_min(b, vec_id) AS m FROM h GROUP BY label) SELECT vec_id, h.label, array_to_string(list_transform(b, lambda z: CAST(CAST(z AS INT) AS VARCHAR)), '') AS hash, CAST(len(list_filter(list_zip(b, m), lambda z: z[1] <> z[2])) AS INT) AS distance FROM h JOIN f ON h.label = f.label")
def _(spark, d):
    """Average hash of all elements of feature vectors, and how far each is from its label's first one."""
    h = load(spark, d, "embeddings").select("vec_id", "label", S.average_hash(F.col("embedding")).alias("hash"))
    first = h.groupBy("label").agg(F.min(F.struct("vec_id", "hash")).alias("m"))
    return h.join(first, "label").select("vec_id", "label", "hash", S.hamming(F.col("hash"), F.col("m.hash")).alias("distance"))


@query("sim_composite")
def _(spark, d):
    """Mean of the sequence ratio and the token share, and of the piece and bucket scores where they are above 0; 100 for equal texts."""
    p = load(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat_ws(" ", F.split("p_name", " ")[0], "p_type").alias("b"))
    kinds = [sign_score for name, sign_score in ST.SIMILARITIES.items() if name in ("pieces", "buckets")]
    mean = ST.composite(F.round(ST.sequence_ratio("a", "b"), 2), ST.token_share(F.col("a"), F.col("b")), *(score(sign(F.col("a")), sign(F.col("b"))) for sign, score in kinds), always=2)
    return p.select("p_partkey", F.when(F.col("a") == F.col("b"), 100.0).otherwise(mean).alias("score"))


@query("sim_levenshtein_bounded", "SELECT p_partkey, CAST(least(levenshtein(p_name, p_type), 13) AS INT) AS dist FROM part")
def _(spark, d):
    near = F.levenshtein("p_name", "p_type", 12)
    return load(spark, d, "part").select("p_partkey", F.when(near == -1, 13).otherwise(near).alias("dist"))


@query("sim_nearest_topn", f"WITH t AS (SELECT t FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE doc_id = (SELECT min(doc_id) FROM documents)) SELECT d.doc_id, round(len(list_intersect(d.t, t.t)) * 100.0 / (len(d.t) + len(t.t) - len(list_intersect(d.t, t.t))), 2) AS score FROM (SELECT doc_id, {TOKENS} AS t FROM documents) d, t WHERE len(d.t) + len(t.t) > 0 ORDER BY score DESC, doc_id LIMIT 20")
def _(spark, d):
    s = token_sets(spark, d)
    target = s.orderBy("doc_id").limit(1).select(F.col("t").alias("q"))  # one row
    inner = F.size(F.array_intersect("t", "q"))
    scored = s.join(F.broadcast(target)).select("doc_id", F.round(F.try_divide(inner * 100.0, F.size("t") + F.size("q") - inner), 2).alias("score")).filter("score is not null")
    return L.top(scored, 20, F.desc("score"), "doc_id")


@query("sim_vector_l2norm", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda z: z * z))), 4) AS norm FROM v")
def _(spark, d):
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return load(spark, d, "embeddings").select("vec_id", F.round(n, 4).alias("norm"))


@query("cluster_union_find", f"WITH RECURSIVE h AS (SELECT doc_id, sha256({TX}) AS k FROM documents) SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY k) AS label FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1")
def _(spark, d):
    h = docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"))
    first = h.groupBy("k").agg(F.min("doc_id").alias("a"))
    pairs = h.join(first, "k").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    return S.connected(pairs, checkpoint=lambda df: staged(spark, df, "labels"))


SOURCE = "def f{n}(x):\n    # one\n    return x + {n}\n\nclass C{n}:\n    pass\n\nimport os, json\nLIMIT = {n}\n"


def sources(spark, d):
    k = F.pmod("p_partkey", F.lit(7)).cast("string")
    return load(spark, d, "part").select("p_partkey", F.replace(F.lit(SOURCE), F.lit("{n}"), k).alias("src"))


@query("dedup_normalised_code")
def _(spark, d):
    x = sources(spark, d).select("p_partkey", F.inline(ST.definitions("src")))
    return x.groupBy("digest").agg(F.count("*").alias("cnt"), F.min("p_partkey").alias("first")).filter("cnt > 1")


@query("dedup_definition_hash")
def _(spark, d):
    x = sources(spark, d).select("p_partkey", F.inline(ST.definitions("src")))
    return x.groupBy("kind", "name", "digest").agg(F.count("*").alias("cnt"), F.min("p_partkey").alias("first")).filter("cnt > 1")


@query("udtf_extract_entities", "SELECT p_partkey, unnest(['f' || k, 'C' || k, 'LIMIT']) AS name, unnest(['function', 'class', 'constant']) AS kind, CAST(unnest([1, 5, 9]) AS INT) AS first, CAST(unnest([3, 6, 9]) AS INT) AS last FROM (SELECT p_partkey, p_partkey % 7 AS k FROM part)")
def _(spark, d):
    return sources(spark, d).select("p_partkey", F.inline(ST.definitions("src"))).select("p_partkey", "name", "kind", "first", "last")


#: A source text of each language for the part of that number; what is commented or quoted isn't defined.
BY_LANGUAGE = {
    "python": "# def no():\ndef f{n}(x):\n    return '''\nclass No:\n'''\nclass C{n}:\n    pass\n",
    "javascript": "/* function no() {\n} */\nexport function f{n}() {}\nvar s = `\nclass No {}`\nclass C{n} {}\n",
    "rust": "/* a /* fn no() */\nfn no() {} */\npub fn f{n}() {}\n\n\npub struct C{n};\n",
    "go": "// func no()\n/*\nfunc no() */\nfunc f{n}() {}\n\ntype C{n} struct {\n",
}
ENTITIES = """SELECT p_partkey, language, unnest(['f' || p_partkey, 'C' || p_partkey]) AS name, unnest(['function', 'class']) AS kind, CAST(unnest(lines) AS INT) AS line
FROM (SELECT p_partkey, ['python', 'javascript', 'rust', 'go'][1 + p_partkey % 4] AS language, [[2, 6], [3, 6], [3, 6], [4, 6]][1 + p_partkey % 4] AS lines FROM part)"""


@query("udtf_entities_by_language", ENTITIES)
def _(spark, d):
    """What source texts of four languages define, with its line."""
    p, out = load(spark, d, "part").select("p_partkey"), None
    for k, (name, template) in enumerate(BY_LANGUAGE.items()):
        mine = p.filter(F.pmod("p_partkey", F.lit(len(BY_LANGUAGE))) == k).select("p_partkey", F.lit(name).alias("language"), F.replace(F.lit(template), F.lit("{n}"), F.col("p_partkey").cast("string")).alias("s"))
        rows = mine.select("p_partkey", "language", F.inline(X.names(name)("s")))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("udtf_imports", "SELECT module, count(*) AS cnt FROM (SELECT unnest(['os', 'json']) AS module FROM part) GROUP BY module")
def _(spark, d):
    return sources(spark, d).select("p_partkey", F.explode(ST.imported_modules("src")).alias("module")).groupBy("module").agg(F.count("*").alias("cnt"))


#: What splits words in Python: the white space of Unicode and four separators of ASCII.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query("udf_map_files", f"SELECT doc_id, len(regexp_extract_all(text, '[^{WHITE}]+')) AS value, CASE WHEN text IS NULL THEN 'AttributeError' END AS error FROM documents")
def _(spark, d):
    """The extension point: any function of a text, with its error as a column instead of a failed task."""

    def apply(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf.doc_id, pdf.text, strict=True):
                try:
                    rows.append((i, len(t.split()), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "value", "error"])

    return docs(spark, d).select("doc_id", "text").mapInPandas(apply, "doc_id long, value long, error string")


FLAT = "'[{\"brand\":\"1\",\"name\":\"2\",\"size\":' || p_size || '},\"' || p_brand || '\",\"' || p_name || '\"]'"


@query("json_flat_codec", f"SELECT p_partkey, {FLAT} AS flat, true AS back FROM part")
def _(spark, d):
    whole = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    p = load(spark, d, "part").select("p_partkey", whole.alias("whole"))
    return p.select("p_partkey", "whole", ST.flat_json("whole").alias("flat")).select("p_partkey", "flat", (ST.nested_json("flat") == F.col("whole")).alias("back"))


@query("scan_pickle", "SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}' AS value FROM part")
def _(spark, d):
    """Pickles, here a column; of files it is the column `content`."""
    p = load(spark, d, "part")
    raw = p.select("p_partkey", ST.json_pickle(F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))).alias("content"))
    return staged(spark, raw, "pickles").select("p_partkey", ST.pickle_json("content").alias("value"))
