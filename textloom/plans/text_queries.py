"""Queries over lines and words of documents: scans, filters, counts, ranks, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import lines as L
from textloom.plans.catalog import load, query

SPLIT = "string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))"
ARR = f"(CASE WHEN {SPLIT}[-1] = '' THEN {SPLIT}[1:len({SPLIT}) - 1] ELSE {SPLIT} END)"
LINES = f"(SELECT doc_id, lang, source, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (SELECT doc_id, lang, source, {ARR} AS a FROM documents))"
BLINES = f"(SELECT item_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (SELECT item_id, {ARR} AS a FROM benchmark))"
STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
BLANK = r"(NOT regexp_matches({}, '[^\x20\x09-\x0D]'))"
WORDS = r"(SELECT doc_id, lang, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS w FROM documents))"
WORDS3 = "(SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM documents))"
ALNUM = "(SELECT doc_id, unnest(regexp_extract_all(lower(translate(coalesce(text, ''), '-_', '  ')), '[a-z0-9]+')) AS word FROM documents)"
SPACE = r"""(SELECT doc_id, unnest(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: lower(regexp_replace(regexp_replace(x, '[,.|\;:''"]+$', ''), '^[''"]+', '')))) AS word FROM documents)"""
UNI = r"(SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:[''’]\p{L}+)*'), lambda x: length(x) > 1)) AS word FROM documents)"
STOP = ("the", "and", "for", "that", "with", "this", "from", "der", "die", "und", "les", "des", "que", "los", "las", "una")
STOPS = ", ".join(f"'{w}'" for w in STOP)


def docs(spark, d):
    return load(spark, d, "documents")


def all_lines(spark, d, *keep):
    return L.lines(docs(spark, d), "doc_id", "text", *keep)


# ---- scans and filters ----


@query("scan_text_lines", f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM {LINES}")
def _(spark, d):
    return all_lines(spark, d)


@query("scan_csv_positional", f"SELECT doc_id, CAST(pos AS INT) AS pos, f[1] AS a, f[2] AS b, f[3] AS c FROM (SELECT doc_id, pos, string_split(line, ',') AS f FROM {LINES}) WHERE len(f) >= 3")
def _(spark, d):
    f = F.split("line", ",")
    return all_lines(spark, d).select("doc_id", "pos", f.alias("f")).filter(F.size("f") >= 3).select("doc_id", "pos", *(F.get("f", F.lit(k)).alias(n) for k, n in enumerate("abc")))


@query("scan_key_value", f"SELECT doc_id, CAST(pos AS INT) AS pos, substr(line, 1, instr(line, '=') - 1) AS k, substr(line, instr(line, '=') + 1) AS v FROM {LINES} WHERE instr(line, '=') > 0 AND NOT starts_with(line, '#')")
def _(spark, d):
    kv = F.split("line", "=", 2)
    return all_lines(spark, d).filter(F.contains("line", F.lit("=")) & ~F.col("line").startswith("#")).select("doc_id", "pos", kv[0].alias("k"), kv[1].alias("v"))


@query("scan_zip_parallel_text", f"SELECT doc_id, CAST(a.pos AS INT) AS pos, a.line AS left_line, b.line AS right_line FROM {LINES} a JOIN {BLINES} b ON a.doc_id = b.item_id AND a.pos = b.pos")
def _(spark, d):
    a = all_lines(spark, d).withColumnRenamed("line", "left_line")
    b = L.lines(load(spark, d, "benchmark"), "item_id").select(F.col("item_id").alias("doc_id"), "pos", F.col("line").alias("right_line"))
    return a.join(b, ["doc_id", "pos"])


@query("filter_contains", f"SELECT doc_id, array_to_string(list_filter({ARR}, lambda x: NOT (contains(x, 'the') OR contains(x, 'que'))), chr(10)) AS text FROM documents")
def _(spark, d):
    return L.map_lines(docs(spark, d), lambda x: L.without_any(x, ["the", "que"]))


@query("filter_keep_contains", f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM {LINES} WHERE contains(line, '@') OR starts_with(line, 'The') OR ends_with(line, 'the.')")
def _(spark, d):
    c = F.col("line")
    return all_lines(spark, d).filter(c.contains("@") | c.startswith("The") | c.endswith("the."))


@query("filter_regex_search", rf"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM {LINES} WHERE regexp_matches(line, '[a-z]+@[a-z]+[.][a-z]+|[0-9]{{5,}}')")
def _(spark, d):
    return L.grep(docs(spark, d), "[a-z]+@[a-z]+[.][a-z]+|[0-9]{5,}")


@query("filter_blank", f"SELECT doc_id, array_to_string(list_filter({ARR}, lambda x: NOT {BLANK.format('x')}), chr(10)) AS text FROM documents")
def _(spark, d):
    return L.map_lines(docs(spark, d), lambda x: ~L.is_blank(x))


@query(
    "filter_squeeze_blank",
    f"""WITH l AS (SELECT doc_id, pos, line, {BLANK.format('line')} AS b FROM {LINES}),
    w AS (SELECT *, lag(b, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS p, max(CASE WHEN NOT b THEN pos END) OVER (PARTITION BY doc_id) AS last FROM l)
    SELECT doc_id, coalesce(text, '') AS text FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN b THEN '' ELSE line END, chr(10) ORDER BY pos) AS text FROM w WHERE pos <= last AND NOT (b AND p) GROUP BY doc_id) USING (doc_id)""",
)
def _(spark, d):
    return L.squeeze_blank(docs(spark, d))


@query("filter_repeated_char", f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM {LINES} WHERE NOT (length(line) > 1 AND replace(line, line[1], '') = '')")
def _(spark, d):
    return all_lines(spark, d).filter(~F.col("line").rlike(r"(?s)^(.)\1+$"))


@query("filter_min_lines", f"SELECT doc_id, CAST(len({ARR}) AS INT) AS n FROM documents WHERE len({ARR}) < 5")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(L.split_lines(F.col("text"))).alias("n")).filter("n < 5")


@query("project_first_n_lines", f"SELECT DISTINCT array_to_string({ARR}[1:23], chr(10)) AS head FROM documents")
def _(spark, d):
    return docs(spark, d).select(F.array_join(F.slice(L.split_lines(F.col("text")), 1, 23), "\n").alias("head")).distinct()


@query("project_line_numbers", f"SELECT doc_id, CAST(pos AS INT) AS pos, CAST(length(line) AS INT) AS n FROM {LINES}")
def _(spark, d):
    return all_lines(spark, d).select("doc_id", "pos", F.char_length("line").alias("n"))


@query("limit_first_bytes", "SELECT doc_id, substr(text, 1, 5000) AS head FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.substring("text", 1, 5000).alias("head"))


# ---- word counts ----


@query("agg_word_count", f"SELECT word, count(*) AS cnt FROM {WORDS} GROUP BY word")
def word_count(spark, d):
    return L.counts(L.words(docs(spark, d)), "word")


@query("udaf_counter_merge", f"SELECT lang, word, count(*) AS cnt FROM {WORDS} GROUP BY lang, word")
def _(spark, d):
    return L.counts(L.words(docs(spark, d), "alpha", "doc_id", "text", "lang"), "lang", "word")


@query("agg_word_count_split", f"SELECT word, count(*) AS cnt FROM {SPACE} GROUP BY word")
def _(spark, d):
    return L.counts(L.words(docs(spark, d), "space"), "word")


@query("agg_word_count_stopwords", f"SELECT word, count(*) AS cnt FROM {WORDS3} WHERE word NOT IN ({STOPS}) GROUP BY word HAVING count(*) > 1 ORDER BY cnt DESC, word LIMIT 50")
def _(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")  # a fixed list
    return L.top(L.counts(L.words(docs(spark, d), "alpha3").join(F.broadcast(stop), "word", "left_anti"), "word").filter("cnt > 1"), 50, F.desc("cnt"), "word")


@query("agg_word_top_per_doc", f"SELECT doc_id, word, cnt, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rn FROM (SELECT doc_id, word, count(*) AS cnt, min(pos) AS first FROM {WORDS3} GROUP BY doc_id, word)) WHERE rn <= 30")
def _(spark, d):
    c = L.words(docs(spark, d), "alpha3").groupBy("doc_id", "word").agg(F.count("*").alias("cnt"), F.min("pos").alias("first"))
    return L.top_per(c, 30, "doc_id", F.desc("cnt"), "first").select("doc_id", "word", "cnt", "rn")


RANKED = f"""WITH c AS (SELECT word, count(*) AS cnt FROM {ALNUM} GROUP BY word), t AS (SELECT sum(cnt) AS total, count(*) AS uniq FROM c)
SELECT CAST(row_number() OVER (ORDER BY cnt DESC, word) AS INT) AS rank, word, cnt, round(cnt * 100.0 / total, 6) AS pct, CAST(uniq AS BIGINT) AS uniq FROM c, t ORDER BY cnt DESC, word LIMIT 100"""


@query("agg_word_rank_pct", RANKED)
def word_rank(spark, d):
    c = L.counts(L.words(docs(spark, d), "alnum"), "word")
    total = c.agg(F.sum("cnt").alias("total"), F.count("*").alias("uniq"))  # one row
    best = L.top(c, 100, F.desc("cnt"), "word")
    return best.join(F.broadcast(total)).select(
        F.row_number().over(Window.orderBy(F.desc("cnt"), "word")).alias("rank"), "word", "cnt", F.round(F.col("cnt") * 100.0 / F.col("total"), 6).alias("pct"), "uniq"
    )


@query("win_rank", f"SELECT lang, word, cnt, CAST(rank() OVER (PARTITION BY lang ORDER BY cnt DESC) AS INT) AS rk FROM (SELECT lang, word, count(*) AS cnt FROM {WORDS} GROUP BY lang, word)")
def _(spark, d):
    """A word's rank is one more than the words of its language that are counted more often: the window runs over distinct counts, not over words."""
    c = L.counts(L.words(docs(spark, d), "alpha", "doc_id", "text", "lang"), "lang", "word")
    same = c.groupBy("lang", "cnt").agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = same.select("lang", "cnt", (F.coalesce(F.sum("k").over(w), F.lit(0)) + 1).cast("int").alias("rk"))
    return c.join(ranks, ["lang", "cnt"]).select("lang", "word", "cnt", "rk")


@query("agg_vocabulary", f"SELECT DISTINCT word FROM {UNI}")
def _(spark, d):
    return L.words(docs(spark, d), "unicode").select("word").distinct()


@query("str_tokenize_regex", f"SELECT 'alpha' AS grammar, count(*) AS cnt FROM {WORDS} UNION ALL SELECT 'alpha3', count(*) FROM {WORDS3} UNION ALL SELECT 'alnum', count(*) FROM {ALNUM} UNION ALL SELECT 'unicode', count(*) FROM {UNI} UNION ALL SELECT 'space', count(*) FROM {SPACE}")
def _(spark, d):
    out = None
    for g in ("alpha", "alpha3", "alnum", "unicode", "space"):
        one = L.words(docs(spark, d), g).agg(F.count("*").alias("cnt")).select(F.lit(g).alias("grammar"), "cnt")
        out = one if out is None else out.unionByName(one)
    return out


@query("topk_most_common", f"SELECT word, count(*) AS cnt, min((doc_id, pos))[1] AS first_doc FROM {WORDS} GROUP BY word ORDER BY cnt DESC, min((doc_id, pos)) LIMIT 100")
def _(spark, d):
    c = L.words(docs(spark, d)).groupBy("word").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return L.top(c, 100, F.desc("cnt"), "first").select("word", "cnt", F.col("first.doc_id").alias("first_doc"))


@query("sort_count_then_key", f"SELECT word, count(*) AS cnt FROM {WORDS3} GROUP BY word")
def _(spark, d):
    return L.sort_all(L.counts(L.words(docs(spark, d), "alpha3"), "word"), F.desc("cnt"), F.asc("word"))


# ---- line counts ----


@query("agg_line_frequency", f"SELECT lang, {STRIP.format('line')} AS line, count(*) AS cnt FROM {LINES} WHERE NOT {BLANK.format('line')} GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return L.counts(all_lines(spark, d, "lang").select("lang", L.strip(F.col("line")).alias("line")).filter("line <> ''"), "lang", "line").filter("cnt >= 2")


@query("agg_line_top500", f"SELECT lang, line, cnt FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, line) AS rn FROM (SELECT lang, line, count(*) AS cnt FROM {LINES} WHERE line <> '' GROUP BY lang, line)) WHERE rn <= 500")
def _(spark, d):
    c = L.counts(all_lines(spark, d, "lang").filter("line <> ''"), "lang", "line")
    return L.top_per(c, 500, "lang", F.desc("cnt"), "line").drop("rn")


@query(
    "agg_file_line_stats",
    f"""SELECT doc_id, CAST(len(a) AS BIGINT) AS total, CAST(len(list_distinct(a)) AS BIGINT) AS uniq, CAST(len(a) - len(list_distinct(a)) AS BIGINT) AS dups,
    CASE WHEN len(a) > 0 THEN round((len(a) - len(list_distinct(a))) * 100.0 / len(a), 4) END AS dup_pct, CAST(coalesce(list_max(s), 0) AS BIGINT) AS max_len,
    CASE WHEN len(a) > 0 THEN round(list_sum(s) / len(a), 4) END AS avg_len FROM (SELECT doc_id, a, list_transform(a, lambda x: length(x)) AS s FROM (SELECT doc_id, {ARR} AS a FROM documents))""",
)
def _(spark, d):
    return L.line_stats(docs(spark, d))


@query("math_ratio_pct", f"SELECT doc_id, CASE WHEN len({ARR}) > 0 THEN round(len(list_filter({ARR}, lambda x: {BLANK.format('x')})) * 100.0 / len({ARR}), 4) END AS blank_pct FROM documents")
def _(spark, d):
    a = L.split_lines(F.col("text"))
    return docs(spark, d).select("doc_id", F.round(F.try_divide(F.size(F.filter(a, L.is_blank)) * F.lit(100.0), F.size(a)), 4).alias("blank_pct"))


CODE = f"count(*) FILTER (WHERE NOT {BLANK.format('line')} AND NOT regexp_matches(line, '^[ ]*#'))"


@query("agg_code_line_counts", f"SELECT lang, {CODE} AS code, count(*) FILTER (WHERE regexp_matches(line, '^[ ]*#')) AS comment, count(*) FILTER (WHERE {BLANK.format('line')}) AS blank FROM {LINES} GROUP BY lang")
def _(spark, d):
    c, comment, blank = F.col("line"), F.col("line").rlike("^[ ]*#"), L.is_blank(F.col("line"))
    return all_lines(spark, d, "lang").groupBy("lang").agg(F.count_if(~blank & ~comment).alias("code"), F.count_if(comment).alias("comment"), F.count_if(L.is_blank(c)).alias("blank"))


@query("agg_partial_final", f"SELECT source, count(*) AS total, count(*) FILTER (WHERE {BLANK.format('line')}) AS blanks, count(*) FILTER (WHERE line <> {STRIP.format('line')}) AS changed FROM {LINES} GROUP BY source")
def _(spark, d):
    c = F.col("line")
    return all_lines(spark, d, "source").groupBy("source").agg(F.count("*").alias("total"), F.count_if(L.is_blank(c)).alias("blanks"), F.count_if(c != L.strip(c)).alias("changed"))


@query("agg_chars", "SELECT c, count(*) AS cnt, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY c")
def _(spark, d):
    # counted within each document first, so the shuffle carries characters of a document, not of the corpus
    one = docs(spark, d).filter("text <> ''").select("doc_id", F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    return one.groupBy("c").agg(F.sum("n").alias("cnt"), F.count("*").alias("docs"))


@query("agg_lang_distribution", "SELECT lang, count(*) AS files, count(*) FILTER (WHERE length(text) < 200) AS small, count(*) FILTER (WHERE text IS NULL) AS missing FROM documents GROUP BY lang")
def _(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("files"), F.count_if(F.char_length("text") < 200).alias("small"), F.count_if(F.col("text").isNull()).alias("missing"))


@query("agg_lang_mode", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang) WHERE rn = 1")
def _(spark, d):
    c = docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("m")).select("source", "m.lang")


@query("agg_collect_occurrences", f"SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS cnt, min(doc_id) AS first_doc FROM {LINES} WHERE length(line) > 10 GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def _(spark, d):
    per = all_lines(spark, d).filter(F.char_length("line") > 10).groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("line").agg(F.count("*").alias("docs"), F.sum("n").alias("cnt"), F.min("doc_id").alias("first_doc")).filter("docs > 1")


# ---- window-shaped ----


@query("win_lag_equal", f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {LINES}) WHERE line = nxt AND NOT {BLANK.format('line')}")
def _(spark, d):
    # neighbours are in one array, so no shuffle is needed to see them
    pairs = docs(spark, d).select("doc_id", F.posexplode(L.neighbours(L.split_lines(F.col("text")))).alias("pos", "p"))
    return pairs.filter((F.col("p.line") == F.col("p.next")) & ~L.is_blank(F.col("p.line"))).select("doc_id", (F.col("pos") + 1).alias("pos"), "p.line")


@query("win_prev_blank", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM {LINES}) WHERE prev = '' AND line <> '' GROUP BY doc_id")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return all_lines(spark, d).select("doc_id", "line", F.lag("line").over(w).alias("prev")).filter("prev = '' AND line <> ''").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("win_running_offsets", f"SELECT doc_id, CAST(pos AS INT) AS pos, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM {LINES}")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return all_lines(spark, d).select("doc_id", "pos", F.coalesce(F.sum(F.char_length("line").cast("long") + 1).over(w), F.lit(0)).alias("off"))


@query("win_share_of_total", "SELECT source, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM (SELECT source, sum(length(coalesce(text, ''))) AS n FROM documents GROUP BY source)")
def _(spark, d):
    c = docs(spark, d).groupBy("source").agg(F.sum(F.char_length(F.coalesce("text", F.lit(""))).cast("long")).alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t")))).select("source", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).alias("pct"))


PACKED = f"""WITH p AS (SELECT doc_id, list_transform(range(1, len(a) + 1), lambda i: struct_pack(done := CAST([] AS STRUCT(first INT, last INT, size INT)[]), first := CAST(i AS INT), last := CAST(i AS INT), size := CAST(length(a[i]) AS INT))) AS l FROM (SELECT doc_id, {ARR} AS a FROM documents) WHERE len(a) > 0),
r AS (SELECT doc_id, list_reduce(l, lambda x, y: CASE WHEN x.size + y.size + 1 <= 500 THEN struct_pack(done := x.done, first := x.first, last := y.last, size := x.size + y.size + 1)
  ELSE struct_pack(done := list_append(x.done, struct_pack(first := x.first, last := x.last, size := x.size)), first := y.first, last := y.last, size := y.size) END) AS z FROM p),
c AS (SELECT doc_id, list_append(z.done, struct_pack(first := z.first, last := z.last, size := z.size)) AS c FROM r)
SELECT doc_id, CAST(k AS INT) AS chunk, c[k].first AS first, c[k].last AS last, c[k].size AS size FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS k FROM c)"""


@query("win_chunk_pack", PACKED)
def _(spark, d):
    return L.chunk_pack(docs(spark, d), 500)


# ---- sorts ----


@query("sort_lines", f"SELECT line, doc_id, CAST(pos AS INT) AS pos FROM {LINES}")
def _(spark, d):
    return L.sort_all(all_lines(spark, d).select("line", "doc_id", "pos"), F.lower("line"), "doc_id", "pos")


@query("sort_external", f"SELECT line, count(*) AS cnt FROM {LINES} GROUP BY line")
def _(spark, d):
    return L.counts(all_lines(spark, d), "line").repartitionByRange("line").sortWithinPartitions("line")


VALUE_PART = "CASE WHEN instr(line, ':') > 0 THEN substr(line, instr(line, ':') + 1) ELSE substr(line, instr(line, '=') + 1) END"


@query("sort_lines_by_value_part", f"SELECT doc_id, CAST(pos AS INT) AS pos, {STRIP.format(VALUE_PART)} AS v FROM {LINES} WHERE instr(line, ':') > 0 OR instr(line, '=') > 0")
def _(spark, d):
    colon = F.contains("line", F.lit(":"))
    v = L.strip(F.when(colon, F.split("line", ":", 2)[1]).otherwise(F.split("line", "=", 2)[1]))
    return L.sort_all(all_lines(spark, d).filter(colon | F.contains("line", F.lit("="))).select("doc_id", "pos", v.alias("v")), "v", "doc_id", "pos")


@query("sample_shuffle")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("place")).sort("place", "doc_id")
