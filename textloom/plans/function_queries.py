"""Queries over string, URL, time, hash and map functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexing as X
from textloom.functions import strings as S
from textloom.functions import times as T
from textloom.functions import urls as U
from textloom.operators import lines as L
from textloom.plans.catalog import load, query
from textloom.plans.text_queries import ARR, LINES, all_lines, docs

TX = "coalesce(text, '')"
text = lambda: F.coalesce("text", F.lit(""))


def over_text(name: str, sql: str, make):
    """A query (doc_id, value) over documents."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents" if sql else None)(lambda spark, d: docs(spark, d).select("doc_id", make(text()).alias("value")))


over_text("str_strip_controls", rf"regexp_replace({TX}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{AD}}\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g')", S.strip_controls)
over_text("str_strip_unprintable", rf"regexp_replace({TX}, '[^\x20-\x7E\n\r\t]', '', 'g')", S.strip_unprintable)
over_text("str_norm_whitespace", rf"regexp_replace(regexp_replace({TX}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')", S.normal_white)
over_text("str_dos2unix", f"replace(replace({TX}, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))", lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("\r\n")), F.lit("\r\n"), F.lit("\n")))
over_text("str_split_sentences", f"CAST(len(regexp_extract_all({TX}, '[^.!]+[.!]')) AS INT)", lambda c: F.size(S.sentences(c)))
over_text("str_split_delim", f"array_to_string(list_transform(string_split({TX}, ','), lambda x: trim(x)), chr(10))", lambda c: F.array_join(F.transform(F.split(c, ","), lambda x: F.trim(x)), "\n"))
over_text("str_contains_script", rf"regexp_matches({TX}, '[\x{{0400}}-\x{{04FF}}]') OR regexp_matches({TX}, '[\x{{0600}}-\x{{06FF}}]') OR regexp_matches({TX}, '[\x{{4E00}}-\x{{9FFF}}]')", lambda c: c.rlike(r"[\x{0400}-\x{04FF}]") | c.rlike(r"[\x{0600}-\x{06FF}]") | c.rlike(r"[\x{4E00}-\x{9FFF}]"))
over_text("str_ascii_ratio", rf"round(CASE WHEN length(regexp_replace({TX}, '[^\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace({TX}, '[^A-Za-z]', '', 'g')) / length(regexp_replace({TX}, '[^\p{{L}}]', '', 'g')) END, 6)", lambda c: F.round(S.ascii_ratio(c), 6))
LICENSE = "Licensed under the Apache License, Version 2.0."
over_text("str_remove_multiline", rf"regexp_replace({TX}, '(?i)licensed[ \n]+under[ \n]+the[ \n]+apache[ \n]+license,[ \n]+version[ \n]+2[.]0[.]', '', 'g')", lambda c: F.regexp_replace(c, r"(?i)licensed[ \n]+under[ \n]+the[ \n]+apache[ \n]+license,[ \n]+version[ \n]+2[.]0[.]", ""))
over_text("str_remove_info_block", rf"regexp_replace({TX}, '(?im)^(author|email|license[d]?)\b[^\n]*\n?', '', 'g')", lambda c: F.regexp_replace(c, r"(?im)^(author|email|license[d]?)\b[^\n]*\n?", ""))
over_text("str_strip_timestamps", f"regexp_replace({TX}, '[0-9]{{2,4}}[-_:/ ]?[0-9]{{2}}[-_:/ ]?[0-9]{{2,4}}', '', 'g')", lambda c: F.regexp_replace(c, "[0-9]{2,4}[-_:/ ]?[0-9]{2}[-_:/ ]?[0-9]{2,4}", ""))
over_text("str_hex_colors", f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({TX}, '[0-9a-f]{{6}}'), lambda x: '#' || x))), ',')", lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[0-9a-f]{6}"), F.lit(0)), lambda x: F.concat(F.lit("#"), x)))), ","))
over_text("str_base64_find", f"CAST(len(regexp_extract_all({TX}, '[A-Za-z0-9+/]{{24,}}={{0,2}}')) AS INT)", lambda c: F.size(F.regexp_extract_all(c, F.lit("[A-Za-z0-9+/]{24,}={0,2}"), F.lit(0))))


def raw_bytes(c):
    """Texts as files may hold them: in ISO-8859-1 where that has all their characters, else in UTF-8."""
    return F.when(c.rlike(r"(?s)\A[\x00-\x{FF}]*+\z"), F.encode(c, "ISO-8859-1")).otherwise(F.encode(c, "UTF-8"))


over_text("str_decode_fallback", TX, lambda c: S.decoded(raw_bytes(c)))
over_text("str_normalize_line", "", S.normalize_line)
over_text("str_wrap_sentence", "", S.wrap_sentences)


def comments_sql(text: str, name: str) -> str:
    """SQL that takes out a language's comments; the other engine's expressions never go back, so they have no marks for that."""
    pattern = f"({X.strings_pattern(name)})|{X.comments_pattern(name)}".replace("++", "+").replace("*+", "*").replace("'", "''")
    return rf"regexp_replace({text}, '{pattern}', '\1', 'g')"


over_text("str_comment_strip", comments_sql(TX, "shell"), lambda c: X.without_comments(c, "shell"))
query("str_comment_strip_c", f"SELECT page_id, {comments_sql('html', 'c')} AS value FROM pages")(lambda spark, d: load(spark, d, "pages").select("page_id", X.without_comments(F.col("html"), "c").alias("value")))
query("str_comment_strip_nested")(lambda spark, d: docs(spark, d).select("doc_id", X.without_comments(text(), "rust").alias("value")))
over_text("str_code_strip", "", S.strip_python)
over_text("sink_html_md", "", S.markdown_html)
over_text("hash_sha256", f"sha256({TX})", lambda c: F.sha2(c, 256))
over_text("hash_md5_sha1_blake", f"md5({TX}) || ':' || sha1({TX})", lambda c: F.concat_ws(":", F.md5(c), F.sha1(c)))
over_text("hash_blake2b", "", S.blake2b)
over_text("hash_xxh64", "", S.xxh64)
over_text("json_blob_encode", f"'{{\"__blob_base64\":\"' || base64(encode({TX})) || '\"}}'", lambda c: F.to_json(F.struct(F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit("")).alias("__blob_base64"))))
over_text("math_hex", f"lower(hex(length({TX}))) || '/' || CAST(length({TX}) % 256 AS VARCHAR)", lambda c: F.concat_ws("/", F.lower(F.hex(F.char_length(c))), F.pmod(F.conv(F.hex(F.char_length(c)), 16, 10).cast("int"), F.lit(256)).cast("string")))




READABLE = f"""WITH d AS (SELECT doc_id, {TX} AS t, regexp_extract_all(lower({TX}), '{S.LETTERS}') AS a FROM documents),
s AS (SELECT *, list_transform(a, lambda x: greatest(1, len(regexp_extract_all(x, '{S.VOWELS}')))) AS v FROM d),
k AS (SELECT doc_id, greatest(1, len(regexp_extract_all(t, '[.!?]+'))) AS sentences, len(a) AS words, CAST(coalesce(list_sum(v), 0) AS BIGINT) AS syllables, CAST(coalesce(list_sum(list_transform(a, lambda x: length(x))), 0) AS BIGINT) AS letters, len(list_filter(a, lambda x: length(x) >= 7)) AS long_words, len(list_filter(v, lambda x: x >= 3)) AS hard_words FROM s),
f AS (SELECT *, sentences::DOUBLE AS n, nullif(words, 0)::DOUBLE AS w, syllables::DOUBLE AS y, letters::DOUBLE AS c, long_words::DOUBLE AS lw, CASE WHEN words > 0 THEN hard_words::DOUBLE END AS hw FROM k)
SELECT doc_id, sentences, words, syllables, letters, long_words, hard_words, floor((206.835::DOUBLE - 1.015::DOUBLE * w / n - 84.6::DOUBLE * y / w) * 10000 + 0.5) / 10000 AS flesch, floor((0.39::DOUBLE * w / n + 11.8::DOUBLE * y / w - 15.59::DOUBLE) * 10000 + 0.5) / 10000 AS kincaid,
floor((1.043::DOUBLE * sqrt(30 * hw / n) + 3.1291::DOUBLE) * 10000 + 0.5) / 10000 AS smog, floor((5.88::DOUBLE * c / w - 29.6::DOUBLE * n / w - 15.8::DOUBLE) * 10000 + 0.5) / 10000 AS coleman_liau, floor((4.71::DOUBLE * c / w + 0.5::DOUBLE * w / n - 21.43::DOUBLE) * 10000 + 0.5) / 10000 AS automated,
floor((0.4::DOUBLE * (w / n + 100 * hw / w)) * 10000 + 0.5) / 10000 AS fog, floor(((w + 2 * hw) / n / 2 - CASE WHEN (w + 2 * hw) / n <= 20 THEN 1 ELSE 0 END) * 10000 + 0.5) / 10000 AS linsear, floor((w / n + 100 * lw / w) * 10000 + 0.5) / 10000 AS lix, floor((206.84::DOUBLE - 60 * y / w - 1.02::DOUBLE * w / n) * 10000 + 0.5) / 10000 AS fernandez_huerta,
floor((206.835::DOUBLE - 62.3::DOUBLE * y / w - w / n) * 10000 + 0.5) / 10000 AS szigriszt, floor((95.2::DOUBLE - 9.7::DOUBLE * c / w - 0.35::DOUBLE * w / n) * 10000 + 0.5) / 10000 AS gutierrez, floor(({-0.205 * 100!r}::DOUBLE * n / w + {0.049 * 100!r}::DOUBLE * y / w - 3.407::DOUBLE) * 10000 + 0.5) / 10000 AS crawford, floor((89 + (300 * n - 10 * c) / w) * 10000 + 0.5) / 10000 AS gulpease FROM f"""


@query("str_readability", READABLE)
def _(spark, d):
    return docs(spark, d).select("doc_id", S.readability(text()).alias("r")).select("doc_id", "r.*")


CHUNKS = f"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS n, 0 AS num, '' AS chunk, {TX} AS rest FROM documents UNION ALL
SELECT doc_id, k, num + 1, substr(rest, 1, k), substr(rest, k + 1) FROM (SELECT doc_id, num, rest, CASE WHEN length(rest) <= 4990 THEN length(rest)
WHEN regexp_matches(substr(rest, 4901, 90), '[.!?]') THEN 4990 - length(regexp_extract(substr(rest, 4901, 90), '[^.!?]*$'))
WHEN contains(substr(rest, 2, 4989), ' ') THEN 4990 - length(regexp_extract(substr(rest, 2, 4989), '[^ ]*$')) ELSE 4990 END AS k FROM c WHERE rest <> ''))
SELECT doc_id, CAST(num - 1 AS INT) AS num, chunk FROM c WHERE num > 0"""


@query("str_chunk_chars", CHUNKS)
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(S.chunk_chars(text())).alias("num", "chunk"))


@query("str_clean_stem", "SELECT p_partkey, replace(trim(regexp_replace(regexp_replace(s, '_[0-9]+$', ''), ' ?\\([0-9]+\\)$', '')), ' ', '_') AS value FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '_' || p_size ELSE p_name || ' (' || p_size || ')' END AS s FROM part)")
def _(spark, d):
    s = F.when(F.col("p_size") % 2 == 0, F.concat_ws("_", "p_name", F.col("p_size").cast("string"))).otherwise(F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")))
    return load(spark, d, "part").select("p_partkey", S.clean_stem(s).alias("value"))


@query("str_slug", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS value, substr(sha256(url), 1, 10) AS key FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", S.slug(F.col("url")).alias("value"), F.substring(F.sha2("url", 256), 1, 10).alias("key"))


SIZE = "CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END"


@query("str_format_size", f"SELECT l_orderkey, l_linenumber, {SIZE} AS value FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS n FROM lineitem)")
def _(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.format_size(F.floor("l_extendedprice").cast("double")).alias("value"))


@query("str_parse_size", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN p_retailprice * 1024 ELSE p_retailprice / 1024 END, 4) AS value FROM part")
def _(spark, d):
    s = F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.when(F.col("p_size") % 2 == 0, " GiB").otherwise(" KB"))
    return load(spark, d, "part").select("p_partkey", F.round(S.parse_size(s), 4).alias("value"))


#: English function words, which don't count.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
PLAIN_TEXT = f"trim(regexp_replace({TX}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
FREQ = f"""WITH t AS (SELECT doc_id, {PLAIN_TEXT} AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(string_split(x, ' ')) > 2) AS a FROM t),
s AS (SELECT doc_id, len(a) AS n, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS sentence FROM a WHERE len(a) > 1),
w AS (SELECT doc_id, pos, word FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS word FROM s) WHERE word NOT IN ({', '.join(repr(w) for w in STOP)})),
f AS (SELECT doc_id, word, count(*) AS c FROM w GROUP BY doc_id, word),
r AS (SELECT doc_id, pos, CAST(sum(c) AS DOUBLE) / count(*) AS score FROM w JOIN f USING (doc_id, word) GROUP BY doc_id, pos),
k AS (SELECT doc_id, pos, sentence, n, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, pos) AS rn FROM s LEFT JOIN r USING (doc_id, pos)),
b AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM k WHERE rn <= greatest(1, floor(n * CAST(0.3 AS DOUBLE))) GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(a) > 1 THEN summary ELSE t END AS summary FROM a LEFT JOIN b USING (doc_id)"""


@query("str_summarize_freq", FREQ)
def _(spark, d):
    """The three tenths of the sentences whose words, but for function words, are most frequent in the document, in their order; a text of one sentence or none stays."""
    plain = F.trim(F.regexp_replace(text(), r"[\x20\x09-\x0D]+", " "))
    found = F.filter(F.split(F.regexp_replace(plain, "([.!?]) ", "$1\x01"), "\x01"), lambda x: F.size(F.split(x, " ")) > 2)
    t = docs(spark, d).select("doc_id", plain.alias("t"), found.alias("a"))
    places = S.frequent_sentences(STOP)(F.when(F.size("a") > 1, F.transform("a", F.lower)))
    kept = t.select("doc_id", "t", "a", places.alias("places"))
    return kept.select("doc_id", F.when(F.size("a") > 1, F.array_join(F.transform("places", lambda k: F.get("a", k)), " ")).otherwise(F.col("t")).alias("summary"))


over_text("str_summarize_lexrank", "", S.lexrank)
over_text("str_summarize_textrank", "", S.textrank)
over_text("str_summarize_lsa", "", S.lsa)


# ---- html and urls ----


def pages(spark, d):
    return load(spark, d, "pages")


@query("str_html_strip", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS text FROM pages")
def _(spark, d):
    c = F.col("html")
    for p in ("(?s)<script.*?</script>", "(?s)<style.*?</style>", "<[^>]*>"):
        c = F.regexp_replace(c, p, " ")
    return pages(spark, d).select("page_id", c.alias("text"))


@query("str_html_comments", "SELECT page_id, regexp_replace(html, '(?s)<!--[^\\[].*?-->', '', 'g') AS html FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", F.regexp_replace("html", r"(?s)<!--[^\[].*?-->", "").alias("html"))


@query("str_html_remove_tag")
def _(spark, d):
    return pages(spark, d).select("page_id", S.remove_elements("html").alias("html"))


@query("url_extract", "SELECT page_id, unnest(list_transform(regexp_extract_all(html || ' ' || url, 'https?://[^ \"<>]+'), lambda x: rtrim(x, '.,;:!?)'))) AS u FROM pages")
def _(spark, d):
    found = F.regexp_extract_all(F.concat_ws(" ", "html", "url"), F.lit('https?://[^ "<>]+'), F.lit(0))
    return pages(spark, d).select("page_id", F.explode(found).alias("u")).select("page_id", F.regexp_replace("u", "[.,;:!?)]+$", "").alias("u"))


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


@query("url_normalize_basic", f"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || rtrim({PATH}, '/') || regexp_extract(url, '([?][^#]*)', 1) AS u FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", U.normal_basic(F.col("url")).alias("u"))


@query("url_normalize_root", f"SELECT page_id, array_to_string(list_concat([{HOST}], list_filter(string_split({PATH}, '/'), lambda x: x <> '')[1:1]), '/') AS u FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", U.root(F.col("url")).alias("u"))


QUERY, FRAGMENT = "regexp_extract(url, '([?][^#]*)', 1)", "regexp_extract(url, '(#.*)$', 1)"


@query("url_normalize_full", f"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || {QUERY} || {FRAGMENT} AS u, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || {FRAGMENT} AS filtered FROM pages")
def _(spark, d):
    """The whole normal form, and the same with only the parameters that say what a page is; the pages' hosts have none such."""
    return pages(spark, d).select("page_id", U.normal_full("url").alias("u"), U.normal_filtered("url").alias("filtered"))


@query("url_humanize")
def _(spark, d):
    return pages(spark, d).select("page_id", U.humanize("url").alias("u"))


@query(
    "url_classify_git",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '/issues/[0-9]+') THEN 'issue' WHEN regexp_matches(url, '/pull/[0-9]+') THEN 'pull' WHEN contains(url, '/releases') THEN 'release' WHEN regexp_matches(url, '/raw/|^https?://raw\.') THEN 'raw'
    WHEN regexp_matches(url, '\.git$') THEN 'clone' WHEN regexp_matches(url, '^https?://[^/]+/[^/?#]+/[^/?#]+/?$') THEN 'repo' ELSE 'other' END AS kind FROM pages""",
)
def _(spark, d):
    return pages(spark, d).select("page_id", U.classify(F.col("url")).alias("kind"))


@query("url_distinct_hosts", f"SELECT {HOST} AS host, min(page_id) AS first FROM pages GROUP BY 1")
def _(spark, d):
    return pages(spark, d).groupBy(U.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("first"))


@query("url_links_from_html", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@query("agg_shortest_per_root", f"SELECT {HOST} AS root, min((length(url), url))[2] AS url FROM pages GROUP BY 1")
def _(spark, d):
    return pages(spark, d).groupBy(U.host(F.col("url")).alias("root")).agg(F.min(F.struct(F.char_length("url").alias("n"), "url")).alias("m")).select("root", "m.url")


@query("filter_url_drop_images", r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '\.(jpe?g|png|svg|gif|webp)')")
def _(spark, d):
    return pages(spark, d).filter(~F.col("url").rlike(r"\.(jpe?g|png|svg|gif|webp)")).select("page_id", "url")


@query("sink_partition_by_ext", f"SELECT CASE WHEN regexp_extract({PATH}, '/([a-z]+)/', 1) IN ('en', 'de', 'fr', 'es') THEN regexp_extract({PATH}, '/([a-z]+)/', 1) ELSE 'rest' END AS ext, count(*) AS cnt FROM pages GROUP BY 1")
def _(spark, d):
    ext = F.regexp_extract(U.part(F.col("url"), 3), "/([a-z]+)/", 1)
    return pages(spark, d).groupBy(F.when(ext.isin("en", "de", "fr", "es"), ext).otherwise("rest").alias("ext")).agg(F.count("*").alias("cnt"))


# ---- time ----

SRT = "printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"


@query("time_srt_shift", f"SELECT event_id, {SRT} AS value FROM (SELECT event_id, greatest(event_id * 1234 % 86400000 - 2500, 0) AS ms FROM events)")
def _(spark, d):
    at = T.ms_srt((F.col("event_id") * 1234) % 86400000)
    return load(spark, d, "events").select("event_id", T.shift_srt(at, -2500).alias("value"))


@query("time_srt_parse", "SELECT event_id, (event_id * 1234 % 86400000) / 1000.0 AS start, event_id * 1234 % 86400000 / 1000.0 + 1.5 AS stop FROM events")
def _(spark, d):
    at = T.srt_ms(T.ms_srt((F.col("event_id") * 1234) % 86400000)) / F.lit(1000.0)
    return load(spark, d, "events").select("event_id", at.alias("start"), (at + 1.5).alias("stop"))


@query("str_srt_to_text", "SELECT doc_id, array_to_string(list_filter(list_transform(" + ARR + ", lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), lambda x: NOT regexp_matches(x, '^[0-9]*$') AND NOT contains(x, '-->')), chr(10)) AS text FROM documents")
def _(spark, d):
    rows = F.transform(L.split_lines(F.col("text")), lambda x: F.regexp_replace(x, "<[^>]*>", ""))
    return docs(spark, d).select("doc_id", F.array_join(F.filter(rows, lambda x: ~x.rlike("^[0-9]*$") & ~x.contains("-->")), "\n").alias("text"))


AGE = ", ".join(f"CASE WHEN {e} > 0 THEN CAST({e} AS VARCHAR) || ' {u}' END" for e, u in (("s // 31536000", "y"), ("s % 31536000 // 2592000", "m"), ("s % 31536000 % 2592000 // 86400", "d"), ("s % 31536000 % 2592000 % 86400 // 3600", "h"), ("s % 31536000 % 2592000 % 86400 % 3600 // 60", "min"), ("s % 31536000 % 2592000 % 86400 % 60", "sec")))


@query("time_age_units", f"SELECT event_id, concat_ws(', ', {AGE}) AS value FROM (SELECT event_id, event_id * 7777 AS s FROM events)")
def _(spark, d):
    return load(spark, d, "events").select("event_id", T.age_units(F.col("event_id") * 7777).alias("value"))


@query("time_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS value FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("value"))


@query("time_cutoff", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _(spark, d):
    e = load(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).filter("ts >= last - INTERVAL 1 DAY").select("event_id")


@query("time_ttl_cache", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') < 365 AS valid FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", (F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate")) < 365).alias("valid"))


JALALI = """WITH a AS (SELECT o_orderkey, date_diff('day', DATE '1600-01-01', CAST(o_orderdate AS DATE)) - 79 AS n FROM orders),
b AS (SELECT *, n // 12053 AS c, n % 12053 AS r FROM a), e AS (SELECT *, 979 + 33 * c + 4 * (r // 1461) AS y0, r % 1461 AS q FROM b),
f AS (SELECT o_orderkey, y0 + CASE WHEN q >= 366 THEN (q - 1) // 365 ELSE 0 END AS y, CASE WHEN q >= 366 THEN (q - 1) % 365 ELSE q END AS k FROM e)
SELECT o_orderkey, CAST(y AS BIGINT) AS year, CAST(CASE WHEN k < 186 THEN k // 31 + 1 ELSE (k - 186) // 30 + 7 END AS BIGINT) AS month, CAST(CASE WHEN k < 186 THEN k % 31 + 1 ELSE (k - 186) % 30 + 1 END AS BIGINT) AS day FROM f"""


@query("time_jalali", JALALI)
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", T.jalali(F.to_date("o_orderdate")).alias("j")).select("o_orderkey", "j.*")


@query("filter_age", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def _(spark, d):
    e = load(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("last")))).filter("ts >= last - INTERVAL 60 MINUTES").select("event_id")


@query("filter_same_day", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT min(CAST(o_orderdate AS DATE)) FROM orders)")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(F.broadcast(o.agg(F.min("day").alias("first")))).filter("day = first").select("o_orderkey")


GAP = "WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 30 AS t FROM events), f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type OR s - lag(t) OVER w > 600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, t)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, min(event_type) AS event_type, min(s) AS s, max(t) AS t, count(*) AS n FROM g GROUP BY user_id, island"


@query("win_gap_merge", GAP)
def _(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 30).alias("t"))
    return T.merge_gaps(e, "user_id", "s", "t", "event_type", 600.0)


# ---- maps and json ----


@query("map_to_rows", "SELECT o_orderkey, k, v FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS k, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders)")
def _(spark, d):
    m = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return load(spark, d, "orders").select("o_orderkey", F.explode(m).alias("k", "v"))


@query("arr_flatten_explode", f"SELECT doc_id, CAST(len(flatten(list_transform({ARR}, lambda x: string_split(x, ' ')))) AS INT) AS n FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.flatten(F.transform(L.split_lines(F.col("text")), lambda x: F.split(x, " ")))).alias("n"))


@query("project_lower_keys", "SELECT event_id, 'k' AS k, json_extract_string(props, '$.k') AS v FROM events")
def _(spark, d):
    m = F.from_json(F.regexp_replace("props", '"k"', '"K"'), "map<string,string>")
    return load(spark, d, "events").select("event_id", F.explode(F.transform_keys(m, lambda k, v: F.lower(k))).alias("k", "v"))


@query("project_keys", "SELECT event_id, unnest(json_keys(props)) AS k FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("k"))


@query("validate_schema", "SELECT event_id, CAST(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS BOOLEAN) AS valid FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", (F.schema_of_variant(F.try_parse_json(F.get_json_object("props", "$.k"))) == "BIGINT").alias("valid"))


@query("validate_json_dup_keys", "SELECT event_id, list_filter(['k'], lambda x: list_contains(json_keys(props), 'k')) AS repeated FROM events")
def _(spark, d):
    """Keys that objects have twice, here each with a `k` put before its own keys."""
    twice = F.concat(F.lit('{"k": 0, '), F.expr("substring(props, 2)"))
    return load(spark, d, "events").select("event_id", S.json_repeated_keys(twice).alias("repeated"))


@query("json_canonical", "SELECT count(DISTINCT props) AS n FROM events")
def _(spark, d):
    m = F.map_entries(F.from_json("props", "map<string,string>"))
    canon = F.to_json(F.map_from_entries(F.array_sort(m)))
    return load(spark, d, "events").agg(F.count_distinct(canon).alias("n"))


@query("agg_json_dup_values", "SELECT user_id, CAST(count(*) AS INT) AS before, CAST(count(DISTINCT event_type) AS INT) AS after FROM events GROUP BY user_id")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count("event_type").cast("int").alias("before"), F.count_distinct("event_type").cast("int").alias("after"))


@query("sort_map_by_value", "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY n, lang) AS sorted FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def _(spark, d):
    c = docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    m = c.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", "lang"))).alias("e"))
    return m.select("source", F.array_join(F.transform("e", lambda x: F.concat_ws("=", x["lang"], x["n"].cast("string"))), ",").alias("sorted"))


HUE = """WITH c AS (SELECT p_partkey, printf('#%06x', p_partkey * 7919 % 16777216) AS color FROM part),
v AS (SELECT *, CAST('0x' || substr(color, 2, 2) AS INT) / 255.0::DOUBLE AS r, CAST('0x' || substr(color, 4, 2) AS INT) / 255.0::DOUBLE AS g, CAST('0x' || substr(color, 6, 2) AS INT) / 255.0::DOUBLE AS b FROM c),
m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM v),
x AS (SELECT p_partkey, color, round(60 * CASE WHEN d = 0 THEN 0 WHEN t = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN t = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END, 4) AS h, round(CASE WHEN t = 0 THEN 0 ELSE d / t END, 4) AS s, round(t, 4) AS v FROM m)
SELECT * FROM x"""


@query("sort_hue", HUE)
def _(spark, d):
    color = F.format_string("#%06x", F.pmod(F.col("p_partkey") * 7919, F.lit(16777216)))
    p = load(spark, d, "part").select("p_partkey", color.alias("color")).filter(F.col("color").rlike("^#[0-9a-f]{6}$"))
    return L.sort_all(p.withColumn("hsv", S.hsv(F.col("color"))), "hsv", "p_partkey").select("p_partkey", "color", "hsv.*")
