"""Queries on documents, benchmark passages and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gritstone.functions import text as T
from gritstone.operators import search
from gritstone.sources.tables import latest, table

from .catalogue import query


def _norm_sql(column: str) -> str:
    for pattern, to in T.UNMARK:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92)).replace(chr(39), chr(39) * 2)}', 'g')"
    return f"lower(trim({column}))"


_TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda t: length(t) > 1)"


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {_norm_sql('text')} AS body FROM documents) d, (SELECT item_id, {_norm_sql('text')} AS passage FROM benchmark) b WHERE length(passage) >= 12 AND contains(body, passage)")
def q_verbatim_audit(spark: SparkSession, d: str) -> DataFrame:
    return search.contained(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query(f"SELECT item_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT item_id, {_norm_sql('text')} AS n FROM benchmark)")
def q_norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.norm(F.col("text")).alias("n")).select("item_id", F.length("n").alias("n_chars"), F.md5("n").alias("digest"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 5")
def q_tokens_df(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).filter("df >= 5")


@query(f"SELECT lang, count(*) AS n_docs, sum(n) AS n_tokens, round(avg(n), 6) AS avg_length, max(n) AS longest FROM (SELECT lang, len({_TOKENS.format('text')}) AS n FROM documents) GROUP BY lang")
def q_doc_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(T.tokens(F.col("text")))
    return table(spark, d, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_length"), F.max("n").alias("longest"))


_BM25 = f"""
 words AS (SELECT doc_id, lang, {_TOKENS.format('text')} AS w FROM documents),
 total AS (SELECT count(*) AS n, avg(len(w)) AS avg_length FROM words),
 post AS (SELECT doc_id, lang, len(w) AS len, term, count(*) AS tf FROM (SELECT doc_id, lang, w, unnest(w) AS term FROM words) GROUP BY ALL),
 asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark)),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 scores AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_length))) AS score
   FROM post JOIN dfs USING (term) JOIN asked USING (term), total {{where}} GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM scores)"""


@query(f"WITH {_BM25.replace('{where}', '')} SELECT item_id, doc_id, rank, round(score, 3) AS score FROM ranked WHERE rank <= 5")
def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = search.bm25_top(table(spark, d, "documents"), table(spark, d, "benchmark"), 5)
    return top.select("item_id", "doc_id", "rank", F.round("score", 3).alias("score"))


@query(f"WITH {_BM25.replace('{where}', '')} SELECT item_id, doc_id, rank, round(score, 3) AS score FROM ranked WHERE rank <= 10")
def q_bm25_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking without scoring what can't get in; for many documents and questions, where common words would pair nearly all of them."""
    top = search.bm25_top(table(spark, d, "documents"), table(spark, d, "benchmark"), 10)
    return top.select("item_id", "doc_id", "rank", F.round("score", 3).alias("score"))


@query(f"WITH {_BM25.replace('{where}', "WHERE lang = 'en'")} SELECT item_id, doc_id, rank, round(score, 3) AS score FROM ranked WHERE rank <= 5")
def q_bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    top = search.bm25_top(table(spark, d, "documents"), table(spark, d, "benchmark"), 5, F.col("lang") == "en")
    return top.select("item_id", "doc_id", "rank", F.round("score", 3).alias("score"))


@query(f"""WITH {_BM25.replace('{where}', '')}, held AS (SELECT item_id, doc_id FROM (SELECT doc_id, {_norm_sql('text')} AS body FROM documents) d, (SELECT item_id, {_norm_sql('text')} AS passage FROM benchmark) b WHERE length(passage) >= 12 AND contains(body, passage)),
 best AS (SELECT item_id, min(rank) AS rank FROM held LEFT JOIN (SELECT * FROM ranked WHERE rank <= 30) r USING (item_id, doc_id) GROUP BY item_id)
 SELECT count(*) AS cases, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1.0 / rank END), 6) AS mrr, count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10, count(*) FILTER (rank <= 20) AS hit_20, count(*) FILTER (rank <= 30) AS hit_30 FROM best""")
def q_retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    top = search.bm25_top(docs, items, 30).select("item_id", "doc_id", "rank")
    best = search.contained(docs, items).join(top, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("rank"))
    hits = [F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in (5, 10, 20, 30)]
    return best.agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), *hits)


@query(f"SELECT doc_id, item_id, count(*) AS n_terms FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) JOIN (SELECT DISTINCT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) USING (term) GROUP BY ALL")
def q_term_coverage(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    own = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return own.join(search.light(asked), "term").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_terms"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, array_to_string({_TOKENS.format('text')}, ' ') ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def q_copy_suppression(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", "source", F.sha1(F.array_join(T.tokens(F.col("text")), " ")).alias("key"))
    first = keyed.groupBy("source", "key").agg(F.min("doc_id").alias("first"))  # summed up before the shuffle: a group of copies is one row a task
    return keyed.join(first, ["source", "key"]).filter("doc_id > first").select("doc_id", "source")


@query("SELECT doc_id, lang, n FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR))) AS n FROM documents) WHERE n <= 10")
def q_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.sha1(F.col("doc_id").cast("string").cast("binary")))
    return table(spark, d, "documents").select("doc_id", "lang", F.row_number().over(w).alias("n")).filter("n <= 10")


@query("SELECT doc_id, i AS window_no, substr(text, i * 1400 + 1, 2000) AS body FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 2000) / 1400.0) AS INTEGER)))) AS i FROM documents WHERE length(text) > 0)")
def q_windows(spark: SparkSession, d: str) -> DataFrame:
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - 2000) / 1400.0).cast("int"))
    docs = table(spark, d, "documents").filter("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return docs.select("doc_id", "window_no", F.substring("text", F.col("window_no") * 1400 + 1, F.lit(2000)).alias("body"))


_BARE = "regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<svg[^>]*>.*?</svg>|<iframe[^>]*>.*?</iframe>', ' ', 'g')"
_DECODED = (
    "array_to_string(list_transform(string_split({0}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
    + " ".join(f"WHEN regexp_matches(p, '^(?i){n};') THEN '{c.replace(chr(39), chr(39) * 2)}' || substr(p, {len(n) + 2})" for n, c in T.ENTITIES.items())
    + " WHEN regexp_matches(p, '^#[0-9]+;') THEN chr(CAST(regexp_extract(p, '^#([0-9]+);', 1) AS INTEGER)) || regexp_replace(p, '^#[0-9]+;', '') ELSE '&' || p END), '')"
)
_TIDY = "trim(regexp_replace(" + _DECODED.replace("{0}", "regexp_replace({0}, '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


def _element_sql(tag: str) -> str:
    return _TIDY.replace("{0}", f"regexp_extract({_BARE.replace('{0}', 'html')}, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)")


def lines_sql(html: str) -> str:
    s = _BARE.replace("{0}", html)
    for pattern, to in ((r"(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table|title)>|<br[^>]*>", "chr(10)"), ("(?i)</t[dh]>", "' | '"), ("<[^>]*>", "' '")):
        s = f"regexp_replace({s}, '{pattern}', {to}, 'g')"
    s = f"regexp_replace({_DECODED.replace('{0}', s)}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"list_filter(list_transform(string_split({s}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""SELECT page_id, {_element_sql('title')} AS title, {_element_sql('h1')} AS h1, {_TIDY.replace('{0}', "regexp_extract(html, '(?i)<meta[^>]+name=.description.[^>]+content=.([^<>]*?)[^<>/]/?>', 1)")} AS description FROM pages""")
def q_html_meta(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", T.element(T.bare(html), "title").alias("title"), T.element(T.bare(html), "h1").alias("h1"), T.description(html).alias("description"))


@query(f"""WITH p AS (SELECT page_id, lower({_element_sql('title')} || ' ' || {_element_sql('h1')}) AS head, {lines_sql('html')} AS l FROM pages)
 SELECT page_id, len(l) AS n_lines, regexp_matches(head, '{T.GONE_TITLE}') OR (length(array_to_string(l, chr(10))) < 400 AND regexp_matches(array_to_string(l, chr(10)), '{T.GONE_TEXT}')) AS soft_404 FROM
 (SELECT page_id, head, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS l FROM p)""")
def q_soft404(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(T.lines(html)).alias("n_lines"), T.soft_404(html).alias("soft_404"))


@query(rf"""WITH m AS (SELECT page_id, url, regexp_extract_all({_BARE.replace('{0}', 'html')}, '(?is)<a\b[^>]*\bhref=["'']([^"'']+)["''][^>]*>(.*?)</a>', 0) AS found FROM pages),
 e AS (SELECT page_id, url AS base, unnest(found) AS a, unnest(range(len(found))) AS pos FROM m),
 h AS (SELECT page_id, base, pos, regexp_replace(trim({_DECODED.replace('{0}', "regexp_extract(a, '(?is)<a\\b[^>]*\\bhref=[\"'']([^\"'']+)[\"'']', 1)")}), '#.*$', '') AS own,
  nullif(left({_TIDY.replace('{0}', "regexp_extract(a, '(?is)^<a[^>]*>(.*?)</a>', 1)")}, 200), '') AS title FROM e),
 f AS (SELECT page_id, pos, title, regexp_replace(CASE WHEN regexp_matches(own, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN own WHEN own LIKE '//%' THEN regexp_extract(base, '^[a-zA-Z]+:') || own WHEN own LIKE '/%' THEN regexp_extract(base, '^[a-zA-Z]+://[^/?#]*') || own
  WHEN own LIKE '?%' THEN regexp_extract(base, '^[^?#]*') || own ELSE regexp_extract(base, '^[a-zA-Z]+://[^/?#]*') || coalesce(nullif(regexp_extract(base, '^[a-zA-Z]+://[^/?#]*([^?#]*/)', 1), ''), '/') || own END, '^(https?://[^/?]+)(\?.*)?$', '\1/\2') AS url FROM h WHERE own <> '')
 SELECT page_id, pos, url, title FROM f WHERE regexp_matches(url, '^(?i)https?://') QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1""")
def q_anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.inline(T.anchors(F.col("html"), F.col("url")))).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url", "title")


@query(r"""SELECT page_id, CASE WHEN origin = '' THEN url ELSE lower(origin) || coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS url FROM
 (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+([^?#]*)', 1) AS path,
 array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_|fbclid|gclid)')), '&') AS q FROM pages)""")
def q_url_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.clean_url(F.col("url")).alias("url"))


@query(r"""SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1""")
def q_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(r"""SELECT page_id, 2 * CAST(regexp_matches(url, '/(en|fr)/') AS INTEGER) + CAST(regexp_matches(url, 'https') AS INTEGER) + 8 * CAST(NOT regexp_matches(url, '[0-9]') AS INTEGER) - 6 * CAST(regexp_matches(url, 'page=') AS INTEGER) AS score FROM pages""")
def q_url_score(spark: SparkSession, d: str) -> DataFrame:
    has = lambda p: F.col("url").rlike(p).cast("int")
    return table(spark, d, "pages").select("page_id", (2 * has("/(en|fr)/") + has("https") + 8 * (1 - has("[0-9]")) - 6 * has("page=")).alias("score"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, count(*) OVER (PARTITION BY conv_id, role) AS role_turns FROM conversations")
def q_turn_sequence(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("seq"), F.count("*").over(Window.partitionBy("conv_id", "role")).alias("role_turns"))


@query("SELECT lang, source, reason, count(*) AS n FROM (SELECT lang, source, CASE WHEN text IS NULL OR text = '' THEN 'EMPTY' WHEN length(text) < 100 THEN 'SHORT' WHEN n_chars <> length(text) THEN 'LENGTH' WHEN text LIKE '%!!%' THEN 'SHOUTING' WHEN text LIKE '% | %' THEN 'TABLE' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY ALL")
def q_rejection_tally(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    reason = F.when(t.isNull() | (t == ""), "EMPTY").when(F.length(t) < 100, "SHORT").when(F.col("n_chars") != F.length(t), "LENGTH").when(t.contains("!!"), "SHOUTING").when(t.contains(" | "), "TABLE")
    return table(spark, d, "documents").withColumn("reason", reason).filter("reason is not null").groupBy("lang", "source", "reason").agg(F.count("*").alias("n"))


@query("SELECT host, max_by(page_id, page_id) AS last_page, max(url) AS url FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) ORDER BY page_id DESC) AS n FROM pages) WHERE n = 1 GROUP BY host")
def q_page_hash_ledger(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1).alias("host"))
    return latest(pages, ["host"], [F.desc("page_id")]).select("host", F.col("page_id").alias("last_page"), "url")
