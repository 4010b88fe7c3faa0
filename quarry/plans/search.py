"""Queries over the index: postings, dictionary, segments, retrieval, BM25F, fusion and the cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numbers import sql_round
from quarry.operators import index, rank
from quarry.operators.ordered import new_path, places
from quarry.plans.registry import Tables, query

TERMS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
POSTINGS = f"postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY ALL)"
DICTIONARY = "terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf, count(*) = 1 AS singleton FROM postings GROUP BY term)"
BLOCKS = "blocks AS (SELECT term, (p // 128)::BIGINT AS block, min(doc_id) AS first_doc, max(doc_id) AS last_doc, max(tf) AS max_tf, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS p FROM postings) GROUP BY term, p // 128)"
QUERY_TERMS = ("eren", "thing", "retion")
VALUES = ", ".join(f"('{t}')" for t in QUERY_TERMS)
TARGETS = ", ".join(f"('{t}', {d})" for t in ("eren", "the", "thing") for d in (0, 37, 150, 5000))
TARGET_TERMS = ("eren", "the", "thing")
DELETES = "deletes AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"
WEIGHTS = "('eren', 1.5), ('thing', 1.0), ('retion', 2.0), ('the', 0.25)"


_sealed: dict[tuple, index.Sealed] = {}


def sealed(t: Tables) -> index.Sealed:
    """The documents' index, sealed in the shared folder once for an application and these files."""
    docs = t.documents
    key = (t.spark.sparkContext.applicationId, t.sf_dir, tuple(sorted(docs.inputFiles())))
    if key not in _sealed:
        _sealed[key] = index.seal(docs, new_path(t.spark, "index"), ("source", "n_chars", "text"))
    return _sealed[key]


def posts(t: Tables) -> DataFrame:
    return sealed(t).postings.select("doc_id", "term", "tf")


def deletes(t: Tables) -> DataFrame:
    return t.labels.where("toxic = 1").select("doc_id").distinct()


@query("index_postings", f"WITH {POSTINGS} SELECT doc_id % 4 AS segment, doc_id, term, tf FROM postings")
def index_postings(t: Tables) -> DataFrame:
    return posts(t).select(F.pmod("doc_id", F.lit(4)).cast("long").alias("segment"), "doc_id", "term", "tf")


@query("term_dictionary", f"WITH {POSTINGS}, {DICTIONARY} SELECT * FROM terms")
def term_dictionary(t: Tables) -> DataFrame:
    return sealed(t).dictionary


@query("term_lookup", f"WITH {POSTINGS}, {DICTIONARY} SELECT * FROM terms WHERE term IN ('eren', 'thing', 'absent')")
def term_lookup(t: Tables) -> DataFrame:
    return index.lookup(sealed(t).dictionary, "eren", "thing", "absent")


@query("term_prefix_scan", f"WITH {POSTINGS}, {DICTIONARY} SELECT term, df FROM terms WHERE term LIKE 'ere%' ORDER BY term")
def term_prefix_scan(t: Tables) -> DataFrame:
    return index.prefix_scan(sealed(t).dictionary, "ere").select("term", "df")


@query("term_postings", f"WITH {POSTINGS} SELECT term, doc_id, tf, count(*) OVER (PARTITION BY term) AS df FROM postings WHERE term IN ('eren', 'thing', 'retion')")
def term_postings(t: Tables) -> DataFrame:
    wanted = index.lookup(posts(t), *QUERY_TERMS)
    return wanted.join(index.lookup(sealed(t).dictionary, *QUERY_TERMS).select("term", "df"), "term").select("term", "doc_id", "tf", "df")


@query("posting_iterate", f"WITH {POSTINGS} SELECT doc_id, tf FROM postings WHERE term = 'thing' ORDER BY doc_id")
def posting_iterate(t: Tables) -> DataFrame:
    return index.lookup(posts(t), "thing").orderBy("doc_id").select("doc_id", "tf")


@query("live_docs", f"WITH {DELETES} SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM deletes)")
def live_docs(t: Tables) -> DataFrame:
    return index.live(t.documents, deletes(t)).select("doc_id", "source", "n_chars")


@query("soft_delete", f"WITH {DELETES} SELECT doc_id % 4 AS segment, count(*) AS docs, count(d.doc_id) AS deleted FROM documents LEFT JOIN deletes d USING (doc_id) GROUP BY 1")
def soft_delete(t: Tables) -> DataFrame:
    gone = deletes(t).withColumn("gone", F.lit(1))
    return t.documents.join(gone, "doc_id", "left").groupBy(F.pmod("doc_id", F.lit(4)).cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("docs"), F.count("gone").alias("deleted"))


@query("segment_merge", f"WITH {DELETES} SELECT doc_id % 4 AS segment, doc_id, row_number() OVER (ORDER BY doc_id % 4, doc_id) - 1 AS new_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM deletes)")
def segment_merge(t: Tables) -> DataFrame:
    docs = t.documents.select(F.pmod("doc_id", F.lit(4)).cast("long").alias("segment"), "doc_id")
    return index.merge_segments(docs, deletes(t)).select("segment", "doc_id", "new_id")


SEGMENTS = "(1, 5000, 100), (2, 900, 10), (3, 80000, 2000), (4, 1500, 0), (5, 1500, 20), (6, 40, 1), (7, 7000, 50), (8, 3000, 3), (9, 60000, 70), (10, 2000, 5), (11, 1000, 9), (12, 100000, 0)"


@query("merge_policy_select", f"""WITH s AS (SELECT * FROM (VALUES {SEGMENTS}) v(segment, docs, deleted)), r AS (
  SELECT *, docs - deleted AS live, count(*) OVER () AS n, min(CASE WHEN deleted * 100 >= docs * 33 THEN segment END) OVER () AS heavy, row_number() OVER (ORDER BY greatest(docs - deleted, 2000), segment) AS rank FROM s)
SELECT segment, docs, deleted, CASE WHEN heavy IS NOT NULL THEN segment = heavy ELSE n >= 10 AND rank <= 10 AND coalesce((SELECT sum(b.live) FROM r b WHERE b.rank < r.rank), 0) < 50000000 END AS selected FROM r""")
def merge_policy_select(t: Tables) -> DataFrame:
    return index.merge_candidates(t.rows("segment, docs, deleted", SEGMENTS))


@query("posting_blocks", f"WITH {POSTINGS}, {BLOCKS} SELECT * FROM blocks")
def posting_blocks(t: Tables) -> DataFrame:
    return sealed(t).blocks.drop("cf")


@query("posting_list_stats", f"WITH {POSTINGS} SELECT term, count(*) AS n_docs, max(tf) AS max_freq FROM postings GROUP BY term")
def posting_list_stats(t: Tables) -> DataFrame:
    return sealed(t).dictionary.select("term", F.col("df").alias("n_docs"), F.col("max_tf").alias("max_freq"))


@query("posting_next_geq", f"WITH {POSTINGS}, targets AS (SELECT * FROM (VALUES {TARGETS}) v(term, target)) SELECT t.term, t.target, min(p.doc_id) FILTER (WHERE p.doc_id >= t.target) AS doc_id FROM targets t LEFT JOIN postings p USING (term) GROUP BY ALL")
def posting_next_geq(t: Tables) -> DataFrame:
    return index.next_at_or_after(index.lookup(sealed(t).postings, *TARGET_TERMS), index.lookup(sealed(t).blocks, *TARGET_TERMS), t.rows("term, target", TARGETS))


@query("block_max_lookup", f"""WITH {POSTINGS}, {BLOCKS}, targets AS (SELECT * FROM (VALUES {TARGETS}) v(term, target)), last AS (SELECT term, max(block) AS block FROM blocks GROUP BY term),
hit AS (SELECT t.term, t.target, coalesce(min(b.block) FILTER (WHERE b.last_doc >= t.target), max(b.block)) AS block FROM targets t JOIN blocks b USING (term) GROUP BY ALL)
SELECT h.term, h.target, h.block, b.last_doc, b.max_tf FROM hit h JOIN blocks b USING (term, block)""")
def block_max_lookup(t: Tables) -> DataFrame:
    return index.block_bounds(index.lookup(sealed(t).blocks, *TARGET_TERMS), t.rows("term, target", TARGETS))


WAND = f"WITH {POSTINGS}, q AS (SELECT * FROM (VALUES {WEIGHTS}) v(term, weight)) SELECT doc_id, sum(tf * weight::DOUBLE) AS score FROM postings JOIN q USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"


def weighted(t: Tables) -> DataFrame:
    return t.rows("term, weight", WEIGHTS).withColumn("weight", F.col("weight").cast("double"))


@query("wand_topk", WAND)
def wand_topk(t: Tables) -> DataFrame:
    return index.wand(sealed(t), weighted(t), 20)


@query("block_max_topk", WAND)
def block_max_topk(t: Tables) -> DataFrame:
    return index.block_max(sealed(t), weighted(t), 20)


# --- BM25

IDF = "ln(1 + (n - least(df, n) + 0.5) / (least(df, n) + 0.5))"
BM25 = f"""WITH {POSTINGS}, lengths AS (SELECT doc_id, len({TERMS.format("text")}) AS len FROM documents), stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM lengths),
q AS (SELECT unnest(['eren', 'thing', 'retion', 'thing']) AS term), dfs AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term),
eff AS (SELECT p.doc_id, p.term, p.tf / (0.25 + 0.75 * l.len / s.mean) AS eff FROM postings p JOIN lengths l USING (doc_id), stats s)"""


def bm25_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    found = sealed(t)
    lists = index.lookup(found.postings, *QUERY_TERMS).select("doc_id", F.lit("body").alias("field"), "term", "tf")
    pseudo = rank.pseudo_frequencies(lists, found.stored.select("doc_id", F.lit("body").alias("field"), F.col("length").alias("len")))
    wanted = t.rows("term", VALUES + ", ('thing')")
    df = index.lookup(sealed(t).dictionary, *QUERY_TERMS).select("term", "df")
    return pseudo, wanted, df, found.stored.count()


@query("bm25f_topk", BM25 + f", scored AS (SELECT doc_id, round(sum({IDF} * eff * 2.2 / (1.2 + eff)), 6) AS score FROM eff JOIN q USING (term) JOIN dfs USING (term), stats GROUP BY doc_id) SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10")
def bm25f_topk(t: Tables) -> DataFrame:
    pseudo, wanted, df, n = bm25_parts(t)
    scored = rank.bm25f(pseudo, wanted, df, n)
    return index.top_documents(scored.withColumn("score", sql_round("score", 6)), 10)


@query("bm25f_term_score", BM25 + f" SELECT doc_id, term, round({IDF} * eff * 2.2 / (1.2 + eff), 6) AS score FROM eff JOIN dfs USING (term), stats WHERE term IN ('eren', 'thing', 'retion')")
def bm25f_term_score(t: Tables) -> DataFrame:
    pseudo, _, df, n = bm25_parts(t)
    return pseudo.join(df, "term").select("doc_id", "term", sql_round(index.saturated(index.idf(n, F.col("df")), F.col("eff")), 6).alias("score"))


@query("bm25_idf", f"WITH {POSTINGS}, dfs AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term), stats AS (SELECT count(*)::DOUBLE AS n FROM documents) SELECT term, round({IDF}, 6) AS idf FROM dfs, stats")
def bm25_idf(t: Tables) -> DataFrame:
    return sealed(t).dictionary.select("term", sql_round(index.idf(sealed(t).stored.count(), F.col("df")), 6).alias("idf"))


@query("bm25_first_stage", f"WITH {POSTINGS}, dfs AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term), stats AS (SELECT count(*)::DOUBLE AS n FROM documents) SELECT doc_id, round(sum({IDF} * tf * 2.2 / (1.2 + tf)), 6) AS score FROM postings JOIN dfs USING (term), stats WHERE term IN ('eren', 'thing', 'retion') GROUP BY doc_id")
def bm25_first_stage(t: Tables) -> DataFrame:
    n = sealed(t).stored.count()
    wanted = index.lookup(posts(t), *QUERY_TERMS).join(index.lookup(sealed(t).dictionary, *QUERY_TERMS).select("term", "df"), "term")
    part = index.saturated(index.idf(n, F.col("df")), F.col("tf").cast("double"))
    return wanted.groupBy("doc_id").agg(sql_round(F.sum(part), 6).alias("score"))


def page_fields(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Title, address and visible text of pages; and a row for each link that points to one (by host and path), with its words."""
    html = F.col("html")
    body = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    pages = t.pages.select(F.col("page_id").alias("doc_id"), F.col("url"), F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"), body.alias("body"), "html")
    host, path = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    links = pages.select(host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('(?s)<a href="([^"]*)">([^<]*)</a>'), F.lit(0))).alias("a"))
    links = links.select("host", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("path"), F.regexp_extract("a", ">([^<]*)<", 1).alias("anchor"))
    anchors = links.join(pages.select("doc_id", host.alias("host"), path.alias("path")), ["host", "path"]).select("doc_id", "anchor")
    return pages.select("doc_id", "url", "title", "body"), anchors


FIELD_SQL = f"""WITH raw AS (SELECT page_id AS doc_id, url, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
  regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS body FROM pages),
links AS (SELECT host, regexp_extract(a, 'href="([^"]*)"', 1) AS path, regexp_extract(a, '>([^<]*)<', 1) AS anchor FROM (SELECT host, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">([^<]*)</a>')) AS a FROM raw)),
anchors AS (SELECT host, path, string_agg(anchor, ' ') AS anchor FROM links GROUP BY ALL),
fields AS (SELECT doc_id, unnest([{{'field': 'url', 'text': url}}, {{'field': 'title', 'text': title}}, {{'field': 'body', 'text': body}}, {{'field': 'anchor', 'text': coalesce(anchor, '')}}], recursive := true) FROM raw LEFT JOIN anchors USING (host, path)),
lengths AS (SELECT doc_id, field, len({TERMS.format("text")}) AS len FROM fields), means AS (SELECT field, avg(len) AS mean FROM lengths GROUP BY field),
fp AS (SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, field, unnest({TERMS.format("text")}) AS term FROM fields) GROUP BY ALL),
eff AS (SELECT doc_id, term, sum(CASE field WHEN 'body' THEN 1.0 WHEN 'title' THEN 3.0 WHEN 'anchor' THEN 2.0 ELSE 1.5 END * tf / (0.25 + 0.75 * len / CASE WHEN mean > 0 THEN mean ELSE 1 END)) AS eff FROM fp JOIN lengths USING (doc_id, field) JOIN means USING (field) GROUP BY ALL)"""
FIELDS = ["url", "title", "body"]


def page_pseudo(t: Tables) -> DataFrame:
    docs, anchors = page_fields(t)
    lists = rank.field_postings(docs, FIELDS).unionByName(rank.field_postings(anchors, ["anchor"]))
    own = rank.field_lengths(anchors, ["anchor"]).unionByName(docs.select("doc_id", F.lit("anchor").alias("field"), F.lit(0).alias("len")))  # links' words add up
    return rank.pseudo_frequencies(lists, rank.field_lengths(docs, FIELDS).unionByName(own.groupBy("doc_id", "field").agg(F.sum("len").cast("int").alias("len"))))


@query("bm25f_pseudo_freq", FIELD_SQL + " SELECT doc_id, term, round(eff, 5) AS eff FROM eff")
def bm25f_pseudo_freq(t: Tables) -> DataFrame:
    return page_pseudo(t).select("doc_id", "term", sql_round("eff", 5).alias("eff"))


@query("bm25f_pages_topk", FIELD_SQL + f", q AS (SELECT unnest(['the', 'fr', 'thing']) AS term), dfs AS (SELECT term, count(*)::DOUBLE AS df FROM eff GROUP BY term), stats AS (SELECT count(*)::DOUBLE AS n FROM pages) SELECT doc_id, round(sum({IDF} * eff * 2.2 / (1.2 + eff)), 6) AS score FROM eff JOIN q USING (term) JOIN dfs USING (term), stats GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def bm25f_pages_topk(t: Tables) -> DataFrame:
    pseudo = page_pseudo(t).where(F.col("term").isin("the", "fr", "thing"))
    df = pseudo.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = rank.bm25f(pseudo, t.rows("term", "('the'), ('fr'), ('thing')"), df, t.pages.count())
    return index.top_documents(scored.withColumn("score", sql_round("score", 6)), 10)


# --- fusion: documents ranked by two scores are two lists


LISTS = """lists AS (SELECT 0 AS list_id, doc_id % 4 AS segment, doc_id // 4 AS local, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank0, n_chars::DOUBLE AS score FROM documents
UNION ALL SELECT 1, doc_id % 4, doc_id // 4, row_number() OVER (ORDER BY length(text) - length(replace(text, 'e', '')) DESC, doc_id) - 1, (length(text) - length(replace(text, 'e', '')))::DOUBLE FROM documents)"""


def lists(t: Tables) -> DataFrame:
    score = [F.col("n_chars").cast("double"), (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("double")]
    both = [t.documents.select(F.lit(i).alias("list_id"), F.pmod("doc_id", F.lit(4)).cast("long").alias("segment"), F.floor(F.col("doc_id") / 4).cast("long").alias("local"), "doc_id", s.alias("score")) for i, s in enumerate(score)]
    return places(both[0].unionByName(both[1]), "list_id", [F.desc("score"), "doc_id"], "rank0").drop("doc_id")


@query("fuse_from_results", f"WITH {LISTS} SELECT * FROM lists")
def fuse_from_results(t: Tables) -> DataFrame:
    return lists(t).select("list_id", "segment", "local", "rank0", "score")


@query("fuse_rrf", f"WITH {LISTS} SELECT segment, local, round(sum(1.0::DOUBLE / (61 + rank0)), 9) AS score FROM lists GROUP BY ALL")
def fuse_rrf(t: Tables) -> DataFrame:
    return rank.rrf(lists(t)).withColumn("score", sql_round("score", 9))


@query("fuse_linear", f"WITH {LISTS}, spans AS (SELECT list_id, min(score) AS low, max(score) AS high FROM lists GROUP BY 1) SELECT segment, local, round(sum(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1 END * CASE list_id WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 6) AS score FROM lists JOIN spans USING (list_id) GROUP BY ALL")
def fuse_linear(t: Tables) -> DataFrame:
    weights = t.rows("list_id, weight", "(0, 0.7D), (1, 0.3D), (2, 0D)")
    return rank.linear_fusion(lists(t), weights).withColumn("score", sql_round("score", 6))


# --- features and cascade

FEATURES_SQL = """SELECT d.doc_id, d.n_chars / 1000.0::DOUBLE AS bm25, 0.0::DOUBLE AS dense, 0.0::DOUBLE AS proximity, CASE WHEN l.quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, ln(1 + d.n_chars) AS length, 0.0::DOUBLE AS pagerank,
0.0::DOUBLE AS authority, coalesce(l.toxic, 0)::DOUBLE AS spam, 0.0::DOUBLE AS freshness, 0.0::DOUBLE AS click_rate, 0.0::DOUBLE AS dwell FROM documents d LEFT JOIN labels l USING (doc_id)"""


def features(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    empty = F.lit(None).cast("double")
    known = {"bm25": F.col("n_chars") / F.lit(1000.0), "exact": F.when(F.col("quality") == 1, 1.0), "length": F.ln(F.lit(1) + F.col("n_chars")), "spam": F.col("toxic")}
    return rank.feature_vector(joined.select("doc_id", *[known.get(f, empty).alias(f) for f in rank.FEATURES]))


MODEL = [0.5, 0.1, 0.1, 0.75, 0.25, 0.0, 0.0, -2.0, 0.0, 0.0, 0.0]
SCORE_SQL = "0.125 + 0.5 * bm25 + 0.75 * exact + 0.25 * length - 2.0 * spam"


@query("ltr_features", f"SELECT doc_id, bm25, dense, proximity, exact, round(length, 9) AS length, pagerank, authority, spam, freshness, click_rate, dwell FROM ({FEATURES_SQL})")
def ltr_features(t: Tables) -> DataFrame:
    return features(t).withColumn("length", sql_round("length", 9))


def scored_features(t: Tables) -> DataFrame:
    return features(t).select("doc_id", rank.linear_model(F.array(*rank.FEATURES), MODEL, 0.125).alias("score"))


@query("ltr_linear_score", f"SELECT doc_id, round({SCORE_SQL}, 6) AS score FROM ({FEATURES_SQL})")
def ltr_linear_score(t: Tables) -> DataFrame:
    return scored_features(t).withColumn("score", sql_round("score", 6))


@query("ltr_check", "SELECT 11 AS dimension, true AS fits UNION ALL SELECT 10, false")
def ltr_check(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(n, rank.check_model(n)) for n in (11, 10)], "dimension int, fits boolean")


CASCADE = f"""WITH c AS (SELECT source AS query_id, doc_id, doc_id % 4 AS segment, doc_id // 4 AS local, round({SCORE_SQL}, 6) AS model_score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS stage_rank, count(*) OVER (PARTITION BY source) >= 30 AS reranked
FROM ({FEATURES_SQL}) f JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN -model_score ELSE stage_rank END, segment, local) AS place FROM c)
SELECT query_id, place, segment, local, CASE WHEN reranked THEN model_score ELSE 0.0 END AS score, reranked FROM r WHERE place <= 8"""


@query("cascade_rerank", CASCADE)
def cascade_rerank(t: Tables) -> DataFrame:
    cands = t.documents.join(scored_features(t), "doc_id").select(F.col("source").alias("query_id"), "doc_id", "n_chars", F.pmod("doc_id", F.lit(4)).cast("long").alias("segment"), F.floor(F.col("doc_id") / 4).cast("long").alias("local"), sql_round("score", 6).alias("model_score"))
    staged = rank.ranks(cands, [F.desc("n_chars"), "doc_id"], group="query_id", out="stage_rank")
    return rank.rerank(staged, 8, least=30).select("query_id", F.col("place").cast("long").alias("place"), "segment", "local", "score", "reranked")


# --- serving wire calls


@query("search_total_matched", f"WITH {POSTINGS}, hits AS (SELECT doc_id, sum(tf) AS score FROM postings WHERE term IN ('eren', 'thing', 'retion') GROUP BY doc_id) SELECT doc_id, score::BIGINT AS score, count(*) OVER () AS total_matched FROM hits ORDER BY score DESC, doc_id LIMIT 10")
def search_total_matched(t: Tables) -> DataFrame:
    hits = index.lookup(posts(t), *QUERY_TERMS).groupBy("doc_id").agg(F.sum("tf").alias("score"))
    return index.top_documents(hits, 10).withColumn("total_matched", F.lit(hits.count()))


@query("snippet_hydrate", f"WITH {POSTINGS}, hits AS (SELECT doc_id, sum(tf) AS score FROM postings WHERE term IN ('eren', 'thing', 'retion') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, source AS title, substr(text, 1, 160) AS snippet FROM hits JOIN documents USING (doc_id)")
def snippet_hydrate(t: Tables) -> DataFrame:
    hits = index.top_documents(index.lookup(posts(t), *QUERY_TERMS).groupBy("doc_id").agg(F.sum("tf").alias("score")), 10)
    return sealed(t).stored.join(F.broadcast(hits), "doc_id").select("doc_id", F.col("source").alias("title"), F.substring("text", 1, 160).alias("snippet"))  # ten rows
