"""Queries over stored cells, links, archives and the crawl, and over duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import hashing
from quarry.functions.numbers import sql_round
from quarry.operators import crawl, dedup, storage
from quarry.operators.ordered import places, shared_table, total_before
from quarry.plans.registry import Tables, query
from quarry.plans.search import POSTINGS, sealed
from quarry.sources import formats

# --- key-value: pages by address

KV = "kv AS (SELECT url AS key, md5(html) AS value FROM pages)"


def kv(t: Tables) -> DataFrame:
    return t.pages.select(F.col("url").alias("key"), F.md5("html").alias("value"))


@query("kv_get", f"WITH {KV} SELECT * FROM kv WHERE key = (SELECT min(key) FROM kv)")
def kv_get(t: Tables) -> DataFrame:
    return kv(t).where(F.col("key") == kv(t).agg(F.min("key")).first()[0])


@query("kv_range_scan", f"WITH {KV} SELECT * FROM kv WHERE key >= 'http://e' AND key < 'http://s' ORDER BY key")
def kv_range_scan(t: Tables) -> DataFrame:
    return storage.key_range(kv(t), "http://e", "http://s")


@query("kv_prefix_scan", f"WITH {KV} SELECT * FROM kv WHERE starts_with(key, 'http://th') ORDER BY key")
def kv_prefix_scan(t: Tables) -> DataFrame:
    return storage.key_range(kv(t), "http://th", storage.prefix_end(b"http://th").decode())


LOG = "log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)"


def log(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")


@query("kv_apply_batch", f"WITH {LOG} SELECT key, value FROM log WHERE op = 'put' AND seq = (SELECT max(l.seq) FROM log l WHERE l.key = log.key)")
def kv_apply_batch(t: Tables) -> DataFrame:
    return storage.latest_writes(log(t))


@query("kv_snapshot_read", f"WITH {LOG}, seen AS (SELECT * FROM log WHERE seq <= 700) SELECT key, value FROM seen WHERE op = 'put' AND seq = (SELECT max(l.seq) FROM seen l WHERE l.key = seen.key)")
def kv_snapshot_read(t: Tables) -> DataFrame:
    return storage.latest_writes(log(t), upto=700)


@query("ordered_key_roundtrip")
def ordered_key_roundtrip(t: Tables) -> DataFrame:
    """Keys of all pages sort as their parts do, and give them back."""

    def trip(batches):
        for batch in batches:
            keys = [storage.ordered_key(u.encode() + bytes(i % 3), i % 4, b"q\x00" * (i % 2), i) for i, u in zip(batch["page_id"], batch["url"], strict=True)]
            back = [storage.split_ordered_key(k) for k in keys]
            yield pd.DataFrame({"page_id": batch["page_id"], "key": keys, "same": [b == (u.encode() + bytes(i % 3), i % 4, b"q\x00" * (i % 2), i) for b, i, u in zip(back, batch["page_id"], batch["url"], strict=True)]})

    return t.pages.select("page_id", "url").mapInPandas(trip, "page_id long, key binary, same boolean")


# --- cells: users by event type, versions by time

CELLS = "cells AS (SELECT user_id AS row, user_id % 3 AS family, event_type AS qualifier, event_id AS ts, value FROM events)"


def cells(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("row"), F.pmod("user_id", F.lit(3)).cast("long").alias("family"), F.col("event_type").alias("qualifier"), F.col("event_id").alias("ts"), "value")


@query("webtable_put", f"WITH {CELLS} SELECT row, count(DISTINCT (qualifier, ts)) AS versions FROM cells GROUP BY row")
def webtable_put(t: Tables) -> DataFrame:
    twice = cells(t).unionByName(cells(t))  # the same version again replaces itself
    return storage.newest_cells(twice, 1 << 30).groupBy("row").agg(F.count(F.lit(1)).alias("versions"))


@query("webtable_latest", f"WITH {CELLS} SELECT row, family, qualifier, arg_max(value, ts) AS value, max(ts) AS ts FROM cells GROUP BY row, family, qualifier")
def webtable_latest(t: Tables) -> DataFrame:
    return storage.latest_cells(cells(t))


@query("webtable_scan_family", f"WITH {CELLS} SELECT row, qualifier, ts, value FROM cells WHERE family = 1 QUALIFY row_number() OVER (PARTITION BY row, family, qualifier ORDER BY ts DESC) = 1")
def webtable_scan_family(t: Tables) -> DataFrame:
    return storage.newest_cells(cells(t).where("family = 1")).select("row", "qualifier", "ts", "value")


@query("webtable_gc_versions", f"WITH {CELLS} SELECT row, family, qualifier, ts, value FROM cells QUALIFY row_number() OVER (PARTITION BY row, family, qualifier ORDER BY ts DESC) <= 3")
def webtable_gc_versions(t: Tables) -> DataFrame:
    return storage.newest_cells(cells(t), 3).select("row", "family", "qualifier", "ts", "value")


HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def host_of():
    return F.regexp_extract("url", "^https?://([^/?#]+)", 1)




@query("reverse_host_rowkey", f"SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(lower({HOST} || CASE WHEN page_id % 2 = 0 THEN '.' ELSE '' END), '[.]$', ''), '.')), '.') || regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS row_key FROM pages")
def reverse_host_rowkey(t: Tables) -> DataFrame:
    host = F.concat(host_of(), F.when(F.pmod("page_id", F.lit(2)) == 0, ".").otherwise(""))
    return t.pages.select("page_id", F.concat(storage.reversed_host(host), F.regexp_extract("url", "^https?://[^/?#]+(.*)$", 1)).alias("row_key"))


LINKS = f"""raw AS (SELECT page_id, {HOST} AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS a FROM pages),
each AS (SELECT 'http://' || host AS src, 'http://' || host || regexp_extract(a, 'href="([^"]*)"', 1) AS dst, regexp_extract(a, '>([^<]*)<', 1) AS anchor, page_id FROM raw),
links AS (SELECT src, dst, max((page_id, anchor)) AS last FROM each GROUP BY src, dst), edges AS (SELECT src, dst, struct_extract(last, 2) AS anchor FROM links)"""


def written(t: Tables) -> DataFrame:
    a = t.pages.select("page_id", host_of().alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))).alias("a"))
    src = F.concat(F.lit("http://"), "host")
    anchor = F.regexp_extract("a", ">([^<]*)<", 1)
    return a.select(src.alias("src"), F.concat(src, F.regexp_extract("a", 'href="([^"]*)"', 1)).alias("dst"), anchor.alias("anchor"), F.struct("page_id", anchor).alias("seq"))


def edges(t: Tables) -> DataFrame:
    return storage.last_links(written(t))


@query("link_upsert", f"WITH {LINKS} SELECT * FROM edges")
def link_upsert(t: Tables) -> DataFrame:
    return edges(t)


@query("link_outlinks", f"WITH {LINKS} SELECT dst, anchor FROM edges WHERE src = (SELECT min(src) FROM edges) ORDER BY dst")
def link_outlinks(t: Tables) -> DataFrame:
    first = edges(t).agg(F.min("src")).first()[0]
    return edges(t).where(F.col("src") == first).orderBy("dst").select("dst", "anchor")


@query("link_inversion_anchors", f"WITH {LINKS} SELECT dst, p // 256 AS piece, string_agg(anchor, '|' ORDER BY src, anchor) AS anchors, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src, anchor) - 1 AS p FROM edges) GROUP BY dst, p // 256")
def link_inversion_anchors(t: Tables) -> DataFrame:
    """Anchors by target, in pieces of 256 links, so that a target that everyone links to is no single row."""
    placed = places(edges(t), "dst", ["src", "anchor"], "place").withColumn("piece", F.floor(F.col("place") / 256).cast("long"))
    pieces = placed.groupBy("dst", "piece").agg(F.sort_array(F.collect_list(F.struct("src", "anchor"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return pieces.select("dst", "piece", F.array_join(F.transform("x", lambda e: e["anchor"]), "|").alias("anchors"), "n")


@query("link_outdegree", f"WITH {LINKS}, nodes AS (SELECT src AS v FROM edges UNION SELECT dst FROM edges) SELECT v, count(src) AS degree FROM nodes LEFT JOIN edges ON v = src GROUP BY v")
def link_outdegree(t: Tables) -> DataFrame:
    from quarry.operators.graph import out_degrees

    e = edges(t)
    return out_degrees(e, e.select(F.col("src").alias("v")).union(e.select("dst")).distinct())


# --- archives and the export


@query("warc_write_locators")
def warc_write_locators(t: Tables) -> DataFrame:
    """Offset and length of each page's member in an archive of all, by page."""
    records = t.pages.select(F.col("page_id").alias("seq"), F.lit("response").alias("kind"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("url").alias("uri"), F.lit("application/http;msgtype=response").alias("content_type"), F.create_map(F.lit("WARC-Consent"), F.lit("allowed")).alias("fields"), F.encode("html", "utf-8").alias("block"))
    sized = formats.archive_members(records).select("seq", F.octet_length("member").cast("long").alias("length"))
    placed = total_before(sized, ["seq"], "length", "offset")
    return placed.select(F.col("seq").alias("page_id"), "offset", "length")


@query("warc_record_types", "SELECT page_id, 'consent: allowed' || chr(13) || chr(10) || 'host: ' || regexp_extract(url, '^https?://([^/?#]+)', 1) || chr(13) || chr(10) || 'size: ' || length(html) || chr(13) || chr(10) AS block FROM pages")
def warc_record_types(t: Tables) -> DataFrame:
    fields = F.create_map(F.lit("size"), F.length("html").cast("string"), F.lit("host"), host_of(), F.lit("consent"), F.lit("allowed"))
    return t.pages.select("page_id", formats.metadata_block(fields).alias("block"))


LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)"


@query("warc_block_digest", f"WITH d AS (SELECT page_id, sha1(html) AS h FROM pages), letters AS (SELECT page_id, i, {LETTER} AS c FROM d, range(32) r(i)) SELECT page_id, string_agg(c, '' ORDER BY i) AS digest FROM letters GROUP BY page_id")
def warc_block_digest(t: Tables) -> DataFrame:
    def digest(batches):
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "digest": [formats.base32_sha1(x.encode()) for x in batch["html"]]})

    return t.pages.select("page_id", "html").mapInPandas(digest, "page_id long, digest string")


def lengths(t: Tables) -> DataFrame:
    """doc_id, name and terms of each document, as the index stores them."""
    return sealed(t).stored.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "length")


@query("ciff_export_bytes")
def ciff_export_bytes(t: Tables) -> DataFrame:
    """The export's pieces with their sizes, in order."""
    found = sealed(t)
    return formats.export_lists(found.lists, found.dictionary, lengths(t), "documents").select("part", "key", "place", F.octet_length("data").cast("long").alias("bytes"), F.md5("data").alias("digest"))


@query("ciff_gap_decode", f"WITH {POSTINGS} SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM postings")
def ciff_gap_decode(t: Tables) -> DataFrame:
    """Gaps, and the documents that summing them gives back. Blocks carry the document before them, so each is decoded by itself."""
    return formats.decoded(sealed(t).lists)


@query("ciff_header_stats", f"WITH {POSTINGS} SELECT (SELECT count(DISTINCT term) FROM postings) AS lists, (SELECT count(*) FROM documents) AS docs, (SELECT sum(tf)::BIGINT FROM postings) AS total, (SELECT sum(tf) FROM postings)::DOUBLE / (SELECT count(*) FROM documents) AS mean")
def ciff_header_stats(t: Tables) -> DataFrame:
    terms = sealed(t).dictionary.agg(F.count(F.lit(1)).alias("lists"), F.coalesce(F.sum("cf"), F.lit(0)).alias("total"))
    docs = t.documents.agg(F.count(F.lit(1)).alias("docs"))
    mean = F.when(F.col("docs") > 0, F.col("total") / F.col("docs")).otherwise(F.lit(0.0))
    return terms.join(docs).select("lists", "docs", "total", mean.alias("mean"))  # one row each


@query("ciff_postings", f"WITH {POSTINGS} SELECT term, p // 128 AS block, count(*) AS n, sum(tf)::BIGINT AS cf, md5(string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id)) AS postings FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS p FROM postings) GROUP BY term, p // 128")
def ciff_postings(t: Tables) -> DataFrame:
    """Digests of the lists by blocks of 128, so that no row holds a whole list."""
    text = F.array_join(F.zip_with("docs", "tfs", lambda d, n: F.concat_ws(":", d.cast("string"), n.cast("string"))), ",")
    return sealed(t).lists.select("term", "block", "n", "cf", F.md5(text).alias("postings"))


@query("forward_dense_check", "SELECT doc_id % 4 AS segment, min(doc_id // 4) AS low, max(doc_id // 4) AS high, max(doc_id // 4) - min(doc_id // 4) + 1 = count(*) AS dense FROM documents GROUP BY 1")
def forward_dense_check(t: Tables) -> DataFrame:
    local = F.floor(F.col("doc_id") / 4).cast("long")
    return t.documents.groupBy(F.pmod("doc_id", F.lit(4)).cast("long").alias("segment")).agg(F.min(local).alias("low"), F.max(local).alias("high"), ((F.max(local) - F.min(local) + 1) == F.count(F.lit(1))).alias("dense"))


@query("forward_hydrate_topk", "SELECT doc_id, source, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 16")
def forward_hydrate_topk(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(16).select("doc_id")
    return t.documents.join(F.broadcast(ids), "doc_id").select("doc_id", "source", "lang", "n_chars")  # sixteen rows


WIDTH = "CASE WHEN {0} <= 0 THEN 1 ELSE length(bin({0})) END"
PLACED = f"{POSTINGS}, gaps AS (SELECT term, doc_id, tf, (doc_id - coalesce(lag(doc_id) OVER w, 0))::BIGINT AS gap, row_number() OVER w - 1 AS place FROM postings WINDOW w AS (PARTITION BY term ORDER BY doc_id))"


def width(x):
    return F.greatest(F.length(F.bin(x)), F.lit(1))


@query("bitpack_width_stats", f"WITH {PLACED} SELECT term, place // 128 AS block, max({WIDTH.format('gap')})::BIGINT AS gap_bits, max({WIDTH.format('tf')})::BIGINT AS tf_bits, (count(*) * max({WIDTH.format('gap')}) + 7)::BIGINT // 8 AS bytes FROM gaps GROUP BY 1, 2")
def bitpack_width_stats(t: Tables) -> DataFrame:
    gap_bits, tf_bits = (width(F.array_max(c)).cast("long") for c in ("gaps", "tfs"))
    return sealed(t).lists.select("term", "block", gap_bits.alias("gap_bits"), tf_bits.alias("tf_bits"), F.floor((F.col("n") * gap_bits + 7) / 8).cast("long").alias("bytes"))


@query("groupvarint_size", f"WITH {PLACED}, tails AS (SELECT *, count(*) OVER (PARTITION BY term) AS n FROM gaps) SELECT term, sum(({WIDTH.format('gap')} + 7) // 8)::BIGINT + (count(*) + 3) // 4 AS bytes FROM tails WHERE place >= n // 128 * 128 GROUP BY term")
def groupvarint_size(t: Tables) -> DataFrame:
    """Bytes of a list's last block where it isn't full: those of its gaps, and one for the sizes of every four."""
    gaps = F.aggregate("gaps", F.lit(0).cast("long"), lambda a, x: a + F.floor((width(x) + 7) / 8))
    return sealed(t).lists.where("n < 128").select("term", (gaps + F.floor((F.col("n") + 3) / 4)).cast("long").alias("bytes"))


@query("pfor_choose_width", f"WITH {PLACED}, blocks AS (SELECT term, place // 128 AS block, {WIDTH.format('tf')} AS bits, count(*) AS n FROM gaps GROUP BY ALL), cost AS (SELECT term, block, w, (sum(n) * w + 7)::BIGINT // 8 + 6 * coalesce(sum(n) FILTER (WHERE bits > w), 0)::BIGINT AS cost FROM blocks, range(1, 33) r(w) GROUP BY term, block, w) SELECT term, block, w AS width, cost FROM cost QUALIFY row_number() OVER (PARTITION BY term, block ORDER BY cost, w) = 1")
def pfor_choose_width(t: Tables) -> DataFrame:
    """Packed bytes and six for each exception; of equal costs the smaller width."""
    return formats.packed_widths(sealed(t).lists)


@query("artifact_address", "SELECT page_id, sha256(html) AS address FROM pages")
def artifact_address(t: Tables) -> DataFrame:
    return t.pages.select("page_id", storage.address(F.col("html")).alias("address"))


@query("artifact_signing_bytes", "SELECT page_id, lower(lpad(hex((page_id % 6)::BIGINT), 2, '0') || hex(encode('snap-1')) || sha256(html) || hex(encode('op' || page_id % 3))) AS message FROM pages")
def artifact_signing_bytes(t: Tables) -> DataFrame:
    message = storage.signing_bytes(F.pmod("page_id", F.lit(6)), F.lit("snap-1"), storage.address(F.col("html")), F.concat(F.lit("op"), F.pmod("page_id", F.lit(3)).cast("string")))
    return t.pages.select("page_id", F.lower(F.hex(message)).alias("message"))


@query("artifact_verify_status", "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'unknown operator' WHEN page_id % 5 = 0 THEN 'bad signature' WHEN page_id % 7 = 0 THEN 'hash mismatch' ELSE 'ok' END AS status FROM pages")
def artifact_verify_status(t: Tables) -> DataFrame:
    real = storage.address(F.col("html"))
    rows = t.pages.select("page_id", real.alias("content"), F.when(F.pmod("page_id", F.lit(7)) == 0, F.sha2(F.lit("other"), 256)).otherwise(real).alias("rebuilt"), (F.pmod("page_id", F.lit(5)) != 0).alias("signed"), F.concat(F.lit("op"), F.pmod("page_id", F.lit(3)).cast("string")).alias("operator"))
    return storage.verify_status(rows, t.rows("operator", "('op0'), ('op1')")).select("page_id", "status")


# --- crawl: pages are URLs in order, their sizes fetch times

URLS = f"urls AS (SELECT page_id AS seq, md5(html) AS fingerprint, CASE WHEN page_id % 11 = 0 THEN '' ELSE {HOST} END AS host, (page_id * 7) % 13 - 2 AS priority, (length(html) / 10000.0)::DOUBLE AS took, (page_id % 4)::DOUBLE AS delay FROM pages UNION ALL SELECT page_id + 1000000, md5(html), {HOST}, 3, (length(html) / 10000.0)::DOUBLE, (page_id % 4)::DOUBLE FROM pages WHERE page_id % 2 = 0)"
ADMITTED = f"{URLS}, adm AS (SELECT fingerprint, seq, host, greatest(0, least(7, priority)) AS priority, priority AS raw, took, delay FROM urls WHERE host <> '' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1), queued AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS place, max(raw) OVER (PARTITION BY host) AS host_priority FROM adm)"
GAP = "greatest(delay, least(greatest(10 * took, 0.5), 30.0))"


def urls(t: Tables) -> DataFrame:
    base = t.pages.select(F.col("page_id").alias("seq"), F.md5("html").alias("fingerprint"), host_of().alias("host"), (F.length("html") / F.lit(10000.0)).alias("fetch"), F.pmod("page_id", F.lit(4)).cast("double").alias("delay"))
    first = base.withColumn("priority", F.pmod(F.col("seq") * 7, F.lit(13)) - 2).withColumn("host", F.when(F.pmod("seq", F.lit(11)) == 0, "").otherwise(F.col("host")))
    return first.unionByName(base.where("seq % 2 = 0").withColumn("seq", F.col("seq") + 1000000).withColumn("priority", F.lit(3).cast("long")))


@query("frontier_admit", f"WITH {ADMITTED} SELECT fingerprint, seq, host, priority FROM adm")
def frontier_admit(t: Tables) -> DataFrame:
    return crawl.admitted(urls(t)).select("fingerprint", "seq", "host", "priority")


def queued(t: Tables) -> DataFrame:
    return crawl.host_queues(crawl.admitted(urls(t)))


@query("frontier_host_queue", f"WITH {ADMITTED} SELECT host, place, seq, host_priority FROM queued")
def frontier_host_queue(t: Tables) -> DataFrame:
    return queued(t).select("host", F.col("place").cast("long").alias("place"), "seq", "host_priority")


@query("frontier_schedule", f"WITH {ADMITTED} SELECT host, seq, round(coalesce(sum(took + {GAP}) OVER (PARTITION BY host ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM queued")
def frontier_schedule(t: Tables) -> DataFrame:
    return crawl.schedule(queued(t)).select("host", "seq", sql_round("start", 6).alias("start"))


@query("politeness_gap", f"WITH {URLS} SELECT seq, {GAP} AS gap FROM urls")
def politeness_gap(t: Tables) -> DataFrame:
    return urls(t).select("seq", crawl.gap(F.col("fetch"), F.col("delay")).alias("gap"))


ROBOTS = {
    "a": "User-agent: *\nDisallow: /private/\nAllow: /private/open*.html$\nCrawl-delay: 2\n\nUser-agent: findbot\nUser-agent: findbot-news\nDisallow: /\nAllow: /news # but these\nSitemap: http://a/map.xml",
    "b": "Disallow: /early\nUser-agent: other\nDisallow:\nCrawl-delay: -1\nUser-agent: *\nDisallow: /*.pdf$\nDisallow: /a.b?c=(d)\n",
    "c": "# nothing here\n",
}
RULES = "('a', 0, '*', 2.0, false, '/private/'), ('a', 0, '*', 2.0, true, '/private/open*.html$'), ('a', 1, 'findbot', NULL, false, '/'), ('a', 1, 'findbot', NULL, true, '/news'), ('a', 1, 'findbot-news', NULL, false, '/'), ('a', 1, 'findbot-news', NULL, true, '/news'), ('b', 0, 'other', NULL, NULL, NULL), ('b', 1, '*', NULL, false, '/*.pdf$'), ('b', 1, '*', NULL, false, '/a.b?c=(d)')"
VISITS = ", ".join(f"('{s}', '{u}', '{p}')" for s in "abc" for u in ("FindBot/2.0", "Findbot-News", "other 1", "Mozilla") for p in ("/", "private/x", "/private/open1.html", "/private/open1.htmlx", "/news/today", "/x.pdf", "/x.pdfs", "/a.b?c=(d)e", "/aXb?c=(d)e"))
AGENT = "v AS (SELECT DISTINCT site, ua FROM visits), met AS (SELECT v.site, v.ua, r.grp, CASE WHEN r.agent = '*' THEN 0 ELSE length(r.agent) END AS n FROM v JOIN rules r ON v.site = r.site AND (r.agent = '*' OR contains(lower(v.ua), r.agent))), best AS (SELECT site, ua, arg_max(grp, (n, -grp)) AS grp FROM met GROUP BY ALL)"
ROBOTS_SQL = f"rules AS (SELECT * FROM (VALUES {RULES}) r(site, grp, agent, delay, allow, pattern)), visits AS (SELECT * FROM (VALUES {VISITS}) v(site, ua, path)), {AGENT}"


def robots(t: Tables) -> DataFrame:
    return crawl.robots_rows(t.spark.createDataFrame(list(ROBOTS.items()), "site string, body string"))


def visits(t: Tables) -> DataFrame:
    return t.rows("site, ua, path", VISITS)


@query("robots_rules", f"SELECT * FROM (VALUES {RULES.replace('2.0', '2.0::DOUBLE')}) r(site, grp, agent, delay, allow, pattern)")
def robots_rules(t: Tables) -> DataFrame:
    return robots(t)


@query("robots_group_for", f"WITH {ROBOTS_SQL} SELECT v.site, v.ua, b.grp FROM v LEFT JOIN best b USING (site, ua)")
def robots_group_for(t: Tables) -> DataFrame:
    return crawl.chosen_groups(robots(t), visits(t).select("site", "ua").distinct())


@query("robots_allowed", f"""WITH {ROBOTS_SQL}, p AS (SELECT *, CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS full_path FROM visits),
fit AS (SELECT p.site, p.ua, p.path, r.allow, length(regexp_replace(r.pattern, '[$]$', '')) AS n FROM p JOIN best b USING (site, ua) JOIN rules r ON r.site = b.site AND r.grp = b.grp AND r.pattern IS NOT NULL
  AND regexp_matches(p.full_path, '^' || regexp_replace(regexp_replace(regexp_replace(r.pattern, '[$]$', ''), '([.?()])', '\\\\\\1', 'g'), '[*]', '.*', 'g') || CASE WHEN ends_with(r.pattern, '$') THEN '$' ELSE '' END))
SELECT v.site, v.ua, v.path, coalesce(arg_max(f.allow, (f.n, f.allow)), true) AS allowed FROM visits v LEFT JOIN fit f USING (site, ua, path) GROUP BY ALL""")
def robots_allowed(t: Tables) -> DataFrame:
    return crawl.allowed(robots(t), visits(t))


@query("robots_crawl_delay", f"WITH {ROBOTS_SQL} SELECT v.site, v.ua, max(r.delay)::DOUBLE AS delay FROM v LEFT JOIN best b USING (site, ua) LEFT JOIN rules r ON r.site = b.site AND r.grp = b.grp GROUP BY ALL")
def robots_crawl_delay(t: Tables) -> DataFrame:
    groups = crawl.chosen_groups(robots(t), visits(t).select("site", "ua").distinct())
    return groups.join(robots(t).select("site", "grp", "delay").distinct(), ["site", "grp"], "left").groupBy("site", "ua").agg(F.max("delay").alias("delay"))


@query("needs_render", """SELECT page_id, octet_length(encode(trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)))) <= 512 AND contains(lower(html), '<script') AND page_id % 3 = 0 AS needed FROM pages""")
def needs_render(t: Tables) -> DataFrame:
    """The supplied pages have no app root; every third gets one, outside its text."""
    html = F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat("html", F.lit('<div id="root"></div>'))).otherwise(F.col("html"))
    return t.pages.select("page_id", crawl.needs_render(html).alias("needed"))


@query("fcrdns_verify", "SELECT * FROM (VALUES ('1.1.1.1', 'find.org', true), ('1.1.1.2', 'find.org', false), ('1.1.1.3', 'find.org', false), ('9.9.9.9', 'find.org', false)) v(ip, domain, confirmed)")
def fcrdns_verify(t: Tables) -> DataFrame:
    claims = t.rows("ip, domain", "('1.1.1.1', 'find.org'), ('1.1.1.2', 'find.org'), ('1.1.1.3', 'find.org'), ('9.9.9.9', 'find.org')")
    names = t.rows("ip, name", "('1.1.1.1', 'crawl-1.Find.org.'), ('1.1.1.2', 'crawl-2.find.org'), ('1.1.1.3', 'notfind.org')")
    return crawl.confirmed(claims, names, t.rows("name, ip", "('crawl-1.Find.org.', '1.1.1.1'), ('crawl-2.find.org', '8.8.8.8'), ('notfind.org', '1.1.1.3')"))


# --- duplicates


@query("exact_dedup", "SELECT sha256(text) AS hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(t: Tables) -> DataFrame:
    return dedup.exact(t.documents)


WORDS = "list_filter(regexp_split_to_array(lower(text), '[\\s\\x{0085}\\x{00A0}\\x{2028}\\x{2029}\\x{3000}]+'), lambda x: x <> '')"
GRAMS = f"words AS (SELECT doc_id, {WORDS} AS w FROM documents), grams AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM words)"


@query("shingle_counts", f"WITH {GRAMS} SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL")
def shingle_counts(t: Tables) -> DataFrame:
    return dedup.shingle_counts(t.documents)


FINGERPRINTS = f"{GRAMS}, h AS MATERIALIZED (SELECT gram, {hashing.fnv_sql('gram')} AS h FROM (SELECT DISTINCT gram FROM grams)), bits AS (SELECT doc_id, {', '.join(f'sum((h >> {b}::UHUGEINT) & 1::UHUGEINT) * 2 > count(*) AS b{b}' for b in range(64))} FROM grams JOIN h USING (gram) GROUP BY doc_id), fps AS MATERIALIZED (SELECT d.doc_id, coalesce({' || '.join(f'b{b}::INT::VARCHAR' for b in reversed(range(64)))}, repeat('0', 64)) AS fp FROM documents d LEFT JOIN bits USING (doc_id))"


@query("simhash_fingerprint", f"WITH {FINGERPRINTS} SELECT doc_id, fp FROM fps")
def simhash_fingerprint(t: Tables) -> DataFrame:
    return dedup.fingerprints(t.documents).select("doc_id", F.lpad(F.bin("fp"), 64, "0").alias("fp"))


@query("hamming_pairs", f"WITH {FINGERPRINTS} SELECT a.doc_id, bit_count(xor(a.fp::BIT, b.fp::BIT))::BIGINT AS distance, bit_count(xor(a.fp::BIT, b.fp::BIT)) <= 3 AS near FROM fps a JOIN fps b ON b.doc_id = a.doc_id + 1")
def hamming_pairs(t: Tables) -> DataFrame:
    """Each document against that of the next id."""
    fps = shared_table(dedup.fingerprints(t.documents), "fingerprints")
    after = fps.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fp").alias("next"))
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col("next")))
    return fps.join(after, "doc_id").select("doc_id", d.cast("long").alias("distance"), (d <= dedup.THRESHOLD).alias("near"))


@query("near_dup_classes", f"WITH {FINGERPRINTS} SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS class FROM fps")
def near_dup_classes(t: Tables) -> DataFrame:
    """The class of each document: the first with its fingerprint. near_dup_pairs has the links between classes."""
    fps = shared_table(dedup.fingerprints(t.documents), "fingerprints")
    return fps.join(dedup.classes(fps), "fp").select("doc_id", F.col("first").alias("class"))


@query("near_dup_pairs", f"WITH {FINGERPRINTS}, c AS (SELECT fp::BIT AS fp, min(doc_id) AS first FROM fps GROUP BY fp) SELECT x.first AS a, y.first AS b, bit_count(xor(x.fp, y.fp))::BIGINT AS distance FROM c x JOIN c y ON x.first < y.first AND bit_count(xor(x.fp, y.fp)) <= 3")
def near_dup_pairs(t: Tables) -> DataFrame:
    found = shared_table(dedup.classes(dedup.fingerprints(t.documents)), "classes")
    return dedup.near_pairs(found).select("a", "b", "distance")


@query("near_dup_clusters")
def near_dup_clusters(t: Tables) -> DataFrame:
    return dedup.leaders(shared_table(dedup.fingerprints(t.documents), "fingerprints"))
