"""Rules that the supplied tables don't reach: formats, codecs, hashes, robots, answers, streams."""

import random
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import hashing
from quarry.functions.numbers import sql_round
from quarry.functions.text import shingles

from quarry.operators import answer, control, crawl, crowd, dedup, evaluation, graph, index, ordered, rank, serving, storage, telemetry, vectors
from quarry.plans import platform, search, web  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES
from quarry.sources import formats
from quarry.streaming import live


def brute_fnv(data):
    h = hashing.OFFSET
    for b in data:
        h = (h ^ b) * hashing.PRIME % 2**64
    return h


def test_fnv_forms_agree(spark):
    texts = ["", "a", "hello", "é\U0001d518 x", "z" * 300]
    want = [brute_fnv(t.encode()) for t in texts]
    assert hashing.fnv1a_many([t.encode() for t in texts]).tolist() == want
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.fnv1a(F.col("t"))).collect()
    assert [r[0] % 2**64 for r in got] == want


def test_jump_hash_moves_few_and_balances():
    keys = np.arange(100_000, dtype=np.uint64)
    a, b = hashing.jump(keys, 100), hashing.jump(keys, 101)
    assert (a != b).mean() <= 0.02 and set(b[a != b]) == {100}
    counts = np.bincount(hashing.jump(keys, 10))
    assert abs(counts - 10_000).max() <= 500
    assert (hashing.jump(keys[:5], 0) == 0).all()


def test_rendezvous_spreads_a_lost_node(spark):
    shards = spark.range(5000).select(F.col("id").alias("shard"))
    before = {r.shard: r.node for r in control.placed(shards, [f"n{i}" for i in range(5)], 1).collect()}
    after = {r.shard: r.node for r in control.placed(shards, [f"n{i}" for i in range(4)], 1).collect()}
    assert all(after[s] == n for s, n in before.items() if n != "n4")
    moved = Counter(after[s] for s, n in before.items() if n == "n4")
    assert max(moved.values()) < 1.35 * sum(moved.values()) / 4


@given(st.binary(max_size=12), st.integers(0, 255), st.binary(max_size=6), st.integers(-(2**63), 2**63 - 1))
@settings(max_examples=200, deadline=None)
def test_ordered_keys_round_trip(row, family, qualifier, ts):
    assert storage.split_ordered_key(storage.ordered_key(row, family, qualifier, ts)) == (row, family, qualifier, ts)


@given(st.lists(st.tuples(st.binary(max_size=4), st.integers(0, 3), st.binary(max_size=3), st.integers(0, 9)), min_size=2, max_size=8))
@settings(max_examples=100, deadline=None)
def test_ordered_keys_sort_as_their_parts(cells):
    by_key = sorted(cells, key=lambda c: storage.ordered_key(*c))
    assert by_key == sorted(cells, key=lambda c: (c[0], c[1], c[2], -c[3]))


def test_prefix_end():
    assert storage.prefix_end(b"ab") == b"ac" and storage.prefix_end(b"a\xff") == b"b"
    assert storage.prefix_end(b"\xff\xff") is None and storage.prefix_end(b"") is None


def test_log_of_writes(spark):
    log = spark.createDataFrame([("a", 1, "put", 1.0), ("a", 2, "delete", None), ("b", 3, "delete", None), ("c", 4, "put", 4.0), ("c", 5, "put", 5.0)], "key string, seq long, op string, value double")
    assert [(r.key, r.value) for r in storage.latest_writes(log).collect()] == [("c", 5.0)]
    assert sorted((r.key, r.value) for r in storage.latest_writes(log, upto=1).collect()) == [("a", 1.0)]
    assert storage.latest_writes(log.limit(0)).count() == 0


def test_signatures(spark):
    public, signature = storage.sign(spark, b"seed", b"message")
    assert storage.signature_holds(spark, public, b"message", signature)
    assert not storage.signature_holds(spark, public, b"messagf", signature)


def test_export_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    posts = index.postings(docs).cache()
    names = docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")).join(posts.groupBy("doc_id").agg(F.sum("tf").alias("length")), "doc_id")
    parts = sorted(formats.export_parts(posts, names, "forty").collect(), key=lambda r: (r.part, r.key.encode(), r.place))
    data = b"".join(bytes(r.data) for r in parts)
    back = formats.read_export(data)
    want = Counter((r.term, r.doc_id, r.tf) for r in posts.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # lists in many pieces are the same bytes
    try:
        small = sorted(formats.export_parts(posts, names, "forty").collect(), key=lambda r: (r.part, r.key.encode(), r.place))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(small) > len(parts) and b"".join(bytes(r.data) for r in small) == data
    lists = {t: (df, cf) for t, df, cf, _ in back["lists"]}
    assert lists == {r.term: (r.df, r.cf) for r in index.dictionary(posts).collect()}
    assert Counter((t, d, n) for t, _, _, p in back["lists"] for d, n in p) == want
    assert [t for t, *_ in back["lists"]] == sorted(t for t, *_ in back["lists"])
    assert len(back["docs"]) == 40 and back["about"] == "forty" and back["mean"] == back["total"] / 40
    with pytest.raises(ValueError):
        formats.read_export(b"NOPE" + data[4:])
    with pytest.raises(ValueError):
        formats.read_export(data[:4] + b"\x09" + data[5:])
    with pytest.raises(ValueError):
        formats.list_bytes("x", [(5, 1), (3, 1)])


@given(st.integers(0, 2**64 - 1))
def test_uvarints(n):
    assert formats.Cursor(formats.uvarint(n)).number() == n


def test_header_keeps_the_mean():
    assert formats.read_export(formats.header_bytes(0, 0, 0, 2.5, ""))["mean"] == 2.5
    assert struct.pack("<d", 2.5)


def test_archive_members_stand_alone(spark):
    rows = [(0, "response", "2024-01-01T00:00:00Z", "http://a/", "application/http;msgtype=response", {"B": "2", "A": "1"}, bytearray(b"body\r\n\r\nmore")), (1, "metadata", "2024-01-01T00:00:00Z", None, None, {}, bytearray(b""))]
    df = spark.createDataFrame(rows, "seq long, kind string, date string, uri string, content_type string, fields map<string,string>, block binary")
    members = {r.seq: bytes(r.member) for r in formats.archive_members(df).collect()}
    fields, block = formats.parse_record(members[0])
    assert block == b"body\r\n\r\nmore" and list(fields)[:4] == ["WARC-Type", "WARC-Date", "WARC-Record-ID", "WARC-Target-URI"]
    assert list(fields)[-3:] == ["A", "B", "Content-Length"] and fields["WARC-Block-Digest"] == "sha1:" + formats.base32_sha1(b"body\r\n\r\nmore")
    fields, block = formats.parse_record(members[1])
    assert block == b"" and "WARC-Block-Digest" not in fields and fields["Content-Type"] == "application/octet-stream"


def test_archive_data_source(spark, tmp_path):
    from quarry.sources.datasource import WarcSource

    spark.dataSource.register(WarcSource)
    rows = [(f"k{i}", f"http://h/{i}", "2024-01-01T00:00:00Z", "text/plain", bytearray(b"x" * i + b"\r\nWARC/1.1")) for i in range(20)]
    df = spark.createDataFrame(rows, "kind string, uri string, date string, content_type string, block binary").repartition(3)
    df.write.format("warc").mode("append").save(str(tmp_path / "w"))
    back = spark.read.format("warc").load(str(tmp_path / "w"))
    assert Counter((r.kind, r.uri, bytes(r.block)) for r in back.collect()) == Counter((a, b, bytes(e)) for a, b, _, _, e in rows)


def naive_glob(pattern, path):
    end = pattern.endswith("$")
    p = pattern[:-1] if end else pattern

    def fit(i, j):
        if i == len(p):
            return not end or j == len(path)
        if p[i] == "*":
            return any(fit(i + 1, k) for k in range(j, len(path) + 1))
        return j < len(path) and p[i] == path[j] and fit(i + 1, j + 1)

    return fit(0, 0)


def test_robots_globs(spark):
    rng = random.Random(0)
    pairs = [("".join(rng.choice("/ab*.$?(") for _ in range(rng.randint(1, 6))), "/" + "".join(rng.choice("/ab.$?(") for _ in range(rng.randint(0, 7)))) for _ in range(600)]
    got = spark.createDataFrame(pairs, "p string, s string").select("p", "s", F.rlike("s", crawl.glob_regex(F.col("p"))).alias("m")).collect()
    assert all(r.m == naive_glob(r.p, r.s) for r in got)


def test_robots_parsing():
    groups, maps = crawl.parse_robots("Disallow: /x\nUser-Agent: A\nUser-agent: b\nDisallow:\nUser-agent: c\nCrawl-delay: 3\nCrawl-delay: x\nAllow: /y # z\nSitemap: http://s\n")
    assert groups == [{"agents": ["a", "b"], "rules": [], "delay": None}, {"agents": ["c"], "rules": [(True, "/y")], "delay": 3.0}] and maps == ["http://s"]


def test_leader_clusters_equal_insertion(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(260):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        rows.append((i, hashing.signed(x)))
    want, leads = {}, []
    for i, f in rows:
        near = min((((f ^ g) % 2**64).bit_count(), j) for j, g in leads) if leads else (99, 0)
        want[i] = near[1] if near[0] <= 3 else i
        if want[i] == i:
            leads.append((i, f))
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    assert {r.doc_id: r.leader for r in dedup.leaders(fps).collect()} == want
    first = {f: i for i, f in reversed(rows)}
    pairs = {(min(first[a], first[b]), max(first[a], first[b])) for a in first for b in first if a != b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert {(r.a, r.b) for r in dedup.near_pairs(dedup.classes(fps)).collect()} == pairs


ODD_TEXTS = ["", None, "one", "one two", "one two three", "a b a b a b a b", "Tab\tand\u00a0blank  x\n y", "\u00c9t\u00c9 \u0130x \U0001d518 z", " lead and trail ", "w " * 200_000 + "end"]


def test_shingles_are_hashed_and_counted_as_before(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE", 1000)
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    grams = {r.doc_id: [g for g in r.g or [] if g is not None] for r in docs.select("doc_id", shingles(F.col("text"), 3).alias("g")).collect()}
    want = {}
    for d, each in grams.items():
        bits = Counter()
        for g, n in Counter(each).items():
            for b in range(64):
                bits[b] += n * (brute_fnv(g.encode()) >> b & 1)
        want[d] = hashing.signed(sum(1 << b for b in range(64) if 2 * bits[b] > len(each)))
    assert {r.doc_id: r.fp for r in dedup.fingerprints(docs).collect()} == want
    counts = sorted((d, g, n) for d, each in grams.items() for g, n in Counter(each).items())
    assert sorted(tuple(r) for r in dedup.shingle_counts(docs).collect()) == counts
    assert "Exchange" not in dedup.shingle_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in dedup.shingle_counts(docs.union(docs)).collect()) == [(d, g, 2 * n) for d, g, n in counts]


def test_python_holds_texts_and_not_their_shingles(spark):
    """A batch that Python was given held every shingle as a string of its own, some eight times the text."""
    plan = dedup.fingerprints(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text")))._jdf.queryExecution().analyzed().toString()
    assert "grams" not in plan and "words" in plan


def test_totals_and_folds(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, x long").repartition(5)
    got = {r.i: r.s for r in ordered.total_before(df, ["i"], "x", "s").collect()}
    assert got == {i: sum(x for j, _, x in rows if j < i) for i, _, _ in rows}
    assert ordered.total_before(df.limit(0), ["i"], None, "n").count() == 0


def test_places_of_a_hot_group(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(20)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, x long").repartition(5)
    got = {r.i: r.place for r in ordered.places(df, "g", [F.desc("x"), "i"], "place").collect()}
    for g in ("hot", "b", None):
        mine = sorted((i for i, h, _ in rows if h == g), key=lambda i: (-rows[i][2], i))
        assert [got[i] for i in mine] == list(range(len(mine)))
    assert ordered.places(df.limit(0), "g", ["i"], "place").count() == 0


def test_cache_replay(spark):
    rows = [("s", i, k) for i, k in enumerate("abcabdacca")] + [("t", 0, "a")]
    got = {(r.stream, r.seq): r.hit for r in serving.lru_hits(spark.createDataFrame(rows, "stream string, seq long, key string"), 2).collect()}
    cache, want = [], {}
    for s, i, k in rows[:-1]:
        want[s, i] = k in cache
        cache = [x for x in cache if x != k][-1:] + [k]
    assert got == want | {("t", 0): False}
    assert not any(r.hit for r in serving.lru_hits(spark.createDataFrame(rows, "stream string, seq long, key string"), 0).collect())


def test_hedging(spark):
    rows = [(1, 0, 50.0, True), (1, 1, 5.0, True), (2, 0, 3.0, False), (2, 1, 4.0, True), (3, 0, 2.0, True), (4, 0, 1.0, False)]
    got = {r.request: r.latency for r in serving.hedged(spark.createDataFrame(rows, "request int, replica int, latency double, ok boolean"), 10.0).collect()}
    assert got == {1: 15.0, 2: 7.0, 3: 2.0, 4: None}


def test_pagerank_mass_and_empty(spark):
    vertices = spark.createDataFrame([(i,) for i in range(4)], "v long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2), (0, 2)], "src long, dst long")
    ranks, rounds, converged = graph.power_iteration(edges, vertices)
    assert converged and rounds < 100 and abs(sum(r.rank for r in ranks.collect()) - 1) < 1e-3
    ranks, rounds, converged = graph.power_iteration(edges.limit(0), vertices.limit(0))
    assert converged and rounds == 0 and ranks.count() == 0


def test_evaluation_edges(spark):
    ranked = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 2), ("q3", "x", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q1", "d1", 3), ("q1", "d2", 1), ("q2", "d9", 2)], "query_id string, doc_id string, grade int")
    got = {r.query_id: r for r in evaluation.relevance(ranked, qrels, 10).collect()}
    assert got["q1"].ndcg == 1 and got["q1"].mrr == 1 and got["q1"].recall == 1 and got["q1"].ap == 1
    assert (got["q2"].ndcg, got["q2"].mrr, got["q2"].recall, got["q2"].ap) == (0, 0, 0, 0) and got["q3"].dcg == 0
    ms = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    assert [evaluation.nearest_rank(ms, q).first().x for q in (-1, 0.5, 0.99, 2)] == [1, 51, 99, 100]
    assert evaluation.nearest_rank(ms.limit(0), 0.5).first().x == 0


def test_fusion_and_models(spark):
    lists = spark.createDataFrame([(0, 1, 1, 0, 5.0), (0, 1, 2, 1, 5.0), (1, 1, 2, 0, 9.0), (1, 2, 1, 1, 1.0)], "list_id int, segment int, local int, rank0 int, score double")
    got = {(r.segment, r.local): r.score for r in rank.rrf(lists, 0).collect()}
    assert abs(got[1, 2] - (1 / 62 + 1 / 61)) < 1e-12
    weights = spark.createDataFrame([(0, 1.0), (1, 0.0)], "list_id int, weight double")
    assert {(r.segment, r.local): r.score for r in rank.linear_fusion(lists, weights).collect()} == {(1, 1): 1.0, (1, 2): 1.0}
    assert rank.check_model(11) and not rank.check_model(10)


def test_bm25_invariants(spark):
    row = spark.range(1).select(index.idf(100, F.lit(1)).alias("rare"), index.idf(100, F.lit(90)).alias("common"), index.idf(100, F.lit(500)).alias("over"), index.saturated(F.lit(1.0), F.lit(0.0)).alias("none")).first()
    assert row.rare > row.common > row.over > 0 and row.none == 0


def test_next_posting_and_empty_query(spark):
    posts = spark.createDataFrame([("t", d, 1) for d in (1, 5, 9)], "term string, doc_id long, tf long")
    targets = spark.createDataFrame([("t", 5), ("t", 6), ("t", 10), ("u", 0)], "term string, target int")
    assert {(r.term, r.target): r.doc_id for r in index.next_at_or_after(posts.withColumn("block", F.floor(F.col("doc_id") / 6).cast("long")), index.blocks(posts, 2), targets).collect()} == {("t", 5): 5, ("t", 6): 9, ("t", 10): None, ("u", 0): None}
    none = spark.createDataFrame([], "term string, weight double")
    assert index.top_documents(index.disjunction(posts, none), 5).count() == 0
    assert index.top_documents(index.disjunction(posts, spark.createDataFrame([("t", 1.0)], "term string, weight double")), 0).count() == 0


def test_sealed_index(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(10_000, None), (None, "lost")], "doc_id long, text string"), allowMissingColumns=True)
    found = index.seal(docs, ordered.new_path(spark, "test-index"), ("source",))
    posts = index.postings(docs.where("doc_id IS NOT NULL"))
    assert found.postings.select("term", "doc_id", "tf").exceptAll(posts.select("term", "doc_id", "tf")).count() == 0 == posts.count() - found.postings.count()
    assert {tuple(r) for r in found.dictionary.select("term", "df", "cf", "max_tf", "singleton").collect()} == {tuple(r) for r in index.dictionary(posts).collect()}
    assert {tuple(r) for r in found.blocks.drop("cf").collect()} == {tuple(r) for r in index.blocks(posts).collect()}
    stored = found.stored.orderBy("local").collect()
    assert [r.local for r in stored] == list(range(docs.count() - 1)) and [r.doc_id for r in stored] == sorted(r.doc_id for r in stored)
    assert stored[-1].length == stored[-1].norm == 0
    plan = index.lookup(found.postings, "thing")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,thing)]" in plan


def test_lists_dealt_over_tasks_are_whole(spark, monkeypatch):
    """Terms in most documents are cut into buckets and dealt; blocks that two tasks begin and end are put together. Keys that repeat are one document."""
    monkeypatch.setattr(index, "SPAN", 100)
    rng = random.Random(5)
    rows = [(d * 3, " ".join(t for t, p in (("a", 0.99), ("b", 0.7), ("c", 0.1), (f"w{d % 50}", 1.0)) for _ in range(rng.randint(1, 3)) if rng.random() < p)) for d in range(4000)]
    rows += [(30, "a a b new"), (30, "a"), (12_001, None), (12_002, ""), (None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = index.seal(docs, ordered.new_path(spark, "test-index"), size=16)
    posts = index.postings(docs.where("doc_id IS NOT NULL"))
    whole = {}
    for r in posts.collect():
        whole.setdefault(r.term, []).append((r.doc_id, r.tf))
    assert spark.read.parquet(f"{found.path}/seams").count() > 3
    lists = {(r.term, r.block): r for r in found.lists.collect()}
    assert len(lists) == found.lists.count() == sum(-(-len(p) // 16) for p in whole.values())
    for term, listed in whole.items():
        listed.sort()
        for k in range(0, len(listed), 16):
            r, part = lists[term, k // 16], listed[k : k + 16]
            assert list(zip(r.docs, r.tfs, strict=True)) == part
            assert r.gaps == [d - (listed[k + i - 1][0] if k + i else 0) for i, (d, _) in enumerate(part)]
            assert (r.first_doc, r.last_doc, r.max_tf, r.cf, r.n) == (part[0][0], part[-1][0], max(n for _, n in part), sum(n for _, n in part), len(part))
    assert {tuple(r) for r in found.dictionary.collect()} == {tuple(r) for r in index.dictionary(posts).collect()}
    assert sorted((r.term, r.doc_id) for r in formats.decoded(found.lists).collect()) == sorted((r.term, r.doc_id) for r in posts.collect())
    assert sorted(r.local for r in found.stored.collect()) == list(range(len(rows) - 1))
    parts = sorted(formats.export_lists(found.lists, found.dictionary, found.stored.select("doc_id", F.lit("d").alias("name"), "length"), "dealt").collect(), key=lambda r: (r.part, r.key.encode(), r.place))
    assert {t: p for t, _, _, p in formats.read_export(b"".join(bytes(r.data) for r in parts))["lists"]} == whole


def test_queries_on_blocks_shuffle_nothing(spark, sf):
    for name in ("ciff_postings", "ciff_gap_decode", "bitpack_width_stats", "groupvarint_size", "pfor_choose_width", "posting_blocks"):
        assert "Exchange" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name


def test_pruned_searches_equal_the_plain_one(spark):
    rng = random.Random(3)
    for k in range(4):
        words = {d: [t for t, p in (("a", 0.9), ("b", 0.3), ("c", 0.02)) for _ in range(rng.randint(1, 9)) if rng.random() < p] for d in range(3000)}
        docs = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string")
        found = index.seal(docs, ordered.new_path(spark, "test-index"))
        terms = spark.createDataFrame([("a", 0.1), ("b", rng.random()), ("c", 3.0), ("c", 0.5), ("absent", 1.0)][: 5 if k else 2], "term string, weight double")
        plain = [(r.doc_id, round(r.score, 9)) for r in index.top_documents(index.disjunction(found.postings, terms), 10).collect()]
        assert plain == [(r.doc_id, round(r.score, 9)) for r in index.wand(found, terms, 10).collect()]
        assert plain == [(r.doc_id, round(r.score, 9)) for r in index.block_max(found, terms, 10).collect()]
        if k:
            assert "a" not in index.bounds(found, terms, 10).essential()
    assert index.wand(found, terms, 0).count() == index.block_max(found, terms.where("term = 'absent'"), 5).count() == 0
    with pytest.raises(ValueError):
        index.bounds(found, spark.createDataFrame([("a", -1.0)], "term string, weight double"), 5)


def test_vector_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(v, q, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.graph_search(vectors.graph_index(v), q, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    coarse = vectors.product_encoded(v, vectors.product_codebook(v, 8, rounds=0)).agg(F.avg("distortion")).first()[0]
    assert vectors.product_encoded(v, vectors.product_codebook(v, 8)).agg(F.avg("distortion")).first()[0] < coarse
    with pytest.raises(ValueError):
        vectors.product_codebook(v, 7)


def test_searches_in_blocks(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    codes = v.select("vec_id", "embedding", F.xxhash64("vec_id").alias("code"))
    q, book = codes.where("vec_id % 20 = 0"), vectors.product_codebook(v, 8, rounds=0)
    coded = vectors.product_encoded(v, book).select("vec_id", "codes")
    searches = [
        lambda: [(r.query_id, r.vec_id, r.rank, round(r.distance, 9)) for r in vectors.nearest(v, q, 5).collect()],
        lambda: [(r.query_id, r.vec_id) for r in vectors.nearest_codes(codes, q, 5).collect()],
        lambda: [(r.query_id, r.vec_id, r.rank) for r in vectors.asymmetric_top(coded, q, book, 5).collect()],
    ]
    plain = [sorted(f()) for f in searches]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 90)
    assert [sorted(f()) for f in searches] == plain
    assert len(plain[0]) == 5 * q.count()
    exact = {x[:2] for x in plain[0]}
    monkeypatch.setattr(vectors, "SEGMENT", 150)
    found = {(r.query_id, r.vec_id) for r in vectors.graph_search(vectors.graph_index(v), q, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert vectors.nearest(v.limit(0), q, 5).count() == 0 and vectors.nearest(v, q.limit(0), 5).count() == 0


def test_claims_and_citations():
    assert [c for c, _, _ in answer.claims("Pi is 3.14. Yes?! No")] == ["Pi is 3.14.", "Yes?!", "No"]
    clean, claims = answer.citations("Sky is blue. [1][3] Grass is green.[2]\nNo mark. Tail [4]")
    assert clean == "Sky is blue. Grass is green. No mark. Tail [4]"
    assert [(c, k) for c, _, _, k in claims] == [("Sky is blue.", [0, 2]), ("Grass is green.", [1]), ("No mark.", []), ("Tail [4]", [])]
    assert all(clean.encode()[a:z].decode() == c for c, a, z, _ in claims)
    assert answer.citations("Zero. [0] More.")[1][0][3] == []
    assert answer.claims("") == [] and answer.citations("") == ("", [])


def test_claims_of_odd_documents(spark):
    """More texts than are worked off at once, and null ones, which failed."""
    texts = [None, "", "A b. C d! e", "\u00e9\u00e9. x?", *[f"n {i}. m" for i in range(150)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r)[:5] for r in platform.parsed(docs, "claims").collect())
    assert got == [(d, i, *c) for d, text in enumerate(texts) for i, c in enumerate(answer.claims(text or ""))]
    cited = [(r.doc_id, r.claim, r.chunks) for r in platform.parsed(spark.createDataFrame([(7, "One. [2][1] Two.")], "doc_id long, text string"), "citations").collect()]
    assert cited == [(7, "One.", [1, 0]), (7, "Two.", [])]


def test_grounding(spark):
    answers = spark.createDataFrame([("q", "héllo world", 2), ("r", "none", 0)], "query_id string, answer string, n_chunks int")
    supports = spark.createDataFrame([("q", 0, 0, 6, [0], "héllo"), ("q", 1, 0, 12, [1], "héllo world"), ("q", 2, 7, 12, [0, 1], "world")], "query_id string, i int, start int, end int, chunks array<int>, span string")
    assert {r.query_id: r.marked for r in answer.inserted(answers, supports).collect()} == {"q": "héllo[1] world[1][2][2]", "r": "none"}
    assert {r.query_id: r.problem for r in answer.validated(answers, supports).collect()} == {"q": None, "r": None}
    wrong = supports.withColumn("end", F.when(F.col("i") == 1, 99).otherwise(F.col("end"))).withColumn("chunks", F.when(F.col("i") == 0, F.array().cast("array<int>")).otherwise(F.col("chunks")))
    assert {r.query_id: r.problem for r in answer.validated(answers, wrong).collect()}["q"] == "no chunk"


def test_grounding_of_empty_and_null_documents(spark, tmp_path):
    rows = [(i, text) for i, text in enumerate(["", None, "a", "", "é", None, "\n", None, "ten bytes and more", *[""] * 20])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("ground_validate", "ground_insert"):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=repr) == sorted(duck.sql(ORACLE_SQL[name]).fetchall(), key=repr)


def test_crowd_bias_is_removed(spark):
    rows = spark.range(20_000).select(F.col("id").alias("report"), F.lit("q").alias("query"), F.lit(1).alias("doc"), (F.col("id") % 10 < 7).alias("good"), F.lit(False).alias("last_longest"), F.lit(True).alias("pogo"))
    got = crowd.debiased(crowd.tallied(crowd.privatized(rows, 1.0, "s")), 1.0).first()
    assert abs(got.good / 20_000 - 0.7) < 0.035 and abs(got.pogo / 20_000 - 1) < 0.05
    with pytest.raises(ValueError):
        crowd.debiased(crowd.tallied(rows), 0.0)
    with pytest.raises(ValueError, match="secret"):
        crowd.privatized(rows, 1.0, "")
    with pytest.raises(ValueError, match="secret"):
        crowd.secret_of(spark)
    one, two = (crowd.privatized(rows, 1.0, s).where("good").select("report") for s in ("s", "t"))
    assert one.exceptAll(two).count() > 1000


def test_rounding_is_that_of_sql(spark, tmp_path):
    """Prices that aren't whole cents come near halves, where Spark's own rounding goes by the shortest decimal."""
    rng = np.random.default_rng(2)
    xs = [*np.round(rng.uniform(-100, 100, 20_000), 5).tolist(), *rng.uniform(0, 3e8, 20_000).tolist(), 0.285, 1.005, -0.00005, 1e300, -1e17, 4503599627370495.5, float("inf"), None]
    spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").select("i", "x", *[sql_round("x", n).alias(f"r{n}") for n in (2, 4, 6)]).coalesce(1).write.parquet(str(tmp_path / "r"))
    table = f"'{tmp_path}/r/*.parquet'"
    for n in (2, 4, 6):
        assert duckdb.sql(f"SELECT x, r{n} FROM {table} WHERE round(x, {n}) IS DISTINCT FROM r{n}").fetchall() == []
    spark.createDataFrame([(i, x) for i, x in enumerate(xs) if x is not None and 0 <= x < 1e9], "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(tuple(r) for r in QUERIES["cap_token_cost"](spark, str(tmp_path)).collect()) == sorted(duck.sql(ORACLE_SQL["cap_token_cost"]).fetchall())


def test_telemetry_edges(spark):
    calls = spark.createDataFrame([("m", 2000.0, None, 1), ("m", 3000.0, "x", 2)], "method string, ms double, error string, seq long")
    assert telemetry.quantile(telemetry.histogram(calls), 0.5).first().x == 1000.0
    bad = spark.range(1).select(telemetry.extracted(F.create_map(F.lit("trace"), F.lit("zz"), F.lit("span"), F.lit("3"))).alias("x")).first().x
    assert (bad.trace, bad.valid, bad.sampled) == (None, False, False)
    assert {r.sampled for r in telemetry.ratio_sampled(spark.range(5).select(F.col("id").alias("trace_id")), 1.0).collect()} == {True}


def test_depths_of_spans_have_no_limit_of_rows(spark):
    """Recursive SQL stops at a million rows (here at six); a chain, a star, a loop that no root leads to and a lost parent."""
    rows = [(0, None), *[(i, i - 1) for i in range(1, 12)], (20, None), *[(i, 20) for i in range(21, 29)], (40, 41), (41, 40), (50, 49)]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "6")
    try:
        got = sorted((r.span, r.depth) for r in telemetry.depths(spark.createDataFrame(rows, "span long, parent long")).collect())
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == [*[(i, i) for i in range(12)], (20, 0), *[(i, 1) for i in range(21, 29)]]
    assert telemetry.depths(spark.createDataFrame([(1, 1)], "span long, parent long")).count() == 0


def test_trace_tree_over_few_rows_a_level(spark, tmp_path):
    """Before, the query itself failed where a recursion may return fewer rows than there are events."""
    spark.range(100).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {r.span: r.depth for r in QUERIES["trace_tree"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {i: (0, 1, 1, 2, 2, 2, 2, 3)[i % 8] for i in range(100)}


def test_placement_goes_on_after_a_restart(spark, tmp_path):
    """Membership that comes in three files, a batch each, with the stream stopped in between."""
    shards = spark.createDataFrame([(i,) for i in range(12)], "shard long")
    for k, rows in enumerate(([(1, "join", "a"), (2, "join", "b")], [(3, "join", "c")], [(4, "leave", "a")])):
        spark.createDataFrame(rows, "seq int, op string, node string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema("seq int, op string, node string").parquet(str(tmp_path / "log"))
        live.reconciled(spark, stream, shards, 2, str(tmp_path / "routes"), str(tmp_path / "offsets"))
    rows = spark.read.parquet(str(tmp_path / "routes"))
    last = {r.shard: r.nodes for r in rows.groupBy("shard").agg(F.max_by("nodes", "batch").alias("nodes")).collect()}
    want = {r.shard: r.nodes for r in control.assignment(control.placed(shards, ["b", "c"], 2)).collect()}
    assert last == want
    assert [r["count"] for r in rows.groupBy("batch").count().orderBy("batch").collect()][0] == 12


def test_late_events_are_left_out(spark, tmp_path):
    first = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 10:30:00", "a", 1.0)], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts"))
    late = spark.createDataFrame([("2024-01-01 08:00:00", "a", 5.0), ("2024-01-01 12:00:00", "a", 1.0), ("2024-01-01 12:00:00", "a", 1.0)], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts"))
    folder = tmp_path / "in"
    folder.mkdir()  # a stream's folder must be there
    stream = spark.readStream.schema(first.schema).parquet(str(folder))
    for i, part in enumerate((first, late)):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        query = live.windowed(stream, "ts", "10 minutes", "1 hour", "k").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
    got = {(r.window.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(10, 2)}


def test_command_line(capsys):
    from quarry.__main__ import main

    assert main(["plan"]) == 0 and "M9" in capsys.readouterr().out
    assert main(["risks"]) == 0 and capsys.readouterr().out.count("(primary)") == 1
    assert main([]) == 0 and main(["version"]) == 0 and main(["--version"]) == 0
    assert main(["nothing"]) == 2


def test_shared_loads():
    import threading

    loads, calls, gate = serving.SharedLoads(1), [], threading.Event()

    def slow():
        calls.append(1)
        gate.wait(10)
        return "x"

    got = []
    waiting = [threading.Thread(target=lambda: got.append(loads.get("k", slow))) for _ in range(4)]
    for t in waiting:
        t.start()
    with pytest.raises(TimeoutError):
        loads.get("k", slow, 0.05)
    gate.set()
    for t in waiting:
        t.join(10)
    assert got == ["x"] * 4 and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        loads.get("bad", lambda: 1 / 0)
    assert loads.get("bad", lambda: 2) == 2 and loads.get("k", lambda: "new") == "new"


def test_every_claim_is_verified(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    texts, langs = {r.doc_id: r.text for r in docs}, {r.doc_id: r.lang for r in docs}
    claims = [(d, i, c, p) for d, t in texts.items() for i, (c, _, _) in enumerate(answer.claims(t)) for p in (d, d + 1) if p in texts and (len(t) < 2000 or i % 7 == 0)]
    rows = spark.createDataFrame(claims, "doc_id long, claim_id long, claim string, passage long").join(spark.createDataFrame(list(texts.items()), "passage long, text string"), "passage")
    want = {(r.doc_id, r.claim_id, r.passage): (r.v.entailed, round(r.v.score, 6)) for r in rows.withColumn("v", answer.overlap(F.col("claim"), F.col("text"))).collect()}
    got = {(r.doc_id, r.claim_id, r.passage): (r.entailed, r.score) for r in QUERIES["verify_overlap_claims"](spark, sf).collect()}
    assert len(got) == sum(len(answer.claims(t)) * (1 + (d + 1 in texts)) for d, t in texts.items())
    assert {k: got[k] for k in want} == want
    best = {}
    for (d, i, _), v in got.items():
        best[d, i] = max(best.get((d, i), (False, 0.0)), v)
    assert {(r.doc_id, r.claim_id): (r.entailed, r.score) for r in QUERIES["verify_best_passage_claims"](spark, sf).collect()} == best
    for r in QUERIES["verify_correct_claims"](spark, sf).collect():
        keep = [e for (d, _), (e, _) in best.items() if langs[d] == r.query_id]
        assert (r.kept, r.dropped, r.verified) == (sum(keep), len(keep) - sum(keep), all(keep))
