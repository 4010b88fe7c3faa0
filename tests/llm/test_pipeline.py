"""The pipeline's stages in turn, each against a brute-force version of it on what the one before kept."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import brute_lines, brute_similar, brute_tokens, rows_of

import corpus_pipeline
from quarry.llm import line_dedup, mixing, quality, queries

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "best-fit packing"]


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality rules"](spark, docs, sf).cache()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {d for d, kept in duck.sql(f"SELECT doc_id, kept FROM ({queries.quality_sql()})").fetchall() if kept}
    assert good.columns == COLUMNS
    assert Counter(rows_of(good, *COLUMNS)) == Counter(r for r in rows_of(docs, *COLUMNS) if r[0] in want)

    lines = stages["line dedup"](spark, good, sf).cache()
    brute = {d: t for d, t, _, _ in brute_lines(rows_of(good, "doc_id", "text", "source"), line_dedup.MIN_SITES, line_dedup.MIN_CHARS)}
    assert lines.columns == COLUMNS and lines.count() == good.count()
    for d, t, n in rows_of(lines, "doc_id", "text", "n_chars"):
        assert t == brute[d] and n == len(t)

    single = stages["simhash near-dedup"](spark, lines, sf).cache()
    rows = rows_of(lines, "doc_id", "text")
    norm = lambda t: b" ".join(t.encode().lower().split())
    root = {norm(t): norm(t) for _, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_similar(rows):
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for d, t in rows:
        groups[find(norm(t))].append(d)
    kept = {d for (d,) in rows_of(single, "doc_id")}
    assert single.columns == COLUMNS
    assert kept == {min(g) for g in groups.values()}

    mixed = stages["mixing"](spark, single, sf).cache()
    rated = mixing.mix(single, spark.read.parquet(f"{sf}/labels.parquet"), corpus_pipeline.SHARES, queries.vocabulary(corpus_pipeline.VOCABULARY), budget="clean", most=1.0)
    assert mixed.columns == COLUMNS
    assert {d for (d,) in rows_of(mixed, "doc_id")} == {r.doc_id for r in rated.collect() if r.copies >= 1}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    stayed = {d for (d,) in rows_of(mixed, "doc_id")}
    assert len(clean & stayed) >= 0.95 * len(clean & kept)

    packed = rows_of(stages["best-fit packing"](spark, mixed, sf), "doc_id", "piece", "length", "ids_crc32", "sequence_id", "offset")
    want = Counter((d, k, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for d, ids in brute_tokens(mixed, "word_bpe_49k.json", 1) for k, a in enumerate(range(0, len(ids), 4096)))
    assert Counter(r[:4] for r in packed) == want
    filled = defaultdict(list)
    for *_, length, _, sequence, offset in packed:
        filled[sequence].append((offset, length))
    for places in filled.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096

    whole = rows_of(corpus_pipeline.run(spark, sf), "doc_id", "piece", "length", "ids_crc32")
    assert Counter(whole) == want


def test_boilerplate_goes_from_documents_that_are_mostly_boilerplate(spark, sf):
    shared = "a line that all of the pages have\nand one more that they share"
    rows = [(i, f"{shared}\nown {i}", "en", f"s{i}", 0) for i in range(6)]
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert dict(rows_of(out, "doc_id", "text")) == {0: rows[0][1]} | {i: f"own {i}" for i in range(1, 6)}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_an_id_are_decided_each(spark, sf):
    good = " ".join(f"word{i}" for i in range(40))
    stages = dict(corpus_pipeline.STAGES)
    rows = [(None, f"{good} a", "en", "s1", 1), (None, "short", "en", "s1", 2), (1, f"{good} b", "en", "s1", 3), (1, "short", "en", "s2", 4), (2, f"{good} c", None, None, None)]
    kept = stages["quality rules"](spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[1] != "short")
    rows = [(d, " ".join(f"{k}{i}" for i in range(30)), "en", "s", i) for i, (d, k) in enumerate(zip((None, None, None, 5, 5, 6), "abcdef", strict=True))]
    copies = [*rows, rows[0], rows[3], (None, rows[3][1], "en", "s", 9), (4, rows[5][1], "fr", "s", 9)]
    kept = stages["simhash near-dedup"](spark, spark.createDataFrame(copies, SCHEMA), sf)
    assert Counter(map(tuple, kept.collect())) == Counter([*rows[:5], copies[-1]])


@pytest.mark.parametrize("rows", ["odd", "none"])
@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs, stage, rows):
    docs = odd_docs if rows == "odd" else no_docs
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf)
    found, every = out.collect(), rows_of(docs, *COLUMNS)
    if stage == "best-fit packing":
        want = Counter((d, len(ids)) for d, ids in brute_tokens(docs, corpus_pipeline.VOCABULARY, 1))
        whole = Counter()
        for r in sorted(found, key=lambda r: r.piece):
            whole[r.doc_id] += r.length
        assert whole == sum((Counter({d: n * k}) for (d, n), k in want.items()), Counter())
        return
    assert out.columns == COLUMNS
    if stage == "quality rules":
        hosts = {(r.doc_id, r.text_hash, r.host): r.kept for r in quality.quality_rules(docs).collect()}
        hashes = rows_of(docs.select(*COLUMNS, F.xxhash64("text").alias("h")), "h")
        assert Counter(map(tuple, found)) == Counter(r for r, (h,) in zip(every, hashes, strict=True) if hosts[r[0], h, r[3]])
    elif stage == "line dedup":
        brute = brute_lines([(r[0], r[1], r[3]) for r in every], line_dedup.MIN_SITES, line_dedup.MIN_CHARS)
        assert Counter((r.doc_id, r.text) for r in found) == sum((Counter({(d, t): k}) for (d, t, _, _), k in brute.items()), Counter())
    elif stage == "simhash near-dedup":
        norm = lambda t: b" ".join((t or "").encode().lower().split())
        near = {frozenset(x) for x in brute_similar([(r[0], r[1]) for r in every])}
        kept = [norm(r.text) for r in found]
        assert len(kept) == len(set(kept)) and not any({a, b} in near for a in kept for b in kept if a != b)
        assert all(norm(r[1]) in kept or any(norm(r[1]) in pair for pair in near) for r in every)
        assert not Counter(map(tuple, found)) - Counter(every)
    else:
        assert not Counter(map(tuple, found)) - Counter(every)
