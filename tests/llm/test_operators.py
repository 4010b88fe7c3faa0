"""Each operator against a brute-force version, on the supplied tables and on a table of odd rows."""

import datetime
import gc
import hashlib
import random
import re
import threading
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quarry.llm import components as cc
from quarry.llm import buckets, embed_dedup, encode, line_dedup, mixing, packing, pii, quality, queries, sharding, simhash, token_counts, token_files

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]


def docs_at(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(params=["table", "odd", "empty"])
def docs(request, spark, sf):
    return {"table": lambda: docs_at(spark, sf), "odd": lambda: request.getfixturevalue("odd_docs"), "empty": lambda: request.getfixturevalue("no_docs")}[request.param]()


# --- encoding


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, blanks):
    library = encode.load(queries.vocabulary(name))
    rng = random.Random(3)
    bits = ["a", "the", " ", "\n", "  ", "'s", "don't", ".", "!!", "é", "é", "İ", "ß", "12", "\t", " ", "<|endoftext|>", "ﬁ", "\U0001d518", "Σ", "word", "\r", "­"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encode.rule(queries.vocabulary(name)) == ("bytes" if blanks else "words")
    assert encode.Encoder(queries.vocabulary(name))(texts) == want
    assert encode.Encoder(queries.vocabulary(name), counts=True)(texts) == [len(x) // 4 for x in want]


def test_encoder_memo_generations(monkeypatch):
    monkeypatch.setattr(encode, "MEMO", 5)
    path = queries.vocabulary("byte_bpe_50k.json")
    texts = [f"w{i} shared x{i % 7} y{i}z.\nline{i} again" for i in range(50)]
    want = [len(x.ids) for x in encode.load(path).encode_batch(texts, add_special_tokens=False)]
    assert encode.Encoder(path, counts=True)(texts) == want


def test_encoder_is_freed_at_once():
    """By the next one, and by the steps that don't encode; without a search for cycles, which comes too late in a worker."""
    path = queries.vocabulary("word_bpe_49k.json")

    class Rows:
        def mapInArrow(self, step, schema):  # noqa: N802
            return list(step(iter(())))

    def filled(counts):
        made = encode.encoder(path, counts)
        assert made(["some words, and others"])
        return weakref.ref(made)

    gc.disable()
    try:
        first, second = filled(False), filled(True)
        assert first() is None and second() is not None
        simhash.copies_of(Rows())
        assert second() is None
        third = filled(True)
        assert list(buckets._groups(iter(()), lambda table, group: None, "a long, b long", buckets.SMALL)) == []
        assert third() is None
    finally:
        gc.enable()


# --- 2: shards


def test_shards(docs):
    tree = sharding.Tree.build(24)
    got = sharding.assign_shards(docs, tree, tree.expanded()).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in rows_of(docs, "doc_id", "text")
    )
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        by[r.shard].append((r.slot, r.doc_id if r.doc_id is not None else -1))
    for slots in by.values():
        assert [s for s, _ in sorted(slots)] == list(range(len(slots)))
        assert [d for _, d in sorted(slots)] == sorted(d for _, d in slots)
    home = defaultdict(set)
    for r in got:
        home[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in home.values())


def test_tree_moves_only_where_weights_change(spark):
    tree = sharding.Tree.build(24)
    keys = spark.range(6000)
    heavy = tree.reweighted(13, 4.0)
    found = keys.select(*[sharding.choose(F.col("id").cast("string"), t).alias(n) for t, n in ((tree, "a"), (heavy, "b"), (tree.expanded(2.0), "c"))]).collect()
    regions = {s: (r, k) for r, region in enumerate(tree.regions) for k, rack in enumerate(region) for s, _ in rack}
    for r in found:
        if r.a != r.b:  # only into shard 13's region; inside it only into its rack; inside that only into it
            (ra, ka), (rb, kb) = regions[r.a], regions[r.b]
            assert rb == regions[13][0]
            if ra == rb:
                assert kb == regions[13][1]
                assert ka != kb or r.b == 13
        assert r.c in (r.a, 24)
    counts = Counter(r.a for r in found)
    assert max(counts.values()) < 1.35 * 250 and min(counts.values()) > 0.65 * 250
    assert abs(sum(r.c == 24 for r in found) - 6000 * 2 / 26) < 100


# --- 5: token files


def brute_tokens(docs, name, end):
    library = encode.load(queries.vocabulary(name))
    out = []
    for d, t in rows_of(docs, "doc_id", "text"):
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4")
        out.append((d, ids))
    return out


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(docs, bits):
    got = rows_of(token_files.token_files(docs, queries.vocabulary("byte_bpe_50k.json"), 2, bits), "doc_id", "start", "n_tokens", "ids_crc32")
    want = [(d, len(i), zlib.crc32(i.tobytes())) for d, i in brute_tokens(docs, "byte_bpe_50k.json", 2)]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter(want)
    got.sort(key=lambda r: r[1])
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got]).tolist()][: len(got)]
    order = [-1 if d is None else d for d, *_ in got]
    assert order == sorted(order)


@pytest.mark.parametrize("bits", [False, True])
def test_token_file_format(tmp_path, bits):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, top, n).astype("<u4") for top, n in ((50_000, 0), (50_000, 7), (2, 300), (2**32, 90), (1, 20))]
    with open(tmp_path / "x.tok", "wb") as out:
        writer = token_files.Writer(out, bits, block=64)
        for x in parts:
            writer.add(x.tobytes())
        writer.close()
    with open(tmp_path / "x.tok", "rb") as file:
        reader = token_files.Reader(file)
        assert [x.tolist() for x in reader.documents()] == [x.tolist() for x in parts]
        assert reader.block(2).tolist() == np.concatenate(parts)[128:192].tolist()
    data = (tmp_path / "x.tok").read_bytes()
    (tmp_path / "bad.tok").write_bytes(data[:-60] + b"\0" + data[-59:])
    with open(tmp_path / "bad.tok", "rb") as file, pytest.raises(ValueError):
        token_files.Reader(file)


# --- 6: quality


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(docs):
    got = rows_of(quality.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(r[:-1] for r in got) == Counter((d, *brute_quality(t)) for d, t in rows_of(docs, "doc_id", "text"))
    assert not any(kept and failed for *_, failed, kept in got)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 50 else "short", f"h{i % 8}") for i in range(800)] + [(1000 + i, "short" if i else good, "bad") for i in range(60)] + [(2000, "short", "tiny"), (2001, good, "tiny")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert not kept[1000] and kept[1] and not kept[0]
    assert kept[2001]  # one failure of two is no verdict: the prior weighs more


# --- 7: counts


def test_token_counts(docs):
    library = encode.load(queries.vocabulary("byte_bpe_50k.json"))
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows_of(docs, "doc_id", "text"))
    for step, overlap in ((32_768, 512), (700, 40)):
        got = token_counts.token_counts(docs, queries.vocabulary("byte_bpe_50k.json"), step=step, overlap=overlap)
        assert Counter(rows_of(got, "doc_id", "n_bytes", "n_tokens")) == want


def test_token_counts_with_sentencepiece(docs):
    path = queries.vocabulary("piece_bpe_32k.model")
    library = encode.load(path)
    want = Counter((d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in rows_of(docs, "doc_id", "text"))
    got = token_counts.token_counts(docs, path, step=700, overlap=40)
    assert Counter(rows_of(got, "doc_id", "n_bytes", "n_tokens")) == want


def test_a_file_of_another_kind_goes_whole_to_the_library(tmp_path):
    import json

    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        said = json.load(file)
    said["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(said, file)
    assert encode.rule(path) is None
    texts = ["Hello there world", "a\nb", ""]
    assert encode.Encoder(path, counts=True)(texts) == [len(x.ids) for x in encode.load(path).encode_batch(texts, add_special_tokens=False)]


# --- 8: embeddings


def brute_links(rows, threshold):
    ok = [(i, l, np.asarray(v, dtype=float)) for i, (_, v, l) in enumerate(rows) if l is not None and v is not None and None not in v and np.isfinite(np.asarray(v, dtype=float)).all() and np.any(np.asarray(v, dtype=float))]
    ok = [(i, l, v / np.abs(v).max()) for i, l, v in ok]  # else the squares of huge components overflow
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, l, v) in enumerate(ok):
        for j, m, w in ok[a + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    return Counter((r[0], links[i], min((x for x in ids[find(i)] if x is not None), default=None)) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, sf, monkeypatch, block):
    if block == 16:
        meet = embed_dedup.meet
        monkeypatch.setattr(embed_dedup, "meet", lambda *a, **k: meet(*a, **k | {"block": 16}))
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 24))
    rows = [(i, (base[i % 6] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])).tolist(), i % 3) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)] + [rows[1], rows[1], (400, None, 1), (401, [0.0] * 24, 1), (402, [1.0, None], 1), (403, [float("nan")] * 24, 1), (404, [1.0, 2.0], 1), (405, [2.0, 4.0], 1), (406, rows[1][1], None), (None, rows[1][1], rows[1][2]), (407, [1e300, 1e300], 1), (408, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("gid", F.lit("x"))
    got = embed_dedup.embedding_links(df)
    assert Counter(rows_of(got, "vec_id", "n_links", "component_id")) == brute_links(rows, 0.93)
    assert embed_dedup.embedding_links(df.limit(0)).count() == 0
    if block == 1024:
        table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        some = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
        assert Counter(rows_of(embed_dedup.embedding_links(table), "vec_id", "n_links", "component_id")) == brute_links(some, 0.93)


def test_hashes_follow_the_rows():
    near = embed_dedup.agreement(np.sqrt(2 - 2 * 0.93))
    found = [embed_dedup.choose(n, 0.93) for n in (10, 10**3, 10**5, 10**8)]
    assert found == sorted(found, key=lambda x: x[1])
    assert all((1 - near**h) ** t <= embed_dedup.MISS for t, h in found)
    rng = np.random.default_rng(2)
    a, b = embed_dedup.projections(48, 400, 5)
    x = rng.normal(size=(200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + (z := rng.normal(size=x.shape)) / np.linalg.norm(z, axis=1, keepdims=True) * 0.374
    same = np.floor((x @ a + b) / 2.0) == np.floor((y @ a + b) / 2.0)
    assert abs(same.mean() - embed_dedup.agreement(0.374)) < 0.01


def test_codes_never_hide_a_link():
    rng = np.random.default_rng(3)
    for dim in (2, 24, 64, 300):
        x = rng.normal(size=(500, dim))
        y = x + rng.normal(size=x.shape) * rng.choice([0.01, 0.2, 0.4], size=(500, 1))
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        a, b = (embed_dedup.codes(v).astype(float) for v in (x, y))
        linked = (x * y).sum(axis=1) >= 0.93
        close = ((a - b) ** 2).sum(axis=1) <= embed_dedup.code_limit(0.93, a.shape[1])
        assert linked.any() and close[linked].all()
        assert dim < 64 or not ((a - a[::-1]) ** 2).sum(axis=1)[:200].min() <= embed_dedup.code_limit(0.93, a.shape[1])


# --- 9: packing


def test_packing(docs):
    got = rows_of(packing.packed_documents(docs, queries.vocabulary("word_bpe_49k.json"), 1), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = Counter()
    for d, ids in brute_tokens(docs, "word_bpe_49k.json", 1):
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[d, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter(r[:5] for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r[5]].append((r[6], r[3]))
    for places in filled.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r[3] for r in got)
    assert len(filled) <= -(-total // 4096) + max(1, len(filled) // 50)


def test_sequences_hold_the_ids(spark, sf):
    docs = docs_at(spark, sf)
    packed = packing.packed_documents(docs, queries.vocabulary("word_bpe_49k.json"), 1, with_ids=True).cache()
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        s = made[r.sequence_id]
        assert zlib.crc32(bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32
        assert len(s.ids) == 4 * s.length


def exact_bins(items, capacity):
    items = sorted(items, reverse=True)
    for n in range(-(-sum(items) // capacity), len(items) + 1):
        def fit(i, rooms):
            if i == len(items):
                return True
            tried = set()
            for k, room in enumerate(rooms):
                if room >= items[i] and room not in tried:
                    tried.add(room)
                    rooms[k] -= items[i]
                    if fit(i + 1, rooms):
                        return True
                    rooms[k] += items[i]
            return False

        if fit(0, [capacity] * n):
            return n


def test_bin_completion_is_optimal_where_brute_force_can_tell():
    rng = random.Random(4)
    better = 0
    for k in range(150):
        if k % 2:
            items = [rng.randint(8, 60) for _ in range(rng.randint(1, 13))]
        else:  # few lengths, many of each
            kinds = [rng.randint(15, 60) for _ in range(rng.randint(2, 4))]
            items = [rng.choice(kinds) for _ in range(rng.randint(4, 13))]
        counts = Counter(items)
        found = packing.bin_completion(dict(counts), 100, None)
        used = Counter()
        for filling, n in found.patterns:
            assert sum(filling) <= 100
            for x in filling:
                used[x] += n
        assert used == counts and found.bins == sum(n for _, n in found.patterns)
        assert found.proven and found.bound <= found.bins == exact_bins(items, 100)
        better += found.bins < sum(n for _, n in packing.best_fit(dict(counts), 100))
    assert better
    mixed = {53: 2, 35: 2, 34: 3, 23: 4}  # two fillings around one length: fewer repeats than the counts allow
    assert packing.bin_completion(mixed, 100, None).bins == 4


def test_a_spent_budget_is_told():
    rng = random.Random(9)
    counts = Counter(rng.randint(200, 700) for _ in range(400))
    plan = packing.bin_completion(dict(counts), 1000, 3)
    assert plan.proven == (plan.bins == plan.bound) and plan.bound <= plan.bins == sum(n for _, n in plan.patterns)
    used = Counter()
    for filling, n in plan.patterns:
        for x in filling:
            used[x] += n
    assert used == counts


def test_bins_without_contents_equal_best_fit(monkeypatch):
    rng = random.Random(3)
    for _ in range(500):
        capacity = rng.choice([7, 30, 100, 1000])
        counts = {rng.randint(1, capacity): rng.choice([1, 2, 5, 40, 1000]) for _ in range(rng.randint(1, 60))}
        have = [counts.get(x, 0) for x in range(capacity + 1)]
        assert packing.best_fit_bins(have, sorted(counts, reverse=True), capacity) == sum(n for _, n in packing.best_fit(counts, capacity))
    made = []
    monkeypatch.setattr(packing, "best_fit", lambda *a, made_by=packing.best_fit: made.append(made_by(*a)) or made[-1])
    rng = random.Random(1)
    plan = packing.bin_completion(dict(Counter(rng.randint(200, 700) for _ in range(400))), 1000, 50)
    assert not plan.proven
    bins = [sum(n for _, n in x) for x in made]
    assert len(bins) <= 1 + bins[0] - plan.bins  # contents are made for the first packing and for better ones, not at each node


def test_the_search_runs_beside_the_places(spark, monkeypatch):
    began, placed, waited = threading.Event(), threading.Event(), []
    write, search = packing.materialize, packing.bin_completion

    def written(df, tag):
        waited.append(began.wait(20))  # the search begins before the places are found
        out = write(df, tag)
        placed.set()
        return out

    def slow(*a):
        began.set()
        waited.append(placed.wait(60))  # and may end after
        return search(*a)

    monkeypatch.setattr(packing, "materialize", written)
    monkeypatch.setattr(packing, "bin_completion", slow)
    pieces = spark.createDataFrame([(i, 0, 0, 1 + i % 7, i) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, capacity=10)
    assert waited == [True, True] and packed.count() == 50


# --- 10: simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, tau=2):
    """{id or place: least id}; fps is a list of (id, fp)."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= tau:
                root[find(b)] = find(a)
    least = defaultdict(list)
    for d, f in fps:
        least[find(f)].append(d)
    return [(d, f"{f:016x}", min((x for x in least[find(f)] if x is not None), default=None)) for d, f in fps]


def test_simhash(docs):
    got = Counter(rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id"))
    cache = {}
    fps = [(d, cache.setdefault(t, brute_fingerprint(t) if t not in cache else 0)) for d, t in rows_of(docs, "doc_id", "text")]
    assert got == Counter(brute_components(fps))


@pytest.mark.parametrize("block", [2048, 8])
def test_simhash_links(spark, monkeypatch, block):
    meet = simhash.meet
    monkeypatch.setattr(simhash, "meet", lambda *a, **k: meet(*a, **k | {"block": block}))
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for _ in range(500):
        x = rng.choice(base)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    parts = {r.node: r.component for r in cc.components(links).collect()}
    want = {f: c for f, _, c in brute_components([(f, f) for f in fps])}
    groups = defaultdict(set)
    for f, s in zip(fps, signed, strict=True):
        groups[parts.get(s, s)].add(want[f])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(want.values()))


def brute_similar(rows, least=0.8):
    """The links between different texts of rows (doc_id, text), by five-word shingles."""
    sets = {}
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets[b" ".join(w)] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def edited(text, rng, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
    return " ".join(words)


@pytest.mark.parametrize(("block", "size"), [(1024, 16 << 20), (4, 16 << 20), (1024, 8_000)])
def test_near_duplicate_texts(spark, sf, odd_docs, monkeypatch, block, size):
    monkeypatch.setattr(simhash, "TEXTS", block)
    monkeypatch.setattr(simhash, "TEXT_BYTES", size)
    rng = random.Random(3)
    base = rows_of(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    rows = base + [(10_000 + 10 * d + k, edited(t, rng, share)) for d, t in base[:40] for k, share in enumerate((0.005, 0.01, 0.02, 0.1))]
    rows += [(d if d is None else d + 90_000, t) for d, t in rows_of(odd_docs, "doc_id", "text")]
    got = rows_of(simhash.near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")
    assert sorted(str(d) for d, _ in got) == sorted(str(d) for d, _ in rows)
    norm = lambda t: b" ".join((t or "").encode().lower().split())
    links = brute_similar(rows)
    root = {norm(t): norm(t) for _, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = defaultdict(list)
    for d, t in rows:
        least[find(norm(t))].append(d)
    want = {d: min(x for x in least[find(norm(t))] if x is not None) for d, t in rows if d is not None}
    wrong = [d for d, c in got if d is not None and want[d] != c]
    assert len(wrong) <= 0.03 * len(rows)
    assert all(c >= want[d] for d, c in got if d is not None)  # a missed link leaves groups apart, and none is false
    assert len(links) > 60


def passages_changed(words, rng, share):
    """The copies of a text with one passage appended, prepended, cut off either end, put in, or replaced."""
    k = max(1, int(len(words) * share))
    new, at = [f"fresh{rng.randrange(10**9)}" for _ in range(k)], rng.randrange(len(words) - k)
    return [words + new, new + words, words[:-k], words[k:], words[:at] + new + words[at:], words[:at] + new[: max(1, k // 2)] + words[at + max(1, k // 2) :]]


def test_near_duplicate_texts_with_one_passage_changed(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([40, 90, 300, 900]))] for _ in range(60)]
    texts = [" ".join(x) for w in base for share in (0.05, 0.15, 0.19) for x in (w, *passages_changed(w, rng, share))]
    rows = list(enumerate(dict.fromkeys(texts)))
    names = {t.encode(): d for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = brute_similar(rows)
    for a, b in links:
        low, high = sorted((find(names[a]), find(names[b])))
        root[high] = low
    got = dict(rows_of(simhash.near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id"))
    assert len(links) > 600
    assert got == {d: find(d) for d, _ in rows}


def test_near_duplicate_texts_of_nothing(no_docs):
    assert simhash.near_duplicate_texts(no_docs).count() == 0


def test_kept_texts_are_one_of_each_group(spark, odd_docs):
    rows = [(None, "one text of its own"), (None, "another text, as it is"), (None, "the third of them all here"), (5, "a fourth one with more words"), (5, "fifth text that is not like them"), (6, "and a sixth")]
    got = simhash.near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.kept for r in got.collect()] == [True] * 6
    groups = defaultdict(set)
    for t, h, kept in rows_of(simhash.near_duplicate_texts(odd_docs).join(odd_docs.select("doc_id", "text", F.xxhash64("text").alias("h")), "doc_id").where("h = text_hash"), "text", "text_hash", "kept"):
        groups[b" ".join((t or "").encode().lower().split())].add((h, kept))
    assert all(len({h for h, kept in x if kept}) <= 1 for x in groups.values())


def test_loosest_distance_shrinks_with_the_corpus():
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    found = [simhash.loosest(n, both * n) for n in (10, 10**5, 10**8, 10**11, 10**20)]
    assert found[0] == simhash.FIND_TAU and found == sorted(found, reverse=True) and found[-1] == simhash.TAU


def test_thresholds_meet_the_pigeonhole():
    rng = np.random.default_rng(2)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n in (10, 10**6, 10**11):
        for parts in [simhash.plan(n, bits.T @ bits / 500 * n)]:
            assert len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)
            left = 64 - sum(len(p) for p, _ in parts)
            assert sum(t + 1 for _, t in parts) >= 3 and left >= 0


# --- components


def test_links_in_parts_give_the_same_forest():
    draw = np.random.default_rng(5)
    for n in (1, 2, 50, 600):
        for m in (0, 1, n // 2, 4 * n):
            left, right = draw.integers(0, n, m), draw.integers(0, n, m)
            root = np.arange(n)
            for k in range(0, m, 7):
                root = buckets.grown(root, left[k : k + 7], right[k : k + 7])
            assert (root == buckets.forest(left, right, n)).all()


def test_overlaps_of_more_sets_than_a_strip():
    draw = np.random.default_rng(6)
    sets = [set(draw.choice(90, draw.integers(0, 40), replace=False).tolist()) for _ in range(simhash.STRIP + 70)]
    both = simhash._overlaps(np.asarray([x for s in sets for x in sorted(s)], dtype="<u8"), np.asarray([len(s) for s in sets]))
    for i, j in draw.integers(0, len(sets), (4000, 2)).tolist():
        assert i > j or both[i, j] == len(sets[i] & sets[j])


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (50, 30), (300, 280), (200, 199)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 199 else [(i, i + 1) for i in range(199)]
        got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- 1: lines


def brute_lines(rows, min_sites, min_chars):
    sites, first = defaultdict(set), {}
    low = lambda d, p: (d is not None, d or 0, p)
    for d, t, s in rows:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            line = line.strip(" ")
            if len(line) >= min_chars:
                sites[line].add(s)
                first[line] = min(first.get(line, (True, 1 << 62, 0)), low(d, p))
    out = Counter()
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for p, x in enumerate(lines) if len(sites.get(x.strip(" "), ())) < min_sites or low(d, p) == first[x.strip(" ")]]
        out[d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


@pytest.mark.parametrize("min_sites", [2, 5, 10])
def test_lines(docs, min_sites):
    rows = rows_of(docs, "doc_id", "text", "source")
    got = line_dedup.line_dedup(docs, min_sites=min_sites)
    assert Counter(rows_of(got, "doc_id", "text", "n_lines", "n_removed")) == brute_lines(rows, min_sites, line_dedup.MIN_CHARS)


def test_lines_near_the_threshold(spark):
    rows = [(1000 * k + i, f"this is the shared line number {k}\nand own {k} {i}", f"site{i}") for k in range(70, 131, 5) for i in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.line_dedup(df, min_sites=100)
    assert Counter(rows_of(got, "doc_id", "text", "n_lines", "n_removed")) == brute_lines(rows, 100, 15)


# --- 3: private values


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_private_values(spark):
    rows = [
        (1, "Mail ann.lee@mail7.example.com or élan.3@x.org now."), (2, "4111111111111111 and 4111 1111 1111 1111!! 4111-1111-1111-1111 4111111111111112"),
        (3, "call +1 (017) 555-7713%%% or 234-567-8901, no 12345-67"), (4, "ip 233.254.104.120. Version 2.0 and 1.2.3.999 1.2.3.4.5"),
        (5, "born 1984-02-29, 31/12/1999, not 2023-02-30 or 1750-01-01"), (6, "ssn 123-45-6789 666-45-6789 000-12-3456"),
        (7, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"'), (8, None), (9, ""), (10, "plain words only"),
        (11, "again 4111111111111111 and 233.254.104.120"), (12, "4111111111111111" * 3), (None, "1984-02-29"), (1, "Mail ann.lee@mail7.example.com or élan.3@x.org now."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_found", F.lit(1))
    got = pii.pseudonymize(df, "k1").collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r for r in got}
    assert [out[i].n_found for i in range(1, 13)] == [2, 3, 2, 1, 2, 1, 2, 0, 0, 0, 2, 0]  # 234-567-8901 has valid codes, +1 (017) its marks
    assert out[8].text is None and out[9].text == "" and out[10].text == rows[9][1] and out[12].text == rows[11][1]
    cards = re.findall(r"\d[\d -]{14,}\d", out[2].text.split(" 4111111111111112")[0])
    digits = {re.sub(r"\D", "", x) for x in re.findall(r"(?:\d{16}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})", out[2].text)} - {"4111111111111112"}
    assert cards and len(digits) == 1 and luhn(digits.pop()) and "4111111111111112" in out[2].text
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}%%% or \d{3}-\d{3}-\d{4}, no 12345-67", out[3].text) and "555-7713" not in out[3].text
    ip = re.fullmatch(r"ip (\d+\.\d+\.\d+\.\d+)\. Version 2\.0 and 1\.2\.3\.999 1\.2\.3\.4\.5", out[4].text)[1]
    assert ip != "233.254.104.120" and ip in out[11].text
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, \d\d/\d\d/\d{4}, not 2023-02-30 or 1750-01-01", out[5].text) and "1984-02-29" not in out[5].text
    assert out[None].text in out[5].text
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} 666-45-6789 000-12-3456", out[6].text) and "123-45-6789" not in out[6].text
    a, b = re.findall(r'"(\w+)"', out[7].text)
    assert a != b and a == b.lower() and len(a) == 40
    assert "ann.lee" not in out[1].text and "@x.org" not in out[1].text
    other = {r.doc_id: r.text for r in pii.pseudonymize(df, "k2").collect()}
    assert other[11] != out[11].text


def brute_feistel(value, a, b, key, kind):
    left, right = value % a, value // a
    for r in range(8):
        half = right if r % 2 == 0 else left
        f = int(hashlib.sha256("|".join(map(str, (key, kind, a, b, r, half))).encode()).hexdigest()[:13], 16)
        if r % 2 == 0:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return left + a * right


def brute_digits(digits, key, kind):
    low = len(digits) // 2
    return str(brute_feistel(int(digits), 10**low, 10 ** (len(digits) - low), key, kind)).zfill(len(digits))


CODES = {True: [c for c in range(200, 1000) if c % 100 != 11], False: [*range(200), *range(211, 1000, 100)]}


def refilled(shape, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


def brute_pseudonym(m, key):
    """(kind, replacement) of one match, by tables and loops."""
    d = re.sub(r"\D", "", m)
    mac = lambda kind, x: hashlib.sha256("|".join((key, kind, x)).encode()).hexdigest()
    if "@" in m:
        return "email", f"user.{mac('email', m.lower())[:16]}@mail.invalid"
    if re.fullmatch(r"[0-9a-fA-F]{32,64}", m):
        new = mac("secret", m.lower())[: len(m)]
        return "secret", new.upper() if m == m.upper() else new
    if regex.fullmatch(pii.DATE, m):
        us = "/" in m and m[3:5] > "12"
        form = "%Y-%m-%d" if "/" not in m else "%m/%d/%Y" if us else "%d/%m/%Y"
        first = datetime.date(1800, 1, 1)
        try:
            at = (datetime.datetime.strptime(m, form).date() - first).days
        except ValueError:
            return None, m
        if not 0 <= at < 382 * 382:
            return None, m
        while True:
            at = brute_feistel(at, 382, 382, key, "date")
            day = first + datetime.timedelta(days=at)
            if not us or day.day > 12:
                return "date", day.strftime(form)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return None, m
        x = brute_feistel(areas.index(area) * 99 + group - 1 + 898 * 99 * (serial - 1), 898 * 99, 9999, key, "ssn")
        return "ssn", f"{areas[x % (898 * 99) // 99]:03}-{x % (898 * 99) % 99 + 1:02}-{x // (898 * 99) + 1:04}"
    if re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", m):
        parts = m.split(".")
        if max(map(int, parts)) > 255:
            return None, m
        x = brute_feistel(int.from_bytes(bytes(map(int, parts)), "big"), 65536, 65536, key, "ip").to_bytes(4, "big")
        return "ip", ".".join(f"{o:03}" if any(p[0] == "0" < p[1:] for p in parts) else str(o) for o in x)
    if regex.fullmatch(pii.CARD, m):
        if not luhn(d):
            return None, m
        body = brute_digits(d[:-1], key, "card")
        return "card", refilled(m, body + next(c for c in "0123456789" if luhn(body + c)))
    n = re.sub(pii.COUNTRY, "", d) if m[0] == "+" else d
    lead = d[: len(d) - len(n)]
    if m[0] == "+" and not 8 <= len(d) <= 15 or m[0] != "+" and "(" not in m and not (int(d[:3]) in CODES[True] and int(d[3:6]) in CODES[True]):
        return None, m
    if len(n) == 10 and lead in ("", "1"):
        good = int(n[:3]) in CODES[True]
        areas, exchanges = CODES[good], CODES[int(n[3:6]) in CODES[True]] if good else list(range(1000))
        a = len(areas) * len(exchanges)
        x = brute_feistel(areas.index(int(n[:3])) * len(exchanges) + exchanges.index(int(n[3:6])) + a * int(n[6:]), a, 10_000, key, "phone")
        return "phone", refilled(m, f"{lead}{areas[x % a // len(exchanges)]:03}{exchanges[x % a % len(exchanges)]:03}{x // a:04}")
    return "phone", refilled(m, lead + brute_digits(n, key, "phone"))


def brute_private(text, key):
    found = Counter()

    def swap(m):
        kind, new = brute_pseudonym(m[0], key)
        found[kind] += kind is not None
        return new

    return (None if text is None else regex.sub(pii.ANY, swap, text)), found


def test_private_values_equal_brute_force(spark, sf, odd_docs, no_docs):
    rng = random.Random(11)
    say = lambda form: re.sub("9", lambda _: str(rng.randrange(10)), form)
    forms = ["+1 (999) 999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "+19999999999", "+44 99 9999 9999", "+4499999999", "+99999999999999", "9999999999", "9999 9999 9999 9999", "9999 999999 99999", "9999-999999-99999",
             "999-99-9999", "999.99.9.999", "1.02.3.4", "9999-09-29", "0999-09-09", "09/19/1999", "12/29/2009", "29/02/2000", "01/02/2003", "99/99/9999", "a.99@x9.org"]
    texts = [" ".join(say(rng.choice(forms)) + rng.choice(["", ",", "!", " x"]) for _ in range(60)) for _ in range(60)]
    cards = ["378282246310005", "3782 822463 10005", "3782-822463-10005", "4111 1111 1111 1111", "6011000990139424"]
    texts += ["12/25/2024 1899-12-31 2150-03-04 1799-12-31 2199-07-11 2199-07-12 " + " ".join(cards), "000-111-2222 123.456.7890 234.567.8901 +14155550123 4155550123", "1.2.3.4 001.002.003.004 ff" * 3, "say 4111111111111111 now " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for docs in (df, docs_at(spark, sf), odd_docs, no_docs):
        want = Counter()
        for d, t in rows_of(docs, "doc_id", "text"):
            text, found = brute_private(t, "k")
            want[d, text, sum(found.values()), *[found[k] for k in pii.KINDS]] += 1
        got = Counter(rows_of(pii.pseudonymize(docs, "k"), "doc_id", "text", "n_found", *[f"n_{k}" for k in pii.KINDS]))
        assert got == want
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymize(df, "")
    with pytest.raises(ValueError, match="key"):
        pii.key_of(spark)


def test_phones_and_month_first_dates_are_permuted_among_their_own():
    phones = [f"({a:03}) {e:03}-0000" for a in (*range(195, 215), 311, 999) for e in (0, 11, 199, 200, 211, 911, 999)]
    dates = [f"{d:%m/%d/%Y}" for k in range(3000) if (d := datetime.date(2000, 1, 1) + datetime.timedelta(days=k)).day > 12]
    for kind, values in (("phone", phones), ("date", dates)):
        new = [brute_pseudonym(x, "k") for x in values]
        assert all(k == kind for k, _ in new) and len({x for _, x in new}) == len(values)
    assert all(x[3:5] > "12" for _, x in (brute_pseudonym(x, "k") for x in dates))
    for x in phones:
        same = lambda p: [int(c) in CODES[True] for c in (p[1:4], p[6:9])]
        was, now = same(x), same(brute_pseudonym(x, "k")[1])
        assert was[0] == now[0] and (not was[0] or was[1] == now[1])


@pytest.mark.parametrize(("a", "b"), [(10, 10), (100, 10), (27, 27), (1, 7)])
def test_feistel_is_a_permutation(spark, a, b):
    n = a * b
    moved = spark.range(n).select(pii.feistel(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), "k", "t").alias("x"))
    found = [r.x for r in moved.collect()]
    assert sorted(found) == list(range(n))
    assert n < 20 or found != list(range(n))


def test_private_values_of_the_table_go(spark, sf):
    docs = docs_at(spark, sf)
    out = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k").collect()}
    kinds = Counter()
    for d, t in rows_of(docs, "doc_id", "text"):
        found = re.findall(r"\S+@\S+\.com", t) + re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", t) + re.findall(r"(?<!\d)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d)", t) + re.findall(r"\b[0-9a-fA-F]{40}\b", t)
        found += [x for x in re.findall(r"(?<!\d)\d{16}(?!\d)", t) if luhn(x)]
        kinds[bool(found)] += 1
        assert not any(x in out[d] for x in found)
        if not re.search(r"[0-9@]", t):
            assert out[d] == t
    assert kinds[True] > 3


# --- 4: mixing


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs_at(spark, sf)
    out = queries.op4_mixing(spark, sf).collect()
    assert len(out) == docs.count()
    t = np.asarray([r.n_tokens for r in out], dtype=float)
    p = np.asarray([[r.p_clean, r.p_junk, r.p_toxic] for r in out])
    rate = np.asarray([r.rate for r in out])
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    sizes = {d: len(ids) - 1 for d, ids in brute_tokens(docs, "word_bpe_49k.json", 1)}
    assert all(r.n_tokens == sizes[r.doc_id] for r in out)
    totals = (t * rate) @ p
    assert np.allclose(totals, np.asarray([0.85, 0.10, 0.05]) * t.sum(), rtol=1e-3)
    assert np.allclose(totals, [out[0].reached_clean, out[0].reached_junk, out[0].reached_toxic])
    assert np.allclose([0.85 * t.sum(), 0.10 * t.sum(), 0.05 * t.sum()], [out[0].wanted_clean, out[0].wanted_junk, out[0].wanted_toxic])
    model = mixing.train(mixing.labelled(docs, labels))
    texts = dict(rows_of(docs, "doc_id", "text"))
    for r in out[:50]:  # posteriors by hand: weights of the words a text has, then softmax
        words = {x.strip(".,;:!?\"'#*$%&|<>()").lower() for x in texts[r.doc_id].split()}
        z = model.weights[-1] + ((mixing.features([texts[r.doc_id]], {})[2][0] - model.mean) / model.spread) @ model.weights[len(model.words) : -1]
        z = z + sum((model.weights[model.words[w]] for w in sorted(words) if w in model.words), np.zeros(3))
        e = np.exp(z - z.max())
        assert np.allclose(e / e.sum(), [r.p_clean, r.p_junk, r.p_toxic])


def test_targets_out_of_reach_are_told(spark):
    members = spark.createDataFrame([(i, 10, [0.9, 0.1, 0.0]) for i in range(20)], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="aren't met"):
        fit = mixing.fit_rates(members, {"clean": 0.5, "toxic": 0.5})
    assert not fit.met and fit.totals[2] == 0


def test_rates_equal_projected_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4] * 3, 300)
    t = rng.integers(1, 900, 300)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(300)], "doc_id long, n_tokens long, p array<double>")
    for shares, most in (({"clean": 0.8, "junk": 0.15, "toxic": 0.05}, 8.0), ({"clean": 1.0}, 1.5)):
        fit = mixing.fit_rates(members, shares, most=most, steps=400)
        weigh = np.linalg.inv((p * t[:, None]).T @ p)
        r = np.ones(300)
        for _ in range(20_000):
            r = np.clip(r - p @ (weigh @ ((t * r) @ p - fit.targets)), 0, most)
        loss = lambda x: (((t * x) @ p - fit.targets) @ weigh @ ((t * x) @ p - fit.targets))
        assert loss(mixing.replay(p, fit.history, most)) <= loss(r) * 1.01 + 1e-3 * t.sum() * 1e-3


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = docs_at(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    known = mixing.labelled(docs, labels, 100_000)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = mixing.train(known.where(~held))
    test = known.where(held).collect()
    _, p = model.posteriors([r.text for r in test])
    right = np.asarray([r.domain for r in test]) == p.argmax(axis=1)
    clean = np.asarray([r.domain == 0 for r in test])
    print("held out accuracy", right.mean(), "clean kept", right[clean].mean())
    assert right.mean() > 0.9


def test_mixing_of_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate([(1, 0), (0, 0), (1, 1), (None, None), (1, None), (0, 1), (1, 0), (1, 0), (0, 0)])] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(odd_docs, labels, queries.SHARES).count() == odd_docs.count()
    assert mixing.mix(no_docs, labels, queries.SHARES).count() == 0
    assert mixing.mix(odd_docs, labels.limit(0), queries.SHARES).count() == odd_docs.count()
