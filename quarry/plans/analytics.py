"""Queries over vectors, the link graph, and relevance and answer judgments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import hashing
from quarry.functions.numbers import sql_round
from quarry.functions.text import ascii_terms
from quarry.operators import evaluation, graph, vectors
from quarry.operators.ordered import shared_table
from quarry.plans.registry import Tables, query

# --- vectors: every row against the row of the next id

NEXT = "pairs AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[], 1, embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS b FROM embeddings)"


def pairs(t: Tables) -> DataFrame:
    """Each vector with that of the next id, by a join on the id (ids are dense), the last with itself."""
    v = t.embeddings.select("vec_id", vectors.doubles(F.col("embedding")).alias("a"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(after, "vec_id", "left").select("vec_id", "a", F.coalesce("b", "a").alias("b"))


L2 = "list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query("vec_l2", f"WITH {NEXT} SELECT vec_id, round({L2}, 6) AS d FROM pairs")
def vec_l2(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", sql_round(vectors.l2(F.col("a"), F.col("b")), 6).alias("d"))


@query("vec_inner_product", f"WITH {NEXT} SELECT vec_id, round(list_dot_product(a, b), 6) AS d FROM pairs")
def vec_inner_product(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", sql_round(vectors.dot(F.col("a"), F.col("b")), 6).alias("d"))


@query("vec_cosine", f"WITH {NEXT} SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS d FROM pairs")
def vec_cosine(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", sql_round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("d"))


@query("vec_distance", f"WITH {NEXT} SELECT vec_id, round({L2}, 6) AS l2, round(-list_dot_product(a, b), 6) AS inner_product, round(-list_cosine_similarity(a, b), 6) AS cosine FROM pairs")
def vec_distance(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs(t).select("vec_id", *[sql_round(vectors.distance(m, a, b), 6).alias(n) for m, n in (("l2", "l2"), ("inner", "inner_product"), ("cosine", "cosine"))])


@query("embed_cosine", f"WITH {NEXT} SELECT vec_id, round(list_dot_product(a, b), 6) AS cosine FROM pairs")
def embed_cosine(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", sql_round(vectors.embed_cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("vec_normalize", "SELECT vec_id, i - 1 AS dim, round((embedding::DOUBLE[])[i] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings, range(1, 65) r(i)")
def vec_normalize(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(vectors.normalize(F.col("embedding"))).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), sql_round("x", 6).alias("x"))


def asked(t: Tables) -> DataFrame:
    """The stated query set: every id divisible by 20."""
    return t.embeddings.where("vec_id % 20 = 0")


@query("knn_exact", """SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10""")
def knn_exact(t: Tables) -> DataFrame:
    return vectors.nearest(t.embeddings, asked(t), 10).select("query_id", "vec_id", sql_round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_graph(t: Tables) -> DataFrame:
    return shared_table(vectors.graph_index(t.embeddings), "graph")


@query("ann_search_recall")
def ann_search_recall(t: Tables) -> DataFrame:
    """Recall at 10 of the graph search against the exact one, for each query."""
    exact, found = vectors.nearest(t.embeddings, asked(t), 10), vectors.graph_search(vector_graph(t), asked(t), 10)
    both = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query("ann_build_stats")
def ann_build_stats(t: Tables) -> DataFrame:
    """Rows, links and the least and most links of a row, for each segment's graph."""
    links = F.size("near")
    return vector_graph(t).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(links).alias("links"), F.min(links).alias("least"), F.max(links).alias("most"))


RANGES = "ranges AS (SELECT i - 1 AS dim, min((embedding::DOUBLE[])[i]) AS low, (max((embedding::DOUBLE[])[i]) - min((embedding::DOUBLE[])[i])) / 254 AS scale FROM embeddings, range(1, 65) r(i) GROUP BY i)"
CODES = "codes AS (SELECT vec_id, dim, low, scale, (embedding::DOUBLE[])[dim + 1] AS x, CASE WHEN scale = 0 THEN 0 ELSE greatest(-127, least(127, round(((embedding::DOUBLE[])[dim + 1] - low) / scale) - 127)) END AS code FROM embeddings, ranges)"


@query("sq_train", f"WITH {RANGES} SELECT dim, round(low, 8) AS low, round(scale, 10) AS scale FROM ranges")
def sq_train(t: Tables) -> DataFrame:
    return vectors.scalar_ranges(t.embeddings).select(F.col("dim").cast("long").alias("dim"), sql_round("low", 8).alias("low"), sql_round("scale", 10).alias("scale"))


def coded(t: Tables) -> tuple[DataFrame, list[float], list[float]]:
    low, scale = vectors.dimension_arrays(vectors.scalar_ranges(t.embeddings))
    return t.embeddings.withColumn("codes", vectors.scalar_codes(F.col("embedding"), low, scale)), low, scale


@query("sq_encode", f"WITH {RANGES}, {CODES} SELECT vec_id, dim, code::INT AS code FROM codes")
def sq_encode(t: Tables) -> DataFrame:
    return coded(t)[0].select("vec_id", F.posexplode("codes").alias("dim", "code")).withColumn("dim", F.col("dim").cast("long"))


@query("sq_distance", f"WITH {RANGES}, {CODES} SELECT vec_id, round(sum((x - (low + (code + 127) * scale)) * (x - (low + (code + 127) * scale))), 8) AS distortion FROM codes GROUP BY vec_id")
def sq_distance(t: Tables) -> DataFrame:
    rows, low, scale = coded(t)
    return rows.select("vec_id", sql_round(vectors.l2(F.col("embedding"), vectors.scalar_decoded(F.col("codes"), low, scale)), 8).alias("distortion"))


MEANS = "means AS (SELECT i, avg((embedding::DOUBLE[])[i]) AS m FROM embeddings, range(1, 65) r(i) GROUP BY i), bits AS (SELECT vec_id, label, embedding, string_agg(CASE WHEN (embedding::DOUBLE[])[i] > m THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS bits FROM embeddings, means GROUP BY ALL)"


def bits(t: Tables) -> DataFrame:
    return t.embeddings.withColumn("bits", vectors.binary_bits(F.col("embedding"), vectors.dimension_means(t.embeddings)))


@query("bq_encode", f"WITH {MEANS} SELECT vec_id, bits FROM bits")
def bq_encode(t: Tables) -> DataFrame:
    return bits(t).select("vec_id", "bits")


@query("bq_hamming_rescore", f"""WITH {MEANS}, near AS (SELECT q.vec_id AS query_id, v.vec_id, q.embedding::DOUBLE[] AS a, v.embedding::DOUBLE[] AS b FROM bits q, bits v WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.bits::BIT, v.bits::BIT)), v.vec_id) <= 60)
SELECT query_id, vec_id, round({L2}, 6) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {L2}, vec_id) <= 10""")
def bq_hamming_rescore(t: Tables) -> DataFrame:
    """The 60 nearest codes of each query, then the 10 nearest of those by distance."""
    v = bits(t).select("vec_id", "embedding", vectors.binary_code(F.col("bits")).alias("code"))
    near = vectors.nearest_codes(v, v.where("vec_id % 20 = 0"), 60)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = near.join(v.select("vec_id", "embedding"), "vec_id").join(q.select("query_id", "q"), "query_id").select("query_id", "vec_id", vectors.l2(F.col("q"), F.col("embedding")).alias("distance"))
    best = exact.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("n <= 10")
    return best.select("query_id", "vec_id", sql_round("distance", 6).alias("distance"))


@query("pq_train_distortion")
def pq_train_distortion(t: Tables) -> DataFrame:
    book = vectors.product_codebook(t.embeddings, 8)
    return vectors.product_encoded(t.embeddings, book).agg(F.count(F.lit(1)).alias("n"), F.avg("distortion").alias("distortion"))


#: A fixed codebook for the oracle: centroid c of part p is the p-th part of vector c.
FIXED = "book AS (SELECT vec_id AS c, p, (embedding::DOUBLE[])[p * 8 + 1:p * 8 + 8] AS centroid FROM embeddings, range(8) r(p) WHERE vec_id < 16), parts AS (SELECT vec_id, p, (embedding::DOUBLE[])[p * 8 + 1:p * 8 + 8] AS part FROM embeddings, range(8) r(p)), scored AS (SELECT vec_id, p, c, part, centroid, list_sum(list_transform(list_zip(part, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN book USING (p)), codes AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, c) = 1)"


def fixed_book(t: Tables):
    return vectors.product_codebook(t.embeddings, 8, rounds=0)


@query("pq_encode", f"WITH {FIXED} SELECT vec_id, string_agg(c::VARCHAR, ',' ORDER BY p) AS codes, round(sum(d), 6) AS distortion FROM codes GROUP BY vec_id")
def pq_encode(t: Tables) -> DataFrame:
    rows = vectors.product_encoded(t.embeddings, fixed_book(t))
    return rows.select("vec_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), sql_round("distortion", 6).alias("distortion"))


@query("pq_adc_topk", f"""WITH {FIXED}, q AS (SELECT vec_id AS query_id, p, part FROM parts WHERE vec_id % 20 = 0), adc AS (SELECT q.query_id, k.vec_id, round(sum(list_sum(list_transform(list_zip(q.part, k.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM q JOIN codes k USING (p) GROUP BY ALL)
SELECT query_id, vec_id, distance FROM adc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""")
def pq_adc_topk(t: Tables) -> DataFrame:
    book = fixed_book(t)
    codes = vectors.product_encoded(t.embeddings, book)
    top = vectors.asymmetric_top(codes, asked(t), book, 40).select("query_id", "vec_id", sql_round("distance", 6).alias("distance"))
    return top.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("n <= 10").drop("n")


TOKENS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"


@query("tokenize_ascii", f"SELECT doc_id, len({TOKENS})::BIGINT AS n, md5(array_to_string({TOKENS}, ' ')) AS tokens FROM documents")
def tokenize_ascii(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(ascii_terms(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(ascii_terms(F.col("text")), " ")).alias("tokens"))


DIM = 64


@query("hash_embed", f"""WITH toks AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), h AS (SELECT term, {hashing.fnv_sql('term')} AS h FROM (SELECT DISTINCT term FROM toks)),
parts AS (SELECT doc_id, (h % 64)::BIGINT AS dim, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN 1 ELSE -1 END)::DOUBLE AS x FROM toks JOIN h USING (term) GROUP BY ALL)
SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM parts WHERE x <> 0""")
def hash_embed(t: Tables) -> DataFrame:
    """Non-zero components; each distinct term is hashed once."""
    toks = t.documents.select("doc_id", F.explode(ascii_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    hashed = toks.select("term").distinct().select("term", hashing.fnv1a(F.col("term")).alias("h"))
    signed = F.when(F.col("h") < 0, F.col("n")).otherwise(-F.col("n"))
    parts = toks.join(hashed, "term").groupBy("doc_id", F.col("h").bitwiseAND(F.lit(DIM - 1)).alias("dim")).agg(F.sum(signed).cast("double").alias("x")).where("x <> 0")
    norm = parts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return parts.join(norm, "doc_id").select("doc_id", "dim", sql_round(F.col("x") / F.col("norm"), 6).alias("x"))


# --- the link graph: nations by trade (dense), and suppliers to parts (dangling)

NATIONS = "edges AS (SELECT c.c_nationkey::BIGINT AS src, s.s_nationkey::BIGINT AS dst FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey), vertices AS (SELECT n_nationkey::BIGINT AS v FROM nation)"


def trade(t: Tables) -> tuple[DataFrame, DataFrame]:
    li, o, c, s = (t.lineitem.select("l_orderkey", "l_suppkey"), t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_nationkey"), t.supplier.select("s_suppkey", "s_nationkey"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")), t.nation.select(F.col("n_nationkey").cast("long").alias("v"))


def supply(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers are 2 s, parts 2 p + 1, so that parts have no out-edges."""
    edges = t.lineitem.select((F.col("l_suppkey") * 2).cast("long").alias("src"), (F.col("l_partkey") * 2 + 1).cast("long").alias("dst"))
    return edges, edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


SUPPLY = "edges AS (SELECT (l_suppkey * 2)::BIGINT AS src, (l_partkey * 2 + 1)::BIGINT AS dst FROM lineitem), vertices AS (SELECT src AS v FROM edges UNION SELECT dst FROM edges)"


@query("graph_build", "WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), names AS (SELECT src AS name FROM e UNION SELECT dst FROM e) SELECT name, row_number() OVER (ORDER BY name) - 1 AS v FROM names")
def graph_build(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return graph.dense_vertices(edges)


@query("graph_outdegree", f"WITH {SUPPLY} SELECT v, count(src) AS degree FROM vertices LEFT JOIN edges ON v = src GROUP BY v")
def graph_outdegree(t: Tables) -> DataFrame:
    return graph.out_degrees(*supply(t))


@query("graph_reverse", f"WITH {SUPPLY} SELECT dst AS src, src AS dst, count(*) AS times FROM edges GROUP BY ALL")
def graph_reverse(t: Tables) -> DataFrame:
    return graph.reverse(supply(t)[0]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))


def ranked_sql(graph_sql: str, seed: str, rounds: int = 20, last: str = "") -> str:
    steps = "".join(
        f", r{i} AS MATERIALIZED (SELECT b.v, 0.15 * b.t + 0.85 * (coalesce(f.inflow, 0) + (SELECT coalesce(sum(r.rank), 0) FROM r{i - 1} r JOIN base z USING (v) WHERE z.degree = 0) * b.t) AS rank FROM base b LEFT JOIN (SELECT dst AS v, sum(rank * share) AS inflow FROM links JOIN r{i - 1} ON src = v GROUP BY dst) f USING (v))"
        for i in range(1, rounds + 1)
    )
    return f"""WITH {graph_sql}, degrees AS (SELECT v, count(src) AS degree FROM vertices LEFT JOIN edges ON v = src GROUP BY v),
links AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / any_value(degree) AS share FROM edges JOIN degrees ON src = v GROUP BY src, dst),
base AS MATERIALIZED (SELECT v, degree, {seed} AS t FROM degrees), r0 AS (SELECT v, t AS rank FROM base){steps} {last or f"SELECT v, round(rank, 9) AS rank FROM r{rounds}"}"""


SEEDS = "(1), (3), (3), (7)"
SEED_SQL = "(CASE v WHEN 1 THEN 0.25::DOUBLE WHEN 3 THEN 0.5::DOUBLE WHEN 7 THEN 0.25::DOUBLE ELSE 0::DOUBLE END)"


def seeds(t: Tables) -> DataFrame:
    return t.rows("v", SEEDS).withColumn("v", F.col("v").cast("long"))


def rounded(found: tuple[DataFrame, int, bool]) -> DataFrame:
    return found[0].select("v", sql_round("rank", 9).alias("rank"))


@query("pagerank_fixed20", ranked_sql(SUPPLY, "1.0::DOUBLE / (SELECT count(*) FROM vertices)"))
def pagerank_fixed20(t: Tables) -> DataFrame:
    return rounded(graph.power_iteration(*supply(t), rounds=20, fixed=True))


#: More rounds than the graph needs; the first whose ranks moved by less than the tolerance is the answer.
ROUNDS = 40
SETTLED = ", moved AS (" + " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.rank - b.rank)) AS d FROM r{i} a JOIN r{i - 1} b USING (v)" for i in range(1, ROUNDS + 1)) + "), stop AS (SELECT min(i) AS n FROM moved WHERE d < 1e-6), every AS (" + " UNION ALL ".join(f"SELECT {i} AS i, v, rank FROM r{i}" for i in range(1, ROUNDS + 1)) + ") SELECT v, round(rank, 9) AS rank, n AS rounds, true AS converged FROM every, stop WHERE i = n"


@query("pagerank_converged", ranked_sql(NATIONS, "1.0::DOUBLE / (SELECT count(*) FROM vertices)", ROUNDS, SETTLED))
def pagerank_converged(t: Tables) -> DataFrame:
    ranks, rounds, converged = graph.power_iteration(*trade(t))
    return ranks.select("v", sql_round("rank", 9).alias("rank"), F.lit(rounds).alias("rounds"), F.lit(converged).alias("converged"))


@query("trustrank_fixed20", ranked_sql(NATIONS, SEED_SQL))
def trustrank_fixed20(t: Tables) -> DataFrame:
    edges, vertices = trade(t)
    return rounded(graph.power_iteration(edges, vertices, seeds(t), rounds=20, fixed=True))


@query("antitrustrank_fixed20", ranked_sql(NATIONS.replace("AS src", "AS x").replace("AS dst", "AS src").replace("AS x", "AS dst"), SEED_SQL))
def antitrustrank_fixed20(t: Tables) -> DataFrame:
    edges, vertices = trade(t)
    return rounded(graph.power_iteration(graph.reverse(edges), vertices, seeds(t), rounds=20, fixed=True))


# --- evaluation: sources are queries, documents by length are their ranking, labels are grades

QRELS = "qrels AS (SELECT d.source AS query_id, d.doc_id, (l.quality * 2 + l.toxic)::INT AS grade FROM documents d JOIN labels l USING (doc_id)), ranked AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"
METRICS = f"""WITH {QRELS}, rows AS (SELECT r.*, coalesce(q.grade, 0) AS grade, (coalesce(q.grade, 0) > 0)::INT AS hit FROM ranked r LEFT JOIN qrels q USING (query_id, doc_id)),
run AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM rows),
got AS (SELECT query_id, sum(CASE WHEN rank <= 10 AND grade > 0 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (WHERE rank <= 10 AND hit = 1) AS first, coalesce(sum(hit) FILTER (WHERE rank <= 10), 0) AS found,
  sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS precisions, sum(CASE WHEN hit = 1 AND rank <= 10 THEN hits / rank ELSE 0 END) AS precisions_k FROM run GROUP BY query_id),
best AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM qrels),
ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 AND grade > 0 THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS ideal, count(*) FILTER (WHERE grade > 0) AS relevant FROM best GROUP BY query_id),
metrics AS (SELECT query_id, coalesce(dcg, 0) AS dcg, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg, coalesce(1.0 / first, 0)::DOUBLE AS mrr, CASE WHEN relevant > 0 THEN coalesce(found, 0) / relevant ELSE 0 END AS recall,
  CASE WHEN relevant > 0 THEN coalesce(precisions, 0) / relevant ELSE 0 END AS ap, CASE WHEN found > 0 THEN precisions_k / found ELSE 0 END AS context_precision FROM got FULL JOIN ideal USING (query_id))"""


def metrics(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("source").alias("query_id"), "doc_id", "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"))).drop("n_chars")
    qrels = docs.join(t.labels, "doc_id").select("query_id", "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("grade"))
    return evaluation.relevance(ranked, qrels, 10)


def _metric(name: str, column: str) -> None:
    @query(name, f"{METRICS} SELECT query_id, round({column}, 6) AS {column} FROM metrics")
    def metric(t: Tables) -> DataFrame:
        return metrics(t).select("query_id", sql_round(column, 6).alias(column))


for _name, _column in (("eval_dcg", "dcg"), ("eval_ndcg", "ndcg"), ("eval_mrr", "mrr"), ("eval_recall", "recall"), ("eval_context_precision", "context_precision")):
    _metric(_name, _column)


@query("eval_map", f"{METRICS} SELECT round(avg(ap), 6) AS map FROM metrics")
def eval_map(t: Tables) -> DataFrame:
    return metrics(t).agg(sql_round(F.coalesce(F.avg("ap"), F.lit(0.0)), 6).alias("map"))


REPORT = "round(coalesce(avg(ndcg), 0), 6) AS ndcg, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(recall), 0), 6) AS recall"


def report(t: Tables) -> DataFrame:
    return metrics(t).agg(*[sql_round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("ndcg", "mrr", "recall")])


@query("harness_relevance", f"{METRICS} SELECT {REPORT} FROM metrics")
def harness_relevance(t: Tables) -> DataFrame:
    return report(t)


@query("gate_relevance", f"{METRICS}, report AS (SELECT {REPORT} FROM metrics), e AS (SELECT unnest([{{'metric': 'ndcg', 'baseline': 0.99::DOUBLE, 'got': ndcg}}, {{'metric': 'mrr', 'baseline': 0.1::DOUBLE, 'got': mrr}}, {{'metric': 'recall', 'baseline': 0.99::DOUBLE, 'got': recall}}], recursive := true) FROM report) SELECT metric, baseline, got, format('{{}} fell from {{:.4f}} to {{:.4f}}', metric, baseline, got) AS message FROM e WHERE got < baseline - 0.01")
def gate_relevance(t: Tables) -> DataFrame:
    return evaluation.gate(report(t), {"ndcg": 0.99, "mrr": 0.1, "recall": 0.99}, 0.01)


#: Conversations are answers: an assistant's turn is a claim, entailed if it has a line feed, cited if it is long.
ANSWERS = "SELECT conv_id AS query_id, coalesce(avg((role = 'assistant' AND contains(text, chr(10)))::INT), 1)::DOUBLE AS faithfulness, coalesce(avg((length(text) > 200)::INT), 1)::DOUBLE AS citation_recall, coalesce(avg((length(text) > 200 AND turn > 0)::INT), 1)::DOUBLE AS citation_precision, coalesce(avg((turn < 3)::INT), 1)::DOUBLE AS context_recall FROM conversations GROUP BY conv_id"


def answers(t: Tables) -> DataFrame:
    long = F.length("text") > 200
    flags = {"faithfulness": (F.col("role") == "assistant") & F.contains("text", F.lit("\n")), "citation_recall": long, "citation_precision": long & (F.col("turn") > 0), "context_recall": F.col("turn") < 3}
    return t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(*evaluation.fractions(flags))


SHARES = ("faithfulness", "citation_recall", "citation_precision", "context_recall")


@query("eval_answer_fractions", f"SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in SHARES)} FROM ({ANSWERS})")
def eval_answer_fractions(t: Tables) -> DataFrame:
    return answers(t).select("query_id", *[sql_round(c, 6).alias(c) for c in SHARES])


@query("eval_f1", f"SELECT query_id, round(CASE WHEN citation_recall + citation_precision > 0 THEN 2 * citation_recall * citation_precision / (citation_recall + citation_precision) ELSE 0 END, 6) AS f1 FROM ({ANSWERS})")
def eval_f1(t: Tables) -> DataFrame:
    return answers(t).select("query_id", sql_round(evaluation.f1(F.col("citation_recall"), F.col("citation_precision")), 6).alias("f1"))


MEANS_SQL = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in SHARES)


def answer_report(t: Tables) -> DataFrame:
    return answers(t).agg(*[sql_round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in SHARES])


@query("harness_answer", f"WITH m AS (SELECT {MEANS_SQL} FROM ({ANSWERS})) SELECT *, round(CASE WHEN citation_recall + citation_precision > 0 THEN 2 * citation_recall * citation_precision / (citation_recall + citation_precision) ELSE 0 END, 6) AS f1 FROM m")
def harness_answer(t: Tables) -> DataFrame:
    return answer_report(t).withColumn("f1", sql_round(evaluation.f1(F.col("citation_recall"), F.col("citation_precision")), 6))


@query("gate_answer", f"WITH m AS (SELECT {MEANS_SQL} FROM ({ANSWERS})), e AS (SELECT unnest([{', '.join(chr(123) + f'{chr(39)}metric{chr(39)}: {chr(39)}{c}{chr(39)}, {chr(39)}baseline{chr(39)}: 0.9::DOUBLE, {chr(39)}got{chr(39)}: {c}' + chr(125) for c in SHARES)}], recursive := true) FROM m) SELECT metric, baseline, got, format('{{}} fell from {{:.4f}} to {{:.4f}}', metric, baseline, got) AS message FROM e WHERE got < baseline - 0.02")
def gate_answer(t: Tables) -> DataFrame:
    return evaluation.gate(answer_report(t), dict.fromkeys(SHARES, 0.9), 0.02)


@query("latency_percentile", " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, value AS x FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) WHERE r = 1 + floor({q} * (n - 1) + 0.5)" for q in (0.0, 0.5, 0.95, 0.99, 1.0)))
def latency_percentile(t: Tables) -> DataFrame:
    found = [evaluation.nearest_rank(t.events, q, "value").select(F.lit(q).alias("q"), F.col("value").alias("x")) for q in (0.0, 0.5, 0.95, 0.99, 1.0)]
    return reduce(DataFrame.unionByName, found)
