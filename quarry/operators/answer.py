"""Answers: routing, passage construction, citations, verification and grounding."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import STOPWORDS, content_words

#: The same words must route queries alike. What asks for several hops, then what asks a question.
HOPS = ("compare", "versus", " vs ", "difference between", "how does", "why does", "relationship between", "timeline of", "step by step", "and then")
ASKS = ("what", "who", "when", "where", "why", "how", "explain", "summarize", "list", "best", "should i")
ENTAILED, CONFIDENT = 0.5, 0.5


def route(query: Column) -> Column:
    """struct(route, confidence). What takes several hops is agentic; a question is one pass, or agentic if long; a few words are a search."""
    q = F.btrim(F.lower(query), F.lit(" \t\r\n"))
    words = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    hop, ask = F.lit(False), F.contains(q, F.lit("?"))
    for cue in HOPS:
        hop = hop | F.contains(q, F.lit(cue))
    for cue in ASKS:
        ask = ask | (F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")) == cue) | F.contains(q, F.lit(f" {cue} "))
    made = lambda name, p: F.struct(F.lit(name).alias("route"), F.lit(p).alias("confidence"))
    return (
        F.when(hop, made("agentic", 0.8)).when(ask & (F.size(words) > 12), made("agentic", 0.55)).when(ask, made("single_pass", 0.75))
        .when(F.size(words) <= 2, made("search", 0.7)).otherwise(made("single_pass", 0.5))
    )


def escalation(routes: DataFrame) -> DataFrame:
    return routes.agg(F.coalesce(F.avg((F.col("route") != "search").cast("int")), F.lit(0.0)).alias("rate"))


def consolidated(passages: DataFrame, per_source: int = 3, query: str = "query_id") -> DataFrame:
    """The best passages of each source (at least one), earlier ones first among equals; those without a source all stay."""
    place = F.row_number().over(Window.partitionBy(query, "source").orderBy(F.desc("score"), "pos"))
    return passages.withColumn("_n", place).where((F.coalesce("source", F.lit("")) == "") | (F.col("_n") <= max(per_source, 1))).drop("_n")


def edge_order(passages: DataFrame, query: str = "query_id") -> DataFrame:
    """slot from 0: the best at the two ends, the weakest in the middle; two or fewer keep their order."""
    by = Window.partitionBy(query)
    ranked = passages.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("score"), "pos")) - 1).withColumn("_p", F.row_number().over(by.orderBy("pos")) - 1)
    slot = F.when(F.col("_n") <= 2, F.col("_p")).when(F.pmod("_r", F.lit(2)) == 0, F.floor(F.col("_r") / 2)).otherwise(F.col("_n") - 1 - F.floor((F.col("_r") - 1) / 2))
    return ranked.withColumn("slot", slot.cast("long")).drop("_n", "_r", "_p")


def within_budget(passages: DataFrame, budget: int, share: float = 0.6, order: str = "slot", query: str = "query_id") -> DataFrame:
    """Passages in order until the first whose cost would go over; a share of 0 or less is 0.6."""
    most = int(budget * (share if share > 0 else 0.6))
    upto = F.sum("cost").over(Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return passages.withColumn("upto", upto).where(F.col("upto") <= most)


def freshened(score: Column, published: Column, now: int, half_life: int, weight: float, scale: float) -> Column:
    if weight <= 0 or half_life <= 0:
        return score
    age = F.greatest(F.lit(now) - published, F.lit(0))
    new = F.greatest(score * (1 - weight) + F.lit(weight * scale) * F.pow(F.lit(2.0), -age / F.lit(float(half_life))), F.lit(0.0))
    return F.when(published == 0, score).otherwise(new)


SPACE = " \t\r\n"


def claims(text: str) -> list[tuple[str, int, int]]:
    """Sentences with their byte spans: a run of . ! ? ends one where a blank or the end follows."""
    b, out, start, i = text.encode(), [], 0, 0

    def add(a: int, z: int) -> None:
        while a < z and chr(b[a]) in SPACE:
            a += 1
        while z > a and chr(b[z - 1]) in SPACE:
            z -= 1
        if a < z:
            out.append((b[a:z].decode(errors="replace"), a, z))

    while i < len(b):
        if b[i] in b".!?":
            while i < len(b) and b[i] in b".!?":
                i += 1
            if i == len(b) or chr(b[i]) in SPACE:
                add(start, i)
                start = i
        else:
            i += 1
    add(start, len(b))
    return out


def citations(raw: str) -> tuple[str, list[tuple[str, int, int, list[int]]]]:
    """(clean text, claims with byte spans and cited chunks from 0): any run of . ! ? ends a claim; [n] marks after it are its citations."""
    b, clean, out, start, i = raw.encode(), bytearray(), [], 0, 0

    def add(a: int, z: int, chunks: list[int]) -> None:
        while a < z and chr(clean[a]) in SPACE:
            a += 1
        while z > a and chr(clean[z - 1]) in SPACE:
            z -= 1
        if a < z:
            out.append((clean[a:z].decode(errors="replace"), a, z, chunks))

    while i < len(b):
        clean.append(b[i])
        i += 1
        if clean[-1] not in b".!?":
            continue
        while i < len(b) and b[i] in b".!?":
            clean.append(b[i])
            i += 1
        end, j, chunks = len(clean), i, []
        while j < len(b) and chr(b[j]) in SPACE:
            j += 1
        while j < len(b) and b[j : j + 1] == b"[":
            k = b.find(b"]", j)
            if k < 0 or not b[j + 1 : k].isdigit():
                break
            if (number := int(b[j + 1 : k])) > 0:
                chunks.append(number - 1)
            j = k + 1
        add(start, end, chunks)
        start = end
        if chunks:
            i = j
            while i < len(b) and chr(b[i]) in SPACE:
                i += 1
            if i < len(b):
                clean += b" "
            start = len(clean)
    add(start, len(clean), [])
    return clean.decode(errors="replace"), out


def overlap(claim: Column, passage: Column) -> Column:
    """struct(entailed, score): the share of a claim's content words, repeats counted, that the passage has.

    Both texts are split once; the words that the passage lacks are found by hashing.
    """

    def verdict(words: Column, lacks: Column) -> Column:
        have = F.filter(words, lambda w: ~F.array_contains(lacks, w))
        score = F.when(F.size(words) > 0, F.size(have) / F.size(words)).otherwise(F.lit(0.0))
        return F.struct(((score >= ENTAILED) & (F.size(words) > 0)).alias("entailed"), score.alias("score"))

    split = F.array(F.struct(content_words(claim).alias("c"), content_words(passage).alias("p")))
    found = F.transform(split, lambda x: F.struct(x["c"].alias("c"), F.array_except(x["c"], x["p"]).alias("lacks")))
    return F.transform(found, lambda x: verdict(x["c"], x["lacks"]))[0]


def _content(text: str) -> list[str]:
    """What content_words gives."""
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOPWORDS]


def all_overlaps(text: str, passages: Iterable[str]) -> list[tuple[int, int, bool, float]]:
    """claim_id, the passage's place, entailed, score: overlap() of every claim of a text with every passage, each split once."""
    said = [_content(c) for c, _, _ in claims(text)]
    out = []
    for k, passage in enumerate(passages):
        has = set(_content(passage))
        for i, words in enumerate(said):
            score = sum(w in has for w in words) / len(words) if words else 0.0
            out.append((i, k, bool(words) and score >= ENTAILED, score))
    return out


def best_verdicts(claims_: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, claim_id, entailed, score: the best over the passages cited (chunks); uncited claims and chunks out of range have none."""
    cited = claims_.select("query_id", "claim_id", "claim", F.explode_outer("chunks").alias("chunk"))
    met = cited.join(passages.select("query_id", F.col("pos").alias("chunk"), "text"), ["query_id", "chunk"], "left")
    verdict = F.when(F.col("text").isNotNull(), overlap(F.col("claim"), F.coalesce("text", F.lit(""))))
    best = met.groupBy("query_id", "claim_id").agg(F.max(verdict).alias("v"))
    return best.select("query_id", "claim_id", F.coalesce("v.entailed", F.lit(False)).alias("entailed"), F.coalesce("v.score", F.lit(0.0)).alias("score"))


def corrected(verdicts: DataFrame, queries: DataFrame) -> DataFrame:
    """kept, dropped and verified for each query: verified where nothing is dropped, also where there is no claim."""
    keep = F.col("entailed") & (F.col("score") >= CONFIDENT)
    got = verdicts.groupBy("query_id").agg(F.sum(keep.cast("long")).alias("kept"), F.sum((~keep).cast("long")).alias("dropped"))
    return queries.select("query_id").distinct().join(got, "query_id", "left").select("query_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"), (F.coalesce("dropped", F.lit(0)) == 0).alias("verified"))


def marker(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), (c + 1).cast("string"), F.lit("]"))), "")


def inserted(answers: DataFrame, supports: DataFrame) -> DataFrame:
    """query_id, marked: markers put in at the byte ends of (query_id, i, end, chunks); of equal ends the later support's comes first."""
    got = supports.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("end", (-F.col("i")).alias("i"), marker(F.col("chunks")).alias("m")))).alias("s"))
    raw = F.encode("answer", "utf-8")
    start = F.struct(F.lit(b"").cast("binary").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substr(raw, a["at"] + 1, s["end"] - a["at"]), F.encode(s["m"], "utf-8")).alias("out"), s["end"].alias("at"))
    done = F.aggregate("s", start, step, lambda a: F.concat(a["out"], F.substr(raw, a["at"] + 1, F.octet_length("answer") - a["at"])))
    return answers.join(got, "query_id", "left").select("query_id", F.when(F.col("s").isNull(), F.col("answer")).otherwise(F.decode(done, "utf-8")).alias("marked"))


def validated(answers: DataFrame, supports: DataFrame) -> DataFrame:
    """problem of each answer: of its first support that has one: range, text, no chunk, or a chunk that isn't there; null for none."""
    met = answers.join(supports, "query_id")
    held = F.substr(F.encode("answer", "utf-8"), F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)))
    bad = F.when((F.col("start") < 0) | (F.col("end") > F.octet_length("answer")) | (F.col("start") > F.col("end")), "range").when(held != F.encode("span", "utf-8"), "text")
    bad = bad.when(F.size("chunks") == 0, "no chunk").when(F.exists("chunks", lambda c: (c < 0) | (c >= F.col("n_chunks"))), "bad chunk")
    first = met.withColumn("bad", bad).where("bad IS NOT NULL").groupBy("query_id").agg(F.min_by("bad", "i").alias("problem"))
    return answers.select("query_id").join(first, "query_id", "left")
