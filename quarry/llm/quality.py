"""Quality rules on documents, and host-level verdicts from shrunk failure rates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, materialize, pick

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: A host goes when the shrunk share of its documents that fail a rule is above this.
HOST_LIMIT = 0.5
RULES = ("short", "repetitive", "symbols", "line_copies")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def _covered(places: Column) -> Column:
    """Words in the union of windows that begin at these ascending places."""
    gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)


def _places(keys: Column) -> Column:
    """Ascending places (from 0) of the values that occur twice or more, by sorting (value, place)."""
    pairs = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))

    def kept(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.try_element_at(s, i + 2)["k"] == x["k"], F.lit(False)) | ((i > 0) & (F.try_element_at(s, F.greatest(i, F.lit(1)))["k"] == x["k"])))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    return let(pairs, kept)


def _repeats(words: Column) -> Column:
    """Words in 8-word windows that occur twice or more. Hashes of windows find the texts that may have some;
    only there are the windows themselves compared, so the count is exact."""
    count = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(count - WINDOW + 1, F.lit(1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    strings = F.transform(starts, lambda i: F.array_join(F.slice(words, i, WINDOW), " "))
    suspect = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    exact = let(_places(strings), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(_covered(p)))
    return F.when((count > WINDOW) & suspect, exact).otherwise(F.lit(0).cast("long"))


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, text_hash, host and the counts of the base rules over whole texts.

    Null text: no words. Null host: null is one host. Other columns are left out; repeated rows give a row each.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeats(words).alias("n_repeat_words"),
        )

    found = pick(docs, doc_id=key, text=text, host=host).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "host",
        let(words_of(body), counted).alias("w"),
        (F.char_length(body) - F.char_length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("copies"), F.size(x).alias("lines"))).alias("l"),
    )
    return found.select("doc_id", "text_hash", "host", "w.n_words", "w.word_chars", "n_symbols", F.col("l.copies").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.lines").alias("n_lines"))


def _failures() -> dict[str, Column]:
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return {
        "short": words < 20,
        "repetitive": 100 * repeats > 30 * words,
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "line_copies": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_verdicts(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, host_kept and the shrunk rate of each rule.

    For each rule, hosts' failure rates have a beta prior by moments: mean m over all documents, strength
    m(1 - m)/v - 1 with v the variance of the hosts' rates, held within 1 and a million (the latter where the
    hosts don't differ). Only the eight moments, two for each rule, come to the driver.
    """
    rules = _failures()
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(r) for r, c in rules.items()])
    hosts = materialize(hosts, "hosts")
    moments = hosts.agg(*[x for r in rules for x in ((F.sum(r) / F.sum("n")).alias(f"m_{r}"), F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}"))]).first()
    rates = {}
    for r in rules:
        mean, var = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1e6
        rates[r] = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    kept = F.lit(True)
    for c in rates.values():
        kept = kept & (c <= limit)
    return hosts.select("host", kept.alias("host_kept"), *[c.alias(f"rate_{r}") for r, c in rates.items()])


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The counts of each document, base_failed, and kept: false if base_failed, else its host's verdict.

    The counts are written to the shared folder once and read for the hosts' rates and for the verdicts.
    Spark picks the join by the measured size of the hosts' table and splits a hot host where it shuffles.
    """
    stats = materialize(document_stats(docs, key, text, host), "quality")
    verdicts = host_verdicts(stats, limit).select(F.col("host").alias("_host"), "host_kept")
    rules = _failures()
    joined = stats.join(verdicts, stats["host"].eqNullSafe(verdicts["_host"]), "left")
    failed = rules["short"] | rules["repetitive"]
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce("host_kept", F.lit(True))).alias("kept"), "host", "text_hash",
    )
