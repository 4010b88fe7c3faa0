"""Cross-site boilerplate: lines that many distinct sites share, found by HyperLogLog sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pick

#: Distinct sites that make a line boilerplate; lines shorter than this many characters are never taken for it.
MIN_SITES, MIN_CHARS = 5, 15
#: Sketches have 2 ** LG_K registers, an error of 1.04 / 64; within MARGIN of the threshold the count is made exact.
LG_K, MARGIN = 12, 0.2


def _keys(line):
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line long enough: its document, place, 128-bit key and site. Lines are compared without outer blanks."""
    each = docs.select("doc_id", "th", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    each = each.withColumn("line", F.trim("line")).where(F.char_length("line") >= min_chars)
    return each.select("doc_id", "th", "site", "place", *_keys(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 and first (the occurrence that stays: least document, then place) of lines on min_sites sites or more.

    Sketches merge map-side, so a line on every page sends one sketch a task. Where the estimate is within MARGIN
    of the threshold, the line's distinct sites are counted exactly.
    """
    sketches = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "th", "place")).alias("first")
    )
    spread = sketches.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    found = materialize(spread.where(F.col("sites") >= min_sites * (1 - MARGIN)), "lines-spread")
    clear = F.col("sites") >= min_sites * (1 + MARGIN)
    near = found.where(~clear).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    exact = exact.where(F.col("exact") >= min_sites).select("h1", "h2")
    kept = found.where(clear).select("h1", "h2", "first").unionByName(found.where(~clear).join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))
    return materialize(kept, "lines-boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text", site: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines, n_removed, and the columns named in carry.

    A line is boilerplate if it stands on min_sites distinct sites or more, a null site counting as one. Its first
    occurrence stays, so nothing is lost from the corpus; the others go. Rows that repeat a document keep the
    same lines. Null text stays null with no lines; an emptied text is "". Other columns are left out.
    """
    base = pick(docs, doc_id=key, text=text, site=site, **{f"_c{i}": c for i, c in enumerate(carry)})
    base = base.withColumns({"doc_id": F.col("doc_id").cast("long"), "th": F.xxhash64("text"), "site": F.coalesce(F.col("site").cast("string"), F.lit("\x00null"))})
    lines = _lines(base, min_chars)
    shared = boilerplate(lines, min_sites)
    here = F.struct("doc_id", "th", "place")
    hits = lines.join(shared, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first")))
    hits = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set("place").alias("_gone"))
    split = F.split("text", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    rebuilt = F.array_join(F.transform(F.array(split), lambda x: F.transform(F.array_sort(stays), lambda p: x[p]))[0], "\n")
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["_doc"]) & (base["th"] == hits["_th"]), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )
