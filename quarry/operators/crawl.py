"""Crawl scheduling and consent: admission, host queues, politeness, robots rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.index import summed_before
from quarry.operators.ordered import places

ROBOTS_LIMIT = 500 * 1024


def admitted(urls: DataFrame) -> DataFrame:
    """Each fingerprint once, by arrival (seq); an empty host never counts as seen. priority is held within 0 and 7."""
    known = urls.where((F.col("host") != "") & F.col("host").isNotNull())
    firsts = known.groupBy("fingerprint").agg(F.min_by(F.struct(*[c for c in urls.columns if c != "fingerprint"]), "seq").alias("x"))
    held = firsts.select("fingerprint", "x.*")
    return held.withColumn("raw_priority", F.col("priority")).withColumn("priority", F.greatest(F.least("priority", F.lit(7)), F.lit(0)))


def host_queues(urls: DataFrame) -> DataFrame:
    """place of each URL in its host's queue: arrival alone decides; host_priority is the highest unclamped one seen."""
    most = urls.groupBy("host").agg(F.max("raw_priority").alias("host_priority"))
    return places(urls, "host", ["seq"], "place").withColumn("place", F.col("place") + 1).join(most, "host")


#: The limits of connections and waits that the fetcher of pages is to have, as another engine must find them here. Times are in seconds.
FETCH_SETTINGS = {
    "dial_timeout": 10, "keep_alive": 30, "idle_connections": 10_000, "idle_per_host": 2, "connections_per_host": 4,
    "idle_timeout": 90, "handshake_timeout": 10, "continue_timeout": 1, "header_timeout": 15, "decompress": False,
}


def gap(fetch: Column, delay: Column) -> Column:
    """Seconds between two fetches from a host: ten times the last fetch, within half a second and thirty, and never less than its crawl delay."""
    return F.greatest(delay, F.least(F.greatest(10 * fetch, F.lit(0.5)), F.lit(30.0)))


def schedule(queue: DataFrame) -> DataFrame:
    """start of each fetch when every host is worked off alone: what fetches and gaps before it in its queue took."""
    return summed_before(queue, ["host"], "place", F.col("fetch") + gap(F.col("fetch"), F.col("delay")), "start").withColumn("start", F.col("start").cast("double"))


def parse_robots(body: str) -> tuple[list[dict], list[str]]:
    """Groups (agents, rules as (allow, pattern), delay) and sitemaps of a robots file."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    open_agents = False
    for line in body.encode()[:ROBOTS_LIMIT].decode(errors="ignore").splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not open_agents:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            open_agents = True
        elif field in ("allow", "disallow"):
            if groups:
                open_agents = False
                if value:
                    groups[-1]["rules"].append((field == "allow", value))
        elif field == "crawl-delay":
            if groups:
                open_agents = False
                try:
                    seconds = float(value)
                except ValueError:
                    continue
                if seconds >= 0:
                    groups[-1]["delay"] = seconds
        elif field == "sitemap" and value:
            sitemaps.append(value)
    return groups, sitemaps


def robots_rows(files: DataFrame) -> DataFrame:
    """site, grp, agent, delay, allow, pattern of (site, body): a row for each agent and rule, with nulls for none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for site, body in zip(batch["site"], batch["body"], strict=True):
                for i, g in enumerate(parse_robots(body or "")[0]):
                    for agent in g["agents"]:
                        rows += [(site, i, agent, g["delay"], *rule) for rule in g["rules"] or [(None, None)]]
            yield pd.DataFrame(rows, columns=["site", "grp", "agent", "delay", "allow", "pattern"])

    return files.mapInPandas(parse, "site string, grp int, agent string, delay double, allow boolean, pattern string")


def chosen_groups(agents: DataFrame, visits: DataFrame) -> DataFrame:
    """grp for each (site, ua): the longest agent that the user agent contains, the first of equals; * only where none is."""
    met = visits.join(agents.select("site", "grp", "agent").distinct(), "site", "left")
    fits = (F.col("agent") == "*") | (F.col("agent") != "") & F.contains(F.lower("ua"), F.col("agent"))
    length = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = F.max(F.when(fits, F.struct(length.alias("n"), (-F.col("grp")).alias("g"))))
    return met.groupBy("site", "ua").agg(best.alias("b")).select("site", "ua", (-F.col("b.g")).alias("grp"))


def glob_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is any run, a final $ the end, all else is literal and a prefix."""
    open_ = F.regexp_replace(pattern, r"\$$", "")
    literal = F.regexp_replace(open_, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(literal, r"\*", ".*"), F.when(pattern.endswith("$"), r"\z").otherwise(""))


def allowed(rules: DataFrame, visits: DataFrame) -> DataFrame:
    """allowed for each (site, ua, path): the longest fitting pattern decides, allow before disallow, and none allows."""
    groups = chosen_groups(rules, visits.select("site", "ua").distinct())
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), F.col("path")))
    met = visits.withColumn("p", path).join(groups, ["site", "ua"], "left").join(rules.select("site", "grp", "allow", "pattern").distinct(), ["site", "grp"], "left")
    fits = F.col("pattern").isNotNull() & F.rlike(F.col("p"), glob_regex(F.coalesce("pattern", F.lit(""))))
    length = F.length(F.regexp_replace("pattern", r"\$$", ""))
    best = F.max(F.when(fits, F.struct(length.alias("n"), F.col("allow").alias("a"))))
    return met.groupBy("site", "ua", "path").agg(best.alias("b")).select("site", "ua", "path", F.coalesce("b.a", F.lit(True)).alias("allowed"))


def needs_render(html: Column) -> Column:
    """Little visible text, a script, and the root of an app."""
    low = F.lower(html)
    visible = F.btrim(F.regexp_replace(html, "<[^>]*>", ""), F.lit(" \t\r\n"))
    roots = F.lit(False)
    for name in ("root", "app", "__next"):
        roots = roots | F.contains(low, F.lit(f'id="{name}"'))
    return (F.octet_length(visible) <= 512) & F.contains(low, F.lit("<script")) & roots


def confirmed(claims: DataFrame, names: DataFrame, addresses: DataFrame) -> DataFrame:
    """confirmed for each (ip, domain): a reverse name of the address lies in the domain and resolves back to it."""
    met = claims.join(names, "ip", "left").join(addresses.select("name", F.col("ip").alias("back")), "name", "left")
    name, domain = F.lower(F.regexp_replace("name", r"\.$", "")), F.lower("domain")
    inside = (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))
    return met.groupBy("ip", "domain").agg(F.coalesce(F.bool_or(inside & (F.col("back") == F.col("ip"))), F.lit(False)).alias("confirmed"))
