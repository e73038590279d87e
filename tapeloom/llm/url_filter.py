"""URL filters from dated lists: every capture is judged by the entries that were active when it was fetched.

List changes (`add` or `remove`, with a date) become validity intervals; an as-of join on the entry's key and the
fetch time finds the active ones. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import scratch

#: A change list of up to so many intervals is broadcast; a longer one is shuffled.
BROADCAST_INTERVALS = 50_000


def intervals(changes: DataFrame) -> DataFrame:
    """list, kind, value, category, valid_from, valid_to (exclusive; null: still active) from dated changes.

    Changes: list (`allow` or `block`), kind (`domain`: the host or any below it; `prefix`: host and path), value,
    category, action (`add`, `remove`), effective. Of several changes of one entry at one time `remove` wins, then the
    smallest category; rows with a null in list, kind, value, action or effective are no entries.
    """
    key = ["list", "kind", "value"]
    one = (
        changes.dropna(subset=[*key, "action", "effective"])
        .withColumn("value", F.lower("value"))
        .groupBy(*key, "effective")
        .agg(F.min(F.struct(F.when(F.col("action") == "remove", 0).otherwise(1).alias("o"), "category")).alias("x"))
    )
    w = Window.partitionBy(*key).orderBy("effective")
    return (
        one.withColumn("valid_to", F.lead("effective").over(w))
        .filter("x.o = 1")
        .select(*key, F.col("x.category").alias("category"), F.col("effective").alias("valid_from"), "valid_to")
    )


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; empty where there is none."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    authority = F.regexp_extract(rest, r"^//([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", ""))


def path_of(url: Column) -> Column:
    """Path without query and fragment; `/` where it is empty."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def evaluate(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched", id_col: str = "page_id") -> DataFrame:
    """One row per capture: id, host, decision (`allow`, `block`, `none`), and the deciding entry's value, category and start.

    Of the active entries that match, the longest value decides; of equal lengths `allow`, then the smaller list entry.
    A null or host-less URL or a null time matches nothing (decision `none`, host empty where there is none). Repeated
    captures all stay; other columns are not read. Of a URL only the suffixes and prefixes of as many parts as some
    entry has are looked up, however many parts it has itself.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp").alias("fetched"))
    active = scratch.Table(intervals(changes), "url-intervals").read()
    depth = F.when(F.col("kind") == "domain", F.size(F.split("value", r"\."))).otherwise(F.size(F.split("value", "/")))
    depths: dict[str, list[int]] = {"domain": [], "prefix": []}
    for kind, n in active.select("kind", depth.alias("n")).distinct().collect():  # as many as the list has depths
        depths.setdefault(kind, []).append(n)
    host = host_of(F.col("url"))

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    above = [key("domain", F.substring_index("host", ".", -n)) for n in sorted(depths["domain"])]
    below = [key("prefix", F.lower(F.concat("host", F.substring_index("path", "/", n)))) for n in sorted(depths["prefix"])]
    sound = F.col("url").isNotNull() & F.col("fetched").isNotNull()
    asked = rows.filter(sound).select("url", "fetched").distinct().withColumn("host", host).filter("host <> ''").withColumn("path", path_of(F.col("url")))
    wanted = F.array_distinct(F.array(*above, *below)) if above or below else F.array().cast("array<struct<kind:string,value:string>>")
    keys = asked.select("url", "fetched", F.explode(wanted).alias("k")).select("url", "fetched", "k.kind", "k.value")
    if active.count() <= BROADCAST_INTERVALS:
        active = F.broadcast(active)
    hit = keys.join(active, ["kind", "value"]).filter((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    best = hit.groupBy("url", "fetched").agg(F.min(F.struct((-F.length("value")).alias("n"), "list", "kind", "value", "category", "valid_from")).alias("best"))
    best = scratch.Table(best, "url-answers").read()  # a plain table on that side: a URL captured very often can be dealt out
    judged = rows.filter(sound).join(best, ["url", "fetched"], "left").select("id", "url", "best")
    judged = judged.union(rows.filter(~sound).select("id", "url", F.lit(None).cast(best.schema["best"].dataType).alias("best")))
    return judged.select(
        F.col("id").alias(id_col),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce("best.list", F.lit("none")).alias("decision"),
        F.col("best.value").alias("entry"),
        F.col("best.category").alias("category"),
        F.col("best.valid_from").cast("date").alias("active_since"),
    )
