"""Catalog entries: (info_hash, name, size, categories, created_at, build_date, complete, ...) rows, with status, feeds and recipes beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(*, prefix: str = "") -> list[Column]:
    """A total order, newest first: by build date or else creation, then creation, then key."""
    c = lambda n: F.col(f"{prefix}{n}")
    return [F.coalesce(c("build_date"), c("created_at")).desc_nulls_last(), c("created_at").desc_nulls_last(), c("info_hash").asc()]


def newest_key(prefix: str = "") -> Column:
    """The same order as a struct whose maximum is the newest entry; lets max_by find it with partial aggregation."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.struct(F.coalesce(c("build_date"), c("created_at")).alias("a"), c("created_at").alias("b"), (-c("info_hash").cast("long")).alias("c"))


def per_category(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("category", F.explode("categories"))


def category_list(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("categories").alias("category")).distinct()


def category_summary(catalog: DataFrame) -> DataFrame:
    """Entries, newest entry and whether any complete entry can be served, for each category."""
    return per_category(catalog).groupBy("category").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.max_by("info_hash", newest_key()).alias("newest"), F.bool_or("complete").alias("servable"))


def newest_per_category(catalog: DataFrame) -> DataFrame:
    return per_category(catalog).groupBy("category").agg(F.max_by(F.struct("info_hash", "name", "created_at"), newest_key()).alias("e")).select("category", "e.*")


def retention_plan(catalog: DataFrame, family: str, keep: int | None, keep_days: int | None, now: Column) -> DataFrame:
    """Entries to expire: ranked beyond `keep`, or older than keep_days. Age never takes the newest, nor undated entries."""
    ranked = catalog.withColumn("rank", F.row_number().over(Window.partitionBy(family).orderBy(*newest())))
    by_count = F.col("rank") > keep if keep is not None else F.lit(False)
    dated = F.coalesce("build_date", "created_at")
    by_age = F.coalesce((F.col("rank") > 1) & (dated < now - F.make_interval(days=F.lit(keep_days))), F.lit(False)) if keep_days is not None else F.lit(False)
    return ranked.filter(by_count | by_age).withColumn("reason", F.when(by_count, "count").otherwise("age"))


def retirement_plan(catalog: DataFrame, family: str, trigger: str, keep: int, need_complete: bool) -> DataFrame:
    """Entries that an arrival retires: only where the arrival (rows flagged by `trigger`) is its family's newest, and complete if that is asked for."""
    w = Window.partitionBy(family).orderBy(*newest())
    ranked = catalog.withColumns({"rank": F.row_number().over(w), "_first": F.first_value(F.col(trigger)).over(w), "_done": F.first_value("complete").over(w)})
    return ranked.filter(F.col("_first") & (F.col("_done") if need_complete else F.lit(True)) & (F.col("rank") > keep)).drop("_first", "_done")


def with_status(catalog: DataFrame, status: DataFrame) -> DataFrame:
    return catalog.join(status, "info_hash", "left")


def merged_status(status: DataFrame, primary: str) -> DataFrame:
    """The primary engine's rows, with peers and speeds summed over all engines that hold the archive. One aggregate, no join."""
    figures = ("peers", "seeds", "down", "up")
    return (
        status.groupBy("info_hash")
        .agg(F.max_by("state", F.when(F.col("engine") == primary, 1)).alias("state"), F.bool_or(F.col("engine") == primary).alias("_own"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in figures), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
        .filter("_own")
        .drop("_own")
    )


def resolved_sources(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recipe sources (stack_id, idx, category, archive, required) with the archive that each stands for: pinned, or its category's newest. The bottom source is required unless it says otherwise."""
    current = newest_per_category(catalog).select("category", F.col("info_hash").alias("_current"))
    held = catalog.select(F.col("info_hash").alias("archive"), F.lit(True).alias("_held"))
    out = sources.join(current, "category", "left").join(held, "archive", "left")
    return out.select("stack_id", "idx", "category", F.when(F.col("archive").isNotNull(), F.when(F.col("_held"), F.col("archive"))).otherwise(F.col("_current")).alias("info_hash"), F.col("archive").isNotNull().alias("pinned"), F.coalesce("required", F.col("idx") == 0).alias("required"))


def removal_impact(removed: DataFrame, sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stacks that lose by removing archives: by a pin, as a category's last or newest entry, or as one of several in a category."""
    cats = category_summary(catalog).select("category", "entries", "newest")
    gone = removed.select("info_hash", "categories")
    pinned = sources.filter("archive is not null").join(gone.select(F.col("info_hash").alias("archive")), "archive", "left_semi").select("stack_id", "idx", F.col("archive").alias("info_hash"), F.lit("pinned").alias("impact"))
    by = gone.withColumn("category", F.explode("categories")).join(cats, "category").join(sources.filter("archive is null").select("stack_id", "idx", "category"), "category")
    kind = F.when(F.col("entries") == 1, "last").when(F.col("newest") == F.col("info_hash"), "newest").otherwise("category")
    return pinned.unionByName(by.select("stack_id", "idx", "info_hash", kind.alias("impact")))


def stack_coverage(sources: DataFrame) -> DataFrame:
    """Zooms, box, format and attributions of each stack's archives: the format only where all agree, attributions once each in order of source."""
    return sources.groupBy("stack_id").agg(
        F.min("min_zoom").alias("min_zoom"), F.max("max_zoom").alias("max_zoom"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
        F.when(F.min("format") == F.max("format"), F.min("format")).alias("format"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("attribution").isNotNull(), F.struct("idx", "attribution")))), lambda s: s["attribution"])), ", ").alias("attribution"),
    )


def adopt_candidates(offered: DataFrame, catalog: DataFrame) -> DataFrame:
    return offered.join(catalog.select("info_hash"), "info_hash", "left_anti")


def held_sources(offered: DataFrame, catalog: DataFrame, held: bool = True) -> DataFrame:
    """Offers whose source link the catalog holds already, or doesn't."""
    return offered.join(catalog.select("source").filter("source is not null"), "source", "left_semi" if held else "left_anti")


def take_until_seen(items: DataFrame, most: int = 1) -> DataFrame:
    """A feed's items in order up to the first one seen before, `most` of them at most (0: all)."""
    first = items.groupBy("feed").agg(F.min(F.when(F.col("seen"), F.col("pos"))).alias("_stop"))
    new = items.join(first, "feed").filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))).drop("_stop")
    if not most:
        return new
    return new.withColumn("_n", F.row_number().over(Window.partitionBy("feed").orderBy("pos"))).filter(F.col("_n") <= most).drop("_n")


def skip_seen(items: DataFrame) -> DataFrame:
    """Items of a catalogue listing that weren't seen; others don't stop it."""
    return items.filter(~F.col("seen"))


def prune_plan(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries of a feed that its listing no longer has. A listing that is partial or filtered, or that is empty, prunes nothing."""
    whole = listing.groupBy("feed").agg(F.bool_and(~F.col("partial")).alias("_whole")).filter("_whole").select("feed")
    return entries.join(whole, "feed", "left_semi").join(listing.select("feed", "info_hash"), ["feed", "info_hash"], "left_anti")


def expected_builds(sources: DataFrame, held: DataFrame, today: Column, back: int = 3, most: int = 1) -> DataFrame:
    """Dates that a dated source should have: from today back to the first date held, `most` at most. Sources with offset_days count from so many days after today (below 0: before)."""
    start = F.date_add(today, F.coalesce(F.col("offset_days").cast("int"), F.lit(0))) if "offset_days" in sources.columns else today
    dates = sources.withColumn("date", F.explode(F.sequence(start, F.date_sub(start, back - 1), F.expr("interval -1 day"))))
    marked = dates.join(held.select("source", "date", F.lit(True).alias("_held")).distinct(), ["source", "date"], "left")
    stop = marked.groupBy("source").agg(F.max(F.when(F.col("_held"), F.col("date"))).alias("_stop"))
    new = marked.join(stop, "source").filter(F.col("_stop").isNull() | (F.col("date") > F.col("_stop")))
    return new.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("date")))).filter(F.col("_n") <= max(1, most)).select(*dates.columns)


def listing_selection(links: DataFrame, pattern: str, most: int) -> DataFrame:
    """A listing's links that match, the last ones by name."""
    w = Window.partitionBy("source").orderBy(F.desc("link"))
    return links.filter(F.col("link").rlike(pattern)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def seeding_limit(own: Column, node: Column, forever: Column) -> Column:
    """The limit (struct of ratio, minutes) in force: none where the entry is set to seed for ever, its own if it names a number above 0, else the node's."""
    names = lambda x: x.isNotNull() & (F.coalesce(x["ratio"] > 0, F.lit(False)) | F.coalesce(x["minutes"] > 0, F.lit(False)))
    return F.when(F.coalesce(forever, F.lit(False)), F.lit(None)).when(names(own), own).when(names(node), node)


def seeding_verdict(entries: DataFrame, now: Column) -> DataFrame:
    """entries: mode, complete, seeding_since, ratio, limit_ratio, limit_minutes. Whether seeding ends and why, and what is left; the ratio is looked at first, and cached archives never end."""
    minutes = (F.unix_timestamp(now) - F.unix_timestamp("seeding_since")) / 60
    live = (F.col("mode") != "cache") & F.col("complete")
    by_ratio = live & F.col("limit_ratio").isNotNull() & (F.col("ratio") >= F.col("limit_ratio"))
    by_time = live & F.col("limit_minutes").isNotNull() & F.col("seeding_since").isNotNull() & (minutes >= F.col("limit_minutes"))
    left = F.when((F.col("mode") != "cache") & F.col("limit_minutes").isNotNull() & F.col("seeding_since").isNotNull(), F.greatest(F.lit(0.0), (F.col("limit_minutes") - minutes) * 60))
    return entries.withColumns({"verdict": F.when(F.coalesce(by_ratio, F.lit(False)), "ratio").when(F.coalesce(by_time, F.lit(False)), "time").otherwise("keep"), "seconds_left": F.floor(left).cast("long"), "pending": F.col("limit_minutes").isNotNull() & F.col("seeding_since").isNull()})


def seeding_remaining(entries: DataFrame, now: Column) -> DataFrame:
    """What is left before a limit ends seeding, for entries like seeding_verdict's: for ever (cached archives, and those whose limits are none above 0), the progress towards a ratio, the end of the time and its seconds left, or pending where the clock has not begun."""
    ratio, minutes = (F.when(F.col(c) > 0, F.col(c)) for c in ("limit_ratio", "limit_minutes"))
    forever = F.coalesce(F.col("mode") == "cache", F.lit(False)) | ratio.isNull() & minutes.isNull()
    ends = F.timestamp_seconds(F.unix_timestamp("seeding_since") + minutes * 60)
    of = lambda c: F.when(~forever, c)
    return entries.withColumns({
        "forever": forever, "ratio": of(F.when(ratio.isNotNull(), F.coalesce("ratio", F.lit(0.0)))), "ratio_target": of(ratio), "expires_at": of(ends),
        "seconds_left": of(F.when(ends.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(ends) - F.unix_timestamp(now)).cast("long"))), "pending": ~forever & minutes.isNotNull() & F.col("seeding_since").isNull(),
    })


def origin_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Status of each entry of `before` by two snapshots of its origin (info_hash, etag, modified, length, summary), and what differs.

    unknown: nothing was recorded; missing: the origin is gone; changed: a validator that both snapshots have differs; else unchanged. A
    date that alone differs is no change if both summaries are known and agree.
    """
    names = ("etag", "modified", "length")
    b = before.select("info_hash", *(F.col(c).alias(f"_{c}") for c in (*names, "summary")), F.coalesce(*(F.col(c).cast("string") for c in names)).isNotNull().alias("_known"))
    a = after.select("info_hash", *names, "summary", F.lit(True).alias("_there"))
    differs = lambda c: F.col(c).isNotNull() & F.col(f"_{c}").isNotNull() & (F.col(c) != F.col(f"_{c}"))
    rows = b.join(a, "info_hash", "left").withColumn("changes", F.concat_ws("; ", *(F.when(differs(c), c) for c in names)))
    agree = (F.col("changes") == "modified") & F.coalesce(F.col("summary") == F.col("_summary"), F.lit(False))
    status = F.when(~F.col("_known"), "unknown").when(F.col("_there").isNull(), "missing").when((F.col("changes") == "") | agree, "unchanged").otherwise("changed")
    return rows.select("info_hash", status.alias("status"), F.when(status == "changed", F.col("changes")).otherwise("").alias("changes"))


def edited_categories(cats: Column, add: Column, remove: Column, replace: Column | None = None) -> Column:
    """Categories after an edit: replaced or kept, then added to, then taken from; sorted."""
    base = F.coalesce(replace, cats) if replace is not None else cats
    return F.array_sort(F.array_except(F.array_union(base, add), remove))


def ordered_union(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def all_peers(engines: dict[str, DataFrame]) -> DataFrame:
    """Peers of all engines, tagged by engine; columns that an engine lacks are null."""
    out = None
    for name, peers in engines.items():
        tagged = peers.withColumn("engine", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Entries by key: new values over old ones, the first creation kept, the update noted on rows that new has."""
    keys = ("info_hash", "created_at", "updated_at")
    rest = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in rest]
    created = F.coalesce(F.col("o.created_at"), F.col("n.created_at") if "created_at" in new.columns else F.lit(None), now)
    return o.join(n, F.col("o.info_hash") == F.col("n.info_hash"), "full_outer").select(F.coalesce("o.info_hash", "n.info_hash").alias("info_hash"), *pick, created.alias("created_at"), F.when(F.col("_new"), now).otherwise(F.col("o.updated_at")).alias("updated_at"))


def sorted_catalog(catalog: DataFrame, by: str) -> DataFrame:
    """Entries in the order of a listing: name, newest or largest; unknown values last."""
    order = {"name": [F.lower("name").asc_nulls_last(), F.col("info_hash")], "newest": newest(), "largest": [F.col("size").desc_nulls_last(), F.col("info_hash")]}
    return catalog.orderBy(*order[by])


def feed_items(catalog: DataFrame, most: int = 0) -> DataFrame:
    """The newest entries for a feed (0: all); the cap is the feature."""
    out = catalog.orderBy(*newest())
    return out.limit(most) if most else out
