"""Queries on catalogs, feeds and recipes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules as P
from ..operators import audit as A
from ..operators import catalog as C
from ..operators.stack import stack_revision
from ..sources import tables as H
from ..streaming.streams import shared_dir
from .fixtures import catalog, feed_items, table, with_views

NOW = "1999-01-01 00:00:00"
#: Recipes of the queries: stack, index from the bottom, category or pinned archive, required.
RECIPES = (("base", 0, "BUILDING", None, None), ("base", 1, "1-URGENT", None, None), ("base", 2, None, 7, None), ("relief", 0, "AUTOMOBILE", None, None), ("relief", 1, "NOWHERE", None, True), ("relief", 2, None, 999999999, None))


def recipe_sources(s):
    return s.createDataFrame(list(RECIPES), "stack_id string, idx int, category string, archive long, required boolean")


def _seconds(*names):
    return [F.unix_timestamp(n).alias(n) for n in names]


def category_list(s, d):
    return C.category_list(catalog(s, d))


def category_summary(s, d):
    return C.category_summary(catalog(s, d))


def newest_per_category(s, d):
    return C.newest_per_category(catalog(s, d)).select("category", "info_hash", "name", *_seconds("created_at"))


def retention_plan(s, d):
    return C.retention_plan(catalog(s, d), "custkey", 5, 900, F.lit(NOW).cast("timestamp")).select("info_hash", "custkey", "rank", "reason")


def retirement_plan(s, d):
    c = catalog(s, d).withColumn("arrived", F.col("info_hash") % 3 == 0)
    return C.retirement_plan(c, "custkey", "arrived", 2, True).select("info_hash", "custkey", "rank")


def catalog_search(s, d):
    return catalog(s, d).filter(P.matches_text(" House", F.col("name"), F.col("info_hash").cast("string"), F.col("categories"))).select("info_hash", "name")


def publishing_flags(s, d):
    c = catalog(s, d).withColumns({"own_serve": F.when(F.col("info_hash") % 3 == 0, F.col("info_hash") % 2 == 0), "own_seed": F.when(F.col("info_hash") % 5 == 0, True)})
    flags = P.publishing({"serve": F.col("own_serve"), "self_seed": F.col("own_seed"), "download": F.lit(True)}, {"serve": F.lit(True)}, F.col("complete"))
    return c.select("info_hash", *(v.alias(k) for k, v in flags.items()))


def visible_entries(s, d):
    scope, allowed = F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.when(F.col("info_hash") % 2 == 0, F.array(F.lit("1-URGENT"), F.lit("BUILDING")))
    return catalog(s, d).filter(P.visible(F.col("categories"), scope, allowed)).select("info_hash")


def title_filter(s, d):
    return catalog(s, d).filter(F.col("name").rlike("(?i)^ORDER-[0-9]*7$")).select("info_hash", "name")


def catalog_status(s, d):
    status = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("info_hash")).agg(F.count(F.lit(1)).alias("peers"), F.sum("l_quantity").alias("uploaded"))
    return C.with_status(catalog(s, d), status).select("info_hash", "size", "peers", "uploaded")


def engine_merge(s, d):
    e = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("info_hash"), F.concat(F.lit("e"), (F.col("l_linenumber") % 3).cast("string")).alias("engine")).agg(
        F.max("l_linestatus").alias("state"), F.sum("l_quantity").cast("long").alias("peers"), F.count(F.lit(1)).alias("seeds"), F.max("l_quantity").cast("long").alias("down"), F.min("l_quantity").cast("long").alias("up")
    )
    return C.merged_status(e, "e1")


def stack_resolution(s, d):
    return C.resolved_sources(recipe_sources(s), catalog(s, d))


def stack_impact(s, d):
    c = catalog(s, d)
    return C.removal_impact(c, recipe_sources(s), c)


def stack_impact_all(s, d):
    c = catalog(s, d)
    return C.removal_impact(c, recipe_sources(s), c)


def stack_coverage(s, d):
    c = table(s, d, "orders").select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("stack_id"), F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 6).cast("int").alias("min_zoom"), (8 + F.col("o_orderkey") % 7).cast("int").alias("max_zoom"),
        *((F.col("o_orderkey") % 90 - x).cast("double").alias(n) for n, x in (("west", 100), ("south", 50), ("east", -10), ("north", 5))), F.when(F.col("o_custkey") % 2 == 0, "png").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "png").otherwise("webp")).alias("format"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("attribution"),
    )
    return C.stack_coverage(c)


def stack_revisions(s, d):
    return stack_revision(C.resolved_sources(recipe_sources(s), catalog(s, d)))


def adopt_candidates(s, d):
    offered = table(s, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("info_hash")).distinct()
    return C.adopt_candidates(offered, catalog(s, d))


def held_sources(s, d):
    c = catalog(s, d).withColumn("source", F.concat(F.lit("http://x/"), F.col("info_hash").cast("string")))
    offered = table(s, d, "documents").select("doc_id", F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("source"))
    return C.held_sources(offered, c).select("doc_id").withColumn("held", F.lit(True)).unionByName(C.held_sources(offered, c, held=False).select("doc_id").withColumn("held", F.lit(False)))


def feed_take_until_seen(s, d):
    return C.take_until_seen(feed_items(s, d), 3).select("feed", "pos", "info_hash")


def catalogue_unseen(s, d):
    return C.skip_seen(feed_items(s, d)).select("feed", "info_hash")


def prune_plan(s, d):
    items = feed_items(s, d)
    listing = items.filter("info_hash % 3 <> 0").withColumn("partial", F.col("feed").isin("src1", "src2"))
    return C.prune_plan(items.select("feed", "info_hash"), listing)


def expected_builds(s, d):
    src = table(s, d, "nation").select(F.col("n_nationkey").alias("source"))
    held = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("source"), F.col("o_orderdate").cast("date").alias("date"))
    today = held.agg(F.max("date").alias("_t"))
    return C.expected_builds(src.crossJoin(today).withColumn("today", F.col("_t")), held, F.col("today"), 5, 3).select("source", F.date_format("date", "yyyy-MM-dd").alias("date"))  # one row on the right


#: Forms of dated links; braces that are no date stay.
TEMPLATES = ("https://h/{YYYY}/{MM}/b-{YYYYMMDD}.pmtiles", "h/{YYYY-MM-DD}/{yy}_{M}.{D}", "h/{name}/{yyyy/mm}/{D-}{}", "h/{Y.M.D}/{YY")


def url_templates(s, d):
    forms = F.array(*(F.lit(t) for t in TEMPLATES))
    return catalog(s, d).select("info_hash", P.expand_template(F.get(forms, (F.col("info_hash") % 4).cast("int")), F.col("created_at")).alias("url"))


def seeding_verdicts(s, d):
    now = F.lit("1998-06-01 00:00:00").cast("timestamp")
    e = catalog(s, d).select(
        "info_hash", F.when(F.col("info_hash") % 4 == 0, "cache").otherwise("full").alias("mode"), "complete", F.when(F.col("info_hash") % 5 != 0, F.col("created_at")).alias("seeding_since"), (F.col("size") % 40 / 10).alias("ratio"),
        F.coalesce(F.when(F.col("info_hash") % 3 == 0, F.lit(2.0)), F.lit(3.5)).alias("limit_ratio"), F.when(F.col("info_hash") % 2 == 0, F.lit(1000000)).alias("limit_minutes"),
    )
    return C.seeding_verdict(e, now).select("info_hash", "verdict", "seconds_left", "pending")


def seeding_remaining(s, d):
    c = catalog(s, d)
    k = F.col("info_hash")
    e = c.select("info_hash", F.when(k % 4 == 0, "cache").otherwise("full").alias("mode"), F.when(k % 5 != 0, F.col("created_at")).alias("seeding_since"), F.when(k % 7 != 0, F.col("size") % 40 / 10).alias("ratio"), F.when(k % 3 == 0, 2.0).when(k % 3 == 1, 0.0).alias("limit_ratio"), F.when(k % 2 == 0, 1000000).when(k % 11 == 0, -5).alias("limit_minutes"))
    now = F.lit("1997-01-01 00:00:00").cast("timestamp")
    return C.seeding_remaining(e, now).select("info_hash", "forever", "ratio", "ratio_target", F.unix_timestamp("expires_at").alias("expires_at"), "seconds_left", "pending")


def origin_drift(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    known = k % 13 != 0
    a = o.select(k.alias("info_hash"), F.when(known & (k % 2 == 0), F.lit("e")).alias("etag"), F.when(known, F.lit(10)).alias("modified"), F.when(known, F.lit(5)).alias("length"), F.when(k % 4 < 2, F.lit("s")).alias("summary"))
    b = o.filter(k % 17 != 0).select(k.alias("info_hash"), F.when(k % 7 == 0, "f").otherwise("e").alias("etag"), F.when(k % 3 == 0, 11).otherwise(10).alias("modified"), F.when(k % 11 == 0, 6).otherwise(5).alias("length"), F.when(k % 5 < 3, F.when(k % 6 == 0, "t").otherwise("s")).alias("summary"))
    return C.origin_drift(a, b)


def category_edits(s, d):
    out = C.edited_categories(P.categories(F.col("categories"), F.concat(F.lit(" "), F.col("family"))), F.array(F.lit("new")), F.array(F.lit("BUILDING"), F.lit("1-URGENT")))
    return catalog(s, d).select("info_hash", F.array_join(out, "|").alias("categories"), F.array_join(C.ordered_union(F.array(F.lit("z"), F.col("family")), F.array(F.col("family"), F.lit("a"))), "|").alias("attributions"))


def engine_peers(s, d):
    return engine_peers_all(s, d)


def engine_peers_all(s, d):
    """Every line is a peer of one engine: odd ones of the first, which tells no speed, even ones of the second."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("info_hash"), F.col("l_suppkey").alias("peer"), F.col("l_linenumber").alias("k"))
    return C.all_peers({"one": li.filter("k % 2 = 1").select("info_hash", "peer"), "two": li.filter("k % 2 = 0").select("info_hash", "peer", F.col("k").alias("speed"))})


def name_kinds(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("dir/F"), F.col("doc_id").cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".pmtiles", ".MBTiles", ".torrent", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int"))).alias("path"))
    ruled = A.matched_rules(docs, [("tens", "F*0.pmtiles"), ("tiles", "*.pmtiles"), ("short", "F?.*")])
    return docs.join(ruled.select("doc_id", "rule"), "doc_id", "left").select("doc_id", P.kind_of_name(F.col("path")).alias("kind"), "rule", P.matches_glob(F.col("path"), "F1*.t*").alias("globbed"))


def catalog_upsert(s, d):
    c = catalog(s, d).select("info_hash", "name", "size", "created_at").withColumn("updated_at", F.col("created_at"))
    new = table(s, d, "documents").select(F.col("doc_id").alias("info_hash"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("long").alias("size"))
    return C.upsert(c, new, F.lit(NOW).cast("timestamp")).select("info_hash", "name", "size", *_seconds("created_at", "updated_at"))


def catalog_upsert_stored(s, d):
    """The same through a stored catalogue: all entries as a first batch, the documents as a second one that comes twice."""
    c = catalog(s, d).select("info_hash", "name", "size", "created_at").withColumn("updated_at", F.col("created_at"))
    new = table(s, d, "documents").select(F.col("doc_id").alias("info_hash"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("long").alias("size"))
    store = H.Buckets(s, f"{shared_dir(s)}/catalog-{uuid.uuid4().hex}", "info_hash long, name string, size long, created_at timestamp, updated_at timestamp", "info_hash")
    store.merge("load", c, lambda old, rows: rows)
    for _ in range(2):
        store.merge("documents", new, lambda old, rows: C.upsert(old, rows, F.lit(NOW).cast("timestamp")))
    return store.rows().select("info_hash", "name", "size", *_seconds("created_at", "updated_at"))


def _placed(s, d, by):
    """The sorted entries with their place in the order that the frame has: its partitions are ranges in order, so a place is a partition's first place and the row's within."""
    rows = C.sorted_catalog(catalog(s, d).select("info_hash", F.when(F.col("info_hash") % 9 != 0, F.upper("name")).alias("name"), F.when(F.col("info_hash") % 8 != 0, F.col("size") % 100).alias("size"), "created_at", "build_date"), by)
    numbered = rows.select("info_hash", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_id"))
    from pyspark.sql import Window

    parts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row for each partition
    return numbered.join(F.broadcast(parts), "_p").select("info_hash", (F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def catalog_ranks(s, d):
    return _placed(s, d, "newest")


def catalog_by_name(s, d):
    return _placed(s, d, "name")


def catalog_by_size(s, d):
    return _placed(s, d, "largest")


def feed_cap(s, d):
    return C.feed_items(catalog(s, d), 25).select("info_hash", "name")


def metadata_flags(s, d):
    e = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    flag = F.when(F.col("event_id") % 3 == 0, " TRUE").when(F.col("event_id") % 3 == 1, "0").otherwise(F.col("k"))
    enc = F.when(F.col("event_id") % 2 == 0, " Terrarium").otherwise(F.col("event_type"))
    f = P.custom_factors(F.col("k"), F.lit("1.5"), F.when(F.col("event_id") % 4 == 0, F.lit("x")).otherwise(F.lit("2")), F.lit("0"))
    return e.select("event_id", P.metadata_flag(flag).alias("flag"), P.metadata_encoding(enc).alias("encoding"), f.isNotNull().alias("custom"))


QUERIES = (category_list, category_summary, newest_per_category, retention_plan, retirement_plan, catalog_search, publishing_flags, visible_entries, title_filter, catalog_status, engine_merge, stack_resolution, stack_impact, stack_impact_all, stack_coverage, stack_revisions, adopt_candidates, held_sources, feed_take_until_seen, catalogue_unseen, prune_plan, expected_builds, url_templates, seeding_verdicts, seeding_remaining, origin_drift, category_edits, engine_peers, engine_peers_all, name_kinds, catalog_upsert, catalog_upsert_stored, catalog_ranks, catalog_by_name, catalog_by_size, feed_cap, metadata_flags)

CAT, PERCAT, FEED = with_views("catalog"), with_views("catalog", "percat"), with_views("feed_items")
_ORDER = "coalesce(build_date, created_at) DESC, created_at DESC, info_hash"
_RECIPES = "recipes(stack_id, idx, category, archive, required) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in RECIPES) + ")"
_NEWEST = f"newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY category) AS n FROM percat) WHERE k = 1)"
_RESOLVED = f"""{PERCAT}, {_RECIPES}, {_NEWEST}, resolved AS (SELECT stack_id, idx, r.category, CASE WHEN r.archive IS NOT NULL THEN c.info_hash ELSE n.info_hash END AS info_hash, r.archive IS NOT NULL AS pinned, coalesce(r.required, idx = 0) AS required
FROM recipes r LEFT JOIN newest n ON n.category = r.category LEFT JOIN catalog c ON c.info_hash = r.archive)"""
_TS = lambda c: f"CAST(floor(epoch({c})) AS BIGINT)"

ORACLE = {
    "category_list": f"{PERCAT} SELECT DISTINCT category FROM percat",
    "category_summary": f"{PERCAT} SELECT category, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, first(info_hash ORDER BY {_ORDER}) AS newest, bool_or(complete) AS servable FROM percat GROUP BY category",
    "newest_per_category": f"{PERCAT}, {_NEWEST} SELECT category, info_hash, name, {_TS('created_at')} AS created_at FROM newest",
    "retention_plan": f"""{CAT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY {_ORDER}) AS rank FROM catalog)
SELECT info_hash, custkey, rank, CASE WHEN rank > 5 THEN 'count' ELSE 'age' END AS reason FROM ranked WHERE rank > 5 OR (rank > 1 AND coalesce(build_date, created_at) < TIMESTAMP '{NOW}' - INTERVAL 900 DAY)""",
    "retirement_plan": f"""{CAT}, ranked AS (SELECT *, row_number() OVER w AS rank, first_value(info_hash % 3 = 0) OVER w AS f, first_value(complete) OVER w AS c FROM catalog WINDOW w AS (PARTITION BY custkey ORDER BY {_ORDER}))
SELECT info_hash, custkey, rank FROM ranked WHERE f AND c AND rank > 2""",
    "catalog_search": f"{CAT} SELECT info_hash, name FROM catalog WHERE lower(name) LIKE '%house%' OR lower(array_to_string(categories, '|')) LIKE '%house%'",
    "publishing_flags": f"""{CAT}, f AS (SELECT info_hash, complete, coalesce(CASE WHEN info_hash % 3 = 0 THEN info_hash % 2 = 0 END, true) AS serve, coalesce(CASE WHEN info_hash % 5 = 0 THEN true END, false) AS ss FROM catalog)
SELECT info_hash, serve, ss AND serve AS self_seed, complete AS download FROM f""",
    "visible_entries": f"{CAT} SELECT info_hash FROM catalog WHERE list_has_any(categories, ['BUILDING', 'MACHINERY']) AND (info_hash % 2 <> 0 OR list_has_any(categories, ['1-URGENT', 'BUILDING']))",
    "title_filter": f"{CAT} SELECT info_hash, name FROM catalog WHERE regexp_matches(name, '(?i)^ORDER-[0-9]*7$')",
    "catalog_status": f"{CAT} SELECT info_hash, size, peers, uploaded FROM catalog LEFT JOIN (SELECT l_orderkey AS info_hash, count(*) AS peers, sum(l_quantity) AS uploaded FROM lineitem GROUP BY 1) USING (info_hash)",
    "engine_merge": """WITH e AS (SELECT l_orderkey AS info_hash, 'e' || (l_linenumber % 3) AS engine, max(l_linestatus) AS state, CAST(sum(l_quantity) AS BIGINT) AS peers, count(*) AS seeds, CAST(max(l_quantity) AS BIGINT) AS down, CAST(min(l_quantity) AS BIGINT) AS up FROM lineitem GROUP BY 1, 2)
SELECT info_hash, max(state) FILTER (WHERE engine = 'e1') AS state, CAST(sum(peers) AS BIGINT) AS peers, CAST(sum(seeds) AS BIGINT) AS seeds, CAST(sum(down) AS BIGINT) AS down, CAST(sum(up) AS BIGINT) AS up, string_agg(engine, ',' ORDER BY engine) AS engines FROM e GROUP BY info_hash HAVING bool_or(engine = 'e1')""",
    "stack_resolution": f"{_RESOLVED} SELECT * FROM resolved",
    "stack_impact": f"""{PERCAT}, {_RECIPES}, {_NEWEST}
SELECT stack_id, idx, archive AS info_hash, 'pinned' AS impact FROM recipes JOIN catalog ON info_hash = archive WHERE archive % 7 = 0
UNION ALL SELECT r.stack_id, r.idx, p.info_hash, CASE WHEN n.n = 1 THEN 'last' WHEN n.info_hash = p.info_hash THEN 'newest' ELSE 'category' END FROM percat p JOIN newest n USING (category) JOIN recipes r ON r.category = p.category AND r.archive IS NULL WHERE p.info_hash % 7 = 0""",
    "stack_coverage": """WITH c AS (SELECT 's' || (o_custkey % 50) AS stack_id, o_orderkey AS idx, CAST(o_orderkey % 6 AS INT) AS min_zoom, CAST(8 + o_orderkey % 7 AS INT) AS max_zoom, o_orderkey % 90 AS b,
  CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 2 = 0 THEN 'png' ELSE 'webp' END AS format, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS att FROM orders),
a AS (SELECT stack_id, string_agg(att, ', ' ORDER BY first) AS attribution FROM (SELECT stack_id, att, min(idx) AS first FROM c WHERE att IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT stack_id, min(min_zoom) AS min_zoom, max(max_zoom) AS max_zoom, CAST(min(b) - 100 AS DOUBLE) AS west, CAST(min(b) - 50 AS DOUBLE) AS south, CAST(max(b) + 10 AS DOUBLE) AS east, CAST(max(b) - 5 AS DOUBLE) AS north,
  CASE WHEN min(format) = max(format) THEN min(format) END AS format, coalesce(any_value(attribution), '') AS attribution FROM c LEFT JOIN a USING (stack_id) GROUP BY stack_id""",
    "stack_revisions": f"{_RESOLVED} SELECT stack_id, substr(sha1(stack_id || ':' || string_agg(coalesce(CAST(info_hash AS VARCHAR), ''), ':' ORDER BY idx)), 1, 16) AS revision FROM resolved GROUP BY stack_id",
    "adopt_candidates": f"{CAT} SELECT DISTINCT l_orderkey + l_linenumber AS info_hash FROM lineitem WHERE l_orderkey + l_linenumber NOT IN (SELECT info_hash FROM catalog)",
    "held_sources": f"{CAT} SELECT doc_id, doc_id IN (SELECT info_hash FROM catalog) AS held FROM documents",
    "feed_take_until_seen": f"{FEED}, stop AS (SELECT feed, min(pos) FILTER (WHERE seen) AS s FROM feed_items GROUP BY feed) SELECT feed, CAST(pos AS INT) AS pos, info_hash FROM feed_items JOIN stop USING (feed) WHERE (s IS NULL OR pos < s) AND pos <= 3",
    "catalogue_unseen": f"{FEED} SELECT feed, info_hash FROM feed_items WHERE NOT seen",
    "prune_plan": f"{FEED} SELECT feed, info_hash FROM feed_items WHERE feed NOT IN ('src1', 'src2') AND info_hash % 3 = 0 AND feed IN (SELECT feed FROM feed_items WHERE info_hash % 3 <> 0)",
    "expected_builds": """WITH held AS (SELECT DISTINCT c_nationkey AS source, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT max(date) AS today FROM held),
dates AS (SELECT n_nationkey AS source, CAST(today - CAST(k AS INT) AS DATE) AS date FROM nation, t, range(5) r(k)), stop AS (SELECT source, max(date) AS s FROM dates JOIN held USING (source, date) GROUP BY 1)
SELECT source, strftime(date, '%Y-%m-%d') AS date FROM (SELECT source, date, row_number() OVER (PARTITION BY source ORDER BY date DESC) AS k FROM dates LEFT JOIN stop USING (source) WHERE s IS NULL OR date > s) WHERE k <= 3""",
    "url_templates": f"""{CAT} SELECT info_hash, CASE info_hash % 4 WHEN 0 THEN strftime(created_at, 'https://h/%Y/%m/b-%Y%m%d.pmtiles') WHEN 1 THEN strftime(created_at, 'h/%Y-%m-%d/%y_%-m.%-d')
  WHEN 2 THEN 'h/{{name}}/' || strftime(created_at, '%Y/%m') || '/{{D-}}{{}}' ELSE strftime(created_at, 'h/%Y.%-m.%-d') || '/{{YY' END AS url FROM catalog""",
    "seeding_verdicts": f"""{CAT}, e AS (SELECT info_hash, info_hash % 4 <> 0 AND complete AS live, CASE WHEN info_hash % 5 <> 0 THEN created_at END AS since, size % 40 / 10 AS ratio, CASE WHEN info_hash % 3 = 0 THEN 2.0 ELSE 3.5 END AS lr, CASE WHEN info_hash % 2 = 0 THEN 1000000 END AS lm FROM catalog),
m AS (SELECT *, (epoch(TIMESTAMP '1998-06-01') - floor(epoch(since))) / 60 AS minutes FROM e)
SELECT info_hash, CASE WHEN live AND ratio >= lr THEN 'ratio' WHEN live AND coalesce(minutes >= lm, false) THEN 'time' ELSE 'keep' END AS verdict, CASE WHEN info_hash % 4 <> 0 AND lm IS NOT NULL AND since IS NOT NULL THEN CAST(floor(greatest(0, (lm - minutes) * 60)) AS BIGINT) END AS seconds_left, lm IS NOT NULL AND since IS NULL AS pending FROM m""",
    "seeding_remaining": f"""{CAT}, e AS (SELECT info_hash, info_hash % 4 = 0 AS cache, CASE WHEN info_hash % 5 <> 0 THEN epoch(created_at) END AS since, CASE WHEN info_hash % 7 <> 0 THEN size % 40 / 10 ELSE 0.0 END AS r, CASE WHEN info_hash % 3 = 0 THEN 2.0 END AS lr, CASE WHEN info_hash % 2 = 0 THEN 1000000 END AS lm FROM catalog),
f AS (SELECT *, cache OR lr IS NULL AND lm IS NULL AS forever FROM e)
SELECT info_hash, forever, CASE WHEN NOT forever AND lr IS NOT NULL THEN r END AS ratio, CASE WHEN NOT forever THEN lr END AS ratio_target, CASE WHEN NOT forever THEN CAST(since + lm * 60 AS BIGINT) END AS expires_at,
  CASE WHEN NOT forever THEN CAST(greatest(0, since + lm * 60 - 852076800) + since * 0 + lm * 0 AS BIGINT) END AS seconds_left, NOT forever AND lm IS NOT NULL AND since IS NULL AS pending FROM f""",
    "origin_drift": """WITH x AS (SELECT o_orderkey AS k FROM orders), y AS (SELECT k, k % 13 = 0 AS unknown, k % 17 = 0 AS missing, k % 2 = 0 AND k % 7 = 0 AS e, k % 3 = 0 AS m, k % 11 = 0 AS l, k % 4 < 2 AND k % 5 < 3 AND k % 6 <> 0 AS same FROM x),
z AS (SELECT *, CASE WHEN unknown THEN 'unknown' WHEN missing THEN 'missing' WHEN NOT e AND NOT l AND (NOT m OR same) THEN 'unchanged' ELSE 'changed' END AS status FROM y)
SELECT k AS info_hash, status, CASE WHEN status = 'changed' THEN concat_ws('; ', CASE WHEN e THEN 'etag' END, CASE WHEN m THEN 'modified' END, CASE WHEN l THEN 'length' END) ELSE '' END AS changes FROM z""",
    "category_edits": f"""{CAT} SELECT info_hash, array_to_string(list_sort(list_distinct(list_filter(list_concat(categories, [family, 'new']), lambda c: c NOT IN ('BUILDING', '1-URGENT')))), '|') AS categories, 'z|' || family || '|a' AS attributions FROM catalog""",
    "name_kinds": """SELECT doc_id, ['pmtiles', 'mbtiles', 'torrent', 'other'][doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 4 = 0 AND doc_id % 10 = 0 THEN 'tens' WHEN doc_id % 4 = 0 THEN 'tiles' WHEN doc_id < 10 THEN 'short' END AS rule, doc_id % 4 IN (2, 3) AND CAST(doc_id AS VARCHAR) LIKE '1%' AS globbed FROM documents""",
    "catalog_upsert": f"""{CAT} SELECT coalesce(c.info_hash, doc_id) AS info_hash, coalesce('doc-' || doc_id, name) AS name, size, {_TS(f"coalesce(created_at, TIMESTAMP '{NOW}')")} AS created_at, {_TS(f"CASE WHEN doc_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE created_at END")} AS updated_at FROM catalog c FULL JOIN documents ON doc_id = c.info_hash""",
    "catalog_upsert_stored": f"""{CAT} SELECT coalesce(c.info_hash, doc_id) AS info_hash, coalesce('doc-' || doc_id, name) AS name, size, {_TS(f"coalesce(created_at, TIMESTAMP '{NOW}')")} AS created_at, {_TS(f"CASE WHEN doc_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE created_at END")} AS updated_at FROM catalog c FULL JOIN documents ON doc_id = c.info_hash""",
    "catalog_ranks": f"{CAT} SELECT info_hash, row_number() OVER (ORDER BY coalesce(build_date, created_at) DESC NULLS LAST, created_at DESC NULLS LAST, info_hash) - 1 AS place FROM catalog",
    "catalog_by_name": f"{CAT} SELECT info_hash, row_number() OVER (ORDER BY CASE WHEN info_hash % 9 <> 0 THEN lower(name) END NULLS LAST, info_hash) - 1 AS place FROM catalog",
    "catalog_by_size": f"{CAT} SELECT info_hash, row_number() OVER (ORDER BY CASE WHEN info_hash % 8 <> 0 THEN size % 100 END DESC NULLS LAST, info_hash) - 1 AS place FROM catalog",
    "feed_cap": f"{CAT} SELECT info_hash, name FROM catalog ORDER BY {_ORDER} LIMIT 25",
    "metadata_flags": """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events), f AS (SELECT *, lower(trim(CASE event_id % 3 WHEN 0 THEN ' TRUE' WHEN 1 THEN '0' ELSE k END)) AS t, lower(trim(CASE WHEN event_id % 2 = 0 THEN ' Terrarium' ELSE event_type END)) AS enc FROM e)
SELECT event_id, CASE WHEN t IN ('true', '1', 'yes') THEN true WHEN t IN ('false', '0', 'no') THEN false END AS flag, CASE WHEN enc IN ('mapbox', 'terrarium', 'custom') THEN enc END AS encoding, try_cast(k AS DOUBLE) IS NOT NULL AND event_id % 4 <> 0 AS custom FROM f""",
}
# The same over all entries and all lines.
ORACLE["stack_impact"] = ORACLE["stack_impact"].replace(" WHERE archive % 7 = 0", "").replace(" WHERE p.info_hash % 7 = 0", "")
ORACLE["stack_impact_all"] = ORACLE["stack_impact"]
ORACLE["engine_peers_all"] = "SELECT l_orderkey AS info_hash, l_suppkey AS peer, CASE WHEN l_linenumber % 2 = 1 THEN 'one' ELSE 'two' END AS engine, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS speed FROM lineitem"
ORACLE["engine_peers"] = ORACLE["engine_peers_all"]
