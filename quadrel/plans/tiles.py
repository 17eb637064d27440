"""Queries on coverage, contents, pieces and audits, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import rules as P
from ..functions import tiles as T
from ..operators import audit as A
from ..operators import cover as V
from ..operators import pieces as K
from ..operators import runs as U
from ..operators import stack as ST
from ..operators import tiles as O
from ..sources import pmtiles as Z
from ..sources import text as X
from ..streaming.streams import shared_dir
from .fixtures import archive_tiles, catalog, piece_availability, table, tile_payloads, tile_requests, with_views


def coverage_union(s, d):
    return O.coverage_union(archive_tiles(s, d))


def coverage_overlap(s, d):
    return O.coverage_overlap(archive_tiles(s, d), 0, 1)


def _entries(s, d):
    """Each archive's directory entries: its tiles as runs."""
    return U.union_runs(archive_tiles(s, d).withColumn("run_length", F.lit(1).cast("long")), ["source_idx"])


def coverage_union_runs(s, d):
    return U.union_runs(_entries(s, d))


def coverage_overlap_runs(s, d):
    return U.overlap_runs(_entries(s, d), 0, 1)


def warm_report_runs(s, d):
    """The second archive's tiles, and the block of ids around every hundredth of them, are wanted of the first."""
    two = _entries(s, d).filter("source_idx = 1")
    blocks = two.select(F.floor(F.col("tile_id") / 100).cast("long").alias("b")).distinct().select((F.col("b") * 100).alias("tile_id"), F.lit(40).cast("long").alias("run_length"))
    return U.warm_runs(two.select("tile_id", "run_length").unionByName(blocks), _entries(s, d).filter("source_idx = 0"))


def coverage_by_zoom(s, d):
    return archive_tiles(s, d).groupBy("source_idx", T.zoom_of(F.col("tile_id")).alias("z")).agg(F.count(F.lit(1)).alias("tiles"))


def tile_places(s, d):
    t = O.with_zxy(O.coverage_union(archive_tiles(s, d)))
    return t.select("tile_id", "z", "x", "y", T.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("back"))


def priority_tiles(s, d):
    t = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("source_idx"), F.col("l_orderkey").alias("tile_id")).agg(F.max("l_extendedprice").alias("payload"))
    return O.priority_tiles(t, "payload")


def _places(s, d):
    return O.with_zxy(O.coverage_union(archive_tiles(s, d)))


def parent_fallback(s, d):
    t = _places(s, d)
    return O.ancestor_tiles(t.filter("tile_id % 3 = 0").select("z", "x", "y"), t.filter("tile_id % 3 <> 0"))


def child_assembly(s, d):
    t = _places(s, d)
    return O.assembled_children(t.select("z", "x", "y", F.col("tile_id").alias("parent")), t.select("z", "x", "y", "tile_id"), 1).select("parent", "children")


def _boxes(s, d):
    k = F.col("o_orderkey") % 1009
    return table(s, d, "orders").select(F.col("o_orderkey").alias("box"), (k * 0.3 - 170).alias("west"), (k * 0.13 - 70).alias("south"), (k * 0.3 - 170 + 1 + k % 7 * 4).alias("east"), (k * 0.13 - 70 + 1 + k % 5 * 3).alias("north"))


def tiles_in_bounds(s, d):
    return O.tiles_in_bounds(_boxes(s, d), 0, 4).select("box", "z", "x", "y")


def tiles_in_bounds_runs(s, d):
    """All boxes together, eight zooms, as runs of ids."""
    return V.boxes_union(_boxes(s, d), 0, 7)


def tile_counts(s, d):
    return O.tile_counts(_boxes(s, d), 0, 10, 500).select("box", "tiles")


def warm_report(s, d):
    w = O.tiles_in_bounds(_boxes(s, d), 0, 6).select("z", T.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id")).distinct()
    return O.warm_report(w, archive_tiles(s, d))


def shared_domain(s, d):
    """Every order's archive has some zooms and a box; what all of them share."""
    b = _boxes(s, d).select((F.col("box") % 4).alias("min_zoom"), (F.col("box") % 3 + 5).alias("max_zoom"), (F.col("west") / 100 - 5).alias("west"), (F.col("south") / 100 - 5).alias("south"), (F.col("east") / 100 + 10).alias("east"), (F.col("north") / 100 + 5).alias("north"))
    return O.shared_domain(b).select("min_zoom", "max_zoom", *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


def box_sides(s, d):
    return _boxes(s, d).select("box", F.explode(T.bounds_segments(F.col("west"), F.col("south"), F.col("east"), F.col("north"))).alias("s")).select("box", F.col("s.seg").alias("seg"), *(F.round(F.col(f"s.{c}"), 6).alias(c) for c in ("ax", "ay", "bx", "by")))


def tile_dedup(s, d):
    return O.content_dedup(tile_payloads(s, d))


def tile_runs(s, d):
    return O.tile_runs(tile_payloads(s, d, "lang"))


def content_counts(s, d):
    return O.content_counts(tile_payloads(s, d, "lang"))


def tile_offsets(s, d):
    return O.tile_offsets(O.content_dedup(tile_payloads(s, d))).select("tile_id", "length", "offset")


def _arrivals(s, d):
    e = table(s, d, "lineitem").select((F.col("l_suppkey") % 4).alias("archive"), F.col("l_orderkey").alias("tile_id"), (F.col("l_orderkey") * 8 + F.when(F.col("l_suppkey") % 4 == 1, 0).otherwise(F.col("l_linenumber"))).alias("seq")).groupBy("archive", "tile_id").agg(F.min("seq").alias("seq"))
    return e.withColumn("seq", F.when(F.col("archive") == 2, -F.col("seq")).when((F.col("archive") == 3) & (F.col("tile_id") % 1000 == 7), F.col("seq") + 64).otherwise(F.col("seq")))


def clustered_check(s, d):
    return O.clustered(_arrivals(s, d), "archive", "seq", 8)


def passthrough_split(s, d):
    return O.passthrough(archive_tiles(s, d), F.col("tile_id") % 5 == 0)


def bake_report(s, d):
    t = archive_tiles(s, d)
    return ST.bake_report(O.coverage_union(t), t.filter("source_idx = 0"))


def bake_archive(s, d):
    """The topmost source's tiles, baked into one archive in the shared folder and read back from it."""
    folder = f"{shared_dir(s).removeprefix('file://').removeprefix('file:')}/baked-{uuid.uuid4().hex}"
    os.makedirs(folder)
    layers = table(s, d, "documents").select(F.floor(F.col("doc_id") / 2).cast("long").alias("tile_id"), (F.col("doc_id") % 2).cast("int").alias("source_idx"), "lang", "text")
    content = F.when(F.col("tile_id") % 3 == 0, F.col("text")).otherwise(F.col("lang"))
    answers = O.priority_tiles(layers.withColumn("content", content), "content")
    ST.bake(answers, F.col("content").cast("binary"), f"{folder}/all.pmtiles", {"max_zoom": 12}, {"name": "all"})
    entries = Z.scan(s, folder)
    tiles = Z.read_tiles(entries, folder).select(F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"), F.sha2("content", 256).alias("digest"), F.col("run_length").cast("long").alias("run_length"))
    return tiles


def _local_shared(s):
    """A new folder in the shared one, as a path that open() takes."""
    folder = f"{shared_dir(s).removeprefix('file://').removeprefix('file:')}/baked-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def bake_resumed(s, d):
    """A bake of every line's order as a tile, broken off after two ranges and gone on with: entries by the archive's own directory, of more than one leaf."""
    folder = _local_shared(s)
    wanted = table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tile_id")).distinct()
    answers = lambda part: part.withColumn("content", F.concat_ws(":", F.shiftright("tile_id", 1).cast("string"), F.lit("t")))
    rows = max(1, wanted.count() // 5)
    ST.bake_on(wanted, answers, F.col("content"), f"{folder}/work", "r1", rows, most=2)
    parts, left = ST.bake_on(wanted, answers, F.col("content"), f"{folder}/work", "r1", rows)
    if left:
        raise RuntimeError("ranges are left")
    ST.bake_parts(parts, f"{folder}/all.pmtiles", {"max_zoom": 20}, {"name": "all"})
    entries = Z.scan(s, folder)
    return Z.read_tiles(entries, folder).select("tile_id", F.col("run_length").cast("long").alias("run_length"), F.col("content").cast("string").alias("content"))


def archive_entries(s, d):
    """An archive for each source, of every line's order as a tile, scanned together in two stages."""
    folder = _local_shared(s)
    lines = table(s, d, "lineitem").select((F.col("l_suppkey") % 3).alias("source_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tile_id")).distinct()
    for k in range(3):
        Z.write_archive(lines.filter(F.col("source_idx") == k).select("tile_id", F.shiftright("tile_id", 2).cast("string").alias("content")), f"{folder}/s{k}.pmtiles")
    return Z.scan_folder(s, folder).select("archive", "tile_id", F.col("run_length").cast("long").alias("run_length"))


def archive_headers(s, d):
    """Header and metadata of an archive of all documents, as the sink writes and the source reads them."""
    folder = f"{shared_dir(s).removeprefix('file://').removeprefix('file:')}/headers-{uuid.uuid4().hex}"
    os.makedirs(folder)
    Z.write_archive(tile_payloads(s, d), f"{folder}/docs.pmtiles", {"tile_type": 1, "max_zoom": 11, "west": -1234000000}, {"name": "docs"})
    return Z.scan(s, folder, "headers").select("archive", "format", "max_zoom", "west", "addressed", "contents", "clustered", F.get_json_object("metadata", "$.name").alias("name"))


def bake_remaining(s, d):
    t = O.coverage_union(archive_tiles(s, d))
    done = table(s, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "r1").otherwise("r0").alias("revision"), (F.col("n_nationkey") * 1000).cast("long").alias("first_id"), (F.col("n_nationkey") * 1000 + 700).cast("long").alias("last_id"))
    return ST.to_bake(t, done, "r1")


def contributor_report(s, d):
    reads = archive_tiles(s, d).select("tile_id", "source_idx", F.concat(F.lit("s"), F.col("source_idx").cast("string")).alias("name"), F.when((F.col("tile_id") + F.col("source_idx")) % 11 == 0, "error").otherwise("ok").alias("outcome"), (F.col("source_idx") == 0).alias("required"))
    return ST.source_rule(reads)


def piece_digests(s, d):
    return K.piece_digests(table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content")), 1024)


def piece_ranges(s, d):
    r = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100).alias("begin"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("long") * 50).alias("stop"))
    return K.pieces_of_ranges(r, 1024).groupBy("piece").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("last_piece") - F.col("first_piece")).alias("spread"))


def piece_verify(s, d):
    docs = table(s, d, "documents")
    a = K.piece_digests(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("content")), 1024)
    b = K.piece_digests(docs.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")), 1024)
    return K.verified(b, a).withColumn("share", F.round("share", 6))


def piece_sample_verify(s, d):
    """Texts as files of which a third have another beginning; a fifth of the pieces are in dispute."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text")).cast("binary").alias("file"))
    size = F.octet_length("text")
    digests = K.piece_digests(docs.select("key", F.col("text").alias("content")), 1024)
    expected = digests.join(docs.select("key", size.alias("size")), "key").select("key", "piece", "sha1", F.least(F.lit(1024), F.col("size") - F.col("piece") * 1024).alias("length"))
    wanted = K.sampled_pieces(expected, digests.select("key", "piece", ((F.col("key") + F.col("piece")) % 5 != 0).alias("held")))
    read = wanted.select("key", "piece", "length").join(docs.select("key", "file"), "key").select("key", "piece", F.substring(F.col("file"), F.col("piece") * 1024 + 1, F.col("length")).alias("data"))
    return K.sample_verified(wanted, read)


def shared_entries(s, d):
    return A.sharing_entries(table(s, d, "documents").select(F.md5("text").alias("path"), F.col("doc_id").alias("info_hash")))


def domain_sample(s, d):
    """Seeded tiles of what all orders' archives share: as many as there are customers."""
    n = table(s, d, "customer").count()
    return O.sample_domain(shared_domain(s, d), n).select("i", "z", "x", "y")


def piece_buckets(s, d):
    return K.piece_buckets(piece_availability(s, d), 5)


def distributed_copies(s, d):
    return K.distributed_copies(piece_availability(s, d)).withColumn("copies", F.round("copies", 6))


def lru_plan(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 5).alias("cache"), F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("used"), F.floor(F.col("value") * 1000 + 0.5).alias("size"))
    return A.budget_plan(e, 10_000_000).select("cache", "key", "running", "kept")


def shared_files(s, d):
    return A.shared_files(table(s, d, "documents").select(F.md5("text").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("info_hash")))


def import_paths(s, d):
    return A.import_paths(table(s, d, "documents").select("source", (F.col("n_chars") % 4 == 0).alias("trouble")), "src0", 1.1).withColumn("rate", F.round("rate", 6))


def log_rules(s, d):
    lines = table(s, d, "events").select(F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))
    return A.classified_log(lines, {"errors": "^error", "bought": "purchase", "sevens": "7$"})


def watched_rules(s, d):
    ending = F.when(F.col("doc_id") % 3 == 0, ".mbtiles").otherwise(".pmtiles")
    files = table(s, d, "documents").select("doc_id", F.concat(F.lit("/watch/"), "source", F.lit("/"), "lang", F.lit("-"), F.col("doc_id").cast("string"), ending).alias("path"))
    return A.matched_rules(files, [("english", "en-*.pmtiles"), ("early", "??-??.*"), ("boxes", "*.mbtiles")]).select("doc_id", "rule")


def _snapshots(s, d, users="true"):
    e = table(s, d, "events").filter(users)
    return e.groupBy((F.col("user_id") % 20).alias("info_hash"), F.hour(F.col("ts").cast("timestamp")).alias("cycle")).agg(F.when(F.first(F.col("user_id") % 20) == 5, F.lit(0)).otherwise(F.max("event_id")).alias("mtime"))


def save_cycles(s, d):
    return A.save_cycles(_snapshots(s, d))[0]


def never_saved(s, d):
    return A.save_cycles(_snapshots(s, d))[1]


def save_cycles_all(s, d):
    return A.save_cycles(_snapshots(s, d, "true"))[0]


def never_saved_all(s, d):
    return A.save_cycles(_snapshots(s, d, "true"))[1]


def disk_use(s, d):
    """Files named like their archive, like its beginning, or by its key within; keys are digests, and names may begin alike."""
    k, n = F.col("doc_id"), F.floor(F.col("doc_id") / 4).cast("string")
    key = F.sha1(F.concat(F.lit("k"), n))
    name = F.get(F.array(F.concat(F.lit("order-"), n), F.concat(F.lit("order-"), n, F.lit(".part")), F.concat(F.lit("x-"), key, F.lit("-y.bin")), F.concat(F.lit("other-"), n)), (k % 4).cast("int"))
    files = table(s, d, "documents").select(F.concat(F.lit("/"), (k % 3 % 2).cast("string")).alias("folder"), name.alias("name"), F.col("n_chars").alias("size"))
    c = catalog(s, d)
    entries = c.select(F.sha1(F.concat(F.lit("k"), F.col("info_hash").cast("string"))).alias("info_hash"), "name", F.concat(F.lit("/"), (F.col("info_hash") % 2).cast("string")).alias("folder"))
    return A.disk_use(files, entries)


def orphan_files(s, d):
    return A.orphans(table(s, d, "documents").select(F.col("doc_id").alias("info_hash")), catalog(s, d))


#: Links that listings hold besides their own: signed, of a foreign host, above the listing, folded, of another scheme, and a bucket's key.
LINKS = "<a href='sub/x.pmtiles?sig=a%2Bb&amp;e=1#f'>x</a><a class=k href=\"//foreign.example/x\">f</a><a href='../../up'>u</a><a href='./a/../b.pmtiles'>b</a><a href='mailto:x@example.org'>m</a><Key>bucket/y.mbtiles</Key><a href='p"


def listing_links(s, d):
    return X.parse_listing(_listing(s, d)).select("index_url", "link", "pos")


def _listing(s, d):
    links = F.concat(F.lit(LINKS.replace("{n}", "0")), F.col("page_id").cast("string"), F.lit("'>z</a>"))
    return table(s, d, "pages").select("page_id", F.col("url").alias("index_url"), F.concat("html", links).alias("body")).withColumn("index_url", F.regexp_replace("index_url", r"/(fr|en|de|es)/[^/?#]*.*$", "/"))


def listing_newest(s, d):
    from ..operators.catalog import listing_selection

    links = X.parse_listing(_listing(s, d)).select(F.col("index_url").alias("source"), "link").distinct()
    return listing_selection(links, "[a-zñéèêçóíäöüß]$", 3)


def link_reachability(s, d):
    p = table(s, d, "pages").select("page_id", "url")
    host = F.element_at(F.array(*(F.lit(h) for h in ("localhost", "10.1.2.3", "intranet", "user:pw@files.example.org", "[::1]", "tiles.local"))), (F.col("page_id") % 6 + 1).cast("int"))
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("http://"), host, F.lit("/a?X-Amz-Signature=1&b=2")))
    return p.select("page_id", P.reachability(url).alias("reach"), P.carries_credentials(url).alias("credentials"))


def parsed_feed(s, d):
    """Items with a torrent by its type, by its ending or as the link, with a magnet of its own or as the link, and with an image alone, which are left out."""
    docs = table(s, d, "documents").select("source", "doc_id", "lang")
    k = F.col("doc_id").cast("string")
    link = F.get(F.array(
        F.concat(F.lit('<enclosure type="application/x-bittorrent" url="http://h/t?a=1&amp;b='), k, F.lit('"/>')), F.concat(F.lit('<enclosure url="http://h/'), k, F.lit('.torrent?s=1" type="x"/><link>http://h/page</link>')),
        F.concat(F.lit('<enclosure url="http://h/i.png" type="image/png"/><link>http://h/'), k, F.lit("/file</link>")), F.concat(F.lit('<enclosure url="http://h/i.png" type="image/png"/><pmtiles:magnet>magnet:?xt=urn:btih:'), F.sha1(k), F.lit("</pmtiles:magnet>")),
        F.concat(F.lit("<link>magnet:?xt=urn:btih:"), F.sha1(k), F.lit("&amp;dn=x</link>")), F.lit('<enclosure url="http://h/i.png" type="image/png"/><link>http://h/page</link>'),
    ), (F.col("doc_id") % 6).cast("int"))
    more = F.concat(F.lit("<pmtiles:infohash>"), F.upper(F.sha1(k)), F.lit("</pmtiles:infohash><pmtiles:mtime>2024-03-05T06:07:08Z</pmtiles:mtime><pmtiles:format>mvt</pmtiles:format><pmtiles:bounds>-1, 2,3,4.5</pmtiles:bounds><pmtiles:maxzoom>9</pmtiles:maxzoom>"))
    item = F.concat(F.lit("<item><title>A &amp; B "), k, F.lit("</title>"), link, more, F.lit("<category>"), "lang", F.lit("</category><category> </category><category>x</category></item>"))
    feeds = docs.withColumn("item", item).withColumn("feed", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100).cast("string"))).groupBy("feed").agg(F.array_join(F.array_sort(F.collect_list("item")), "\n").alias("body"))
    parsed = X.parse_feed(feeds)
    return parsed.select("feed", "title", "torrent_url", "magnet", "info_hash", F.unix_timestamp("mtime").alias("mtime"), F.col("summary.max_zoom").alias("max_zoom"), F.element_at("summary.bounds", 4).alias("north"), F.array_join("categories", "|").alias("categories"))


def counter_maps(s, d):
    from ..operators import requests as R

    r = tile_requests(s, d)
    m = R.counters(R.by_status(r), "status")
    return m.select("info_hash", F.to_json("by_status").alias("by_status"))


QUERIES = (coverage_union, coverage_overlap, coverage_union_runs, coverage_overlap_runs, warm_report_runs, coverage_by_zoom, tile_places, priority_tiles, parent_fallback, child_assembly, tiles_in_bounds, tiles_in_bounds_runs, tile_counts, warm_report, shared_domain, box_sides, tile_dedup, tile_runs, content_counts, tile_offsets, clustered_check, passthrough_split, bake_report, bake_archive, bake_resumed, archive_entries, archive_headers, bake_remaining, contributor_report, piece_digests, piece_ranges, piece_verify, piece_sample_verify, shared_entries, domain_sample, piece_buckets, distributed_copies, lru_plan, shared_files, import_paths, log_rules, watched_rules, save_cycles, never_saved, save_cycles_all, never_saved_all, disk_use, orphan_files, listing_links, listing_newest, link_reachability, parsed_feed, counter_maps)

AT, ZOOMED = with_views("archive_tiles"), with_views("archive_tiles", "zoomed")
_BOX = "boxes AS (SELECT o_orderkey AS box, (o_orderkey % 1009) * 0.3::DOUBLE - 170 AS west, (o_orderkey % 1009) * 0.13::DOUBLE - 70 AS south, (o_orderkey % 1009) * 0.3::DOUBLE - 170 + 1 + o_orderkey % 1009 % 7 * 4 AS east, (o_orderkey % 1009) * 0.13::DOUBLE - 70 + 1 + o_orderkey % 1009 % 5 * 3 AS north FROM orders)"
_WX, _WY = lambda c: f"(({c}) + 180) / 360", lambda c: f"(1 - ln(tan(radians(greatest(-85.0511287798066, least(85.0511287798066, {c})))) + 1 / cos(radians(greatest(-85.0511287798066, least(85.0511287798066, {c}))))) / pi()) / 2"
_TILE = lambda f: f"CAST(greatest(0, least(pow(2, z) - 1, floor(({f}) * pow(2, z)))) AS BIGINT)"
_RANGE = lambda top: f"{_BOX}, r AS (SELECT box, z, {_TILE(_WX('west'))} AS x0, {_TILE(_WX('east'))} AS x1, {_TILE(_WY('north'))} AS y0, {_TILE(_WY('south'))} AS y1 FROM boxes, range({top}) q(z))"
#: Hilbert places by walking the levels, as a recursive query.
_ZXY = """walk AS (SELECT tile_id, z, 0 AS k, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, tile_id - CAST((pow(4, z) - 1) / 3 AS BIGINT) AS t FROM (SELECT DISTINCT tile_id, z FROM zoomed)
  UNION ALL SELECT tile_id, z, k + 1, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - y ELSE y END) ELSE x END + s * rx, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - x ELSE x END) ELSE y END + s * ry, t >> 2
  FROM (SELECT *, CAST(pow(2, k) AS BIGINT) AS s, (t >> 1) & 1 AS rx, xor(t, (t >> 1) & 1) & 1 AS ry FROM walk WHERE k < z)),
places AS (SELECT tile_id, z, x, y FROM walk WHERE k = z)"""
_ZR = ZOOMED.replace("WITH", "WITH RECURSIVE", 1)
_CELLS = "p AS (SELECT l_suppkey AS archive, CAST(l_linenumber - 1 AS BIGINT) AS piece, count(*) AS copies FROM lineitem GROUP BY 1, 2)"
def _sample_sql() -> str:
    u = lambda k: f"('0x' || substr(md5('1:{k}:' || i), 1, 7))::BIGINT / pow(2, 28)"
    at = lambda f: f"CAST(greatest(0, least(pow(2, z) - 1, floor({f} * pow(2, z)))) AS BIGINT)"
    return f"""WITH {_BOX}, dom AS (SELECT max(box % 4) AS low, min(box % 3 + 5) AS high, round(max(west / 100 - 5), 6) AS w, round(max(south / 100 - 5), 6) AS s, round(min(east / 100 + 10), 6) AS e, round(min(north / 100 + 5), 6) AS n FROM boxes),
p AS (SELECT CAST(i AS INT) AS i, CAST(low + floor(sqrt({u(0)}) * (high - low + 1)) AS INT) AS z, w + {u(1)} * (e - w) AS lon, s + {u(2)} * (n - s) AS lat FROM dom, (SELECT unnest(range((SELECT count(*) FROM customer))) AS i))
SELECT i, z, {at(_WX("lon"))} AS x, {at(_WY("lat"))} AS y FROM p"""


_PIECES = "pieces AS (SELECT doc_id AS key, unnest(range(greatest(1, CAST(ceil(octet_length(encode(text)) / 1024) AS BIGINT)))) AS piece, encode(text) AS b FROM documents)"
_SNAP = "snap AS (SELECT user_id % 20 AS info_hash, hour(ts) AS cycle, CASE WHEN user_id % 20 = 5 THEN 0 ELSE max(event_id) END AS mtime FROM events GROUP BY 1, 2), marked AS (SELECT *, coalesce(mtime <> lag(mtime) OVER (PARTITION BY info_hash ORDER BY cycle), false) AS new FROM snap)"

ORACLE = {
    "coverage_union": f"{AT} SELECT DISTINCT tile_id FROM archive_tiles",
    "coverage_union_runs": f"{AT}, t AS (SELECT DISTINCT tile_id FROM archive_tiles), g AS (SELECT tile_id, tile_id - row_number() OVER (ORDER BY tile_id) AS g FROM t) SELECT min(tile_id) AS tile_id, count(*) AS run_length FROM g GROUP BY g",
    "coverage_overlap_runs": f"{AT}, t AS (SELECT tile_id, CASE WHEN tile_id IN (SELECT tile_id FROM archive_tiles WHERE source_idx = 1) THEN 'both' ELSE 'first' END AS held_by FROM archive_tiles WHERE source_idx = 0), g AS (SELECT *, tile_id - row_number() OVER (PARTITION BY held_by ORDER BY tile_id) AS g FROM t) SELECT min(tile_id) AS tile_id, count(*) AS run_length, held_by FROM g GROUP BY held_by, g",
    "warm_report_runs": f"""{AT}, r AS (SELECT tile_id, tile_id - row_number() OVER (ORDER BY tile_id) AS g FROM archive_tiles WHERE source_idx = 1), b AS (SELECT DISTINCT min(tile_id) // 100 AS b FROM r GROUP BY g),
w AS (SELECT tile_id FROM r UNION SELECT b * 100 + i FROM b, range(40) q(i)), p AS (SELECT tile_id, {"".join(f"CASE WHEN tile_id < {(4 ** (k + 1) - 1) // 3} THEN {k} ELSE " for k in range(16))}NULL{" END" * 16} AS z FROM w)
SELECT z, count(*) AS total, count(*) FILTER (WHERE tile_id IN (SELECT tile_id FROM archive_tiles WHERE source_idx = 0)) AS hits, count(*) FILTER (WHERE tile_id NOT IN (SELECT tile_id FROM archive_tiles WHERE source_idx = 0)) AS misses FROM p GROUP BY z""",
    "coverage_overlap": f"{AT} SELECT tile_id, CASE WHEN tile_id IN (SELECT tile_id FROM archive_tiles WHERE source_idx = 1) THEN 'both' ELSE 'first' END AS held_by FROM archive_tiles WHERE source_idx = 0",
    "coverage_by_zoom": f"{ZOOMED} SELECT source_idx, z, count(*) AS tiles FROM zoomed GROUP BY ALL",
    "tile_places": f"{_ZR}, {_ZXY} SELECT tile_id, z, x, y, tile_id AS back FROM places",
    "priority_tiles": "WITH t AS (SELECT l_suppkey % 4 AS source_idx, l_orderkey AS tile_id, max(l_extendedprice) AS payload FROM lineitem GROUP BY 1, 2) SELECT tile_id, max(source_idx) AS source_idx, arg_max(payload, source_idx) AS payload, count(*) AS held FROM t GROUP BY tile_id",
    "parent_fallback": f"""{_ZR}, {_ZXY}, up AS (SELECT w.z, w.x, w.y, d, z - d AS pz, x >> d AS px, y >> d AS py FROM places w, range(7) r(d) WHERE w.tile_id % 3 = 0 AND d <= z)
SELECT u.z, u.x, u.y, arg_max(h.tile_id, pz) AS from_id, max(pz) AS from_z, arg_max(u.x % (1 << d), pz) AS sub_x, arg_max(u.y % (1 << d), pz) AS sub_y FROM up u JOIN places h ON h.z = pz AND h.x = px AND h.y = py AND h.tile_id % 3 <> 0 GROUP BY u.z, u.x, u.y""",
    "child_assembly": f"{_ZR}, {_ZXY} SELECT w.tile_id AS parent, count(*) AS children FROM places w JOIN places c ON c.z = w.z + 1 AND c.x >> 1 = w.x AND c.y >> 1 = w.y GROUP BY 1 HAVING count(*) = 4",
    "tiles_in_bounds_runs": f"""WITH RECURSIVE {_RANGE(8)}, w AS (SELECT DISTINCT z, unnest(xs) AS x, y FROM (SELECT z, range(x0, x1 + 1) AS xs, unnest(range(y0, y1 + 1)) AS y FROM r)),
c AS (SELECT CAST(z AS BIGINT) AS z, x, y, CAST(z AS BIGINT) - 1 AS k, CAST(0 AS BIGINT) AS d FROM w UNION ALL SELECT z, CASE WHEN ry = 1 THEN lx WHEN rx = 1 THEN s - 1 - ly ELSE ly END, CASE WHEN ry = 1 THEN ly WHEN rx = 1 THEN s - 1 - lx ELSE lx END, k - 1, d + s * s * xor(3 * rx, ry)
  FROM (SELECT *, CAST(1 AS BIGINT) << k AS s, (x >> k) & 1 AS rx, (y >> k) & 1 AS ry, x & ((CAST(1 AS BIGINT) << k) - 1) AS lx, y & ((CAST(1 AS BIGINT) << k) - 1) AS ly FROM c WHERE k >= 0)),
t AS (SELECT d + CAST((pow(4, z) - 1) / 3 AS BIGINT) AS tile_id FROM c WHERE k = -1), g AS (SELECT tile_id, tile_id - row_number() OVER (ORDER BY tile_id) AS g FROM t) SELECT min(tile_id) AS tile_id, count(*) AS run_length FROM g GROUP BY g""",
    "tiles_in_bounds": f"WITH {_RANGE(5)} SELECT box, CAST(z AS INT) AS z, unnest(xs) AS x, y FROM (SELECT box, z, range(x0, x1 + 1) AS xs, unnest(range(y0, y1 + 1)) AS y FROM r)",
    "tile_counts": f"WITH {_RANGE(11)} SELECT box, CAST(least(500, sum(greatest(0, x1 - x0 + 1) * greatest(0, y1 - y0 + 1))) AS BIGINT) AS tiles FROM r GROUP BY box",
    "warm_report": f"""{_ZR}, {_ZXY}, {_RANGE(7)}, w AS (SELECT DISTINCT z, unnest(xs) AS x, y FROM (SELECT z, range(x0, x1 + 1) AS xs, unnest(range(y0, y1 + 1)) AS y FROM r))
SELECT CAST(w.z AS INT) AS z, count(*) AS total, count(p.tile_id) AS hits, count(*) - count(p.tile_id) AS misses FROM w LEFT JOIN places p ON p.z = w.z AND p.x = w.x AND p.y = w.y GROUP BY w.z""",
    "shared_domain": f"WITH {_BOX} SELECT max(box % 4) AS min_zoom, min(box % 3 + 5) AS max_zoom, round(max(west / 100 - 5), 6) AS west, round(max(south / 100 - 5), 6) AS south, round(min(east / 100 + 10), 6) AS east, round(min(north / 100 + 5), 6) AS north FROM boxes",
    "box_sides": f"""WITH {_BOX}, c AS (SELECT box, seg, CASE WHEN seg IN (0, 3) THEN west ELSE east END AS a, CASE WHEN seg IN (0, 1) THEN north ELSE south END AS b, CASE WHEN seg IN (2, 3) THEN west ELSE east END AS e, CASE WHEN seg IN (0, 3) THEN north ELSE south END AS f FROM boxes, range(4) r(seg))
SELECT box, CAST(seg AS INT) AS seg, CAST(round({_WX('a')}, 6) AS DOUBLE) AS ax, round({_WY('b')}, 6) AS ay, CAST(round({_WX('e')}, 6) AS DOUBLE) AS bx, round({_WY('f')}, 6) AS by FROM c""",
    "tile_dedup": "SELECT sha256(text) AS digest, min(doc_id) AS tile_id, CAST(max(octet_length(encode(text))) AS BIGINT) AS length, count(*) AS tiles FROM documents GROUP BY text",
    "tile_runs": "SELECT sha256(lang) AS digest, min(doc_id) AS tile_id, count(*) AS run_length FROM (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS g FROM documents) GROUP BY lang, g",
    "content_counts": "WITH r AS (SELECT lang, count(*) AS n FROM (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS g FROM documents) GROUP BY lang, g) SELECT CAST(sum(n) AS BIGINT) AS addressed, count(*) AS entries, count(DISTINCT lang) AS contents FROM r",
    "tile_offsets": "WITH c AS (SELECT min(doc_id) AS tile_id, CAST(max(octet_length(encode(text))) AS BIGINT) AS length FROM documents GROUP BY text) SELECT tile_id, length, CAST(coalesce(sum(length) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c",
    "clustered_check": """WITH e AS (SELECT l_suppkey % 4 AS archive, l_orderkey AS tile_id, min(l_orderkey * 8 + CASE WHEN l_suppkey % 4 = 1 THEN 0 ELSE l_linenumber END) AS seq FROM lineitem GROUP BY 1, 2),
a AS (SELECT archive, tile_id, CASE WHEN archive = 2 THEN -seq WHEN archive = 3 AND tile_id % 1000 = 7 THEN seq + 64 ELSE seq END AS seq FROM e), b AS (SELECT *, lag(tile_id) OVER (PARTITION BY archive ORDER BY seq) AS p FROM a)
SELECT archive, count(*) FILTER (WHERE tile_id <= p) = 0 AS clustered, count(*) AS entries FROM b GROUP BY archive""",
    "passthrough_split": f"{AT} SELECT tile_id, count(*) AS sources, max(source_idx) AS source_idx, count(*) = 1 AND tile_id % 5 <> 0 AS copied FROM archive_tiles GROUP BY tile_id",
    "bake_report": f"{AT} SELECT count(DISTINCT tile_id) FILTER (WHERE source_idx = 0) AS written, count(DISTINCT tile_id) - count(DISTINCT tile_id) FILTER (WHERE source_idx = 0) AS skipped, count(*) FILTER (WHERE source_idx = 0) = 0 AS failed FROM archive_tiles",
    "bake_archive": """WITH l AS (SELECT doc_id // 2 AS tile_id, arg_max(CASE WHEN doc_id // 2 % 3 = 0 THEN text ELSE lang END, doc_id % 2) AS content FROM documents GROUP BY 1), g AS (SELECT *, tile_id - row_number() OVER (PARTITION BY content ORDER BY tile_id) AS g FROM l)
SELECT tile_id, sha256(content) AS digest, count(*) OVER (PARTITION BY content, g) AS run_length FROM g""",
    "archive_headers": "SELECT 'docs.pmtiles' AS archive, 'mvt' AS format, 11 AS max_zoom, -123.4::DOUBLE AS west, count(*) AS addressed, count(DISTINCT text) AS contents, true AS clustered, 'docs' AS name FROM documents",
    "bake_resumed": """WITH t AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS tile_id FROM lineitem), g AS (SELECT tile_id, (tile_id >> 1) || ':t' AS content, tile_id - row_number() OVER (PARTITION BY tile_id >> 1 ORDER BY tile_id) AS g FROM t)
SELECT min(tile_id) AS tile_id, count(*) AS run_length, content FROM g GROUP BY content, g""",
    "archive_entries": """WITH t AS (SELECT DISTINCT l_suppkey % 3 AS k, l_orderkey * 8 + l_linenumber AS tile_id FROM lineitem), g AS (SELECT k, tile_id, tile_id >> 2 AS c, tile_id - row_number() OVER (PARTITION BY k, tile_id >> 2 ORDER BY tile_id) AS g FROM t)
SELECT 's' || k || '.pmtiles' AS archive, min(tile_id) AS tile_id, count(*) AS run_length FROM g GROUP BY k, c, g""",
    "bake_remaining": f"{AT} SELECT DISTINCT tile_id FROM archive_tiles WHERE NOT (tile_id // 1000 < 25 AND tile_id // 1000 % 2 = 0 AND tile_id % 1000 <= 700)",
    "contributor_report": f"{AT}, r AS (SELECT *, CASE WHEN (tile_id + source_idx) % 11 = 0 THEN 'error' ELSE 'ok' END AS o FROM archive_tiles) SELECT tile_id, bool_or(o = 'error' AND source_idx = 0) AS failed, count(*) FILTER (WHERE o = 'ok') AS sources, string_agg('s' || source_idx || '=' || o, ',' ORDER BY source_idx) AS contributors FROM r GROUP BY tile_id",
    "piece_digests": f"WITH {_PIECES} SELECT key, md5(b) AS file_md5, CAST(piece AS INT) AS piece, sha1(b[piece * 1024 + 1:piece * 1024 + 1024]) AS sha1 FROM pieces",
    "piece_ranges": "WITH r AS (SELECT l_partkey * 100 AS a, l_partkey * 100 + CAST(l_quantity AS BIGINT) * 50 AS b FROM lineitem), s AS (SELECT a // 1024 AS f, (b - 1) // 1024 AS l FROM r) SELECT unnest(range(f, l + 1)) AS piece, count(*) AS ranges, CAST(sum(l - f) AS BIGINT) AS spread FROM s GROUP BY 1",
    "domain_sample": _sample_sql(),
    "piece_sample_verify": f"""WITH {_PIECES}, e AS (SELECT p.key, p.piece, sha1(b[p.piece * 1024 + 1:p.piece * 1024 + 1024]) AS sha1, least(1024, octet_length(b) - p.piece * 1024) AS len, (p.key + p.piece) % 5 = 0 AS disputed, max(p.piece) OVER (PARTITION BY p.key) + 1 AS n, encode(CASE WHEN p.key % 3 = 0 THEN '#' || substr(text, 2) ELSE text END) AS f FROM pieces p JOIN documents ON doc_id = p.key),
o AS (SELECT *, CASE WHEN disputed AND row_number() OVER (PARTITION BY key, disputed ORDER BY piece) <= 3 THEN piece WHEN piece = 0 THEN 1000001 WHEN piece = n // 2 THEN 1000002 WHEN piece = n - 1 THEN 1000003 END AS nth FROM e),
t AS (SELECT *, f[piece * 1024 + 1:piece * 1024 + len] AS got FROM o WHERE nth IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY nth) <= 3)
SELECT key, count(*) FILTER (WHERE octet_length(got) >= len) AS checked, count(*) FILTER (WHERE octet_length(got) >= len AND sha1(got) = sha1) AS passed FROM t GROUP BY key""",
    "shared_entries": "SELECT md5(text) AS path, doc_id AS info_hash, count(*) OVER (PARTITION BY text) AS entries FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1",
    "piece_verify": f"WITH {_PIECES}, n AS (SELECT key, piece, max(piece) OVER (PARTITION BY key) AS last FROM pieces) SELECT key, count(*) AS pieces, CASE WHEN key % 3 = 0 AND octet_length(encode(any_value(text))) % 1024 > 0 OR key % 3 = 0 AND octet_length(encode(any_value(text))) = 0 THEN round((count(*) - 1) / count(*), 6) ELSE 1.0 END AS share, CASE WHEN key % 3 = 0 AND (octet_length(encode(any_value(text))) % 1024 > 0 OR octet_length(encode(any_value(text))) = 0) THEN CAST(max(piece) AS INT) END AS first_bad FROM n JOIN documents ON doc_id = key GROUP BY key",
    "piece_buckets": f"""WITH {_CELLS}, n AS (SELECT archive, max(piece) + 1 AS n FROM p GROUP BY 1), s AS (SELECT archive, b AS bucket, b * n // 5 AS lo, greatest(b * n // 5 + 1, (b + 1) * n // 5) AS hi FROM n, range(5) r(b)),
x AS (SELECT s.archive, bucket, coalesce(copies, 0) AS c FROM s JOIN range(100) q(i) ON i >= lo AND i < hi LEFT JOIN p ON p.archive = s.archive AND p.piece = i) SELECT archive, CAST(bucket AS INT) AS bucket, bool_and(c > 0) AS all_held, bool_or(c > 0) AS any_held, CAST(least(255, min(c)) AS BIGINT) AS least FROM x GROUP BY 1, 2""",
    "distributed_copies": f"WITH {_CELLS}, m AS (SELECT *, min(copies) OVER (PARTITION BY archive) AS mn FROM p) SELECT archive, round(min(mn) + avg(CASE WHEN copies > mn THEN 1.0 ELSE 0.0 END), 6) AS copies FROM m GROUP BY archive",
    "lru_plan": "WITH e AS (SELECT user_id % 5 AS cache, event_id AS key, CAST(sum(floor(value * 1000 + 0.5)) OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events) SELECT *, running <= 10000000 AS kept FROM e",
    "shared_files": "SELECT md5(text) AS path, count(*) AS entries, CAST((count(*) - 1) * max(n_chars) AS BIGINT) AS bytes_again, min(doc_id) AS first_entry FROM documents GROUP BY text HAVING count(*) > 1",
    "import_paths": "WITH r AS (SELECT source, count(*) AS entries, count(*) FILTER (WHERE n_chars % 4 = 0) AS troubled, count(*) FILTER (WHERE n_chars % 4 = 0) / count(*) AS rate FROM documents GROUP BY source) SELECT source, entries, troubled, round(rate, 6) AS rate, rate > 1.1 * (SELECT rate FROM r WHERE source = 'src0') AS suspect FROM r",
    "log_rules": """WITH l AS (SELECT event_id AS seq, event_type || ' ' || user_id AS line FROM events), h AS (SELECT seq, 'errors' AS rule FROM l WHERE line LIKE 'error%' UNION ALL SELECT seq, 'bought' FROM l WHERE line LIKE '%purchase%' UNION ALL SELECT seq, 'sevens' FROM l WHERE line LIKE '%7'),
k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY seq DESC) AS n FROM h) SELECT rule, count(*) AS hits, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (WHERE n <= 3) AS last_seqs, string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE n <= 3) AS last_lines FROM k JOIN l USING (seq) GROUP BY rule""",
    "watched_rules": "WITH f AS (SELECT doc_id, lang || '-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.mbtiles' ELSE '.pmtiles' END AS base FROM documents WHERE source IS NOT NULL) SELECT doc_id, CASE WHEN base GLOB 'en-*.pmtiles' THEN 'english' WHEN base GLOB '??-??.*' THEN 'early' WHEN base GLOB '*.mbtiles' THEN 'boxes' END AS rule FROM f WHERE rule IS NOT NULL",
    "save_cycles": f"WITH {_SNAP} SELECT CAST(cycle AS INT) AS cycle, count(DISTINCT info_hash) AS written, count(DISTINCT info_hash) = (SELECT count(DISTINCT info_hash) FROM snap) AS full FROM marked WHERE new GROUP BY cycle",
    "never_saved": f"WITH {_SNAP} SELECT DISTINCT info_hash FROM snap WHERE info_hash NOT IN (SELECT info_hash FROM marked WHERE new)",
    "disk_use": f"""{with_views('catalog')}, e AS (SELECT sha1('k' || info_hash) AS info_hash, name, '/' || (info_hash % 2) AS folder FROM catalog),
f AS (SELECT doc_id, '/' || (doc_id % 3 % 2) AS folder, n_chars AS size, CASE doc_id % 4 WHEN 0 THEN 'order-' || (doc_id // 4) WHEN 1 THEN 'order-' || (doc_id // 4) || '.part' WHEN 2 THEN 'x-' || sha1('k' || (doc_id // 4)) || '-y.bin' ELSE 'other-' || (doc_id // 4) END AS name FROM documents),
hit AS (SELECT e.info_hash, doc_id, size FROM f JOIN e ON f.folder = e.folder AND f.name[1:length(e.name)] = e.name UNION SELECT e.info_hash, doc_id, size FROM f JOIN e ON f.folder = e.folder AND f.name[3:42] = e.info_hash)
SELECT e.info_hash, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(doc_id) AS files FROM e LEFT JOIN hit USING (info_hash) GROUP BY e.info_hash""",
    "orphan_files": f"{with_views('catalog')} SELECT coalesce(info_hash, doc_id) AS info_hash, CASE WHEN info_hash IS NULL THEN 'orphan' ELSE 'missing' END AS state FROM catalog FULL JOIN documents ON doc_id = info_hash WHERE info_hash IS NULL OR doc_id IS NULL",
    "link_reachability": """WITH p AS (SELECT page_id, page_id % 2 = 1 AS odd, page_id % 6 AS k FROM pages) SELECT page_id, CASE WHEN NOT odd THEN 'ok' WHEN k IN (0) THEN 'bad' WHEN k = 1 THEN 'warn' WHEN k = 3 THEN 'ok' WHEN k = 5 THEN 'warn' END AS reach, odd AS credentials FROM p""",
    "parsed_feed": """SELECT source || '-' || (doc_id // 100) AS feed, 'A & B ' || doc_id AS title, CASE doc_id % 6 WHEN 0 THEN 'http://h/t?a=1&b=' || doc_id WHEN 1 THEN 'http://h/' || doc_id || '.torrent?s=1' WHEN 2 THEN 'http://h/' || doc_id || '/file' END AS torrent_url,
CASE doc_id % 6 WHEN 3 THEN 'magnet:?xt=urn:btih:' || sha1(CAST(doc_id AS VARCHAR)) WHEN 4 THEN 'magnet:?xt=urn:btih:' || sha1(CAST(doc_id AS VARCHAR)) || '&dn=x' END AS magnet, sha1(CAST(doc_id AS VARCHAR)) AS info_hash,
CAST(epoch(TIMESTAMP '2024-03-05 06:07:08') AS BIGINT) AS mtime, 9.0::DOUBLE AS max_zoom, 4.5::DOUBLE AS north, lang || '|x' AS categories FROM documents WHERE doc_id % 6 <> 5""",
    "listing_links": r"""WITH l AS (SELECT DISTINCT regexp_replace(url, '/(fr|en|de|es)/[^/?#]*.*$', '/') AS index_url, html || ' """ + LINKS.replace("'", "''") + r"""' || page_id || '''>z</a>' AS body FROM pages),
x AS (SELECT index_url, regexp_extract_all(body, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']+)["'']', 1) || regexp_extract_all(body, '<Key>([^<]+)</Key>', 1) AS a FROM l),
y AS (SELECT index_url, unnest(a) AS href, CAST(generate_subscripts(a, 1) - 1 AS INT) AS pos, regexp_extract(index_url, '^([a-z]+:)', 1) AS scheme, regexp_extract(index_url, '^([a-z]+://[^/]*)', 1) AS root FROM x),
z AS (SELECT index_url, pos, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN root || href ELSE index_url || href END AS raw FROM y),
f AS (SELECT index_url, pos, regexp_replace(regexp_replace(replace(raw, '/./', '/'), '/[^/.]+/\.\./', '/'), '/\.\./\.\./', '/') AS link FROM z WHERE starts_with(raw, 'http'))
SELECT index_url, link, min(pos) AS pos FROM f WHERE starts_with(link, index_url) AND link <> index_url GROUP BY 1, 2""",
    "counter_maps": f"{with_views('tile_requests')}, c AS (SELECT info_hash, status, count(*) AS n FROM tile_requests GROUP BY 1, 2) SELECT info_hash, '{{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}}' AS by_status FROM c GROUP BY info_hash",
}
ORACLE["listing_newest"] = r"""WITH links AS (""" + ORACLE["listing_links"] + r"""), k AS (SELECT index_url AS source, link, row_number() OVER (PARTITION BY index_url ORDER BY link DESC) AS rank FROM links WHERE regexp_matches(link, '[a-zñéèêçóíäöüß]$')) SELECT source, link, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3"""
# The same over all users.
for _name in ("save_cycles", "never_saved"):
    ORACLE[_name + "_all"] = ORACLE[_name].replace(" WHERE user_id % 20 < 12", "")
