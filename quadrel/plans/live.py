"""Queries that run streams over the given tables to the end of what is there, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.traffic import clean_samples
from ..sources import tables as H
from ..streaming import streams as S
from .fixtures import as_requests, as_samples, with_views


def _requests(s, d):
    return as_requests(S.read_stream(s, d, "events"))


def stream_hourly_requests(s, d):
    """Counters in update mode; a window's latest row holds."""
    out = S.drained(S.request_windows(_requests(s, d)), "update")
    last = out.groupBy("window_start", "info_hash").agg(F.max_by(F.struct("requests", "bytes"), "trigger").alias("x"))
    return last.select(F.unix_timestamp("window_start").alias("window_start"), "info_hash", "x.requests", "x.bytes")


def stream_sessions(s, d):
    """Sessions that the watermark has closed."""
    return S.drained(S.client_sessions(_requests(s, d), late="1 day")).select("ip", *(F.unix_micros(c).alias(c) for c in ("session_start", "session_end")), "requests", "bytes")


def stream_items_once(s, d):
    items = _requests(s, d).select(F.col("ip").alias("info_hash"), "at")
    return S.drained(S.new_items(items, "3650 days")).select("info_hash")


def stream_recent_percentiles(s, d):
    out = S.drained(S.recent_percentiles(_requests(s, d)), "update")
    return out.groupBy("info_hash").agg(F.max_by(F.struct("samples", "p50", "p95"), "trigger").alias("x")).select("info_hash", "x.samples", "x.p50", "x.p95")


def _samples(s, d):
    return as_samples(S.read_stream(s, d, "events")).withColumn("at", F.timestamp_seconds("at"))


def stream_traffic_archives(s, d):
    """Mean rates by archive in windows that the watermark has closed."""
    return S.drained(S.traffic_windows(_samples(s, d), late="1 day")).select(F.unix_timestamp("window_start").alias("bucket"), "info_hash", "down", "up", "samples")


def stream_traffic_node(s, d):
    """Mean rates of all archives together, an hour every half hour, in windows that the watermark has closed."""
    return S.drained(S.throughput_windows(_samples(s, d), slide="30 minutes", late="1 day")).select(F.unix_timestamp("window_start").alias("bucket"), "down", "up", "samples")


def stream_seeding_ends(s, d):
    """Clients' requests stand for status rows: complete from the first of more than 20 ms on, done at 300 ms or after 10 days, at a row or when the watermark passes them."""
    status = _requests(s, d).select(F.col("ip").alias("info_hash"), "at", (F.col("ms") > 20).cast("double").alias("progress"), F.col("ms").alias("ratio"))
    return S.drained(S.seeding_ends(status, 10 * 24 * 60, 300.0, late="1 day")).select("info_hash", "reason")


KEEP_HOURS = 240


def stream_traffic_history(s, d):
    """Samples appended to a stored history by a stream, a trigger that comes again, and the eviction of all that is older than ten days; what each archive has left."""
    history = H.History(s, f"{S.shared_dir(s)}/history-{uuid.uuid4().hex}", "info_hash long, at long, down long, up long", 86400)
    samples = as_samples(S.read_stream(s, d, "events"))
    history.sink(clean_samples(samples), f"{history.folder.path}/_stream").awaitTermination()
    rows = history.rows()
    history.append(rows.limit(100), 0)
    history.prune(rows.agg(F.max("at")).first()[0] - KEEP_HOURS * 3600)
    return history.rows().groupBy("info_hash").agg(F.count(F.lit(1)).alias("samples"), F.min("at").alias("first"), F.sum("down").alias("down"), F.sum("up").alias("up"))


def stream_settled_files(s, d):
    """Requests stand for listings of a file for each client, whose length and time change now and then: files that stood still for a day."""
    r = _requests(s, d)
    listed = r.select(F.concat(F.lit("in/"), F.col("ip").cast("string"), F.lit(".pmtiles")).alias("path"), "at", F.floor(F.col("ms") / 100).cast("long").alias("length"), F.timestamp_seconds(F.floor(F.unix_timestamp("at") / 259200) * 259200).alias("modified"))
    return S.drained(S.stood_still(listed, 86400, late="1 day")).select("path", "length")


QUERIES = (stream_settled_files, stream_traffic_history, stream_hourly_requests, stream_sessions, stream_items_once, stream_recent_percentiles, stream_traffic_archives, stream_traffic_node, stream_seeding_ends)

_T = with_views("traffic_samples")
_R = with_views("tile_requests")


def oracle(batch: dict[str, str]) -> dict[str, str]:
    """Streams give what the same work gives in batch, whose SQL is taken over."""
    return {
        "stream_settled_files": f"""{_R}, l AS (SELECT ip, epoch_us("at") AS us, CAST(floor(ms / 100) AS BIGINT) AS length, epoch_us("at") // 259200000000 AS modified FROM tile_requests),
n AS (SELECT *, coalesce(length <> lag(length) OVER w OR modified <> lag(modified) OVER w, true) AS new FROM l WINDOW w AS (PARTITION BY ip ORDER BY us, modified, length)),
g AS (SELECT ip, us AS since, length, lead(us) OVER (PARTITION BY ip ORDER BY us) AS until, (SELECT max(us) FROM n m WHERE m.ip = n.ip) AS last FROM n WHERE new),
ok AS (SELECT * FROM g WHERE coalesce(until, last) - since >= 86400000000 OR until IS NULL AND since + 86400000000 < (SELECT max(us) FROM n) - 86400000000)
SELECT 'in/' || ip || '.pmtiles' AS path, arg_min(length, since) AS length FROM ok GROUP BY ip""",
        "stream_traffic_history": f"""{_T} SELECT info_hash, count(*) AS samples, min("at") AS first, CAST(sum(down) AS BIGINT) AS down, CAST(sum(up) AS BIGINT) AS up FROM traffic_samples
WHERE "at" >= (SELECT max("at") FROM traffic_samples) - {KEEP_HOURS * 3600} GROUP BY info_hash""",
        "stream_hourly_requests": batch["tumbling_requests"],
        "stream_sessions": f"""SELECT * FROM ({batch["client_sessions"]}) WHERE session_end <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - 86400000000""",
        "stream_items_once": f"{_R} SELECT DISTINCT ip AS info_hash FROM tile_requests",
        "stream_recent_percentiles": batch["latency_recent512"],
        "stream_traffic_archives": f"""{_T} SELECT "at" - "at" % 3600 AS bucket, info_hash, CAST(floor(avg(down) + 0.5) AS BIGINT) AS down, CAST(floor(avg(up) + 0.5) AS BIGINT) AS up, count(*) AS samples
FROM traffic_samples GROUP BY 1, 2 HAVING bucket + 3600 <= (SELECT max("at") FROM traffic_samples) - 86400""",
        "stream_traffic_node": f"""{_T}, i AS (SELECT "at", sum(down) AS down, sum(up) AS up FROM traffic_samples GROUP BY "at"), w AS (SELECT *, unnest(["at" - "at" % 1800, "at" - "at" % 1800 - 1800]) AS bucket FROM i)
SELECT bucket, CAST(floor(avg(down) + 0.5) AS BIGINT) AS down, CAST(floor(avg(up) + 0.5) AS BIGINT) AS up, count(*) AS samples FROM w GROUP BY bucket HAVING bucket + 3600 <= (SELECT max("at") FROM traffic_samples) - 86400""",
        "stream_seeding_ends": f"""{_R}, s AS (SELECT *, min("at") FILTER (WHERE ms > 20) OVER (PARTITION BY ip) AS since FROM tile_requests),
e AS (SELECT ip, since, arg_min(CASE WHEN ms >= 300 THEN 'ratio' ELSE 'time' END, "at") FILTER (WHERE "at" >= since AND (ms >= 300 OR "at" >= since + INTERVAL 10 DAY)) AS reason FROM s WHERE since IS NOT NULL GROUP BY ip, since)
SELECT ip AS info_hash, coalesce(reason, 'time') AS reason FROM e WHERE reason IS NOT NULL OR since + INTERVAL 10 DAY < (SELECT max("at") FROM tile_requests) - INTERVAL 1 DAY""",
    }
