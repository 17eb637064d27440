"""Queries on requests and bandwidth, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tiles as T
from ..functions.rules import in_schedule
from ..operators import requests as R
from ..operators import traffic as B
from ..streaming import streams as S
from .fixtures import tile_requests, traffic_samples, with_views

UNIX = ("first_seen", "last_seen")


def request_totals(s, d):
    r = tile_requests(s, d)
    p = R.recent_percentiles(r, {"p50": 0.5, "p95": 0.95})
    out = R.archive_totals(r).join(p, "info_hash", "left")
    return out.select("info_hash", "requests", "bytes", *(F.unix_timestamp(c).alias(c) for c in UNIX), "name", "p50", "p95")


def requests_by_zoom(s, d):
    return R.by_zoom(tile_requests(s, d))


def requests_by_status(s, d):
    return R.by_status(tile_requests(s, d))


def top_clients(s, d):
    return R.by_client(tile_requests(s, d))


def latency_recent512(s, d):
    return R.recent_percentiles(tile_requests(s, d), {"p50": 0.5, "p95": 0.95})


def node_snapshot(s, d):
    return R.node_totals(tile_requests(s, d))


def recent_requests(s, d):
    return R.recent(tile_requests(s, d)).select("seq", "info_hash", "z", "status", "bytes")


def _sided(s, d):
    return tile_requests(s, d).withColumn("side", F.when(F.col("ip") % 2 == 0, "a").otherwise("b"))


def latency_ab(s, d):
    return R.latency_summary(_sided(s, d), "side")


def latency_full(s, d):
    """Requests of even and odd clients as results, with a time to the first byte, an encoding and a backend of their own."""
    r = _sided(s, d)
    return R.latency_report(r.select("side", (F.col("status") < 400).alias("ok"), "status", F.col("ms").alias("total"), F.floor(F.col("ms") * 0.4).cast("double").alias("ttfb"), "bytes", F.when(F.col("z") % 3 == 0, "gzip").when(F.col("z") % 3 == 1, "br").alias("encoding"), F.when(F.col("ip") % 4 != 0, F.concat(F.lit("b"), (F.col("ip") % 4).cast("string"))).alias("backend")), "side")


def latency_ratio(s, d):
    r = R.side_ratio(R.latency_summary(_sided(s, d), "side"), "side", "a", "b")
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


def latency_histogram(s, d):
    return R.histogram(_sided(s, d), "side")


def latency_modes(s, d):
    """Two sides as they are, and two made of them that a slow half or a slow tenth joins."""
    r = _sided(s, d)
    slow = lambda name, every: r.withColumns({"side": F.concat(F.lit(name), "side"), "ms": F.when(F.col("seq") % every == 0, F.col("ms") / 50 + 900).otherwise(F.col("ms") / 50)})
    return R.two_modes(r.unionByName(slow("half-", 2)).unionByName(slow("tail-", 10)), "side")


def tumbling_requests(s, d):
    return S.request_windows(tile_requests(s, d)).withColumn("window_start", F.unix_timestamp("window_start"))


def client_sessions(s, d):
    return S.client_sessions(tile_requests(s, d)).withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


def traffic_series_one(s, d):
    return B.series(traffic_samples(s, d), 3600, archive=3)


def traffic_series_all(s, d):
    return B.series(traffic_samples(s, d), 3600)


def traffic_totals(s, d):
    return B.totals(traffic_samples(s, d))


def traffic_retained(s, d):
    t = B.clean_samples(traffic_samples(s, d))
    now = t.agg(F.max("at").alias("_now"))
    return B.retained(t.crossJoin(now), 24, F.col("_now")).groupBy("info_hash").agg(F.count(F.lit(1)).alias("samples"), F.sum("down").alias("down"))  # one row on the right


def in_schedule_bytes(s, d):
    r = tile_requests(s, d)
    night = in_schedule(F.col("at"), ("mon", "tue", "wed", "thu", "fri"), 22 * 60, 6 * 60)
    limit = B.limit_in_force(F.col("at"), F.lit(None).cast("long"), F.lit(500).cast("long"), F.lit(0).cast("long"), ("mon", "tue", "wed", "thu", "fri"), 22 * 60, 6 * 60)
    return r.groupBy("info_hash", night.alias("in_schedule"), limit.alias("limit_kbps")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests"))


def bucket_widths(s, d):
    t = traffic_samples(s, d).groupBy("info_hash").agg(F.min("at").alias("since"), F.max("at").alias("until"))
    return t.select("info_hash", T.bucket_seconds(F.col("since"), F.col("until"), F.lit(200)).alias("seconds"))


QUERIES = (request_totals, requests_by_zoom, requests_by_status, top_clients, latency_recent512, node_snapshot, recent_requests, latency_ab, latency_full, latency_ratio, latency_histogram, latency_modes, tumbling_requests, client_sessions, traffic_series_one, traffic_series_all, traffic_totals, traffic_retained, in_schedule_bytes, bucket_widths)

_RECENT = """recent AS (SELECT info_hash, ms, row_number() OVER (PARTITION BY info_hash ORDER BY ms) AS i, count(*) OVER (PARTITION BY info_hash) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY info_hash ORDER BY "at" DESC, seq DESC) AS k FROM tile_requests WHERE ms IS NOT NULL) WHERE k <= 512),
pct AS (SELECT info_hash, count(*) AS samples, max(CASE WHEN i = ceil(0.5 * n) THEN ms END) AS p50, max(CASE WHEN i = ceil(0.95 * n) THEN ms END) AS p95 FROM recent GROUP BY info_hash)"""
_AB = """sided AS (SELECT *, CASE WHEN ip % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM tile_requests),
ranked AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY ms, seq) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM sided),
ab AS (SELECT side, count(*) AS requests, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN ms END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.9)) THEN ms END) AS p90,
  max(CASE WHEN i = least(n - 1, floor(n * 0.99)) THEN ms END) AS p99, max(ms) AS worst, count(*) FILTER (WHERE status >= 400) AS errors, CAST(sum(bytes) AS BIGINT) AS bytes FROM ranked GROUP BY side)"""
_FULL = ", ".join(f"{c}[1 + CAST(least(n - 1, floor(n * {q})) AS BIGINT)] AS {name}_p{int(q * 100)}" for c, name in (("f", "ttfb"), ("t", "total")) for q in (0.5, 0.9, 0.99))
_MODES = _AB.split("ranked AS")[0].replace("sided AS", "plain AS") + """sided AS (SELECT * FROM plain UNION ALL SELECT * REPLACE ('half-' || side AS side, CASE WHEN seq % 2 = 0 THEN ms / 50 + 900 ELSE ms / 50 END AS ms) FROM plain UNION ALL SELECT * REPLACE ('tail-' || side AS side, CASE WHEN seq % 10 = 0 THEN ms / 50 + 900 ELSE ms / 50 END AS ms) FROM plain),
ranked AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY ms, seq) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM sided)"""
_NIGHT = "((dayofweek(\"at\") BETWEEN 1 AND 5 AND hour(\"at\") * 60 + minute(\"at\") >= 1320) OR (dayofweek(\"at\") BETWEEN 2 AND 6 AND hour(\"at\") * 60 + minute(\"at\") < 360))"
T_R, T_S = with_views("tile_requests"), with_views("traffic_samples")

ORACLE = {
    "request_totals": f"""{T_R}, {_RECENT}
SELECT r.info_hash, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(floor(epoch(min("at"))) AS BIGINT) AS first_seen, CAST(floor(epoch(max("at"))) AS BIGINT) AS last_seen, min(name) AS name, max(p50) AS p50, max(p95) AS p95
FROM tile_requests r LEFT JOIN pct USING (info_hash) GROUP BY r.info_hash""",
    "requests_by_zoom": f"{T_R} SELECT info_hash, z, count(*) AS requests FROM tile_requests GROUP BY ALL",
    "requests_by_status": f"{T_R} SELECT info_hash, status, count(*) AS requests FROM tile_requests GROUP BY ALL",
    "top_clients": f"{T_R} SELECT CAST(ip AS VARCHAR) AS client, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM tile_requests GROUP BY ip",
    "latency_recent512": f"{T_R}, {_RECENT} SELECT * FROM pct",
    "node_snapshot": f"{T_R} SELECT info_hash, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, grouping(info_hash) = 0 AS archive FROM tile_requests GROUP BY ROLLUP (info_hash)",
    "recent_requests": f"{T_R} SELECT seq, info_hash, z, status, bytes FROM tile_requests ORDER BY \"at\" DESC, seq DESC LIMIT 200",
    "latency_ab": f"{T_R}, {_AB} SELECT * FROM ab",
    "latency_full": f"""{T_R}, sided AS (SELECT CASE WHEN ip % 2 = 0 THEN 'a' ELSE 'b' END AS side, status < 400 AS ok, status, ms AS total, floor(ms * 0.4) AS ttfb, bytes, CASE z % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'br' END AS encoding, CASE WHEN ip % 4 <> 0 THEN 'b' || (ip % 4) END AS backend FROM tile_requests),
pc AS (SELECT side, list_sort(list(total)) AS t, list_sort(list(ttfb)) AS f, count(*) AS n FROM sided WHERE ok AND total IS NOT NULL GROUP BY side),
st AS (SELECT side, string_agg(x, ',' ORDER BY x) AS statuses FROM (SELECT side, status || '=' || count(*) AS x FROM sided GROUP BY side, status) GROUP BY side),
en AS (SELECT side, string_agg(x, ',' ORDER BY x) AS encodings FROM (SELECT side, encoding || '=' || count(*) AS x FROM sided WHERE ok AND encoding IS NOT NULL GROUP BY side, encoding) GROUP BY side),
ba AS (SELECT side, string_agg(x, ',' ORDER BY x) AS backends FROM (SELECT side, backend || '=' || count(*) AS x FROM sided WHERE ok AND backend IS NOT NULL GROUP BY side, backend) GROUP BY side)
SELECT s.*, {_FULL}, statuses, encodings, backends
FROM (SELECT side, count(*) AS "of", count(*) FILTER (WHERE ok) AS served, sum(bytes) FILTER (WHERE ok)::BIGINT AS bytes, max(total) FILTER (WHERE ok) AS total_max FROM sided GROUP BY side) s LEFT JOIN pc USING (side) LEFT JOIN st USING (side) LEFT JOIN en USING (side) LEFT JOIN ba USING (side)""",
    "latency_ratio": f"{T_R}, {_AB} SELECT round(b.p50 / a.p50, 6) AS p50_ratio, round(b.p90 / a.p90, 6) AS p90_ratio, round(b.p99 / a.p99, 6) AS p99_ratio FROM ab a, ab b WHERE a.side = 'a' AND b.side = 'b'",
    "latency_histogram": f"{T_R}, {_AB} SELECT side, CAST(CASE WHEN worst <= 0 THEN 0 ELSE least(7, floor(ms / (worst / 8))) END AS BIGINT) AS bin, count(*) AS requests FROM sided JOIN ab USING (side) GROUP BY ALL",
    "latency_modes": f"""{T_R}, {_MODES}, gaps AS (SELECT side, i, n, ms, lead(ms) OVER (PARTITION BY side ORDER BY ms, seq) AS nxt FROM ranked),
g AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY nxt - ms DESC, i) AS k FROM gaps WHERE i >= floor(n * 0.1) AND i < ceil(n * 0.9) - 1 AND nxt > ms),
cut AS (SELECT side, ms AS low_end, nxt AS high_start, n, i + 1 AS below, n - i - 1 AS above FROM g WHERE k = 1),
q AS (SELECT cut.*, max(CASE WHEN r.i = least(below - 1, floor(below * 0.5)) THEN r.ms END) OVER w AS fast, max(CASE WHEN r.i = below + least(above - 1, floor(above * 0.5)) THEN r.ms END) OVER w AS slow,
  max(CASE WHEN r.i = least(below - 1, floor(below * 0.9)) THEN r.ms END) OVER w - max(CASE WHEN r.i = least(below - 1, floor(below * 0.1)) THEN r.ms END) OVER w AS spread FROM cut JOIN ranked r ON r.side = cut.side WINDOW w AS (PARTITION BY cut.side))
SELECT DISTINCT side, low_end, high_start, CAST(below AS BIGINT) AS below, CAST(above AS BIGINT) AS above, fast AS fast_median, slow AS slow_median,
  n >= 20 AND least(below, above) / n >= 0.25 AND slow >= fast * 1.8 AND high_start - low_end >= greatest(1, spread) * 3 AS split FROM q""",
    "tumbling_requests": f"{T_R} SELECT CAST(epoch(date_trunc('hour', \"at\")) AS BIGINT) AS window_start, info_hash, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM tile_requests GROUP BY ALL",
    "client_sessions": f"""{T_R}, marked AS (SELECT *, CASE WHEN "at" < lag("at") OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM tile_requests WINDOW w AS (PARTITION BY ip ORDER BY "at", seq)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY ip ORDER BY "at", seq) AS k FROM marked)
SELECT ip, epoch_us(min("at")) AS session_start, epoch_us(max("at") + INTERVAL 30 MINUTE) AS session_end, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM numbered GROUP BY ip, k""",
    "traffic_series_one": f"{T_S} SELECT \"at\" - \"at\" % 3600 AS bucket, CAST(floor(avg(down) + 0.5) AS BIGINT) AS down, CAST(floor(avg(up) + 0.5) AS BIGINT) AS up FROM traffic_samples WHERE info_hash = 3 GROUP BY 1",
    "traffic_series_all": f"{T_S} SELECT \"at\" - \"at\" % 3600 AS bucket, CAST(floor(avg(d) + 0.5) AS BIGINT) AS down, CAST(floor(avg(u) + 0.5) AS BIGINT) AS up FROM (SELECT \"at\", sum(down) AS d, sum(up) AS u FROM traffic_samples GROUP BY \"at\") GROUP BY 1",
    "traffic_totals": f"{T_S} SELECT info_hash, CAST(sum(down) * 15 AS BIGINT) AS down_bytes, CAST(sum(up) * 15 AS BIGINT) AS up_bytes, count(*) AS samples FROM traffic_samples GROUP BY info_hash",
    "traffic_retained": f"{T_S} SELECT info_hash, count(*) AS samples, CAST(sum(greatest(0, down)) AS BIGINT) AS down FROM traffic_samples WHERE \"at\" >= (SELECT max(\"at\") FROM traffic_samples) - 86400 GROUP BY info_hash",
    "in_schedule_bytes": f"{T_R} SELECT info_hash, {_NIGHT} AS in_schedule, CAST(CASE WHEN {_NIGHT} THEN 500 ELSE -1 END AS BIGINT) AS limit_kbps, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS requests FROM tile_requests GROUP BY ALL",
    "bucket_widths": f"{T_S} SELECT info_hash, CAST(greatest(1, floor((max(\"at\") - min(\"at\")) / 200 + 0.5)) AS BIGINT) AS seconds FROM traffic_samples GROUP BY info_hash",
}
