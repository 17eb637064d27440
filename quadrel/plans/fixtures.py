"""Views of the given tables as the operators' inputs, for Spark and as the CTEs of the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(c: str):
    return F.col(c).cast("timestamp")


def tile_requests(spark: SparkSession, d: str) -> DataFrame:
    return as_requests(table(spark, d, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type").isin("view", "click"), 200).when(F.col("event_type") == "signup", 204).when(F.col("event_type") == "purchase", 304).otherwise(503)
    return events.select(
        (F.col("user_id") % 20).alias("info_hash"), (F.col("user_id") % 15).cast("int").alias("z"), status.alias("status"), F.floor(F.col("value") * 1000 + 0.5).alias("bytes"), F.col("value").alias("ms"),
        F.col("user_id").alias("ip"), _at("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("archive-"), (F.col("user_id") % 20).cast("string")).alias("name"),
    )


def traffic_samples(spark: SparkSession, d: str) -> DataFrame:
    return as_samples(table(spark, d, "events"))


def as_samples(events: DataFrame) -> DataFrame:
    t = F.unix_timestamp(_at("ts"))
    return events.select((F.col("user_id") % 20).alias("info_hash"), (t - t % 15).alias("at"), F.floor(F.col("value") * 1000 + 0.5).alias("down"), F.floor(F.col("value") * 500 + 0.5).alias("up"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("info_hash"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"), F.floor("o_totalprice").cast("long").alias("size"), F.array("o_orderpriority", "c_mktsegment").alias("categories"),
        _at("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", _at("o_orderdate")).alias("build_date"), (F.col("o_orderstatus") == "F").alias("complete"), F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("family"),
    )


def archive_tiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("source_idx"), F.col("l_orderkey").alias("tile_id")).distinct()


def tile_payloads(spark: SparkSession, d: str, content: str = "text") -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("tile_id"), F.col(content).alias("content"))


def height_tiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("tile_id"), (F.col("vec_id") % 4).cast("int").alias("source_idx"), F.transform("embedding", lambda v: v.cast("double") * 1000).alias("px"))


def rgba_tiles(spark: SparkSession, d: str) -> DataFrame:
    byte = lambda shift: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.least(F.lit(255), F.floor(F.abs(F.get("embedding", F.pmod(i + shift, F.lit(64))).cast("double")) * 500)).cast("int"))
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 4).cast("long").alias("tile_id"), (F.col("vec_id") % 4).cast("int").alias("source_idx"), byte(0).alias("r"), byte(16).alias("g"), byte(32).alias("b"), F.array_repeat(F.floor(F.col("label") * 255 / 9).cast("int"), F.lit(64)).alias("a")
    )


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    # Positions run within cells of ids, then over a feed's cells: a feed may hold a third of all documents.
    docs = table(spark, d, "documents").select(F.col("source").alias("feed"), F.col("doc_id").alias("info_hash"), F.shiftright("doc_id", 16).alias("cell"))
    cells = docs.groupBy("feed", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("feed", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("feed").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("feed", "cell").orderBy(F.desc("info_hash")))
    return docs.withColumn("own", own).join(before, ["feed", "cell"]).select("feed", "info_hash", (F.col("before") + F.col("own")).cast("int").alias("pos"), (F.col("info_hash") % 7 == 0).alias("seen"))


def piece_availability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("archive"), (F.col("l_linenumber") - 1).cast("long").alias("piece")).agg(F.count(F.lit(1)).alias("copies"))


CTE = {
    "tile_requests": """tile_requests AS (SELECT user_id % 20 AS info_hash, CAST(user_id % 15 AS INT) AS z,
  CASE WHEN event_type IN ('view', 'click') THEN 200 WHEN event_type = 'signup' THEN 204 WHEN event_type = 'purchase' THEN 304 ELSE 503 END AS status,
  CAST(floor(value * 1000 + 0.5) AS BIGINT) AS bytes, value AS ms, user_id AS ip, CAST(ts AS TIMESTAMP) AS "at", event_id AS seq, 'archive-' || (user_id % 20) AS name FROM events)""",
    "traffic_samples": """traffic_samples AS (SELECT user_id % 20 AS info_hash, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 15 AS "at",
  CAST(floor(value * 1000 + 0.5) AS BIGINT) AS down, CAST(floor(value * 500 + 0.5) AS BIGINT) AS up FROM events)""",
    "catalog": """catalog AS (SELECT o_orderkey AS info_hash, 'order-' || o_orderkey AS name, CAST(floor(o_totalprice) AS BIGINT) AS size, [o_orderpriority, c_mktsegment] AS categories,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS build_date, o_orderstatus = 'F' AS complete, o_custkey AS custkey, o_orderpriority AS family
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "percat": "percat AS (SELECT *, unnest(categories) AS category FROM catalog)",
    "archive_tiles": "archive_tiles AS (SELECT DISTINCT l_suppkey % 4 AS source_idx, l_orderkey AS tile_id FROM lineitem)",
    "zoomed": "zoomed AS (SELECT *, CASE "
    + " ".join(f"WHEN tile_id < {(4 ** (k + 1) - 1) // 3} THEN {k}" for k in range(16))
    + " END AS z FROM archive_tiles)",
    "heights": """heights AS (SELECT vec_id // 4 AS tile_id, CAST(vec_id % 4 AS INT) AS source_idx, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 1000 AS h FROM embeddings)""",
    "feed_items": "feed_items AS (SELECT source AS feed, doc_id AS info_hash, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS pos, doc_id % 7 = 0 AS seen FROM documents)",
    "piece_availability": "piece_availability AS (SELECT l_suppkey AS archive, CAST(l_linenumber - 1 AS BIGINT) AS piece, count(*) AS copies FROM lineitem GROUP BY 1, 2)",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
