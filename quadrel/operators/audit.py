"""Audits of catalogs, state files, logs and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import glob_regex


def shared_files(entries: DataFrame) -> DataFrame:
    """Paths that several entries share, how many, and the bytes read again for them."""
    return entries.groupBy("path").agg(F.count(F.lit(1)).alias("entries"), ((F.count(F.lit(1)) - 1) * F.max("size")).alias("bytes_again"), F.min("info_hash").alias("first_entry")).filter("entries > 1")


def sharing_entries(entries: DataFrame) -> DataFrame:
    """(path, info_hash, entries): every entry that shares its path with others."""
    shared = entries.groupBy("path").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")
    return entries.select("path", "info_hash").join(shared, "path")


def import_paths(entries: DataFrame, base: str, ratio: float = 2.0) -> DataFrame:
    """Entries and the share in trouble for each source, and whether that share is well above the base source's."""
    rates = entries.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.count_if("trouble").alias("troubled"), F.avg(F.col("trouble").cast("int")).alias("rate"))
    usual = rates.filter(F.col("source") == base).select(F.max("rate").alias("_usual"))
    return rates.crossJoin(usual).withColumn("suspect", F.coalesce(F.col("rate") > F.col("_usual") * ratio, F.lit(False))).drop("_usual")  # one row on the right


def classified_log(lines: DataFrame, rules: dict[str, str], last: int = 3) -> DataFrame:
    """Hits of each rule (name: regular expression) over (seq, line) rows, and its last lines in order. Rules are matched in the scan; Spark cuts each partition to its last lines (a window group limit) before they are shuffled."""
    hit = F.explode(F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull())).alias("rule")
    hits = lines.select("seq", "line", hit)
    counts = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))
    newest = hits.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("seq")))).filter(F.col("_n") <= last)
    samples = newest.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return counts.join(samples, "rule").select("rule", "hits", F.array_join(F.transform("l", lambda x: x["seq"].cast("string")), ",").alias("last_seqs"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("last_lines"))


def save_cycles(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cycle, written, full) rows of snapshots (cycle, info_hash, mtime), and the keys that were never written after the first cycle."""
    w = Window.partitionBy("info_hash").orderBy("cycle")
    marked = snapshots.withColumn("_new", F.coalesce(F.col("mtime") != F.lag("mtime").over(w), F.lit(False)))
    total = snapshots.agg(F.countDistinct("info_hash").alias("_all"))
    cycles = marked.filter("_new").groupBy("cycle").agg(F.countDistinct("info_hash").alias("written")).crossJoin(total).select("cycle", "written", (F.col("written") == F.col("_all")).alias("full"))
    never = snapshots.select("info_hash").distinct().join(marked.filter("_new").select("info_hash"), "info_hash", "left_anti")
    return cycles, never


def disk_use(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Bytes and number of the files (folder, name, size) that belong to each entry (info_hash, name, folder): their name begins with the entry's or holds its key.

    Names and keys have few lengths, so a file's name is cut into its beginnings and its runs of those lengths, and the rest is an equi-join.
    """
    lengths = entries.agg(F.array_sort(F.collect_set(F.length("name"))).alias("_n"), F.array_sort(F.collect_set(F.length("info_hash"))).alias("_k"))  # a name's length is 255 at most
    numbered = files.select("folder", "name", "size", F.xxhash64("folder", "name").alias("_file"))
    cut = numbered.crossJoin(F.broadcast(lengths))  # one row on the right
    begins = F.transform(F.filter("_n", lambda n: n <= F.length("name")), lambda n: F.struct(F.lit("name").alias("of"), F.substring(F.col("name"), F.lit(1), n).alias("text")))
    runs = F.flatten(F.transform(F.filter("_k", lambda k: k <= F.length("name")), lambda k: F.transform(F.sequence(F.lit(1), F.length("name") - k + 1), lambda i: F.struct(F.lit("key").alias("of"), F.substring(F.col("name"), i, k).alias("text")))))
    parts = cut.select("folder", "_file", "size", F.explode(F.array_distinct(F.concat(begins, runs))).alias("p")).select("folder", "_file", "size", "p.of", "p.text")
    wanted = entries.select("info_hash", "folder", F.explode(F.array(*(F.struct(F.lit(of).alias("of"), F.col(c).alias("text")) for of, c in (("name", "name"), ("key", "info_hash"))))).alias("p")).select("info_hash", "folder", "p.of", "p.text")
    found = parts.join(wanted, ["folder", "of", "text"]).select("info_hash", "_file", "size").distinct()
    return entries.select("info_hash").join(found, "info_hash", "left").groupBy("info_hash").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("_file").alias("files"))


def orphans(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keys that only the files or only the catalog have."""
    a, b = files.select("info_hash").distinct().withColumn("_f", F.lit(True)), catalog.select("info_hash").distinct().withColumn("_c", F.lit(True))
    return a.join(b, "info_hash", "full_outer").filter("_f is null or _c is null").select("info_hash", F.when(F.col("_c").isNull(), "orphan").otherwise("missing").alias("state"))


def matched_rules(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The first rule (name, glob) that accepts each file's base name; files that none accepts are left out. Rules are few and fixed, so they are tested in the scan."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    first = F.coalesce(*(F.when(base.rlike(glob_regex(g)), F.lit(n)) for n, g in rules))
    return files.withColumn("rule", first).filter("rule is not null")


def budget_plan(items: DataFrame, budget: int, cell_seconds: int = 3600) -> DataFrame:
    """Items (cache, key, used, size) to keep: the most recently used up to a budget of bytes for each cache. Sums run within time cells, then over the cells, so a large cache takes many tasks."""
    placed = items.withColumn("_cell", F.floor(F.unix_timestamp("used") / cell_seconds))
    cells = placed.groupBy("cache", "_cell").agg(F.sum("size").alias("_n"))
    bases = cells.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("cache").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.sum("size").over(Window.partitionBy("cache", "_cell").orderBy(F.desc("used"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(bases, ["cache", "_cell"]).withColumn("running", F.col("_base") + F.col("_own")).withColumn("kept", F.col("running") <= budget).drop("_cell", "_own", "_base")
