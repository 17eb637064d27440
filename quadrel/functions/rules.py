"""Scalar rules on catalog entries, names, links, metadata and schedules, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings that a summary may name, and parts of a link's query that carry credentials.
ENCODINGS = ("mapbox", "terrarium", "custom")
SIGNED = r"(?i)(^|&)(x-amz-signature|signature|sig|token|access_token|key|apikey|api_key)="
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def categories(listed: Column, single: Column) -> Column:
    """One list of a category list and a single category: trimmed, no blanks, distinct, sorted."""
    both = F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.array(single))
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))))


def publishing(flags: dict[str, Column], defaults: dict[str, Column], complete: Column) -> dict[str, Column]:
    """serve, self_seed and download of an entry: its own flag, else the node's, else no. Seeding itself needs serving, a download a complete file."""
    own = {k: F.coalesce(flags.get(k, F.lit(None)).cast("boolean"), defaults.get(k, F.lit(None)).cast("boolean"), F.lit(False)) for k in ("serve", "self_seed", "download")}
    return {"serve": own["serve"], "self_seed": own["self_seed"] & own["serve"], "download": own["download"] & F.coalesce(complete, F.lit(False))}


def visible(cats: Column, scope: Column, allowed: Column) -> Column:
    """Whether a requester sees an entry: its scope list first, then the node's list; entries without a category stay hidden where a list holds."""
    lists = [F.when(x.isNull(), F.lit(True)).otherwise(F.coalesce(F.arrays_overlap(cats, x), F.lit(False))) for x in (scope, allowed)]
    return lists[0] & lists[1]


def matches_text(needle: str, name: Column, key: Column, cats: Column) -> Column:
    """Search that ignores case: the needle in the name, the key or a category. An empty needle matches all."""
    n = F.lit(needle.strip().lower())
    return F.coalesce(F.lower(name).contains(n), F.lit(False)) | F.coalesce(F.lower(key).contains(n), F.lit(False)) | F.coalesce(F.exists(cats, lambda c: F.lower(c).contains(n)), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell glob as a regular expression over the whole base name; * and ? don't cross a slash."""
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c) for c in pattern) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1).rlike(glob_regex(pattern))


def kind_of_name(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".pmtiles"), "pmtiles").when(n.endswith(".mbtiles"), "mbtiles").when(n.endswith(".torrent"), "torrent").otherwise("other")


def kind_of_bytes(content: Column) -> Column:
    head = F.substring(content, 1, 16)
    return F.when(F.substring(head, 1, 2) == F.lit(b"PM"), "pmtiles").when(head == F.lit(b"SQLite format 3\0"), "mbtiles").otherwise("other")


def reachability(url: Column) -> Column:
    """bad: no host or this machine; warn: private networks and names without a dot; else ok."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^\[|\]$", "")
    return (
        F.when((host == "") | host.rlike(r"^(localhost|.*\.localhost|127\.[0-9.]+|0\.0\.0\.0|::1|::)$"), "bad")
        .when(host.rlike(r"^(10\.[0-9.]+|192\.168\.[0-9.]+|172\.(1[6-9]|2[0-9]|3[01])\.[0-9.]+|169\.254\.[0-9.]+|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9.]+|f[cd][0-9a-f]{2}:.*|fe80:.*)$") | host.rlike(r"\.(local|lan|internal|home)$") | ~host.rlike(r"[.:]"), "warn")
        .otherwise("ok")
    )


def carries_credentials(url: Column) -> Column:
    user = F.try_parse_url(url, F.lit("USERINFO"))
    query = F.try_parse_url(url, F.lit("QUERY"))
    return (F.coalesce(user, F.lit("")) != "") | F.coalesce(query.rlike(SIGNED), F.lit(False))


def metadata_flag(text: Column) -> Column:
    """True, false, or null where the metadata says neither."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def metadata_encoding(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*ENCODINGS), t)


def custom_factors(red: Column, green: Column, blue: Column, shift: Column) -> Column:
    """The four numbers of a custom encoding, or null unless all four are numbers."""
    n = [c.try_cast("double") for c in (red, green, blue, shift)]
    return F.when(n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull() & n[3].isNotNull(), F.struct(*(x.alias(k) for x, k in zip(n, ("red", "green", "blue", "shift"), strict=True))))


def in_schedule(at: Column, days: tuple[str, ...], start: int, stop: int) -> Column:
    """Whether a time lies in a daily window of minutes. One that crosses midnight belongs to the day it starts; equal ends mean never."""
    minute, day = F.hour(at) * 60 + F.minute(at), F.dayofweek(at) - 1
    on = [DAYS.index(d) for d in days]
    if start == stop:
        return F.lit(False)
    if start < stop:
        return day.isin(on) & (minute >= start) & (minute < stop)
    return (day.isin(on) & (minute >= start)) | (day.isin([(d + 1) % 7 for d in on]) & (minute < stop))


def limit(value: Column) -> Column:
    """A rate limit; zero, less and nothing mean none (-1)."""
    return F.when(value > 0, value).otherwise(F.lit(-1).cast("long"))


def expand_template(template: Column, at: Column) -> Column:
    """Dates in a link template: braces that hold runs of Y, M and D, with single separators between, stand for parts of the date; two Ys are the last two digits, a single M or D has no zero before it. Other braces stay as they are."""
    parts = {"y": F.date_format(at, "yyyy"), "m": F.date_format(at, "M"), "d": F.date_format(at, "d")}

    def run(x: Column) -> Column:
        letter, n = F.lower(F.substring(x, 1, 1)), F.length(x)
        year = F.when(n == 2, F.substring(parts["y"], 3, 2)).otherwise(parts["y"])
        two = lambda p: F.when((n > 1) & (F.length(p) < 2), F.concat(F.lit("0"), p)).otherwise(p)
        return F.when(letter == "y", year).when(letter == "m", two(parts["m"])).when(letter == "d", two(parts["d"])).otherwise(x)

    def piece(x: Column) -> Column:
        runs = F.regexp_extract_all(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(r"([YMDymd])\1*|[-_./ ]"), F.lit(0))
        return F.when(x.rlike(r"^\{[YMDymd]+([-_./ ]?[YMDymd]+)*\}$"), F.array_join(F.transform(runs, run), "")).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(r"\{[^{}]*\}|[^{]+|\{"), F.lit(0)), piece), "")


def client_key(address: Column) -> Column:
    """One client counts once: IPv4 addresses in IPv6 form lose their prefix."""
    return F.regexp_replace(address.cast("string"), "^::ffff:", "")


def round_half_up(x: Column) -> Column:
    """Rounding as floor(x + 0.5), also below zero."""
    return F.floor(x + 0.5)
