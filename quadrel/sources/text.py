"""Feeds and directory listings that arrive as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import metadata_encoding


def decode_entities(text: Column) -> Column:
    """The five named entities of XML, & last."""
    out = text
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def _tag(name: str) -> Column:
    raw = F.regexp_extract("item", rf"(?is)<{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.when(raw != "", decode_entities(raw))


def _attribute(element: str, name: str) -> Column:
    raw = F.regexp_extract("item", rf"(?is)<{element}\b[^>]*\b{name}=[\"']([^\"']+)[\"'][^>]*>", 1)
    return F.when(raw != "", decode_entities(raw))


def parse_feed(feeds: DataFrame) -> DataFrame:
    """(feed, body) rows as items in order. A magnet comes from its own element, the link or the enclosure; a torrent is an enclosure or link that says so by its type or its ending. Items with neither are left out; the info hash is what its element says."""
    items = feeds.select("feed", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<item[\s>].*?</item>"), F.lit(0))).alias("pos", "item"))
    enclosure, kind, link = _attribute("enclosure", "url"), _attribute("enclosure", "type"), _tag("link")
    magnet = F.get(F.filter(F.array(_tag("pmtiles:magnet"), link, enclosure), lambda x: x.startswith("magnet:")), F.lit(0))
    torrent = lambda x: ~x.startswith("magnet:") & (F.coalesce(kind.rlike("(?i)bittorrent"), F.lit(False)) | x.rlike(r"(?i)\.torrent(\?|$)") | x.rlike("(?i)/file$"))
    cats = F.filter(F.transform(F.regexp_extract_all("item", F.lit(r"(?s)<category>(.*?)</category>"), F.lit(1)), lambda c: F.trim(decode_entities(c))), lambda c: c != "")
    when = _tag("pmtiles:mtime")
    number = lambda name: F.trim(_tag(name)).try_cast("double")
    box = F.filter(F.transform(F.split(F.coalesce(_tag("pmtiles:bounds"), F.lit("")), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    summary = F.struct(
        _tag("pmtiles:format").alias("format"), number("pmtiles:minzoom").alias("min_zoom"), number("pmtiles:maxzoom").alias("max_zoom"), F.when(F.size(box) == 4, box).alias("bounds"),
        number("pmtiles:tiles").alias("tiles"), _tag("pmtiles:attribution").alias("attribution"), metadata_encoding(_tag("pmtiles:encoding")).alias("encoding"),
    )
    parsed = items.select(
        "feed", "pos", F.coalesce(_tag("title"), F.lit("untitled")).alias("title"), F.get(F.filter(F.array(enclosure, link), lambda x: x.isNotNull() & torrent(x)), F.lit(0)).alias("torrent_url"), magnet.alias("magnet"),
        F.lower(_tag("pmtiles:infohash")).alias("info_hash"), _tag("pmtiles:mutable").alias("mutable_magnet"), _tag("pmtiles:md5").alias("md5"),
        F.coalesce(F.try_to_timestamp(when), F.try_to_timestamp(when, F.lit("EEE, d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(when, F.lit("EEE, d MMM yyyy HH:mm:ss z"))).alias("mtime"),
        F.when(F.col("item").rlike("(?i)<pmtiles:format[\\s>]"), summary).alias("summary"), cats.alias("categories"),
    )
    return parsed.filter("magnet is not null or torrent_url is not null")


def _folded(path: Column) -> Column:
    """A path without its . and .. segments; those at the end leave a slash."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolved(raw: Column, base: Column) -> Column:
    """A link as an address, against the document's own: absolute, of another host (//), from the root, of the query or fragment alone, or relative. Null unless it is http or https. Characters are left as they are."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    link = F.trim(raw)
    full = (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link)).when(link.startswith("#") | (link == ""), F.concat(F.regexp_replace(base, "#.*$", ""), link)).otherwise(F.concat(F.regexp_extract(page, r"^(.*/)", 1), link))
    )
    place, path, rest = (F.regexp_extract(full, r"^(?i)(https?://[^/?#]+)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    return F.when(place != "", F.concat(F.lower(place), F.when(path == "", "/").otherwise(_folded(path)), rest))


def parse_listing(listings: DataFrame) -> DataFrame:
    """(index_url, body) rows as links below the listing's own address, once each in order: anchors, and keys of bucket listings. Queries stay, for they may sign a link."""
    anchors = F.regexp_extract_all("body", F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    keys = F.regexp_extract_all("body", F.lit(r"(?is)<Key>([^<]+)</Key>"), F.lit(1))
    raw = listings.select("index_url", resolved(F.lit("."), F.col("index_url")).alias("base"), F.posexplode(F.concat(anchors, keys)).alias("pos", "raw"))
    links = raw.select("index_url", "pos", "base", resolved(F.col("raw"), F.col("index_url")).alias("link"))
    return links.filter(F.col("link").startswith(F.col("base")) & (F.col("link") != F.col("base"))).groupBy("index_url", "link").agg(F.min("pos").alias("pos"))
