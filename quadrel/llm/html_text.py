"""Operator 7. Main text of pages by consensus of a host's pages.

Each page's containers are scored: a block of text counts in full for the element that holds it, by half for the next
outer one and so on; text of links and of furniture counts nothing. The best container's path, generalised to tags and class
names without numbers, gets the page's score as a vote; Spark sums the votes by host and path, and pages are extracted again at
their host's winning path. A page without an element at that path uses its own best container.

Furniture is what the elements and roles for it hold (menus, footers, asides, forms and their fields, dialogs, scripts, styles, the head; a
header outside the article), what is hidden from all readers, and what class names or ids say is menu, advert, notice, reader comment and the
like. Names are evidence by degree: a name made only of such words and of neutral parts ("comment-list", "ad_box2") decides for a block element; one
that mixes them with other words ("related-work") counts only if most of the element's text is links. So does, within an article, one that is
made of words that articles have as subjects too ("banner", "share"), if there is more than a label in it. Names of inline elements, of
anything in preformatted text, and of the containers that hold the article say nothing. All else is kept: formulas,
captions, fallbacks of objects, text of drawings.

Memory and time are in proportion to the page: elements know their parents by number, paths are folded into hashes and written out for winners only.

The winners (a row for each host) are broadcast up to `broadcast_bytes`. Where they are more, pages meet them by host, and a host
with more pages than its share of a partition is dealt to several partitions by a salt, with a copy of its winner in each.

Null html gives an empty text. A null or unreadable url belongs to the host "". Equal votes go to the path that sorts last. Repeated rows give
equal rows; malformed markup is read as browsers do in the main (open elements end with their parents). Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[^<>]*>|[^<]++|<""", re.S)
#: The same without quotes, for pages on which quotes don't end.
BARE = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^<>]*)>|<[^<>]*>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Fixed lists of HTML's elements and of words that name furniture. Text of RAW elements is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark math noscript object picture q rp rt ruby s samp small span strike strong sub sup svg time tt u var video".split())
INLINE |= frozenset("mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose merror semantics annotation g text tspan path circle rect line use defs".split())
FURNITURE = frozenset("nav footer aside form button menu dialog head select datalist".split()) | RAW
#: Which open element a start tag ends.
CLOSED = {t: ("p",) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div main section table ul ol dl nav header footer form blockquote td th html".split())
HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li ul ol dl dt dd tr td th tbody thead table figure figcaption".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted recommended related replies respond share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe taboola toolbar".split()
)
#: Words of those that name subjects of articles as well, and how much text more than a label has.
SUBJECTS, LABEL = frozenset("banner recommended related share sharing social".split()), 20
NEUTRAL = frozenset("a all area bar block bottom box button buttons center column container content footer form global header inner item items left link links list main middle mini mobile outer panel primary right row secondary section side site slot space text the thread top unit widget wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())


class _Element:
    __slots__ = ("above", "tag", "name", "path", "out", "link", "block", "weak", "held", "score", "text", "linked")

    def __init__(self, above: int, tag: str, name: str, path: int, out: bool, link: bool, block: int, weak: int, held: bool):
        self.above, self.tag, self.name, self.path, self.out, self.link, self.block, self.weak, self.held = above, tag, name, path, out, link, block, weak, held
        self.score = self.text = self.linked = 0


@cache
def _named(names: str) -> int:
    """What class names or an id say: 3 furniture, 2 furniture or a subject, 1 perhaps, 0 nothing."""
    degree = 0
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).lower()) if x]
        if found := WORDS & set(parts):
            degree = max(degree, 1 if any(p not in WORDS and p not in NEUTRAL for p in parts) else 2 if found <= SUBJECTS else 3)
    return degree


def _furniture(tag: str, attributes: dict[str, str], article: bool) -> int:
    """3: yes, 2: if it is mostly links or a mere label, 1: only if it is mostly links, 0: no."""
    if tag in FURNITURE or tag == "header" and not article or "hidden" in attributes or attributes.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return 3
    if tag in INLINE or tag in ("html", "body", "main"):
        return 0
    degree = _named(attributes.get("class", "")) if tag == "article" else max(_named(attributes.get("class", "")), _named(attributes.get("id", "")))
    return degree + (degree == 2 and not article)


def _step(path: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), path)


def read(html: str) -> tuple[list[tuple[int, str, int]], list[_Element]]:
    """Blocks of text outside sure furniture (the element around it, the text, how much of it is links), and all elements, each after its parent."""
    elements, stack, blocks, held = [_Element(0, "", "", 0, False, False, 0, 0, False)], [0], [], []
    open_: Counter = Counter()
    at, pattern, broken = 0, TOKEN, 0

    def flush() -> None:
        text = " ".join("".join(piece for piece, _ in held).split())
        if text:
            linked = sum(len(" ".join(piece.split())) for piece, link in held if link)
            blocks.append((elements[stack[-1]].block, text, min(linked, len(text))))
        held.clear()

    def close(n: int) -> None:
        while len(stack) > n:
            open_[elements[stack.pop()].tag] -= 1

    while at < len(html):
        m = pattern.match(html, at)
        tag = m["tag"]
        if tag is None:
            top = elements[stack[-1]]
            if (m[0][0] != "<" or m[0] == "<") and not top.out:
                held.append((unescape(m[0]), top.link))
            if m[0][0] == "<" and html[at + 1 : at + 2].isalpha():
                broken += 1
                pattern = BARE if broken > 16 else TOKEN
            at = m.end()
            continue
        at = m.end()
        tag = tag.lower()
        if m["end"]:
            if tag not in INLINE:
                flush()
            if open_[tag] > 0:
                for n in range(len(stack) - 1, 0, -1):
                    now = elements[stack[n]].tag
                    if now == tag:
                        close(n)
                        break
                    if tag in INLINE and now not in INLINE:
                        break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
        ended = CLOSED.get(tag, ())
        if any(open_[t] > 0 for t in ended):
            outermost = None  # a row ends its last cell too
            for n in range(len(stack) - 1, 0, -1):
                now = elements[stack[n]].tag
                if now in ended:
                    outermost = n
                elif now in SCOPES or outermost is not None:
                    break
            if outermost is not None:
                close(outermost)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        up = elements[stack[-1]]
        out, weak, name, path = up.out, 0, "", up.path
        if not out:
            attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m["rest"] or "")}
            article = open_["article"] > 0 or open_["main"] > 0
            degree = 0 if open_["pre"] > 0 else _furniture(tag, attributes, article)
            out, weak = degree == 3, degree % 3
            if tag not in INLINE:
                names = ".".join(sorted({x for c in attributes.get("class", "").lower().split() if (x := re.sub(r"[-_]?\d+", "", c))}))
                name = f"{tag}{'.' + names if names else ''}"
                path = _step(up.path, name)
        if m[0].endswith("/>") and (tag in ("svg", "math") or open_["svg"] > 0 or open_["math"] > 0):
            continue
        own = len(elements)
        elements.append(_Element(stack[-1], tag, name, path, out, up.link or tag == "a", own if tag not in INLINE else up.block, weak, tag in HOLDERS))
        stack.append(own)
        open_[tag] += 1
    flush()
    return blocks, elements


def judged(html: str) -> tuple[list[tuple[int, str]], list[_Element]]:
    """Blocks outside furniture, each with the element around it, and the elements with their scores."""
    blocks, elements = read(html)
    if any(e.weak for e in elements):
        for k, text, link in blocks:
            elements[k].text += len(text)
            elements[k].linked += link
        for e in elements[:0:-1]:
            up = elements[e.above]
            up.text += e.text
            up.linked += e.linked
        for e in elements[1:]:
            e.out = elements[e.above].out or e.out or e.weak > 0 and 2 * e.linked > e.text or e.weak == 2 and e.text < LABEL
    for k, text, link in blocks:
        n = 0 if elements[k].out else len(text) - link
        while n:
            if not elements[k].held:
                elements[k].score += n
                n //= 2
            if not k:
                break
            k = elements[elements[k].above].block
    return [(k, text) for k, text, _ in blocks if not elements[k].out], elements


def best(elements: list[_Element]) -> int:
    return max(range(len(elements)), key=lambda k: elements[k].score)  # of equals the outermost


def path_of(elements: list[_Element], k: int) -> str:
    names = []
    while k:
        names.append(elements[k].name)
        k = elements[k].above
    return "".join(f">{n}" for n in reversed(names) if n)


def main_text(html: str, path: str | None) -> str:
    blocks, elements = judged(html)
    inside = [False] * len(elements)
    if path is not None:
        wanted = 0
        for name in path.split(">")[1:]:
            wanted = _step(wanted, name)
        inside = [e.path == wanted and e.score > 0 and e.block == k for k, e in enumerate(elements)]
    if not any(inside):
        inside[best(elements)] = True
    for k, e in enumerate(elements):
        inside[k] = inside[k] or bool(k) and inside[e.above]
    return " ".join(text for k, text in blocks if inside[k])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    score, pages = Counter(), Counter()
    for table in text_batches(batches, "html"):
        for host, html in zip(table["host"].to_pylist(), table["html"], strict=True):
            elements = judged(html.as_py() or "")[1]
            top = best(elements)
            path = path_of(elements, top)
            score[host, path] += elements[top].score
            pages[host, path] += 1
    if pages:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([k[0] for k in pages], [k[1] for k in pages], [score[k] for k in pages], list(pages.values()))], names=["host", "path", "score", "pages"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in text_batches(batches, "html"):
        texts = [main_text(h.as_py() or "", p) for h, p in zip(table["html"], table["path"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([table["page_id"].combine_chunks(), table["url"].combine_chunks(), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, pages): one row for each host with its number of pages. Where no page has text, the path is one that no text is under."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_vote, "host string, path string, score long, pages long")
    by_path = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages"))
    return by_path.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"), F.sum("pages").alias("pages"))


def _with_winners(rows: DataFrame, winners: DataFrame, broadcast_bytes: int, share: float) -> DataFrame:
    total = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64).alias("bytes"), F.sum("pages").alias("pages")).first()
    if (total.bytes or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(winners), "host", "left")
    even = max(1.0, share * total.pages / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = winners.withColumn("salts", F.floor(F.col("pages") / even).cast("int") + 1)
    hot = salts.filter("salts > 1").select("host", "salts")  # partitions / share rows at most
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), "salts"), F.lit(0)).cast("int")).drop("salts")
    return dealt.join(salts.select("host", "path", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), ["host", "salt"], "left")


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20, share: float = 0.25) -> DataFrame:
    """page_id, url, text of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    winners = stored(winning_paths(pages), "winners")
    return _with_winners(rows, winners, broadcast_bytes, share).select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string")
