"""Operator 6. Personal data by weak supervision.

Base spans (email, ip, card, phone by strict rules) always stay. Looser candidates are judged: addresses that are spelled out or
bracketed; version 6 and defanged network addresses; card numbers that fail the check digit or are parted by other signs;
phone numbers in national layouts, with a trunk zero, or with 00 for the plus. Three labelers vote yes, no or nothing: the
format (rules on layout, length, check digit, dates), a gazetteer (mail endings, address blocks, issuers' prefixes, calling codes) and
the words around the span. Base spans vote in the same way. Spark counts the vote patterns with the spans' features;
expectation-maximisation on those counts (a bounded table) estimates each labeler's reliability per kind, from base spans as
known cases (their weight is that of the candidates at most, lest what is regular about them decide) and from candidates by how the
labelers agree; a labeler that errs more than not is counted against its word. The resulting probabilities train a logistic span classifier on
the same counts. A second pass adds the candidates that it accepts.

Null texts are empty. Spans are code points, end exclusive, in order of kind, then start. Added spans overlap neither base spans nor each other.
A null doc_id stays null; repeated rows give equal rows; empty tables give empty results, and other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from ipaddress import IPv6Address
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|\b[Aa][Tt]\b|::")
_AT, _DOT = r"\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?", r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
_OCTET = r"(?:\[\.\]|\(\.\)|\{\.\}|\x20dot\x20)[0-9]{1,3}"
#: Candidates beyond the base.
LOOSE = {
    "email": re.compile(
        rf"(?<![\w.%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}(?!\w)"
        r"|(?<![\w.%+-])[A-Za-z0-9_%+-]{1,64}(?:(?:\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9_%+-]{1,64}){0,3}\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{1,63}){1,4}(?!\w)"
    ),
    "ip": re.compile(rf"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![\w:])|(?<![\w.])[0-9]{{1,3}}(?:{_OCTET}){{3}}(?![\w])"),
    "card": re.compile(r"(?<![\w.+-])(?:[0-9]{4}([\x20\xa0./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|3[0-9]{3}([\x20\xa0./_-]?)[0-9]{6}\2[0-9]{5})(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w+.,:/-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![\w-])"
        # Digits are taken whole and never given back, and a number has few parts: no digit is read more than some ten times.
        r"|(?<![\w+.,:/-])\(?0(?:0[1-9]|[1-9])[0-9]*+\)?(?:[\x20./-]{1,2}+\(?[0-9]++\)?|\([0-9]++\)){0,7}+(?![\w-])"
    ),
}
#: What a text must hold to have a candidate at all: tests that are much cheaper than the rules.
HINTS = {
    "email": re.compile(r"[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]|\x20(?:dot|DOT)\x20"),
    "ip": re.compile(r":[0-9A-Fa-f]{0,4}:|[\[({]\.[\])}]|[0-9]\x20dot\x20[0-9]"),
    "card": re.compile(r"[0-9]{4}[\x20\xa0./_-]?[0-9]{4}"),
    "phone": re.compile(r"[0-9)][0-9()\x20./-]{6}"),
}
DATE = re.compile(r"[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}|[0-9]{4})|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}")
#: Fixed word lists of the gazetteer and context labelers: endings of mail hosts, country calling codes, words that announce a kind, words that announce other numbers.
ENDINGS = frozenset("com org net edu gov mil int info biz name dev app io ai co me tv eu uk de fr es it nl be ch at se no dk fi pl pt cz ie gr hu ro ru ua tr il in cn jp kr au nz ca us mx br ar cl za sg hk tw".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 233 234 254 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 385 386 387 389 420 421 852 853 855 880 886 961 962 963 964 965 966 971 972 973 974".split())
CUES = {
    "email": frozenset("mail email e-mail contact write address correo courriel kontakt adresse reach".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address addr adresse gateway client from".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta pan".split()),
    "phone": frozenset("call phone tel telephone mobile fax cell telefon teléfono telefono téléphone handy rufnummer dial".split()),
}
AGAINST = frozenset("version isbn issn order invoice item page doi serial id no number nr ticket date time art".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:  # an address holds one @, and starts as far left of it as what came before lets it
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for kind, rule in (("card", CARD), ("phone", PHONE)):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap no base span, and of each other the first."""
    found = [(m.start(), -m.end(), k, kind) for k, (kind, rule) in enumerate(LOOSE.items()) if HINTS[kind].search(text) for m in rule.finditer(text) if kind != "phone" or 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    out, taken, end = [], sorted((a, b) for _, a, b in base), 0
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))
    for start, stop, _, kind in sorted(found):
        at = bisect_left(starts, -stop)
        if start >= end and (not at or reach[at - 1] <= start):
            out.append((kind, start, -stop))
            end = -stop
    return out


def _email_votes(own: str, digits: str) -> tuple[int, int]:
    return (1 if "@" in own and "[" not in own else -1 if len(own) > 100 else int(bool(re.search(r"[\[({<]", own)))), 1 if re.split(r"[^A-Za-z0-9]+", own.lower().rstrip(")]}> "))[-1] in ENDINGS else -1


def _ip_votes(own: str, digits: str) -> tuple[int, int]:
    if ":" not in own:
        parts = re.split(r"[^0-9]+", own)
        good = len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p or 0) <= 255 for p in parts)
        return (1 if good else -1), (1 if parts[0] in ("10", "127", "172", "192") else 0)
    try:
        first = int.from_bytes(IPv6Address(own).packed[:2], "big")
    except ValueError:
        return -1, -1
    return 1, 1 if 0x2000 <= first < 0x4000 or first >> 9 == 0xFC >> 1 or first >> 6 == 0xFE80 >> 6 else -1


def _card_votes(own: str, digits: str) -> tuple[int, int]:
    form = 1 if luhn(digits) or len(digits) < len(own) else -1
    two, four = int(digits[:2]), int(digits[:4])
    issuer = len(digits) == 15 if two in (34, 37) else len(digits) in (16, 19) and (digits[0] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or 64 <= two <= 65 or two == 35)
    return form, 1 if issuer else -1


def _phone_votes(own: str, digits: str) -> tuple[int, int]:
    if DATE.fullmatch(own) or not 9 <= len(digits) <= 14:
        return -1, -1
    form = 1 if own[0] in "+(" or len(digits) < len(own) else 0 if digits.startswith("00") else -1  # an unbroken run is rarely a number to call
    code = digits if own[0] == "+" else digits[2:] if digits.startswith("00") else ""
    if code:
        return form, 1 if any(code[:n] in CALLING for n in (1, 2, 3)) else -1
    if digits[0] == "0":  # a trunk zero, then an area or network
        return form, 1 if 9 <= len(digits) <= 12 and len(set(digits[1:])) > 2 else -1
    return form, 1 if digits[0] in "23456789" and digits[3] not in "01" else -1


LAYOUTS = {"email": _email_votes, "ip": _ip_votes, "card": _card_votes, "phone": _phone_votes}


def votes(text: str, span: tuple[str, int, int]) -> tuple[int, int, int]:
    """Format, gazetteer and context: 1 for personal data, -1 against, 0 no opinion."""
    kind, start, end = span
    own = text[start:end]
    before = set(re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-4:])
    return *LAYOUTS[kind](own, re.sub("[^0-9]", "", own)), 1 if before & CUES[kind] else -1 if before & AGAINST else 0


def features(text: str, span: tuple[str, int, int]) -> tuple[int, ...]:
    """Small whole numbers, so that equal spans are counted together."""
    kind, start, end = span
    own = text[start:end]
    return (min(9, len(own) // 6), int(any(c in own for c in "()[]{}")), int(" " in own), int(start > 0 and text[start - 1].isalnum()), int(end < len(text) and text[end].isalnum()), int(any(c.isalpha() for c in own)))


def _row(v: tuple, f: tuple) -> list[float]:
    return [1.0, *(float(x == y) for x in v for y in (1, -1)), *map(float, f)]


def learn(counts: list[tuple[str, tuple, tuple, bool, int]], rounds: int = 50) -> dict[str, dict]:
    """counts: kind, votes, features, base or not, number. Per kind the labelers' reliabilities, the prior of candidates, and the classifier's weights."""
    out = {}
    for kind in KINDS:
        own = sorted(x for x in counts if x[0] == kind)
        if not own:
            continue
        v, n, known = np.array([x[1] for x in own]), np.array([x[4] for x in own], float), np.array([x[3] for x in own])
        loose = n[~known].sum()
        n[known] *= min(1.0, max(loose, 10.0) / max(n[known].sum(), 1.0))
        good, prior = np.full(v.shape[1], 0.7), 0.5
        for _ in range(rounds):
            right, wrong = np.log(good), np.log(1 - good)
            yes = np.log(prior) + np.where(v == 1, right, np.where(v == -1, wrong, 0)).sum(axis=1)
            no = np.log(1 - prior) + np.where(v == -1, right, np.where(v == 1, wrong, 0)).sum(axis=1)
            p = np.where(known, 0.98, 1 / (1 + np.exp(no - yes)))
            prior = float(np.clip(((p * n)[~known].sum() + 2) / (loose + 4), 0.05, 0.95))
            agree = (n[:, None] * np.where(v == 1, p[:, None], np.where(v == -1, 1 - p[:, None], 0))).sum(axis=0)
            good = np.clip((agree + 7) / ((n[:, None] * (v != 0)).sum(axis=0) + 10), 0.05, 0.99)
        x = np.array([_row(r[1], r[2]) for r in own])
        weight, w = np.log1p(n), np.zeros(x.shape[1])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.eye(len(w)) * 0.1, x.T @ (weight * (p - q)) - 0.1 * w)
        out[kind] = {"reliability": good.round(4).tolist(), "prior": prior, "weights": w.tolist()}
    return out


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    for table in text_batches(batches):
        for t in table["text"]:
            text = t.as_py() or ""
            if ANY.search(text):
                base = base_spans(text)
                n.update((s[0], votes(text, s), features(text, s), s in base) for s in (*base, *loose_spans(text, base)))
    if n:
        yield pa.RecordBatch.from_pydict({"kind": [k[0] for k in n], "votes": [list(k[1]) for k in n], "features": [list(k[2]) for k in n], "base": [k[3] for k in n], "n": list(n.values())})


def _finder(model: dict, least: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
        for table in text_batches(batches):
            out = []
            for t in table["text"]:
                text, found = t.as_py() or "", []
                if ANY.search(text):
                    base = base_spans(text)
                    found = [(*s, True) for s in base]
                    for s in loose_spans(text, base):
                        w = model.get(s[0], {}).get("weights")
                        if w and 1 / (1 + np.exp(-np.dot(w, _row(votes(text, s), features(text, s))))) >= least:
                            found.append((*s, False))
                    found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append([{"kind": k, "start": a, "stop": b, "base": own} for k, a, b, own in found])
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(out, span)], names=["doc_id", "spans"])

    return find


def train(docs: DataFrame) -> dict[str, dict]:
    """The driver gets one row for each distinct (kind, votes, features): some thousands at most, whatever the input."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter, "kind string, votes array<long>, features array<long>, base boolean, n long")
    rows = counts.groupBy("kind", "votes", "features", "base").agg(F.sum("n").alias("n")).collect()
    return learn([(x.kind, tuple(x.votes), tuple(x.features), x.base, x.n) for x in rows])


def find_pii(docs: DataFrame, model: dict[str, dict] | None = None, least: float = 0.5) -> DataFrame:
    """doc_id and spans (kind, start, stop, base) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_finder(train(docs) if model is None else model, least), "doc_id long, spans array<struct<kind:string,start:int,stop:int,base:boolean>>")
