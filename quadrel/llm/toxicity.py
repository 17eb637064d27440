"""Operator 12. Toxicity by a weighted finite-state pattern grammar.

A lexicon reads words and gives classes (insult, threat, target, negator, reporting verb, other) with the weight of an insult. Five
sequential transducers read classes and give classes and weights: negation takes back what stands within three words after a negator;
threat needs someone threatened nearby; target adds weight to an insult near a person; insult adds weight where insults pile up;
reported speech takes weight from what is told of others. They are composed once into one table of states. A clause (up to a
stop, colon, semicolon or line end) is scored by the path that its words take: the sum of the arcs and of the insults that still
count, so the same word weighs differently when aimed at someone, denied or reported. A text's score comes from the
heaviest clause and the sum over clauses by a logistic fit.

The lexicon has fixed words of four languages, and stems learnt from labels: beginnings of four to ten letters, or whole words,
that are `LEAST_WEIGHT` more likely (log-odds) in toxic rows and too often so for chance among all beginnings counted.
Learning takes a bounded sample: at most `per_class` labelled rows of each class, the first by a hash of doc_id, near copies (of one least
hash of five-word windows) once. One half gives stems, counted in Spark; the other half calibrates, and the shares of the classes among all
labels set the intercept. Everything is scored, over whole texts, from texts alone.

Null texts count as empty; empty texts score as those without a match. Null labels and doc_ids are not learnt from; where labels of
a doc_id differ, each counts. With too few labels of a class to calibrate, stated weights serve. Repeated rows score alike, empty
tables give empty results, other columns are ignored. Long clauses take time by their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WindowHash, flat, stored, text_batches
from .quality import _logistic

#: Fixed words in English, German, French and Spanish.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers trash scum clown worthless pathetic disgusting dumb fool imbecile dummkopf trottel abschaum versager widerlich crétin imbécile ordure nul minable estúpido imbécil basura inútil asqueroso".split())
THREATS = frozenset("kill killed hurt destroy murder beat strangle shoot stab töten umbringen schlagen vernichten tuer tuerai détruire frapper matar mataré destruir golpear".split())
TARGETS = frozenset("you your you're u he she they him her them his their du dich dir dein deine ihr euch sie ihn tu te toi ton ta vous votre il elle ils eux usted ustedes tú ti él ella ellos".split())
NEGATORS = frozenset("not no never nobody isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say called calls quoted quotes wrote writes told claims claimed reported sagte sagt nannte schrieb zitierte dit disait appelé écrit cite dijo dice llamó escribió cita".split())

OTHER = "."
#: What counts with its insult's own weight when all transducers have read it.
COUNTED = frozenset("idq")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
ENDS = re.compile(r"[.!?;:\n]")
LENGTHS = range(4, 11)
LEAST_WEIGHT = 3.0
#: Intercept, heaviest clause, sum of clauses: used until labels say better.
STATED = [-2.5, 0.9, 0.0]


class Transducer:
    """Of each state and symbol: the symbol given, a weight, the next state. Symbols without an arc pass at no weight, to the state that `fade` names, else the start."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, float, str]], fade: dict[str, str] | None = None, start: str = "0"):
        self.arcs, self.fade, self.start = arcs, fade or {}, start

    def step(self, state: str, symbol: str) -> tuple[str, float, str]:
        return self.arcs.get((state, symbol)) or (symbol, 0.0, self.fade.get(state, self.start))

    def run(self, symbols: Iterable[str]) -> tuple[list[str], list[float]]:
        state, out, weights = self.start, [], []
        for x in symbols:
            y, w, state = self.step(state, x)
            out.append(y)
            weights.append(w)
        return out, weights


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that gives what `second` makes of what `first` gives; weights add up. States that can't be reached are left out."""
    start, arcs = (first.start, second.start), {}
    todo, seen = [start], {start}
    while todo:
        a, b = todo.pop()
        for x in alphabet:
            y, v, a2 = first.step(a, x)
            z, w, b2 = second.step(b, y)
            arcs[(a, b), x] = (z, v + w, (a2, b2))
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(arcs, start=start)


def within(mark: str, words: int) -> tuple[dict[tuple[str, str], tuple[str, float, str]], dict[str, str], list[str]]:
    """Arcs that remember `mark` for so many words after it, the fading of that memory, and the states that remember."""
    states = [f"{mark}{k}" for k in range(words, 0, -1)]
    fade = dict(zip(states, [*states[1:], "0"], strict=True))
    return {(s, mark): (mark, 0.0, states[0]) for s in ("0", *states)}, fade, states


def negation(words: int = 3) -> Transducer:
    arcs, fade, states = within("n", words)
    return Transducer(arcs | {(s, x): (OTHER, 0.0, "0") for s in states for x in "it"}, fade)


def threat(words: int = 4, weight: float = 5.0) -> Transducer:
    """A verb of violence counts where a person stands before it or after it."""
    before, fade, after_y = within("y", words)
    after, fade_t, after_t = within("t", words)
    arcs = before | after | {(s, "t"): ("T", weight, "0") for s in after_y} | {(s, "y"): ("T", weight, after_y[0]) for s in after_t}
    return Transducer(arcs, fade | fade_t)


def target(words: int = 4, weight: float = 1.5) -> Transducer:
    before, fade, after_y = within("y", words)
    after, fade_i, after_i = within("i", words // 2)
    arcs = before | after | {(s, "i"): ("d", weight, s) for s in after_y} | {(s, "y"): ("y", weight, after_y[0]) for s in after_i}
    return Transducer(arcs, fade | fade_i)


def insult(words: int = 3, weight: float = 0.5) -> Transducer:
    """Insults that follow each other weigh more."""
    one, fade, states = within("i", words)
    arcs = {(s, x): (x, weight * (s != "0"), states[0]) for s in ("0", *states) for x in "id"}
    return Transducer(one | arcs, fade)


def reported(weight: float = -2.0) -> Transducer:
    arcs = {(s, "r"): ("r", 0.0, "r") for s in "0r"} | {("r", x): ("q" if x in "id" else OTHER, weight, "r") for x in "idT"}
    return Transducer(arcs, {"r": "r"})


ALPHABET = ".itynr"


def grammar() -> Transducer:
    return reduce(lambda a, b: compose(a, b, ALPHABET), (negation(), threat(), target(), insult(), reported()))


class Lexicon:
    """Words and stems as a tree of letters: of a word the class and weight of its longest entry. A whole word's entry ends in "$"."""

    def __init__(self, stems: dict[str, float]):
        self.root: dict = {}
        for cls, entries in (("r", REPORTS), ("n", NEGATORS), ("y", TARGETS), ("t", THREATS)):
            for word in entries:
                self._add(f"{word}$", cls, 0.0)
        for stem, weight in stems.items():
            self._add(stem, "i", weight)
        self.triggers = re.compile(rf"(?<![^\W\d_])(?:{self._rule(self._tree([*stems, *(f'{w}$' for w in THREATS)]))})") if stems or THREATS else None

    def _add(self, entry: str, cls: str, weight: float) -> None:
        node = self.root
        for c in entry:
            node = node.setdefault(c, {})
        node[""] = (cls, weight)

    @staticmethod
    def _tree(entries: Iterable[str]) -> dict:
        root: dict = {}
        for entry in entries:
            node = root
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = True
        return root

    @classmethod
    def _rule(cls, node: dict) -> str:
        """One regular expression without common beginnings."""
        if "" in node:
            return ""
        parts = [(r"(?![^\W\d_])" if c == "$" else re.escape(c)) + cls._rule(below) for c, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    def of(self, word: str) -> tuple[str, float]:
        node, found = self.root, (OTHER, 0.0)
        for c in word:
            node = node.get(c)
            if node is None:
                return found
            found = node.get("", found)
        return node["$"][""] if "$" in node else found


class Grammar:
    def __init__(self, stems: dict[str, float], weights: list[float] | None = None):
        self.lexicon, self.weights, self.stems = Lexicon(stems), weights or STATED, stems
        made = grammar()
        number = {s: i for i, s in enumerate(dict.fromkeys([made.start, *(s for s, _ in made.arcs)]))}
        self.table = [{} for _ in number]
        for (s, x), (y, w, t) in made.arcs.items():
            self.table[number[s]][x] = (y in COUNTED, w, number[t])

    def clause(self, words: list[str]) -> float:
        state, total, of = 0, 0.0, self.lexicon.of
        for word in words:
            cls, own = of(word)
            counted, w, state = self.table[state][cls]
            total += w + own * counted
        return max(0.0, total)

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """Start, end and weight of each clause that holds an insult or a verb of violence; places are of the text in lower case."""
        low, end = (text or "").lower(), 0
        for m in self.lexicon.triggers.finditer(low) if self.lexicon.triggers else ():
            if m.start() < end:
                continue
            start = max(end, *(low.rfind(c, end, m.start()) + 1 for c in ".!?;:\n"))
            stop = ENDS.search(low, m.start())
            end = stop.start() if stop else len(low)
            if (w := self.clause(WORDS.findall(low, start, end))) > 0:
                yield start, end, w

    def features(self, text: str | None) -> list[float]:
        found = [w for _, _, w in self.clauses(text)]
        return [max(found, default=0.0), math.log1p(sum(found))]

    def score(self, text: str | None) -> float:
        b, *w = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(x * y for x, y in zip(w, self.features(text), strict=True))))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each half and class hold a beginning."""
    for table in text_batches(batches, limit=1 << 20):
        n: Counter = Counter()
        for half, toxic, text in zip(table["half"].to_pylist(), table["toxic"].to_pylist(), table["text"], strict=True):
            words = set(WORDS.findall((text.as_py() or "").lower()))
            entries = {w[:k] for w in words for k in LENGTHS if len(w) >= k} | {f"{w}$" for w in words if len(w) >= 3}
            n.update((e, half, toxic) for e in entries)
        if n:
            entry, half, toxic = zip(*n, strict=True)
            yield pa.RecordBatch.from_pydict({"entry": entry, "half": half, "toxic": toxic, "n": list(n.values())}, pa.schema([("entry", pa.string()), ("half", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())]))


def stems_of(counts: dict[str, tuple[int, int]], toxic: int, clean: int, entries: int) -> dict[str, float]:
    """counts: entry -> toxic and clean texts that hold it. The fixed insults and the shortest stems that are sure, with their weights."""
    share, out = toxic / max(1, toxic + clean), {}

    def weight(t: int, c: int) -> float:
        return math.log((t + 1) / (toxic + 2)) - math.log((c + 0.05) / (clean + 2))

    def sure(t: int, c: int) -> bool:
        """By the bound of large deviations, over all entries that were counted."""
        p = t / (t + c)
        if p <= share:
            return False
        kl = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
        return weight(t, c) >= LEAST_WEIGHT and (t + c) * kl >= math.log(max(2, entries)) + 5

    good = {e: tc for e, tc in counts.items() if sum(tc) and sure(*tc)}
    longest: Counter = Counter()  # of each beginning the most toxic texts that a longer entry holds
    for e, (t, _) in good.items():
        for k in range(1, len(e)):
            longest[e[:k]] = max(longest[e[:k]], t)
    for e in sorted(good, key=len):
        if longest[e] < 0.95 * good[e][0] and not any(e[:k] in out for k in range(1, len(e))):
            out[e] = min(8.0, weight(*good[e]))
    for word in INSULTS:
        if not any(word[:k] in out for k in range(1, len(word) + 1)):
            out.setdefault(f"{word}$", max(0.0, min(8.0, weight(*counts.get(f"{word}$", (0, 0))))))
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, stems: int = 5000) -> Grammar:
    """docs: doc_id, text; labels: doc_id, toxic. The driver gets at most `stems` counted entries and two numbers for each calibrating text."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit("toxic"))
    drawn = known.filter("toxic = 0").orderBy(order, "doc_id").limit(per_class).unionByName(known.filter("toxic = 1").orderBy(order, "doc_id").limit(per_class))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHash(5)
        for table in text_batches(batches):
            h = [hasher(flat(t.as_py()).lower())[2] for t in table["text"]]
            name = pa.array([int(x.min().view(np.int64)) if len(x) else None for x in h], pa.int64())
            yield from table.append_column("least", name).combine_chunks().to_batches()

    named = stored(rows.mapInArrow(least, "doc_id long, text string, toxic int, least long").withColumn("least", F.coalesce("least", F.xxhash64("text"))), "labelled")
    one = named.groupBy("toxic", "least").agg(F.min("doc_id").alias("doc_id"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sample = stored(named.join(F.broadcast(one), ["toxic", "least", "doc_id"]).select("toxic", "text", half.alias("half")), "sample")
    sizes = {(x.half, x.toxic): x.n for x in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sum(sizes.get((h, k), 0) for h in (0, 1)) for k in (1, 0))
    if not toxic or not clean:
        return Grammar(stems_of({}, toxic, clean, 0))
    cells = [((F.col("half") == h) & (F.col("toxic") == k)) for h in (0, 1) for k in (1, 0)]
    counts = sample.mapInArrow(_counted, "entry string, half int, toxic int, n long")
    counts = stored(counts.groupBy("entry").agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for c, n in zip(cells, ("t0", "c0", "t1", "c1"), strict=True))), "entries")
    entries = counts.count()
    t, c, fixed = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), F.col("entry").isin([f"{w}$" for w in INSULTS])
    # Entries of fewer toxic texts than any sure one has, or of too many clean ones in both halves, needn't come.
    few = (math.log(max(2, entries)) + 5) / math.log((toxic + clean) / toxic)
    wanted = counts.filter(fixed | ((t >= few / 2) & (t * (clean + 2) >= 5 * c * (toxic + 2))))
    got = wanted.orderBy(~fixed, F.desc(t), "entry").limit(stems).collect()

    def learnt(halves: tuple[int, ...]) -> dict[str, float]:
        found = {x.entry: tuple(sum(x[f"{k}{h}"] for h in halves) for k in "tc") for x in got}
        return stems_of(found, *(sum(sizes.get((h, k), 0) for h in halves) for k in (1, 0)), entries)

    by_half, both = [learnt((h,)) for h in (0, 1)], learnt((0, 1))
    if toxic < 16 or clean < 16:
        return Grammar(both)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Grammar(by_half[1 - h]) for h in (0, 1)]
        for table in text_batches(batches):
            x = [own[h].features(t.as_py()) for h, t in zip(table["half"].to_pylist(), table["text"], strict=True)]
            yield pa.RecordBatch.from_arrays([table["toxic"].combine_chunks(), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rest = sorted(sample.mapInArrow(measure, "toxic int, x array<double>").collect(), key=lambda r: (r.toxic, r.x))
    w = _logistic(np.array([r.x for r in rest]), np.array([r.toxic for r in rest], float), ridge=1e-5)
    of = {x.toxic: x.n for x in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    w[0] += math.log(of[1] / of[0]) - math.log(toxic / clean)
    return Grammar(both, w.tolist())


def scores(docs: DataFrame, model: Grammar) -> DataFrame:
    """doc_id and score (0 to 1; higher: toxic is likelier)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((model.stems, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*held.value)
        for table in text_batches(batches):
            s = pa.array([own.score(t.as_py()) for t in table["text"]], pa.float64())
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), s], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")
