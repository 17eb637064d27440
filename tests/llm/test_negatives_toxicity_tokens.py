"""Hard negatives, toxicity and token alignment against brute force, labels and the tokenizers' own libraries; edge cases of each."""

import hashlib
import html
import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrel.llm import hard_negatives, html_text, pii, queries, simhash_dedup, token_alignment, toxicity

A, B = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
VECTORS = "vec_id long, embedding array<float>, label int, extra string"


def text_order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


# Hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    dims = max((len(e) for _, e, _ in rows if e), default=0)
    able = [(v, [int(np.floor(256 * float(x))) for x in e] + [0] * (dims - len(e)), lab) for v, e, lab in rows if None not in (v, e, lab) and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, (anchor, q, label) in enumerate(able):
        if not is_anchor(anchor):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, r)), v, lab) for j, (v, r, lab) in enumerate(able) if j != i))
        for s, v, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(anchor, v, n + 1, w, -s, -t) for n, (t, w, _) in enumerate(fits[:negatives])]
    return text_order(out)


def mined(spark, rows, is_anchor=None, **more):
    docs = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    return text_order(tuple(r) for r in hard_negatives.mine(docs, F.col("vec_id") % 5 == 0 if is_anchor is None else is_anchor, **more).collect())


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    of = rng.integers(0, 6, n)
    x = centres[of] + rng.normal(size=(n, dims)) * 0.35
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, x[i].astype(np.float32).tolist(), int((of[i] + rng.integers(0, 3)) % 5)) for i in range(n)]


def test_negatives_against_brute_force(spark):
    rows = clustered(400, 12, 1)
    want = brute_negatives(rows, lambda v: v % 5 == 0)
    assert len(want) > 600
    assert mined(spark, rows) == want
    assert mined(spark, rows, members=4, anchor_rows=7, sample=30, first_share=3) == want  # many clusters, anchors in blocks


def test_negatives_of_odd_rows(spark):
    rows = clustered(60, 6, 2)
    nan, inf = float("nan"), float("inf")
    odd = [(None, rows[1][1], 1), (100, None, 1), (105, rows[2][1], None), (110, [nan] * 6, 1), (115, [inf] + [0.0] * 5, 1), (120, [None, *rows[0][1][1:]], 1), (125, [], 2), (130, [0.5], 2), (135, [0.0] * 6, 2), (-5, rows[3][1], 2)]
    ties = [(v, rows[4][1], lab) for v, lab in ((200, 1), (201, 1), (202, 2), (203, 1), (204, 3), (205, 1))]
    rows += odd + ties + [rows[5], rows[5], rows[6]]
    assert mined(spark, rows) == brute_negatives(rows, lambda v: v is not None and v % 5 == 0)
    assert mined(spark, []) == [] and mined(spark, rows, F.lit(False)) == [] and mined(spark, [(5, None, None)]) == []
    large = [(v, [float(x) * 2.0**18 for x in e], lab) for v, e, lab in clustered(40, 4, 3)]  # beyond what floats hold exactly
    assert mined(spark, large) == brute_negatives(large, lambda v: v % 5 == 0)
    with pytest.raises(Exception, match="64"):
        mined(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)])


def test_walks_end_early_and_bounds_hold():
    rows = clustered(3000, 8, 4)
    x = np.floor(256 * np.array([e for _, e, _ in rows], np.float64)).astype(np.int32)
    block = {"row": np.arange(3000), "vec_id": np.arange(3000), "label": np.array([lab for *_, lab in rows]), "vectors": x.astype(np.float32), "exact": x.astype(np.float64)}
    block["length"] = np.linalg.norm(block["exact"], axis=1)
    held = hard_negatives.centres(block["exact"][:200], 24)
    of = (block["exact"][:100] @ held.T).argmax(axis=1)
    walked = 0
    for c in np.unique(of):
        m = np.flatnonzero(of == c)
        cluster = hard_negatives.Cluster(held[c], m, block["label"][m], block["vectors"][m], np.full((len(m), 1), -(2.0**62)), np.full((len(m), 1), 2.0**62))
        scores = block["exact"][m] @ block["exact"].T
        assert (scores <= cluster.bounds(block["exact"], block["length"]) * cluster.length[:, None] + 1e-3).all()
        group, index, score, n = hard_negatives.walk(cluster, block, 5, True)
        walked += n
        for k, row in enumerate(m.tolist()):
            own = [(-scores[k, j], j) for j in range(3000) if j != row and block["label"][j] == block["label"][row]]
            assert [(-s, j) for j, s in zip(index[group == k].tolist(), score[group == k].tolist())] == sorted(own)[:5]
    assert walked < 0.75 * 100 * 3000


@pytest.mark.parametrize("name", ["op11_hard_negatives"])
def test_query(name, compare):
    compare(queries.queries()[name], queries.oracle_sql()[name])


# Toxicity


def paths(machines, symbols):
    """Symbols through the machines one after the other: what comes out, and each symbol's weight."""
    total = np.zeros(len(symbols))
    for machine in machines:
        symbols, weights = machine.run(symbols)
        total += weights
    return symbols, total.tolist()


def test_composition_against_cascade():
    machines = (toxicity.negation(), toxicity.threat(), toxicity.target(), toxicity.insult(), toxicity.reported())
    whole = toxicity.grammar()
    for symbols in itertools.product(toxicity.ALPHABET, repeat=5):
        out, weights = whole.run(symbols)
        want, sums = paths(machines, list(symbols))
        assert out == want and weights == pytest.approx(sums)


def test_clauses_and_not_words():
    model = toxicity.Grammar({"idiot$": 6.0, "zorgl": 6.0})
    score = model.score
    assert score("you are an idiot") > score("an idiot") > score("he said an idiot came") > score("she is not an idiot") == score("")
    assert score("i will kill you") > score("kill the process") == score(None)
    assert score("never. an idiot") == score("an idiot")  # a stop ends what a negator reaches
    assert score("you idiot zorglish") > score("you idiot") and score("Zorgles") == score("an idiot") and score("idiotic xzorgl") == score("")
    assert [(a, b) for a, b, _ in model.clauses("Fine; you IDIOT! fine")] == [(5, 15)]
    long = "idiot " * 200_000
    began = time.time()
    assert score(long) > 0.99 and score("a. " * 200_000 + "idiot") == score("idiot") and time.time() - began < 20


def test_lexicon_takes_the_longest_entry():
    lexicon = toxicity.Lexicon({"abcd": 1.0, "abcdef": 2.0, "abcde$": 3.0})
    assert [lexicon.of(w)[1] for w in ("abc", "abcd", "abcde", "abcdx", "abcdefg")] == [0.0, 1.0, 3.0, 1.0, 2.0]
    assert lexicon.of("not")[0] == "n" and lexicon.of("nothing") == (".", 0.0)
    hits = [m.start() for m in lexicon.triggers.finditer("abcd xabcd kill killer abc")]
    assert hits == [0, 11]


def toxic_rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("mo", "ta", "ri", "lu", "ke") for b in ("na", "so", "vi") for c in ("ter", "l", "mas", "dun")]
    rows, labels = [], []
    for i in range(n):
        w, toxic = rng.choice(vocabulary, 60).tolist(), i % 5 == 0
        if toxic:
            w[int(rng.integers(60))] = "grumf" + str(rng.choice(["a", "el", "ot"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_stems_are_learnt_and_held_out_rows_scored(spark, none_docs):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 450"), marks.filter("doc_id < 450"))
    assert "grumf" in model.stems and len(model.stems) <= len(toxicity.INSULTS) + 2
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, t in labels if i >= 450)
    again = [(1000 + i, f"{rows[0][1]} x{i}") for i in range(200)]  # near copies of one toxic row teach no words of it
    more = toxicity.fit(docs.unionByName(spark.createDataFrame(again, docs.schema)), marks.unionByName(spark.createDataFrame([(i, 1) for i, _ in again], marks.schema)))
    assert set(more.stems) == set(model.stems)
    assert toxicity.scores(none_docs, model).count() == 0
    for few in (marks.filter("toxic = 0"), marks.limit(0), marks.filter("doc_id < 8"), marks.withColumn("toxic", F.lit(None).cast("int"))):
        own = toxicity.fit(docs, few)
        assert own.score("you idiot") > own.score("fine words")


def test_toxicity_of_odd_rows(spark, sf_dir):
    labels = queries.table(spark, sf_dir, "labels")
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("x").alias("score"), F.lit("x").alias("toxic"), F.lit("x").alias("half"))
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, "you idiot", "x"), (1, None, "x"), (1, "", "x"), (2, "you idiot", "x"), (2, "you idiot", "x"), (3, "\x00 é 漢字 idiot", "x")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.score) for r in toxicity.scores(odd, model).collect()]
    by = dict(got)
    assert len(got) == 6 and by[None] == by[2] > by[1] and all(0 <= s <= 1 for _, s in got)
    out = queries.op12_toxicity(spark, sf_dir).collect()
    assert len(out) == queries.table(spark, sf_dir, "documents").count() and {r.predicted for r in out} == {0, 1}


@pytest.fixture(scope="module")
def none_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra string")


def test_toxicity_on_held_out_labels(spark):
    got = queries.op12_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    n = Counter((r.predicted, r.toxic) for r in got)
    assert n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.8 and n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.85
    assert np.mean([(r.score - r.toxic) ** 2 for r in got]) < 0.03


# Token alignment


def brute_alignment(rows):
    """By the tokenizers' own libraries on whole texts and a walk along both sides."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    signs = token_alignment.byte_signs()
    a_bytes = {i: bytes(signs[c] for c in s) for s, i in a_tok.get_vocab(with_added_tokens=False).items() if all(c in signs for c in s)}
    count, each = Counter(), []
    for doc, text in rows:
        each.append((doc, None))
        if not text:
            continue
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        pieces = [b_tok.id_to_piece(i) for i in b]
        of_a, of_b = [a_bytes[i] for i in a], [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
            continue
        a_at, b_at = ([0, *itertools.accumulate(map(len, of))] for of in (of_a, of_b))
        links, j = [], 0
        for i in range(len(a)):
            while j and b_at[j] > a_at[i]:
                j -= 1
            while b_at[j + 1] <= a_at[i]:
                j += 1
            k = j
            while k < len(b) and b_at[k] < a_at[i + 1]:
                links.append((a[i], b[k]))
                k += 1
        both = sorted(set(a_at) & set(b_at))
        groups = ";".join(",".join(str(x) for x, s in zip(a, a_at) if p <= s < q) + "|" + ",".join(str(x) for x, s in zip(b, b_at) if p <= s < q) for p, q in zip(both, both[1:])) if len(a) < 3000 else None
        count.update(links)
        each[-1] = (doc, (len(a), len(b), len(both) - 1, links, groups))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return text_order(
        (d, 0, 0, 0, 0, 0, 0, "") if r is None else (d, *r[:3], len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest() if r[4] is not None else None) for d, r in each
    )


ODD = [None, "", " ", "  a b", "a  b ", " a", "a\n\nb \n c", "x▁y z", "<|endoftext|> a <s> </s>", "a <|endoftext|>", "it's 's o 'll don't", "\x1c \x1d a", "日本 語 text", "é é è ê", "ﬁ ﬁ ﬀ", "a\tb c", "　 a 　b", "stop\r\n now", "🙂 🙂🙂 a", "a\x00b c", "a   b", "ab" * 3000, "12 345 6789 $$ %% --", "​ a ​", "﻿a b", "a ́b x ̀", "same", "same", " ".join(f"w{i % 97}" for i in range(20000))]


def same_rows(got, want):
    """Rows in one order; a digest that the brute force leaves out isn't compared."""
    got = text_order(tuple(r) for r in got)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(g[7] == w[7] for g, w in zip(got, want) if w[7] is not None)


def test_alignment_against_the_libraries(spark, none_docs):
    rows = [*enumerate(ODD), (500, ODD[10]), (None, ODD[13]), (None, None), (26, "same")]
    want = brute_alignment(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pair string, n_a int")
    same_rows(token_alignment.align(docs, A, B).collect(), want)
    same_rows(token_alignment.align(docs, A, B, block_pairs=50).collect(), want)  # counts in many blocks
    assert token_alignment.align(none_docs, A, B).count() == 0
    assert [tuple(r)[1:] for r in token_alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()] == [(0,) * 6 + ("",)] * 2


def test_alignment_of_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").filter("length(text) < 6000").collect()]
    docs = queries.table(spark, sf_dir, "documents").filter("length(text) < 6000")
    same_rows(token_alignment.align(docs, A, B).collect(), brute_alignment(rows))


def test_cached_pieces_change_nothing(monkeypatch):
    texts = [t for t in ODD if t and len(t) < 5000]
    whole = list(token_alignment.Aligner(A, B).align(texts))
    monkeypatch.setattr(token_alignment, "CACHED", 3)
    one = token_alignment.Aligner(A, B)
    each = [next(one.align([t])) for t in texts]
    uncut = token_alignment.Aligner(A, B)
    uncut.apart = False
    for a, b, c in zip(whole, each, uncut.align(texts), strict=True):
        for x, y, z in zip(a or (), b or (), c or (), strict=True):
            assert np.array_equal(x, y) and np.array_equal(x, z)
        assert (a is None) == (b is None) == (c is None)


# What earlier operators do with hostile and long texts


def test_phone_rule_is_linear():
    began = time.time()
    assert pii.loose_spans("012345678901234567890123456789x " * 4000, []) == []
    pii.loose_spans("0" + "1" * 300_000 + "x", [])
    pii.loose_spans("01 " * 60_000 + "x", [])
    pii.loose_spans("(01)" * 40_000 + "x", [])
    assert time.time() - began < 20


def test_added_spans_on_planted_rows(spark, sf_dir):
    """Precision and recall of what weak supervision adds to the base, in the given documents with numbers planted in them."""
    rng = np.random.default_rng(6)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    good = {
        "phone": lambda: f"({rng.integers(201, 990)}) {rng.integers(201, 999)}-{digits(4)}",
        "email": lambda: f"{rng.choice(['ann', 'joe', 'eva'])}{digits(2)} [at] host{digits(2)} [dot] {rng.choice(['com', 'org', 'de'])}",
        "ip": lambda: f"2001:db8:{rng.integers(1, 9999)}::{rng.integers(1, 9999)}",
    }
    bad = [lambda: f"{rng.integers(10, 28)}.{rng.integers(10, 12)}.20{rng.integers(10, 24)}", lambda: f"{rng.integers(10, 23)}:{rng.integers(10, 59)}:{rng.integers(10, 59)}", lambda: f"isbn {digits(10)}"]
    planted, rows = {}, []
    for r in queries.table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        text, own = r.text or "", []
        for kind, make in good.items():
            if rng.random() < 0.5:
                span = make()
                text += f"\n{ {'phone': 'call', 'email': 'mail', 'ip': 'host'}[kind] } "
                own.append((kind, len(text), len(text) + len(span)))
                text += span + " today"
        for make in bad:
            text += f"\non {make()} again"
        planted[r.doc_id] = own
        rows.append((r.doc_id, text))
    found = {r.doc_id: {(s.kind, s.start, s.stop) for s in r.spans if not s.base} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(s in found[d] for d, own in planted.items() for s in own)
    assert hits / sum(map(len, planted.values())) >= 0.95
    assert hits / sum(map(len, found.values())) >= 0.8


def test_near_copies_in_blocks_of_bytes(spark):
    rng = np.random.default_rng(12)
    words = [f"v{i}" for i in range(5000)]
    rows = []
    for g in range(3):
        original = rng.choice(words, 4000).tolist()
        for k in range(12):
            copy = list(original)
            for at in rng.choice(4000, 6, replace=False):
                copy[at] = f"own{k}"
            rows.append((g * 100 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (128 << 20, 100_000):  # three texts a block
        got = {r.doc_id: r.component_id for r in simhash_dedup.similar_texts(docs, group_bytes=size).collect()}
        assert all(c == d - d % 100 for d, c in got.items())


def test_stars_join_what_links_join():
    rng = np.random.default_rng(21)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), rng.integers(0, 2**64, 300, dtype=np.uint64)]))
    for size in (4096, 8):
        links, stars = simhash_dedup.tree_links(fps, 2), list(simhash_dedup.tree_stars(fps, 2, size))
        assert dict(simhash_dedup._stars(links)) == dict(simhash_dedup._stars(stars)) and len(links) > 400
    dense = np.array([base[0] ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(33) for j in range(i)], np.uint64)  # each two within four bits, many within two
    assert len(list(simhash_dedup.tree_stars(dense, 2))) == len(dense) - 1 < len(simhash_dedup.tree_links(dense, 2)) / 10


def test_extraction_gives_each_page_its_own_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in queries.table(spark, sf_dir, "pages").collect()}
    for r in queries.op7_html_text(spark, sf_dir).collect():
        own = re.search(r"<article[^>]*>(.*?)</article>", pages[r.page_id], re.S)[1]
        own = re.sub(r"<!--.*?-->|<(script|style|aside|nav|form|footer)\b.*?</\1>", "", own, flags=re.S)
        assert "".join(r.text.split()) == "".join(html.unescape(re.sub(r"<[^<>]*>", "", own)).split())


def test_names_of_subjects_yield_to_evidence():
    text = lambda x: html_text.main_text(x, None)
    article = "<body><article><p>The long first paragraph of the article.</p>{}<p>And the second one.</p></article>{}</body>"
    whole = "The long first paragraph of the article. {}And the second one."
    for own, kept in (("<div class='banner'><p>The city's banner shows a bear on gold.</p></div>", "The city's banner shows a bear on gold. "), ("<section class='share'>Share of the vote by party</section>", "Share of the vote by party "), ("<div id=social-main><p>Social work began in the parishes.</p></div>", "Social work began in the parishes. ")):
        assert text(article.format(own, "")) == whole.format(kept)
    for no in ("<div class='banner'>Sale!</div>", "<div class='share'>Share: <a href=x>on one network</a> <a href=y>on another</a></div>", "<div class='social-links'><a href=x>follow us all over the place</a></div>", "<div class='sponsored banner'><p>Bears of gold, now cheaper than ever before.</p></div>"):
        assert text(article.format(no, "")) == whole.format("")
    assert text(article.format("", "<div class='banner'><p>A banner that is outside of the article.</p></div>")) == whole.format("")


def test_quality_scores_are_calibrated(spark):
    """Held-out rows: the Brier score, and in each bin of scores the share of good rows near the mean score."""
    got = queries.op8_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    s, y = np.array([r.score for r in got]), np.array([r.quality for r in got], float)
    assert len(got) > 600 and np.mean((s - y) ** 2) < 0.05 < np.mean((y.mean() - y) ** 2)
    of = np.minimum((s * 5).astype(int), 4)
    error = sum(abs(s[of == k].mean() - y[of == k].mean()) * (of == k).sum() for k in np.unique(of)) / len(s)
    assert error < 0.08
