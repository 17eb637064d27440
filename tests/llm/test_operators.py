"""Corpus operators against brute force, on edge cases, and on held-out labels."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quadrel.llm import decontaminate, exact_dedup, html_text, mixing, pii, quality, queries, secrets, simhash_dedup, substring_dedup, token_rollup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"
LONG = " ".join(f"w{i % 97}" for i in range(30000))
RUN = " ".join(f"r{i}" for i in range(25))
TEXTS = [None, "", " \t\n", "a", "A", "a  b", "a b", "a\nb", RUN, f"x {RUN} y", f"{RUN} {RUN}", LONG, LONG, "to " * 60, "é\x0bü ø", "word joined", RUN.upper()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and an extra column."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[8], (None, "null id", "en", "s1", 7, "extra")], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repeats(rows, width):
    """Per row, in the order of rows: words, words removed, what is kept. Rows without an id: their text's hash stands in, as in Spark."""

    def place(doc, text, i):
        return (1, doc, 0, i) if doc is not None else (0, *signed_hashes(text), i)

    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            key, at = tuple(w[i : i + width]), place(doc, text, i)
            first[key] = min(first.get(key, at), at)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = {i + k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < place(doc, text, i) for k in range(width)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def signed_hashes(text):
    one = xxhash.xxh64_intdigest(text.encode(), 42)
    two = xxhash.xxh64_intdigest(text.encode(), one)
    return tuple(x - (x >> 63 << 64) for x in (one, two))


def removed(docs, width, **more):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, width, **more).collect()), key=str)


def test_substring_dedup(odd, none):
    want = brute_repeats([(r.doc_id, r.text) for r in odd.collect()], 5)
    assert removed(odd, 5) == want
    assert removed(odd, 5, max_log2_cells=12) == want  # a full sketch costs work, never a repeat
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_shared_and_null_ids(spark, monkeypatch):
    alone = " ".join(f"u{i}" for i in range(40))
    docs = spark.createDataFrame([(1, RUN), (5, RUN), (5, alone), (5, f"a {RUN}"), (5, RUN), (None, f"n {RUN}"), (None, f"{RUN} m"), (None, f"{RUN} m"), (None, None), (9, alone)], "doc_id long, text string")
    got = removed(docs, 20)
    assert got == brute_repeats([tuple(r) for r in docs.collect()], 20)
    assert (5, 40, 0, alone) in got and (9, 40, 40, "") in got
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", -1)  # all rows named by their texts
    assert removed(docs, 20) == got
    only = docs.filter("doc_id is null or doc_id = 5")
    assert removed(only, 20) == brute_repeats([tuple(r) for r in only.collect()], 20)


def test_extra_columns_with_clashing_names(spark, sf_dir):
    """Columns that the operators use themselves change no result."""
    docs = queries.table(spark, sf_dir, "documents").limit(60)
    names = "_key row row2 cuts key h n norm salt salts hot front low size members score fp node bucket blob spans component_id copies taken target source_size tokens _row".split()
    clash = docs.select("*", *(F.lit("x").alias(n) for n in names))
    bench, labels = queries.table(spark, sf_dir, "benchmark"), queries.table(spark, sf_dir, "labels")
    model = queries.quality_model(docs, labels)
    same = {
        "repeats": substring_dedup.remove_repeats, "copies": exact_dedup.mark_copies, "near": simhash_dedup.near_copies, "leaks": lambda d: decontaminate.contaminated(d, bench.withColumn("doc_id", F.lit(1))),
        "pii": pii.find_pii, "secrets": secrets.find_secrets, "mix": mixing.mixed, "tokens": lambda d: token_rollup.count_tokens(d, queries.VOCABULARY, "v"), "quality": lambda d: quality.scores(d, model).select("doc_id", "score"),
    }
    for what, operator in same.items():
        assert sorted(map(str, operator(clash).collect())) == sorted(map(str, operator(docs).collect())), what
    pages = queries.table(spark, sf_dir, "pages").limit(40)
    assert sorted(map(str, html_text.extract(pages.select("*", *(F.lit("x").alias(n) for n in ("host", "path", "text", "salt"))))  .collect())) == sorted(map(str, html_text.extract(pages).collect()))
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, clash, sf_dir), stage(spark, docs, sf_dir)
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in want.select("doc_id").collect()), name
        assert name == corpus_pipeline.STAGES[-1][0] or got.columns == clash.columns


def test_exact_dedup(odd, none):
    want, norm = {}, lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r.doc_id, norm(r.text)) for r in odd.collect()]
    for share in (0.25, 1e-9):
        got = exact_dedup.mark_copies(odd, keep=("row",), share=share).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [d for d, t in rows if t == r.norm]
            keep = min(same, key=lambda d: -1 if d is None else d)
            assert (r.keep_id, r.group_size, r.carried_row, r.text_sha256) == (keep, len(same), "extra", hashlib.sha256(r.norm.encode()).hexdigest())
        for t in {t for _, t in rows}:
            want[t] = [r for r in got if r.norm == t and r.kept]
            assert len(want[t]) == 1 and want[t][0].doc_id == want[t][0].keep_id
    assert exact_dedup.mark_copies(none).count() == 0


def test_exact_dedup_hot_group(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 6).cast("string"))).alias("text")).withColumnRenamed("id", "doc_id")
    got = exact_dedup.mark_copies(rows, partitions=64)
    hot = got.filter("norm = 'hot text'")
    assert hot.filter("keep_id = 0 and group_size = 3000").count() == 3000
    assert [r.doc_id for r in hot.filter("kept").collect()] == [0]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def test_simhash(spark, sf_dir, none):
    docs = queries.table(spark, sf_dir, "documents")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    got = simhash_dedup.near_copies(docs).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)
    assert simhash_dedup.near_copies(none).count() == 0


def test_simhash_odd(odd):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_copies(odd).collect()}
    assert got[0] == got[1] == got[2] == ("0" * 16, 0)
    assert got[4][0] == got[3][0] and got[16][1] == 8


def test_trees_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 64, 6)), *(base ^ np.uint64(3 << int(k)) for k in rng.integers(0, 60, 4))]))
    want = {(max(int(a), int(b)), min(int(a), int(b))) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 2}
    assert simhash_dedup.tree_links(fps, 2) == want
    assert simhash_dedup.tree_links(fps, 2, tree_size=8) == want


def test_wide_trees_keep_components():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (12, 8), dtype=np.uint64)
    near = [b ^ np.packbits(rng.random((8, 64)) < p, axis=1).view(np.uint64)[:, 0] for b in base for p in (0.02, 0.05, 0.1, 0.1, 0.12)]
    fps = rng.permutation(np.concatenate([base, near]))
    for radius in (40, 88, 120):
        parent = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius:
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if x in (a, b) else x for x in parent]
        got = dict(simhash_dedup.tree_components(fps, radius))
        assert [got.get(i, i) for i in range(len(fps))] == parent


def test_similar_texts(spark, odd, none):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, k = [], 0
    for g in range(60):
        original = rng.choice(vocabulary, 300).tolist()
        rows.append((k, " ".join(original)))
        for change in (3, 5):  # at most 5 shingles lost and gained for each changed word: a similarity of 0.84 or more
            copy = list(original)
            for at in rng.choice(300, change, replace=False):
                copy[at] = "changed"
            rows.append((k + change, "  ".join(copy).upper()))
        rows.append((k + 1, " ".join(original[:120] + rng.choice(vocabulary, 180).tolist())))  # similar at 0.25
        k += 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard_rows in (200_000, 1):
        got = {r.doc_id: r.component_id for r in simhash_dedup.similar_texts(docs, shard_rows=shard_rows).collect()}
        assert all(got[d] == d for d in got if d % 10 in (0, 1))
        caught = [got[d] == d - d % 10 for d in got if d % 10 in (3, 5)]
        assert len(caught) == 120 and np.mean(caught) >= 0.97
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_texts(odd).collect()}
    assert found[0] == found[1] == found[2] == 0 and found[4] == 3 and found[6] == found[7] == 5 and found[12] == 11 and found[13] == 13
    assert simhash_dedup.similar_texts(none).count() == 0


def test_similar_texts_around_the_threshold(spark, none):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = []
    for n in (8, 9, 14, 40, 300):
        for _ in range(30):
            original = rng.choice(vocabulary, n).tolist()
            texts.append(original)
            for own in (n // 12, n // 9, n // 7, n // 5):  # other words at one end: similar at some 0.6 to 0.9
                texts += [original[own:], original[: n - own] + rng.choice(vocabulary, own).tolist()]
    texts += [["x"] * 3, ["x"] * 2, []]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)} for t in texts]
    want = list(range(len(texts)))
    near = {True: 0, False: 0}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (shared := len(a & b)) and 0.6 < (s := shared / len(a | b)) < 0.9:
                near[s >= 0.8] += 1
            if shared and s >= 0.8 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert min(near.values()) > 200
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for sizes in ({}, {"shard_rows": 2, "group_rows": 2}):
        got = {r.doc_id: r.component_id for r in simhash_dedup.similar_texts(docs, **sizes).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_token_rollup(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "en", "a"), (2, None, "en", "a"), (3, "drei", None, None)], "doc_id long, text string, lang string, source string")
    roll = token_rollup.Rollup(spark, str(tmp_path / "r"))
    count = lambda d: token_rollup.count_tokens(d, queries.VOCABULARY, "v1")
    load = docs.select(F.lit("insert").alias("op"), "doc_id")
    assert roll.commit("a", load, count(docs)) and not roll.commit("a", load, count(docs))
    got = {(r.source, r.lang): (r.documents, r.words, r.characters) for r in roll.totals().collect()}
    assert got == {("a", "en"): (2, 2, 7), (None, None): (1, 1, 4)}
    new = spark.createDataFrame([(1, "one two three", "fr", "a")], docs.schema)
    edits = spark.createDataFrame([("revise", 1), ("delete", 3), ("delete", 99)], "op string, doc_id long")
    assert roll.commit("b", edits, count(new)) and not roll.commit("b", edits, count(new))
    got = {(r.source, r.lang): (r.documents, r.words) for r in roll.totals().collect()}
    assert got == {("a", "en"): (1, 0), ("a", "fr"): (1, 3)}


def test_token_rollup_odd(spark, tmp_path, odd, none):
    roll = token_rollup.Rollup(spark, str(tmp_path / "odd"))
    counts = token_rollup.count_tokens(odd, queries.VOCABULARY, "v1")
    load = odd.select(F.lit("insert").alias("op"), "doc_id", "row")
    assert roll.commit("load", load, counts)
    rows = {tuple(r) for r in odd.select("doc_id", "source", "text").collect()}  # the repeated row once
    want = {}
    for _, source, text in rows:
        n = want.get(source, (0, 0, 0))
        want[source] = (n[0] + 1, n[1] + len(words(text)), n[2] + len(text or ""))
    assert {r.source: (r.documents, r.words, r.characters) for r in roll.totals().collect()} == want
    assert roll.commit("nothing", load.limit(0), counts) and roll.commit("none", none.select(F.lit("delete").alias("op"), "doc_id"), token_rollup.count_tokens(none, queries.VOCABULARY, "v1"))
    for bad in ([("insert", 1), ("delete", 1)], [(None, 1)], [("remove", 1)]):
        with pytest.raises(Exception, match="no single known operation"):
            roll.commit("bad", spark.createDataFrame(bad, "op string, doc_id long"), counts)
        assert not roll.committed("bad")
    assert {r.source: (r.documents, r.words, r.characters) for r in roll.totals().collect()} == want
    assert roll.commit("all away", odd.select(F.lit("delete").alias("op"), "doc_id"), counts) and roll.totals().count() == 0


def test_token_rollup_shared_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "en", "a"), (1, "six ten", "en", "a"), (None, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    roll = token_rollup.Rollup(spark, str(tmp_path / "shared"))
    roll.commit("a", docs.select(F.lit("insert").alias("op"), "doc_id"), token_rollup.count_tokens(docs, queries.VOCABULARY, "v1"))
    assert [(r.documents, r.words) for r in roll.totals().collect()] == [(3, 5)]


def test_token_rollup_query_against_brute_force(spark, sf_dir):
    import tiktoken

    own = tiktoken.Encoding("x", pat_str=token_rollup.PIECES, mergeable_ranks=token_rollup.ranks(queries.VOCABULARY), special_tokens={})
    labels = queries.table(spark, sf_dir, "labels").collect()
    gone, low = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    want = {}
    for r in queries.table(spark, sf_dir, "documents").collect():
        if r.doc_id not in gone:
            text = re.sub(r"[!$%&*#|]+", "", r.text or "") if r.doc_id in low else r.text or ""
            n = want.get((r.source, r.lang), (0, 0, 0, 0))
            want[r.source, r.lang] = tuple(a + b for a, b in zip(n, (1, len(own.encode_ordinary(text)), len(words(text)), len(text))))
    assert gone and low and {(r.source, r.lang): (r.documents, r.tokens, r.words, r.characters) for r in queries.op3_token_rollup(spark, sf_dir).collect()} == want


def test_changed_documents_by_either_join(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], "doc_id long, text string")
    edits = spark.createDataFrame([("revise", 1), ("delete", 2), ("insert", None)], "op string, doc_id long")
    for most in (4_000_000, 0):
        assert sorted(r.text for r in token_rollup.changed(docs, edits, most).collect()) == ["a", "c"]


def test_bit_counts():
    rng = np.random.default_rng(9)
    for n in (1, 254, 255, 256, 4080, 4081, 9000):
        h = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        h[:, : n // 2] = 2**64 - 1  # full lanes
        want = [[int(((x >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)] for x in h]
        assert simhash_dedup.bit_counts(h).tolist() == want and simhash_dedup.bit_counts(h[1]).tolist() == want[1]


def test_tokens_against_the_library(spark, sf_dir):
    import tiktoken

    docs = queries.table(spark, sf_dir, "documents").limit(20)
    own = tiktoken.Encoding("x", pat_str=token_rollup.PIECES, mergeable_ranks=token_rollup.ranks(queries.VOCABULARY), special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_rollup.count_tokens(docs, queries.VOCABULARY, "v").collect():
        assert own.decode(own.encode_ordinary(texts[r.doc_id])) == texts[r.doc_id]
        assert r.tokens == len(own.encode_ordinary(texts[r.doc_id]))


def test_tiling():
    item = "a b c d e f g h i j k l".split()
    assert sum(t[0] for t in decontaminate.tiles(item, item, 5)) == 12
    moved = "g h i j k l x a b c d e f".split()
    assert sorted(t[0] for t in decontaminate.tiles(item, moved, 5)) == [6, 6]
    assert decontaminate.tiles(item, "l k j i h g f e d c b a".split(), 5) == []
    assert sum(t[0] for t in decontaminate.tiles(["a"] * 40, ["a"] * 17, 5)) == 17


def brute_tiles(item, text, least):
    used_i, used_j, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and i + k not in used_i and j + k not in used_j:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        used_i |= set(range(i, i + k))
        used_j |= set(range(j, j + k))
        out.append(best)


def test_tiling_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(400):
        letters = list("abcdefgh"[: rng.integers(1, 9)])
        item, text = rng.choice(letters, rng.integers(0, 30)).tolist(), rng.choice([*letters, None], rng.integers(0, 60)).tolist()
        got = decontaminate.tiles(item, text, 2)
        want = brute_tiles(item, [object() if x is None else x for x in text], 2)
        assert got == want, (item, text)


def plain_words(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (text or "").lower()).split(" ")


def test_decontamination_against_brute_force(spark, sf_dir):
    """All documents against all items: every shared run of five words is a candidate, tiled by brute force."""
    docs, bench = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    items = {r.item_id: [w for w in plain_words(r.text) if w] for r in bench.collect()}
    want = {}
    for r in docs.collect():
        w = [x for x in plain_words(r.text.replace("\n", " ").replace("\t", " ")) if x]
        seeds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, item in items.items():
            own = {i + d for i in range(len(item) - 4) if tuple(item[i : i + 5]) in seeds for d in range(5)}
            if len(own) >= 0.6 * len(item):
                n = sum(t[0] for t in brute_tiles(item, w, 5))
                if n >= 0.6 * len(item):
                    want[r.doc_id, k] = round(n / len(item), 9)
    assert want and {(r.doc_id, r.item_id): round(r.coverage, 9) for r in queries.op5_decontaminate(spark, sf_dir).collect()} == want


def test_decontamination_of_repetitive_and_long_texts():
    import time

    began = time.time()
    seeds = decontaminate._Seeds([(1, "spam " * 1000), (2, " ".join(f"x{i}" for i in range(1000)))], 5)
    found = list(seeds.matches("spam " * 20000 + LONG, 0.6))
    assert [(k, c, n) for k, c, n in found] == [(1, 1.0, 1)] and time.time() - began < 20


def test_short_items_and_shared_ids(spark):
    item = " ".join(f"q{i}" for i in range(24))
    docs = spark.createDataFrame([(None, f"see {item}", "x"), (1, "clean words only here", "x"), (1, item, "x"), (2, "the rare Quux, Frobnitz", "x"), (2, "quux of frobnitz", "x"), (3, None, "x"), (3, None, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, "Quux Frobnitz!"), (9, "...")], "item_id long, text string")
    found = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert found == [(-1, 7), (1, 7), (2, 8)]
    for chars in (8 << 20, 50):
        clean = decontaminate.uncontaminated(docs, bench, block_chars=chars)
        assert clean.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(map(str, [(1, "clean words only here"), (2, "quux of frobnitz"), (3, None), (3, None)]))


def test_decontamination(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(24))
    parts = item.split()
    docs = spark.createDataFrame([(1, f"so {item.upper()}! end"), (2, " ".join(parts[12:] + ["mid"] + parts[:12])), (3, " ".join(parts[:8])), (4, None), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, "too short", 1), (10, None, 1)], "item_id long, text string, doc_id long")
    for chars in (32 << 20, 50):
        got = sorted((r.doc_id or -1, r.item_id, r.coverage) for r in decontaminate.contaminated(docs, bench, block_chars=chars).collect())
        assert got == [(d, i, 1.0) for d in (-1, 1, 2) for i in (7, 8)]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def brute_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


PII_PARTS = ["a", "@", "b.c", "1", "2.3", ".", "-", " ", "+1 ", "4", "(555) ", "555-1212", "é", "4111 1111 1111 1111", "127.0.0.1", "256", "%", "_"]
SECRET_PARTS = ["token", "secret", "Api_key", "apikey", "PASSWORD", "passwd", "=", ":", " ", '"', "'", "abc", "123456", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "_", "-", "+x/", ".\n", "ghp_", "eyJ"]


def test_spans_against_regular_expressions():
    rng = np.random.default_rng(3)
    scanner = secrets.Scanner()
    for _ in range(3000):
        t = "".join(rng.choice(PII_PARTS, rng.integers(1, 14)))
        assert sorted(pii.base_spans(t)) == sorted(brute_pii(t)), t
        t = "".join(rng.choice(SECRET_PARTS, rng.integers(1, 16)))
        data = t.encode()
        got = [(scanner.rules[k].kind, len(data[:a].decode()), len(data[:b].decode())) for k, a, b in scanner.spans(data) if scanner.rules[k].base]
        assert got == brute_secrets(t), t


#: The added rules once more, as Python's regular expressions.
ADDED = {
    "private_key": r"-----BEGIN(?: [A-Z]+)* PRIVATE KEY-----[A-Za-z0-9+/=:,. \t\r\n-]*?-----END(?: [A-Z]+)* PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}", "slack": r"xox[abprs]-[A-Za-z0-9-]{24,}", "jwt": r"eyJ[A-Za-z0-9_.-]{60,}", "google": r"AIza[A-Za-z0-9_-]{35,}",
}
KEY_PARTS = ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "\n", "MIIEow+/", "Proc-Type: 4,ENCRYPTED", "ghp_", "ghs_", "xoxb-", "eyJ", "AIza", "a1B2c3D4" * 5, "0-9" * 9, "é", "!", " ", "_x."]


def test_added_secrets_against_regular_expressions(spark):
    rng = np.random.default_rng(13)
    scanner = secrets.Scanner()
    texts = ["".join(rng.choice(KEY_PARTS, rng.integers(1, 14))) for _ in range(1500)]
    seen = set()
    for t in texts:
        data = t.encode()
        got = [(scanner.rules[k].kind, len(data[:a].decode()), len(data[:b].decode())) for k, a, b in scanner.spans(data)]
        for kind, rule in ADDED.items():
            # A run that is too short is consumed too, so the runs are found first.
            runs = re.finditer(rule, t) if kind == "private_key" else (m for m in re.finditer(re.sub(r"\{\d+,\}$", "+", rule), t) if re.fullmatch(rule, m[0]))
            want = [m.span() for m in runs]
            assert [(a, b) for k, a, b in got if k == kind] == want, (kind, t)
            seen |= {kind} if want else set()
        whole = [(a, b) for k, a, b in got if k == "private_key"]
        cut = [m.span() for m in re.finditer(r"-----BEGIN(?: [A-Z]+)* PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*", t) if not any(a <= m.start() < b for a, b in whole)]
        assert [(a, b) for k, a, b in got if k == "private_key_open"] == [x for x in cut if t[x[1] - 1] != "-"], t
    assert seen == set(ADDED)
    found = secrets.find_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in found[:300]:
        data = texts[r.doc_id].encode()
        assert [(s.kind, s.start, s.stop) for s in r.spans] == [(scanner.rules[k].kind, len(data[:a].decode()), len(data[:b].decode())) for k, a, b in scanner.spans(data)]


def test_secret_scan_is_linear():
    import time

    began, scanner = time.time(), secrets.Scanner()
    end = b"-----END PRIVATE KEY-----\n"
    assert len(scanner.spans(b"-----BEGIN PRIVATE KEY-----\n" + end * 4000)) == 1
    assert len(scanner.spans((b"-----BEGIN PRIVATE KEY-----\nMII\n" + end) * 1000)) == 1000
    assert time.time() - began < 20


def test_pii_and_secret_queries(spark, sf_dir, odd, none):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    for query, brute, order in ((queries.op6_pii, brute_pii, lambda x: (("email", "ip", "card", "phone").index(x[0]), x[1])), (queries.op10_secrets, brute_secrets, lambda x: x[1])):
        for r in query(spark, sf_dir).collect():
            want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(brute(texts[r.doc_id]), key=order))
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert pii.find_pii(none).count() == 0 and secrets.find_secrets(none).count() == 0
    assert pii.find_pii(odd).count() == odd.count() == secrets.find_secrets(odd).count()


NATIONAL = {
    "phone": ["030 1234567", "01 23 45 67 89", "0044 20 7946 0958", "(212) 555-7788", "020 7946 0958", "089/123456-78"],
    "email": ["john dot doe at example dot com", "joe [at] example [dot] com", "ann (at) example.org"],
    "card": ["4111 1111 1111 1112", "4111.1111.1111.1111", "5500/0000/0000/0004"],
    "ip": ["2001:db8::8a2e:370:7334", "fe80::1", "10[.]0[.]0[.]1"],
}
NOT_PERSONAL = ["on 01.02.2024", "at 12:34:56 sharp", "std::vector", "look at this dot", "isbn 0306406152", "aa:bb:cc:dd:ee:ff", "item 9807915762804490", "version 0012 3456"]


def test_candidates_of_every_kind(spark):
    cues = {"phone": "call", "email": "mail", "card": "card", "ip": "host"}
    rows = [f"{cues[k]} {t} today" for k, ts in NATIONAL.items() for t in ts] * 3 + NOT_PERSONAL * 4 + ["call +1 212 555 7788 or mail a.b@example.com from 10.1.2.3 with card 4111 1111 1111 1111"] * 9
    plain = [(k, t) for k, ts in NATIONAL.items() for t in ts]
    docs = spark.createDataFrame(list(enumerate([*rows, *(t for _, t in plain)])), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.stop, s.base) for s in r.spans] for r in pii.find_pii(docs).collect()}
    for k, (kind, t) in enumerate(plain):
        assert found[len(rows) + k] == [(kind, 0, len(t), False)], t
    for k, t in enumerate(rows):
        if t in NOT_PERSONAL:
            assert not found[k], t
    for spans in found.values():
        ordered = sorted(spans, key=lambda s: s[1])
        assert all(a[2] <= b[1] for a, b in zip(ordered, ordered[1:]) if not (a[3] and b[3]))


def slow_em(rows, rounds=50):
    """Expectation-maximisation over single rows (votes, known), each with its weight."""
    good, prior = [0.7] * 3, 0.5
    for _ in range(rounds):
        p = []
        for v, known, _ in rows:
            yes, no = prior, 1 - prior
            for x, g in zip(v, good):
                yes *= {1: g, -1: 1 - g, 0: 1}[x]
                no *= {-1: g, 1: 1 - g, 0: 1}[x]
            p.append(0.98 if known else yes / (yes + no))
        loose = [(q, w) for q, (_, known, w) in zip(p, rows) if not known]
        prior = min(0.95, max(0.05, (sum(q * w for q, w in loose) + 2) / (sum(w for _, w in loose) + 4)))
        good = [min(0.99, max(0.05, (sum(w * (q if v[k] == 1 else 1 - q) for q, (v, _, w) in zip(p, rows) if v[k]) + 7) / (sum(w for v, _, w in rows if v[k]) + 10))) for k in range(3)]
    return good, prior


def test_em_finds_the_wrong_labeler():
    rng = np.random.default_rng(14)
    rows = []
    for _ in range(600):  # two labelers are right at 0.9, the third at 0.15; each abstains now and then
        y = 1 if rng.random() < 0.4 else -1
        rows.append(tuple(0 if rng.random() < 0.1 else y if rng.random() < right else -y for right in (0.9, 0.9, 0.15)))
    base = [(1, 1, -1)] * 200
    counts = [("phone", v, (0,) * 6, known, n) for known, vs in ((False, rows), (True, base)) for v, n in __import__("collections").Counter(vs).items()]
    model = pii.learn(counts)["phone"]
    good, prior = slow_em([(v, False, 1.0) for v in rows] + [(v, True, 1.0) for v in base])
    assert model["reliability"] == pytest.approx(good, abs=1e-3) and model["prior"] == pytest.approx(prior, abs=1e-6)
    assert good[0] > 0.8 and good[1] > 0.8 and good[2] < 0.3 and abs(prior - 0.4) < 0.06
    score = lambda *v: 1 / (1 + np.exp(-np.dot(model["weights"], pii._row(v, (0,) * 6))))
    assert score(1, 1, 1) > 0.5 > score(-1, -1, 1)


def test_weak_supervision_adds_spans(spark):
    rows = [(i, f"please call +1 (212) 555-{1000 + i} today") for i in range(40)] + [(100, "phone (212) 555-7788 or mail joe [at] example [dot] com"), (101, "version (102) 155-7788")]
    found = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("phone", False) in found[100] and found[0] == [("phone", True)]


def test_extraction(spark, sf_dir, none):
    assert html_text.main_text("", None) == ""
    page = """<html><body><header>Site</header><nav><a href=x>menu</a></nav><div class="post-12"><h1>T&eacute;st</h1><p>One <b>two</b>
    three.<p>Four &lt; five &amp; six<div class="comments"><p>reader says a lot of words that go on and on and on and on</div></div>
    <aside>side</aside><form>form</form><script>x = "</p>";</script><footer>end</footer></body></html>"""
    assert html_text.main_text(page, None) == "Tést One two three. Four < five & six"
    pages = queries.table(spark, sf_dir, "pages")
    docs = {" ".join(r.text.split()) for r in queries.table(spark, sf_dir, "documents").collect()}
    heads = {r.page_id: " ".join(html.unescape(re.search("<h1>(.*?)</h1>", r.html, re.S)[1]).split()) for r in pages.collect()}
    got = queries.op7_html_text(spark, sf_dir).collect()
    assert len(got) == len(heads)
    for r in got:  # the whole article: its heading, then a whole document
        assert r.text.startswith(heads[r.page_id]) and r.text[len(heads[r.page_id]) :].strip() in docs and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (2, "x", ""), (3, "http://h/", "<p>only<p>this"), (3, "http://h/", "<p>only<p>this"), (4, None, "plain < text")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_text.extract(odd).collect())
    assert got == [(1, ""), (2, ""), (3, "only this"), (3, "only this"), (4, "plain < text")]
    assert html_text.extract(spark.createDataFrame([], odd.schema)).count() == 0
    for frame in (pages, odd):  # hosts salted, not broadcast
        salted = html_text.extract(frame, broadcast_bytes=-1, share=1e-9)
        assert sorted(map(str, salted.collect())) == sorted(map(str, html_text.extract(frame).collect()))


def test_extraction_keeps_what_is_no_furniture():
    text = lambda x: html_text.main_text(x, None)
    assert text("<p>Let <math><mi>x</mi></math> be") == "Let x be"
    assert text("foo<img>bar<wbr>baz<br>end") == "foobarbaz end"
    assert text("<p>a<noscript>b</noscript><object>c</object><svg><text>d</text><path d=''/></svg>e") == "abcde"
    assert text("<p>1 &am<b>p;2</b> &amp;lt; &#233;") == "1 &amp;2 &lt; é"
    article = "<body><div class='top-menu'>menu</div><article><p>The long first paragraph of the article.</p>{}<p>And the second one.</p></article></body>"
    whole = "The long first paragraph of the article. {}And the second one."
    for own in ("<div class='related-work'><p>Earlier results.</p></div>", "<pre><code><span class='comment'>Earlier results.</span></code></pre>", "<p aria-hidden='true'>Earlier results.</p>", "<header>Earlier results.</header>", "<section id='notices-of-death'>Earlier results.</section>"):
        assert text(article.format(own)) == whole.format("Earlier results. ")
    for no in ("<div class='comment-list'><p>I disagree with all of this.</p></div>", "<ul class='related-work'><li><a href=x>Earlier results.</a></li></ul>", "<div id='adBox2'>Buy!</div>", "<div role=search>find</div>", "<footer>f</footer><form>x<select><option>y</select></form><script>'</p>'</script>", "<div style='display: none'>hidden</div>"):
        assert text(article.format(no)) == whole.format("")


def test_extraction_is_linear():
    import time

    began, n = time.time(), 100_000
    assert html_text.main_text("<div>" * n + "x" + "</div>" * n, None) == "x"
    assert html_text.main_text("<b>" * n + "<p>x" * n, None) == " ".join("x" * n)
    assert html_text.main_text("<div><span>" * n + "</p></section>" * n, None) == ""
    assert len(html_text.main_text("<a '" * n, None)) == 4 * n
    blocks, elements = html_text.judged("<div class=c>" * 3000 + "<p>deep</p>")
    path = html_text.path_of(elements, html_text.best(elements))
    assert html_text.main_text("<div class=c>" * 3000 + "<p>deep</p>", path) == "deep" and path.count(">div.c") == 3000
    assert time.time() - began < 60


def test_quality_on_held_out_labels(spark, odd, none):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, d, "labels").collect()}
    got = queries.op8_quality(spark, d).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert quality.scores(none, 1.0).count() == 0
    assert quality.fit(odd, spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")) == 1.0


def test_dictionary_pieces_are_bounded_and_from_all_over():
    view = b" ".join(f"w{i}".encode() for i in range(20000))
    some = quality._share(view, 2048, 10_000)
    assert sum(map(len, some)) <= 10_000 and len(some) == 4 and max(view.index(x) for x in some) > len(view) // 4
    assert quality._share(b"short", 2048, 10_000) == [b"short"] and quality._share(b"", 2048, 10) == []


def test_quality_of_odd_rows(spark, odd, none, sf_dir):
    labels = queries.table(spark, sf_dir, "labels")
    model = queries.quality_model(queries.table(spark, sf_dir, "documents"), labels)
    rows = quality.scores(odd, model).collect()
    scorer = quality.Scorer(model.dictionaries, model.piece, model.weights)
    assert len(rows) == odd.count() and all(r.score == pytest.approx(scorer.score(r.text)) for r in rows)
    assert quality.accepted(odd, model, 0.3).count() == sum(r.score >= 0.3 for r in rows)
    assert quality.scores(none, model).count() == 0 == quality.accepted(none, model, 0.3).count()


def test_mixing(spark, odd, none):
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    rows = mixing.mixed(docs).collect()
    for source in {r.target for r in rows}:
        own = [r for r in rows if r.target == source]
        assert abs(sum(r.taken for r in own) - source) <= 50
    assert all(r.taken <= 2 * r.size for r in rows) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(docs).collect()))
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(none).count() == 0


def test_flow_repeats_last():
    flow = mixing.cheapest_flow({("a", "b"): 100.0, ("a",): 50.0}, {"a": 120.0, "b": 60.0}, 2)
    assert sum(x.get("a", 0) for x in flow.values()) == pytest.approx(120) and flow[("a", "b")]["b"] == pytest.approx(60)
    assert sum(flow[("a",)].values()) <= 100


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, compare):
    compare(queries.queries()[name], queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def shared(spark, sf_dir):
    """A leak, a near copy and an exact copy without an id; clean rows that share their ids; empty texts; columns with the stages' own names."""
    rng = np.random.default_rng(12)
    base = rng.choice([f"v{i}" for i in range(3000)], 300).tolist()
    near = [*base[:-4], "other", "end", "of", "it"]
    item = queries.table(spark, sf_dir, "benchmark").first().text
    rows = [
        (None, f"see {item} here"), (7, f"{item} again"), (7, "a clean row that shares the id of a leak and stays"), (3, " ".join(base)), (8, " ".join(near)), (8, "a clean row that shares the id of a near copy"),
        (None, "twice the same"), (9, "twice  the\nsame"), (9, "another row of nine"), (None, ""), (2, None), (5, "one text"), (5, "one text"),
    ]
    return spark.createDataFrame([(*r, "en", "s", "x", "y", 1.0) for r in rows], "doc_id long, text string, lang string, source string, size string, row string, score double")


def kept_by(stage, spark, docs, sf_dir):
    got = stage(spark, docs, sf_dir)
    assert set(docs.columns) <= set(got.columns)
    return sorted(((r.doc_id, " ".join(words(r.text))) for r in got.collect()), key=str)


def test_stages_on_shared_and_null_ids(spark, shared, sf_dir):
    stages, every = dict(corpus_pipeline.STAGES), sorted(((r.doc_id, " ".join(words(r.text))) for r in shared.collect()), key=str)
    without = lambda *gone: [x for x in every if x not in gone]
    item = " ".join(words(queries.table(spark, sf_dir, "benchmark").first().text))
    assert kept_by(stages["benchmark decontamination"], spark, shared, sf_dir) == without((None, f"see {item} here"), (7, f"{item} again"))
    near = next(x for x in every if x[0] == 8 and x[1].endswith("end of it"))
    want = without(near, (7, f"{item} again"), (9, "twice the same"), (2, ""), (5, "one text"))
    assert kept_by(stages["simhash near-dedup"], spark, shared, sf_dir) == sorted([*want, (5, "one text")], key=str)
    want = without((9, "twice the same"), (2, ""), (5, "one text"))
    assert kept_by(stages["exact dedup"], spark, shared, sf_dir) == sorted([*want, (5, "one text")], key=str)
    judged = kept_by(stages["quality classifier"], spark, shared, sf_dir)
    model = queries.quality_model(shared, queries.table(spark, sf_dir, "labels"))
    score = {r.text: r.score for r in quality.scores(shared, model).collect()}
    assert judged == sorted(((r.doc_id, " ".join(words(r.text))) for r in shared.collect() if score[r.text] >= queries.LEAST_QUALITY), key=str)
    mixed = stages["mixing sources"](spark, shared, sf_dir)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "row", "score", "size", "target", "copies", "taken"]
    rows = mixed.collect()
    assert all(r.size == len(words(r.text)) and r.taken == r.copies * r.size <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 300
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, shared.limit(0), sf_dir).count() == 0


def brute_mix(rows, weights=(5, 2, 1)):
    """Copies of each (doc_id, source, text) by ordering every source's documents."""
    size = {r[0]: len(words(r[2])) for r in rows}
    names = sorted({r[1] for r in rows})
    total = {s: sum(size[r[0]] for r in rows if r[1] == s) for s in names}
    target = mixing.targets(total)
    out = {}
    for s in names:
        own = sorted((int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16), r[0]) for r in rows if r[1] == s)
        before = 0
        for _, d in own:
            out[d] = sum(size[d] > 0 and e * total[s] + before + size[d] / 2 <= target[s] for e in range(2))
            before += size[d]
    return out


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = {r.doc_id: r.copies for r in corpus_pipeline.source_mix(spark, docs, sf_dir).collect()}
    assert got == {d: c for d, c in brute_mix(rows).items() if c}
    sets = {}
    for d, _, text in rows:
        w = words((text or "").encode().lower().decode())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    of = {}
    for d, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(d)
    root = {d: d for d in sets}
    for a, b in {(a, b) for ds in of.values() for a in ds for b in ds if a < b}:
        if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()) == sorted(set(root.values()))


def test_mixing_cells_and_overlaps(spark, monkeypatch):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    whole = sorted(map(tuple, mixing.mixed(docs).collect()))
    both = docs.withColumn("tags", F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("extra"))).otherwise(F.array("source")))
    asks = {"s0": 9000.0, "s1": 20000.0, "s2": 12000.0, "extra": 15000.0}
    overlapping = sorted(map(str, mixing.mix(mixing.with_sizes(both, "tags"), asks).collect()))
    for rows in (100, 1):
        monkeypatch.setattr(mixing, "CELL_ROWS", rows)
        assert sorted(map(tuple, mixing.mixed(docs).collect())) == whole
        assert sorted(map(str, mixing.mix(mixing.with_sizes(both, "tags"), asks).collect())) == overlapping
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == whole
    taken = mixing.mix(mixing.with_sizes(both, "tags"), asks).agg(F.sum("taken")).first()[0]
    assert abs(taken - sum(asks.values())) <= 6 * 50


def test_pipeline(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "exact dedup" and len(corpus_pipeline.STAGES) == 5
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = corpus_pipeline.stored(stage(spark, kept, sf_dir), f"test{k}")
        assert after.columns == docs.columns and after.exceptAll(kept).count() == 0
        kept = after
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.join(kept, "doc_id", "left_anti").count() == 0
    texts = [" ".join(words(r.text)) for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    bench = queries.table(spark, sf_dir, "benchmark")
    assert decontaminate.contaminated(kept, bench).count() == 0
    good = queries.table(spark, sf_dir, "labels").join(docs, "doc_id")
    stage1 = corpus_pipeline.quality_classifier(spark, docs, sf_dir)
    assert good.filter("quality = 1").join(stage1, "doc_id", "left_anti").count() <= 1
