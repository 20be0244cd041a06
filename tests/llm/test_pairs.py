"""Operators 3 and 5 and their parts against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from voxlake.llm import components, ngram_join, suffix_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, k):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = f"X{rng.random():.3f}"
    return " ".join(words)


def linked_by_force(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset([tuple(w[j : j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        old = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if old == least:
            return {i: (len(s), least[i]) for i, s in sets.items()}


def test_join_of_null_and_repeated_ids(spark):
    rng = random.Random(9)
    pairs = [(t, edited(rng, t, 1)) for t in (prose(rng, 100 + i) for i in range(12))]
    # near copies of an id or none; all ids but the partners' are shared by different texts
    rows = [(None if i % 2 else 7, a) for i, (a, _) in enumerate(pairs)] + [(100 + i, b) for i, (_, b) in enumerate(pairs)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] and r["doc_id"] >= 100}
    assert got == {100 + i: 100 + i if i % 2 else 7 for i in range(12)}
    rows = [(None, a) for a, _ in pairs] + [(None, b) for _, b in pairs] + [(5, edited(rng, pairs[3][0], 1))]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 25 and sorted(str(r["component_id"]) for r in got) == ["5"] * 3 + ["None"] * 22


@pytest.mark.parametrize("limits", [(2, 2000, 256), (1, 6, 16)])
def test_join_equals_brute_force(spark, monkeypatch, limits):
    """Also where a family of copies with edits is too large for a task."""
    for name, value in zip(("BATCH_MOST", "FAMILY", "PIVOTS"), limits, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 150)
    texts = [None, "", " \t", "one two", "One TWO", "a b c d e", "A b c d e f", "É é", "é é"]
    texts += [f"{prose(rng, rng.randint(3, 60))} {passage} {prose(rng, rng.randint(3, 60))}" for _ in range(30)] + [edited(rng, base, rng.randint(0, 8)) for _ in range(40)]
    texts += texts[-5:] + [prose(rng, 3000)]
    rows = list(enumerate(texts))
    got = ngram_join.jaccard_components(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, c string, n string").repartition(3)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == linked_by_force(rows)


def test_classes_just_below_the_threshold_are_no_family(spark, monkeypatch):
    """A passage that hundreds of texts share, each with a tail of its own just too long for links: nothing is left to be joined in rounds."""
    rng = random.Random(3)
    core = prose(rng, 84)
    rows = [(i, f"{core} t{i} {prose(rng, 10)}") for i in range(300)]  # 80 of 102 shingles are shared
    rows += [(1000 + i, edited(rng, rows[i][1], 1)) for i in range(0, 300, 50)] + [(2000, core)]
    monkeypatch.setattr(ngram_join, "FAMILY", 20)
    monkeypatch.setattr(ngram_join, "_pool_labels", lambda *a: pytest.fail("a large family"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(docs.where("doc_id < 2000")).collect()}
    assert got == linked_by_force([r for r in rows if r[0] < 2000]) and sum(i != c for i, (_, c) in got.items()) == 6
    monkeypatch.undo()  # the bare passage is linked with all
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == linked_by_force(rows) and {c for _, c in got.values()} == {0}


def test_join_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = ngram_join.jaccard_components(spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "a b c"), (2, "z")], "doc_id long, text string")).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == [("2", 1, 2), ("4", 1, 4), ("4", 1, 4), ("None", 1, 4)]


def test_trie_equals_pairs():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.int64) for _ in range(80)]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    got = ngram_join.local_components([(s, counts[np.searchsorted(every, s)]) for s in sets], [len(s) for s in sets], 60)
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                k = len(np.intersect1d(a, b))
                if 100 * k >= 60 * (len(a) + len(b) - k):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (200, 200)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 103: 100}


def removed_by_force(texts):
    data, seen = [(t or "").encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [256, 5])
def test_dedup_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = random.Random(most)
    passage, base = prose(rng, 70), prose(rng, 200)
    texts = [None, "", "short", "a" * 700, "a" * 250 + "b" + "a" * 300, "ab" * 300, passage, passage[:-1], base, base, base[50:]]
    texts += [prose(rng, rng.randint(5, 40)) + passage + prose(rng, rng.randint(5, 40)) for _ in range(20)] + [edited(rng, base, rng.randint(0, 9)) for _ in range(25)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, g string, c int").repartition(3)
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.dedup_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_force(texts)


def test_dedup_of_nothing_repeated_rows_and_long_texts(spark):
    assert suffix_dedup.dedup_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(1)
    long = prose(rng, 150_000)
    assert len(long.encode()) > suffix_dedup.SEGMENT
    rows = [(1, "é" * 150), (1, "é" * 150), (None, "q"), (3, long), (4, long[300_000:300_400])]
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in suffix_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    piece = len(rows[4][1].encode())
    assert got == [("1", 300, 300, 1), ("1", 300, 300, 1), ("3", len(long.encode()), piece, 1), ("4", piece, piece, 1), ("None", 1, 0, 0)]


@pytest.mark.parametrize("colliding", [False, True])
def test_reach_equals_windows(monkeypatch, colliding):
    if colliding:  # all strings of a length have one hash
        monkeypatch.setattr(suffix_dedup, "_prefix_hashes", lambda x: np.zeros(len(x) + 1, np.uint64))
    rng = random.Random(2)
    core = bytes(rng.choice(b"ab") for _ in range(suffix_dedup.K))
    left, right = [bytes(rng.choice(b"ab") for _ in range(150)) for _ in range(4)], [bytes(rng.choice(b"ab") for _ in range(suffix_dedup.W - suffix_dedup.K)) for _ in range(4)]
    rows = []
    for _ in range(40):
        a, b, c = rng.choice(left), rng.choice(left), rng.randint(0, 150)
        before = a[: 150 - c] + b[150 - c :]
        a, b, c = rng.choice(right), rng.choice(right), rng.randint(0, suffix_dedup.W - suffix_dedup.K)
        rows.append((before + core + a[:c] + b[c:], 150))
    want = []
    for i, (s, a) in enumerate(rows):
        hit = [p for p in range(len(s) - suffix_dedup.W + 1) if p <= a and p + suffix_dedup.W >= a + suffix_dedup.K and any(t[p : p + suffix_dedup.W] == s[p : p + suffix_dedup.W] for j, (t, _) in enumerate(rows) if j != i and t != s)]
        want.append((a - min(hit), max(hit) + suffix_dedup.W - a) if hit else (0, 0))
    distinct = [rows.index(r) for r in dict.fromkeys(rows)]
    assert suffix_dedup.reach([rows[i] for i in distinct]) == [want[i] for i in distinct]
