"""Operators 1, 2, 4, 6 to 10 on small tables, against brute force, round trips and held-out rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from voxlake.llm import chat, fingerprint, langid, line_quality, mixing, queries, sharding, sp_bpe, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, shard string, size string"
ODD = [(1, None, None, None, "x", "y"), (2, "", "en", "s", "x", "y"), (2, "", "en", "s", "x", "y"), (None, "a b", "en", "s", "x", "y"), (5, "word " * 30_000, "de", "t", "x", "y"), (6, " \n\t ", "de", "t", "x", "y"), (7, "a b", "en", None, "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_lpt_equals_a_plain_heap():
    rng = random.Random(1)
    for _ in range(50):
        sizes = Counter({rng.randint(1, 30): rng.randint(1, 400) for _ in range(6)})
        plan, loads = sharding.lpt_plan(dict(sizes), 5)
        heap = [(0, i) for i in range(5)]
        for s in sorted(sizes.elements(), reverse=True):
            load, i = heapq.heappop(heap)
            heapq.heappush(heap, (load + s, i))
        assert loads == [x for x, _ in sorted(heap, key=lambda x: x[1])]
        assert {s: sum(k for _, k in runs) for s, runs in plan.items()} == dict(sizes)


def test_shards(spark, odd, none):
    rows = queries.op1_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["size"] == len(docs[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in rows)
    of, slots, load = {}, {}, Counter()
    for r in rows:
        assert of.setdefault(docs[r["doc_id"]], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(40))
    group = max(sum(r["size"] for r in rows if docs[r["doc_id"]] == t) for t in of)
    assert max(load.values()) <= max(group, sum(load.values()) / 40 * 4 / 3)
    assert sharding.shard_documents(none).count() == 0
    got = sharding.shard_documents(odd, 3).collect()
    assert len(got) == len(ODD) and len({r["shard"] for r in got if r["size"] == 16}) == 1


def test_another_schedule_is_another_mix(spark, monkeypatch):
    rows = {r["doc_id"]: r for r in queries.op8_mixing(spark, SF).collect()}
    monkeypatch.setattr(mixing, "PHI", 2**0.5 - 1)
    other = {r["doc_id"]: r for r in queries.op8_mixing(spark, SF).collect()}
    assert {i: r["taken"] for i, r in rows.items()} == {i: r["taken"] for i, r in other.items()}
    assert sum(r["first_slot"] != other[i]["first_slot"] for i, r in rows.items()) > len(rows) / 2


@pytest.mark.parametrize("name", ["op4_sentencepiece", "op6_quality_rules", "op7_language_id"])
def test_ids_of_another_type(spark, name, tmp_path):
    path = f"{tmp_path}/ints"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("doc_id", docs["doc_id"].cast("int")).write.parquet(f"{path}/documents.parquet")
    same = lambda d: sorted(map(str, queries.QUERIES[name](spark, d).select("doc_id", *queries.QUERIES[name](spark, d).columns[1:]).collect()))
    assert same(path) == same(SF)


def weighted_jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark, odd, none):
    rows = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids, error = sorted(docs), []
    for i, x in enumerate(ids):
        t, after = docs[x], docs[ids[(i + 1) % len(ids)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert rows[x]["n_chars"] == len(t) and rows[x]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        error += [rows[x]["near_edited"] - weighted_jaccard(t, edited), rows[x]["near_next"] - weighted_jaccard(t, after)]
    assert abs(np.mean(error)) < 0.02 and np.sqrt(np.mean(np.square(error))) < 0.1
    assert len({(docs[x], r["fingerprint"]) for x, r in rows.items()}) == len(set(docs.values()))
    assert fingerprint.fingerprint_documents(none).count() == 0
    got = fingerprint.fingerprint_documents(odd).collect()
    assert len(got) == len(ODD) and {r["fingerprint"] for r in got if r["n_chars"] in (0, 4)} == {"-"}


def test_error_of_fingerprints(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids, error = sorted(docs), []
    for r in queries.op2_fingerprints(spark, SF).collect():
        t, after = docs[r["doc_id"]], docs[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        error += [r["near_edited"] - weighted_jaccard(t, edited), r["near_next"] - weighted_jaccard(t, after)]
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 8 * fingerprint.SAMPLES
    assert np.sqrt(np.mean(np.square(error))) < 0.055


def test_fingerprint_by_its_definition(spark):
    import math

    import xxhash

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n)) for n in (1, 7, 80, 20_000)]
    r_table, c_table = ([float(f"{v:.9g}") for v in t] for t in fingerprint.tables())

    def print_of(text):
        out = []
        for k in range(fingerprint.SAMPLES):
            best = []
            for word, n in Counter(WORD.findall(text)).items():
                h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(xxhash.xxh64_digest(word, 42)[::-1], 42))
                r, log_c, b = r_table[h & (fingerprint.R_STEPS - 1)], c_table[h >> 10 & (fingerprint.C_STEPS - 1)], (h >> 22 & (1 << 20) - 1) / (1 << 20)
                t = math.floor(math.log(n) / r + b)
                best.append((int((log_c - r * (t - b + 1) + 64) * (1 << 24)), (h >> 32 ^ t * 0x9E3779B1) & 0xFFFFFFFF))
            out.append(f"{min(best)[1]:08x}")
        return "".join(out)

    ids = [-(2**63) + 5, 7, 8, 2**63 - 9]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()}
    assert [got[i]["fingerprint"] for i in ids] == list(map(print_of, texts))
    for i, (x, text) in enumerate(zip(ids, texts, strict=True)):
        after, k = texts[(i + 1) % 4], len(text) // 4
        assert got[x]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()


@pytest.mark.parametrize("quantiles", [1024, 4])
def test_ranges_keep_the_order(spark, quantiles):
    rng = random.Random(quantiles)
    ids = [-(2**63), 2**63 - 1, None, None] + [rng.randint(0, 10**6) for _ in range(4000)] + [2**52 + i for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    number, parts = fingerprint.ranges(df, 50, quantiles=quantiles)
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -(2**64), r["b"]) for r in df.withColumn("b", number).collect())
    assert parts == -(-len(ids) // 50) and [b for _, b in rows] == sorted(b for _, b in rows)
    assert quantiles == 4 or max(Counter(b for _, b in rows).values()) < 250


TEXTS = ["", "  a  b\n\nc ", " ", "   ", "▁a▁ b", "\n", "a\x00b", "<0x0A></s><s>", "aaaa" * 300, "漢字かな🙂é́", " \t x", "hello’s", "x" * 1000, "a.\n\n  b, c.\nD"]


def test_sentencepiece_equals_the_library(spark, odd, none):
    import sentencepiece

    path = queries.tokenizer_path()
    mine, library = sp_bpe.PieceModel(path, cached=50), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("  \n\tabcdeé漢_-.,0159thon▁") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()[:60]]
    for t in texts:
        coded = mine.encode(t)
        assert memoryview(coded).cast("I").tolist() == library.encode(t)
        assert mine.decode(coded) == library.decode(library.encode(t))
    assert sp_bpe.encode_documents(none, path).count() == 0
    got = {(str(r["doc_id"]), r["n_tokens"], tuple(r["ids"])) for r in sp_bpe.encode_documents(odd, path, ids=True).collect()}
    assert ("1", 2, (1, 2)) in got and ("7", len(library.encode("a b")) + 2, (1, *library.encode("a b"), 2)) in got


def test_sentencepiece_of_long_runs():
    import sentencepiece

    path = queries.tokenizer_path()
    mine, library = sp_bpe.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for x in "\t\0🙂Q□•\u00a0":
        for t in (x * 3000, "word" + x * 3000, x * 3000 + "word", "a " + x * 3000 + "\n" + x * 3000 + " b", "  " + x * 3000):
            coded = mine.encode(t)
            assert memoryview(coded).cast("I").tolist() == library.encode(t)
            assert mine.decode(coded) == library.decode(library.encode(t))


def test_sentencepiece_of_many_texts(monkeypatch):
    import sentencepiece

    path = queries.tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sp_bpe, "CHARS", 3000)
    monkeypatch.setattr(sp_bpe, "ROWS", 100)
    rng = random.Random(5)
    texts = [*TEXTS, "", *("".join(rng.choice("  \n\tabcdeé漢字_-.,0159thon▁🙂\0ßж") for _ in range(rng.randint(0, 90))) for _ in range(400)), "ab" * 24, "▁" * 48, "é" * 49, ""]
    for kept in (10, 400_000):
        mine = sp_bpe.PieceModel(path, cached=kept)
        ids, numbers = mine.encode_all(texts)
        ends = np.cumsum(numbers)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, numbers, strict=True)] == [library.encode(t) for t in texts]
        assert mine.decode_all(ids, numbers) == [library.decode(library.encode(t)) for t in texts]
        assert mine.n_kept <= kept
    for none in ([], ["", ""]):
        ids, numbers = mine.encode_all(none)
        assert len(ids) == 0 and numbers.tolist() == [0] * len(none) and mine.decode_all(ids, numbers) == none


def test_sentencepiece_takes_distinct_words_together(spark, monkeypatch):
    """No word has a Python loop of its own, and what one task has learnt of pairs serves the next."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(["th", "on", "er", "an", "ti", "re"]) for _ in range(rng.randint(2, 7))) for _ in range(500)) for _ in range(20)]
    calls = Counter()
    for name in ("encode_chunk", "_merged"):
        plain = getattr(sp_bpe.PieceModel, name)
        monkeypatch.setattr(sp_bpe.PieceModel, name, lambda self, text, name=name, plain=plain: calls.update([name]) or plain(self, text))
    mine = sp_bpe.PieceModel(queries.tokenizer_path())
    first = [mine.encode(t) for t in texts]
    assert calls["encode_chunk"] == 0 < calls["_merged"]
    mine.forget()
    calls.clear()
    assert [mine.encode(t) for t in texts] == first and not calls


def stats_by_force(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_line_rules(spark, odd, none):
    rng = random.Random(3)
    for t in ["", "a", "a b", "a b c", "a b c a b c", "x\nx\n\nx <#>"] + ["".join(rng.choice("ab \n#") for _ in range(60)) for _ in range(200)]:
        assert line_quality.text_stats(t) == stats_by_force(t)
    body = lambda i: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j % 26) + chr(97 + j // 26) for j in range(60))
    rows = [(i, "Same  Line 1 " * 20 + "\n" + body(i), "h") for i in range(8)] + [(20 + i, "same line 7 " * 20, "h") for i in range(3)] + [(30, body(30), "h"), (31, "same line 1 " * 20 + "\n" + body(31), "other")]
    got = {r["doc_id"]: r for r in line_quality.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_documents=5, keep_share=0.5).collect()}
    assert all(got[i]["n_line_words_removed"] == 60 and got[i]["kept"] for i in range(8) if not got[i]["base_failed"])
    assert not any(got[20 + i]["kept"] for i in range(3)) and got[31]["n_line_words_removed"] == 0 and got[30]["kept"]
    assert line_quality.line_rules(none).count() == 0
    assert sorted(r["n_words"] for r in line_quality.line_rules(odd).collect()) == [0, 0, 0, 0, 2, 2, 30_000]


def test_languages(spark, odd, none):
    rows = {r["doc_id"]: r for r in queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [x for x in rows if zlib.crc32(str(x).encode()) % 3 == 1]
    assert all(rows[x]["held_out"] == (x in set(held)) for x in rows) and np.mean([rows[x]["lang_pred"] == truth[x] for x in held]) > 0.95
    model = langid.fit_languages(odd)
    got = {str(r["doc_id"]): r["lang_pred"] for r in langid.predict_languages(odd, model).collect()}
    assert got["1"] == got["2"] == got["6"] == "und" and got["7"] == "en"
    assert {r["lang_pred"] for r in langid.predict_languages(odd, langid.fit_languages(none)).collect()} == {"und"}


def test_capped_targets():
    assert mixing.capped_targets([10, 10, 10], [5, 2, 1], 45) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.capped_targets([0, 10], [5, 1], 15) == pytest.approx([0, 15])
    assert mixing.capped_targets([], [], 0) == []


def test_mixing(spark, odd, none):
    rows = queries.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes = {x: len(WORD.findall(r["text"] or "")) for x, r in docs.items()}
    names = sorted({r["source"] for r in docs.values()})
    total = [sum(sizes[x] for x, r in docs.items() if r["source"] == n) for n in names]
    goal = dict(zip(names, mixing.capped_targets(total, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(total)), strict=True))
    taken = Counter()
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(goal[docs[r["doc_id"]]["source"]])
        taken[docs[r["doc_id"]]["source"]] += r["taken"]
    assert len(rows) == len(docs) and all(abs(taken[n] - goal[n]) <= 1 for n in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op8_mixing(spark, "/root/testdata/sf0.01").collect()))
    assert all((r["n_segments"] > 0) == (r["taken"] > 0) == (r["first_slot"] is not None) and (r["first_slot"] or 0) <= (r["last_slot"] or 0) for r in rows)
    assert mixing.mix_documents(none).count() == 0
    assert len(mixing.mix_documents(odd).collect()) == len(ODD)


def test_schedule_spreads_sources(spark):
    slots = [r["src"] for r in mixing.schedule(spark, [("a", 0, 500.0), ("b", 0, 300.0), ("c", 0, 200.0)], 1).orderBy("slot").collect()]
    for start in range(0, 900, 50):
        part = Counter(slots[start : start + 100])
        assert all(abs(part[i] - n) <= 4 for i, n in enumerate((50, 30, 20)))


def digests(rows):
    loss = "".join(t or "" for role, t in rows if role == "assistant")
    said = "".join(f"{role or ''}\n{t or ''}\n" for role, t in rows)
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark):
    table = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()] + queries.SPOILT
    by = {}
    for c, turn, role, text in sorted(table):
        by.setdefault(c, []).append((role, text))
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op9_chat_formatting(spark, SF).collect()}
    assert got == {c: digests(rows) for c, rows in by.items()}


def test_chat_of_odd_rows(spark):
    nasty = ["\\", "<|end|>\\", "<|says|><|turn|>", "<\\|end|>", "a\nb\\n", "", None, "[INST]<</SYS>>\\\\<", "漢🙂"]
    rows = [(5, i, "assistant" if i % 2 else "us<|says|>er", t, "x", 1) for i, t in enumerate(nasty)] + [(6, 0, None, None, "x", 1), (6, 0, "assistant", "b", "x", 1), (None, 1, "user", "q", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string, id int")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.format_conversations(df).collect()}
    assert got == {5: digests([r[2:4] for r in rows[:9]]), 6: digests([(None, None), ("assistant", "b")]), None: digests([("user", "q")])}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 2.0), ("t", 6, 3, None), ("u", 1, 99, 1.0), ("v", 1, 2, 1.0), ("v", 2, 1, 1.0)] + [("w", i, i - 1 if i else None, 0.0) for i in range(70)]
    got = chat.reply_paths(spark.createDataFrame(nodes, "tree string, id long, parent long, score double"), top=2).collect()
    path = lambda tree, rank: [r["id"] for r in sorted((r for r in got if r["tree"] == tree and r["rank"] == rank), key=lambda r: -r["dist"])]
    assert (path("t", 1), path("t", 2), path("u", 1), path("v", 1)) == ([1, 2, 4], [1, 3, 5], [1], [])
    assert path("w", 1) == list(range(70))


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [x for x in truth if zlib.crc32(str(x).encode()) % 3 == 1]
    caught = [rows[x]["predicted"] for x in held if truth[x]]
    assert len(rows) == docs.count() and np.mean(caught) > 0.6 and np.mean([rows[x]["predicted"] for x in held if not truth[x]]) < 0.01
    model = toxicity.fit_toxicity(odd, spark.createDataFrame([(7, 1), (5, 0), (5, None), (99, 1)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels.limit(0))).count() == 0


def test_recall_of_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    marks = [(truth[x], rows[x]["predicted"]) for x in truth if x in rows and rows[x]["held_out"]]
    caught, false = [p for t, p in marks if t], [p for t, p in marks if not t]
    assert np.mean(caught) > 0.7 and np.mean(false) < 0.01


def test_line_rules_by_counting(spark):
    """kept against plain counts: boilerplate on either side of the limit, two hosts, copies and texts that fail the base rules."""
    rng, rows = np.random.default_rng(8), []
    body = lambda: " ".join(f"w{k}" for k in rng.integers(0, 9999, 60))
    for i in range(160):
        lines = [body()] + (["shared footer " * 40] if i < 70 else []) + (["rare footer " * 40] if i % 4 == 0 else [])
        rows.append((i, "\n".join(lines), "a" if i < 120 else "b"))
    rows += [(200 + i, rows[i][1], "a") for i in range(5)] + [(300, "few words", "a"), (301, "same " * 80, "b"), (302, None, "a")]
    got = {r["doc_id"]: r for r in line_quality.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    seen = {}
    for _, text, host in rows:
        for line in {" ".join(WORD.findall(x)) for x in (text or "").split("\n")} - {""}:
            seen.setdefault((host, line), set()).add(text)
    hosts = {h: len({t for _, t, k in rows if k == h}) for h in ("a", "b")}
    for i, text, host in rows:
        lines = [" ".join(WORD.findall(x)) for x in (text or "").split("\n")]
        gone = sum(len(x.split()) for x in lines if x and len(seen[host, x]) > max(50, 0.01 * hosts[host]))
        words = len(WORD.findall(text or ""))
        assert got[i]["n_line_words_removed"] == gone and got[i]["kept"] == (not got[i]["base_failed"] and 2 * (words - gone) >= words), i
    assert got[0]["n_line_words_removed"] == 80 and not got[0]["kept"] and got[159]["kept"] and got[301]["base_failed"]


def test_nearest_centroid_by_its_definition(spark):
    """Each prediction against plain loops over the fitted centroids, and the inverse document frequencies against counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where(~langid.held_out("doc_id"))
    model = langid.fit_languages(train, 1000)
    texts = [r["text"] for r in train.where("lang is not null").collect()]
    met = np.zeros(langid.DIMS)
    for t in texts:
        met += langid.ngram_counts(t or "") > 0
    np.testing.assert_allclose(model.idf, 1 + np.log((1 + len(texts)) / (1 + met)), rtol=1e-5)
    assert sorted(set(model.langs)) == sorted({r["lang"] for r in train.where("lang is not null").select("lang").distinct().collect()}) and max(map(model.langs.count, model.langs)) > 1
    got = {r["doc_id"]: r for r in langid.predict_languages(docs, model).collect()}
    for r in docs.collect():
        v = [np.log1p(float(c)) * float(w) for c, w in zip(langid.ngram_counts(r["text"] or ""), model.idf, strict=True)]
        size = sum(x * x for x in v) ** 0.5
        cosine = [sum(a * float(b) for a, b in zip(v, c, strict=True) if a) / size for c in model.centres]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert abs(got[r["doc_id"]]["score"] - min(1, max(0, cosine[best]))) < 1e-4
        if sorted(cosine)[-2] < cosine[best] - 1e-4:
            assert got[r["doc_id"]]["lang_pred"] == model.langs[best] and got[r["doc_id"]]["rejected"] == (cosine[best] < model.least[best]) or abs(cosine[best] - model.least[best]) < 1e-4


def test_ftrl_by_its_definition():
    """Weights and scores against a plain loop, coordinate by coordinate."""
    texts = ["you are a fool", "a kind day to you", "fool of a fool", "the day is kind", "such a fool you are", "kind words"] * 5
    labels = np.array([1, 0, 1, 0, 1, 0] * 5)
    rows = [toxicity.features(t) for t in texts]
    l1 = 3.0  # leaves some features out and some in
    options = {"alpha": 0.5, "beta": 1.0, "l1": l1, "l2": 1.0, "passes": 3, "seed": 5, "toxic_weight": 2.0}
    z, n, order = {}, {}, np.random.default_rng(5)

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((1.0 + n[i] ** 0.5) / 0.5 + 1.0)

    for _ in range(3):
        for r in order.permutation(len(rows)):
            coordinates = [*rows[r].tolist(), "bias"]
            w = {i: weight(i) for i in coordinates}
            p = 1 / (1 + np.exp(-sum(w.values())))
            g = (p - labels[r]) * (2.0 if labels[r] else 1.0)
            for i in coordinates:
                rate = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.5
                z[i], n[i] = z.get(i, 0.0) + g - rate * w[i], n.get(i, 0.0) + g * g
    model = toxicity.Ftrl.fit(rows, labels, **options)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert set(model.index.tolist()) == set(want) and 0 < len(want) < len(z) - 1
    np.testing.assert_allclose(model.value, [want[i] for i in model.index.tolist()])
    assert abs(model.bias - weight("bias")) < 1e-9
    for t in ["a fool", "kind", "", None]:
        s = sum(want.get(i, 0.0) for i in toxicity.features(t).tolist()) + model.bias
        assert abs(model.score(t) - 1 / (1 + np.exp(-s))) < 1e-9
