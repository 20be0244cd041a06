"""Operators 11 to 13 on small tables: against counting by hand, the library and a tree built by its definition."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF
from voxlake.llm import divergence, merkle, queries, token_counts

DOCS = "doc_id int, text string, lang string, source string, n_chars int, key string, term string, h string"
WORDS = ["Alpha", "beta", "gamma-delta", "straße", "ÉTÉ", "ab12cd", "x" * 50_000]
ODD = [
    (i, None if i % 11 == 5 else "" if i % 13 == 6 else " ".join(WORDS[(i * k + j) % 7 if (i * k + j) % 7 < 6 or i == 3 else 0] for k, j in ((1, 0), (2, 1), (3, i % 4), (1, 5))), (None, "en", "", "de")[i % 4], (None, "s", "s", "t", "", "u")[i % 6], None if i % 7 == 0 else i, "k", "t", "h")
    for i in range(60)
]
ODD += [ODD[3], ODD[3], (None, "NO ID", "en", "s", 5, "", "", ""), (None, "NO ID", "en", "s", 5, "", "", ""), (7, "other TEXT", "xx", "alone", 1, None, None, None), (8, "!!", "yy", "one", 1, None, None, None), (9, "!!", "yy", "two", 1, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def audited_by_hand(rows, least, most):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        held[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        terms = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]

        def p(count):
            total = sum(count[t] for t in terms)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(terms)) for t in terms}

        of = {s: p(held[lang, s]) for s in sources}
        q = p(sum((held[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(of[s][t] - of[o][t]) for t in terms), o.encode(), o) for o in sources if o != s]
            term = [(-(of[s][t] - q[t]), t.encode(), t) for t in terms if held[lang, s][t] > 0 and of[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", sorted(term)[:most])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(sorted(found), 1)}
    return out


@pytest.mark.parametrize("least, most", [(1, 50), (5, 2), (30, 50), (1000, 50)])
def test_divergence_equals_counting(odd, least, most):
    got = [tuple(r) for r in divergence.audit(odd, least, most).collect()]
    assert set(got) == audited_by_hand(ODD, least, most) and len(got) == len(set(got))


def test_divergence_counts_in_each_task(spark, odd, none, monkeypatch):
    assert divergence.audit(none).count() == 0
    met = divergence.group_counts(odd.repartition(5), 1).where("term = 'alpha' and lang = 'de'").collect()
    assert sum(r["c"] for r in met) == met[0]["lang_c"] and sum(r["first"] for r in met) == 1
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    import pyarrow as pa

    rows = [r[:4] for r in ODD if r[0] is not None]
    batch = pa.RecordBatch.from_pydict({"text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": [r[3] for r in rows]})
    sent = list(divergence._count(iter([batch])))
    assert max(b.num_rows for b in sent) < 12
    total = Counter()
    for b in sent:
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["tf"]
    want = Counter()
    for _, text, lang, source in rows:
        want.update((lang or "", source or "", w.encode().translate(divergence.TERM_BYTES).decode()) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
    assert {k: v for k, v in total.items() if v} == dict(want)


TEXTS = [
    None, "", " ", "  two  spaces \n\n and\ttabs\r\n", "it's I'M we'll they'd 'S 's", "straße ÉTÉ ńų 日本語のテキスト कि", "123 45,678.90 ٣٤ Ⅷ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext",
    "x" * 20_000, "ab" * 7000 + " " * 3000, "\u0085   \x1c end", "𐐀𐐁 😀😀 👩‍👩‍👧", "՘ ֋౜ a⃁b ꟎X \U0003134f9", "é ​ zero", "=" * 100 + "-" * 33, "".join(map(chr, range(1, 0x3000))),
    " ".join(a + chr(i) + b for i in range(1, 256) for a in "a1- " for b in "a1- "), "\n".join(chr(i) * 3 for i in range(1, 256)),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, library, odd, none):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path).collect()}
    for i, text in enumerate(TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 1024), text
    assert token_counts.count_tokens(none, path).count() == 0 and token_counts.count_tokens(odd, path).count() == len(ODD)
    rows = {r["doc_id"]: r["n_tokens"] for r in queries.op12_token_counts(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}


def test_whole_tokens_are_proved_and_most_words_need_no_merge(spark, library):
    v = token_counts.Vocabulary(queries.tokenizer_path("byte_bpe_50k.json"))
    assert len(v.whole) > 40_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in v.whole)
    counting, words = token_counts.Counting(v, dict.fromkeys(v.whole, 1)), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("text").collect():
        words.update(counting.pre_tokens(r["text"] or ""))
    proved = set(v.whole)
    assert sum(n for w, n in words.items() if w in proved) > 0.3 * words.total()  # invented prose: real words are fewer


def test_merging_by_a_heap_is_merging_by_rank():
    v = token_counts.Vocabulary(queries.tokenizer_path("byte_bpe_50k.json")).merges
    for text in ("interestingly", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Donaudampfschifffahrtsgesellschaftskapitän" * 3):
        ids = [v.first[b] for b in text.encode()]
        while found := [(v.rank[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in v.rank]:
            rank, i = min(found)
            ids[i : i + 2] = [v.become[rank]]
        assert v.count(text.encode()) == v._count_long(text.encode()) == len(ids)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Vocabulary(queries.tokenizer_path("word_bpe_49k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_by_hand(rows, fan):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def climb(nodes):
        """The root, and of each node the [(left, right)] of its levels."""
        paths, at, own = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(own) > 1:
            for k, i in enumerate(at):
                run = own[i // fan * fan : i // fan * fan + fan]
                paths[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            at, own = [i // fan for i in at], [sha("".join(own[i : i + fan])) for i in range(0, len(own), fan)]
        return own[0], paths

    trees = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        low = "".join(c.lower() if c.isascii() else c for c in r[1]) if changed else r[1]
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low), r[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    climbed = {s: climb([x[2] for x in sorted(trees[s])]) for s in order}
    root, above = climb([climbed[s][0] for s in order])
    out = []
    for s, outer in zip(order, above, strict=True):
        for (_, _, h, altered, doc_id), path in zip(sorted(trees[s]), climbed[s][1], strict=True):
            for left, right in path + outer:
                altered = sha(left + altered + right)
            out.append((doc_id, h, climbed[s][0], root, sha("".join(a + b for a, b in path + outer)), altered, altered == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan, height", [(16, 3), (2, 1), (3, 2), (2, 3)])
def test_manifest_equals_a_tree_by_definition(odd, fan, height):
    got = merkle.manifest(odd, fan, height).collect()
    assert sorted(map(tuple, got), key=str) == manifest_by_hand(ODD, fan)
    assert {r["verified"] for r in got} == {True, False} and len({r["root"] for r in got}) == 1


def test_manifest_of_few_rows(spark, odd, none):
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(odd.where("source = 'alone'")).collect()
    assert len(one) == 1 and one[0]["root"] == one[0]["subroot"] == one[0]["leaf"] and one[0]["proof_sha256"] == sha("")


def test_blocks_stay_whole_between_buckets():
    import pyarrow as pa

    rows = [(k, b, i) for k in "ab" for b in range(3) for i in range(5)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("key", "block", "i"), map(list, zip(*rows[at : at + 4], strict=True)), strict=True))) for at in range(0, 30, 4)]
    tables = list(merkle.whole_blocks(iter(batches), 7))
    met = [{(r["key"], r["block"]) for r in t.to_pylist()} for t in tables]
    assert sum(t.num_rows for t in tables) == 30 and len(tables) > 2 and sum(map(len, met)) == 6
