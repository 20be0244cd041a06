"""The pipeline against a brute-force version of its stages, and its stages on odd rows."""

import hashlib
from collections import Counter

import corpus_pipeline as P
import pytest
from conftest import SF
from test_pairs import linked_by_force, removed_by_force
from voxlake.llm import base, mixing, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        done = base.stored(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, done))
        docs = done
    return out


def test_columns(stages):
    assert all(set(done.columns) == set(P.COLUMNS) for _, done in stages[:-1])


def test_toxic_documents_go(stages):
    docs, done = stages[0]
    rows, kept = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in done.collect()}
    model = toxicity.fit_toxicity(docs, docs.sparkSession.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {i: t for i, t in rows.items() if model.score(t) < toxicity.THRESHOLD} and len(kept) > 0.9 * len(rows)


def test_near_copies_go(stages):
    docs, done = stages[1]
    want = linked_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in done.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_repeats_go(stages):
    docs, done = stages[2]
    rows = docs.collect()
    want = removed_by_force([r["text"] for r in rows])
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    for r, (n, gone, _, sha) in zip(rows, want, strict=True):
        if not gone:
            assert got[r["doc_id"]] == r["text"]
        elif r["doc_id"] in got and r["text"].isascii():
            assert hashlib.sha256(got[r["doc_id"]].encode()).hexdigest() == sha
        elif r["doc_id"] not in got:
            assert gone > 0


def test_mix_takes_what_the_operator_says(spark, stages):
    docs, done = stages[3]
    words = Counter()
    for r in done.collect():
        words[r["doc_id"]] += len(base.WORD.findall(r["text"] or ""))
    sized = [(r["doc_id"], r["source"], len(base.WORD.findall(r["text"] or ""))) for r in docs.collect()]
    total = Counter()
    for _, s, n in sized:
        total[s] += n
    names = sorted(total)
    goal = dict(zip(names, mixing.capped_targets([total[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(total.values())), strict=True))
    for name in names:
        assert abs(sum(words[d] for d, s, _ in sized if s == name) - goal[name]) <= 1
    assert all(words[d] <= 2 * n for d, _, n in sized)


def test_ids(stages):
    import sentencepiece

    docs, done = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = Counter((r["doc_id"], len(library.encode(r["text"] or "")) + 2) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in done.collect()) == want


def test_run_is_the_stages(spark, stages):
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in P.run(spark, SF).collect())
    assert got == Counter((r["doc_id"], r["ids_sha256"]) for r in stages[-1][1].collect())


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, "a b", "en", None, 3), (4, "x " * 400, "en", "s", 800), (4, "x " * 400, "en", "s", 800)], DOCS)
    want = [[1, 2, 3, 4, 4, None], [1, 2, 3, 4], [1, 2, 3], [3], [3]]
    for docs, ids in ((odd, want), (odd.limit(0), [[]] * 5)):
        for (name, stage), left in zip(P.STAGES, ids, strict=True):
            docs = base.stored(stage(spark, docs, SF), "test-odd")
            got = [r["doc_id"] for r in docs.select("doc_id").collect()]
            # the mix takes a document up to twice
            assert (sorted(set(got)) if name in ("mixing", "sentencepiece") else sorted(got, key=str)) == left, name
