"""Token counts of a byte-level BPE vocabulary without encoding: most pre-tokens are one token, and that is proved beforehand.

Offline, on the driver, every string of the vocabulary is merged by the vocabulary's own rules. Those that end as one token go into a
table; a pre-token found there counts 1 and is never merged. Only the rest is merged, by a heap of adjacent pairs.
What goes to the tasks is the vocabulary's merges, that table and a few ranges of characters: bounded by the vocabulary.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import base

#: The pattern of byte-level pre-tokens, with the letters and digits that a library knows in place of L and N.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
#: Results of merging are kept for pre-tokens up to this many characters, so many of them at once.
KEPT_CHARS, KEPT = 48, 200_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def unknown_characters(path: str) -> str:
    """Letters and digits of this Python's Unicode tables that the library's older tables take for neither, as ranges of a class."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    found: list[int] = []
    for kind, mate in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        asked = regex.findall(kind, "".join(map(chr, (i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000))))
        # The text is "aX aX ..": the piece that holds the a of a known character ends behind that character.
        known = {stop // 3 for _, (start, stop) in split(" ".join(mate + c for c in asked)) if stop % 3 == 2 and start <= stop - 2}
        found += [ord(c) for i, c in enumerate(asked) if i not in known]
    ranges: list[list[int]] = []
    for o in sorted(set(found)):
        if ranges and ranges[-1][1] == o - 1:
            ranges[-1][1] = o
        else:
            ranges.append([o, o])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Merges:
    """Pairs of token numbers, as one number, with their rank; and by rank what a pair becomes."""

    def __init__(self, vocab: dict[str, int], pairs: list[list[str]]):
        of = byte_characters()
        if lacking := [b for b, c in of.items() if c not in vocab]:
            raise ValueError(f"the vocabulary lacks the bytes {lacking[:5]}")
        self.first = [vocab[of[b]] for b in range(256)]
        self.rank = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.become, self.none = [vocab[a + b] for a, b in pairs], len(pairs)

    def count(self, data: bytes) -> int:
        """Tokens after all merges: the pair of least rank first, the leftmost of equal ones."""
        if len(data) > 64:
            return self._count_long(data)
        get, none, ids = self.rank.get, self.none, [self.first[b] for b in data]
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = self.become[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return len(ids)

    def _count_long(self, data: bytes) -> int:
        """The same in n log n steps: a heap of pairs, those that a merge has broken up being skipped."""
        ids, get = [self.first[b] for b in data], self.rank.get
        n = left = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(found, i) for i in range(n - 1) if (found := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.become[rank], -1
            left -= 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (found, x))
        return left


class Vocabulary:
    """What the tasks need of a byte-level BPE file; other kinds of tokenizers are refused by name."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        wanted = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        odd = {k: model.get(k) for k, v in wanted.items() if (model.get(k) or None) != (v or None)}
        if odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"only byte-level BPE without a normalizer and a prefix space is counted; this has {odd or spec['normalizer'] or pre}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or word ends into account are not supported")
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.merges = Merges(model["vocab"], [p.split(" ") if isinstance(p, str) else p for p in model["merges"]])
        self.unknown = unknown_characters(path)
        self.whole = self._proved(model["vocab"])

    def _proved(self, vocab: dict[str, int]) -> list[str]:
        """Strings of the vocabulary that are one pre-token and merge into one token."""
        back = {c: b for b, c in byte_characters().items()}
        split, out = Counting(self, {}), []
        for text in vocab:
            data = bytes(back[c] for c in text if c in back)
            try:
                word = data.decode()
            except UnicodeDecodeError:
                continue  # a part of a character is no pre-token
            if len(data) == len(text) and split.pre_tokens(word) == [word] and self.merges.count(data) == 1:
                out.append(word)
        return out


def narrow_pattern() -> str:
    """The pattern for texts of the first 256 characters, with their letters and digits spelt out: the quicker `re` takes it."""
    of = {k: "".join(chr(i) for i in range(256) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
    white = r"\t-\r \x85\xa0"
    other = f"[^{white}{of['L']}{of['N']}]"
    return PATTERN.replace("{L}", f"[{of['L']}]").replace("{N}", f"[{of['N']}]").replace("{O}", other).replace(r"(?!\S)", f"(?![^{white}])").replace(r"\s", f"[{white}]")


class Counting(dict):
    """Tokens of a pre-token: 1 from the proved table, else by merging, kept in the younger of two tables while there is room."""

    def __init__(self, vocabulary: Vocabulary, whole: dict[str, int]):
        super().__init__(whole)
        self.vocabulary, self.proved, self.old = vocabulary, len(whole), {}
        new = vocabulary.unknown
        usual = {"{L}": r"\p{L}", "{N}": r"\p{N}", "{O}": r"[^\s\p{L}\p{N}]"}
        older = {"{L}": rf"[\p{{L}}--[{new}]]", "{N}": rf"[\p{{N}}--[{new}]]", "{O}": rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])"} if new else usual
        of = lambda names: regex.compile(regex.sub(r"\{[LNO]\}", lambda m: names[m[0]], PATTERN), regex.V1).findall
        self.usual, self.older, self.holds_new = of(usual), of(older), regex.compile(f"[{new}]").search if new else lambda text: None
        self.narrow = re.compile(narrow_pattern()).findall
        self.added = regex.compile("|".join(map(regex.escape, vocabulary.added))) if vocabulary.added else None

    def __missing__(self, word: str) -> int:
        n = self.old.get(word) or self.vocabulary.merges.count(word.encode())
        if len(word) <= KEPT_CHARS:
            if len(self) - self.proved >= KEPT:
                self.old = {w: self[w] for w in islice(self, self.proved, None)}
                for w in self.old:
                    del self[w]
            self[word] = n
        return n

    def pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.older if self.holds_new(text) else self.usual)(text)
        return self.narrow(text)

    def tokens(self, text: str) -> int:
        parts = self.added.split(text) if self.added and self.added.search(text) else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pre_tokens(part))) for part in parts)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text): as the library counts, without begin and end.

    Strings of added tokens in a text are one token each. A null text counts as empty and has no token; a text of any length is
    counted whole, and a pre-token of any length is merged in n log n steps; repeated rows stay apart; an empty table gives none;
    extra columns are ignored. No shuffle; a task holds one Arrow batch, bounded by bytes or one text.
    """
    base.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(sent.value, dict.fromkeys(sent.value.whole, 1))
        for batch in batches:
            n = pa.array([counting.tokens(t.as_py() or "") for t in batch.column("text")], pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": pc.greater(n, limit)})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(base.lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
