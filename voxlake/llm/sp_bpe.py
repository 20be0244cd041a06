"""Operator 4, SentencePiece encoding and decoding by a table of last tokens.

The ids that a merge-type model gives a prefix of a text are the ids of a shorter prefix plus one token, and just one
token that ends there fits: the one whose pair with the shorter prefix's last token stays apart when the two are
encoded together. So a table of the last token of every prefix is filled from left to right with an automaton's
matches and pair tests, and the ids are read from it backwards.

Where no piece holds two characters side by side, what stands on both sides is encoded apart. A batch of texts is cut there
into chunks, and the tables of its distinct chunks are filled together, a column of prefixes of one length at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

SPACE = "▁"
#: Chunks of more characters are encoded one by one: they would make columns of few rows.
LONG = 48
#: Chunks whose tables are filled together, characters of texts whose chunks are told apart together, and those looked up together.
ROWS, CHARS, SLICE = 16_000, 4_000_000, 1 << 16


class Table:
    """Numbers by distinct numbers of 0 or more, for arrays of them at once; open addressing."""

    def __init__(self, most: int, kind: type = np.int32):
        bits = max(4, (2 * most).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, kind)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not there yet; the caller sees to it that there are not too many."""
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            won = self.keys[slots] == keys
            self.values[slots[won]] = values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & self.last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = self.values[slots]
        other = np.flatnonzero(there != keys)
        out[other] = -1
        other = other[there[other] >= 0]
        while len(other):
            slots[other] = at = (slots[other] + 1) & self.last
            there = self.keys[at]
            same = there == keys[other]
            out[other[same]] = self.values[at[same]]
            other = other[~same & (there >= 0)]
        return out

    def clear(self) -> None:
        self.keys.fill(-1)


class PieceModel:
    """A merge-type SentencePiece model with byte fallback, identity normalisation and a dummy prefix; keeps `cached` tested pairs."""

    def __init__(self, path: str, cached: int = 400_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.cached = sp.bos_id(), sp.eos_id(), cached
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_id = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and not sp.is_byte(i)}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        inside = [p for p in self.ids if "\n" in p or SPACE in p.lstrip(SPACE)]
        if inside:
            raise ValueError(f"pieces that cross chunks: {inside[:3]}")
        output = [b"" if i in special else bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.output = pa.array(output, pa.large_binary())
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        #: By last token (or none), whether a token may follow it, for long chunks; filled as pairs are met.
        self.rows: list[dict[int, bool]] = [{} for _ in range(len(self.pieces) + 1)]
        self.n_pairs = 0
        self._number_characters()
        self._grow_tree()
        del self.spelled
        self.pairs, self.n_kept = Table(cached, np.int8), 0

    def _number_characters(self) -> None:
        """Characters by number, 0 for those of no piece; pieces as rows of numbers; which two may stand side by side."""
        marks = sorted({c for p in self.ids for c in p})
        self.n_marks = len(marks) + 1
        self.mark = np.zeros(0x110000, np.uint16 if self.n_marks < 1 << 16 else np.int32)
        self.mark[[ord(c) for c in marks]] = np.arange(1, self.n_marks)
        self.length = np.zeros(len(self.pieces) + 1, np.int64)
        self.length[list(self.ids.values())] = [len(p) for p in self.ids]
        self.spelled = np.zeros((len(self.pieces) + 1, self.length.max()), np.int64)
        for p, i in self.ids.items():
            self.spelled[i, : len(p)] = self.mark[list(map(ord, p))]
        two = self.spelled[:, :-1] * self.n_marks + self.spelled[:, 1:]
        two = np.unique(two[(self.spelled[:, 1:] > 0)])
        self.beside = Table(2 * len(two), np.int8)
        self.beside.put(two, np.ones(len(two), np.int8))

    def _grow_tree(self) -> None:
        """The automaton as arrays. By node: its token or -1, its depth, its fallback, and the longest suffix that is a token (0: none)."""
        ids = np.array(sorted(self.ids.values()))
        at, tokens, depths, above, marks = np.zeros(len(ids), np.int64), [np.array([-1])], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        n = 1
        for d in range(self.spelled.shape[1]):
            ids, at = ids[self.length[ids] > d], at[self.length[ids] > d]
            new, at = np.unique(at * self.n_marks + self.spelled[ids, d], return_inverse=True)
            token = np.full(len(new), -1)
            ends = self.length[ids] == d + 1
            token[at[ends]] = ids[ends]
            above.append(new // self.n_marks)
            marks.append(new % self.n_marks)
            tokens.append(token)
            depths.append(np.full(len(new), d + 1))
            at = at + n
            n += len(new)
        self.token, self.depth = np.concatenate(tokens), np.concatenate(depths)
        parent, mark = np.concatenate(above), np.concatenate(marks)
        self.edges = Table(n)
        self.edges.put(parent[1:] * self.n_marks + mark[1:], np.arange(1, n, dtype=np.int32))
        self.fallback, self.longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(1, len(depths)):
            nodes = np.flatnonzero(self.depth == d)
            if d > 1:
                self.fallback[nodes] = self._next(self.fallback[parent[nodes]], mark[nodes])
            self.longest[nodes] = np.where(self.token[nodes] >= 0, nodes, self.longest[self.fallback[nodes]])

    def _next(self, nodes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Where the automaton goes from each node by a character."""
        out = self.edges.get(nodes * self.n_marks + marks).astype(np.int64)
        stuck = np.flatnonzero(out < 0)
        below = nodes[stuck]
        while True:
            out[stuck[below == 0]] = 0
            stuck, below = stuck[below > 0], self.fallback[below[below > 0]]
            if not len(stuck):
                return out
            got = self.edges.get(below * self.n_marks + marks[stuck])
            found = got >= 0
            out[stuck[found]] = got[found]
            stuck, below = stuck[~found], below[~found]

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by repeated merging of its best pair; ties fall to the left."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == float("inf"):
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stay_apart(self, left: int, right: int) -> bool:
        pair = [self.pieces[t] for t in (left, right) if t < len(self.pieces)]
        return self._merged("".join(pair)) == pair

    def _may_follow(self, left: int, right: int) -> bool:
        if self.n_pairs > 300_000:
            self.n_pairs = 0
            for row in self.rows:
                row.clear()
        self.n_pairs += 1
        found = self.rows[left][right] = self._stay_apart(left, right)
        return found

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers."""
        n, none, rows, seen = len(chunk), len(self.pieces), self.rows, -1
        last = [none] * (n + 1)  # the last token of each prefix; none: a character that is no piece
        size = [1] * (n + 1)
        for end, (length, token) in self.automaton.iter(chunk):
            if end != seen:
                before = last[end + 1 - length]
                fits = rows[before].get(token)
                if fits if fits is not None else self._may_follow(before, token):
                    last[end + 1], size[end + 1], seen = token, length, end
        out, at = [], n
        while at:
            token = last[at]
            if token != none:
                out.append(token)
            else:
                out.extend(self.byte_id[b] for b in reversed(chunk[at - 1].encode()))
            at -= size[at]
        out.reverse()
        return array("I", out).tobytes()

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether right may follow left; pairs that are new are tested, and kept as long as there is room."""
        keys = left * len(self.rows) + right
        out = self.pairs.get(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            pairs, at = np.unique(keys[new], return_inverse=True)
            apart = np.array([self._stay_apart(*divmod(p, len(self.rows))) for p in pairs.tolist()], np.int8)
            out[new] = apart[at]
            if self.n_kept + len(pairs) > self.cached:
                self.pairs.clear()
                self.n_kept = 0
            if len(pairs) <= self.cached:
                self.pairs.put(pairs, apart)
                self.n_kept += len(pairs)
        return out > 0

    def _encode_short(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of chunks of points, longest first, end to end, and their numbers; a character that is no piece is its point above all pieces."""
        n, none = len(starts), len(self.pieces)
        marks = self.mark[points]
        last = np.full((sizes[0] + 1, n), none, np.int32)  # by length of the prefix; none: a character that is no piece
        size = np.ones((sizes[0] + 1, n), np.int16)
        nodes = np.zeros(n, np.int64)
        for j in range(1, sizes[0] + 1):
            going = n - np.searchsorted(sizes[::-1], j)
            nodes = self._next(nodes[:going], marks[starts[:going] + j - 1])
            node = self.longest[nodes]
            chunk = np.flatnonzero(node)
            node = node[chunk]
            while len(chunk):
                token, length = self.token[node], self.depth[node]
                fits = self._fit(last[j - length, chunk].astype(np.int64), token)
                last[j, chunk[fits]], size[j, chunk[fits]] = token[fits], length[fits]
                node = self.longest[self.fallback[node[~fits]]]
                chunk = chunk[~fits][node > 0]
                node = node[node > 0]
        said, numbers, at, chunk = [], np.zeros(n, np.int64), sizes.copy(), np.arange(n)
        while len(chunk):
            token = last[at, chunk].astype(np.int64)
            odd = np.flatnonzero(token == none)
            token[odd] += points[starts[chunk[odd]] + at[odd] - 1]
            said.append((chunk, token))
            numbers[chunk] += 1
            at = at - size[at, chunk]
            chunk, at = chunk[at > 0], at[at > 0]
        ends, out = np.cumsum(numbers), np.zeros(numbers.sum(), np.int64)
        for k, (chunk, token) in enumerate(said, 1):
            out[ends[chunk] - k] = token
        return out, numbers

    def _spell(self, tokens: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens of chunks: characters that are no piece become their bytes in UTF-8."""
        point = tokens - len(self.pieces)
        if not (point >= 0).any():
            return tokens.astype(np.uint32), numbers
        wide = np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        chunk = np.repeat(np.arange(len(numbers)), numbers)
        many = np.repeat(wide, wide)
        after = np.repeat(np.cumsum(wide), wide) - np.arange(wide.sum()) - 1  # bytes of the character that follow
        points = np.repeat(point, wide)
        byte = points >> 6 * after
        byte = np.where(many == 1, byte, np.where(after == many - 1, byte | np.array([0, 0, 0xC0, 0xE0, 0xF0])[many], byte & 0x3F | 0x80))
        ids = np.where(points < 0, np.repeat(tokens, wide), np.array([self.byte_id[b] for b in range(256)])[byte & 0xFF])
        return ids.astype(np.uint32), np.bincount(chunk, weights=wide, minlength=len(numbers)).astype(np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without begin and end, end to end as 32-bit integers, and the number of each text's."""
        ids, numbers, part, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [], 0
        for text in texts:
            if n and n + len(text) > CHARS:
                a, b = self._encode_part(part)
                ids.append(a)
                numbers.append(b)
                part, n = [], 0
            part.append(text)
            n += len(text)
        if n:
            a, b = self._encode_part(part)
            ids.append(a)
            numbers.append(b)
        else:
            numbers.append(np.zeros(len(part), np.int64))
        return np.concatenate(ids), np.concatenate(numbers)

    def _encode_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join([SPACE + t for t in texts if t]).encode("utf-32-le"), np.uint32).astype(np.int32)
        points[points == ord(" ")] = ord(SPACE)
        cut = np.ones(len(points), bool)
        for i in range(0, len(points) - 1, SLICE):
            marks = self.mark[points[i : i + SLICE + 1]].astype(np.int64)
            cut[i : i + len(marks) - 1] = self.beside.get(marks[:-1] * self.n_marks + marks[1:]) < 0
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        cut[ends[sizes > 0] - 1] = True
        stops = np.flatnonzero(cut) + 1
        offsets = np.concatenate([[0], stops])
        chunks = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets * 4), pa.py_buffer(points)]).dictionary_encode()
        kind = chunks.indices.to_numpy()
        n_kinds = len(chunks.dictionary)
        # The chunks that differ, the longest first.
        first = np.frombuffer(chunks.dictionary.buffers()[1], np.int64)[: n_kinds + 1] // 4
        points = np.frombuffer(chunks.dictionary.buffers()[2], np.int32)
        starts, sizes_of = first[:-1], np.diff(first)
        order = np.argsort(-sizes_of, kind="stable")
        tokens, numbers = [], []
        long = int((sizes_of > LONG).sum())
        for k in order[:long]:
            one = array("I", self.encode_chunk(points[starts[k] : starts[k] + sizes_of[k]].astype(np.uint32).tobytes().decode("utf-32-le")))
            tokens.append(np.array(one, np.uint32))
            numbers.append(np.array([len(one)]))
        for i in range(long, n_kinds, ROWS):
            some = order[i : i + ROWS]
            ids, number = self._spell(*self._encode_short(points, starts[some], sizes_of[some]))
            tokens.append(ids)
            numbers.append(number)
        tokens, numbers = np.concatenate(tokens), np.concatenate(numbers)
        place = np.empty(n_kinds, np.int64)
        place[order] = np.arange(n_kinds)
        kind = place[kind]
        # Each chunk's ids are taken from those of its kind.
        each = numbers[kind]
        after = np.cumsum(each)
        ids = tokens[np.arange(after[-1]) + np.repeat(np.cumsum(numbers)[kind] - after, each)]
        upto = np.concatenate([[0], after])[np.searchsorted(stops, ends, "right")]
        return ids, np.diff(upto, prepend=0)

    def encode(self, text: str) -> bytes:
        """Ids of a text without begin and end, as little-endian 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def forget(self) -> None:
        """Empty the tables of long chunks; that of pairs is of one size."""
        self.n_pairs = 0
        for row in self.rows:
            row.clear()

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; the dummy prefix goes, begin and end give nothing."""
        return self.decode_all(np.frombuffer(ids, np.uint32), np.array([len(ids) // 4]))[0]

    def decode_all(self, ids: np.ndarray, numbers: np.ndarray) -> list[str]:
        """As decode, of texts whose ids stand end to end."""
        said = self.output.take(pa.array(ids))
        upto = np.frombuffer(said.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(numbers)])].tolist() if len(ids) else [0] * (len(numbers) + 1)
        said = memoryview(said.buffers()[2] or b"")
        return [bytes(said[a:b]).removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(upto, upto[1:], strict=False)]


MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each worker process and path."""
    if path not in MODELS:
        MODELS[path] = PieceModel(path)
    return MODELS[path]


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text), and with ids=True also ids.

    Ids have begin and end. A null text counts as empty. Rows stay apart even if repeated; extra columns are ignored. A text of any
    length is encoded whole, in time in proportion to it; an empty table gives none.
    """
    import hashlib

    more = ", ids array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        begin, end = array("I", [m.bos]).tobytes(), array("I", [m.eos]).tobytes()
        for batch in batches:
            n, a, d, kept, at = [], [], [], [], 0
            said, numbers = m.encode_all([t or "" for t in batch.column("text").to_pylist()])
            for number, back in zip(numbers.tolist(), m.decode_all(said, numbers), strict=True):
                coded = begin + said[at : at + number].tobytes() + end
                at += number
                n.append(len(coded) // 4)
                a.append(hashlib.sha256(coded).hexdigest())
                d.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    kept.append(coded)
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())}
            if ids:
                ends = pa.array([0, *accumulate(n)], pa.int32())
                cols["ids"] = pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(kept))]))
            yield pa.RecordBatch.from_pydict(cols)
        m.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(base.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
