"""Operator 5, suffix-array deduplication of repeated byte strings.

Every window of W bytes has an anchor, the K-byte string in it of least hash, so equal windows have equal anchors at
equal places. Suffixes are sorted per anchor string and not over the whole corpus: an anchor that occurs once is
dropped by a count; occurrences with equal surroundings (the bytes of all windows that have this anchor) are one class.
The classes of an anchor are put in suffix order by a mergesort whose comparisons find the common extension by binary
search over prefix polynomial hashes, and check it byte by byte. The same order of what stands left of the anchor, read
backwards, and a merge of neighbouring suffixes from long to short common extensions give, for each class, how far
windows with a second occurrence reach to either side.

An anchor with more classes than one task shall sort is split: its windows by quarters of the places that the anchor has
in them, and these by the bytes that all windows of a quarter hold. Such a part has the classes of shorter surroundings,
and is sorted like an anchor, or split again; a part of one place is one window, and so one class.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

W, K = 200, 24
SEGMENT = 1 << 19
#: Classes of an anchor, or of a part of it, that one task sorts.
MOST = 256
#: Anchors that a bucket receives, about, and anchors that a task deals at once. Of one that these hold more often than twice, the rest passes by.
BUCKET, DEALT = 150_000, 45_000
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64 for i below n at least."""
    if len(_POWERS[0]) < n:
        n = max(n, SEGMENT + W)
        inverse = pow(BASE, -1, 1 << 64)
        for k, b in enumerate((BASE, inverse)):
            x = np.full(n, _U(b))
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _POWERS[k] = x
    return _POWERS[0], _POWERS[1]


_POWERS = [np.ones(0, _U), np.ones(0, _U)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(32))


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hash, place, first and last window start of each anchor of a text; the anchor lies in all these windows."""
    parts = []
    for s in range(0, max(0, len(data) - W + 1), SEGMENT):
        x = np.frombuffer(data, np.uint8)[s : s + SEGMENT + W - 1]
        h, (_, down) = _prefix_hashes(x), _powers(len(x))
        grams = _mixed((h[K:] - h[:-K]) * down[: len(x) - K + 1])
        key = (grams & ~_U(0xFFFFF)) | np.arange(len(grams), dtype=_U)
        span, width = W - K + 1, 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        place = (key & _U(0xFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        at = place[first]
        parts.append((grams[at].view(np.int64), at + s, first + s, last + s))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


class Strings:
    """Byte strings with prefix hashes; order() is their mergesort, common() their common extension."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.hashes = [_prefix_hashes(np.frombuffer(s, np.uint8)).tolist() for s in strings]

    def common(self, i: int, j: int) -> int:
        a, b = self.hashes[i], self.hashes[j]
        low, high = 0, min(len(a), len(b)) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if a[mid] == b[mid]:
                low = mid
            else:
                high = mid - 1
        s, t = self.strings[i], self.strings[j]
        if s[:low] != t[:low]:  # two strings with one hash
            low = next(k for k in range(low) if s[k] != t[k])
        return low

    def order(self) -> list[int]:
        def compare(i: int, j: int) -> int:
            k = self.common(i, j)
            s, t = self.strings[i], self.strings[j]
            return s[k] - t[k] if k < min(len(s), len(t)) else len(s) - len(t) or i - j

        return sorted(range(len(self.strings)), key=cmp_to_key(compare))  # a mergesort


def reach(contexts: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """For each (bytes, place of the anchor in them): how many bytes left of the anchor's start and right of it stand in
    windows of W bytes that also occur around another of the contexts; (0, 0) for none. All windows hold the anchor's
    start, so W bytes at most stand right of it."""
    right, left = Strings([c[a:] for c, a in contexts]), Strings([c[:a][::-1] for c, a in contexts])
    by_right, rank = right.order(), [0] * len(contexts)
    by_left = left.order()
    for r, i in enumerate(by_left):
        rank[i] = r
    reached = [(0, 0)] * len(contexts)
    joints = sorted(((right.common(i, j), i, j) for i, j in zip(by_right, by_right[1:], strict=False)), reverse=True)
    root, members = list(range(len(contexts))), {i: [rank[i]] for i in range(len(contexts))}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for shared, i, j in joints:
        i, j = find(i), find(j)
        if len(members[i]) < len(members[j]):
            i, j = j, i
        many, few = members[i], members.pop(j)
        for r in few:
            at = bisect_left(many, r)
            for other in many[max(0, at - 1) : at + 1]:
                x, y = by_left[r], by_left[other]
                back = left.common(x, y)
                if back + shared >= W:
                    for z in (x, y):
                        reached[z] = (max(reached[z][0], back), max(reached[z][1], shared))
        members[i] = sorted(many + few)
        root[j] = i
    return reached


_ROW = np.dtype([("g", "<i8"), ("c", "<i8"), ("id", "<i8"), ("th", "<i8"), ("at", "<i4"), ("back", "u1"), ("fore", "u1")])


def _rows(i: int, h: int, data: bytes) -> np.ndarray:
    """The anchors of a text: hash, class (that of the surroundings), text, place, and its greatest and least distance from a window's start."""
    g, at, first, last = anchors(data)
    rows = np.zeros(len(g), _ROW)
    rows["g"], rows["id"], rows["th"], rows["at"], rows["back"], rows["fore"] = g, i, h, at, at - first, at - last
    around = (xxhash.xxh3_64_intdigest(data[f : t + W], a) for f, t, a in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True))
    rows["c"] = np.fromiter(around, _U, len(g)).view(np.int64)
    return rows


def _packed(buckets: int):
    """The anchors of each DEALT or so as one binary for each bucket of their hashes (kind 0). Of an anchor that is among them more
    than twice, two go there; the others are known to repeat, and pass by (kind 1)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for i, h, text in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True):
                yield _rows(i, h, (text.as_py() or "").encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for rows in base.gathered(each(batches), DEALT):
            rows = rows[np.argsort(rows["g"], kind="stable")]
            third = np.zeros(len(rows), bool)
            third[2:] = rows["g"][2:] == rows["g"][:-2]
            over, rows = rows[third], rows[~third]
            bucket = (rows["g"].view(_U) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            parts, at = [x.tobytes() for x in np.split(rows, cuts)], bucket[np.concatenate([[0], cuts])].tolist()
            kinds = [0] * len(parts)
            if len(over):
                turn += 1
                parts.append(over.tobytes())
                at.append(-1 - (int(over["th"].view(_U)[0]) + turn) % buckets)
                kinds.append(1)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "bucket": pa.array(at, pa.int64()), "rows": pa.array(parts, pa.binary())})

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the anchors of a task's buckets those that occur twice."""

    def out(rows):
        return pa.RecordBatch.from_pydict({k: pa.array(rows[k].astype(np.int32) if k in ("at", "back", "fore") else rows[k].copy()) for k in _ROW.names})

    held = []
    for batch in batches:
        for kind, x in zip(batch.column("kind").to_pylist(), batch.column("rows"), strict=True):
            rows = np.frombuffer(x.as_buffer(), _ROW)
            if kind:
                yield out(rows)
            else:
                held.append(rows)
    if held:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["g"], kind="stable")]
        same = rows["g"][1:] == rows["g"][:-1]
        twice = np.zeros(len(rows), bool)
        twice[1:] |= same
        twice[:-1] |= same
        yield out(rows[twice])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            data = (text.as_py() or "").encode()
            rows += [(x["g"], x["c"], data[x["at"] - x["back"] : x["at"] - x["fore"] + W], x["back"]) for x in wanted.as_py()]
        g, c, b, a = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int64()), "c": pa.array(c, pa.int64()), "bytes": pa.array(b, pa.binary()), "a": pa.array(a, pa.int32())})


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of key: the reach of each class. One anchor's, or part's, classes, MOST at most, are held at a time."""
    now, held = None, []

    def done():
        if len(held) > 1:
            for (t, _, _), (back, ahead) in zip(held, reach([x[1:] for x in held]), strict=True):
                if ahead:
                    yield now, t, back, ahead

    def out(rows):
        key, t, b, a = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "t": pa.array(t, pa.int64()), "back": pa.array(b, pa.int32()), "ahead": pa.array(a, pa.int32())})

    for batch in batches:
        rows = []
        for key, t, b, a in zip(*(batch.column(k).to_pylist() for k in ("key", "t", "bytes", "a")), strict=True):
            if key != now:
                rows += done()
                now, held = key, []
            held.append((t, b, a))
        if rows:
            yield out(rows)
    if rows := list(done()):
        yield out(rows)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once for each quarter of the places low to high that the anchor may have in a window, with the surroundings
    that windows of these places take up; key: the bytes that all of them hold."""
    for batch in batches:
        out = []
        for g, c, low, high, data, a in zip(*(batch.column(k).to_pylist() for k in ("g", "c", "low", "high", "bytes", "a")), strict=True):
            least, step = a - (len(data) - W), -(-(high - low + 1) // 4)
            for x in range(low, high + 1, step):
                y = min(high, x + step - 1)
                if a >= x and least <= y:
                    most = min(y, a)
                    part = data[a - most : a - max(x, least) + W]
                    key = xxhash.xxh3_64_intdigest(data[a - x : a - y + W], x << 8 | y) - (1 << 63)
                    out.append((g, c, key, xxhash.xxh3_64_intdigest(part, most) - (1 << 63), x, y, part, most))
        kinds = {"g": pa.int64(), "c": pa.int64(), "key": pa.int64(), "t": pa.int64(), "low": pa.int32(), "high": pa.int32(), "bytes": pa.binary(), "a": pa.int32()}
        cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), cols, strict=True)})


def _covers(contexts: DataFrame) -> DataFrame:
    """g, c, back, ahead: reaches of the classes (g, c, bytes, a) of anchors of several classes; a class may have several rows."""
    rows = contexts.withColumns({"key": F.col("g"), "t": F.col("c"), "low": F.lit(0), "high": F.lit(W - K)})
    covers, level = None, 0
    while True:
        classes = rows.select("key", "t", "bytes", "a", F.lit(1).alias("m"))
        if level:
            classes = base.stored(rows.groupBy("key", "t").agg(F.count("*").alias("m"), F.min(F.struct("bytes", "a")).alias("x")).select("key", "t", "x.*", "m"), "dedup-parts")
        large = base.stored(classes.groupBy("key").count().where(F.col("count") > MOST).select("key"), "dedup-large")
        sorted_here = classes.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "t")
        found = sorted_here.mapInArrow(base.lean(_reaches), "key long, t long, back int, ahead int")
        if level:
            # surroundings of several classes, cut down to equal ones, repeat as they are
            full = classes.where("m > 1").select("key", "t", F.col("a").alias("back"), (F.length("bytes") - F.col("a")).alias("ahead"))
            found = base.stored(found.unionByName(full), "dedup-found")
            found = rows.select("g", "c", "key", "t").join(found, ["key", "t"]).select("g", "c", "back", "ahead")
        else:
            found = found.select(F.col("key").alias("g"), F.col("t").alias("c"), "back", "ahead")
        found = base.stored(found, "dedup-reaches")
        covers = found if covers is None else covers.unionByName(found)
        if large.isEmpty():
            return covers
        kinds = "g long, c long, key long, t long, low int, high int, bytes binary, a int"
        before = rows
        rows = base.stored(rows.join(large, "key").select("g", "c", "low", "high", "bytes", "a").mapInArrow(base.lean(_split), kinds), "dedup-split")
        if level:
            base.forget(before)
            base.forget(classes)
        level += 1


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with id and th, spans): spans holds for each id, th the array of byte ranges (start, stop) to remove, in no order.

    id is doc_id (null: -1) and th a hash of the text: rows that share both share their spans, which equal texts always do.
    Classes are told apart by the anchor's hash and a hash of all bytes around it, together 128 bits.
    """
    spark = docs.sparkSession
    base.bounded_batches(spark)
    keyed = docs.withColumns({"id": F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), "th": F.xxhash64("text")})
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * n_bytes // ((W - K) * BUCKET)))
    packed = keyed.select("id", "th", "text").mapInArrow(base.lean(_packed(buckets)), "kind int, bucket long, rows binary").repartition(buckets, "bucket")
    again = base.stored(packed.mapInArrow(base.lean(_repeated), "g long, c long, id long, th long, at int, back int, fore int"), "dedup-repeated")
    classes = again.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at", "back", "fore")).alias("one"))
    classes = base.stored(classes.select("g", "c", "n", "one.*"), "dedup-classes")
    several = base.stored(classes.groupBy("g").count().where("count > 1").select("g"), "dedup-several")
    wanted = classes.join(several, "g").groupBy("id", "th").agg(F.collect_list(F.struct("g", "c", "at", "back", "fore")).alias("wanted"))
    texts = keyed.select("id", "th", "text").join(wanted.hint("shuffle_hash"), ["id", "th"])
    contexts = base.stored(texts.select("text", "wanted").mapInArrow(base.lean(_contexts), "g long, c long, bytes binary, a int").dropDuplicates(["g", "c"]), "dedup-contexts")
    covers = _covers(contexts).unionByName(classes.where("n > 1").select("g", "c", "back", (W - F.col("fore")).alias("ahead")))
    covers = base.stored(covers.groupBy("g", "c").agg(F.max("back").alias("back"), F.max("ahead").alias("ahead")), "dedup-covers")
    for done in (several, contexts, classes):
        base.forget(done)
    spans = again.select("g", "c", "id", "th", "at").join(covers, ["g", "c"]).select("id", "th", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("ahead")).alias("stop"))
    spans = base.stored(spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "dedup-spans")
    for done in (again, covers):
        base.forget(done)
    return keyed, spans


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges in order, those that meet or overlap made one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def cut(text: str | None, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """n_bytes, n_removed, n_spans and the bytes that remain."""
    data = (text or "").encode()
    runs = merged([(x["start"], x["stop"]) for x in spans or []])
    kept, at = [], 0
    for start, stop in runs:
        kept.append(data[at:start])
        at = stop
    return len(data), sum(b - a for a, b in runs), len(runs), b"".join([*kept, data[at:]])


def dedup_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: bool = False) -> DataFrame:
    """The kept columns with n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text), and kept_text if text.

    A byte is removed if it stands in a string of W bytes that also starts elsewhere in any text; all occurrences go.
    A null text counts as empty; rows with equal texts repeat each other. kept_text drops what removal left of cut characters.
    A text's spans meet in one list, a few bytes for each run of 200 that goes. An empty table gives none; extra columns are ignored.
    """
    keyed, spans = removed_spans(docs)
    asked = keyed.select(*keep, "id", "th", F.col("text").alias("_text")).join(spans.hint("shuffle_hash"), ["id", "th"], "left").select(*keep, "_text", "spans")
    fields = asked.select(*keep).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *([("kept_text", "string")] if text else [])):
        fields = fields.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = [cut(t.as_py(), s.as_py()) for t, s in zip(batch.column("_text"), batch.column("spans"), strict=True)]
            cols = {k: batch.column(k) for k in keep} | {name: pa.array([r[j] for r in rows], pa.int64()) for j, name in enumerate(("n_bytes", "n_removed", "n_spans"))}
            cols["kept_sha256"] = pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())
            if text:
                cols["kept_text"] = pa.array([r[3].decode("utf-8", "ignore") for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return asked.mapInArrow(base.lean(run), fields)
