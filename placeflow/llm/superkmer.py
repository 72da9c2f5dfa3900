"""Super-k-mers: all windows of every text, dealt to buckets by their minimiser, as packed strings.

A window of `window` units (words or bytes) belongs to the smallest hash of its `gram`-unit pieces. Consecutive windows with one
minimiser travel as one string, so equal windows meet in one bucket and a text moves about three times instead of `window` times.
A task sends a string that repeats in its buffer once, for the smallest doc_id; the repeats are decided on the spot. So a bucket
grows with the number of tasks that saw a string, not with the number of its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import beside, bound_batches, input_partitions, stage
from ._text import Rolling, blocks, mix, spans, utf8

#: Bytes of strings that a task gathers before it deals them out, of the input for each bucket, and of a block of texts.
_BUFFER, _PART, _PIECE = 32 << 20, 4 << 20, 1 << 19
#: Bytes of one minimiser's strings beyond which it is split, and of packed strings that a task holds before it looks for such ones.
HOT, HELD = 4 << 20, 48 << 20
#: Documents whose ids may be broadcast.
SMALL = 1 << 20
_ROLL = Rolling(seed=3)


class Units(NamedTuple):
    """Texts of some rows as units: a buffer in which unit i is bytes at[i] to end[i], hashes of grams, each row's first unit."""

    buf: np.ndarray
    at: np.ndarray
    end: np.ndarray
    grams: np.ndarray
    first: np.ndarray


class Runs(NamedTuple):
    """Strings of consecutive windows with one minimiser."""

    minimiser: np.ndarray  #: 32 bits of its hash; strings with others are only looked at together
    doc: np.ndarray
    row: np.ndarray  #: tells rows with one doc_id apart, 0 where ids don't repeat
    start: np.ndarray  #: unit in its text where the first window starts
    windows: np.ndarray
    offs: np.ndarray  #: where each string starts in text, and the end
    text: np.ndarray

    def pick(self, at: np.ndarray) -> Runs:
        size = np.diff(self.offs)[at]
        return Runs(*(x[at] for x in self[:5]), np.concatenate([[0], np.cumsum(size)]), self.text[spans(self.offs[at], size)])

    def pack(self) -> bytes:
        """Differences of what grows along a text, bytes of one rank together: most are zeros."""
        numbers = np.stack([np.diff(self.doc, prepend=0), np.diff(self.row, prepend=0), np.diff(self.start, prepend=0), self.windows, np.diff(self.offs)])
        planes = np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(5, -1, 8).transpose(0, 2, 1)
        return zstandard.compress(b"".join((np.array([len(self.doc)]).tobytes(), self.minimiser.tobytes(), planes.tobytes(), self.text.tobytes())), 1)


def unpack(blobs: list[bytes]) -> Runs:
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    minimisers, texts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        minimisers.append(np.frombuffer(raw, np.uint32, n, 8))
        planes = np.frombuffer(raw, np.uint8, 40 * n, 8 + 4 * n).reshape(5, 8, n)
        numbers = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(5, n)
        for part, x, steps in zip(parts, numbers, (True, True, True, False, False), strict=True):
            part.append(np.cumsum(x) if steps else x)
        texts.append(np.frombuffer(raw, np.uint8, offset=8 + 44 * n))
    doc, row, start, windows, size = (np.concatenate(x) for x in parts)
    return Runs(np.concatenate(minimisers), doc, row, start, windows, np.concatenate([[0], np.cumsum(size)]), np.concatenate(texts))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n, step = len(h) - width + 1, 1
    if n <= 0:
        return h[:0]
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:n], h[width - step :][:n])


def cut_runs(units: Units, doc: np.ndarray, row: np.ndarray, window: int, gram: int) -> Runs:
    low = sliding_min(units.grams, window - gram + 1)
    n = np.maximum(np.diff(units.first) - window + 1, 0)
    at = spans(units.first[:-1], n)
    own = np.repeat(np.arange(len(n)), n)
    value = low[at]
    head = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))) if len(at) else np.zeros(0, np.int64)
    windows = np.diff(np.append(head, len(at)))
    first, own = at[head], own[head]
    begin = units.at[first]
    size = units.end[first + windows + window - 2] - begin
    return Runs((mix(value[head]) >> np.uint64(32)).astype(np.uint32), doc[own], row[own], first - units.first[own], windows, np.concatenate([[0], np.cumsum(size)]), units.buf[spans(begin, size)])


def equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes at a and at b are the same, for each pair."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 1 << 15):
        s = size[lo : lo + (1 << 15)]
        differs = text[spans(a[lo : lo + len(s)], s)] != text[spans(b[lo : lo + len(s)], s)]
        bad = np.repeat(np.arange(len(s)), s)[differs]
        out[lo + bad] = False
    return out


def sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where a new key may begin in it: places whose high bits differ from those before.

    High bits and places are sorted as one number, which is several times faster than sorting places by key.
    """
    bits = np.uint64(max(1, int(len(key) - 1).bit_length()))
    both = np.sort((key >> bits << bits) | np.arange(len(key), dtype=np.uint64))
    high = both >> bits
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), np.append(True, high[1:] != high[:-1]) if len(key) else np.zeros(0, bool)


def exact_groups(key: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order, and for each item in that order the number of its group: items are together if their bytes are equal."""
    order, head = sorted_places(key)
    a, s = at[order], size[order]
    group = np.cumsum(head) - 1
    lead = np.flatnonzero(head)[group] if len(order) else group
    rest = np.flatnonzero(lead != np.arange(len(order)))
    same = s[rest] == s[lead[rest]]
    same[same] = equal_bytes(text, a[rest][same], a[lead[rest]][same], s[rest][same])
    if not same.all():  # strings that look alike by hash: told apart by what they hold
        clash = np.zeros(len(order), bool)
        clash[lead[rest[~same]]] = True
        clash = clash[lead]
        names: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(clash).tolist():
            group[i] = names.setdefault((int(group[i]), text[a[i] : a[i] + s[i]].tobytes()), len(order) + len(names))
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
        group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    return order, group


def _settled(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Which strings stay, and which are gone because an equal string has a smaller doc_id here."""
    size = np.diff(runs.offs)
    key = np.empty(len(size), np.uint64)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(runs.offs, runs.offs[lo] + _PIECE, "right")) - 1)
        own = runs.offs[lo : hi + 1] - runs.offs[lo]
        key[lo:hi] = _ROLL.ranges(runs.text[runs.offs[lo] : runs.offs[hi]], own[:-1], own[1:])
        lo = hi
    order, group = exact_groups(key, runs.text, runs.offs[:-1], size)
    low = np.minimum.reduceat(runs.doc[order], np.flatnonzero(np.append(True, group[1:] != group[:-1])))[group]
    gone = np.zeros(len(size), bool)
    gone[order] = runs.doc[order] > low
    return np.flatnonzero(~gone), np.flatnonzero(gone)


def pack_marks(doc: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Removed windows by document and row: their starts, then their numbers."""
    if not len(doc):
        return doc, row, []
    order = np.lexsort((row, doc))
    d, r = doc[order], row[order]
    head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])))
    both = np.stack([start[order], windows[order]], axis=1).astype(np.int32)
    return d[head], r[head], [both[a:b].tobytes() for a, b in zip(head, np.append(head[1:], len(d)), strict=True)]


_SENT = "bucket int, done boolean, doc_id long, row long, blob binary"


def row_mark(docs: DataFrame) -> Column:
    """What tells rows apart that share a doc_id: a hash of the text, or 0 if no doc_id repeats."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    return F.lit(0).cast("long") if ids.where("count > 1").isEmpty() else F.xxhash64("text")


def _send(docs: DataFrame, row: Column, cut: Callable[[np.ndarray, np.ndarray], Units], window: int, gram: int, buckets: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []

        def flush() -> Iterator[pa.RecordBatch]:
            runs = Runs(*(np.concatenate([x[i] for x in held]) for i in range(5)), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x.offs) for x in held]))]), np.concatenate([x.text for x in held]))
            held.clear()
            stay, gone = _settled(runs)
            bucket = (mix(runs.minimiser[stay].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # in a bucket strings keep the order of texts, so numbers grow
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            order = stay[order]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                yield batch([b], [False], [0], [0], [runs.pick(order[cuts[b] : cuts[b + 1]]).pack()])
            doc, row, blobs = pack_marks(runs.doc[gone], runs.row[gone], runs.start[gone], runs.windows[gone])
            yield batch((mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), np.ones(len(doc), bool), doc, row, blobs)

        def batch(bucket, done, doc, row, blobs) -> pa.RecordBatch:  # noqa: ANN001
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(done, pa.bool_()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "done", "doc_id", "row", "blob"])

        total = 0
        for own, buf, offs in blocks(batches, size=_PIECE):
            runs = cut_runs(cut(buf, offs), own.column(0).to_numpy(zero_copy_only=False), own.column(1).to_numpy(zero_copy_only=False), window, gram)
            if len(runs.doc):
                held.append(runs)
                total += len(runs.text)
            if total > _BUFFER:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    return keyed.mapInArrow(rows, _SENT)


def single_windows(runs: Runs, cut: Callable[[np.ndarray, np.ndarray], Units], window: int) -> Runs:
    """Every window as a string of its own, with bits of its hash in place of the minimiser's."""
    units = cut(runs.text, runs.offs)
    string = np.repeat(np.arange(len(runs.doc)), runs.windows)
    at = spans(np.zeros(len(runs.doc), np.int64), runs.windows)
    first = units.first[string] + at
    begin = units.at[first]
    size = units.end[first + window - 1] - begin
    key = _ROLL.ranges(units.buf, begin, begin + size)
    return Runs((mix(key) >> np.uint64(32)).astype(np.uint32), runs.doc[string], runs.row[string], runs.start[string] + at, np.ones(len(string), np.int64), np.concatenate([[0], np.cumsum(size)]), units.buf[spans(begin, size)])


def _marked(doc: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pd.DataFrame:
    doc, row, marks = pack_marks(doc, row, start, windows)
    return pd.DataFrame({"bucket": np.full(len(doc), -1), "doc_id": doc, "row": row, "blob": marks})


def repeats(docs: DataFrame, row: Column, cut: Callable[[np.ndarray, np.ndarray], Units], decide: Callable[[Runs], tuple[np.ndarray, np.ndarray, np.ndarray]], window: int, gram: int, hot: int = HOT, held: int = HELD) -> DataFrame:
    """doc_id, row, blob, written to the shared folder: windows of each row that also start in a document with a smaller doc_id, in one or more parts.

    cut makes units of texts; decide gets strings, and returns for removed windows the string, the window in it, and how many
    follow. A minimiser that only one document has needs no more work. One whose strings take more than `hot` bytes is split: its
    windows are dealt out once more, each by its own hash, so that only equal windows must meet, of which a task sends one.
    """
    buckets = input_partitions(docs, _PART, 12)

    def settle(runs: Runs) -> Iterator[pd.DataFrame]:
        order = sorted_places(runs.minimiser.astype(np.uint64) << np.uint64(32))[0]
        m, doc = runs.minimiser[order], runs.doc[order]
        if not len(m):
            return
        head = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        n = np.diff(np.append(head, len(m)))
        several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        order = order[np.repeat(several, n)]
        ends = np.cumsum(n[several])
        size = np.concatenate([[0], np.cumsum(np.diff(runs.offs)[order])])
        lo = 0
        while lo < len(order):  # whole minimisers, about 2 MB of strings at once
            i = int(np.searchsorted(ends, lo, "right"))
            j = max(i, int(np.searchsorted(size[ends], size[lo] + (2 << 20), "right")) - 1)
            hi = int(ends[j])
            own = runs.pick(order[lo:hi])
            string, at, count = decide(own)
            yield _marked(own.doc[string], own.row[string], own.start[string] + at, count)
            lo = hi

    def split(runs: Runs) -> Iterator[pd.DataFrame]:
        lo = 0
        while lo < len(runs.doc):
            hi = max(lo + 1, int(np.searchsorted(runs.offs, runs.offs[lo] + (_PIECE >> 1), "right")) - 1)
            own = single_windows(runs.pick(np.arange(lo, hi)), cut, window)
            stay, gone = _settled(own)
            yield _marked(own.doc[gone], own.row[gone], own.start[gone], own.windows[gone])
            bucket = (mix(own.minimiser[stay].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            some, cuts = np.unique(bucket[order], return_index=True)
            cuts = np.append(cuts, len(order))
            yield pd.DataFrame({"bucket": some, "doc_id": 0, "row": 0, "blob": [own.pick(stay[order[x:y]]).pack() for x, y in zip(cuts, cuts[1:], strict=False)]})
            lo = hi

    def reduce(batches: Iterator[pd.DataFrame], splits: bool) -> Iterator[pd.DataFrame]:
        blobs: list[bytes] = []
        known, total = np.zeros(0, np.uint32), 0
        for rows in batches:
            done = rows["done"].astype(bool)
            if done.any():
                yield rows.loc[done, ["doc_id", "row", "blob"]].assign(bucket=-1)
            blobs += rows.loc[~done, "blob"].tolist()
            total += int(rows.loc[~done, "blob"].str.len().sum())
            if splits and total > held:
                runs = unpack(blobs)
                known = np.union1d(known, _large(runs, hot))
                out = np.isin(runs.minimiser, known)
                yield from split(runs.pick(np.flatnonzero(out)))
                blobs = [runs.pick(np.flatnonzero(~out)).pack()]
                total = len(blobs[0]) // 2  # so it doesn't come here for every batch
        runs = unpack(blobs)
        blobs.clear()
        if splits:
            out = np.isin(runs.minimiser, np.union1d(known, _large(runs, hot)))
            if out.any():
                yield from split(runs.pick(np.flatnonzero(out)))
                runs = runs.pick(np.flatnonzero(~out))
        yield from settle(runs)

    kind = "bucket int, doc_id long, row long, blob binary"
    sent = _send(docs, row, cut, window, gram, buckets).repartitionById(buckets, F.col("bucket"))
    first = stage(sent.mapInPandas(lambda batches: reduce(batches, True), kind), "skm-first")
    marks, more = first.where("bucket < 0").drop("bucket"), first.where("bucket >= 0")
    if more.isEmpty():
        return marks
    again = more.select("bucket", F.lit(False).alias("done"), "doc_id", "row", "blob").repartitionById(buckets, F.col("bucket"))
    return stage(marks.union(again.mapInPandas(lambda batches: reduce(batches, False), kind).where("bucket < 0").drop("bucket")), "skm-marks")


def _large(runs: Runs, hot: int) -> np.ndarray:
    """Minimisers whose strings take more than `hot` bytes."""
    some, at = np.unique(runs.minimiser, return_inverse=True)
    return some[np.bincount(at, np.diff(runs.offs), len(some)) > hot]


def stretches(removed: np.ndarray, string: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows in order of string and place, the removed ones as string, place and number of consecutive ones."""
    s, a = string[removed], at[removed]
    if not len(s):
        return s, a, a
    head = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (a[1:] != a[:-1] + 1)))
    return s[head], a[head], np.diff(np.append(head, len(s)))


def covered(marks: list[bytes] | None, window: int, units: int) -> np.ndarray:
    """Which of a text's units lie in a removed window."""
    step = np.zeros(units + 1, np.int64)
    for blob in marks or ():
        start, n = np.frombuffer(blob, np.int32).reshape(-1, 2).T
        np.add.at(step, start, 1)
        np.add.at(step, start + n + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def with_marks(docs: DataFrame, row: Column, marks: DataFrame, finish: Callable[[bytes | None, list[bytes] | None], tuple], columns: str) -> DataFrame:
    """docs' columns but text, and the columns that finish makes of each row's text and marks, which replace those with their names.

    Texts of documents without marks stay where they are, as long as the ids of the others are few enough to be broadcast; else all
    texts move. They move compressed.
    """
    fields = [x.strip().split(" ") for x in columns.split(",")]
    rest = [c for c in docs.columns if c != "text" and c not in {f for f, _ in fields}]
    kind = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest))).schema[0].dataType
    types = {"long": pa.int64(), "string": pa.string()}

    def results(rows: pa.Array, found: Iterator[tuple]) -> pa.RecordBatch:
        out = list(found)
        return pa.RecordBatch.from_arrays([rows, *(pa.array([x[i] for x in out], types[t]) for i, (_, t) in enumerate(fields))], ["rest", *(c for c, _ in fields)])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, offs = utf8(batch.column(3))
            raw, null = buf.tobytes(), batch.column(3).is_null().to_pylist()
            packed = [None if no else zip_.compress(raw[a:b]) for no, a, b in zip(null, offs, offs[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], ["rest", "doc_id", "row", "packed"])

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield results(batch.column(0), (finish(None if t is None else t.encode(), None) for t in batch.column(3).to_pylist()))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            yield results(batch.column(0), (finish(None if p is None else unzip.decompress(p), m) for p, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))

    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    moved, out = keyed, None
    ids = stage(marks.select("doc_id").distinct(), "skm-ids")
    if ids.count() <= SMALL:
        moved = keyed.join(F.broadcast(ids), "doc_id", "left_semi").select("rest", "doc_id", "row", "text")
        out = keyed.join(F.broadcast(ids), "doc_id", "left_anti").select("rest", "doc_id", "row", "text").mapInArrow(unmarked, beside("rest", kind, columns))
    small = moved.mapInArrow(squeeze, beside("rest", kind, "doc_id long, row long, packed binary")).alias("d")
    listed = marks.groupBy("doc_id", "row").agg(F.collect_list("blob").alias("marks")).alias("m")
    both = small.join(listed, F.expr("d.doc_id = m.doc_id AND d.row = m.row"), "left").select("d.rest", "d.packed", "m.marks")
    marked = both.mapInArrow(finished, beside("rest", kind, columns))
    out = marked if out is None else out.unionByName(marked)
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in rest), *(c for c, _ in fields))


def dedup(docs: DataFrame, cut: Callable[[np.ndarray, np.ndarray], Units], decide: Callable[[Runs], tuple[np.ndarray, np.ndarray, np.ndarray]], window: int, gram: int, finish: Callable[[bytes | None, list[bytes] | None], tuple], columns: str, **limits: int) -> DataFrame:
    """docs with the columns that finish makes of each text and of its windows that also start in a smaller doc_id; limits are those of repeats()."""
    bound_batches(docs.sparkSession)
    row = row_mark(docs)
    return with_marks(docs, row, repeats(docs, row, cut, decide, window, gram, **limits), finish, columns)
