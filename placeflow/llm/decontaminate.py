"""Benchmark decontamination: approximate occurrences of test items in documents, by pigeonhole pieces and Myers verification.

An occurrence within k edits leaves one of k + 1 pieces of the item untouched. So every item is split into its budget plus one
pieces, an Aho-Corasick automaton finds all exact piece hits in a document, and each place that a hit implies is verified with
Myers' bit-parallel edit distance. Documents never move: items come to them in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import beside, bound_batches

#: Edits per character of an item, shortest piece, and characters of items that are sent to tasks at once.
ERROR_RATE, MIN_PIECE, BLOCK_CHARS = 0.05, 8, 4_000_000
#: Bytes of documents that a task holds while the blocks of items pass by, where there are several.
HELD = 32 << 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return max(0, min(int(length * rate), length // MIN_PIECE - 1))


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """Offset and text of budget + 1 pieces of nearly equal length."""
    k = budget(len(item), rate)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, text: str) -> tuple[int, int]:
    """The smallest edit distance of item to any part of text, and where the first such part ends (Myers 1999, one word of len(item) bits)."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        vert = eq | minus
        horiz = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horiz | plus))
        down = plus & horiz
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vert | up))
        minus = up & vert
        if score < best:
            best, at = score, j
    return best, at


class Items:
    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items, self.rate = items, rate
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for offset, piece in pieces(text, rate):
                found.setdefault(piece, []).append((n, offset))
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """item_id, distance, end in the normal text of each item that occurs; its best place."""
        if not len(self.automaton):
            return []
        text = normal(text)
        places: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                places.setdefault(n, set()).add(end + 1 - size - offset)
        out: dict[int | None, tuple[int, int]] = {}
        for n, starts in places.items():
            item_id, item = self.items[n]
            k, best = budget(len(item), self.rate), None
            done = -1
            for start in sorted(starts):  # places within reach of one another are verified together
                if start <= done:
                    continue
                done = start + k
                if not k:  # too short for edits: it must stand by itself
                    end = start + len(item)
                    if not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum():
                        best = best or (0, end)
                    continue
                low = max(0, start - k)
                distance, end = best_match(item, text[low : start + len(item) + 2 * k])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best and (item_id not in out or best < out[item_id]):
                out[item_id] = best
        return [(item_id, *x) for item_id, x in out.items()]


@lru_cache(1)
def _automaton(items: tuple[tuple[int | None, str], ...], rate: float) -> Items:
    return Items(list(items), rate)


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items in blocks of about chars characters, all texts of one item_id in one block."""
    block, size, last = [], 0, None
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if size >= chars and row["item_id"] != last:
            yield tuple(block)
            block, size = [], 0
        text, last = normal(row["text"]), row["item_id"]
        if text:
            block.append((row["item_id"], text))
            size += len(text)
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """docs' columns and leaks, an array of (item_id, distance, end) of the items that occur in the whole text, for every row.

    An item occurs if some part of the text, both in lower case with white space as single blanks, is within rate edits per
    character. Items too short for an edit occur where they stand between other than letters and digits. Null and empty texts hold
    nothing; blank items never occur. Each item_id is reported once per row, with its best place: the smallest distance, then the first
    end; so if its texts repeat or differ. Null item_ids count as one. An empty table of either kind gives no leaks. A column named
    leaks is replaced. Documents are read once, by one Python worker a task: it holds HELD bytes of them, or one batch, while the
    blocks of items pass by, one in memory at a time; a sole block stays.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "leaks"]
    kind = "array<struct<item_id:bigint,distance:bigint,end:bigint>>"
    struct = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())]))
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(benchmark)]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches, HELD if len(blocks) > 1 else 0):
            found: list[list[list[dict]]] = [[[] for _ in range(b.num_rows)] for b in held]
            for sent in blocks:
                known = _automaton(sent.value, rate)
                if len(blocks) > 1:
                    vars(sent).pop("_value", None)  # read again from the worker's disk when it comes by again
                for batch, leaks in zip(held, found, strict=True):
                    for own, text in zip(leaks, batch.column(1).to_pylist(), strict=True):
                        own += [dict(zip(("item_id", "distance", "end"), x, strict=True)) for x in known.find(text)]
            for batch, leaks in zip(held, found, strict=True):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaks, struct)], ["row", "leaks"])

    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text")
    out = inner.mapInArrow(searched, beside("row", inner.schema["row"].dataType, f"leaks {kind}"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "leaks")


def batches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches that hold size bytes at least, but for the last; single batches if size is 0."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
