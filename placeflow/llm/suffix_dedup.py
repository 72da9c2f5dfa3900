"""Suffix-array dedup over bytes: strings of 50 bytes that repeat across documents, by bucket-pointer refinement.

Suffixes are dealt to partitions by the minimiser of the 50 bytes that they start with. In a partition they start in buckets of
equal 16-byte beginnings. A slice of whole buckets is refined down to the full depth before the next slice is begun: its suffixes
are sorted by the buckets that they are in 16 bytes later, their new numbers are written at once, and slices that come later and
point to these suffixes are refined by the new, deeper numbers. Only buckets that several documents share are refined.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from ._text import Rolling, mix, spans
from .superkmer import Runs, Units, covered, dedup, sorted_places, stretches

#: Bytes of a string, of the pieces whose hashes are minimisers, and of the first buckets.
WINDOW, GRAM, FIRST = 50, 12, 16
#: Suffixes of a slice, but for buckets that hold more.
SLICE = 1 << 17
_ROLL = Rolling(seed=50)


def cut_bytes(buf: np.ndarray, offs: np.ndarray) -> Units:
    at = np.arange(len(buf), dtype=np.int64)
    n = max(0, len(buf) - GRAM + 1)
    total = _ROLL.sums(buf)
    grams = mix((total[GRAM : GRAM + n] - total[:n]) * _ROLL.down[:n])
    return Units(buf, at, at + 1, grams, offs)


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs (a, b) together, and along it a number for each distinct pair."""
    order, head = sorted_places(mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b)))
    x, y = a[order], b[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(order) else head
    if (new & ~head).any():  # pairs that look alike by hash: sorted by value
        run = np.cumsum(head) - 1
        clash = np.zeros(int(run[-1]) + 1, bool)
        clash[run[new & ~head]] = True
        at = np.flatnonzero(clash[run])
        order[at] = order[at][np.lexsort((y[at], x[at], run[at]))]
        x, y = a[order], b[order]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    return order, np.cumsum(new) - 1


def _shared(order: np.ndarray, number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which places of the order are in a bucket of several documents."""
    if not len(order):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    own = doc[order]
    return (np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head))[number - number[0]]


def refine(text: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int = WINDOW, first: int = FIRST, size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes among those that start at `at` and share depth bytes with one of another document: their indices, bucket by bucket, and numbers of their buckets.

    Every suffix has depth bytes at least. The first buckets hold equal beginnings of `first` bytes, two words of a machine, and whole
    buckets make slices of about `size` suffixes. A slice is sorted by the first buckets that its suffixes are in `first` bytes later;
    the numbers are written at once. Where all suffixes of a bucket point to ones that have such numbers by then, it is sorted by
    these too and is three times as deep as at first, else twice. What is left of the slice is refined on to depth before the next slice.
    Suffixes that are alone or among their own document's are out at once.
    """
    word = np.ndarray(max(0, len(text)), "<u8", np.append(text, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    half = first // 2
    order, number = numbered(word[at], word[at + half])
    stay = _shared(order, number, doc)
    live, number = order[stay], number[stay]
    head = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(live) else np.zeros(0, np.int64)
    # where suffixes may point to: the numbers of the first buckets there, and of the deeper ones that refined slices have written
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    flat, deep = np.full(len(text), -1, kind), np.full(len(text), -1, kind)
    steps = {0, *_offsets(first, depth, first), *_offsets(2 * first, depth, first), *_offsets(3 * first, depth, first)}
    places = _places([at[live] + k for k in steps], len(text))
    order, number = numbered(word[places], word[places + half])
    flat[places[order]] = number
    del order, number, places
    out, sizes, written = [], [], 0
    for a, b in _slices(head, len(live), size):
        own = live[a:b]
        if depth < 2 * first:
            parts = [(own, flat[at[own]].astype(np.int64), first)]
        else:
            ahead = at[own] + first
            order, bucket = numbered(flat[at[own]].astype(np.uint64), flat[ahead].astype(np.uint64))
            own, later = own[order], deep[ahead[order]]
            deep[at[own]] = bucket + written
            written += int(bucket[-1]) + 1
            keep = _shared(np.arange(len(own)), bucket, doc[own])
            own, later, bucket = own[keep], later[keep], bucket[keep]
            ready = np.zeros(len(own), bool)
            if len(own) and depth >= 3 * first:
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ready = np.repeat(np.minimum.reduceat(later, starts) >= 0, np.diff(np.append(starts, len(own))))
            parts = [(own[~ready], bucket[~ready], 2 * first)]
            order, bucket = numbered(bucket[ready].astype(np.uint64), later[ready].astype(np.uint64))
            own = own[ready][order]
            keep = _shared(np.arange(len(own)), bucket, doc[own])
            parts.append((own[keep], bucket[keep], 3 * first))
        for own, bucket, have in parts:
            for offset in _offsets(have, depth, first):
                order, bucket = numbered(bucket.astype(np.uint64), flat[at[own] + offset].astype(np.uint64))
                own = own[order]
                keep = _shared(np.arange(len(own)), bucket, doc[own])
                own, bucket = own[keep], bucket[keep]
            if len(own):
                out.append(own)
                sizes.append(np.append(True, bucket[1:] != bucket[:-1]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.cumsum(np.concatenate(sizes)) - 1


def _offsets(have: int, depth: int, first: int) -> list[int]:
    """Where to look for first buckets, one after the other, so that a bucket of depth have gets depth."""
    out = []
    while have < depth:
        out.append(min(have, depth - first))
        have = out[-1] + first
    return out


def _slices(head: np.ndarray, total: int, size: int) -> list[tuple[int, int]]:
    """Ranges of whole buckets, which begin at head, of about size places."""
    if not total:
        return []
    cuts = np.unique(head[np.searchsorted(head, np.arange(0, total, size), "right") - 1])
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), total], strict=True))


def _places(parts: list[np.ndarray], size: int) -> np.ndarray:
    seen = np.zeros(size, bool)
    for x in parts:
        seen[x] = True
    return np.flatnonzero(seen)


def decide_bytes(runs: Runs, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    string = np.repeat(np.arange(len(runs.doc)), runs.windows)
    at = spans(np.zeros(len(runs.doc), np.int64), runs.windows)
    doc = runs.doc[string]
    live, bucket = refine(runs.text, runs.offs[string] + at, doc, window)
    removed = np.zeros(len(string), bool)
    if len(live):
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        removed[live] = doc[live] > np.minimum.reduceat(doc[live], head)[bucket]
    return stretches(removed, string, at)


def _finish(text: bytes | None, marks: list[bytes] | None) -> tuple:
    raw = np.frombuffer(text or b"", np.uint8)
    if not marks:
        return len(raw), 0, 0, "[]", hashlib.sha256(raw.tobytes()).hexdigest()
    gone = covered(marks, WINDOW, len(raw))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return len(raw), int(gone.sum()), len(edge) // 2, str(edge.reshape(-1, 2).tolist()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def dedup_suffixes(docs: DataFrame, **limits: int) -> DataFrame:
    """docs' columns but text, and n_bytes, n_removed, n_spans, spans (JSON pairs of start and end of the removed runs), kept_sha256.

    A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller doc_id, as the input has them.
    A null text is empty; shorter texts keep all bytes. What is kept may end within a character, so it is given as bytes' digest and spans.
    Rows without doc_id keep all and remove nothing elsewhere; rows that share a doc_id don't remove from each other. An empty
    table gives an empty result. limits: see superkmer.repeats.
    """
    return dedup(docs, cut_bytes, decide_bytes, WINDOW, GRAM, _finish, "n_bytes long, n_removed long, n_spans long, spans string, kept_sha256 string", **limits)
