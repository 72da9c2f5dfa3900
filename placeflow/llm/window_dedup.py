"""Substring dedup over words: windows dealt out as super-k-mers, counted exactly by sorting."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from ._text import Rolling, combine, spans, split_words
from .superkmer import Runs, Units, covered, dedup, exact_groups, stretches

#: Words of a window and of the pieces whose hashes are minimisers.
WINDOW, GRAM = 13, 3
_ROLL = Rolling(seed=13)


def cut_words(buf: np.ndarray, offs: np.ndarray) -> Units:
    """The words of each row, each followed by one blank."""
    words = split_words(buf, offs)
    size = words.end - words.start + 1
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    if len(at):
        text = np.append(buf, np.uint8(0x20))[spans(words.start, size)]
        text[at + size - 1] = 0x20
    else:
        text = buf[:0]
    return Units(text, at, at + size, combine(_ROLL.ranges(text, at, at + size - 1), GRAM), words.first)


def decide_words(runs: Runs, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = cut_words(runs.text, runs.offs)
    string = np.repeat(np.arange(len(runs.doc)), runs.windows)
    at = spans(np.zeros(len(runs.doc), np.int64), runs.windows)
    first = units.first[string] + at
    begin = units.at[first]
    size = units.end[first + window - 1] - begin
    key = combine(_ROLL.ranges(units.buf, units.at, units.end), window)[first]
    order, group = exact_groups(key, units.buf, begin, size)
    doc = runs.doc[string][order]
    low = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, group[1:] != group[:-1])))[group]
    removed = np.zeros(len(first), bool)
    removed[order] = doc > low
    return stretches(removed, string, at)


def _finish(text: bytes | None, marks: list[bytes] | None) -> tuple:
    words = (text or b"").split()
    gone = covered(marks, WINDOW, len(words))
    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if marks else b" ".join(words)
    return len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()


def dedup_windows(docs: DataFrame, **limits: int) -> DataFrame:
    """docs' columns but text, and n_words, n_removed, kept (words joined by one space), kept_sha256, for every row.

    A word goes if a window of WINDOW words that covers it also starts in a document with a smaller doc_id, as the input has them.
    Null texts, and texts of white space, have no words. Texts with fewer words than a window keep them all. Rows without doc_id
    keep all and remove nothing elsewhere; rows that share a doc_id don't remove from each other. An empty table gives an empty
    result. limits: see superkmer.repeats.
    """
    return dedup(docs, cut_words, decide_words, WINDOW, GRAM, _finish, "n_words long, n_removed long, kept string, kept_sha256 string", **limits)
