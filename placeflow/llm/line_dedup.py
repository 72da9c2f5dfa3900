"""Line dedup that can be undone: exact reference tables of lines, and a sharded cuckoo filter in front of them.

`references` has one row per line key and document that holds it; `counts` has the keys that enough documents hold, with their
number and the largest such doc_id; `filters` has one cuckoo filter per shard over the keys of `counts`. References are a log:
an insertion writes the pairs it adds, a deletion those it takes out, the newest part decides, and a long log is written anew as one
part. Only keys that a change touches are counted again, and only shards with changed keys get their filter updated. A filter's
false hits end at the join with `counts`, so decisions are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import beside, bound_batches, stage
from ._text import LOWER, blocks, split_words
from .cuckoo import CuckooFilter

#: Code points that a key has at least; documents that hold a dropped key at least; keys a shard's filter has about.
MIN_CHARS, MIN_DOCS, KEYS_PER_SHARD = 20, 3, 50_000
#: Keys that a task gathers before it deals them to shards, and parts of a log beyond which it is written anew.
PACKED, PARTS = 200_000, 8


def _lines(buf: np.ndarray, offs: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None], np.ndarray]:
    """Start and end of every line of every row, its key's digest (None: too short), and the index of each row's first line."""
    breaks = np.flatnonzero(buf == 0x0A)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, offs)) + 1)])
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = offs[1:]
    words = split_words(buf, offs)
    a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    some = b > a
    key_start, key_end = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    key_start[some], key_end[some] = words.start[a[some]], words.end[b[some] - 1]
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    low = LOWER[buf].tobytes()
    keys: list[bytes | None] = [None] * len(start)
    for i in np.flatnonzero(points[key_end] - points[key_start] >= min_chars).tolist():
        keys[i] = hashlib.blake2b(low[key_start[i] : key_end[i]], digest_size=16).digest()
    return start, end, keys, first


def line_references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key (16-byte digest), doc_id for each distinct long enough line of each row with a doc_id."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in blocks(batches):
            _, _, keys, first = _lines(buf, offs, min_chars)
            out_key, out_doc = [], []
            for k, doc in enumerate(rows.column(0).to_pylist()):
                if doc is not None:
                    own = set(keys[first[k] : first[k + 1]])
                    own.discard(None)
                    out_key += own
                    out_doc += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.binary()), pa.array(out_doc, pa.int64())], ["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, "key binary, doc_id long")


def _halves(keys: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist() if isinstance(keys, pa.Array) else list(keys)), np.uint64).reshape(-1, 2)


@dataclass
class LineIndex:
    parts: tuple[DataFrame, ...]  #: key, doc_id, present: the log of references, oldest first
    counts: DataFrame  #: shard, key, n_docs, last_doc
    filters: DataFrame  #: shard, cells
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @property
    def references(self) -> DataFrame:
        """key, doc_id"""
        return _latest(self.parts)

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        bound_batches(docs.sparkSession)
        references = stage(line_references(docs, min_chars), "line-refs")
        counted = stage(_counts(references, min_docs), "line-counts")
        shards = max(4, -(-counted.count() // KEYS_PER_SHARD))
        counts = counted.withColumn("shard", _shard(shards))
        filters = stage(counts.groupBy("shard").applyInPandas(_built, "shard int, cells binary"), "line-filters")
        return cls((references.withColumn("present", F.lit(True)),), counts, filters, shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs added; a document that is already in it gains the lines it did not have."""
        return self._changed(line_references(docs, self.min_chars).distinct(), True)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of doc_ids (column doc_id), as if they had never been inserted."""
        ids = doc_ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
        return self._changed(_latest(tuple(p.join(ids, "doc_id", "left_semi") for p in self.parts)).distinct(), False)

    def _changed(self, pairs: DataFrame, present: bool) -> LineIndex:
        change = stage(pairs.select("key", "doc_id"), "line-refs")
        parts = (*self.parts, change.withColumn("present", F.lit(present)))
        if len(parts) > PARTS:
            parts = (stage(_latest(parts), "line-refs").withColumn("present", F.lit(True)),)
        keys = stage(change.select("key").distinct(), "line-touched")
        touched = _latest(tuple(p.join(keys, "key", "left_semi") for p in parts))
        now = stage(_counts(touched, self.min_docs).withColumn("shard", _shard(self.shards)), "line-now")
        before = self.counts.join(keys, "key", "left_semi")
        changes = now.join(before, "key", "left_anti").select("shard", "key", F.lit(True).alias("enters")).unionByName(before.join(now, "key", "left_anti").select("shard", "key", F.lit(False).alias("enters")))
        counts = stage(self.counts.join(keys, "key", "left_anti").unionByName(now), "line-counts")
        held = counts.select("shard", "key")
        grouped = self.filters.groupBy("shard").cogroup(changes.groupBy("shard"))
        filters = stage(grouped.applyInPandas(_updated, "shard int, cells binary"), "line-filters")
        full = filters.where("cells IS NULL").select("shard")
        rebuilt = held.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_built, "shard int, cells binary")
        return LineIndex(parts, counts, stage(filters.where("cells IS NOT NULL").unionByName(rebuilt), "line-filters"), self.shards, self.min_docs, self.min_chars)

    def drops(self) -> DataFrame:
        """doc_id, keys: the keys that each document loses. Lines are probed shard by shard; hits are looked up exactly."""
        packed = self.references.select("key", "doc_id", _shard(self.shards).alias("shard")).mapInArrow(_packed, "shard int, keys binary, docs binary")
        hits = packed.join(self.filters, "shard").select("keys", "docs", "cells", "shard").mapInArrow(_probed, "key binary, doc_id long")
        counts = self.counts.select("key", "last_doc")
        return hits.join(counts, "key").where("doc_id <> last_doc").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _latest(parts: tuple[DataFrame, ...]) -> DataFrame:
    """key, doc_id of the pairs that are present in the newest part that has them."""
    if len(parts) == 1:
        return parts[0].where("present").select("key", "doc_id")
    log = None
    for version, part in enumerate(parts):
        rows = part.select("key", "doc_id", "present", F.lit(version).alias("version"))
        log = rows if log is None else log.unionByName(rows)
    return log.groupBy("key", "doc_id").agg(F.max_by("present", "version").alias("present")).where("present").select("key", "doc_id")


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _counts(references: DataFrame, min_docs: int) -> DataFrame:
    per_key = references.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return per_key.where(F.col("n_docs") >= min_docs)


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    cells = CuckooFilter.of(_halves(rows["key"])).to_bytes()
    return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "cells": [cells]})


def _updated(held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    shard = (held if len(held) else changes)["shard"].iloc[0]
    cells = CuckooFilter.from_bytes(held["cells"].iloc[0]) if len(held) else CuckooFilter.sized_for(len(changes))
    cells.delete(_halves(changes.loc[~changes["enters"].astype(bool), "key"]))
    full = len(cells.insert(_halves(changes.loc[changes["enters"].astype(bool), "key"])))
    return pd.DataFrame({"shard": [shard], "cells": [None if full else cells.to_bytes()]})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard with the keys of many batches: a hot line never makes a hot row, and a filter is sent to few rows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, docs, at = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        order = np.argsort(at, kind="stable")
        some, cuts = np.unique(at[order], return_index=True)
        cuts = np.append(cuts, len(order))
        parts = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([docs[p].tobytes() for p in parts], pa.binary())], ["shard", "keys", "docs"])

    total = 0
    for batch in batches:
        held.append((_halves(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)))
        total += batch.num_rows
        if total >= PACKED:
            yield flush()
            total = 0
    if total:
        yield flush()


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple[int, CuckooFilter] | None = None
    for batch in batches:
        for raw, docs, cells, shard in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if known is None or known[0] != shard:
                known = (shard, CuckooFilter.from_bytes(cells))
            hit = np.flatnonzero(known[1].contains(np.frombuffer(raw, np.uint64).reshape(-1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array([raw[16 * i : 16 * i + 16] for i in hit.tolist()], pa.binary()), pa.array(np.frombuffer(docs, np.int64)[hit], pa.int64())], ["key", "doc_id"])


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs' columns with text replaced by the kept lines, and n_lines, n_dropped.

    A key is a line without outer spaces, ASCII letters lower-cased. Keys of min_chars code points that min_docs documents hold
    lose all their lines except in the largest doc_id that holds them. Rows with one doc_id are one document, each row keeps its
    place. Rows without doc_id neither count nor lose lines. Null and empty texts are one empty line and come back as they were;
    a text all of whose lines go becomes empty. An empty table gives an empty result. Columns named like the new ones are replaced.
    """
    index = index or LineIndex.build(docs)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    d, k = inner.alias("d"), index.drops().alias("k")
    both = d.join(k, F.expr("d.doc_id = k.doc_id"), "left").select("d.row", "d.text", "k.keys")
    min_chars = index.min_chars

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in blocks(batches, "text"):
            start, end, keys, first = _lines(buf, offs, min_chars)
            raw = buf.tobytes()
            texts, total, dropped = [], [], []
            for r, (text, gone) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                n, gone = int(first[r + 1] - first[r]), set(gone or ())
                stay = [i for i in range(first[r], first[r + 1]) if keys[i] not in gone] if gone else None
                total.append(n)
                dropped.append(n - len(stay) if gone else 0)
                texts.append(b"\n".join(raw[start[i] : end[i]] for i in stay).decode() if gone else text)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    out = both.mapInArrow(kept, beside("row", inner.schema["row"].dataType, "kept string, n_lines long, n_dropped long"))
    return out.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names), "n_lines", "n_dropped")
