"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import bound_batches
from ._text import blocks, mix

BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: Numbers of the product of counts and log-probabilities that are made at once.
_AT_ONCE = 1 << 21


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for all that are no letters."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngram_buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per order: bucket of each n-gram with a letter, in text order, and where each row's begin; and which rows have a letter.

    Runs of other characters stay as they are, each as one blank; no n-gram crosses two rows.
    """
    letters = _letters()[np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(points))
    some = np.concatenate([[0], np.cumsum(letters > 0)])
    grams, begins = [], []
    for n in ORDERS:
        m = max(0, len(letters) - n + 1)
        at = np.flatnonzero((some[n : n + m] > some[:m]) & (row[:m] == row[n - 1 : n - 1 + m]))
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + letters[at + k]
        grams.append((mix(h) & np.uint64(BUCKETS - 1)).astype(np.int32))
        begins.append(np.searchsorted(row[at], np.arange(len(offs))))
    return grams, begins, some[points[1:]] > some[points[:-1]]


def sparse_counts(group: np.ndarray, grams: list[np.ndarray], begins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, bucket and count of all pairs that occur, in order; group[r] is the group of row r."""
    rows = np.arange(len(group))
    keys = [group[np.repeat(rows, np.diff(b))] * BUCKETS + g[b[0] : b[-1]] for g, b in zip(grams, begins, strict=True)]
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, n


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  #: (BUCKETS, languages)
    log_prior: np.ndarray

    def score(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each row (ties: first by code point) and its posterior; `und`, 0 without letters."""
        n = len(offs) - 1
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        grams, begins, known = ngram_buckets(buf, offs)
        row, bucket, count = sparse_counts(np.arange(n), grams, begins)
        total = np.tile(self.log_prior, (n, 1))
        step = max(1, _AT_ONCE // len(self.langs))
        for lo in range(0, len(row), step):  # a row that is cut adds up over slices
            r = row[lo : lo + step]
            head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            total[r[head]] += np.add.reduceat(count[lo : lo + step, None] * self.log_prob[bucket[lo : lo + step]], head, axis=0)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, np.minimum(share, 1.0), 0.0)


def learn_languages(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Counts n-grams of all rows with a lang. The model has BUCKETS numbers per language, and that many counts per language come to
    the driver; the number of languages is that of the labels."""
    bound_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in blocks(batches, size=1 << 20):
            grams, begins, _ = ngram_buckets(buf, offs)
            langs, group = np.unique(np.array(rows.column(0).to_pylist(), object), return_inverse=True)
            of, bucket, n = sparse_counts(group, grams, begins)
            # the number of rows stands beside the buckets, as -1
            of, bucket, n = np.append(of, np.arange(len(langs))), np.append(bucket, np.full(len(langs), -1)), np.append(n, np.bincount(group, minlength=len(langs)))
            yield pa.RecordBatch.from_arrays([pa.array(langs[of].tolist(), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "bucket", "n"])

    found = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = found.toPandas()
    langs = sorted(table["lang"].unique(), key=lambda x: x.encode())
    n, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    place = table["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)
    bucket, count = table["bucket"].to_numpy(np.int64), table["n"].to_numpy()
    n[bucket[bucket >= 0], place[bucket >= 0]] = count[bucket >= 0]
    prior[place[bucket < 0]] = count[bucket < 0]
    n += smoothing
    return LanguageModel(langs, np.log(n / n.sum(0)), np.log(prior / max(prior.sum(), 1)))


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row; only text is an input.

    Null texts and texts without a letter are `und` with score 0, as is every text if the model knows no language. Texts of any
    length are read whole. Rows that repeat get the same result; an empty table gives an empty result; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in blocks(batches):
            langs, score = known.value.score(buf, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
