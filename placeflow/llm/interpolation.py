"""LM scoring by deleted interpolation: bigram, unigram and uniform estimates mixed by how often the context was seen.

Texts are cut into chunks of some megabytes, which are written once. A chunk asks for the corpus counts of its distinct words and
bigrams, as sorted hashes dealt to ranges of the hash space; a range adds up what all chunks report, one slice of the range after the
other, and answers each chunk in its own order. So words that repeat in a chunk are asked for once, and neither tables nor answers ever
meet in one place. Some training texts are deleted from the counts and form chunks of their own; expectation-maximisation finds the
weights under which they are likeliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import bound_batches, input_partitions, stage
from ._text import Prints, blocks, mix, split_words

#: Bytes of a chunk's text, of the input for each range, and codes that a range counts at once.
CHUNK, PART, SLICE = 4 << 20, 6 << 20, 1 << 20
#: One in DELETED training texts is kept from the counts; context buckets.
DELETED, CONTEXTS = 8, 18
_ROLL = Prints(seed=2, fold_case=True)
_END, _BEGIN = np.uint64(0x1E4D), np.uint64(0xBE91)
WORD, PAIR = 0, 1
#: What becomes of a text: counted, deleted from the counts but training, or held out.
COUNTED, TUNED, HELD = 0, 1, 2


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each as its bytes of one rank after the other, compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T
        out.append(np.array([len(a)]).tobytes() + raw.tobytes())
    return zstandard.compress(b"".join(out), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n).T).view(np.int64).ravel())
        at += 8 + 8 * n
    return out


@dataclass
class Chunk:
    """Texts as hashes of tokens; `kinds` are the distinct tokens in order of hash, `pairs` the distinct bigrams."""

    first: np.ndarray
    part: np.ndarray
    kinds: np.ndarray
    token: np.ndarray  #: number of each token's kind
    bits: int

    def __post_init__(self) -> None:
        before = np.empty(len(self.token), np.uint64)
        h = self.kinds[self.token]
        before[1:] = h[:-1]
        before[self.first[:-1]] = _BEGIN
        code = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(h)) >> np.uint64(64 - self.bits)
        self.pairs, self.pair = np.unique(code, return_inverse=True)
        self.context = np.empty(len(self.token), np.int64)  # kind of the token before, -1 where a text begins
        self.context[1:] = self.token[:-1]
        self.context[self.first[:-1]] = -1
        self.of = np.repeat(self.part, np.diff(self.first))

    def counts(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each kind or pair is in counted texts and in all that train."""
        return np.bincount(which[self.of == COUNTED], minlength=n), np.bincount(which[self.of != HELD], minlength=n)

    def pick(self, texts: np.ndarray) -> Chunk:
        keep = np.repeat(texts, np.diff(self.first))
        size = np.diff(self.first)[texts]
        return Chunk(np.concatenate([[0], np.cumsum(size)]), self.part[texts], self.kinds, self.token[keep], self.bits)


def _ranges(codes: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each range begins in sorted codes, and the end."""
    width = (1 << bits) // ranges + 1
    return np.searchsorted(codes, np.array([min(i * width, (1 << bits) - 1) for i in range(ranges)] , np.uint64)).tolist() + [len(codes)]


_CHUNKS = "chunk long, texts array<long>, tokens array<long>, docs binary, body binary"


def _chunks(docs: DataFrame) -> DataFrame:
    """A row for every chunk: its number (odd: of deleted texts), its texts and tokens by what becomes of them, ids, and tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        total = {False: 0, True: 0}
        number = TaskContext.get().partitionId() << 32

        def flush(tuned: bool) -> pa.RecordBatch:
            nonlocal number
            h, size, part = (np.concatenate([x[i] for x in held[tuned]]) for i in (0, 1, 3))
            ids = pa.concat_arrays([x[2] for x in held[tuned]])
            held[tuned].clear()
            total[tuned] = 0
            kinds, token = np.unique(h, return_inverse=True)
            known = np.array(ids.is_valid().to_pylist(), np.int64)
            number += 2
            body = _pack(np.concatenate([[0], np.cumsum(size)]), part, np.diff(kinds.view(np.int64), prepend=0), token)
            columns = ([number + tuned], [[int((part == p).sum()) for p in range(3)]], [[int(size[part == p].sum()) for p in range(3)]], [_pack(ids.fill_null(0).to_numpy(zero_copy_only=False), known)], [body])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["chunk", "texts", "tokens", "docs", "body"])

        for own, buf, offs in blocks(batches):
            words = split_words(buf, offs)
            h = _ROLL.ranges(buf, words.start, words.end)
            size = np.diff(words.first) + 1
            tokens = np.full(len(h) + len(size), mix(np.array([_END]))[0], np.uint64)
            is_word = np.ones(len(tokens), bool)
            is_word[np.cumsum(size) - 1] = False
            tokens[is_word] = h
            part = own.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for tuned in (False, True):
                texts = (part == TUNED) == tuned
                if texts.any():
                    held[tuned].append((tokens[np.repeat(texts, size)], size[texts], own.column(0).filter(pa.array(texts)), part[texts]))
                    total[tuned] += int(np.diff(offs)[texts].sum())
                if total[tuned] >= CHUNK:
                    yield flush(tuned)
        for tuned in (False, True):
            if held[tuned]:
                yield flush(tuned)

    return docs.mapInArrow(rows, _CHUNKS)


_ASKED = "chunk long, kind int, part int, body binary"


def _requests(chunks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """For every chunk, kind and range: hashes' differences, counts in counted and in training texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, of, steps, token = _unpack(body)
                chunk = Chunk(first, of, np.cumsum(steps).view(np.uint64), token, bits)
                out = []
                for kind, codes, which, wide in ((WORD, chunk.kinds, token, 64), (PAIR, chunk.pairs, chunk.pair, bits)):
                    counted, train = chunk.counts(which, len(codes))
                    cuts = _ranges(codes, ranges, wide)
                    for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if a < b:
                            out.append((name, kind, r, _pack(np.diff(codes[a:b].view(np.int64), prepend=0), counted[a:b], train[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chunk", "kind", "part", "body"])

    return chunks.select("chunk", "body").mapInArrow(rows, _ASKED)


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each request the corpus counts of its hashes, in its order; and how many kinds of word the ranges here have seen in training.

    Requests stay packed; what of them lies in one slice of the range is counted at once.
    """
    asked: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for rows in batches:
        for chunk, kind, part, body in zip(rows["chunk"], rows["kind"], rows["part"], rows["body"], strict=True):
            asked.setdefault((kind, part), []).append((chunk, body))
    for (kind, part), own in asked.items():
        sizes, low, high = 0, None, None
        for _, body in own:
            codes = np.cumsum(_unpack(body)[0]).view(np.uint64)
            sizes += len(codes)
            low = codes[0] if low is None else min(low, codes[0])
            high = codes[-1] if high is None else max(high, codes[-1])
        slices = -(-sizes // SLICE)
        edges = [int(low) + (int(high) - int(low) + 1) * i // slices for i in range(1, slices)]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in own]
        distinct = 0
        for lo, hi in zip([None, *edges], [*edges, None], strict=True):
            parts = []
            for _, body in own:
                steps, counted, train = _unpack(body)
                codes = np.cumsum(steps).view(np.uint64)
                a = 0 if lo is None else int(np.searchsorted(codes, np.uint64(lo)))
                b = len(codes) if hi is None else int(np.searchsorted(codes, np.uint64(hi)))
                parts.append((codes[a:b].copy(), counted[a:b].astype(np.int32), train[a:b].astype(np.int32)))
            known = np.unique(np.concatenate([x[0] for x in parts]))
            sums = np.zeros((2, len(known)), np.int64)
            for codes, counted, train in parts:  # a chunk's hashes are distinct
                at = np.searchsorted(known, codes)
                sums[0, at] += counted
                sums[1, at] += train
            distinct += int((sums[1] > 0).sum())
            for into, (codes, _, _) in zip(found, parts, strict=True):
                at = np.searchsorted(known, codes)
                into.append((sums[0, at].astype(np.int32 if sums[0].max(initial=0) < 1 << 31 else np.int64), sums[1, at].astype(np.int32 if sums[1].max(initial=0) < 1 << 31 else np.int64)))
        for (chunk, _), into in zip(own, found, strict=True):
            yield pd.DataFrame({"chunk": [chunk], "kind": [kind], "part": [part], "body": [_pack(*(np.concatenate([x[i] for x in into]) for i in (0, 1)))], "distinct": [0]})
            into.clear()
        if kind == WORD:
            yield pd.DataFrame({"chunk": [-1], "kind": [kind], "part": [part], "body": [b""], "distinct": [distinct]})


def _loaded(chunk: pd.DataFrame, answers: pd.DataFrame, bits: int) -> tuple[Chunk, list[np.ndarray], list[np.ndarray]]:
    """The chunk, and for its kinds and its pairs the counts in counted and in training texts."""
    first, part, steps, token = _unpack(chunk["body"].iloc[0])
    out = []
    for kind in (WORD, PAIR):
        own = answers[answers["kind"] == kind].sort_values("part")
        found = [_unpack(b) for b in own["body"]]
        out.append([np.concatenate([x[i] for x in found]) for i in (0, 1)])
    return Chunk(first, part, np.cumsum(steps).view(np.uint64), token, bits), *out


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one more for each doubling."""
    return np.minimum(np.ceil(np.log2(count + 1)), CONTEXTS - 1).astype(np.int64)


def _estimates(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, total: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, bigram and unigram estimate of every token; a text's beginning was seen once a text."""
    context = np.where(chunk.context < 0, texts, words[chunk.context])
    two = np.where(context > 0, pairs[chunk.pair] / np.maximum(context, 1), 0.0)
    return context_bucket(context), two, words[chunk.token] / max(total, 1)


def learn_weights(table: pd.DataFrame, kinds: int, rounds: int = 50) -> np.ndarray:
    """Weights (CONTEXTS, 3) of bigram, unigram and uniform estimate, by EM over binned held-out tokens (bucket, n, two, one: means)."""
    out = np.tile([0.3, 0.5, 0.2], (CONTEXTS, 1))
    for b in range(CONTEXTS):
        own = table[table["bucket"] == b]
        if not len(own):
            if b:
                out[b] = out[b - 1]
            continue
        f = np.stack([own["two"], own["one"], np.full(len(own), 1 / (kinds + 1))], axis=1)
        n, w = own["n"].to_numpy(np.float64), out[b]
        for _ in range(rounds):
            share = f * w
            share /= share.sum(axis=1, keepdims=True)
            w = n @ share / n.sum()
            w = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        out[b] = w
    out[0] = [0, out[0][1], out[0][2]]
    out[0] /= out[0].sum()
    return out


def score_texts(docs: DataFrame, held_out: Column, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are the words of the whole text, ASCII letters lower-cased, then one end. Training are the rows where held_out is not true.
    base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; score adds log10 of the mixture's probability, and gives every
    unknown token the uniform estimate's share. Null and empty texts are one end. Rows without doc_id take part like others; rows
    that repeat count as often as they are there. Without training rows N and V are 0. An empty table gives an empty result. Given
    weights (CONTEXTS, 3) are used as they are, else they are learnt.
    """
    bound_batches(docs.sparkSession)
    part = F.when(F.coalesce(held_out, F.lit(False)), HELD).when(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(DELETED)) == 0, TUNED).otherwise(COUNTED)
    ranges = input_partitions(docs, PART, 12)
    bits = min(62, 44 + ranges.bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "text")
    chunks = stage(_chunks(rows), "lm-chunks")
    asked = _requests(chunks, ranges, bits).repartitionById(ranges, F.col("part"))
    answered = stage(asked.mapInPandas(_answers, f"{_ASKED}, distinct long"), "lm-answers")
    answers = answered.where("chunk >= 0").select("chunk", "kind", "part", "body")
    kinds = int(answered.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0])
    sums = chunks.agg(*(F.coalesce(F.sum(F.col(c)[p]), F.lit(0)) for c in ("tokens", "texts") for p in range(3))).first()
    tokens, texts = sums[:3], sums[3:]
    total, all_texts = tokens[COUNTED] + tokens[TUNED], texts[COUNTED] + texts[TUNED]

    def binned(chunk: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame({c: [] for c in ("bucket", "i", "j", "n", "two", "one")})
        whole, (words, _), (pairs, _) = _loaded(chunk, found, bits)
        bucket, two, one = _estimates(whole, words, pairs, tokens[COUNTED], texts[COUNTED])
        own = whole.of == TUNED
        rows = pd.DataFrame({"bucket": bucket[own], "two": two[own], "one": one[own], "n": 1})
        for name, of in (("i", "two"), ("j", "one")):
            rows[name] = np.where(rows[of] > 0, np.floor(4 * np.log2(np.maximum(rows[of], 1e-300))), -9999).astype(np.int64)
        return rows.groupby(["bucket", "i", "j"], as_index=False).agg({"n": "sum", "two": "sum", "one": "sum"})[["bucket", "i", "j", "n", "two", "one"]]

    odd = "chunk % 2 = 1"
    if weights is None and tokens[TUNED]:
        bins = chunks.where(odd).groupBy("chunk").cogroup(answers.where(odd).groupBy("chunk")).applyInPandas(binned, "bucket long, i long, j long, n long, two double, one double")
        seen = bins.groupBy("bucket", "i", "j").agg(F.sum("n").alias("n"), (F.sum("two") / F.sum("n")).alias("two"), (F.sum("one") / F.sum("n")).alias("one")).toPandas()
        weights = learn_weights(seen, kinds)
    elif weights is None:
        weights = np.tile([0.3, 0.5, 0.2], (CONTEXTS, 1))

    def scored(chunk: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(chunk):
            return pd.DataFrame({c: [] for c in names})
        whole, (_, words), (_, pairs) = _loaded(chunk, found, bits)
        ids, known = _unpack(chunk["docs"].iloc[0])
        bucket, two, one = _estimates(whole, words, pairs, total, all_texts)
        mixed = weights[bucket, 0] * two + weights[bucket, 1] * one + weights[bucket, 2] / (kinds + 1)
        c = words[whole.token]
        begin = whole.first[:-1]
        base = np.add.reduceat(np.log10((c + 0.5) / (total + 0.5 * (kinds + 1))), begin)
        out = (pd.Series(ids).astype("Int64").where(known.astype(bool)), whole.part == HELD, np.diff(whole.first), np.add.reduceat((c > 0).astype(np.int64), begin), total, base, np.add.reduceat(np.log10(mixed), begin))
        return pd.DataFrame(dict(zip(names, out, strict=True)))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
