"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of bytes other than white space and ASCII punctuation, ASCII letters lower-cased. A word's embedding is the sum of
those of its hashed form and of its hashed beginnings, so that inflected forms share a stem. Filters of several widths slide over
the words, each keeps its largest response, and a logistic layer weighs these. All labelled rows count. They
are trained on in rounds: tasks train shards from the same network, whose mean starts the next round. Scores are scaled on every fifth
row, kept from training; thresholds by language are chosen on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stage import beside, bound_batches, delete, scratch, stage
from ._text import Rolling, blocks, mix, spans, split_words

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
#: Bytes of texts in a shard, about; words in a batch, unless one text has more; slices of a vector that tasks sum.
SHARD_BYTES, BATCH_WORDS, SLICES = 16 << 20, 1 << 17, 16
#: Bytes of the beginnings of a word that have embeddings besides the word itself.
STEMS = (4, 5, 6, 7)
_PUNCTUATION = np.frombuffer(bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum()), np.uint8)
_ROLL = Rolling(seed=4, fold_case=True)
_KEY = np.random.default_rng(5).integers(1, 1 << 62, 1 + len(STEMS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_ids(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (from 1; 0: none) of every word's form and stems, one line a word, and the index of each row's first word."""
    gap = np.zeros(256, bool)
    gap[_PUNCTUATION] = True
    words = split_words(np.where(gap[buf], np.uint8(0x20), buf), offs)
    total, out = _ROLL.sums(buf), []
    for n in (0, *STEMS):
        end = words.end if not n else np.minimum(words.start + n, words.end)
        h = mix((total[end] - total[words.start]) * _ROLL.down[words.start] + np.uint64(n))
        ids = (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
        out.append(np.where(words.end - words.start < n, 0, ids))
    return np.stack(out, axis=1), words.first


def _padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with blanks (0) after each row, so that every filter fits; where windows start; each row's first window."""
    n = np.diff(first)
    m = np.maximum(n, 1)
    at = np.concatenate([[0], np.cumsum(m + max(WIDTHS) - 1)])
    out = np.zeros((at[-1], *ids.shape[1:]), ids.dtype)
    out[spans(at[:-1], n)] = ids
    return out, spans(at[:-1], m), np.concatenate([[0], np.cumsum(m)[:-1]])


@dataclass
class ToxicityModel:
    emb: np.ndarray
    taps: list[np.ndarray]  #: per width: (width * DIM, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        # each distinct word once: its embedding, and its response at every place of every filter; word 0 is blank
        _, one, same = np.unique((ids.astype(np.uint64) * _KEY).sum(axis=1), return_index=True, return_inverse=True)
        word = np.concatenate([np.zeros((1, DIM), np.float32), self.emb[ids[one]].sum(axis=1)])
        padded, at, rows = _padded((same + 1).astype(np.int32), first)
        peaks = []
        for w, tap in zip(WIDTHS, self.taps, strict=True):
            peaks.append(np.maximum.reduceat(sum((word @ tap[k * DIM : (k + 1) * DIM])[padded[at + k]] for k in range(w)), rows, axis=0))
        return np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0) @ self.weight + self.offset

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if len(offs) < 2:
            return np.zeros(0)
        z = self.logits(*word_ids(buf, offs)).astype(np.float64) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class _Chunk:
    """Texts of a shard as numbers of distinct words, from 1; table has these words' ids, with word 0, the blank, first."""

    shard: int
    toxic: np.ndarray
    held: np.ndarray
    langs: list
    first: np.ndarray
    words: np.ndarray
    table: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.words[self.first[i] : self.first[i + 1]]

    def training(self) -> np.ndarray:
        return np.flatnonzero(~self.held)


_PACKED = "shard int, toxic binary, held binary, langs array<string>, first binary, words binary, table binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard, or for each 2 * SHARD_BYTES of a larger one. Rows come by shard."""
    parts: list[tuple] = []

    def packed(shard: int) -> pa.RecordBatch:
        keys = np.concatenate([x[4] for x in parts])
        _, one, same = np.unique(keys, return_index=True, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(x[4]) for x in parts])])
        words = np.concatenate([same[at + x[5]] + 1 for at, x in zip(starts, parts, strict=False)]).astype(np.int32)
        table = np.concatenate([np.zeros((1, 1 + len(STEMS)), np.int32), np.concatenate([x[6] for x in parts])[one]])
        first = np.concatenate([[0], np.cumsum(np.concatenate([x[3] for x in parts]))])
        values = [shard, *(np.concatenate([x[k] for x in parts]).astype(np.uint8).tobytes() for k in (0, 1)), [v for x in parts for v in x[2]], first.astype(np.int64).tobytes(), words.tobytes(), table.astype(np.int32).tobytes()]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "toxic", "held", "langs", "first", "words", "table"])

    last, size = -1, 0
    for rows, buf, offs in blocks(batches):
        shards = rows.column("shard").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(shards, prepend=shards[0] - 1, append=shards[-1] + 1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if parts and (shards[lo] != last or size >= 2 * SHARD_BYTES):
                yield packed(last)
                size = 0
            last, some = int(shards[lo]), rows.slice(lo, hi - lo)
            ids, first = word_ids(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            keys, one, same = np.unique((ids.astype(np.uint64) * _KEY).sum(axis=1), return_index=True, return_inverse=True)
            parts.append((some.column("toxic").to_numpy(), some.column("held").to_numpy(), some.column("lang").to_pylist(), np.diff(first), keys, same.astype(np.int32), ids[one]))
            size += int(offs[hi] - offs[lo])
    if parts:
        yield packed(last)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    for batch in batches:
        for r in batch.to_pylist():
            toxic, held = (np.frombuffer(r[k], np.uint8).astype(bool) for k in ("toxic", "held"))
            yield _Chunk(r["shard"], toxic, held, r["langs"], np.frombuffer(r["first"], np.int64), np.frombuffer(r["words"], np.int32), np.frombuffer(r["table"], np.int32).reshape(-1, 1 + len(STEMS)))


def _maybe_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id has a label, and a few more: what a bitmap of the labels' hashes lets pass. So texts without a label
    are not shuffled, and what is broadcast is 8 MB at most, however many labels there are."""
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 26)) + 1
    bits = labels.groupBy(F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits"))
    at = F.bitmap_bit_position(h)
    octet = F.conv(F.hex(F.col("bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return docs.withColumn("bucket", F.bitmap_bucket_number(h)).join(F.broadcast(bits), "bucket").where(F.getbit(octet, (at % 8).cast("int")) == 1).drop("bucket", "bits")


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All texts with a label, packed by shard. A shard is dealt its texts by a hash of their ids and keeps them in order of ids."""
    key = F.col("doc_id").cast("string").alias("key")
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(key, "toxic")
    texts = _maybe_labelled(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(key, F.struct("text", "lang").alias("t")), marks)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t.text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    none = F.lit(None)
    both = texts.select(shard, "key", "t", none.cast(marks.schema["toxic"].dataType).alias("toxic")).union(marks.select(shard, "key", none.cast(texts.schema["t"].dataType).alias("t"), "toxic"))
    # texts meet labels where shards are: one shuffle for both; equal rows of one id meet in partial minima
    one = both.repartition(shards, "shard").groupBy("shard", "key").agg(F.min("t").alias("t"), F.max("toxic").alias("toxic")).where("t IS NOT NULL AND toxic IN (0, 1)")
    held = (F.pmod(F.xxhash64("key", F.lit("held")), F.lit(5)) == 0).cast("int").alias("held")
    rows = one.sortWithinPartitions("shard", "key").select("shard", F.col("toxic").cast("int").alias("toxic"), held, "t.lang", "t.text")
    return stage(rows.mapInArrow(_pack, _PACKED), "tox-texts")


def _summed(packed: DataFrame, part: Callable[[Iterator[_Chunk]], np.ndarray | None], kind: type = np.float64) -> np.ndarray | None:
    """The sum of the vectors that `part` makes of each task's chunks. It is made in slices, so no task and not the driver sees the
    vectors of all tasks; only the sum comes to the driver. Vectors are shuffled as `kind` and added as doubles."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[int] = []

        def noted() -> Iterator[_Chunk]:
            for c in _chunks(batches):
                seen.append(c.shard)
                yield c

        vector = part(noted())
        if vector is not None:
            pieces = [x.tobytes() for x in np.array_split(vector.astype(kind), SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([min(seen)] * SLICES, pa.int32()), pa.array(pieces, pa.binary())], ["slice", "shard", "part"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        # always in the same order, since sums of floats depend on it
        total = sum(np.frombuffer(x, kind).astype(np.float64) for x in rows.sort_values("shard")["part"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "part": [total.tobytes()]})

    rows = packed.mapInArrow(sliced, "slice int, shard int, part binary").groupBy("slice").applyInPandas(added, "slice int, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else None


def _seen(chunks: Iterator[_Chunk]) -> np.ndarray | None:
    """Texts that train, clean and toxic, by the ids that they hold; then the numbers of texts: clean and toxic that train, and held."""
    seen, number = np.zeros((2, BUCKETS)), np.zeros((2, 2))
    for c in chunks:
        np.add.at(number, (c.held.astype(int), c.toxic.astype(int)), 1)
        for i in c.training():
            seen[int(c.toxic[i]), np.unique(c.table[np.unique(c.text(i))])] += 1
    return np.concatenate([seen.ravel(), number.ravel()]) if number.any() else None


def _shapes(kept: int) -> list[tuple]:
    """Of the embeddings (blank first), the taps, the biases and weights of filters, and the offset."""
    return [(kept + 1, DIM), *((w * DIM, FILTERS) for w in WIDTHS), (len(WIDTHS) * FILTERS,), (len(WIDTHS) * FILTERS,), (1,)]


def _split(vector: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s).astype(np.float32) for x, s in zip(np.split(vector, ends[:-1]), shapes, strict=True)]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in arrays])


def _first(rate: np.ndarray, kept: np.ndarray, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    # the first dimension starts from how much likelier a word is in toxic rows, shrunk for rare words
    emb[:, 0] = np.log(rate[1] / rate[0]) / 4
    taps = [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for tap in taps:
        tap[::DIM] = np.abs(tap[::DIM]) + 0.5
    return [np.concatenate([np.zeros((1, DIM), np.float32), emb[kept]]), *taps, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), np.zeros(1, np.float32)]


def _epoch(chunk: _Chunk, place: np.ndarray, state: list[list[np.ndarray]], step: int, share: float, rng: np.random.Generator) -> int:
    """Trains on a chunk's texts once, in batches, by Adam; changes state (parameters, means, mean squares), returns the steps so far."""
    params, mean, square = state
    emb, taps, bias, weight = params[0], params[1 : 1 + len(WIDTHS)], params[-3], params[-2]
    order, at = rng.permutation(chunk.training()), 0
    lengths = np.cumsum(np.diff(chunk.first)[order])
    while at < len(order):
        # long texts make smaller batches; none is cut
        upto = min(at + 32, max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + BATCH_WORDS, "right"))))
        batch = order[at:upto]
        own, at = [chunk.text(i) for i in batch], upto
        kinds, same = np.unique(np.concatenate(own), return_inverse=True)
        ids = place[chunk.table[kinds]]
        ids = np.where(rng.random(ids.shape) < 0.9, ids, 0)
        word = np.concatenate([np.zeros((1, DIM), np.float32), emb[ids].sum(axis=1)])
        padded, start, rows = _padded((same + 1).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
        sizes, peaks, where = np.diff(np.append(rows, len(start))), [], []
        for w, tap in zip(WIDTHS, taps, strict=True):
            r = sum((word @ tap[k * DIM : (k + 1) * DIM])[padded[start + k]] for k in range(w))
            top = np.maximum.reduceat(r, rows, axis=0)
            first = np.where(r == np.repeat(top, sizes, axis=0), np.arange(len(start), dtype=np.int32)[:, None], np.int32(len(start)))
            where.append(start[np.minimum.reduceat(first, rows, axis=0)])
            peaks.append(top)
        h_in = np.concatenate(peaks, axis=1) + bias
        h = np.maximum(h_in, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ weight + params[-1], -30, 30)))
        label = chunk.toxic[batch]
        g = ((p - label) * np.where(label, 0.5 / share, 0.5 / max(1 - share, 1e-3)) / len(batch)).astype(np.float32)
        dh = np.outer(g, weight) * (h_in > 0)
        d_word, d_taps = np.zeros_like(word), [np.zeros_like(t) for t in taps]
        for j, (w, peak) in enumerate(zip(WIDTHS, where, strict=True)):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(w):
                at_peak, cut = padded[peak + k], slice(k * DIM, (k + 1) * DIM)
                d_taps[j][cut] = np.einsum("bfd,bf->df", word[at_peak], d)
                np.add.at(d_word, at_peak, d[:, :, None] * taps[j][cut].T[None])
        hit = np.flatnonzero(d_word[1:].any(axis=1))
        d_emb = np.zeros_like(emb)
        np.add.at(d_emb, ids[hit], d_word[1 + hit][:, None, :])
        d_emb[0] = 0
        step += 1
        for p_, g_, m, v in zip(params, [d_emb, *d_taps, dh.sum(0), h.T @ g, np.array([g.sum()], np.float32)], mean, square, strict=True):
            m += 0.1 * (g_ - m)
            v += 0.001 * (g_ * g_ - v)
            p_ -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6) + 1e-4 * p_
    return step


def _fit(packed: DataFrame, seen: np.ndarray, number: np.ndarray, epochs: int, seed: int) -> ToxicityModel:
    """Rounds over all texts that train: every shard goes on from the same network, and the next round starts from the mean of the
    shards' networks, weighed by their texts. With one shard that is plain training."""
    rate, total = (seen + 1) / (number[:, None] + 2), number.sum()
    rare = seen.sum(0) < max(3, 0.005 * total)  # nothing is learnt of these: they stay blank
    rare[0] = True
    kept, share, steps = np.flatnonzero(~rare), max(float(number[1] / max(total, 1)), 1e-3), 0.0
    place = np.zeros(BUCKETS, np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    params, shapes, spark = _first(rate, kept, seed), _shapes(len(kept)), packed.sparkSession
    state = np.concatenate([_joined(params), np.zeros(2 * sum(x.size for x in params))])
    for epoch in range(epochs):
        known = spark.sparkContext.broadcast((state.astype(np.float32), steps))

        def trained(chunks: Iterator[_Chunk], epoch: int = epoch, known=known) -> np.ndarray | None:
            begun, before = known.value
            out = None
            for c in chunks:
                n = len(c.training())
                own = [_split(x, shapes) for x in np.split(begun, 3)]
                after = _epoch(c, place, own, int(round(before)), share, np.random.default_rng([seed, epoch, c.shard]))
                vector = n * np.concatenate([*(_joined(x) for x in own), [after, 1.0]]).astype(np.float64)
                out = vector if out is None else out + vector
            return out

        total_state = _summed(packed, trained, np.float32)
        known.destroy()
        if total_state is None or not total_state[-1]:
            break  # all rows are held
        state, steps = total_state[:-2] / total_state[-1], total_state[-2] / total_state[-1]
    params = _split(np.split(state, 3)[0], shapes)
    emb = np.zeros((BUCKETS, DIM), np.float32)
    emb[kept] = params[0][1:]
    return ToxicityModel(emb, params[1 : 1 + len(WIDTHS)], params[-3], params[-2], float(params[-1][0]))


def _held(packed: DataFrame, model: ToxicityModel) -> DataFrame:
    """z (the model's logit), y, lang of every text that is held."""
    known = packed.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            for i in np.array_split(np.flatnonzero(c.held), max(1, len(c.words) // BATCH_WORDS)):
                if len(i):
                    own = [c.text(x) for x in i]
                    z = known.value.logits(c.table[np.concatenate(own)], np.concatenate([[0], np.cumsum([len(x) for x in own])]))
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), pa.array(c.toxic[i].astype(np.int32)), pa.array([c.langs[x] for x in i], pa.string())], ["z", "y", "lang"])

    return stage(packed.mapInArrow(logits, "z double, y int, lang string"), "tox-held")


def _probability(a: float, b: float, most: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(a) * F.col("z") + F.lit(b)))))


def _calibrate(model: ToxicityModel, held: DataFrame) -> None:
    """A logistic of the logit by Newton steps, lightly held to slope 1; then the middle of the best gap for every language.

    held has z, y, lang. A step is one aggregation; counts above a cut are those of higher ranges and of the cut's own range.
    """
    a, b = 1.0, 0.0
    mean = held.agg(F.avg("y")).first()[0]
    weight = F.when(F.col("y") == 1, 0.5 / max(mean, 1e-3)).otherwise(0.5 / max(1 - mean, 1e-3))
    for _ in range(25):
        p = _probability(a, b, 30.0)
        g, v = weight * (p - F.col("y")), weight * p * (1 - p)
        s = held.select("z", g.alias("g"), v.alias("v")).agg(*(F.sum(x) for x in (F.col("g") * F.col("z"), F.col("g"), F.col("v") * F.col("z") * F.col("z"), F.col("v") * F.col("z"), F.col("v")))).first()
        step = np.linalg.solve(np.array([[s[2] + 0.5, s[3]], [s[3], s[4] + 0.5]]), np.array([s[0] + 0.5 * (a - 1), s[1] + 0.5 * b]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-12:
            break
    model.scale = (max(a, 0.1), b)
    u = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(model.scale[0]) * F.col("z") + F.lit(b)))
    rows = held.where("lang IS NOT NULL").select("lang", _probability(*model.scale, 40.0).alias("p"), F.floor(u * 50).alias("range"), F.lit(1).alias("n"), "y")
    middle = rows.select("lang").distinct().select("lang", F.lit(0.5).alias("p"), F.lit(0).cast("long").alias("range"), F.lit(0).alias("n"), F.lit(0).alias("y"))
    points = rows.union(middle).groupBy("lang", "p").agg(F.min("range").alias("range"), F.sum("n").alias("n"), F.sum("y").alias("y"))
    # at most 4,001 ranges a language
    ranges = points.groupBy("lang", "range").agg(F.sum("n").alias("rn"), F.sum("y").alias("ry"), F.min("p").alias("low"))
    up, whole = W.partitionBy("lang").orderBy("range"), W.partitionBy("lang")
    ranges = ranges.select("lang", "range", (F.sum("rn").over(up) - F.col("rn")).alias("bn"), (F.sum("ry").over(up) - F.col("ry")).alias("by"), F.lead("low").over(up).alias("above"), F.sum("rn").over(whole).alias("all_n"), F.sum("ry").over(whole).alias("all_y"))
    inside = W.partitionBy("lang", "range").orderBy("p")
    own = points.select("lang", "range", "p", F.sum("n").over(inside).alias("n"), F.sum("y").over(inside).alias("y"), F.lead("p").over(inside).alias("next"))
    cuts = own.join(ranges, ["lang", "range"]).where("all_y >= 5").withColumn("cut", (F.col("p") + F.coalesce("next", "above")) / 2).where("cut IS NOT NULL")
    caught, flagged = F.col("all_y") - F.col("by") - F.col("y"), F.col("all_n") - F.col("bn") - F.col("n")
    f1 = 2 * caught / F.greatest(F.lit(1), flagged + F.col("all_y"))
    best = cuts.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), (-F.abs(F.col("cut") - 0.5)).alias("near"), (-F.col("cut")).alias("cut")))["cut"].alias("cut"))
    model.thresholds |= {r["lang"]: -r["cut"] for r in best.orderBy("lang").collect()}


def learn_toxicity(docs: DataFrame, labels: DataFrame, epochs: int = 6, seed: int = 7) -> ToxicityModel:
    """Fits the network on all rows with a label, in shards of SHARD_BYTES; every fifth row by hash calibrates.

    Rows with null doc_id, text or label don't count; rows that share a doc_id count once, with the text that comes first, and
    labels that disagree count as toxic. With no row of one of the labels the model gives every text the share of toxic rows, or 0
    if there are no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with scratch() as made:
        packed = _training(docs, labels)
        seen = _summed(packed, _seen)
        number = np.zeros((2, 2)) if seen is None else seen[-4:].reshape(2, 2)
        if not number.sum(axis=0).all():
            z = 40.0 if number[:, 1].any() else -40.0
            model = ToxicityModel(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), np.zeros(len(WIDTHS) * FILTERS), z)
        else:
            model = _fit(packed, seen[:-4].reshape(2, BUCKETS), number[0], epochs, seed)
            if number[1].all():
                _calibrate(model, _held(packed, model))
    delete(spark, made)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs' columns and score (0 to 1, from the whole text alone), predicted (score >= 0.5), flagged (score >= the threshold of the
    row's lang, or 0.5 for a lang without its own).

    Null and empty texts are scored as one blank word. Rows that repeat get the same result; an empty table gives an empty result;
    existing columns with the names of the new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("score", "predicted", "flagged")]
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text")
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(known.value.score(buf, offs), pa.float64())], ["row", "score"])

    out = inner.mapInArrow(scored, beside("row", inner.schema["row"].dataType, "score double"))
    threshold = F.lit(0.5)
    if "lang" in names and model.thresholds:
        table = F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair))
        threshold = F.coalesce(F.try_element_at(table, F.coalesce(F.col("row.lang"), F.lit(""))), F.lit(0.5))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("flagged"))
