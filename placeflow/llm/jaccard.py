"""N-gram Jaccard join: documents whose shingle sets overlap by a share of their union, as components.

The join is size-aware. Sets of up to a boundary, chosen by cost, enumerate their subsets of every size that a partner could share;
larger sets scan inverted lists of a prefix of their shingles, rare ones first. The lists that a hot shingle makes are never paired
out: each list checks all members against one centre, and what remains are pairs in different components whose rare shingles and
parity sketches allow a link; the join's condition tests these bounds, and only pairs within them come out. Equal sets are one node
throughout.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import bound_batches, input_partitions, stage
from ._text import Prints, blocks, combine, mix, split_words
from .components import components

WORDS, PERCENT = 5, 80
#: A shingle in more documents than this is heavy: it comes last in every prefix, and its list is checked around centres.
LIGHT = 8
#: Heavy shingles that are sent to every task, the most frequent first; others keep the place of rare ones, which costs only time.
MOST_HEAVY = 1 << 21
#: Share of the hash range whose shingles are counted; larger than a prefix, so that heavy ones can be skipped.
COUNTED = 0.35
#: Largest set that may count as small, and rounds of new centres before the rest is paired.
MOST_SMALL, ROUNDS = 16, 4
#: Prefix shingles that linked sets share at least, if they share so many at all; prefixes are longer by one less.
SHARED = 4
#: Longs of a set's parity sketch.
SKETCH_LONGS = 16
#: Rows of a table of ids that may be broadcast.
SMALL = 1 << 20
_BUFFER = 400_000
_ROLL = Prints(seed=10, fold_case=True)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's shingles; a row of fewer words has one, a row without words none."""
    w = split_words(buf, offs)
    h = _ROLL.ranges(buf, w.start, w.end)
    all_ = combine(h, words)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(all_[a : b - words + 1]))
        else:
            out.append(mix(combine(h[a:b], b - a) ^ np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _required(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set linked to it."""
    return -(-n * percent // 100)


def _prefix_length(n: int, percent: int) -> int:
    """Linked sets share min(SHARED, what either must share) shingles among so many first ones of each."""
    need = _required(n, percent)
    return n - need + min(SHARED, need)


def subset_sizes(n: int, largest: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a small set of n enumerates: what it must share with partners of n to `largest` shingles, or with smaller ones."""
    return sorted({_required(m, percent) for m in range(n, min(largest, n * 100 // percent) + 1)})


def _signatures(tokens: np.ndarray, largest: int, percent: int) -> np.ndarray:
    out = []
    for size in subset_sizes(len(tokens), largest, percent):
        picks = np.array(list(itertools.combinations(range(len(tokens)), size)), np.int64)
        h = np.full(len(picks), size, np.uint64)
        for column in picks.T:
            h = mix(h * np.uint64(31) + tokens[column])
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _prefix(tokens: np.ndarray, heavy: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    need = _prefix_length(len(tokens), percent)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        is_heavy = heavy[at] == tokens
        light = tokens[~is_heavy]
        if len(light) < need:
            last = tokens[is_heavy][np.argsort(rank[at[is_heavy]], kind="stable")]
            return np.concatenate([light, last])[:need]
        return light[:need]
    return tokens[:need]


def _end(tokens: np.ndarray, heavy: np.ndarray, rank: np.ndarray, percent: int) -> tuple[int, int]:
    """Place of the last prefix shingle in the order that prefixes follow: light ones by hash, then heavy ones by rank."""
    if not len(tokens):
        return 0, 0
    last = _prefix(tokens, heavy, rank, percent)[-1]
    at = np.searchsorted(heavy, last)
    return (1, int(rank[at])) if at < len(heavy) and heavy[at] == last else (0, int(last) - (1 << 63))


def boundary(counts: dict[int, int], percent: int = PERCENT) -> int:
    """The size up to which subsets cost less than prefixes: rows written, those of prefixes twice since their lists are read and checked."""

    def cost(b: int) -> float:
        subsets = sum(n * sum(math.comb(s, c) for c in subset_sizes(s, b, percent)) for s, n in counts.items() if s <= b)
        return subsets + 2 * sum(n * _prefix_length(s, percent) for s, n in counts.items() if s >= _required(b + 1, percent))

    return min(range(0, MOST_SMALL + 1), key=lambda b: (cost(b), b))


def _bucketed(found: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int, count: bool) -> Iterator[pa.RecordBatch]:
    """Packs (tokens, nodes) by bucket. A token that is already repeated in the buffer goes to its bucket once with its number; when
    members are asked for, the token goes there without one (kind 2), and its members to a bucket of their own choosing (kind 1): so no
    bucket grows with a hot token. Kind 0 is a token's number or its single member."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        tokens, nodes = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        held.clear()
        order = np.argsort(tokens, kind="stable")
        tokens, nodes = tokens[order], nodes[order]
        head = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        n = np.diff(np.append(head, len(tokens)))
        many = np.repeat(n > 1, n)
        if count:
            parts = [(0, tokens[head], n, tokens[head])]
        else:
            one, more = head[n == 1], head[n > 1]
            parts = [(0, tokens[one], nodes[one], tokens[one]), (2, tokens[more], nodes[more], tokens[more]), (1, tokens[many], nodes[many], mix(tokens[many] ^ nodes[many].astype(np.uint64)))]
        out: list[list] = [[], [], [], []]
        for kind, t, v, by in parts:
            at = (mix(by) >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                for column, value in zip(out, (b, kind, t[own].tobytes(), v[own].astype(np.int64).tobytes()), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["bucket", "kind", "tokens", "nodes"])

    total = 0
    for tokens, nodes in found:
        held.append((tokens, nodes))
        total += len(tokens)
        if total >= _BUFFER:
            yield flush()
            total = 0
    if total:
        yield flush()


_PACKED = "bucket int, kind int, tokens binary, nodes binary"


def _pack(docs: DataFrame, select: Callable[[np.ndarray], np.ndarray], buckets: int, words: int, count: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch, buf, offs in blocks(batches):
                own = [select(s) if len(s) else s for s in shingle_sets(buf, offs, words)]
                yield np.concatenate(own), np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(s) for s in own])

        yield from _bucketed(found(), buckets, count)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _PACKED).repartitionById(buckets, F.col("bucket"))


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of more than LIGHT documents; a partition holds all blobs of its buckets."""
    tokens, n = _unpacked(batches)[:2]
    order = np.argsort(tokens)
    tokens, n = tokens[order], n[order]
    head = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, head) if len(head) else n
    yield pa.RecordBatch.from_arrays([pa.array(tokens[head][total > LIGHT].view(np.int64)), pa.array(total[total > LIGHT])], ["token", "df"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens, nodes, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    for rows in batches:
        for kind, t, v in zip(*(rows.column(c).to_pylist() for c in ("kind", "tokens", "nodes")), strict=True):
            tokens.append(np.frombuffer(t, np.uint64))
            nodes.append(np.frombuffer(v, np.int64))
            kinds.append(np.full(len(nodes[-1]), kind, np.int8))
    return np.concatenate(tokens), np.concatenate(nodes), np.concatenate(kinds)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, node of tokens that are not alone: those marked as repeated, and those that meet another here."""

    def rows(tokens: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(tokens), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(tokens[lo : lo + 50_000].view(np.int64)), pa.array(nodes[lo : lo + 50_000])], ["token", "node"])

    tokens, nodes, kinds = _unpacked(batches)
    apart = kinds == 1
    yield from rows(tokens[apart], nodes[apart])
    tokens, nodes, kinds = tokens[~apart], nodes[~apart], kinds[~apart]
    if len(tokens):
        order = np.argsort(tokens)
        tokens, nodes, kinds = tokens[order], nodes[order], kinds[order]
        same = np.append(False, tokens[1:] == tokens[:-1])
        keep = (same | np.append(same[1:], False)) & (kinds == 0)
        yield from rows(tokens[keep], nodes[keep])


def shingle_features(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (distinct shingles) and a 16-byte digest of the set, for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in blocks(batches):
            sets = shingle_sets(buf, offs, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())], ["doc_id", "n", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, digest binary")


def _sets(docs: DataFrame, words: int, end: Callable[[np.ndarray], tuple[int, int]]) -> DataFrame:
    """node, its set as sorted hashes, and where its prefix ends."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in blocks(batches):
            sets = shingle_sets(buf, offs, words)
            packed = [s.tobytes() for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            ends = [end(s) for s in sets]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary()), pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "digest", "tokens", "tier", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "node long, digest binary, tokens binary, tier int, end long")


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            one, two = _tokens(x), _tokens(y)
            at = np.minimum(np.searchsorted(two, one), max(len(two) - 1, 0))
            n.append((int(np.sum(two[at] == one)), len(one), len(two)) if len(two) else (0, len(one), 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in n], pa.int64()) for i in range(3))], ["a", "b", "overlap", "n_a", "n_b"])


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, overlap, n_a, n_b of the distinct pairs; only sets that are needed move."""
    pairs, sets = stage(pairs.distinct(), "jac-pairs"), sets.select("node", "tokens")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if pairs.count() <= SMALL // 2:
        wanted = F.broadcast(wanted)
        sets = sets.join(wanted, "node", "left_semi")
    one, two = sets.toDF("a", "tokens_a"), sets.toDF("b", "tokens_b")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_overlaps, "a long, b long, overlap long, n_a long, n_b long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) for every row.

    Two documents link when 100 * intersection >= percent * union of their sets of word shingles. Rows without words (null and
    empty texts too) have an empty set and link with nothing. Rows without doc_id keep a null component and link with nothing. Rows
    that share a doc_id are one node: its set is that of the row with the smallest digest, and each row keeps its own n_shingles. Texts
    are read whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    bound_batches(docs.sparkSession)
    features = stage(shingle_features(docs, words), "jac-features")
    nodes = features.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("s")).select("doc_id", "s.digest", "s.n")
    classes = nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    reps = stage(classes.select(F.col("rep").alias("node"), "n"), "jac-reps")
    repeated = not features.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    links = _links(docs.where("doc_id IS NOT NULL"), reps, repeated, percent, words)
    named = components(links)
    low = classes.select("digest", F.col("rep").alias("node")).join(named, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    member = nodes.join(low, "digest").select("doc_id", "component_id")
    return features.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(docs: DataFrame, reps: DataFrame, repeated: bool, percent: int, words: int) -> DataFrame:
    """Linked pairs (a, b) of nodes that connect every component; not all pairs within one."""
    spark = docs.sparkSession
    buckets = input_partitions(docs, 8 << 20, 12)
    edge = np.uint64(int(COUNTED * (1 << 64)))
    counted = _pack(docs, lambda s: s[: np.searchsorted(s, edge)], buckets, words, True)
    heavy = stage(counted.mapInArrow(_heavy, "token long, df long"), "jac-heavy")
    top = heavy.orderBy(F.desc("df"), "token").limit(MOST_HEAVY).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    known = spark.sparkContext.broadcast((tokens[order], len(order) - order))
    b = boundary({r["n"]: r["count"] for r in reps.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").count().collect()}, percent)

    def select(s: np.ndarray) -> np.ndarray:
        own = [_signatures(s, b, percent)] if len(s) <= b else []
        if len(s) >= _required(b + 1, percent):
            own.append(_prefix(s, *known.value, percent))
        return np.concatenate(own)

    shared = _pack(docs, select, buckets, words, False).mapInArrow(_shared, "token long, node long")
    lists = stage(shared.join(reps, "node").select("token", "node", "n"), "jac-lists")
    sizes = lists.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    members = stage(lists.join(sizes, "token").select("token", "node", "n", "df").distinct(), "jac-members")
    near = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    heavy_nodes = members.where(F.col("df") > LIGHT).select("node").distinct()
    light = members.where(F.col("df") <= LIGHT).join(heavy_nodes.withColumn("more", F.lit(True)), "node", "left").select("token", "node", "n", F.col("more").isNotNull().alias("more"))
    met = light.alias("x").join(light.alias("y"), F.expr(f"x.token = y.token AND x.node < y.node AND {near}"))
    # what two sets must share can only be missing from light lists if both have heavy ones
    pairs = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("met"), F.max(F.expr("x.more AND y.more")).alias("more"), F.max(F.least("x.n", "y.n")).alias("n"))
    pairs = stage(pairs.where(f"more OR met >= least({SHARED}, n * {percent} div 100) OR n <= {MOST_SMALL}").select("a", "b"), "jac-light")
    wanted = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(heavy_nodes).distinct(), "jac-wanted")
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    sets = _sets(docs.join(wanted, "doc_id", "left_semi"), words, lambda s: _end(s, *known.value, percent))
    if repeated:  # one set per node, the one that reps tells the size of
        sets = sets.groupBy("node").agg(F.min(F.struct("digest", "tokens", "tier", "end")).alias("s")).select("node", "s.*")
    sets = stage(sets.select("node", "tokens", "tier", "end"), "jac-sets")
    rest = stage(_listed(_heavy_members(members, b, percent)), "jac-rest")
    first = rest
    star = rest.where("node <> centre").selectExpr("centre AS a", "node AS b")
    checked = stage(_checked(pairs.union(star), sets), "jac-checked")
    linked = f"100 * overlap >= {percent} * (n_a + n_b - overlap)"
    links = [checked.where(linked).select("a", "b")]
    for round_ in range(ROUNDS):
        # members that their centre did not take form the next list; one or two more rounds settle most lists
        taken = checked.where(linked).select(F.col("a").alias("centre"), F.col("b").alias("node"))
        rest = stage(_listed(rest.where("node <> centre").join(taken, ["centre", "node"], "left_anti")), "jac-rest")
        if rest.isEmpty():
            break
        checked = stage(_checked(rest.where("node <> centre").selectExpr("centre AS a", "node AS b"), sets), "jac-checked")
        links.append(checked.where(linked).select("a", "b"))
    found = stage(_union(links), "jac-links")
    # what is left: pairs of one list in different components whose own shingles and sketches allow a link
    named = components(found)
    first = first.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sketches = stage(_sketches(sets.join(first.select("node").distinct(), "node", "left_semi")), "jac-sketches")
    placed = stage(first.join(sketches, "node"), "jac-placed")
    differ = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(SKETCH_LONGS))
    bound = f"100 * (x.n + y.n - ({differ})) >= {percent} * (x.n + y.n + ({differ}))"
    # `most` holds for the one whose prefix ends first: what it has there would be in the other's prefix too
    first_end = "struct(x.tier, x.end, x.node) < struct(y.tier, y.end, y.node)"
    possible = f"100 * x.most >= {percent} * (x.n + y.n - x.most)"
    open_ = placed.where("core").alias("x").join(placed.alias("y"), F.expr(f"x.token = y.token AND x.component <> y.component AND {first_end} AND {near} AND {possible} AND {bound}"))
    last = _checked(open_.selectExpr("least(x.node, y.node) AS a", "greatest(x.node, y.node) AS b"), sets)
    return stage(found.union(last.where(linked).select("a", "b")), "jac-links")


def _heavy_members(members: DataFrame, b: int, percent: int) -> DataFrame:
    """token, node, n, most, core of the members of heavy lists that may have links which light lists don't show.

    All pairs of light lists are checked, so a link that they don't show shares heavy shingles only. It shares SHARED of a prefix: sets
    with fewer heavy ones there are done (sets of up to b, which have subsets instead, stay). And where x's prefix ends no
    later than y's in their order, it shares at most `most`, what is left of x without its own light prefix: a shingle from there that
    y held would be in y's prefix, and its light list would have shown the pair. y's light prefix may reach further and says nothing
    of x. With a light part of p and s shared ones, a link of 80 % needs p <= s / 4; in general x is `core`.
    """
    need = f"((n * {percent} + 99) div 100)"
    of_partner = f"(({need} * {percent} + 99) div 100)"
    light = F.expr(f"CASE WHEN n <= {b} THEN 0L ELSE n - {need} + least({SHARED}, {need}) - heavy END")
    heavy = members.where(F.col("df") > LIGHT)
    counted = heavy.join(heavy.groupBy("node").agg(F.count("*").alias("heavy")), "node").where(f"n <= {b} OR heavy >= least({SHARED}, {of_partner})")
    rows = counted.withColumn("light", F.greatest(light, F.lit(0).cast("long"))).withColumn("most", F.col("n") - F.col("light"))
    return rows.select("token", "node", "n", "most", F.expr(f"{percent} * light <= {100 - percent} * most").alias("core"))


def _listed(rows: DataFrame) -> DataFrame:
    """rows of lists with several members, and each list's centre: the member with the smallest light part, then the smallest node."""
    columns = ("token", "node", "n", "most", "core")
    purest = F.min(F.struct((F.col("n") - F.col("most")) / F.col("n"), "node"))["node"]
    lists = rows.groupBy("token").agg(F.count("*").alias("members"), purest.alias("centre")).where("members > 1")
    return rows.select(*columns).join(lists, "token").select(*columns, "centre")


def _sketches(sets: DataFrame) -> DataFrame:
    """node, where its prefix ends, and the parities of its shingles' numbers in 64 * SKETCH_LONGS hash buckets, as longs.

    Where two sketches differ, the sets differ: common shingles cancel out, so as many bits differ as shingles at most.
    """
    names = [f"s{i}" for i in range(SKETCH_LONGS)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, SKETCH_LONGS), np.int64)
            for i, raw in enumerate(batch.column(1).to_pylist()):
                at = (mix(_tokens(raw)) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
                out[i] = np.packbits(np.bincount(at, minlength=64 * SKETCH_LONGS) & 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(out[:, i]) for i in range(SKETCH_LONGS))], ["node", "tier", "end", *names])

    return sets.select("node", "tokens", "tier", "end").mapInArrow(rows, ", ".join(["node long, tier int, end long", *(f"{c} long" for c in names)]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out.distinct()
