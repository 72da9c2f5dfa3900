"""Conversation structure repair: faults by row, and the cheapest edits to `system? (user assistant)+`, by a time-major dynamic programme.

A conversation's rows meet in one partition twice, in one sort: first all rows of the partition without their texts, then again with
them. The programme needs only some bytes a row. It runs over buckets of conversations of like length, whose state costs are updated
turn by turn for all conversations at once; backward costs are kept, and the edits are traced forwards with them, again for all at
once. Texts then pass by one batch at a time, so a worker never holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import bound_batches, input_partitions

#: Costs of edits; TRUNCATED comes on top of a kept row whose text breaks off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Bytes of input for each partition, and cells (turns x conversations) of the programme at once.
PARTITION_BYTES, CELLS = 16 << 20, 1 << 20
SPACES = " \t\n\x0b\f\r"
# States: nothing yet, after system, after user, after assistant; 0 and 3 may end. What a user or assistant row, whichever may come, leads to:
_NEXT = np.array([2, 2, 3, 2])
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int32)
_FAR = np.int32(1 << 30)
_ROLE = {2: "user", 3: "assistant"}


def _initial(role: Column) -> Column:
    """0 system, 1 user, 2 assistant, by the role's first letter; 3 any other."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).cast("byte")


def _backward(initial: np.ndarray, fault: np.ndarray, length: np.ndarray) -> np.ndarray:
    """costs[t, state, conversation] of the rest from turn t on. initial, fault: [turn, conversation]; fault 2 must go, 1 is truncated."""
    turns, n = initial.shape
    costs = np.empty((turns + 1, 4, n), np.int32)
    costs[turns] = _END[:, None]
    for t in range(turns - 1, -1, -1):
        after, x = costs[t + 1], initial[t]
        keep = np.where(fault[t] == 2, _FAR, np.where(fault[t] == 1, TRUNCATED, 0)).astype(np.int32)
        best = after + DELETE
        for q in range(4):
            to = _NEXT[q]
            step = np.where(x == to - 1, 0, REROLE)  # a kept user or assistant, or a row made one
            np.minimum(best[q], keep + step + after[to], out=best[q])
        np.minimum(best[0], np.where(x == 0, keep + after[1], _FAR), out=best[0])
        here = np.minimum(best, np.minimum(best[_NEXT] + INSERT, best[_NEXT[_NEXT]] + 2 * INSERT))
        costs[t] = np.where(t < length, here, _END[:, None])
    return costs


def _forward(costs: np.ndarray, initial: np.ndarray, fault: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """letters[t, place, conversation] of the edits, 0 for none: two places for insertions before turn t, one for its own edit; and
    the state before each of them. Of equally cheap edits the least letter is taken, which gives the least string."""
    turns, n = initial.shape
    letters, states = np.zeros((turns + 1, 3, n), np.uint8), np.zeros((turns + 1, 3, n), np.int8)
    state, who = np.zeros(n, np.int64), np.arange(n)
    for t in range(turns + 1):
        now = costs[t]
        for place in range(2):
            left, to = now[state, who], _NEXT[state]
            gone = (costs[t + 1][state, who] + DELETE == left) & (t < length) if t < turns else np.zeros(n, bool)
            add = (t <= length) & ~gone & (now[to, who] + INSERT == left)
            states[t, place] = state
            letters[t, place][add] = ord("I")
            state = np.where(add, to, state)
        if t == turns:
            break
        live, left, to = t < length, now[state, who], _NEXT[state]
        after = costs[t + 1]
        gone = live & (after[state, who] + DELETE == left)
        extra = np.where(fault[t] == 1, TRUNCATED, 0)
        system = (state == 0) & (initial[t] == 0) & (extra + after[1] == left)
        same = (initial[t] == to - 1) & (extra + after[to, who] == left)
        kept = live & ~gone & (fault[t] < 2) & (system | same)
        made = live & ~gone & ~kept
        states[t, 2] = state
        letters[t, 2] = np.select([gone, kept, made], [ord("D"), ord("K"), ord("R")], 0)
        state = np.where(kept & system & ~same, 1, np.where(kept | made, to, state))
    return letters, states


def cheapest_edits(initial: np.ndarray, fault: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """For rows of conversations that follow one another (first: where each begins, and the number of rows): costs and edits of each
    conversation, and by row its letter and the state before it, and the insertions before it (last one: at the conversation's end)."""
    n = len(first) - 1
    length = np.diff(first)
    cost, edits = np.zeros(n, np.int64), [b""] * n
    letter, state = np.zeros(first[-1], np.uint8), np.zeros(first[-1], np.int8)
    inserted = np.zeros(first[-1] + n, np.int8)  # one place more for each conversation
    order = np.argsort(length, kind="stable")
    at = 0
    while at < n:
        # like lengths together, so that at most half of the cells are padding
        shortest = max(1, int(length[order[at]]))
        end = int(np.searchsorted(length[order], 2 * shortest, "left"))
        end = max(at + 1, min(end, at + max(1, CELLS // (2 * shortest))))
        own = order[at:end]
        at = end
        turns, size = int(length[own].max()), length[own]
        cell = np.arange(turns)[:, None]
        rows = np.minimum(first[own] + cell, max(0, first[-1] - 1))
        inside = cell < size
        x = np.where(inside, initial[rows], 3) if turns else np.zeros((0, len(own)), np.int8)
        f = np.where(inside, fault[rows], 2) if turns else np.zeros((0, len(own)), np.int8)
        costs = _backward(x, f, size)
        letters, states = _forward(costs, x, f, size)
        cost[own] = costs[0, 0]
        flat = letters.transpose(2, 0, 1).reshape(len(own), -1)
        for k, c in enumerate(own.tolist()):
            edits[c] = flat[k][flat[k] > 0].tobytes()
        letter[rows[inside]], state[rows[inside]] = letters[:-1, 2][inside], states[:-1, 2][inside]
        upto = np.arange(turns + 1)[:, None]
        there = upto <= size
        inserted[(first[own] + own + upto)[there]] = (letters[:, :2] > 0).sum(axis=1)[there]
    return cost, edits, letter, state, inserted


class _Partition:
    """What is known of a partition's conversations once its rows have passed without texts."""

    def __init__(self, rows: pa.Table) -> None:
        value = rows["conv_id"].combine_chunks()
        null = np.asarray(value.is_null())
        ids = value.fill_null(0).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
        self.ids = [None if null[i] else int(ids[i]) for i in begins]
        of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(ids)]))
        there = rows["there"].to_numpy()
        self.of = of = of[there]
        n = len(begins)
        self.first = first = np.searchsorted(of, np.arange(n + 1))
        initial, blank, cut = (rows[c].to_numpy()[there] for c in ("initial", "blank", "truncated"))
        digest = rows["digest"].combine_chunks().filter(pa.array(there)).cast(pa.binary(32))
        raw = np.frombuffer(digest.buffers()[1], "V32", len(digest), 32 * digest.offset) if len(digest) else np.zeros(0, "V32")
        pair = np.zeros(len(of), [("c", np.int64), ("d", "V32")])
        pair["c"], pair["d"] = of, raw
        seen = np.ones(len(of), bool)
        seen[np.unique(pair.view("V40"), return_index=True)[1]] = False
        twice, cut = seen & ~blank, cut & ~blank & ~seen
        count = lambda x: np.bincount(of[x], minlength=n)
        self.blank, self.duplicate, self.truncated = count(blank), count(twice), count(cut)
        same = of[1:] == of[:-1]
        code = initial.astype(np.int64)
        fine = np.isin(code[:-1] * 4 + code[1:], [1, 6, 9])  # su, ua, au
        self.illegal = np.bincount(of[1:][same & ~fine], minlength=n)
        turn = rows["turn"].combine_chunks().filter(pa.array(there))
        known = ~np.asarray(turn.is_null())
        t, c = turn.fill_null(0).to_numpy(zero_copy_only=False)[known], of[known]
        new = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])] if len(t) else np.zeros(0, bool)
        self.gaps = np.zeros(n, np.int64)
        some, low, high = *np.unique(c, return_index=True), np.searchsorted(c, np.unique(c), "right") - 1
        self.gaps[some] = t[high] - t[low] + 1 - np.bincount(c[new], minlength=n)[some]
        fault = np.where(blank | seen, 2, np.where(cut, 1, 0)).astype(np.int8)
        self.cost, self.edits, self.letter, self.state, self.inserted = cheapest_edits(initial, fault, first)

    def turns(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, str, bytes]]:
        """conversation, role, text of the repaired rows that the batch's rows lead to; its first row is the partition's row at."""
        roles, texts = batch.column("role").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        for i, (role, text) in enumerate(zip(roles, texts, strict=True), at):
            c = int(self.of[i])
            letter, state = self.letter[i], int(self.state[i])
            yield from self._inserted(c, i, state)
            if letter != ord("D"):
                yield c, role if letter == ord("K") else _ROLE[int(_NEXT[state])], text
            if i + 1 == self.first[c + 1]:
                after = state if letter == ord("D") else 1 if letter == ord("K") and state == 0 and role[:1] == "s" else int(_NEXT[state])
                for _ in range(self.inserted[i + 1 + c]):
                    after = int(_NEXT[after])
                    yield c, _ROLE[after], b""

    def _inserted(self, c: int, i: int, state: int) -> Iterator[tuple[int, str, bytes]]:
        """Rows inserted before row i, whose edit finds the state: the last of them has led to it."""
        n = int(self.inserted[i + c])
        last = state
        for k in range(n):
            yield c, _ROLE[last if k == n - 1 else 5 - last], b""


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Partition, pa.RecordBatch | None, int]]:
    """The partition's plan, first without and then with each batch of rows with texts, and the number of rows before it."""
    light: list[pa.RecordBatch] = []
    known, at = None, 0
    names = ["conv_id", "turn", "there", "initial", "blank", "truncated", "digest"]
    for batch in batches:
        heavy = batch.column("heavy").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(heavy, True))
        if cut:
            light.append(batch.slice(0, cut).select(names))
        if cut < batch.num_rows:
            if known is None:
                known = _Partition(pa.Table.from_batches(light))
                light.clear()
                yield known, None, 0
            part = batch.slice(cut)
            yield known, part, at
            at += part.num_rows
    if known is None and light:
        yield _Partition(pa.Table.from_batches(light)), None, 0


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, current = hashlib.sha256(), -1
    done: dict[int, str] = {}
    known = None

    def rows(which: dict[int, str]) -> pa.RecordBatch:
        order = list(which)
        columns = [[known.ids[c] for c in order], *(getattr(known, k)[order] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), [known.edits[c].decode() for c in order], [which[c] for c in order]]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    for known, batch, at in _passes(batches):
        if batch is None:
            # conversations of which nothing is left: no row with a text will name them
            left = {c: hashlib.sha256().hexdigest() for c in range(len(known.ids)) if not known.edits[c].strip(b"D")}
            if left:
                yield rows(left)
            continue
        for c, role, text in known.turns(batch, at):
            if c != current:
                if current >= 0:
                    done[current] = digest.hexdigest()
                digest, current = hashlib.sha256(), c
                digest.update(f"{role}:".encode() + text)
            else:
                digest.update(f"\n{role}:".encode() + text)
        if done:
            yield rows(done)
            done.clear()
    if current >= 0:
        yield rows({current: digest.hexdigest()})


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, place = -1, 0
    for known, batch, at in _passes(batches):
        if batch is None:
            continue
        out: list[list] = [[], [], [], []]
        for c, role, text in known.turns(batch, at):
            place = place + 1 if c == current else 1
            current = c
            for x, v in zip(out, (known.ids[c], place, role, text.decode()), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "role", "text"])


def _dealt(rows: DataFrame, dropped: Column | None) -> DataFrame:
    spark = rows.sparkSession
    bound_batches(spark)
    parts = input_partitions(rows, PARTITION_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    gone = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), (~gone).alias("there"), role.alias("role"), text.alias("text"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = own.withColumns({
        "initial": _initial(F.col("role")),
        "blank": end == "",
        "truncated": ~F.substring(end, -1, 1).isin(".", "!", "?"),
        "digest": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
    })
    twice = seen.withColumn("heavy", F.explode(F.when(F.col("there"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = twice.withColumn("text", F.when(F.col("heavy"), F.col("text")))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("heavy", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")


def repair_report(rows: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of rows (conv_id, turn, role, text).

    Rows count by turn (nulls first; ties by role, then by a digest of role and text); those where dropped holds only name their
    conversation. Nulls in role and text are one space. A row's first fault counts: blank, duplicate (its role and text were seen
    earlier in the conversation), truncated (its last letter that is no space is none of . ! ?). gaps: turns missing between the
    smallest and the largest; illegal: neighbours whose roles' initials are not su, ua or au. Edits make the initials fit
    `(s?(ua)+)?`: Keep 0, Rerole to user or assistant 1, Delete 2 (a must for blank and duplicate rows), Insert an empty user or
    assistant row 5; a truncated row that stays adds 5. audit has the letters of the cheapest edits, the least string if several
    are. repaired_sha256 is of the repaired rows, `role:text`, joined by newlines. Rows without conv_id are one conversation. A
    conversation without rows has zeros, an empty audit and the digest of nothing. An empty table gives an empty result; other columns
    are not read. conv_id and turn are cast to long.
    """
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _dealt(rows, dropped).mapInArrow(_reports, schema)


def repaired_turns(rows: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, place (from 1), role, text of the repaired conversations; the rules are those of repair_report."""
    return _dealt(rows, dropped).mapInArrow(_turns, "conv_id long, place long, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """rows with faults by crc32 of `conv_id:turn` modulo 20 (nulls: one space), for tests of a repair: 0 marks the row as dropped,
    1 empties its text, 2 takes out . ! ?, 3 repeats the row, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.withColumn("copy", again).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"))
