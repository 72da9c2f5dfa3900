"""Bucket-pointer refinement against groups of equal strings, whatever the depth and the size of slices."""

import random
from collections import defaultdict

import numpy as np

from placeflow.llm.suffix_dedup import refine


def test_refined_buckets_are_groups_of_equal_strings():
    rng = random.Random(1)
    ran = 0
    for _ in range(300):
        depth, letters = rng.choice([16, 17, 20, 31, 32, 33, 40, 47, 48, 49, 50, 64, 70, 100]), rng.choice(["a", "ab", "abcd"])
        pool = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 160))) for _ in range(3)]
        strings = ["".join(rng.choice(pool)[rng.randint(0, 15) :] for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8))]
        at, doc, begin, per = [], [], 0, rng.choice([1, 2])
        for i, t in enumerate(strings):
            at += range(begin, begin + len(t) - depth + 1)
            doc += [i // per] * max(0, len(t) - depth + 1)
            begin += len(t)
        text = "".join(strings).encode()
        groups = defaultdict(list)
        for i, x in enumerate(at):
            groups[text[x : x + depth]].append(i)
        want = sorted(v for v in groups.values() if len({doc[i] for i in v}) > 1)
        live, bucket = refine(np.frombuffer(text, np.uint8), np.array(at, np.int64), np.array(doc, np.int64), depth, 16, rng.choice([1, 3, 10, 50, 1000]))
        got = defaultdict(list)
        for i, n in zip(live.tolist(), bucket.tolist(), strict=True):
            got[n].append(i)
        assert sorted(sorted(v) for v in got.values()) == want
        assert (np.diff(bucket) >= 0).all() and (not len(bucket) or bucket[0] == 0)
        ran += bool(want)
    assert ran > 100
