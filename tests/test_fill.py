"""Filling a sheet downwards, range by range, against a plain pass over its rows."""

import random

import pytest
from placeflow.operators.zones import forward_fill


def _plain(rows):
    out = {}
    for block in {r[0] for r in rows}:
        outer = inner = None
        section = 0
        for b, i, o, n in sorted((r for r in rows if r[0] == block), key=lambda r: r[1]):
            if o is not None:
                outer, inner, section = o, None, section + 1
            inner = n if n is not None else inner
            out[b, i] = (section, outer, inner)
    return out


@pytest.mark.parametrize("ranges", [None, 1, 3, 12, 40])
def test_fill_by_brute_force(spark, ranges):
    rng = random.Random(3)
    rows = []
    for block, n, often in (("a", 120, 0.1), ("b", 3, 0.5), ("c", 200, 0.01), (None, 30, 0.2), ("d", 90, 0.0)):
        for i in range(n):
            rows.append((block, 7 * i - 50, f"o{i}" if rng.random() < often else None, f"i{i}" if rng.random() < often * 2 else None))
    # a section over more than three ranges, opened in the first one
    rows += [("e", i, "only" if i == 0 else None, "city" if i == 2 else None) for i in range(300)]
    table = spark.createDataFrame(rows, "block string, row_idx int, o string, n string").repartition(7)
    filled = forward_fill(table, "o", "n", "block", ranges=ranges)
    got = {(r["block"], r["row_idx"]): (r["section"], r["outer_filled"], r["inner_filled"]) for r in filled.collect()}
    assert got == _plain(rows) and filled.columns == [*table.columns, "section", "outer_filled", "inner_filled"]
    assert forward_fill(table.limit(0), "o", "n", "block", ranges=ranges).count() == 0
