"""The null model against a plain shuffle by digest."""

import hashlib
import math
import random

from placeflow.operators import delimitation


def test_units_fill_places_in_the_order_of_digests(spark):
    rng = random.Random(5)
    units = [f"u{i}" for i in range(300)]
    area = {u: f"a{min(rng.randint(0, 9), rng.randint(0, 9))}" for u in units if rng.random() < 0.9}
    flows = [(rng.choice(units), rng.choice(units), float(rng.randint(1, 9))) for _ in range(3000)]
    od = spark.createDataFrame(flows, "origin string, dest string, flow double")
    assigned = spark.createDataFrame([(u, area.get(u)) for u in units], "unit string, fua string")
    got = {r["repetition"]: r["self_containment"] for r in delimitation.null_model(od, assigned, 5, "s").collect()}
    sizes = sorted(((list(area.values()).count(a), a) for a in set(area.values())), key=lambda x: (-x[0], x[1]))
    places = [a for n, a in sizes for _ in range(n)]
    for repetition in range(1, 6):
        order = sorted(area, key=lambda u: (hashlib.md5(f"s|{repetition}|{u}".encode()).hexdigest(), u))
        label = dict(zip(order, places, strict=True))
        leaving = [(o, d, f) for o, d, f in flows if o in label]
        want = sum(f for o, d, f in leaving if label.get(d) == label[o]) / sum(f for _, _, f in leaving)
        assert math.isclose(got[repetition], want, rel_tol=1e-12)
    empty = delimitation.null_model(od, assigned.where("false"), 5)
    assert empty.count() == 0
