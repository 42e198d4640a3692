"""Running totals over any ids, whatever the number of levels."""

import collections
import random

import pytest

from tessera.operators import report


@pytest.mark.parametrize("width", [10, 1000])
def test_run_stats(spark, width):
    rng = random.Random(1)
    ids = sorted({rng.randrange(-50, 70_000) for _ in range(300)} | {0, 9, 10, 99, 100, 999, 1000})
    rows = [(i, rng.choice(["accepted", "review"])) for i in ids for _ in range(rng.randint(1, 3))]
    objects, accepted = collections.Counter(i for i, _ in rows), collections.Counter(i for i, s in rows if s == "accepted")
    want, o, a = {}, 0, 0
    for k, i in enumerate(ids):
        o, a = o + objects[i], a + accepted[i]
        want[i] = (k + 1, o, a)
    got = report.run_stats(spark.createDataFrame(rows, "image_id long, state string"), width).collect()
    assert {r.image_id: (r.images, r.objects, r.accepted) for r in got} == want
    assert report.run_stats(spark.createDataFrame([], "image_id long, state string")).count() == 0
