"""Windows cut into cells and values by rank, against plain folds."""

import random

from pyspark.sql import functions as F

from leafline.operators.ordered import Cells, at_rank


def test_windows_cut_into_cells(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), t, rng.choice([None, 1, 2, 3]), t / 10) for t in range(300)]
    table = spark.createDataFrame(rows, "k string, t int, v int, x double").repartition(5)
    cells = Cells(table, ["k"], ["t"], F.floor(F.col("t") / 17)).previous("v", "x").running("total", F.coalesce("v", F.lit(0))).carried("last", F.col("v"))
    got = {(r.k, r.t): (r.prev_v, r.prev_x, r.total, r["last"]) for r in cells.rows.collect()}
    assert len(got) == 300
    for key in ("a", "b", None):
        total, last, before = 0, None, (None, None)
        for k, t, v, x in rows:
            if k == key:
                total, last = total + (v or 0), v if v is not None else last
                assert got[k, t] == (*before, total, last)
                before = (v, x)
    assert Cells(table.where("false"), ["k"], ["t"], F.lit(0)).previous("v").rows.count() == 0


def test_values_by_rank(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, -5.5, 0.0, rng.uniform(-1000, 1000), rng.uniform(0, 3), 1e12])) for k in range(6) for _ in range(rng.randrange(1, 80))]
    table = spark.createDataFrame(rows, "k int, v double").repartition(4)
    for rank, at in ((lambda n: F.floor(n / 2) + 1, lambda n: n // 2), (lambda n: F.floor(0.9 * (n - 1)) + 1, lambda n: int(0.9 * (n - 1)))):
        want = {}
        for key in range(6):
            own = sorted(v for k, v in rows if k == key and v is not None)
            if own:
                want[key] = own[at(len(own))]
        assert {r.k: r.v for r in at_rank(table, ["k"], "v", rank).collect()} == want
