import random

from pyspark.sql import functions as F

from corpusloom.plans.scan import neighbours, ordered_parts, prefix_scan


def rows(seed=1, n=3000):
    rng = random.Random(seed)
    # one key holds a third of the rows
    return [(rng.choice(["hot", "hot", *"abcd"]), i, rng.randint(0, 9), rng.choice([None, i])) for i in rng.sample(range(10 * n), n)]


def test_scan_in_ranges_equals_plain_loop(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o int, v int, m int")
    out = prefix_scan(df, "k", "o", row_number="rn", sums={"s": "v"}, maxes={"mx": "m"}, buckets=16, sample_rows=500)
    assert "_range" not in out.columns
    got = {(r.k, r.o): (r.rn, r.s, r.mx) for r in out.collect()}
    state = {}
    for k, o, v, m in sorted(data):
        rn, s, mx = state.get(k, (0, 0, None))
        mx = m if mx is None else mx if m is None else max(mx, m)
        state[k] = (rn + 1, s + v, mx)
        assert got[(k, o)] == state[k]


def test_scan_spreads_the_hot_key(spark):
    df = spark.createDataFrame(rows(), "k string, o int, v int, m int")
    out = prefix_scan(df, "k", "o", row_number="rn", buckets=16, sample_rows=500)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan


def test_neighbours(spark):
    df = spark.createDataFrame(rows(2, 800), "k string, o int, v int, m int")
    out = neighbours(df, "k", "o", {"nxt": "o"}, 1, buckets=8, sample_rows=100)
    got = {(r.k, r.o): r.nxt for r in out.collect()}
    by_key = {}
    for k, o, *_ in sorted(rows(2, 800)):
        by_key.setdefault(k, []).append(o)
    for k, os_ in by_key.items():
        for a, b in zip(os_, [*os_[1:], None]):
            assert got[(k, a)] == b


def test_ordered_parts_keeps_everything(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("x").alias("k"), "id", F.col("id").cast("string").alias("t"))
    out = ordered_parts(df, "k", "id", "t", "items", part_rows=64).collect()
    assert max(len(r["items"]) for r in out) == 64
    hot = [x for r in sorted((r for r in out if r.k == "hot"), key=lambda r: r.part_no) for x in r["items"]]
    assert hot == [str(i) for i in range(900)]
