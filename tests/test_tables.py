from pyspark.sql import functions as F

from corpuslane.operators.tables import asof_join, profile


def test_asof_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, *range(0, 400_000, 7_000)])) for i in range(120)]
    left += [left[0]]  # a repeated row
    right = [(rng.choice(["a", "hot", None]), rng.choice([None, *range(0, 400_000, 9_000)]), rng.choice([None, 1, 2, 3]), rng.choice(["x", "y"])) for _ in range(150)]
    stamp = F.timestamp_seconds("s").alias("ts")
    lt = spark.createDataFrame([(i, k, s, -1) for i, k, s in left], "i int, k string, s bigint, v int").select("i", "k", stamp, "v")
    rt = spark.createDataFrame(right, "k string, s bigint, v int, w string").select("k", stamp, "v", "w")

    def key(r):
        return r[1], (r[2] is not None, r[2] or 0), r[3]

    want = []
    for i, k, s in left:
        fit = [r for r in right if k is not None and s is not None and r[0] == k and r[1] is not None and r[1] <= s]
        best = max(fit, key=key) if fit else None
        want.append((i, *((best[2], best[3]) if best else (None, None))))
    for bucket in ("day", "hour", "year"):
        got = asof_join(lt, rt, "k", "ts", ["v", "w"], bucket)
        assert got.columns == ["i", "k", "ts", "v", "w"]
        assert sorted(map(str, ((r["i"], r["v"], r["w"]) for r in got.collect()))) == sorted(map(str, want))
    assert asof_join(lt.limit(0), rt, "k", "ts", ["v"]).count() == 0
    assert {r["w"] for r in asof_join(lt, rt.limit(0), "k", "ts", ["w"]).collect()} == {None}


def test_profile(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("v"))
    r = {x["g"]: x for x in profile(df, "g", "v").collect()}
    assert r[0]["n"] == 1000 and abs(r[0]["distinct_values"] - 800) < 60 and abs(r[1]["quantiles"][0] - 1000) < 40
    assert profile(df.limit(0), "g", "v").count() == 0
