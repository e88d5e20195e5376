"""Inputs that the given tables do not contain: nested rows, infinities, zones, long texts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablescout.operators.correlate import correlation_t, pearson, strong_pairs
from tablescout.operators.frequency import distinct_counts
from tablescout.operators.profile import table_profile, top_values
from tablescout.operators.quantiles import column_quantiles
from tablescout.operators.relate import relationships, value_overlap
from tablescout.operators.sampling import combine, hashed_sample, random_sample
from tablescout.operators.shape import redact
from tablescout.operators.trends import categorical_trend, period_of

LONG = ["x" * 70 + str(i) for i in range(4)]


def duplicates(df):
    return table_profile({"t": df}).first()["duplicate_pct"]


def test_nested_rows_differ(spark):
    rows = [(1, [1, None], [2]), (1, [1], [None, 2]), (1, [1], [2]), (1, [1], [2])]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    assert duplicates(df) == 0.25
    rows = [([1, 2], [3]), ([1], [2, 3])]
    assert duplicates(spark.createDataFrame(rows, "a array<int>, b array<int>")) == 0
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},)], "m map<string,int>")
    assert duplicates(maps) == 0.5
    variants = spark.sql("""select parse_json(j) v from values ('{"a":1}'), ('{"a":2}') t(j)""")
    assert duplicates(variants) == 0


def test_infinite_values(spark):
    rows = [(float(i), float(i) if i else float("inf"), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in pearson({"t": df}).collect()}
    assert found["a", "b"] == 0 and abs(found["a", "c"] - 1) < 1e-9
    strong = strong_pairs(pearson({"t": df})).collect()
    assert [(r["col_a"], r["col_b"]) for r in strong] == [("a", "c")]
    t = {(r["col_a"], r["col_b"]): r["t"] for r in correlation_t(pearson({"t": df})).collect()}
    assert t["a", "c"] is None and len(t) == 3
    q = column_quantiles({"t": df}, {"p50": 0.5, "p100": 1.0}).where("column_name = 'b'").first()
    assert q["p100"] == float("inf") and q["p50"] == 10.5


def test_missed_ranks_are_looked_for_again(spark, monkeypatch):
    from tablescout.operators import quantiles

    real = quantiles._brackets
    asked = []

    def narrow(tables, wanted, rows, k, widen, *rest):
        asked.append(widen)
        found = real(tables, wanted, rows, k, widen, *rest)
        return {k: [(0.0, 1.0)] for k in found} if widen == 1.0 else found

    monkeypatch.setattr(quantiles, "_brackets", narrow)
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert column_quantiles({"t": df}, {"p50": 0.5}).first()["p50"] == 499.5
    assert asked == [1.0, 8.0]


@pytest.fixture
def berlin(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zone_free_times_ignore_the_session_zone(spark, berlin):
    df = spark.sql(
        "select timestamp_ntz'2024-03-31 02:30:00' t union all select timestamp_ntz'2024-03-31 03:30:00'"
    )
    hours = df.select(period_of(F.col("t"), "hour").cast("string").alias("h")).collect()
    assert sorted(r["h"] for r in hours) == ["2024-03-31 02:00:00", "2024-03-31 03:00:00"]
    assert distinct_counts({"t": df}).first()["distinct_count"] == 2


def test_long_texts_are_compared_and_shown_whole(spark):
    texts = spark.createDataFrame([(t,) for t in LONG * 3], "v string")
    digests = texts.select(F.md5("v").alias("v"))
    assert value_overlap(texts, "v", digests, "v").where("overlap_count > 0").count() == 0
    assert relationships({"a": texts, "b": digests}).count() == 0
    both = texts.unionByName(digests)
    assert distinct_counts({"t": both}).first()["distinct_count"] == 8
    assert {r["value"] for r in top_values({"t": texts}).collect()} == set(LONG)
    timed = texts.select("v", F.lit("2024-01-01").cast("timestamp_ntz").alias("t"))
    assert {r["value"] for r in categorical_trend(timed, "t", "v", "day").collect()} == set(LONG)


def test_decimal_fractions_are_kept_apart(spark):
    whole = spark.createDataFrame([(Decimal("123456789012345678.0"),)], "v decimal(20,1)")
    part = spark.createDataFrame([(Decimal("123456789012345678.5"),)], "v decimal(20,1)")
    found = value_overlap(whole, "v", part, "v")
    assert found.where("overlap_count > 0").count() == 0


def test_rows_without_key_are_sampled_like_others(spark):
    rows = [(i if i % 2 else None, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v int")
    drawn = hashed_sample(df, "k", 30)
    nulls = drawn.where("k is null").count()
    assert 200 < nulls < 400 and 200 < drawn.count() - nulls < 400
    capped = combine([df], "k", 100)
    assert 20 < capped.where("k is null").count() < 80
    assert random_sample(df, "k", 150).count() == 150


def test_the_last_task_of_a_sample_gets_few_rows(spark):
    from tablescout.operators import sampling

    df = spark.range(100_000)
    near = 10 + 10 * 10**0.5 + 20
    drawn = sampling.hashed_sample(df, "id", 100 * near / 100_000)
    assert drawn.count() < 3 * near
    assert random_sample(df, "id", 10).count() == 10


def test_samples_are_full_where_keys_repeat(spark):
    from tablescout.operators import sampling

    few = spark.range(100_000).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    assert sampling._first(few, "k", 50, 100_000).count() == 50
    assert random_sample(few, "k", 500).count() == 500
    assert random_sample(few, "k", 50).count() == 50
    assert sampling.corner_cases(few.select(F.col("k").cast("string"), "v"), few, "k", 50).count() == 50
    by_hash = few.select("k").distinct().orderBy(F.md5(F.col("k").cast("string"))).first()["k"]
    assert {r["k"] for r in sampling._first(few, "k", 50, 100_000).collect()} == {by_hash}
    # a third of the rows share the key of the greatest hash
    last = spark.range(3000).orderBy(F.desc(F.md5(F.col("id").cast("string")))).first()["id"]
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, last).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    assert sampling._first(hot, "k", 5000, 30_000).count() == 5000
    assert random_sample(hot, "k", 9000).count() == 9000


def test_dates_and_ids_are_no_phone_numbers(spark):
    texts = ["2024-01-15 order 12", "id 123456789", "call +1 (555) 010-0199", "(555) 010-0199"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(redact(F.col("t"))).collect()]
    assert got == ["2024-01-15 order 12", "id 123456789", "call ***", "***"]
