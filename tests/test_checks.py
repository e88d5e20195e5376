"""Checks, correlations, relationships and orderings on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from tablescout.operators import correlate as c
from tablescout.operators import relate as r
from tablescout.operators import validate as v
from tablescout.operators.associate import associations, column_entropy
from tablescout.operators.drift import ks_statistic
from tablescout.functions.local import work_folder
from tablescout.operators.ordering import cumulative, range_edges
from tablescout.operators.profile import column_stats, table_profile
from tablescout.operators.validate import referential_integrity


def stats(df):
    return column_stats({"t": df})


def test_completeness_grades_by_missing_share(spark):
    rows = [(None, None, " \t ")] * 3 + [(1, None, "x")] * 3 + [(1, 2, "x")] * 4
    found = {
        x["column_name"]: x
        for x in v.completeness(stats(spark.createDataFrame(rows, "a int, b int, c string"))).collect()
    }
    assert {k: x["severity"] for k, x in found.items()} == {"a": "medium", "b": "high", "c": "low"}
    assert "30.0% empty" in found["c"]["message"]


def test_duplicates_are_graded(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    row = v.duplicate_rows(table_profile({"t": df})).first()
    assert (row["severity"], row["n_bad"], row["column_name"]) == ("high", 1, None)
    assert "33.3%" in row["message"]


def test_key_uniqueness_counts_missing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (3, 3)], "a int, b int")
    rows = v.key_uniqueness({"t": df}, {"t": ["a", "b", "absent"]}).collect()
    assert [(x["column_name"], x["n_bad"], x["severity"]) for x in rows] == [("a", 1, "high")]


def test_referential_integrity(spark):
    source = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    target = spark.createDataFrame([(1,), (2,)], "k bigint")
    row = v.referential_integrity(source, "k", target, "k", "s", "t").first()
    assert (row["n_bad"], row["pct_bad"], row["severity"]) == (1, 0.5, "high")
    whole = v.referential_integrity(target, "k", target, "k", "t", "t")
    assert whole.count() == 0


def test_outliers_need_a_positive_iqr(spark):
    flat = spark.createDataFrame([(1.0,)] * 20 + [(99.0,)], "a double")
    assert v.iqr_outliers({"t": flat}).count() == 0
    spread = spark.createDataFrame([(float(x),) for x in range(20)] + [(999.0,)], "a double")
    row = v.iqr_outliers({"t": spread}).first()
    assert (row["n_bad"], row["severity"]) == (1, "low")
    assert v.outlier_rows(spread, "a").count() == 1


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        (["1", "2.5", "-3e4", ".5", " 7 ", "x", "y", "z"], 5),
        (["1d", "1_0", "nan", "inf", "0x1", "", "1 2"], 0),
    ],
)
def test_number_like(spark, values, expected):
    df = spark.createDataFrame([(x,) for x in values], "a string")
    assert stats(df).first()["number_like_count"] == expected


def test_date_like_needs_more_than_100_values(spark):
    dates = [(f"2024-01-{d % 28 + 1:02d}",) for d in range(101)]
    assert v.date_like_strings(stats(spark.createDataFrame(dates[:100], "a string"))).count() == 0
    assert v.date_like_strings(stats(spark.createDataFrame(dates, "a string"))).count() == 1
    words = spark.createDataFrame([("5-LOW",)] * 101, "a string")
    assert v.date_like_strings(stats(words)).count() == 1
    assert v.date_like_strings(stats(words), strict=True).count() == 0


def test_summary_counts_info_as_low_and_panel_hides_it(spark):
    mails = spark.createDataFrame([("a@b.c",)] * 5 + [(None,)] * 2, "a string")
    report = v.validation_report({"t": mails})
    summary = {x["severity"]: x["checks"] for x in v.validation_summary(report).collect()}
    # missing values 28.6 %: medium; repeated rows: high; the mail pattern: info.
    assert summary == {"medium": 1, "high": 1, "low": 1}
    counts, first = v.validation_panel(report)
    assert {x["severity"] for x in counts.collect()} == {"medium", "high"}
    assert first.count() == 3


def test_pearson_guards(spark):
    rows = [(1.0, 7.0, 2.0), (2.0, 7.0, None), (3.0, 7.0, 6.0), (4.0, 7.0, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(x["col_a"], x["col_b"]): (x["r"], x["n"]) for x in c.pearson({"t": df}).collect()}
    assert got[("a", "b")] == (0.0, 4)
    assert got[("a", "c")] == (pytest.approx(1.0), 2)
    assert c.strong_pairs(c.pearson({"t": df})).count() == 1
    wide = {x["col_a"]: x for x in c.heatmap(c.pearson({"t": df}), ["a", "b", "c"]).collect()}
    assert (wide["a"]["a"], wide["b"]["a"]) == (1.0, 0.0)


def test_spearman_is_invariant_under_monotone_change(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(200)]
    base = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    bent = spark.createDataFrame([(float(a**3), 2.0**b) for a, b in rows], "a double, b double")
    first, second = (c.spearman({"t": x}).first()["r"] for x in (base, bent))
    assert first == pytest.approx(second, abs=1e-12)


def test_spearman_reranks_complete_pairs(spark):
    rows = [(1, 10, 5), (2, None, 4), (3, 30, 3), (4, 20, None), (5, 50, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = {(x["col_a"], x["col_b"]): (round(x["r"], 9), x["n"]) for x in c.spearman({"t": df}).collect()}
    assert got[("a", "b")] == (0.8, 4)
    assert got[("a", "c")] == (-1.0, 4)


def test_cumulative_over_ranges_equals_one_range(spark):
    rng = random.Random(11)
    values = {round(rng.expovariate(0.01), 2): rng.randint(1, 9) for _ in range(3000)}
    df = spark.createDataFrame(list(values.items()), "v double, n bigint").repartition(4)
    assert len(range_edges(df, "v", 100)) > 20
    running, expected = 0, {}
    for value in sorted(values):
        running += values[value]
        expected[value] = running
    for per_range in (100, 10**6):
        got = {x["v"]: x["after"] for x in cumulative(df, "v", "n", rows_per_range=per_range).collect()}
        assert got == expected


def tables(spark):
    return {
        "a": spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.5)], "a_id int, s string, d double"),
        "b": spark.createDataFrame([(1.0, "x"), (3.0, "z"), (2.0, None)], "k double, t string"),
    }


def test_relationships_compare_numbers_as_numbers(spark):
    found = {
        (x["source_column"], x["target_column"]): x for x in r.relationships(tables(spark)).collect()
    }
    assert found[("a_id", "k")]["match_rate"] == 1.0
    assert found[("a_id", "k")]["type"] == "foreign_key"
    assert found[("d", "k")]["match_rate"] == 0.5
    assert found[("s", "t")]["confidence"] == "low"
    assert all(0 <= x["match_rate"] <= 1 for x in found.values())


def test_key_like_source_is_kept_without_overlap(spark):
    pair = {
        "a": spark.createDataFrame([(1,)], "user_id int"),
        "b": spark.createDataFrame([(5,)], "k int"),
        "c": spark.createDataFrame([], "k int"),
    }
    got = {(x["target_table"], x["confidence"], x["match_rate"]) for x in r.relationships(pair).collect()}
    assert got == {("b", "very_low", 0.0), ("c", "low", 0.0)}


def test_more_columns_than_one_bitmap_word(spark):
    wide = spark.createDataFrame([tuple(range(70))], ", ".join(f"c{n} int" for n in range(70)))
    one = spark.createDataFrame([(69,), (3,)], "k int")
    got = {x["source_column"] for x in r.relationships({"a": wide, "b": one}).collect()}
    assert got == {"c69", "c3"}


def test_both_directions(spark):
    one_way = r.relationships(tables(spark)).count()
    assert r.relationships(tables(spark), both_directions=True).count() > one_way


def test_join_coverage_matches_the_join(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    row = r.join_coverage(left, "k", right, "k").first()
    assert tuple(row) == (5, 3, 2, 7)
    assert left.join(right, "k").count() == row["joined_rows"]


def test_priority_filters(spark):
    found = r.relationships(tables(spark))
    keys = spark.createDataFrame([("a", "a_id")], "table_name string, column_name string")
    assert {x["source_column"] for x in r.touching(found, keys).collect()} == {"a_id"}
    assert r.touching_names(found, ["b.k"]).where("target_column <> 'k'").count() == 0
    assert [x["id"] for x in r.graph_nodes(found).orderBy("id").collect()] == ["a", "b"]
    rows = spark.createDataFrame([("b", 3)], "table_name string, row_count bigint")
    assert r.rank_by_target_uniqueness(found, rows).first()["target_uniqueness"] == 1.0


def test_associations_of_equal_and_independent_columns(spark):
    rows = [(x, x, y) for x in "ab" for y in "pq"] * 10
    got = {
        (z["col_a"], z["col_b"]): z
        for z in associations(spark.createDataFrame(rows, "a string, b string, c string")).collect()
    }
    assert got[("a", "b")]["cramers_v"] == pytest.approx(1.0)
    assert got[("a", "b")]["chi_square"] == pytest.approx(40.0)
    assert got[("a", "b")]["mutual_information"] == pytest.approx(0.693147, abs=1e-6)
    assert got[("a", "c")]["cramers_v"] == pytest.approx(0.0, abs=1e-9)


def test_association_of_a_constant_column(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "a string, b string")
    row = associations(df).first()
    assert (row["cramers_v"], row["dof"]) == (0.0, 0)


def test_entropy_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([("x",)] * 4, "a string")
    assert column_entropy({"t": df}).first()["entropy"] == 0.0


def test_ks_of_disjoint_and_equal_samples(spark):
    low = spark.range(10).select(F.col("id").cast("double").alias("v"))
    high = low.select((F.col("v") + 100).alias("v"))
    assert ks_statistic(low, "v", high, "v").first()["ks"] == 1.0
    assert ks_statistic(low, "v", low, "v").first()["ks"] == 0.0


def test_hot_values_change_nothing(spark):
    """One value and one key hold more than a third of the rows."""
    rng = random.Random(5)
    rows = [
        (7 if n % 5 < 2 else rng.randint(0, 900), 0.5 if n % 2 else rng.random(), n % 11)
        for n in range(6000)
    ]
    hot = spark.createDataFrame(rows, "k int, v double, w int").repartition(6)
    keys = spark.createDataFrame([(k,) for k in range(0, 1000, 2)], "k bigint")

    def ranks(values):
        place, total = {}, 0
        for value in sorted(set(values)):
            count = values.count(value)
            place[value] = total + (count + 1) / 2
            total += count
        return [place[value] for value in values]

    def correlation(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        top = sum((a - mx) * (b - my) for a, b in zip(x, y))
        return top / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5

    k, v, _ = (list(column) for column in zip(*rows))
    got = {(x["col_a"], x["col_b"]): x["r"] for x in c.spearman({"t": hot}).collect()}
    assert got[("k", "v")] == pytest.approx(correlation(ranks(k), ranks(v)), abs=1e-9)
    cover = r.join_coverage(hot, "k", keys, "k").first()
    assert cover["matched_rows"] == sum(1 for key in k if key % 2 == 0)
    overlap = r.value_overlap(hot, "k", keys, "k").first()
    assert overlap["overlap_count"] == len({key for key in k if key % 2 == 0})
    missing = len({key for key in k if key % 2})
    assert referential_integrity(hot, "k", keys, "k", "hot", "keys").first()["n_bad"] == missing


def test_spearman_with_hot_values_and_many_ranges(spark, monkeypatch):
    """Hot values are counted, the others dealt by ranges; the ranks must not change."""
    import numpy as np

    rng = np.random.default_rng(9)
    a = np.where(rng.random(4000) < 0.4, 7.0, rng.integers(0, 300, 4000))
    b = np.where(rng.random(4000) < 0.3, -0.0, a + rng.normal(size=4000) * 50)
    b = np.where(rng.random(4000) < 0.1, 0.0, b)
    rows = [(float(x), float(y), None if k % 9 == 0 else int(x)) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c int").repartition(6)
    monkeypatch.setattr(c, "ROWS_PER_TASK", 100)
    got = {(x["col_a"], x["col_b"]): (x["r"], x["n"]) for x in c.spearman({"t": df}).collect()}
    frame = df.toPandas().astype(float)
    for (x, y), (r, n) in got.items():
        both = frame[[x, y]].dropna()
        assert n == len(both)
        assert abs(r - both[x].rank().corr(both[y].rank())) < 1e-9
    hot = c._hot_values(c._doubles(df), ["a", "b", "c"], 4000)
    assert 7.0 in hot[0] and 0.0 in hot[1]


def test_spearman_moves_rows_twice(spark):
    import random

    df = spark.createDataFrame([(random.random(), random.random(), k) for k in range(500)], "a double, b double, c int")
    ranked = c.ranks(c._doubles(df), [(x, "true") for x in "abc"], [[], [], []], work_folder(spark))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # What is stored was dealt once by ranges; of what is read, rows move once more, by row.
    assert plan.count("Exchange hashpartitioning(_row") == 1
    rows = ranked.collect()
    assert len(rows) == 500 and sorted(r["r2"] for r in rows) == list(range(1, 501))
