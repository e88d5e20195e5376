"""Sources: a folder, other formats, the catalog; shared storage."""

import pytest
from pyspark.sql import functions as F

from tablescout.functions.local import work_folder
from tablescout.sources import folder_tables, load_catalog, load_folder, read_csv, read_sources


def test_folder_lists_files_and_directories(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(f"{tmp_path}/many.parquet")
    df.toPandas().to_parquet(f"{tmp_path}/one.parquet")
    df.write.csv(f"{tmp_path}/text.csv", header=True)
    assert folder_tables(spark, str(tmp_path)) == ["many", "one"]
    found = load_folder(spark, str(tmp_path))
    assert {t: d.count() for t, d in found.items()} == {"many": 5, "one": 5}
    texts = load_folder(spark, str(tmp_path), None, ".csv", "csv", header="true")
    assert texts["text"].columns == ["id"] and texts["text"].count() == 5
    assert list(load_folder(spark, str(tmp_path), ["one"])) == ["one"]


def test_catalog(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("scout_view")
    spark.sql(f"create database scout_db location '{tmp_path}/db'")
    spark.sql("create table scout_db.kept using parquet as select 1 as id")
    assert list(load_catalog(spark, "scout_db")) == ["kept"]
    assert list(load_catalog(spark, "scout_db", ["kept", "absent"])) == ["kept"]
    spark.sql("drop database scout_db cascade")


class Settings:
    def __init__(self, values):
        self.values = values

    @property
    def conf(self):
        return self

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        work_folder(Settings({"spark.master": "spark://host:7077"}))
    assert work_folder(Settings({"spark.checkpoint.dir": "s3a://b/c"})).startswith("s3a://b/c/")
    assert work_folder(Settings({"spark.master": "local[4]"}))


def test_malformed_csv_lines_are_kept(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2,y\nthree,z\n4\n")
    read = read_csv(spark, str(path), "a int, b string", corrupt="bad line")
    rows = sorted(read.collect(), key=lambda r: str(r["bad line"]))
    assert [r["bad line"] for r in rows if r["bad line"]] == ["4", "three,z"]
    inferred = read_csv(spark, str(path), corrupt="bad")
    assert inferred.columns == ["a", "b", "bad"] and inferred.count() == 4


def test_one_table_of_several_sources(spark, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    fields = ["id as k", "cast(id % 7 as string) as t", "if(id % 5 = 0, null, id * 0.5D) as x"]
    for low in (0, 1000):
        spark.range(low, low + 1000).selectExpr(*fields).coalesce(1).write.mode("append").parquet(
            f"{one}/t.parquet"
        )
    (tmp_path / "two").mkdir()
    own = spark.range(50).selectExpr("id as k", "'own' as source_name")
    own.toPandas().to_parquet(f"{two}/t.parquet", index=False)
    rows = read_sources(spark, {"one": one, "two": two, "none": f"{tmp_path}/none"}, "t")
    assert rows.columns == ["k", "t", "x", "source_name"]
    counts = {r["source_name"]: r["count"] for r in rows.groupBy("source_name").count().collect()}
    assert counts == {"one": 2000, "two": 50}
    # A column that a file lacks is null in its rows.
    assert rows.where("source_name = 'two' and t is null and x is null").count() == 50
    assert read_sources(spark, {"two": two}, "t").columns == ["k", "source_name"]
    # Small ranges of bytes give more partitions, not more rows.
    split = read_sources(spark, {"one": one, "two": two}, "t", split_bytes=500)
    assert split.rdd.getNumPartitions() > rows.rdd.getNumPartitions() and split.count() == 2050
    with pytest.raises(Exception, match="no source holds"):
        read_sources(spark, {"none": f"{tmp_path}/none"}, "t").schema


def test_filters_reach_the_partitions_of_sources(spark, tmp_path):
    for name in ("one", "two"):
        spark.range(3000).selectExpr("id as k", "cast(id % 7 as string) as t", "id % 2 = 0 as b").withColumn(
            "x", F.when(F.col("k") % 3 == 0, float("nan")).otherwise(F.col("k").cast("double"))
        ).repartition(3).write.parquet(f"{tmp_path}/{name}/t.parquet")
    rows = read_sources(spark, {n: f"{tmp_path}/{n}" for n in ("one", "two")}, "t")
    only = rows.where("source_name = 'two'")
    assert (rows.rdd.getNumPartitions(), only.rdd.getNumPartitions()) == (6, 3)
    assert rows.where("source_name in ('none')").count() == 0
    plain = spark.read.parquet(f"{tmp_path}/two/t.parquet")
    for rule in (
        "k > 2990", "k >= 10 and k < 20", "k <= 5", "t = '3'", "t > '5'", "k in (1, 2, null)", "b",
        "x > 100", "x = 'NaN'", "t is null", "t like '3%'", "k = 7 or t = '1'", "not (k > 5)",
    ):
        assert only.where(rule).count() == plain.where(rule).count(), rule
    plan = only.where("k > 2990 and x > 1")._jdf.queryExecution().executedPlan().toString()
    # Numbers that may be NaN are compared by Spark; integers and the source's name are handed down.
    left = next(line for line in plan.splitlines() if "Filter" in line)
    assert "x#" in left and "k#" not in left and "source_name#" not in left
