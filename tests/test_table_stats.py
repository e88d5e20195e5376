"""Files of a table are counted whether they hold rows or not."""

from tablescout.sources.tables import table_stats


def test_files_without_rows_count(spark, tmp_path):
    folder = f"{tmp_path}/a b %20[1]{{x}}"
    for name, rows in (("full", 3), ("empty", 0)):
        spark.range(rows).coalesce(1).write.parquet(f"{folder}/{name}")
    plain = {name: spark.read.parquet(folder.replace("[", "\\[").replace("{", "\\{") + f"/{name}") for name in ("full", "empty")}
    found = {r["table_name"]: r for r in table_stats(plain).collect()}
    assert (found["full"]["row_count"], found["full"]["files"]) == (3, 1)
    assert (found["empty"]["row_count"], found["empty"]["files"]) == (0, 1)
    assert found["empty"]["bytes"] > 0 and found["empty"]["last_altered"] is not None
