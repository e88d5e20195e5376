"""The pipeline stage by stage on the smallest tables, and the registered queries' contracts."""

import hashlib

import corpus_pipeline
import pytest

from __spark_entry__ import queries
from tablescout.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    docs = docs.unionByName(docs.where("doc_id < 20"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        new = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, new))
        docs = new
    return out


def test_stages(stages):
    assert [s[0] for s in stages] == ["language_id", "quality_classifier", "simhash", "pii", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert 0 < after.count() <= before.count()


def test_one_document_of_each_group_stays(stages):
    from test_llm_neardup import closure, slow_print

    _, before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    prints = [slow_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = closure(len(rows), pairs)
    kept = sorted(rows[i][0] for i in range(len(rows)) if label[i] == i)
    assert sorted(r["doc_id"] for r in after.collect()) == kept


def test_personal_data_is_gone(stages):
    _, before, after = stages[3]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert any("<EMAIL>" in r["text"] or "<CARD>" in r["text"] or "<IP>" in r["text"] for r in rows)
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        if "<" not in r["text"]:
            assert r["text"] == old[r["doc_id"]]
        assert "@mail" not in r["text"]


def test_pieces_fill_sequences(stages):
    _, before, after = stages[4]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    places = {}
    for r in after.collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for one in places.values():
        at = 0
        for offset, n in sorted(one):
            assert offset == at
            at += n
        assert at <= 1024


def test_empty_tables_and_nulls(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(None, None, None, None, None, None), (1, "", None, None, 0, "x"), (2, "ab", "en", None, 2, "y")]):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
            if name != "best_fit_packing":
                assert docs.columns[-1] == "score"
        assert docs.count() <= len(rows)


def test_round_trip_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in QUERIES["op3_byte_bpe"](spark, SF_DIR).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_registered():
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in queries()) == 1 for n in names)
    assert "pipeline" in queries()
