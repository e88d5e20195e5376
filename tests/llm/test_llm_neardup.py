"""Near-duplicates of vectors and texts against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablescout.llm import embedding_neardup, simhash
from tablescout.llm.frames import components, work_folder


def closure(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(500, 560)]
    pairs += [(3, 3), (None, 4), (2, 1), (1, 2), (-9, 2), (559, 9)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r[0]: r[1] for r in components(df, work_folder(spark, "t")).collect()}
    assert {k: v for k, v in got.items() if 100 <= k <= 160 and k != v} == {
        k: 100 for k in range(101, 161)
    }
    assert got[559] == got[9] == 7 and got[2] == got[1] == -9 and 3 not in got
    assert components(df.limit(0), work_folder(spark, "t")).count() == 0


def slow_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t\n", "one", "One", "one two", "a b c", "A B c d", "É a b c d É a b", "x " * 5000]


def test_fingerprints(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = simhash.fingerprints(df).collect()
    assert {r["doc_id"]: r["_fp" if "_fp" in r else "fp"] & (2**64 - 1) for r in rows} == {
        i: slow_print(t) for i, t in enumerate(TEXTS)
    }


@pytest.mark.parametrize("hot", [20_000, 40, 5])
def test_trie_join_finds_all_links(spark, hot):
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 2**63, 300, dtype=np.uint64)
    near = keys[:200].copy()
    for _ in range(3):
        near ^= np.uint64(1) << draw.integers(0, 64, 200, dtype=np.uint64)
    far = keys[:100] ^ np.uint64(0xF)
    cluster = np.uint64(77) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))
    keys = np.unique(np.concatenate([keys, near, far, cluster, [np.uint64(0)]]))
    close = np.bitwise_count(keys[:, None] ^ keys[None]) <= 3
    pairs = list(zip(*np.nonzero(np.triu(close, 1)), strict=True))
    expected = closure(len(keys), pairs)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    place = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    found = [(place[r["a"]], place[r["b"]]) for r in simhash.links(df, 3, hot).collect()]
    assert all(close[a, b] or expected[a] == expected[b] for a, b in found)
    assert closure(len(keys), found) == expected


def trie_links(spark, keys, hot):
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    place = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    return [(place[r["a"]], place[r["b"]]) for r in simhash.links(df, 3, hot).collect()]


@pytest.mark.parametrize("hot", [300, 64])
def test_a_node_that_is_hot_at_any_depth_is_split(spark, hot):
    """Two nodes of 24 bits, one bit apart, hold nearly all fingerprints; few links among them."""
    draw = np.random.default_rng(5)
    low = draw.integers(0, 2**40, 1400, dtype=np.uint64)
    for at in range(0, 900, 3):  # chains of three within reach of one another
        for step in (1, 2):
            flips = draw.choice(40, 2, replace=False).astype(np.uint64)
            low[at + step] = low[at + step - 1] ^ np.bitwise_or.reduce(np.uint64(1) << flips)
    head = np.uint64(0xABCDE5) << np.uint64(40)
    apart = np.where(np.arange(1400) % 3 == 1, np.uint64(1) << np.uint64(45), np.uint64(0))
    keys = np.unique(np.concatenate([head ^ apart ^ low, draw.integers(0, 2**63, 50, dtype=np.uint64)]))
    close = np.bitwise_count(keys[:, None] ^ keys[None]) <= 3
    expected = closure(len(keys), zip(*np.nonzero(np.triu(close, 1)), strict=True))
    assert len(set(expected)) < len(keys) - 500
    assert closure(len(keys), trie_links(spark, keys, hot)) == expected
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    dealt = simhash._deal(df, hot, 3).groupBy(*simhash.GROUP).count()
    cells = dealt.where("cell > 0").count()
    assert cells > 10 and dealt.agg({"count": "max"}).first()[0] <= 3 * hot
    assert dealt.where(f"cell = 0 and mode > 0 and count > {hot}").count() == 0


def test_near_duplicate_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " x", base, base.upper(), "other " * 9, None, "", "z", base.replace("w7 ", "")]
    rows = [(10 + i, t, "c") for i, t in enumerate(texts)] + [(10, base, "c"), (None, base, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Component_ID string")
    got = simhash.near_duplicates(df, work_folder(spark, "t")).collect()
    assert len(got) == len(rows)
    prints = [slow_print(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = closure(len(rows), pairs)
    least = {}
    for (doc, _, _), k in zip(rows, label, strict=True):
        if doc is not None:
            least[k] = min(doc, least.get(k, doc))
    want = sorted((r[0] or 0, f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, label, strict=True))
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(df.limit(0), work_folder(spark, "t")).count() == 0


def unit(draw, n, d=32):
    x = draw.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("hot", [4096, 16])
def test_vectors(spark, hot):
    draw = np.random.default_rng(4)
    base = unit(draw, 300)
    close = base[:120] + 0.02 * draw.normal(size=(120, 32))
    dense = base[0] + 0.01 * draw.normal(size=(90, 32))
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, close, dense])]
    vectors += [vectors[3], vectors[3], None, [0.0] * 32, [None, *vectors[3][1:]]]
    vectors += [[float("nan"), *vectors[3][1:]], [float("inf"), *vectors[3][1:]], [1.0, 2.0], []]
    vectors += [[3 * x for x in vectors[5]]]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")
    got = {r["vec_id"]: r for r in embedding_neardup.near_duplicates(df, work_folder(spark, "t"), hot_list=hot).collect()}
    assert len(got) == len(rows)
    good = [i for i, v in enumerate(vectors) if v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[i] for i in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T) >= 0.95
    np.fill_diagonal(linked, False)
    true, found = int(linked.sum()), sum(got[i]["n_links"] for i in good)
    assert 0.9 * true <= found <= true
    assert all(got[i]["n_links"] <= linked[k].sum() for k, i in enumerate(good))
    label = closure(len(good), zip(*np.nonzero(linked), strict=True))
    assert np.mean([got[i]["component_id"] == good[label[k]] for k, i in enumerate(good)]) > 0.9
    for i in set(got) - set(good):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    a, b = got[3], got[len(base) + len(close) + len(dense)]
    assert a["n_links"] == b["n_links"] >= 2 and a["component_id"] == b["component_id"]


@pytest.mark.parametrize("hot", [4096, 8])
def test_vectors_of_every_length_are_linked(spark, hot):
    draw = np.random.default_rng(8)
    vectors = [v.tolist() for v in unit(draw, 60, 16)]
    vectors += [[1.0, 2.0, 3.0], [2.0, 4.0, 6.001], [3.0, 1.0, -1.0]]  # a rare length
    vectors += [[1.0], [5.0], [-1.0], vectors[0], [1.0, 2.0, 3.0, 0.0]]
    vectors += [(np.array(vectors[7]) + 0.01).tolist(), vectors[60]]
    for d in (5, 6):  # as frequent as each other
        vectors += np.repeat(unit(draw, 30, d), 2, axis=0).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = embedding_neardup.near_duplicates(df, work_folder(spark, "t"), hot_list=hot).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}

    def close(a, b):
        a, b = np.array(a), np.array(b)
        return len(a) == len(b) and a @ b >= 0.95 * np.linalg.norm(a) * np.linalg.norm(b)

    pairs = [(i, j) for i in range(len(vectors)) for j in range(i) if close(vectors[i], vectors[j])]
    label = closure(len(vectors), pairs)
    n = np.bincount(np.array(pairs).ravel(), minlength=len(vectors))
    assert got == {i: (n[i], label[i]) for i in range(len(vectors))}
    assert got[60] == (2, 60) and got[63] == (1, 63) and got[67] == (0, 67)


def test_vector_tables_without_links(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(None, [1.0, 0.0]), (2, [0.0, 1.0])], [(5, [1.0])]):
        df = spark.createDataFrame(rows, kind)
        got = embedding_neardup.near_duplicates(df, work_folder(spark, "t"))
        assert got.count() == len(rows)
        assert got.where(F.col("n_links") > 0).count() == 0
