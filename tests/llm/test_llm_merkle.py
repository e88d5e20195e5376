"""The Merkle manifest against a plain one."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import merkle
from tablescout.llm.frames import work_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, tree int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    out = ""
    for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text):
        s = None if v is None else str(v)
        out += "-" if s is None else f"{len(s.encode())}:{s}"
    return h(out)


def ways(nodes):
    """Root of a list of nodes, and (left, right) siblings on the way of each."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            f = i - i % 3
            paths[k].append(("".join(nodes[f:i]), "".join(nodes[i + 1 : f + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    first = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(groups[s], key=lambda r: (first(r["doc_id"]), leaf(r, r["text"])))
        trees[s] = (mine, *ways([leaf(r, r["text"]) for r in mine]))
    root, upper = ways([trees[s][1] for s in names])
    out = []
    for s, over in zip(names, upper, strict=True):
        mine, subroot, paths = trees[s]
        for r, path in zip(mine, paths, strict=True):
            path = path + over
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for a, b in path:
                folded = h(a, folded, b)
            proof = h(*[a + b for a, b in path])
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, proof, folded, folded == root))
    return out


def run(spark, df, levels):
    d = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(
        df, work_folder(spark, "merkle"), d, F.translate("text", "\n", ""), block_levels=levels
    )


def same(got, expected):
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_against_a_plain_tree(spark, levels):
    rows = [
        {"doc_id": i, "text": f"é\nline {i}" if i % 3 else f"one {i}", "lang": "en",
         "source": ["a", "A", "é", None, "", "one"][min(5, (i * i) % 11)], "n_chars": i}
        for i in range(130)
    ]
    rows += [
        {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
        {"doc_id": 1000, "text": "", "lang": "de", "source": "alone", "n_chars": 0},
        {"doc_id": 7, "text": "same", "lang": "en", "source": "a", "n_chars": 4},
        {"doc_id": 7, "text": "same", "lang": "en", "source": "a", "n_chars": 4},
        {"doc_id": 7, "text": "x\n" * 50_000, "lang": "en", "source": "a", "n_chars": 4},
    ]
    given = [{**r, "root": "clash", "tree": 1} for r in rows]
    df = spark.createDataFrame(given, SCHEMA).repartition(5)
    got = run(spark, df, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert same(got.collect(), brute(rows))


def test_one_leaf_and_no_leaf(spark):
    rows = [{"doc_id": 3, "text": "x\ny", "lang": "en", "source": "s", "n_chars": 3}]
    full = [{**r, "root": "", "tree": 0} for r in rows]
    got = run(spark, spark.createDataFrame(full, SCHEMA), 7).collect()
    assert same(got, brute(rows))
    assert got[0]["root"] == got[0]["leaf"] and got[0]["proof_sha256"] == h()
    assert run(spark, spark.createDataFrame([], SCHEMA), 7).collect() == []


def test_layout_is_a_permutation_with_the_upper_half_first():
    for levels in range(1, 8):
        places = [merkle.address(levels, d, np.arange(3**d)) for d in range(levels)]
        assert sorted(np.concatenate(places)) == list(range(merkle.nodes_of(levels)))
        upper = np.concatenate(places[: max(1, levels // 2)])
        assert upper.max() == len(upper) - 1
