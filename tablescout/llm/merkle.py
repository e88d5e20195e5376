"""Merkle manifest of a dataset in van Emde Boas layout.

Rows are leaves of one tree of runs of three per source; the trees' roots are the leaves of
the tree above them. A tree is cut into aligned blocks of seven levels below their root. A block
is stored as one string of digests in van Emde Boas order: the upper half of its levels first,
then each subtree below it, both laid out in the same way. Digests are found by arithmetic on
(level, index) alone. Block roots are the leaves of the next blocks, so construction and
retrieval recurse over them; no task holds more than one block, however large a source is.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.llm.frames import keep

ARITY = 3
BLOCK_LEVELS = 7  # of runs in a block: 3**7 leaves, 8 levels of nodes, halved thrice
DIGEST = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def nodes_of(levels: int) -> int:
    """Nodes of a complete tree of so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` below the root in a tree of ``levels`` levels."""
    place = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = ARITY ** (depth - top)
        place += nodes_of(top) + index // below * nodes_of(levels - top)
        index, depth, levels = index % below, depth - top, levels - top
    return place


def run_levels(leaves: int) -> int:
    """Levels of runs until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


@lru_cache(16)
def _places(runs: int) -> tuple[np.ndarray, ...]:
    """Places by level of a block, from its leaves (level 0) up to its root."""
    return tuple(
        address(runs + 1, runs - k, np.arange(ARITY ** (runs - k))) for k in range(runs + 1)
    )


def build(leaves: list[str], runs: int) -> bytes:
    """The block over ``leaves`` (hexadecimal digests): every node in its place, zeros elsewhere."""
    store = np.zeros((nodes_of(runs + 1), DIGEST), np.uint8)
    level = leaves
    for k in range(runs + 1):
        raw = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        store[_places(runs)[k][: len(level)]] = raw
        level = [
            sha256("".join(level[i : i + ARITY]).encode()).hexdigest()
            for i in range(0, len(level), ARITY)
        ]
    return store.tobytes()


def siblings(store: bytes, runs: int, leaves: int, at: int) -> list[str]:
    """Left and right siblings, joined, of each level's run, by turns, for the leaf ``at``."""
    out = []
    for k in range(runs):
        count = -(-leaves // ARITY**k)
        mine = at // ARITY**k
        first = mine - mine % ARITY
        for a, b in ((first, mine), (mine + 1, min(first + ARITY, count))):
            places = _places(runs)[k][a:b].tolist()
            out.append("".join(store[p * DIGEST : (p + 1) * DIGEST].hex() for p in places))
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its way up give."""
    for i in range(0, len(path), 2):
        leaf = sha256((path[i] + leaf + path[i + 1]).encode()).hexdigest()
    return leaf


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: each field as its length in UTF-8 bytes, a colon and its text; `-` if null."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """``df`` with ``rank``, from 0 within each ``tree`` by ``order``.

    Rows are dealt by ranges of (tree, order), so a tree that holds most rows is many tasks;
    rows equal in all of these are interchangeable and dealt by a number of their own. Ranges
    are numbered by themselves and offset by the counts of earlier ranges: a table of one row
    per range and tree in it.
    """
    keys = ["tree", *order]
    dealt = df.withColumn("_salt", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys, "_salt")

    def number(batches):
        tree, seen = None, 0
        for batch in batches:
            names = batch.column("tree")
            codes = names.dictionary_encode()
            code = codes.indices.to_numpy()
            begins = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else []
            place = np.arange(len(code), dtype=np.int64)
            for b, e in zip(begins, [*begins[1:], len(code)], strict=True):
                now = codes.dictionary[code[b]].as_py()
                if now != tree:
                    tree, seen = now, 0
                place[b:e] += seen - b
                seen += e - b
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"]
            )

    named = dealt.drop("_salt").withColumn("part", F.spark_partition_id())
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    placed = keep(named.mapInArrow(number, f"{kind}, place long"), folder, name)
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return (
        placed.join(offsets, ["tree", "part"])
        .withColumn("rank", F.col("offset") + F.col("place"))
        .drop("offset", "place", "part")
    )


_BLOCK = "tree string, block long, leaves long, runs long, nodes binary, root string"


def _blocks(leaves: DataFrame, folder: str, name: str, block_levels: int) -> DataFrame:
    """Stored blocks over (tree, rank, digest): one row per block."""
    size = ARITY**block_levels

    def made(table: pa.Table) -> pa.Table:
        rank = table.column("rank").to_numpy()
        digests = table.column("digest").take(pa.array(np.argsort(rank))).to_pylist()
        block = int(rank[0] // size)
        # Only the one block of a small tree ends below the full height.
        runs = block_levels if block else run_levels(len(digests))
        store = build(digests, runs)
        return pa.table(
            {
                "tree": [table.column("tree")[0].as_py()],
                "block": [block],
                "leaves": [len(digests)],
                "runs": [runs],
                "nodes": [store],
                "root": [store[:DIGEST].hex()],  # the root stands first in every layout
            }
        )

    dealt = leaves.select("tree", "rank", "digest", F.expr(f"rank div {size}").alias("block"))
    return keep(dealt.groupBy("tree", "block").applyInArrow(made, _BLOCK), folder, name)


def _trees(leaves: DataFrame, folder: str, name: str, block_levels: int) -> list[DataFrame]:
    """Stored blocks, level by level; a level holds the trees of several blocks in the one below."""
    levels = []
    while True:
        blocks = _blocks(leaves, folder, f"{name}-{len(levels)}", block_levels)
        levels.append(blocks)
        # One number reaches the driver: whether any tree has a second block.
        if not blocks.agg(F.max("block")).first()[0]:
            return levels
        several = blocks.where("block = 1").select("tree")
        leaves = blocks.join(several, "tree", "left_semi").select(
            "tree", F.col("block").alias("rank"), F.col("root").alias("digest")
        )


def _retrieve(children: DataFrame, blocks: DataFrame, block_levels: int, found, kind: str) -> DataFrame:
    """``found(row, block, path)`` for every child row of (tree, rank, ...) in its block.

    path: its siblings within the block, then the ``way`` above the block's root. A block and
    its children, at most ``3**block_levels``, meet in one group.
    """
    size = ARITY**block_levels

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = right.to_dict("records")[0]
        way = list(block["way"])
        return pd.DataFrame(
            [
                found(
                    row,
                    block,
                    siblings(block["nodes"], block["runs"], block["leaves"], row["rank"] % size) + way,
                )
                for row in left.to_dict("records")
            ]
        )

    dealt = children.withColumn("block", F.expr(f"rank div {size}"))
    return (
        dealt.groupBy("tree", "block")
        .cogroup(blocks.groupBy("tree", "block"))
        .applyInPandas(met, kind)
    )


def _with_ways(levels: list[DataFrame], over: DataFrame, block_levels: int) -> DataFrame:
    """The blocks of the lowest level with the ``way`` above their roots and their ``subroot``.

    ``over`` holds (tree, block, way, subroot) for the uppermost block, 0, of every tree.
    """
    for upper, lower in zip(levels[:0:-1], levels[-2::-1], strict=True):
        inner = _retrieve(
            lower.join(upper.where("block = 0").select("tree"), "tree", "left_semi").select(
                "tree", F.col("block").alias("rank")
            ),
            upper.join(over, ["tree", "block"]),
            block_levels,
            lambda row, block, path: {
                "tree": row["tree"], "block": row["rank"], "way": path, "subroot": block["subroot"],
            },
            "tree string, block long, way array<string>, subroot string",
        )
        flat = over.join(upper.where("block = 0").select("tree"), "tree", "left_anti")
        over = inner.unionByName(flat)
    return levels[0].join(over, ["tree", "block"])


def manifest(
    df: DataFrame,
    folder: str,
    tampered: Column | None = None,
    tampered_text: Column | None = None,
    fields: list[str] = FIELDS,
    group: str = "source",
    id: str = "doc_id",
    text: str = "text",
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row of ``df``: ``id``, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf is the digest of ``fields``. Leaves of one ``group`` (null is one of its own, the
    first) ascend by ``id``, then by leaf, nulls first; rows equal in both are interchangeable.
    While a tree has several nodes, each three in a row, fewer at the end, become their digest.
    The roots of the groups, by UTF-8 bytes of ``group``, give root likewise. proof_sha256 is
    the digest of all siblings on the way from leaf to root. Where ``tampered`` holds,
    folded_root starts from the digest with ``tampered_text`` in place of ``text``, else from
    leaf; verified tells whether it is root. Other columns of ``df`` are ignored, whatever their
    names; an empty table gives an empty one. The stored blocks stay in ``folder``, named
    ``blocks-*`` and ``roots-*``.
    """
    spark = df.sparkSession
    columns = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_digest(list(columns.values()))
    other = F.lit(None).cast("string")
    if tampered is not None:
        changed = leaf_digest([tampered_text if c == text else v for c, v in columns.items()])
        other = F.when(tampered, changed)
    # "=" before a name keeps the order of names and puts a null one, "", first.
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = df.select(
        F.col(f"`{id}`").alias("id"), tree.alias("tree"), leaf.alias("digest"), other.alias("other")
    )
    rows = keep(rows, folder, "leaves")
    ranked = keep(numbered(rows, ["id", "digest"], folder, "placed"), folder, "ranked")
    blocks = _trees(ranked, folder, "blocks", block_levels)

    subroots = blocks[0].where("block = 0").select("tree", "root")
    for level in blocks[1:]:
        higher = level.where("block = 0").select("tree", "root")
        subroots = subroots.join(higher, "tree", "left_anti").unionByName(higher)
    named = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")
    )
    named = keep(numbered(named, ["name"], folder, "placed-roots"), folder, "ranked-roots")
    uppers = _trees(named, folder, "roots", block_levels)
    top = uppers[-1].select("tree", "block", F.array().cast("array<string>").alias("way"))
    first = uppers[-1].select("root").first()
    root = first[0] if first else None

    over = _retrieve(
        named,
        _with_ways(uppers, top.withColumn("subroot", F.lit("")), block_levels),
        block_levels,
        lambda row, block, path: {
            "tree": row["name"], "block": 0, "way": path, "subroot": row["digest"],
        },
        "tree string, block long, way array<string>, subroot string",
    )
    over = keep(over, folder, "over")

    def proved(row, block, path):
        start = row["digest"] if row["other"] is None else row["other"]
        return {
            "id": row["id"],
            "leaf": row["digest"],
            "subroot": block["subroot"],
            "proof_sha256": sha256("".join(path).encode()).hexdigest(),
            "folded_root": fold(start, path),
        }

    kind = rows.schema["id"].dataType.simpleString()
    proofs = _retrieve(
        ranked, _with_ways(blocks, over, block_levels), block_levels, proved,
        f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string",
    )
    return proofs.select(
        F.col("id").alias(id),
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
