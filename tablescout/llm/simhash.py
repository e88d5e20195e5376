"""SimHash near-duplicates: a self-join of a binary trie of fingerprints within a Hamming budget.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import attach, components, keep, once, spanning_edges

SEED, WORDS = 42, 3
BLOCK = 65_536  # shingles whose bits are counted at once
BITS, HALF = 64, 32
NODE_BITS = 12  # depth of the trie nodes that are dealt to tasks
WAY_BITS = 4
HOT_GROUP = 100_000  # fingerprints of a group of node pairs from which it is dealt in smaller ones
LEAF_PAIRS = 64  # node pairs with at most so many pairs of leaves are compared leaf by leaf
AT_ONCE = 1_000_000  # node pairs or pairs of leaves held at once


def text_fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a whole text as a signed 64-bit integer; 0 where it has no word.

    Letters A-Z count as lower case and words end at ASCII white space. A bit is 1 where more
    than half of the shingles' XXH64 have it; a text of fewer words is one shingle.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = (ends - [len(w) + 1 for w in parts]).tolist()
    stops = (ends[words - 1 :] - 1).tolist() or [len(joined)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(stops), BLOCK):
        block = zip(starts[i : i + BLOCK], stops[i : i + BLOCK], strict=False)
        hashes = np.array([digest(joined[a:b], seed) for a, b in block], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    on = np.packbits(2 * total > len(stops), bitorder="little")
    return int(on.view("<i8")[0])


def fingerprints(
    df: DataFrame, text: str = "text", out: str = "fp", columns: list[str] | None = None
) -> DataFrame:
    """``df`` (or ``columns`` of it) with the fingerprint of every whole text, a long."""

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t) for t in texts], dtype="int64")

    return attach(df, {out: once(prints, "long")(F.col(f"`{text}`"))}, columns)


def _budget(depth: int, errors: int) -> int:
    """Errors allowed in the first ``depth`` bits of a trie.

    There are two tries, over the fingerprints and over those with their halves swapped. Of two
    fingerprints that differ in ``errors`` bits, one half has at most ``errors // 2`` of them.
    """
    return errors // 2 if depth <= HALF else errors


# What a group of fingerprints stands for. Its own ones lie below one node.
PLAIN, DEEP = 0, 1  # pairs among its own, and of those with the others, which differ in one bit
ACROSS = 2  # pairs of its own with the others alone
BLOCKS = 3  # as ACROSS, but the others are of the same node
GROUP = ["node", "mode", "cell"]


def _neighbours(node, own, rest):
    """The entries of a node's fingerprint: its own, and one with each smaller node a bit away."""
    smaller = [(node.bitwiseAND(1 << j) != 0, node.bitwiseXOR(F.lit(1 << j))) for j in range(NODE_BITS)]
    return [own(node), *[F.when(is_set, rest(there)) for is_set, there in smaller]]


def _shallow(fps: DataFrame) -> DataFrame:
    """(n, other, key): both tries' fingerprints beside the nodes of ``NODE_BITS`` bits.

    A node is paired with itself and with the nodes one bit away; the pair belongs to the
    smaller node, whose fingerprints have ``other`` false. ``n`` holds trie and prefix.
    """
    swapped = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    tries = [
        F.struct(F.lit(trie).cast("long").alias("trie"), key.alias("key"))
        for trie, key in ((0, F.col("fp")), (1, swapped))
    ]
    both = fps.select(F.inline(F.array(*tries)))
    prefix = F.shiftrightunsigned("key", BITS - NODE_BITS)
    named = both.select("key", (F.col("trie") * (1 << NODE_BITS) + prefix).alias("n"))

    def entry(other):
        return lambda node: F.struct(node.alias("n"), F.lit(other).alias("other"))

    each = F.array_compact(F.array(*_neighbours(F.col("n"), entry(False), entry(True))))
    return named.select("key", F.explode(each).alias("e")).select("e.n", "e.other", "key")


def _deeper(rows: DataFrame) -> DataFrame:
    """The rows of hot groups beside the node pairs of twice the depth below theirs.

    Way 1 is a node with itself, whose lower nodes pair as the upper ones did. Way 2 + j is the
    node with the one that differs in bit j: with that error only equal lower nodes may pair.
    """
    n, other = F.col("n"), F.col("other")
    lower = F.shiftrightunsigned("key", BITS - 2 * NODE_BITS).bitwiseAND((1 << NODE_BITS) - 1)
    rows = rows.select("*", lower.alias("s"))

    def entry(way, mode, other):
        def of(node):
            packed = (F.shiftleft(n, WAY_BITS) + way) * (1 << NODE_BITS) + node
            return F.struct(
                packed.alias("node"), F.lit(mode).alias("mode"), F.lit(other).alias("other")
            )

        return of

    own = _neighbours(F.col("s"), entry(1, DEEP, False), entry(1, DEEP, True))
    for j in range(NODE_BITS):
        own.append(F.when(n.bitwiseAND(1 << j) == 0, entry(2 + j, ACROSS, False)(F.col("s"))))
    differs = F.shiftrightunsigned("key", BITS - NODE_BITS).bitwiseXOR(n).bitwiseAND((1 << NODE_BITS) - 1)
    way = F.bit_count(differs - 1) + 2
    rest = F.array(entry(way, ACROSS, True)(F.col("s")))
    each = F.when(other, rest).otherwise(F.array_compact(F.array(*own)))
    return rows.select("key", F.explode(each).alias("e")).select("e.*", "key")


def _cells(rows: DataFrame, hot: int) -> DataFrame:
    """Every group of more than ``hot`` rows as pairs of blocks of about ``hot`` rows at most.

    Blocks are cut by a hash. A block meets itself, every other block of its own node and every
    block of the others, each meeting in a cell of its own, so no pair is lost however many
    fingerprints agree in all the bits of a node.
    """
    sizes = rows.groupBy("node").agg(
        F.count_if(~F.col("other")).alias("n_own"), F.count_if("other").alias("n_other")
    )
    large = sizes.where(F.col("n_own") + F.col("n_other") > hot).select(
        "node",
        F.ceil(F.col("n_own") / hot).cast("int").alias("owns"),
        F.ceil(F.col("n_other") / hot).cast("int").alias("others"),
    )
    owns, others = F.col("owns"), F.col("others")
    hashed = F.xxhash64("key")

    def cell(mode, first, second, width, other):
        number = first.cast("long") * width + second + 1
        return F.struct(
            F.lit(mode).alias("mode"), number.alias("cell"), F.lit(other).alias("other")
        )

    def count_to(end):
        return F.when(end > 0, F.sequence(F.lit(0), end - 1)).otherwise(F.array().cast("array<int>"))

    block = F.pmod(hashed, F.when(F.col("other"), others).otherwise(owns)).cast("int")
    placed = rows.join(large, "node", "left").withColumn("b", block)
    b = F.col("b")
    within = F.transform(
        count_to(owns),
        lambda j: F.when(j == b, cell(DEEP, b, b, owns, False))
        .when(j > b, cell(BLOCKS, b, j, owns, False))
        .otherwise(cell(BLOCKS, j, b, owns, True)),
    )
    nothing = F.filter(within, lambda _: F.lit(False))
    with_others = F.transform(count_to(others), lambda j: cell(ACROSS, b, j, others, False))
    own = F.concat(F.when(F.col("mode") == DEEP, within).otherwise(nothing), with_others)
    rest = F.transform(count_to(owns), lambda j: cell(ACROSS, j, b, others, True))
    whole = F.array(
        F.struct("mode", F.lit(0).cast("long").alias("cell"), "other")
    )
    each = F.when(owns.isNull(), whole).when(F.col("other"), rest).otherwise(own)
    return placed.select("node", "key", F.explode(each).alias("e")).select(
        "node", "e.mode", "e.cell", "e.other", "key"
    )


def _deal(fps: DataFrame, hot: int, errors: int) -> DataFrame:
    """(node, mode, cell, other, key): each fingerprint in every group that it takes part in.

    Groups of more than ``hot`` fingerprints are dealt at twice the depth, and those still too
    large there by pairs of blocks. Sizes are joined as tables: at most two for each prefix of
    ``NODE_BITS`` bits, then those of hot groups alone.
    """
    if errors not in (2, 3):
        raise ValueError("the tries are cut for 2 or 3 differing bits")
    rows = _shallow(fps)
    large = rows.groupBy("n").count().where(F.col("count") > hot).select("n")
    # At most 2 * 2 ** NODE_BITS rows, whatever the data.
    large = F.broadcast(large)
    cool = rows.join(large, "n", "left_anti").select(
        (F.shiftleft("n", WAY_BITS) * (1 << NODE_BITS)).alias("node"),
        F.lit(PLAIN).alias("mode"),
        F.lit(0).cast("long").alias("cell"),
        "other",
        "key",
    )
    return cool.unionByName(_cells(_deeper(rows.join(large, "n", "left_semi")), hot))


def _near_pairs(keys: np.ndarray, pairs: list[np.ndarray], depth: int, errors: int):
    """Pairs of positions in ``keys`` within the budget, in blocks; ``keys`` sorted per node.

    ``pairs`` holds begin and end of both nodes and the bits that differ so far. All node pairs
    go down a bit at a time together: a pair of nodes gives the pairs of their children, and
    those over the budget end there. Where few leaves are left, these are compared.
    """
    stack = [(depth, pairs)]
    while stack:
        depth, (a0, a1, b0, b1, wrong) = stack.pop()
        if len(a0) > AT_ONCE:
            half = len(a0) // 2
            stack.append((depth, [x[half:] for x in (a0, a1, b0, b1, wrong)]))
            stack.append((depth, [x[:half] for x in (a0, a1, b0, b1, wrong)]))
            continue
        few = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth >= BITS)
        yield from _leaf_pairs(keys, *(x[few] for x in (a0, a1, b0, b1)), errors)
        a0, a1, b0, b1, wrong = (x[~few] for x in (a0, a1, b0, b1, wrong))
        if not len(a0):
            continue
        bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        itself = (a0 == b0) & (a1 == b1)
        parts = [
            (a0, am, b0, bm, wrong),
            (am, a1, bm, b1, wrong),
            (a0, am, bm, b1, wrong + 1),
            tuple(x[~itself] for x in (am, a1, b0, bm, wrong + 1)),
        ]
        down = [np.concatenate(x) for x in zip(*parts, strict=True)]
        stay = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= _budget(depth + 1, errors))
        stack.append((depth + 1, [x[stay] for x in down]))


def _leaf_pairs(keys, a0, a1, b0, b1, errors: int):
    sizes = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
        part = slice(at, past)
        which = np.repeat(np.arange(at, past), sizes[part])
        inside = np.arange(len(which)) - np.repeat(ends[part] - sizes[part], sizes[part])
        inside += ends[at - 1] if at else 0
        width = (b1 - b0)[which]
        i, j = a0[which] + inside // width, b0[which] + inside % width
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= errors)
        if near.any():
            yield i[near], j[near]
        at = past


def _links_of(errors: int):
    def links(batches):
        rest = None
        for part in batches:
            rest = part if rest is None else pd.concat([rest, part])
            if len(rest) >= AT_ONCE // 4:
                still = (rest[GROUP] == rest[GROUP].iloc[-1]).all(axis=1)
                yield from _links(rest[~still], errors)
                rest = rest[still]
        if rest is not None:
            yield from _links(rest, errors)

    return links


def _links(rows: pd.DataFrame, errors: int):
    """Spanning links among the fingerprints of whole groups."""
    if not len(rows):
        return
    keys = rows["key"].to_numpy().view(np.uint64)
    marks = [rows[c].to_numpy() for c in (*GROUP, "other")]
    order = np.lexsort((keys, *marks[::-1]))
    keys, (node, mode, cell, other) = keys[order], (m[order] for m in marks)
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(node) != 0) | (np.diff(mode) != 0) | (np.diff(cell) != 0)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(node))
    own = np.append(0, np.cumsum(~other))
    middles = begins + own[ends] - own[begins]
    mode = mode[begins]
    group = np.repeat(np.arange(len(begins)), ends - begins)
    for depth, chosen in ((NODE_BITS, mode == PLAIN), (2 * NODE_BITS, mode != PLAIN)):
        # the others of a group come from several nodes, each a range of the sorted keys
        prefix = (keys >> np.uint64(BITS - depth)).astype(np.int64)
        fresh = (np.diff(prefix, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0)
        fresh |= np.diff(other.astype(np.int8), prepend=0) != 0
        first = np.flatnonzero(fresh)
        past = np.append(first[1:], len(keys))
        of = group[first]
        take = other[first] & chosen[of]
        first, past, of = first[take], past[take], of[take]
        alone = chosen & ((mode == PLAIN) | (mode == DEEP))
        b, m = begins[alone], middles[alone]
        pairs = [
            np.concatenate(x)
            for x in zip(
                (b, m, b, m, np.zeros(len(b), np.int64)),
                (begins[of], middles[of], first, past, (mode[of] != BLOCKS).astype(np.int64)),
                strict=True,
            )
        ]
        filled = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3])
        for i, j in _near_pairs(keys, [x[filled] for x in pairs], depth, errors):
            swap = node[i] >> (2 * NODE_BITS + WAY_BITS) > 0
            x, y = keys[i], keys[j]
            half = np.uint64(HALF)
            x = np.where(swap, (x << half) | (x >> half), x).view(np.int64)
            y = np.where(swap, (y << half) | (y >> half), y).view(np.int64)
            child, root = spanning_edges(x, y)
            yield pd.DataFrame({"a": child, "b": root})


def links(fps: DataFrame, errors: int = 3, hot_group: int = HOT_GROUP) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``errors`` differing bits.

    ``fps`` has the distinct fingerprints in ``fp``. Every pair in reach is found in one of the
    two tries; of the pairs that a task finds together only a spanning forest is returned, so
    the connected components are those of all pairs and a dense group stays small. No task
    compares groups of more than about twice ``hot_group`` fingerprints.
    """
    return (
        _deal(fps, hot_group, errors)
        .repartition(*GROUP)
        .sortWithinPartitions(*GROUP)
        .mapInPandas(_links_of(errors), "a long, b long")
    )


def near_duplicates(
    df: DataFrame,
    folder: str,
    id: str = "doc_id",
    text: str = "text",
    errors: int = 3,
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` of ``df`` (by default ``id``) beside fingerprint and component_id of each row.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest ``id`` that links reach,
    links joining fingerprints that differ in at most ``errors`` bits. Equal fingerprints are
    one point, so copies cost nothing. A null or empty text has fingerprint zero, linked like
    any other. A null ``id`` is passed over by the minimum unless all of a component are null;
    repeated rows stay. An empty table gives an empty table.
    """
    columns = [id] if columns is None else columns
    if id not in columns:
        columns = [*columns, id]
    prints = keep(fingerprints(df, text, "_fp", columns), folder, "fingerprints")
    points = prints.groupBy(F.col("_fp").alias("fp")).agg(F.min(F.col(f"`{id}`")).alias("first"))
    points = keep(points, folder, "points")
    joined = components(links(points.select("fp"), errors), folder)
    labelled = points.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    labelled = keep(labelled, folder, "labelled")
    smallest = keep(labelled.groupBy("root").agg(F.min("first").alias("_c")), folder, "smallest")
    by_print = labelled.join(smallest, "root").select("fp", "_c")
    found = prints.join(by_print, F.col("_fp") == F.col("fp"))
    return attach(
        found,
        {"fingerprint": F.lower(F.lpad(F.hex("_fp"), 16, "0")), "component_id": F.col("_c")},
        columns,
    )
