"""Near-duplicate embeddings by a pivot-permutation index.

Each vector is described by its ordered nearest pivots. The inverted lists are those of sets of
``shared`` pivots: two vectors meet in a list where they have at least so many of their nearest
pivots in common, and are then verified by their cosine.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import attach, components, keep, spanning_edges

PIVOTS = 256
NEAREST = 6  # pivots that describe a vector
SHARED = 3  # of them that two vectors must share to be compared
APART = 0.7  # pivots have less than this cosine with one another, so no cluster holds many
SAMPLE = 8192  # vectors from which pivots are drawn, about
HOT_LIST = 4096  # longer lists are cut into blocks that meet in pairs
ROWS_AT_ONCE = 20_000


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors of the sample, in its order, that lie apart from those chosen before."""
    chosen: list[np.ndarray] = []
    nearest = np.full(len(sample), -1.0)
    for i in range(len(sample)):
        if nearest[i] < apart:
            chosen.append(sample[i])
            nearest = np.maximum(nearest, sample @ sample[i])
            if len(chosen) == pivots:
                break
    return np.array(chosen)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dimension)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _describe(models: dict[int, np.ndarray], nearest: int, shared: int):
    """Map side: a row (d, list, k, n, near, vector) for each list that a vector stands in.

    ``models`` holds the pivots by length of the vectors.
    """

    def lists(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                mine = batch.take(pa.array(np.flatnonzero(lengths == d)))
                for at in range(0, mine.num_rows, ROWS_AT_ONCE):
                    yield of_length(mine.slice(at, ROWS_AT_ONCE), d)

    def of_length(part, d):
        rows, pivots = _matrix(part.column("v"), d), models[d]
        order = np.argsort(-(_unit(rows) @ pivots.T), axis=1, kind="stable")
        some = min(nearest, len(pivots))
        near = np.repeat(order[:, :1], nearest, axis=1).astype(np.int16)
        near[:, :some] = order[:, :some]  # where pivots are fewer, the first stands again
        known = np.sort(order[:, :some], axis=1).astype(np.int64)
        sets = np.array(list(combinations(range(some), min(shared, some))))
        key = np.zeros((len(rows), len(sets)), np.int64)
        for j in range(sets.shape[1]):
            key = key * 4096 + known[:, sets[:, j]]
        row = pa.array(np.repeat(np.arange(len(rows)), key.shape[1]))
        near = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), nearest)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(key.size, d, np.int32)),
                pa.array(key.ravel()),
                part.column("k").take(row),
                part.column("n").take(row),
                near.cast(pa.list_(pa.int16())).take(row),
                part.column("v").take(row),
            ],
            names=["d", "list", "k", "n", "near", "v"],
        )

    return lists


def _verify(models: dict[int, int], pivots: int, nearest: int, least: float):
    """Reduce side: links within each list (or pair of blocks of one), counted and spanned.

    A pair that shares more pivots than it must meets in several lists; it counts in the one of
    its smallest shared pivots, so that no pair is sent anywhere to find its repetitions.
    ``models`` tells by length of the vectors how many pivots a pair must share.
    """
    words = -(-pivots // 64)

    def of_group(shared, key, near, rows, side):
        unit = _unit(rows)
        bits = np.zeros((len(rows), words), np.uint64)
        index = np.arange(len(rows))
        for j in range(nearest):
            np.bitwise_or.at(
                bits, (index, near[:, j] >> 6), np.uint64(1) << (near[:, j] & 63).astype(np.uint64)
            )
        last = key % 4096
        below = np.zeros(words, np.uint64)
        for p in range(last):
            below[p >> 6] |= np.uint64(1) << np.uint64(p & 63)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        whole = not len(right)
        right = left if whole else right
        for at in range(0, len(left), 1024):
            block = left[at : at + 1024]
            i, j = np.nonzero(unit[block] @ unit[right].T >= least)
            i, j = block[i], right[j]
            if whole:
                i, j = i[i < j], j[i < j]
            common = np.bitwise_count(bits[i] & bits[j] & below).sum(axis=1)
            first = common == shared - 1
            if first.any():
                yield i[first], j[first]

    def links(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows >= ROWS_AT_ONCE:
                group = rest.column("group").to_numpy()
                cut = int(np.searchsorted(group == group[-1], True))
                yield from of_table(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None:
            yield from of_table(rest)

    def of_table(table):
        if not table.num_rows:
            return
        table = table.combine_chunks()
        group, key = table.column("group").to_numpy(), table.column("list").to_numpy()
        k, n, side = (table.column(c).to_numpy() for c in ("k", "n", "side"))
        lengths, vectors = table.column("d").to_numpy(), table.column("v").chunk(0)
        near = table.column("near").chunk(0).flatten().to_numpy().reshape(-1, nearest)
        near = near.astype(np.int64)
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(begins[1:], len(group))
        many = ends - begins > 1
        heard, edges = [], []
        for b, e in zip(begins[many].tolist(), ends[many].tolist(), strict=True):
            part = slice(b, e)
            d = int(lengths[b])
            rows = _matrix(vectors.slice(b, e - b), d)
            for i, j in of_group(models[d], int(key[b]), near[part], rows, side[part]):
                i, j = i + b, j + b
                heard.append((np.concatenate([k[i], k[j]]), np.concatenate([n[j], n[i]])))
                edges.append(spanning_edges(k[i], k[j]))
        if not heard:
            return
        who, inverse = np.unique(np.concatenate([h[0] for h in heard]), return_inverse=True)
        total = np.zeros(len(who), np.int64)
        np.add.at(total, inverse, np.concatenate([h[1] for h in heard]))
        a, b = (np.concatenate([e[x] for e in edges]) for x in (0, 1))
        yield _rows(who, total, np.full(len(who), -1))
        yield _rows(a, np.zeros(len(a), np.int64), b)

    def _rows(a, count, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (a, count, b)], names=["a", "links", "b"]
        )

    return links


def near_duplicates(
    df: DataFrame,
    folder: str,
    id: str = "vec_id",
    vector: str = "embedding",
    least: float = 0.95,
    pivots: int = PIVOTS,
    nearest: int = NEAREST,
    shared: int = SHARED,
    hot_list: int = HOT_LIST,
) -> DataFrame:
    """One row per vector: ``id``, n_links, component_id, kept.

    n_links counts the other vectors found with a cosine of at least ``least`` in double
    precision; component_id is the smallest ``id`` that links reach; kept where that is the
    vector's own. A vector that is null, zero, or holds a null or a non-finite component links
    with nothing. Vectors of different lengths have no cosine; each length has an index of its
    own, with pivots of its own. Equal vectors are one point with a count, so copies cost nothing; each row of a repeated ``id`` counts. A null
    ``id`` is passed over by the minimum. An empty table gives an empty table.

    Pivots come from a sample of about ``SAMPLE`` vectors of a length; all vectors are indexed. A list of
    more than ``hot_list`` vectors is cut into blocks, each pair of which is a group of its own.
    """
    results = ["n_links", "component_id", "kept"]
    v = F.col(f"`{vector}`")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("double"))
    )
    rows = keep(
        df.select(
            F.col(f"`{id}`").alias("id"),
            F.when(finite & F.exists(v, lambda x: x != 0), v).alias("v"),
        ),
        folder,
        "rows",
    )
    usable = F.col("v").isNotNull()
    points = (
        rows.where(usable)
        .groupBy("v")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .withColumn("k", F.monotonically_increasing_id())
    )
    points = keep(points, folder, "points")
    # One row per length of vectors reaches the driver, and a bounded sample of each length.
    counts = {r["d"]: r["count"] for r in points.groupBy(F.size("v").alias("d")).count().collect()}
    share = F.lit(0)
    for d, n in counts.items():
        share = F.when(F.size("v") == d, int((1 << 30) * SAMPLE / n) + 1).otherwise(share)
    sample = points.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share)
    drawn = sample.select(F.size("v").alias("d"), "v").orderBy(F.xxhash64("v")).toPandas()
    models = {
        int(d): choose_pivots(_unit(np.stack(found["v"].to_list()).astype(np.float64)), pivots)
        for d, found in drawn.groupby("d")
    }
    for d in counts.keys() - models.keys():  # none drawn: one of them is pivot enough
        models[d] = _unit(np.array([points.where(F.size("v") == d).first()["v"]], np.float64))
    needed = {d: min(shared, nearest, len(m)) for d, m in models.items()}
    listed = keep(
        points.select("k", "n", "v").mapInArrow(
            _describe(models, nearest, shared),
            f"d int, list long, k long, n long, near array<short>, v {points.schema['v'].dataType.simpleString()}",
        ),
        folder,
        "lists",
    )
    long = (
        listed.groupBy("d", "list")
        .count()
        .where(F.col("count") > hot_list)
        .select("d", "list", F.ceil(F.col("count") / hot_list).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    met = F.when(
        F.col("blocks").isNull(),
        F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
            lambda o: F.struct(
                F.least(mine, o).alias("i"),
                F.greatest(mine, o).alias("j"),
                (mine > o).cast("int").alias("side"),
            ),
        )
    )
    dealt = (
        listed.join(long, ["d", "list"], "left")
        .select("*", F.explode(met).alias("e"))
        .select("d", "list", "k", "n", "near", "v", "e.side", F.xxhash64("d", "list", "e.i", "e.j").alias("group"))
    )
    found = keep(
        dealt.repartition("group")
        .sortWithinPartitions("group", "list", "side")
        .mapInArrow(_verify(needed, pivots, nearest, least), "a long, links long, b long"),
        folder,
        "found",
    )
    joined = components(found.where("b >= 0").select("a", "b"), folder)
    heard = found.where("b < 0").groupBy("a").agg(F.sum("links").alias("heard"))
    labelled = (
        points.join(joined, F.col("k") == F.col("node"), "left")
        .join(heard, F.col("k") == F.col("a"), "left")
        .select(
            "v", "first", "n", F.coalesce("heard", F.lit(0)).alias("heard"),
            F.coalesce("component", "k").alias("root"),
        )
    )
    labelled = keep(labelled, folder, "labelled")
    smallest = keep(labelled.groupBy("root").agg(F.min("first").alias("c")), folder, "smallest")
    classes = labelled.join(smallest, "root").select(
        F.col("v").alias("_v"), (F.col("heard") + F.col("n") - 1).alias("n_links"), "c"
    )
    linked = rows.where(usable).join(classes, F.col("v") == F.col("_v")).select("id", "n_links", "c")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c")
    )
    both = linked.unionByName(alone)
    return attach(
        both.withColumnRenamed("id", id),
        dict(
            zip(
                results,
                (F.col("n_links"), F.col("c"), F.col(f"`{id}`").eqNullSafe(F.col("c"))),
                strict=True,
            )
        ),
        [id],
    )
