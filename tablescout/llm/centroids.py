"""Centroid clustering in exact integers, filtered by a PCA rotation.

Each vector is stored with its leading rotated coordinates and the norm of what they leave out.
The distance of the leading coordinates plus the squared difference of those norms is a lower
bound of the distance to a centroid; only centroids whose bound does not exceed the distance to
one already verified are verified, in integers.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import keep

CENTROIDS, ROUNDS, SEED = 40, 5, 2
DIMENSION = 64
LEADING = 16  # rotated coordinates that are stored
SAMPLE = 8192  # vectors from which the rotation is fitted, about; any rotation is exact
SCALE = 256
NARROW = 1 << 25  # integers below this have squared distances that 64 bits hold
LIMB = 30  # bits of the parts in which sums travel
LONGEST = (1 << 63) - 1
ROWS_AT_ONCE = 8192
SLACK = 1e-9  # of the squared norms: over 10**5 times what rounding can change a bound by


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): long where all are narrow, else Python integers."""
    if not x.size or np.abs(x).max() * SCALE < NARROW:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [
        int(np.floor(v * SCALE)) if abs(v) < 2.0**52 else int(v) * SCALE for v in x.ravel().tolist()
    ]
    return np.array(exact, object).reshape(x.shape)


def rotation(sample: np.ndarray, leading: int = LEADING) -> np.ndarray:
    """Orthonormal columns: the directions in which the sample varies most, first."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :leading]
    around = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(around.T @ around)
    return np.linalg.qr(axes[:, ::-1][:, :leading])[0]


def reduced(rows: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading coordinates, norm of the rest, squared norm; wide rows come out as zeros."""
    floats = np.clip(rows, -NARROW, NARROW).astype(np.float64)
    wide = np.abs(floats).max(axis=1, initial=0) >= NARROW
    floats[wide] = 0
    lead, square = floats @ axes, (floats * floats).sum(axis=1)
    rest = np.sqrt(np.maximum(0, square - (lead * lead).sum(axis=1)))
    return lead, rest, np.where(wide, np.inf, square)


def nearest(rows, lead, rest, square, centroids, axes) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller on ties, and the distance.

    ``rows`` and ``centroids`` hold integers. An infinite squared norm marks what the bounds
    say nothing of: it is verified against everything.
    """
    c_lead, c_rest, c_square = reduced(centroids, axes)
    bound = (
        (lead * lead).sum(axis=1)[:, None]
        + (c_lead * c_lead).sum(axis=1)
        - 2 * lead @ c_lead.T
        + (rest[:, None] - c_rest) ** 2
    )
    size = square[:, None] + c_square
    bound = np.where(np.isfinite(size), bound - SLACK * np.where(np.isfinite(size), size, 0) - 1, -1.0)
    narrow = rows.dtype != object and centroids.dtype != object
    best = np.argmin(bound, axis=1)
    away = rows - centroids[best]
    distance = (away * away).sum(axis=1)
    # A candidate survives where its bound is at most the distance of the first one; all do
    # where some integer is wide.
    limit = distance.astype(np.float64) if narrow else np.full(len(rows), np.inf)
    alive = bound <= limit[:, None] * (1 + SLACK) + 1
    for c in range(len(centroids)):
        at = np.flatnonzero(alive[:, c] & (best != c))
        if not len(at):
            continue
        away = rows[at] - centroids[c]
        other = (away * away).sum(axis=1)
        closer = (other < distance[at]) | ((other == distance[at]) & (c < best[at]))
        distance[at[closer]], best[at[closer]] = other[closer], c
    return best, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _reduce(axes: np.ndarray, dimension: int):
    def rows(batches):
        for part in _slices(batches):
            lead, rest, square = reduced(integers(_matrix(part.column("x"), dimension)), axes)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.ListArray.from_arrays(
                        np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32), lead.ravel()
                    ),
                    pa.array(rest),
                    pa.array(square),
                ],
                names=["id", "x", "lead", "rest", "square"],
            )

    return rows


def _assigned(part: pa.RecordBatch, centroids: np.ndarray, axes: np.ndarray):
    rows = integers(_matrix(part.column("x"), centroids.shape[1]))
    return rows, *nearest(
        rows,
        _matrix(part.column("lead"), axes.shape[1]),
        part.column("rest").to_numpy(),
        part.column("square").to_numpy(),
        centroids,
        axes,
    )


def _sums(centroids: np.ndarray, axes: np.ndarray):
    """Counts (component -1) and sums of a partition by cluster, in parts of ``LIMB`` bits."""

    def rows(batches):
        total: dict[tuple[int, int], int] = {}
        for part in _slices(batches):
            vectors, best, _ = _assigned(part, centroids, axes)
            for c in np.unique(best).tolist():
                mine = vectors[best == c]
                total[c, -1] = total.get((c, -1), 0) + len(mine)
                for i, s in enumerate(mine.sum(axis=0).tolist()):
                    total[c, i] = total.get((c, i), 0) + s
        out = []
        for (c, i), s in total.items():
            limb, rest, sign = 0, abs(s), -1 if s < 0 else 1
            while rest:
                out.append((c, i, limb, sign * (rest & ((1 << LIMB) - 1))))
                limb, rest = limb + 1, rest >> LIMB
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in columns], names=["cluster", "i", "limb", "s"]
        )

    return rows


def _final(centroids: np.ndarray, axes: np.ndarray):
    def rows(batches):
        for part in _slices(batches):
            _, best, distance = _assigned(part, centroids, axes)
            exact = [d if d <= LONGEST else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(best, pa.int32()),
                    pa.array(exact, pa.int64()),
                    pa.array([d is None for d in exact]),
                ],
                names=["id", "cluster", "distance", "_over"],
            )

    return rows


def cluster(
    df: DataFrame,
    folder: str,
    id: str = "vec_id",
    vector: str = "embedding",
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimension: int = DIMENSION,
    leading: int = LEADING,
) -> DataFrame:
    """One row per kept vector: ``id``, cluster, distance, cluster_inertia, inertia,
    centroid_sha256.

    Kept are vectors of ``dimension`` components, none null or non-finite; each component x
    becomes floor(256 * x). Centroids start as the vectors with the smallest hexadecimal sha256
    of ``seed:id`` (then the smallest vector, where an id repeats; a null id starts none); if
    there are fewer vectors, there are fewer centroids. Each round assigns every vector to the
    nearest centroid by squared distance (ties: the smaller number), then moves every non-empty
    one to the floor of its vectors' mean; a last assignment follows. All of it is exact,
    whatever the components; a distance or sum of them that 64 bits cannot hold is null. Each
    row of a repeated id counts. Where no centroid can start, or in an empty table, the result
    has no rows. Other columns of ``df`` are ignored.

    Centroids (a number of rows that does not grow with the data) pass through the driver;
    sums are made in the tasks and added by Spark.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector}`")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("double"))
    )
    rows = df.where((F.size(v) == dimension) & finite).select(
        F.col(f"`{id}`").alias("id"), v.cast("array<double>").alias("x")
    )
    rows = keep(rows, folder, "vectors")
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.col("x")]
    start = rows.where("id is not null").orderBy(*order).limit(centroids).select("x").collect()
    names = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kind = rows.schema["id"].dataType.simpleString()
    if not start:
        empty = "id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty.format(kind)).withColumnRenamed("id", id)
    count = rows.count()
    share = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < F.lit(int((1 << 30) * SAMPLE / count) + 1)
    drawn = rows.where(share).select("x").toPandas()["x"]
    sample = np.stack([*drawn, np.zeros(dimension)])
    sample = sample[np.abs(sample).max(axis=1) * SCALE < NARROW]
    axes = rotation(np.floor(sample * SCALE), min(leading, dimension))
    stored = rows.mapInArrow(
        _reduce(axes, dimension),
        f"id {kind}, x array<double>, lead array<double>, rest double, square double",
    )
    stored = keep(stored, folder, "reduced")

    now = integers(np.array([r["x"] for r in start], np.float64))
    for _ in range(rounds):
        made = stored.mapInArrow(_sums(now, axes), "cluster long, i long, limb long, s long")
        # At most a fixed number of rows for each centroid: sums over all vectors.
        parts = made.groupBy("cluster", "i", "limb").agg(F.sum("s").alias("s")).collect()
        total: dict[tuple[int, int], int] = {}
        for r in parts:
            key = (r["cluster"], r["i"])
            total[key] = total.get(key, 0) + (r["s"] << (LIMB * r["limb"]))
        moved = [
            [total.get((c, i), 0) // total[c, -1] for i in range(dimension)] if (c, -1) in total else old
            for c, old in enumerate(now.tolist())
        ]
        wide = max(abs(x) for m in moved for x in m) >= NARROW
        now = np.array(moved, object if wide else np.int64)

    final = stored.mapInArrow(
        _final(now, axes), f"id {kind}, cluster int, distance long, _over boolean"
    )
    final = keep(final, folder, "assigned")
    # One row per centroid; a sum is null where one of its distances is, or where it is too long.
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = final.groupBy("cluster").agg(exact.alias("s"), F.max("_over").alias("o")).collect()
    known = {r["cluster"]: None if r["o"] else int(r["s"]) for r in sums}
    inertia = None if None in known.values() else sum(known.values())
    long = lambda x: x if x is not None and x <= LONGEST else None
    about = spark.createDataFrame(
        [
            (c, long(s), long(inertia), sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest())
            for c, s in known.items()
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return final.join(F.broadcast(about), "cluster").select(*names).withColumnRenamed("id", id)
