"""Best-fit packing by exact complements: a plan over the counts of lengths, then numbering.

The plan needs one count per length, so its size is bounded by the capacity, not by the data.
Each length looks up its gap among single lengths, sums of two and sums of three, and consumes
what fills it exactly, as often as all parts are there; best fit places the rest.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.llm.byte_bpe import added_tokens, load_ranks
from tablescout.llm.frames import keep, once

ROWS_IN_BUCKET = 100_000  # pieces numbered together in one window group, about


@lru_cache(2)
def _encoding(path: str, added: bool) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "pieces",
        pat_str=PATTERN,
        mergeable_ranks=load_ranks(path),
        special_tokens=added_tokens(path) if added else {},
    )


def token_pieces(
    df: DataFrame,
    path: str,
    capacity: int,
    end_id: int,
    columns: list[str],
    text: str = "text",
    added: bool = False,
) -> DataFrame:
    """Every text's ids and ``end_id``, cut into pieces: ``columns``, piece, start, length, ids.

    Only texts of more than ``capacity`` ids are cut, so that all pieces but the first are
    full. ``ids`` is binary, little-endian unsigned 32-bit. A null text counts as empty: its
    one piece is the end id. With ``added``, strings of the vocabulary's added tokens give those
    tokens' ids, as by the tokenizer's default; else they are ordinary text. Repeated rows give
    their pieces each; columns of ``df`` outside ``columns`` are left out.
    """

    def cut(texts: pd.Series) -> pd.Series:
        encoding, out = _encoding(path, added), []
        for t in texts:
            ids = encoding.encode_to_numpy(t or "", allowed_special="all", disallowed_special=())
            raw = np.append(ids, end_id).astype("<u4").tobytes()
            first = (len(raw) // 4 - 1) % capacity + 1
            ends = range(4 * first, len(raw) + 1, 4 * capacity)
            out.append([raw[max(0, e - 4 * capacity) if e > 4 * first else 0 : e] for e in ends])
        return pd.Series(out, dtype=object)

    cols = [F.col(f"`{c}`") for c in columns]
    whole = df.select(*cols, once(cut, "array<binary>")(F.col(f"`{text}`")).alias("_pieces"))
    whole = whole.withColumn("_first", (F.length(F.get("_pieces", F.lit(0))) / 4).cast("long"))
    return whole.select(*cols, "_first", F.posexplode("_pieces").alias("piece", "ids")).select(
        *cols,
        "piece",
        F.when(F.col("piece") == 0, F.lit(0).cast("long"))
        .otherwise(F.col("_first") + (F.col("piece") - 1) * F.lit(capacity).cast("long"))
        .alias("start"),
        (F.length("ids") / 4).cast("long").alias("length"),
        "ids",
    )


class SumIndex:
    """Combinations of one, two and three of the occurring lengths, by their sum.

    Pairs are all enumerated and filed under their sums; the triples of a sum are the pairs
    filed under what a third, largest length leaves of it, listed when they are asked for: all
    of them at once would take memory as the cube of the capacity.
    """

    def __init__(self, lengths: np.ndarray, most: int):
        self.lengths = np.sort(lengths)[::-1]
        high, low = np.meshgrid(self.lengths, self.lengths, indexing="ij")
        fits = (high >= low) & (high + low <= most)
        pairs = np.stack([high[fits], low[fits]], axis=1)  # the larger the first part, the earlier
        total = pairs.sum(axis=1)
        order = np.argsort(total, kind="stable")
        self.pairs = pairs[order]
        self.begins = np.searchsorted(total[order], np.arange(most + 2))

    def of(self, total: int, parts: int) -> np.ndarray:
        """The combinations of ``parts`` lengths with this sum, one a row, largest part first."""
        if parts == 1:
            return self.lengths[self.lengths == total][:, None]
        if parts == 2:
            return self.pairs[self.begins[total] : self.begins[total + 1]]
        found = [np.zeros((0, 3), np.int64)]
        for c in self.lengths[(self.lengths < total) & (3 * self.lengths >= total)].tolist():
            two = self.of(total - c, 2)
            two = two[two[:, 0] <= c]
            found.append(np.column_stack([np.full(len(two), c), two]))
        return np.concatenate(found)


def _exact(left: np.ndarray, capacity: int, heads, index: SumIndex, parts: int, plan: list) -> None:
    """Fill the gap beside each head length exactly, as often as the counts in ``left`` allow."""
    for length in heads:
        if not left[length]:
            continue
        rows = index.of(capacity - length, parts)
        rows = np.column_stack([np.full(len(rows), length), rows])
        # How often a row needs each of its lengths, the head's own included.
        needs = (rows[:, :, None] == rows[:, None, :]).sum(axis=2)
        while left[length]:
            times = (left[rows] // needs).min(axis=1) if len(rows) else np.zeros(0, np.int64)
            able = np.flatnonzero(times)
            if not len(able):
                break
            pattern, n = tuple(rows[able[0]].tolist()), int(times[able[0]])
            plan.append((pattern, n))
            for x in set(pattern):
                left[x] -= pattern.count(x) * n
            # What was passed over cannot become possible: counts only fall.
            rows, needs = rows[able[0] :], needs[able[0] :]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, how many such sequences) that use up ``counts``.

    Complements of one length are consumed first, then pairs, then triples; best fit takes what
    no combination fills exactly.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    index = SumIndex(np.flatnonzero(left), capacity - 1)
    for parts in (1, 2, 3):
        _exact(left, capacity, range(capacity - 1, 0, -1), index, parts, plan)
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns for the lengths in ``left``, the longest first, each into the smallest gap."""
    # Best fit of what is left: open sequences by gap, each entry (gap, pattern, how many).
    gaps: list[tuple[int, tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, (length,))
            if at < len(gaps):
                gap, pattern, many = gaps.pop(at)
            else:
                gap, pattern, many = capacity, (), max(1, n // (capacity // length))
            copies = min(gap // length, n)
            used = min(many, n // copies)
            n -= used * copies
            if many > used and pattern:
                bisect.insort(gaps, (gap, pattern, many - used))
            bisect.insort(
                gaps, (gap - copies * length, pattern + (length,) * copies, used)
            )
    return [(pattern, many) for _, pattern, many in gaps]


def _intervals(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per length: ranks [low, high) fill ``copies`` places each of sequences from ``seq`` on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, many in plan:
        at = 0
        for length in dict.fromkeys(sorted(pattern, reverse=True)):
            copies = pattern.count(length)
            low = used.get(length, 0)
            used[length] = low + copies * many
            rows.append((length, low, used[length], copies, sequence, at))
            at += copies * length
        sequence += many
    return rows


def pack(pieces: DataFrame, capacity: int, folder: str, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: few sequences of at most ``capacity``.

    Lengths must lie in 1..capacity. Offsets within a sequence are gapless from 0. Equal
    lengths are interchangeable, so each piece needs only its number among those of its
    length: numbered within buckets of rows, so that a length that very many pieces share is
    spread, then shifted by the buckets before. The pieces are kept once in ``folder`` on
    shared storage with a row number, so that a repeated task numbers them alike. An empty
    table gives an empty table; input columns named as a result are replaced.
    """
    results = ["sequence_id", "offset"]
    kept = [c for c in pieces.columns if c.lower() not in results]
    pieces = keep(
        pieces.select(
            *[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("_row")
        ),
        folder,
        "pieces",
    )
    spark, size = pieces.sparkSession, F.col(f"`{length}`")
    histogram = {
        r[0]: r[1] for r in pieces.groupBy(size.alias("n")).agg(F.count("*")).collect()
    }
    rows = _intervals(packing_plan(histogram, capacity))
    plan = spark.createDataFrame(
        rows, "_l long, _low long, _high long, _copies long, _seq long, _at long"
    )
    buckets = max(128, -(-sum(histogram.values()) // ROWS_IN_BUCKET))
    numbered = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    group = Window.partitionBy(size, "_bucket").orderBy("_row")
    inside = numbered.withColumn("_rank", F.row_number().over(group) - 1)
    sizes = numbered.groupBy(size.alias("_l"), F.col("_bucket").alias("_b")).agg(
        F.count("*").alias("_n")
    )
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_l", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    ranked = inside.join(
        shifts, (size == F.col("_l")) & (F.col("_bucket") == F.col("_b"))
    ).select(*[F.col(f"`{c}`") for c in kept], (F.col("_rank") + F.col("_s")).alias("_rank"))
    turn = F.col("_rank") - F.col("_low")
    # The plan has a few rows per length, bounded by the capacity whatever the number of pieces.
    return ranked.join(
        F.broadcast(plan),
        (size == F.col("_l")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")),
    ).select(
        *[F.col(f"`{c}`") for c in kept],
        (F.col("_seq") + F.floor(turn / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_at") + turn % F.col("_copies") * size).cast("long").alias("offset"),
    )
