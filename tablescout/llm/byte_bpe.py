"""Byte-level BPE: codepoint classes and transition-function scans find the words, cached pair
merging turns them into ids, byte offsets of the ids drive the decoding."""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import attach, once, text_chunks

CACHED_WORDS = 200_000  # words whose ids a worker remembers
CACHED_BYTES = 64  # longer words are merged anew each time
NO_PAIR = 1 << 40

# The code points of Unicode's White_Space property.
WHITE_SPACE = (
    [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# What may follow an apostrophe as a contraction.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ["re", "ve", "ll"]

# Letters and numbers of Unicode 16 that Python's tables may not have yet.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3),
    (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]

# Symbols: letter, number, other, space joined to what follows, white space within a run, single
# white space, apostrophe of a one- and of a two-letter contraction, separator of texts.
LETTER, NUMBER, OTHER, JOINED, RUN, LONE, SHORT, LONG, APART = range(9)
# States: after what was read. CLOSED: the next character starts a word whatever it is.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_RUN, ONE_LEFT, TWO_LEFT = range(8)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word starts, by symbol and state."""
    step = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[symbol] = state
        starts[symbol, [state, AFTER_SPACE]] = False
    step[LETTER, [ONE_LEFT, TWO_LEFT]] = [CLOSED, ONE_LEFT]
    starts[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    step[JOINED], step[RUN], step[LONE], step[APART] = AFTER_SPACE, IN_RUN, CLOSED, CLOSED
    starts[RUN, IN_RUN] = False
    for symbol, state in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        step[symbol] = state
        step[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    return step, starts


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions closed under composition: states of each, table, by symbol."""
    step, _ = _transitions()
    identity = tuple(range(8))
    known = {identity: 0}
    generators = [tuple(row.tolist()) for row in step]
    queue = [identity]
    for f in queue:
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    images = np.array(queue, np.uint8)
    ids = {f: i for i, f in enumerate(queue)}
    table = np.array(
        [[ids[tuple(images[b][images[a]].tolist())] for b in range(len(queue))]
         for a in range(len(queue))],
        np.uint16,
    )
    return images, table, np.array([ids[g] for g in generators], np.uint16)


@lru_cache(1)
def _code_point_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            classes[c] = LETTER
        elif kind == "N":
            classes[c] = NUMBER
    for ranges, symbol in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            classes[a : b + 1] = symbol
    classes[WHITE_SPACE] = RUN
    return classes


def _symbols(codes: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Classes with what a character's right neighbours decide folded in."""
    out = _code_point_classes()[codes]
    out[separators] = APART
    following = np.append(out[1:], APART)
    before_word = (out == RUN) & (following != RUN) & (following != APART)
    out[before_word] = np.where(codes[before_word] == 32, JOINED, LONE)
    marks = np.flatnonzero((codes == 39) & (out == OTHER))
    if len(marks):
        padded = np.append(codes, [0, 0])
        inside = np.append(out != APART, [False, False])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS]) & inside[marks + 1]
        long = np.zeros(len(marks), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        long &= inside[marks + 1] & inside[marks + 2]
        out[marks[short]] = SHORT
        out[marks[long]] = LONG
    return out


def word_starts(codes: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Positions where words start; separators between texts are words of their own.

    The text is cut into rows. Composing the transition functions along each row, all rows at
    once, gives each row's function; these, composed, give the state at each row's start; a
    second walk along the rows gives the state before every character.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    step, starts = _transitions()
    images, table, of_symbol = _monoid()
    symbols = _symbols(codes, separators)
    width = max(16, int(np.sqrt(n) / 4))
    rows = -(-n // width)
    grid = np.full(rows * width, APART, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    total = np.zeros(rows, np.uint16)
    for column in grid:
        total = table[total, of_symbol[column]]
    state = np.empty(rows, np.uint8)
    now = 0
    for i, f in enumerate(total.tolist()):
        state[i] = images[now][CLOSED]
        now = table[now, f]
    found = np.empty((width, rows), bool)
    for j, column in enumerate(grid):
        found[j] = starts[column, state]
        state = step[column, state]
    return np.flatnonzero(found.T.reshape(-1)[:n])


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings from a rank file, or from a tokenizer's JSON of the same kind."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return {
        bytes(byte_of[c] for c in token): rank
        for token, rank in spec["model"]["vocab"].items()
        if token not in special
    }


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the strings that a tokenizer's JSON adds beside its vocabulary; a rank file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in or depend on their surroundings")
    return {t["content"]: t["id"] for t in added}


class ByteBpe:
    """Encoder and decoder of one vocabulary; one per worker process and path."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.cache: dict[str, bytes] = {}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted(
            ((self.ranks[t[:i]] << 32) | self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        )
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs], np.int64)
        self.byte_pairs = np.array(
            [self.ranks.get(bytes([a, b]), NO_PAIR) for a in range(256) for b in range(256)],
            np.int64,
        )

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word of any length, by a heap of pairs over linked parts.

        The adjacent pair of lowest rank merges first, the leftmost on ties.
        """
        ranks, n = self.ranks, len(word)
        ends = list(range(1, n + 1))  # end of the part that starts here; 0 once merged away
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                left[end] = i
                if (r := ranks.get(word[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (before := left[i]) >= 0 and (r := ranks.get(word[before:end])) is not None:
                heapq.heappush(heap, (r, before, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words of at most ``CACHED_BYTES`` bytes, packed; all words at once.

        Every round merges each word's lowest pair, the leftmost on ties, until none is left.
        """
        out = [b""] * len(words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = self.byte_ids[raw]
        rank = np.full(len(ids), NO_PAIR, np.int64)  # of the pair that starts here
        rank[:-1] = self.byte_pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank[:-1][owner[:-1] != owner[1:]] = NO_PAIR
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            counts = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            over = least == NO_PAIR
            done = np.repeat(over, counts)
            packed, at = ids[done].astype("<u4").tobytes(), 0
            for k, n in zip(owner[first[over]].tolist(), (4 * counts[over]).tolist(), strict=True):
                out[k] = packed[at : at + n]
                at += n
            hit = np.flatnonzero((rank == np.repeat(least, counts)) & ~done)
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]
            ids[hit] = rank[hit]
            stay = ~done
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            hit = moved[hit]
            changed = np.concatenate([hit, hit[hit > 0] - 1])
            rank[changed] = self._pair_rank(ids, owner, changed)
        return out

    def _pair_rank(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pairs that start at these places; ``NO_PAIR`` where there is none."""
        after = np.minimum(at + 1, len(ids) - 1)
        keys = (ids[at] << 32) | ids[after]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        fits = (self.pair_keys[found] == keys) & (owner[at] == owner[after]) & (after > at)
        return np.where(fits, self.pair_ranks[found], NO_PAIR)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for first, past in text_chunks(texts):
            group = texts[first:past]
            joined = "\n".join(group)
            codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
            sizes = np.array([len(t) for t in group])
            separators = np.cumsum(sizes[:-1] + 1) - 1
            cuts = word_starts(codes, separators)
            edges = np.append(cuts, len(codes)).tolist()
            words = [joined[i:j] for i, j in zip(edges, edges[1:])]
            known = self._known(set(words))
            ids = [known[w] for w in words]
            # the words of a text start at its first character and end at its separator
            begins = np.searchsorted(cuts, np.concatenate([[0], separators + 1])).tolist()
            ends = np.searchsorted(cuts, np.append(separators, len(codes))).tolist()
            out += [b"".join(ids[b:e]) for b, e in zip(begins, ends, strict=True)]
        return out

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """The cache, holding these words; it is emptied first where they would overfill it."""
        missing = [w for w in words if w not in self.cache]
        if missing and len(self.cache) + len(missing) > CACHED_WORDS:
            self.cache.clear()
            missing = list(words)
        raw = [w.encode("utf-8", "replace") for w in missing]
        short = [i for i, w in enumerate(raw) if len(w) <= CACHED_BYTES]
        for i, ids in zip(short, self.merge_many([raw[i] for i in short]), strict=True):
            self.cache[missing[i]] = ids
        known, long = self.cache, [i for i, w in enumerate(raw) if len(w) > CACHED_BYTES]
        if long:
            known = self.cache | {
                missing[i]: np.array(self.merge_long(raw[i]), "<u4").tobytes() for i in long
            }
        return known

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token starts, and at last the length."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids at once: each byte is fetched at its token's place in the blob."""
        if not len(ids):
            return b""
        at = self.offsets(ids)
        source = np.repeat(self.begins[ids] - at[:-1], self.lengths[ids]) + np.arange(at[-1])
        return self.blob[source].tobytes()


@lru_cache(4)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(
    df: DataFrame, path: str, text: str = "text", out: str = "ids", columns: list[str] | None = None
) -> DataFrame:
    """``df`` (or ``columns`` of it) with the ids of every whole text, as binary column ``out``.

    Ids are little-endian unsigned 32-bit integers; strings of special tokens are ordinary text.
    A null or empty text has no ids. Repeated rows stay; an input column named ``out`` is
    replaced; an empty table gives an empty table.
    """

    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(codec(path).encode([t or "" for t in texts]), dtype=object)

    return attach(df, {out: once(ids, "binary")(F.col(f"`{text}`"))}, columns)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for, as binary column ``out``; null stays null."""

    def raw(column: pd.Series) -> pd.Series:
        one = codec(path)
        return pd.Series(
            [None if b is None else one.decode(np.frombuffer(b, "<u4")) for b in column],
            dtype=object,
        )

    return attach(df, {out: once(raw, "binary")(F.col(f"`{ids}`"))})


def round_trip(df: DataFrame, path: str, text: str = "text", columns: list[str] | None = None):
    """``df`` (or ``columns`` of it) with ``ids`` as of `encode` and ``decoded`` as of `decode`.

    Both in one Python worker, which holds one vocabulary and one batch, where the two
    operators in a row would hold two of each.
    """

    def both(texts: pd.Series) -> pd.DataFrame:
        one = codec(path)
        ids = one.encode([t or "" for t in texts])
        raw = [one.decode(np.frombuffer(b, "<u4")) for b in ids]
        return pd.DataFrame({"ids": ids, "decoded": raw}, dtype=object)

    found = attach(df, {"_t": once(both, "ids binary, decoded binary")(F.col(f"`{text}`"))}, columns)
    kept = [c for c in found.columns if c.lower() not in ("_t", "ids", "decoded")]
    return found.select(*[F.col(f"`{c}`") for c in kept], "_t.ids", "_t.decoded")


def token_offsets(df: DataFrame, path: str, ids: str = "ids", out: str = "offsets") -> DataFrame:
    """``df`` with the byte offset of each token in its text, as ``array<long>``."""

    def places(column: pd.Series) -> pd.Series:
        one = codec(path)
        return pd.Series(
            [None if b is None else one.offsets(np.frombuffer(b, "<u4"))[:-1] for b in column],
            dtype=object,
        )

    return attach(df, {out: once(places, "array<long>")(F.col(f"`{ids}`"))})
