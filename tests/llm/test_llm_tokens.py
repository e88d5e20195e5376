"""Byte-level BPE and packing against the public libraries and brute force."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from tablescout.llm import byte_bpe, packing, queries
from tablescout.llm.frames import work_folder

RANKS = path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n", "a", "don't we'll 'tis ''s x're'", "  two  spaces \t\n tab",
    "1½²三 ٣", "é ñ 日本語 🎉🎉", "Ᲊ\U00010d40", "a" * 3000, " " * 3000, "ab" * 9000,
    "<|endoftext|> x", "don't we'll 'tis ''s x're'",
]


def ids(raw):
    return np.frombuffer(bytes(raw), "<u4").tolist()


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.load_ranks(RANKS)
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(reference):
    draw = random.Random(5)
    letters = "ab'stremvld  \n\t é1²_-!日🎉'''　 LS"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 80))) for _ in range(4000)]
    got = byte_bpe.codec(RANKS).encode(texts)
    assert [ids(g) for g in got] == [reference.encode_ordinary(t) for t in texts]


def test_small_cache_and_chunks(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_WORDS", 3)
    texts = ["one two three four", "", "five six", "one two"] * 3
    got = byte_bpe.ByteBpe(RANKS).encode(texts)
    assert [ids(g) for g in got] == [reference.encode_ordinary(t) for t in texts]


def test_both_vocabulary_files_agree():
    assert byte_bpe.load_ranks(RANKS) == byte_bpe.load_ranks(path("byte_bpe_50k.json"))


def test_encode_decode(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    found = byte_bpe.token_offsets(byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS), RANKS)
    rows = found.collect()
    assert found.columns == ["doc_id", "text", "ids", "decoded", "offsets"]
    assert len(rows) == len(ODD) + 1
    for r in rows:
        text = r["text"] or ""
        assert ids(r["ids"]) == reference.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        assert len(r["offsets"]) == len(ids(r["ids"]))
    assert byte_bpe.round_trip(df.limit(0), RANKS).count() == 0
    both = byte_bpe.round_trip(df, RANKS, columns=["doc_id"]).collect()
    assert {bytes(r["decoded"]) for r in both} == {(t or "").encode() for t in ODD}


def test_pieces_match_the_tokenizer(spark):
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    pieces = packing.token_pieces(df, path("byte_bpe_50k.json"), 16, 2, ["doc_id"]).collect()
    by_doc = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc) == len(ODD)
    for i, text in enumerate(ODD):
        whole = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for r in by_doc[i] for x in ids(r["ids"])] == whole
        at = 0
        for r in by_doc[i]:
            assert (r["start"], r["length"]) == (at, len(ids(r["ids"])))
            at += r["length"]
        assert all(r["length"] == 16 for r in by_doc[i][1:])
        assert len(by_doc[i]) == -(-len(whole) // 16)


def test_added_tokens_match_the_tokenizers_default(spark):
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    draw = random.Random(9)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "b's", "é", "日", "1"]
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", None]
    texts += ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {
        i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)
    }
    assert whole[0] == [64, 220, 50256, 275, 2]
    pieces = packing.token_pieces(df, path("byte_bpe_50k.json"), 1024, 2, ["doc_id"], added=True)
    assert {r["doc_id"]: ids(r["ids"]) for r in pieces.collect()} == whole
    packed = queries.packed(df).collect()
    assert {r["doc_id"]: r["length"] for r in packed} == {i: len(x) for i, x in whole.items()}
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["doc_id"]], "<u4").tobytes())


def least(lengths, capacity):
    """Fewest sequences, by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(lengths):
            best = len(loads)
            return
        for k in {v: k for k, v in enumerate(loads)}.values():
            if loads[k] + lengths[i] <= capacity:
                place(i + 1, [*loads[:k], loads[k] + lengths[i], *loads[k + 1 :]])
        place(i + 1, [*loads, lengths[i]])

    place(0, [])
    return best


def test_plan_uses_up_all_and_is_near_the_least():
    draw = random.Random(3)
    over = 0
    for _ in range(120):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(1, 9))]
        plan = packing.packing_plan(Counter(lengths), 12)
        used = Counter()
        for pattern, many in plan:
            assert many > 0 and sum(pattern) <= 12
            for x in pattern:
                used[x] += many
        assert used == Counter(lengths)
        over += sum(m for _, m in plan) - least(lengths, 12)
    assert over <= 3
    assert packing.packing_plan({}, 12) == []


def test_plan_goes_on_where_a_part_is_not_there_twice():
    plan = packing.packing_plan({1000: 1, 10: 1, 9: 1, 8: 1, 7: 1}, 1024)
    assert ((1000, 9, 8, 7), 1) in plan and len(plan) == 2


def test_sums_are_indexed_and_counts_respected():
    for parts in (1, 2, 3):
        draw = random.Random(parts)
        for _ in range(150):
            free = np.array([0] + [draw.choice([0, 0, 1, 2]) for _ in range(12)] + [0] * 20)
            there = np.flatnonzero(free)
            index = packing.SumIndex(there, 20)
            total = draw.randint(1, 20)
            every = {c for c in itertools.combinations_with_replacement(there.tolist(), parts) if sum(c) == total}
            assert {tuple(sorted(c)) for c in index.of(total, parts).tolist()} == every
            assert len(index.of(total, parts)) == len(every)
            # Nothing that fills a gap exactly is left undone, and nothing is used twice.
            left, plan = free.copy(), []
            packing._exact(left, 20, range(19, 0, -1), index, parts, plan)
            assert (left >= 0).all() and all(sum(p) == 20 and n > 0 for p, n in plan)
            rest = [int(x) for x in np.repeat(np.arange(len(left)), left)]
            assert not any(sum(c) == 20 for c in itertools.combinations(rest, parts + 1))
            used = Counter(x for p, n in plan for x in p * n)
            assert all(used[x] + left[x] == free[x] for x in range(len(free)))


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_IN_BUCKET", 3)
    lengths = [5] * 500 + [11] * 200 + list(range(1, 17)) * 9
    rows = [(i, n, "a") for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "k long, length long, Offset string")
    found = packing.pack(df, 16, work_folder(spark, "t"))
    assert found.columns == ["k", "length", "sequence_id", "offset"]
    rows = found.collect()
    assert sorted(r["k"] for r in rows) == list(range(len(lengths)))
    places = {}
    for r in rows:
        assert r["length"] == lengths[r["k"]]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for one in places.values():
        at = 0
        for offset, n in sorted(one):
            assert offset == at
            at += n
        assert at <= 16
    assert len(places) <= -(-sum(lengths) // 16) + 60
    assert packing.pack(df.limit(0), 16, work_folder(spark, "t")).count() == 0
