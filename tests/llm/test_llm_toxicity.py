"""The toxicity grammar against sentences, a plain reading of its rules, and made labels."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescout.llm import toxicity as T
from tablescout.llm.frames import work_folder


def kinds(text, arcs=()):
    return [T.KINDS[k] for k, _, _ in T.clauses(text, arcs)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("You are an idiot.", ["directed_insult"]),
        ("What an idiot!", ["insult"]),
        ("You are not an idiot", ["denied"]),
        ("You are not a very nice man, idiot", ["directed_insult"]),  # the negation ends
        ("He said that the man was an idiot.", ["reported"]),
        ('"idiot" is a word', ["reported"]),
        ('a "fine" idiot', ["insult"]),
        ("I will kill you", ["directed_threat"]),
        ("kill the process", ["harm"]),
        ("I don't kill you", ["denied"]),
        ("Sie ist dumm; il dit connard", ["directed_insult", "reported"]),
        ("Idioterie idiotic strash", []),  # words, not their parts
        ("", []),
        (None, []),
    ],
)
def test_kinds_of_clauses(text, found):
    assert kinds(text) == found


def plain_kind(words, insults):
    """The same rules in one pass over words, without transducers."""
    heard, deny, told, quoted = set(), 0, False, False
    for w in words:
        what = "insult" if w in insults else "harm" if w in T.HARM else None
        if w in T.NEGATIONS:
            deny = T.DENIES_FOR
            continue
        denied, deny = deny > 0, max(0, deny - 1)
        if w == '"':
            quoted = not quoted and not told
        elif w in T.REPORTS:
            told = True
        elif what:
            heard.add(f"denied {what}" if denied else f"told {what}" if told or quoted else what)
        elif w in T.TARGETS:
            heard.add("target")
    aimed = "target" in heard
    if "insult" in heard:
        return "directed_insult" if aimed else "insult"
    if "harm" in heard:
        return "directed_threat" if aimed else "harm"
    if any(x.startswith("told") for x in heard):
        return "reported"
    return "denied" if any(x.startswith("denied") for x in heard) else None


def test_grammar_against_a_plain_reading():
    rng = random.Random(3)
    words = ["idiot", "kill", "you", "not", "said", "will", "tree", "sky", '"', "veqal"]
    for _ in range(3000):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        expected = plain_kind(clause, {"idiot", "veqal"})
        assert kinds(" ".join(clause), (("veq", False, 2.0),)) == ([expected] if expected else [])


def made(rows, seed=0):
    """Texts of nonsense words; toxic ones hold words of the stem `gruz` with many endings."""
    rng = random.Random(seed)
    parts = "ka lo mi ren tus bel ora shi pem dov".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(rows):
        words = [word() for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = "gruz" + word() if i % 16 else "tzingu"
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = made(600)
    copies = [(10_000 + i, rows[8][1], 1) for i in range(30)]  # copies prove nothing by themselves
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int")
    return T.fit(df.drop("toxic"), df.drop("text"), work_folder(spark, "toxicity"))


def test_stems_and_words_are_learned(model):
    assert {(a, whole) for a, whole, _ in model.arcs} == {("gru", False), ("tzingu", True)}


def test_held_out(spark, model):
    rows = made(400, seed=1)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in T.score(df, model).collect()}
    assert [got[i] for i, _, _ in rows] == [y for _, _, y in rows]


def test_fit_is_repeatable_where_an_id_has_two_texts(spark):
    rows = made(200)
    twice = [(i, t + " again tzingu") for i, t, _ in rows[:50]]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + twice, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    one = T.fit(df, labels, work_folder(spark, "toxicity"))
    two = T.fit(df.repartition(7).orderBy(F.rand()), labels, work_folder(spark, "toxicity"))
    assert one.arcs == two.arcs
    assert np.allclose(one.weights, two.weights)


def test_weights_lie_where_the_slope_is_none():
    rng = np.random.default_rng(2)
    rows = rng.gamma(1.0, size=(300, len(T.FEATURES)))
    labels = (rows[:, 0] + rng.normal(size=300) > 1).astype(float)
    w = T.fit_weights(rows, labels)

    def loss(w):
        p = T._score(rows, w)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum() + (
            T.FIRMNESS * (w - T.PRIOR) ** 2
        ).sum() / 2

    for k in range(len(w)):
        for d in (-1e-3, 1e-3):
            assert loss(w + d * np.eye(len(w))[k]) >= loss(w)


def test_evidence_is_the_binomial_ratio():
    p = 9 / 10
    assert T.evidence(9, 1, 0.2) == pytest.approx(
        2 * (9 * np.log(p / 0.2) + np.log((1 - p) / 0.8))
    )
    assert T.evidence(1, 9, 0.2) == 0 == T.evidence(0, 0, 0.2)


def test_odd_rows(spark):
    rows = [
        (1, None, 5, "c"), (2, "", 5, "c"), (3, "you idiot", 5, "c"), (3, "you idiot", 5, "c"),
        (None, "x" * 300_000 + " idiot you", 5, "c"), (4, "not stupid. " * 30_000, 5, "c"),
        (5, "idiot " * 50_000, 5, "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, Clauses string")
    got = T.score(df, T.ToxicityModel())
    assert got.columns == ["doc_id", "text", "score", "predicted", "clauses"]
    seen = got.collect()
    assert len(seen) == len(rows)
    by_text = {r["text"]: r for r in seen}
    assert by_text[None]["score"] == by_text[""]["score"] < T.THRESHOLD
    assert by_text["you idiot"]["predicted"] == 1
    assert by_text["not stupid. " * 30_000]["clauses"][0]["kind"] == "denied"
    assert T.score(df.limit(0), T.ToxicityModel()).collect() == []
    empty = T.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"), work_folder(spark, "t"))
    assert empty == T.ToxicityModel()


def test_features_are_sums_over_clauses():
    text = "You idiot. What trash! He said idiot."
    by_kind = {k: sum(w for kind, w, _ in T.clauses(text) if T.KINDS[kind] == k) for k in T.KINDS}
    got = np.expm1(T.features(pd.Series([text]))[0])
    assert got[: len(T.KINDS)] == pytest.approx([by_kind[k] for k in T.KINDS])
    assert len(re.findall(r"[.!]", text)) == len(T.clauses(text))
