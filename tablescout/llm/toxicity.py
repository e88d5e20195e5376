"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A word transducer turns the letters of a text into symbols: insult (with the weight of its arc),
harm, intent, target, negation, report, quote. Clause transducers are composed behind it: one
rewrites what is negated, one what is reported or quoted, one remembers which symbols it was
given; the final state says what kind of clause this was. A document is scored by the arc
weights of its clauses of each kind, never by words alone. Insults that the word lists lack,
as whole words or as stems with many endings, are learned from labelled documents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import attach, keep, once

# Word lists in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid imbecile dumb dumbass fool loser losers trash scum vermin worthless pathetic disgusting clown clowns filth parasite parasites garbage bastard bitch asshole retard coward freak pig pigs idioten dumm dummkopf arschloch abschaum trottel schwachkopf versager drecksau widerlich imbécile idiote idiotes connard salaud ordure minable crétin débile idiota idiotas estúpido estúpida imbécil basura escoria patético asqueroso payaso tonto".split()
HARM = "kill kills killing murder hurt shoot stab beat strangle hang burn destroy töten umbringen erschießen schlagen verletzen tuer frapper brûler égorger détruire matar golpear quemar disparar destruir".split()
INTENT = "will gonna going should must shall ll werde werden wirst soll sollte vais va vas devrait voy vamos vas debería".split()
TARGETS = "you your yours u ya they them those these she he du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles tú ti tus usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't nobody without nicht kein keine nie niemals pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = "said says say called calls calling claimed wrote reported quoted accused alleged sagte nannte schrieb behauptete dit appelé écrit traité dijo llamó escribió acusó".split()

CLAUSE_END = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
QUOTES = frozenset("\"“”«»„")
SYMBOLS = ["insult", "harm", "intent", "target", "negation", "report", "quote", "other"]
DENIES_FOR = 4  # words after a negation that it covers

KINDS = ["directed_insult", "insult", "directed_threat", "harm", "reported", "denied"]
FEATURES = [*KINDS, "density"]
LISTED_WEIGHT, MOST_WEIGHT = 3.0, 6.0  # of the arc of a listed word, and of any
# What the grammar says before any label was seen, and how firmly (in labelled documents).
PRIOR = np.array([-2.5, 2.0, 1.6, 2.0, 0.1, 0.5, 0.2, 0.0])
FIRMNESS = np.array([1.0] + [4.0] * len(FEATURES))
SAMPLE_ROWS = 10_000  # labelled documents that are used for fitting, about
SHORTEST_STEM, LONGEST_STEM = 3, 8
LEAST_PRECISION = 0.5  # of a learned arc: contexts of toxic documents among all of its own
THRESHOLD = 0.3


@dataclass(frozen=True)
class Transducer:
    """Reads a symbol in a state; gives the next state and a symbol."""

    start: object
    step: object  # (state, symbol) -> (state, symbol)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer whose second part reads what the first one writes."""

    def step(state, symbol):
        a, between = first.step(state[0], symbol)
        b, out = second.step(state[1], between)
        return (a, b), out

    return Transducer((first.start, second.start), step)


def _negation(left: int, symbol: str):
    if symbol == "negation":
        return DENIES_FOR, symbol
    if left and symbol in ("insult", "harm"):
        return left - 1, f"denied_{symbol}"
    return max(0, left - 1), symbol


def _report(state: str, symbol: str):
    if symbol == "quote":
        return {"plain": "quoted", "quoted": "plain"}.get(state, state), symbol
    if symbol == "report":
        return "told", symbol
    if state != "plain" and symbol in ("insult", "harm"):
        return state, f"told_{symbol}"
    return state, symbol


_HEARD = frozenset(
    "insult harm intent target denied_insult denied_harm told_insult told_harm".split()
)


def _memory(heard: frozenset, symbol: str):
    return (heard | {symbol} if symbol in _HEARD else heard), symbol


def _kind(heard: frozenset) -> int:
    """Number of the clause's kind in ``KINDS``; -1 if it says nothing."""
    if "insult" in heard:
        return 0 if "target" in heard else 1
    if "harm" in heard:
        return 2 if "target" in heard else 3
    if heard & {"told_insult", "told_harm"}:
        return 4
    return 5 if heard & {"denied_insult", "denied_harm"} else -1


@lru_cache(1)
def grammar() -> tuple[list[list[int]], list[int]]:
    """The composed clause transducer as a table: next state by (state, symbol), kind by state."""
    whole = compose(
        compose(Transducer(0, _negation), Transducer("plain", _report)),
        Transducer(frozenset(), _memory),
    )
    number, queue, table = {whole.start: 0}, [whole.start], []
    for state in queue:
        row = []
        for symbol in SYMBOLS:
            after, _ = whole.step(state, symbol)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append(number[after])
        table.append(row)
    return table, [_kind(state[1]) for state in queue]


@dataclass(frozen=True)
class ToxicityModel:
    """Learned arcs (letters, whole word or stem, weight) and the weights of the features."""

    arcs: tuple[tuple[str, bool, float], ...] = ()
    weights: tuple[float, ...] = tuple(PRIOR.tolist())


@lru_cache(2)
def _words(arcs: tuple) -> tuple[ahocorasick.Automaton, dict[str, int]]:
    """The word transducer: an automaton over letters for insults and harm, a table for the rest."""
    entries = [(w, True, SYMBOLS.index("harm"), 1.0) for w in HARM]
    entries += [(w, True, SYMBOLS.index("insult"), LISTED_WEIGHT) for w in INSULTS]
    entries += [(w, whole, SYMBOLS.index("insult"), weight) for w, whole, weight in arcs]
    by_word: dict[str, list] = {}
    for word, *rest in entries:
        by_word.setdefault(word, []).append((len(word), *rest))
    machine = ahocorasick.Automaton()
    for word, found in by_word.items():
        machine.add_word(word, found)
    machine.make_automaton()
    table = {}
    for symbol, words in (
        ("intent", INTENT), ("target", TARGETS), ("report", REPORTS), ("negation", NEGATIONS),
    ):
        table |= dict.fromkeys(words, SYMBOLS.index(symbol))
    return machine, table


def clauses(text: str | None, arcs: tuple = ()) -> list[tuple[int, float, str]]:
    """(kind, weight, clause) of each clause with an insult or harm; weight sums its arcs."""
    low = (text or "").lower()
    machine, table = _words(arcs)
    hits: dict[int, tuple[int, float]] = {}
    for end, found in machine.iter(low):
        for length, whole, symbol, weight in found:
            at = end - length + 1
            if at and low[at - 1].isalpha():
                continue
            if whole and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            if weight > hits.get(at, (0, 0.0))[1]:
                hits[at] = (symbol, weight)
    if not hits:
        return []
    ends = [m.end() for m in CLAUSE_END.finditer(low)]
    places = sorted({bisect_right(ends, at) for at in hits})
    steps, kinds = grammar()
    quote, other = SYMBOLS.index("quote"), SYMBOLS.index("other")
    out = []
    for k in places:
        first, past = ends[k - 1] if k else 0, ends[k] if k < len(ends) else len(low)
        state, total = 0, 0.0
        for m in TOKEN.finditer(low, first, past):
            word = m[0]
            if word in QUOTES:
                symbol = quote
            elif m.start() in hits:
                symbol, weight = hits[m.start()]
                total += weight
            else:
                symbol = table.get(word.replace("’", "'"), other)
            state = steps[state][symbol]
        if kinds[state] >= 0:
            out.append((kinds[state], total, low[first:past].strip()))
    return out


def features(texts: pd.Series, arcs: tuple = ()) -> np.ndarray:
    """Per text: log of 1 + the arc weights of its clauses of each kind, and of their density."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        for kind, weight, _ in clauses(text, arcs):
            out[i, kind] += weight
        total = out[i, :2].sum()
        if total:
            out[i, -1] = 100 * total / (len(text) / 6 + 10)
    return np.log1p(out)


def _score(rows: np.ndarray, weights) -> np.ndarray:
    w = np.asarray(weights)
    return 1 / (1 + np.exp(-np.clip(w[0] + rows @ w[1:], -30, 30)))


def fit_weights(rows: np.ndarray, labels: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic weights by damped Newton steps, held to the grammar's own by ``FIRMNESS``."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w = PRIOR.copy()

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - labels @ z + (FIRMNESS * (w - PRIOR) ** 2).sum() / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + FIRMNESS * (w - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(FIRMNESS)
        move, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
    return w


def evidence(toxic: float, clean: float, share: float) -> float:
    """Log-likelihood ratio of a part that is toxic more often than ``share``; else 0."""
    n = toxic + clean
    if not n or toxic / n <= share:
        return 0.0
    out = toxic * np.log(toxic / (n * share))
    return float(2 * (out + (clean * np.log(clean / (n * (1 - share))) if clean else 0)))


def learn_arcs(sample: DataFrame, folder: str) -> tuple[tuple[str, bool, float], ...]:
    """Insults of the sample (text, toxic) that the lists lack, with their weights.

    Counted are distinct (previous word, word) pairs, toxic if no clean document has them, so
    that copies and repeated passages count once. A stem must take several endings; of nested
    candidates the one of the most evidence stays. The evidence must exceed what chance yields
    among so many candidates.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    pairs = F.transform(
        F.col("tokens"),
        lambda w, i: F.struct(
            w.alias("w"), F.xxhash64(F.get(F.col("tokens"), i - 1)).alias("before")
        ),
    )
    words = (
        sample.select("toxic", tokens.alias("tokens"))
        .select("toxic", F.explode(pairs).alias("p"))
        .where(~F.col("p.w").isin(INSULTS))
        .groupBy("p.w", "p.before")
        .agg(F.min("toxic").alias("toxic"))
        .groupBy("w")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    )
    words = keep(words, folder, "words")
    totals = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not totals["t"] or not totals["c"]:
        return ()
    share = totals["t"] / (totals["t"] + totals["c"])
    length = F.length("w")
    stems = F.when(
        length > SHORTEST_STEM,
        F.transform(
            F.sequence(F.lit(SHORTEST_STEM), F.least(length - 1, F.lit(LONGEST_STEM))),
            lambda k: F.struct(F.substring(F.col("w"), F.lit(1), k).alias("a"), F.lit(False).alias("whole")),
        ),
    ).otherwise(F.array())
    parts = F.concat(stems, F.array(F.struct(F.col("w").alias("a"), F.lit(True).alias("whole"))))
    counted = (
        words.select("t", "c", F.explode(parts).alias("e"))
        .groupBy("e.a", "e.whole")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.max("t").alias("most"))
    )
    tried = counted.count()
    least = 2 * np.log(max(1, tried)) + 10
    # The least count that could carry that evidence; what is left is a small part of the sample.
    fewest = int(least / (2 * np.log(1 / share)))
    rows = counted.where(
        (F.col("t") >= fewest)
        & (F.col("t") >= LEAST_PRECISION * (F.col("t") + F.col("c")))
        & (F.col("whole") | (F.col("most") <= 0.5 * F.col("t")))
    ).collect()
    strong = [(evidence(r["t"], r["c"], share), r) for r in rows]
    strong = sorted((x for x in strong if x[0] > least), key=lambda x: (-x[0], x[1]["a"], x[1]["whole"]))
    chosen: list = []
    for _, r in strong:
        a, whole = r["a"], r["whole"]
        inside = any((a.startswith(b) if not w else a == b) or (b.startswith(a) and not whole) for b, w, _ in chosen)
        if not inside:
            odds = np.log((r["t"] + 0.5) / (totals["t"] + 1)) - np.log((r["c"] + 0.5) / (totals["c"] + 1))
            chosen.append((a, whole, float(np.clip(odds, 0.1, MOST_WEIGHT))))
    return tuple(sorted(chosen))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    folder: str,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Arcs and weights from about ``sample`` labelled documents, drawn by a hash of their ids.

    Labels other than 0 and 1, and null ids, are not used; an id with several labels counts as
    toxic if one is, one with several texts by that of the smallest hash. Without labels of both
    kinds the model is the grammar's own. Only features and learned arcs reach the driver.
    """
    given = labels.select(F.col(f"`{id}`").alias("_i"), F.col(f"`{label}`").alias("_y")).where(
        "_i is not null and _y in (0, 1)"
    )
    whole = 1 << 30
    part = int(whole * min(1.0, sample / max(1, given.count())))
    drawn = given.where(F.pmod(F.xxhash64("_i"), F.lit(whole)) <= part)
    drawn = drawn.groupBy("_i").agg(F.max("_y").alias("toxic"))
    rows = (
        docs.select(F.col(f"`{id}`").alias("_i"), F.col(f"`{text}`").alias("_t"))
        # About ``sample`` rows of an id and a label: a bound that does not grow with the corpus.
        .join(F.broadcast(drawn), "_i")
        .groupBy("_i")
        .agg(F.max("toxic").alias("toxic"), F.min_by("_t", F.xxhash64("_t")).alias("text"))
    )
    rows = keep(rows, folder, "sample")
    arcs = learn_arcs(rows, folder)
    measure = once(lambda t: pd.Series(list(features(t, arcs))), "array<double>")
    seen = rows.select("toxic", measure("text").alias("f")).toPandas()
    if seen["toxic"].nunique() < 2:
        return ToxicityModel(arcs)
    weights = fit_weights(np.stack(seen["f"].to_list()), seen["toxic"].to_numpy(float))
    return ToxicityModel(arcs, tuple(weights.tolist()))


RESULTS = {
    "score": "double",
    "predicted": "int",
    "clauses": "array<struct<kind:string,weight:double,clause:string>>",
}


def score(
    df: DataFrame,
    model: ToxicityModel,
    text: str = "text",
    columns: list[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``df`` (or ``columns`` of it) with score, predicted (1 from ``threshold`` on) and clauses.

    ``clauses`` holds the matched clauses, lower-cased, with kind and weight. Every whole text
    is scored; a null one as an empty one, which has no clauses. Input columns of the result
    names are replaced; repeated rows stay; an empty table gives an empty table.
    """

    def judged(texts: pd.Series) -> pd.DataFrame:
        scores = _score(features(texts, model.arcs), model.weights)
        return pd.DataFrame(
            {
                "score": scores,
                "predicted": (scores >= threshold).astype("int32"),
                "clauses": [
                    [{"kind": KINDS[k], "weight": w, "clause": c} for k, w, c in clauses(t, model.arcs)]
                    for t in texts
                ],
            }
        )

    kind = ", ".join(f"{k} {v}" for k, v in RESULTS.items())
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in RESULTS]
    held = attach(df, {"_v": once(judged, kind)(F.col(f"`{text}`"))}, kept)
    return held.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_v.{c}").alias(c) for c in RESULTS])
