"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
estimates how far to trust each, and a logistic span classifier is trained on the outcome."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import attach, once

KINDS = ["email", "ip", "card", "phone", "secret", "name"]  # the first four have base rules
BASE_KINDS = 4
EMAIL, IP, CARD, PHONE, SECRET, NAME = range(6)
CONTEXT = 40  # characters before a span in which context words are looked for
ROUNDS = 50  # of expectation-maximisation
LABELERS = ["rule", "check", "context", "gazetteer", "edges", "variety"]

# Gazetteers and context words.
TOP_DOMAINS = set("com org net edu gov mil int io info biz de fr es it nl uk us eu ch at be se no pl pt ca au jp cn in br mx dev app".split())
GIVEN_NAMES = set("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna maria jose carlos luis juan pierre jean marie claude hans peter klaus ursula".split())
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "5", "6", "7", "8", "9")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38", "22", "23", "24", "25", "26", "27")
FOR_WORDS = {
    EMAIL: "mail email e-mail contact write courriel correo".split(),
    IP: "ip address host server from login addr client".split(),
    CARD: "card visa mastercard amex credit payment karte tarjeta carte".split(),
    PHONE: "phone tel call mobile fax cell telefon teléfono whatsapp".split(),
    SECRET: "token key secret password passwd apikey bearer credential auth".split(),
    NAME: "name by from dear author signed contact".split(),
}
AGAINST_WORDS = "version ver isbn issn doi section figure fig chapter page release build rev revision".split()

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
PART = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
INTERNATIONAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])")
HIDDEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?[\[(](?:at|AT)[\])][ ]?[A-Za-z0-9-]{1,63}(?:[ ]?[\[(](?:dot|DOT)[\])][ ]?[A-Za-z0-9-]{1,63}){1,4}")
HEXES = re.compile(r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])")
KEYS = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}(?![A-Za-z0-9_/+-])")
SEGMENT = re.compile(r"[A-Za-z0-9]{12,}")
NAMES = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? (?:[^\W\d_a-z][^\W\d_]{1,20} ){0,2}[^\W\d_a-z][^\W\d_]{1,20}|\b(?:" + "|".join(x.title() for x in sorted(GIVEN_NAMES)) + r") [A-Z][^\W\d_]{1,20}\b")
WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    total = sum(map(int, digits[-1::-2])) + sum(int(doubled[int(d)]) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    """Matches of local part, at sign and dotted domain, leftmost first; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    """Runs of four numbers joined by dots, taken one after the other; and whether each fits."""
    for chain in DOTTED.finditer(text):
        parts = list(PART.finditer(chain[0]))
        for i in range(0, len(parts) - 3, 4):
            fits = all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[i : i + 4])
            yield chain.start() + parts[i].start(), chain.start() + parts[i + 3].end(), fits


def _random_looking(span: str) -> bool:
    """Whether a long run of letters and digits mixes these, or cases inside; slugs, paths and
    joined words do not."""
    return any(
        (re.search("[0-9]", run) and re.search("[A-Za-z]", run))
        or re.search("[a-z][A-Z]{2}", run)
        for run in SEGMENT.findall(span)
    )


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the base rules, in order; failing matches are left out."""
    found = [(a, EMAIL, b) for a, b in _emails(text)]
    found += [(a, IP, b) for a, b, fits in _addresses(text) if fits]
    for m in DIGITS.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    if "+" in text:
        found += [
            (m.start(), PHONE, m.end())
            for m in INTERNATIONAL.finditer(text)
            if 9 <= len(_digits(m[0])) <= 15
        ]
    return sorted(found)


def candidate_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base): base spans, and looser ones that overlap none of them.

    Looser ones may overlap each other; `spans` chooses among those that are accepted.
    """
    base = base_spans(text)
    loose: list[tuple[int, int, int]] = []
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        loose += [(m.start(), EMAIL, m.end()) for m in HIDDEN_EMAIL.finditer(text)]
    if text.count(":") >= 7:
        loose += [(m.start(), IP, m.end()) for m in HEXES.finditer(text)]
    for m in DIGITS.finditer(text):
        if 13 <= len(_digits(m[0])) <= 19:
            loose.append((m.start(), CARD, m.end()))
    loose += [(m.start(), PHONE, m.end()) for m in NATIONAL.finditer(text)]
    for m in KEYS.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            loose.append((m.start(), SECRET, m.end()))
    loose += [(m.start(), NAME, m.end()) for m in NAMES.finditer(text)]
    taken = [(a, b) for a, _, b in base]
    out = [(a, k, b, True) for a, k, b in base]
    i = 0
    taken.sort()
    for a, k, b in sorted(loose):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, k, b, False))
    return sorted(out)


def votes(text: str, start: int, kind: int, end: int, base: bool) -> list[int]:
    """What each labeler says of a span: 1 for, -1 against, 0 abstains."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - CONTEXT) : start].lower()
    near = set(WORD.findall(before))
    check = 0
    if kind == CARD:
        check = 1 if luhn(digits) else -1
    elif kind == PHONE:
        check = 1 if 10 <= len(digits) <= 15 else -1
    elif kind == IP:
        check = 1 if base or span.count(":") == 7 else -1
    elif kind == SECRET:
        # a path after a host name is part of an address
        path = "/" in span and (span.startswith("//") or text[max(0, start - 1) : start] == ".")
        check = 1 if len(set(span)) >= 10 and _random_looking(span) and not path else -1
    gazetteer = 0
    if kind == EMAIL:
        gazetteer = 1 if re.split(r"\W+", span.lower().strip(")]"))[-1] in TOP_DOMAINS else -1
    elif kind == CARD:
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif kind == PHONE and span.startswith("+"):
        gazetteer = 1 if digits.startswith(COUNTRY_CODES) else -1
    elif kind == IP and base:
        gazetteer = 1 if 0 < int(span.split(".")[0]) < 240 else -1
    elif kind == NAME:
        gazetteer = 1 if GIVEN_NAMES & set(span.lower().split()) else 0
    context = 1 if near & set(FOR_WORDS[kind]) else -1 if near & set(AGAINST_WORDS) else 0
    joined = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    variety = 0
    if kind == SECRET:
        variety = 1 if _random_looking(span) else -1
    elif kind != NAME:
        variety = -1 if len(set(digits)) <= 2 and len(digits) >= 9 else 1
    return [1 if base else 0, check, context, gazetteer, -1 if joined else 1, variety]


def features(text: str, start: int, kind: int, end: int, base: bool) -> int:
    """Votes, kind and length class of a span as one number: the classifier's input."""
    code = 0
    for v in votes(text, start, kind, end, base):
        code = code * 3 + v + 1
    size = min(3, (end - start).bit_length() - 3) if end - start >= 8 else 0
    return (code * len(KINDS) + kind) * 4 + size


def _decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, rest = codes % 4, codes // 4
    kind, rest = rest % len(KINDS), rest // len(KINDS)
    table = np.empty((len(codes), len(LABELERS)), np.int64)
    for j in range(len(LABELERS) - 1, -1, -1):
        table[:, j], rest = rest % 3 - 1, rest // 3
    return table, kind, size


def _inputs(codes: np.ndarray) -> np.ndarray:
    """One column for each vote of each labeler, kind and length class, and a constant."""
    table, kind, size = _decoded(codes)
    blocks = [table == 1, table == -1, np.eye(len(KINDS))[kind], np.eye(4)[size]]
    return np.column_stack([*(b.astype(float) for b in blocks), np.ones(len(codes))])


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier; reliabilities of the labelers as (labeler, kind of vote
    given the truth), for inspection."""

    weights: tuple[float, ...]
    reliability: tuple[tuple[str, float], ...]
    threshold: float = 0.5

    def accepts(self, codes: list[int]) -> list[bool]:
        if not codes:
            return []
        margin = _inputs(np.array(codes, np.int64)) @ np.array(self.weights)
        return (margin >= np.log(self.threshold / (1 - self.threshold))).tolist()


def train(patterns: np.ndarray, counts: np.ndarray) -> SpanModel:
    """Model from how often each feature pattern occurs; with no pattern it accepts nothing.

    The labelers' votes are taken as independent given the truth. Expectation-maximisation
    starts from the majority of votes; every estimate has one span of each sort added, so that
    nothing is impossible. The classifier is then fitted to the probabilities found.
    """
    width = _inputs(np.zeros(1, np.int64)).shape[1]
    if not len(patterns):
        return SpanModel((*[0.0] * (width - 1), -10.0), ())
    table, kind, _ = _decoded(patterns)
    n = counts.astype(float)
    truth = 1 / (1 + np.exp(-1.5 * table.sum(axis=1)))
    chances = np.zeros((2, len(LABELERS), 3))
    for _ in range(ROUNDS):
        weight = np.stack([n * (1 - truth), n * truth])
        prior = np.stack(
            [[w[kind == k].sum() + 1.0 for k in range(len(KINDS))] for w in weight]
        )
        prior /= prior.sum(axis=0)
        for y in (0, 1):
            for j in range(len(LABELERS)):
                heard = np.array([weight[y][table[:, j] == v].sum() for v in (-1, 0, 1)]) + 1.0
                # an honest labeler: for a true span a vote for is likelier than one against
                if (heard[2] < heard[0]) == (y == 1) and heard[0] != heard[2]:
                    heard[[0, 2]] = (heard[0] + heard[2]) / 2
                chances[y, j] = heard / heard.sum()
        logs = np.log(prior[:, kind])
        for j in range(len(LABELERS)):
            logs += np.log(chances[:, j, table[:, j] + 1])
        truth = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    x = _inputs(patterns)
    weights = np.zeros(width)
    share = n / n.sum()
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (truth - p)) - 1e-4 * weights
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(width)
        weights = weights + np.clip(np.linalg.solve(bend, slope), -2, 2)
    said = [
        (name, float(chances[1, j, 2] / (chances[1, j, 2] + chances[0, j, 2])))
        for j, name in enumerate(LABELERS)
    ]
    return SpanModel(tuple(weights.tolist()), tuple(said))


def fit(df: DataFrame, text: str = "text") -> SpanModel:
    """Model from the candidate spans of all texts; the driver gets one count per pattern.

    Patterns are a few thousand at most, whatever the data: 3 votes of 6 labelers, 6 kinds and
    4 length classes.
    """

    def codes(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[features(t, *c) for c in candidate_spans(t)] if t else [] for t in texts],
            dtype=object,
        )

    seen = (
        df.select(F.explode(once(codes, "array<long>")(F.col(f"`{text}`"))).alias("code"))
        .groupBy("code")
        .count()
        .orderBy("code")
        .toPandas()
    )
    return train(seen["code"].to_numpy(np.int64), seen["count"].to_numpy(np.int64))


def spans(text: str | None, model: SpanModel) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of a text: all base spans, and those the classifier accepts.

    Of overlapping accepted ones the earlier, then the kind listed first, stands.
    """
    found = candidate_spans(text) if text else []
    said = model.accepts([features(text, *c) for c in found])
    out, ends = [], 0
    for (start, kind, end, base), yes in zip(found, said, strict=True):
        if base:
            out.append((start, kind, end, base))
        elif yes and start >= ends:
            out.append((start, kind, end, base))
            ends = end
    return out


def redacted(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind; of overlapping ones the outer range."""
    out, done = [], 0
    for start, kind, end, _ in sorted(found):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


RESULTS = {
    "pii": "array<struct<kind:string,start:int,end:int,base:boolean>>",
    "redacted": "string",
}


def detect(
    df: DataFrame,
    model: SpanModel,
    text: str = "text",
    columns: list[str] | None = None,
    redact: bool = True,
) -> DataFrame:
    """``df`` (or ``columns`` of it) with ``pii``, the spans of every whole text in code points
    by start and then kind, and ``redacted``, the text with them replaced.

    A null text has no span and stays null. Spans may overlap only where base rules of several
    kinds do. Input columns of the result names are replaced; repeated rows stay.
    """

    def found(texts: pd.Series) -> pd.DataFrame:
        all_spans = [spans(t, model) for t in texts]
        listed = [
            [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in one]
            for one in all_spans
        ]
        clean = [
            redacted(t, one) if redact and t and one else t if redact else None
            for t, one in zip(texts, all_spans, strict=True)
        ]
        return pd.DataFrame({"pii": listed, "redacted": clean}, dtype=object)

    kind = ", ".join(f"{k} {v}" for k, v in RESULTS.items())
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in RESULTS]
    held = attach(df, {"_v": once(found, kind)(F.col(f"`{text}`"))}, kept)
    return held.select(*[F.col(f"`{c}`") for c in kept], "_v.pii", "_v.redacted")
