"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) are matched leftmost and without overlap,
each kind on its own, over whole texts. Wider candidates (number groups, spelled
out addresses) get votes of six labelers: a strict pattern, the shape of the
groups, a checksum or range, a gazetteer, and words before the span that speak
for or against. How often each pattern of votes and features occurs is counted
over all documents by grouped aggregation; expectation-maximisation on these
counts estimates how reliable each labeler is for either class, and its
posteriors train the final span classifier, a logistic model on the span's
features. Base spans stay; other candidates are added where the classifier
reaches ``threshold`` and no base span overlaps.

The table of counts has at most (vote patterns) x (feature patterns) rows, some
hundred thousand by construction, whatever the corpus.

Edge cases: null and empty texts have no span; runs of digits of any length are
handled in linear time; repeated rows count each; clashing extra columns aren't
read; without candidates no span is added; an empty table gives an empty result.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

KINDS = ("email", "ip", "card", "phone", "address", "number")
BASE = 4
THRESHOLD = 0.9

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole, so a run that fails is not tried again from its middle.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Groups of digits by their usual shapes first, so that a telephone number and a card side by side stay two.
_NUMBER = re.compile(
    r"(?<![0-9A-Za-z+])(?:"
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,3}"
    r"|(?:[0-9]{4}[ -]){3}[0-9]{1,7}"
    r"|[0-9]{13,19}"
    r"|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
    r"|\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,14}"
    r")(?![0-9A-Za-z])"
)
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,5}", re.I)
_LABELS = re.compile(r"[^a-z0-9-]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Words that announce personal data, in English, German, French and Spanish.
FOR = (
    "phone", "mobile", "call", "tel", "fax", "whatsapp", "contact", "email", "e-mail", "mail", "card", "credit", "visa",
    "mastercard", "iban", "account", "ssn", "social security", "passport", "telefon", "handy", "anruf", "kontakt", "karte",
    "konto", "ausweis", "téléphone", "portable", "appelez", "carte", "compte", "passeport", "teléfono", "móvil", "llame",
    "tarjeta", "cuenta", "pasaporte", "correo",
)
# Words that announce other numbers.
AGAINST = (
    "version", "page", "section", "chapter", "isbn", "issn", "order", "invoice", "total", "price", "build", "release",
    "seite", "kapitel", "preis", "rechnung", "chapitre", "prix", "facture", "página", "capítulo", "precio", "factura",
)
# First digits of payment cards.
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
# Common ends of mail domains.
MAIL_SUFFIXES = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
_FOR = re.compile(r"\b(?:" + "|".join(map(re.escape, FOR)) + r")\b", re.I)
_AGAINST = re.compile(r"\b(?:" + "|".join(map(re.escape, AGAINST)) + r")\b|[$€%#]\s*\Z", re.I)
_SHAPES_FOR = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}|0[0-9](?:[ .][0-9]{2}){4}")
_SHAPES_AGAINST = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}(?:[ -].*)?|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}|[0-9]{1,3}(?:[. ][0-9]{3}){2,}|(?:[0-9]{1,2}\.){3,}[0-9]*|([0-9])\1{6,}|(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)[0-9]{2}")
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        else:
            # What has been passed can't begin a later match: it would have to hold this sign.
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Wider spans that overlap no base span, then each other's earlier; ``base`` is in order."""
    found = [(m.start(), 5, m.end()) for m in _NUMBER.finditer(text)]
    if "(" in text or "[" in text:
        found = sorted(found + [(m.start(), 4, m.end()) for m in _ADDRESS.finditer(text)])
    # One pass over both: how far the base spans reach that begin before a candidate's end.
    out, at, reach, last = [], 0, 0, 0
    for a, k, b in found:
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a and last <= a:
            out.append((a, k, b))
            last = b
    return out


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """Of each labeler: 2 for, 0 against, 1 none."""
    start, kind, end = span
    value, before = text[start:end], text[max(0, start - WINDOW) : start]
    digits = _NOT_DIGIT.sub("", value)
    strict = 2 if kind < BASE else 1
    shape = 1
    if kind in (2, 3, 5):
        shape = 0 if _SHAPES_AGAINST.fullmatch(value) else 2 if _SHAPES_FOR.search(value) else 1
    elif kind in (0, 4):
        shape = 2 if _LABELS.split(value.lower())[-1][-1:].isalpha() else 0
    check = 1
    if kind in (2, 5) and 13 <= len(digits) <= 19:
        check = 2 if luhn(digits) else 0
    elif kind == 1:
        check = 0 if digits.strip("0") == "" or value.startswith(("0.", "127.")) else 2
    gazetteer = 1
    if kind in (0, 4):
        gazetteer = 2 if _LABELS.split(value.lower())[-1] in MAIL_SUFFIXES else 1
    elif kind in (2, 5) and len(digits) >= 13:
        gazetteer = 2 if digits.startswith(CARD_PREFIXES) else 0
    elif kind == 3:
        gazetteer = 0 if value[1] == "0" else 2
    return strict, shape, check, gazetteer, 2 if _FOR.search(before) else 1, 0 if _AGAINST.search(before) else 1


LABELERS = 6


def span_features(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """Kind, digits (capped), separators (capped), what stands before and after."""
    start, kind, end = span
    value = text[start:end]
    digits = sum(c.isdigit() for c in value)
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return kind, min(digits, 20) // 3, min(len(value) - digits, 7), side(text[start - 1 : start]), side(text[end : end + 1])


SIZES = (len(KINDS), 7, 8, 4, 4)


def one_hot(features, vote) -> np.ndarray:
    """The classifier's input: bias, features, and what all labelers but the strict patterns see."""
    out = np.zeros(1 + sum(SIZES) + 3 * (LABELERS - 1))
    out[0], at = 1, 1
    for f, n in zip(features, SIZES, strict=True):
        out[at + f] = 1
        at += n
    for k, v in enumerate(vote[1:LABELERS]):
        out[at + 3 * k + v] = 1
    return out


#: Kinds whose labelers look at the same things share their reliabilities.
FAMILY = (0, 1, 2, 2, 0, 2)


BELIEF = 20.0


def estimate(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, table[class, labeler, vote], prior) by expectation-maximisation.

    It starts from labelers that are right six times in seven when they vote, and
    counts that belief as ``BELIEF`` candidates of either class, whatever their
    number: labelers that hardly vote stay sane, and the rest is estimated.
    Patterns of ``known`` are of the class whatever the votes. The first labeler, the
    strict pattern, only ever knows what is known, so its silence is no evidence.
    """
    known = np.zeros(len(counts), dtype=bool) if known is None else known
    belief = np.empty((2, LABELERS, 3))
    belief[1] = [0.05, 0.65, 0.30]
    belief[0] = [0.30, 0.65, 0.05]
    belief[:, 0] = [[0.05, 0.9, 0.05], [0.01, 0.45, 0.54]]
    table, prior = belief.copy(), 0.5
    post = np.full(len(counts), prior)
    heard = np.ones(patterns.shape, dtype=bool)
    heard[:, 0] = patterns[:, 0] != 1
    for _ in range(rounds):
        logs = np.log(np.array([1 - prior, prior]))[:, None] + sum(heard[:, k] * np.log(table[:, k, patterns[:, k]]) for k in range(LABELERS))
        new = np.where(known, 1.0, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))
        for c, weight in ((1, counts * new), (0, counts * (1 - new))):
            for k in range(LABELERS):
                got = np.bincount(patterns[:, k], weights=weight, minlength=3) + BELIEF * belief[c, k]
                table[c, k] = got / got.sum()
        prior = float(np.clip((counts @ new + 5) / (counts.sum() + 10), 1e-4, 1 - 1e-4))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return new, table, prior


def fit(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (counts * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (counts * (soft - p)) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    reliabilities: dict
    """By family: votes given the class, and how often the class holds."""


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
OBSERVED = (
    "doc_id bigint, base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,kind:int,end:int>>, patterns array<array<int>>"
)


def _observed(batches):
    for batch in batches:
        bases, others, patterns = [], [], []
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            base = base_spans(text)
            more = candidates(text, base)
            bases.append(base)
            others.append(more)
            patterns.append([votes(text, s) + span_features(text, s) for s in (*base, *more)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bases, _SPANS), pa.array(others, _SPANS), pa.array(patterns, pa.list_(pa.list_(pa.int32())))],
            ["doc_id", "base", "more", "patterns"],
        )


def observe(docs: DataFrame) -> DataFrame:
    """Base spans, candidates, and the votes and features of both, from one pass over the texts; a written table."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialize(narrow.mapInArrow(_observed, OBSERVED), "observed")


def fitted(observed: DataFrame) -> Model | None:
    """A model of all observed candidates; None if there are none."""
    found = observed.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    rows = sorted((tuple(r["pattern"]), r["n"]) for r in found.collect())
    if not rows:
        return None
    patterns, counts = np.array([r[0][:LABELERS] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    family = np.array([FAMILY[r[0][LABELERS]] for r in rows])
    post, reliabilities = np.zeros(len(rows)), {}
    for f in np.unique(family).tolist():
        own = family == f
        # Base spans are what the base patterns say they are.
        post[own], *reliabilities[f] = estimate(patterns[own], counts[own], known=patterns[own, 0] == 2)
    x = np.stack([one_hot(r[0][LABELERS:], r[0]) for r in rows])
    return Model(fit(x, post, counts), reliabilities)


def decided(observed: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (kind:start:end, comma-joined)."""
    weights = None if model is None else model.weights

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches):
        known: dict = {}

        def added(pattern):
            key = tuple(pattern)
            if key not in known:
                known[key] = 1 / (1 + np.exp(-np.clip(one_hot(key[LABELERS:], key) @ weights, -30, 30))) >= threshold
            return known[key]

        for batch in batches:
            counts = np.zeros((BASE, batch.num_rows), dtype=np.int64)
            bases, alls = [], []
            for i, (base, more, patterns) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                base, more = ([(s["start"], s["kind"], s["end"]) for s in spans] for spans in (base, more))
                for _, k, _ in base:
                    counts[k, i] += 1
                if weights is None:
                    more = []
                more = [s for s, p in zip(more, patterns[len(base) :], strict=False) if added(p)]
                bases.append(joined(base))
                alls.append(joined(sorted([*base, *more])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array(bases, pa.string()), pa.array(alls, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
            )

    return observed.mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"
    )


def train(docs: DataFrame) -> Model | None:
    """A model of all documents' candidates; None if there are none."""
    return fitted(observe(docs))


def find(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of ``docs`` under a model, as :func:`decided` returns them."""
    return decided(observe(docs), model, threshold)


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of ``docs`` under a model of its own candidates; the texts are read once."""
    observed = observe(docs)
    return decided(observed, fitted(observed), threshold)
