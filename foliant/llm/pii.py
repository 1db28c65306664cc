"""Personal data by weak supervision.

Exact patterns give the base spans. Beyond them, looser patterns propose candidates (addresses
spelled out, numbers with other separators, numbers without a country code), and five labelers
vote yes, no or nothing on each: a strict pattern, a validator, a gazetteer, the words before and
the shape. No labeler is trusted as such: expectation-maximisation over the counts of vote patterns
of the whole corpus estimates how often each is right, and a logistic span classifier is trained
on the posteriors, weighted by those counts. A candidate becomes a span if the classifier
is sure. Base spans always stay, and they are among the items the reliabilities are learnt from.

The corpus is read twice: for the counts, whose number is bounded by labelers and shapes, and
for the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import field, kept_in_worker, slices, text_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "valid", "gazetteer", "context", "shape")
SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Loose patterns; every repeat is bounded, so a long text costs no more than its length.
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)"
_AT = re.compile(r"[\[({]\x20?(?:at|@)\x20?[\])}]", re.I)  # with a plain " at ", all that the address pattern can hang on
_LOOSE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:\x20?[\[({{]\x20?(?:at|@)\x20?[\])}}]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?\[\.\]\x20?|\x20\.\x20|\.)[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_]|\x20{2})[0-9]{4}(?:[./_]|\x20{2})[0-9]{4}(?:[./_]|\x20{2})[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}|[0-9]{3}[-.\x20][0-9]{3}[-.\x20][0-9]{4}|00[1-9][0-9]{8,12})(?![0-9-])"),
}
# Words that announce each kind, words that deny it, and frequent top-level domains.
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write to|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|from|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|paid)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)\b", re.I),
}
_DENIALS = re.compile(r"(?:\bversion|\bv|\brelease|\bisbn|\border|\binvoice|\bsection|[#$€£=/])[\s:.]*$", re.I)
_TLDS = frozenset("com net org edu gov mil int info biz io co uk de fr es it nl be ch at eu us ca au nz jp cn in br mx ru pl se no fi dk pt gr ie cz hu ro tr za kr sg hk dev app me tv".split())


def luhn(digits: str) -> bool:
    doubled = str.maketrans("0123456789", "0246813579")
    return sum(map(int, digits[-1::-2] + digits[-2::-2].translate(doubled))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the exact patterns, by kind and start, in code points."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose matches that touch no base span, nor each other."""
    out: list[tuple[str, int, int]] = []
    digits = _DIGIT.search(text)
    spelled = " at " in text.lower() or (("(" in text or "[" in text or "{" in text) and _AT.search(text))
    for kind, pattern in _LOOSE.items():
        if not (spelled if kind == "email" else digits):
            continue
        for m in pattern.finditer(text):
            if kind == "email" and not re.search(r"dot|\.|@", m[0], re.I):
                continue
            if all(m.end() <= s or e <= m.start() for _, s, e in [*base, *out]):
                out.append((kind, *m.span()))
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[str, str]:
    """The labelers' votes, a character of ``+-0`` each, and the bucket of the span's shape."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(_DIGIT.findall(span))
    marks = {c for c in span if not c.isalnum()}
    if kind == "email":
        plain = re.sub(r"\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20at\x20", "@", span, flags=re.I)
        plain = re.sub(_DOT, ".", plain, flags=re.I)
        strict, valid = "@" in span or "[" in span or "(" in span or "{" in span, bool(_DOMAIN.fullmatch(plain.rpartition("@")[2]))
        known = plain.rpartition(".")[2].lower() in _TLDS
        shape = len(plain.partition("@")[0]) > 2
    elif kind == "ip":
        parts = [int(x) for x in re.findall(r"[0-9]+", span)]
        strict, valid, known = "[" in span or " " not in span, all(p < 256 for p in parts), 0 < parts[0] < 224
        shape = len(digits) >= 6
    elif kind == "card":
        strict, valid, known = len(digits) == 16, 13 <= len(digits) <= 19 and luhn(digits), digits[0] in "3456"
        shape = len(marks) < 2
    else:
        strict, valid, known = span[0] in "+(", 9 <= len(digits) <= 15, digits.lstrip("0")[:1] not in ("", "1") or span[0] == "+"
        shape = len(set(digits)) > 3
    cue, denial = _CUES[kind].search(before), _DENIALS.search(before)
    sign = ["+" if x else "-" for x in (strict, valid, known)]
    sign += ["-" if denial else "+" if cue else "0", "+" if shape else "-"]
    return "".join(sign), f"{min(len(digits) // 4, 4)}{min(len(span) // 8, 4)}"


@dataclass
class Model:
    """Reliabilities by kind and labeler, and the classifier's weights by feature."""

    reliability: dict[str, dict[str, float]] = dataclass_field(default_factory=dict)
    weights: dict[str, float] = dataclass_field(default_factory=dict)

    def probability(self, kind: str, vote: str, bucket: str) -> float:
        z = sum(self.weights.get(f, 0.0) for f in features(kind, vote, bucket))
        return 1.0 / (1.0 + np.exp(-z)) if self.weights else 0.0


def features(kind: str, vote: str, bucket: str) -> list[str]:
    return [kind, f"{kind}/{bucket}", *(f"{kind}/{name}{v}" for name, v in zip(LABELERS, vote, strict=True))]


def learn(counts: dict[tuple[str, str, str], int], rounds: int = 100) -> Model:
    """EM over ``(kind, votes, bucket) -> count``, then the classifier on its posteriors."""
    model, rows = Model(), sorted(counts)
    if not rows:
        return model
    soft: dict[tuple[str, str, str], float] = {}
    for kind in KINDS:
        mine = [r for r in rows if r[0] == kind]
        if not mine:
            continue
        n = np.array([counts[r] for r in mine], float)
        seen = np.array([["+-0".index(v) for v in r[1]] for r in mine])
        # a labeler that votes is first taken to be right four times of five; the smoothing keeps that prior
        prior = np.array([[4.0, 1.0, 2.0], [1.0, 4.0, 2.0]])[:, None, :] * np.ones((2, len(LABELERS), 3))
        share, table = 0.5, prior / prior.sum(axis=2, keepdims=True)
        for _ in range(rounds):
            like = [np.log(c) + sum(np.log(table[y, j, seen[:, j]]) for j in range(len(LABELERS))) for y, c in ((0, share), (1, 1 - share))]
            p = 1.0 / (1.0 + np.exp(np.clip(like[1] - like[0], -700, 700)))
            share = float((n @ p + 1) / (n.sum() + 2))
            for y, w in ((0, n * p), (1, n * (1 - p))):
                for j in range(len(LABELERS)):
                    got = np.bincount(seen[:, j], weights=w, minlength=3) + prior[y, j]
                    table[y, j] = got / got.sum()
        soft |= dict(zip(mine, p, strict=True))
        right = share * table[0, :, 0] + (1 - share) * table[1, :, 1]
        spoken = right + share * table[0, :, 1] + (1 - share) * table[1, :, 0]
        model.reliability[kind] = dict(zip(LABELERS, (right / spoken).round(4).tolist(), strict=True))
    names = sorted({f for r in rows for f in features(*r)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [place[f] for f in features(*r)]] = 1
    y, n, w = np.array([soft[r] for r in rows]), np.array([counts[r] for r in rows], float), np.zeros(len(names))
    n = n / n.sum() * len(rows)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (n * (p - y)) + 1e-2 * w
        curve = x.T @ (x * (n * p * (1 - p))[:, None]) + 1e-2 * np.eye(len(names))
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    model.weights = dict(zip(names, w.tolist(), strict=True))
    return model


def fit(df: DataFrame, text_col: str = "text") -> Model:
    """Reads all texts; what reaches the driver is one count per vote pattern, of which there are finitely many."""
    schema = T._parse_datatype_string("kind string, vote string, bucket string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("pii")
        for b in batches:
            for a, z in slices(b.column(0)):
                rows = []
                for text in b.column(0).slice(a, z - a).to_pylist():
                    base = base_spans(text)
                    rows += [(s[0], *votes(text, *s)) for s in [*base, *candidates(text, base)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema.names)

    found = df.select(text_of(text_col).alias("text")).mapInArrow(run, schema)
    counts = found.groupBy("kind", "vote", "bucket").agg(F.count("*").alias("n")).collect()
    return learn({(r.kind, r.vote, r.bucket): r.n for r in counts})


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and with them the candidates that the classifier is sure of."""
    base = base_spans(text)
    more = [s for s in candidates(text, base) if model.probability(s[0], *votes(text, *s)) >= SURE]
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as ``[KIND]``; spans that overlap become one."""
    out, at, start, label = [], 0, 0, ""
    end = -1
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < end:
            end = max(end, e)
            continue
        if label:
            out += [text[at:start], label]
            at = end
        start, end, label = s, e, f"[{kind.upper()}]"
    if label:
        out += [text[at:start], label]
        at = end
    return "".join([*out, text[at:]]) if label else text


def detect(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, base, spans, redacted``.

    ``base`` and ``spans`` are arrays of ``kind, start, end`` in code points, end exclusive, by kind
    and start; ``redacted`` is the text with all spans replaced. A NULL or empty text has no
    spans. Rows are answered one by one, so repeated rows and NULL ids are as any other; of the
    other columns none is read. No rows give no rows. Without ``model`` the labelers learn from ``df``.
    """
    known = model or fit(df, text_col)
    span = T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>")
    schema = T.StructType(
        [field(df, id_col, "doc_id"), T.StructField("base", span), T.StructField("spans", span), T.StructField("redacted", T.StringType())]
    )
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("pii")
        for b in batches:
            for a, z in slices(b.column(1)):
                texts = b.column(1).slice(a, z - a).to_pylist()
                found = [all_spans(t, known) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array([named(x) for x, _ in found], kind), pa.array([named(x) for _, x in found], kind),
                     pa.array([redacted(t, x) for t, (_, x) in zip(texts, found, strict=True)], pa.string())],
                    schema.names,
                )

    return df.select(id_col, text_of(text_col)).toDF("doc_id", "text").mapInArrow(run, schema)


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
