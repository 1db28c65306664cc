"""Language identification: sparse multinomial logistic regression on hashed character n-grams.

Documents become TF-IDF vectors of the character 1- to 3-grams of their letters, word by word.
Document frequencies cover all training documents. The weights are learnt with
follow-the-regularised-leader and an elastic net, example by example, on a bounded sample of
labelled documents, ``SAMPLE`` distinct texts a language, spread evenly over the table by hash. A
temperature fitted on labelled documents that the weights have not seen makes the scores
probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import kept_in_worker, slices

DIMS = 1 << 15
SAMPLE = 4000  # labelled documents a language that the weights are fitted on, about
UNKNOWN = "und"
EPOCHS = 2
_ALPHA, _BETA, _L1, _L2 = 1.0, 1.0, 2e-3, 1e-3
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams and their counts, or None for a text without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after each word
    c = np.concatenate([[np.uint32(32)], np.where(is_letter, c, np.uint32(32))[keep], [np.uint32(32)]]).astype(np.uint32)
    one = c * _PRIMES[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _PRIMES[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _PRIMES[2] + c[2:]
    parts = [one[c != 32], two * _PRIMES[0], three[c[1:-1] != 32] * _PRIMES[1]]
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = np.bincount(np.concatenate([p >> shift for p in parts]), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A unit TF-IDF vector as places and values."""
    g = grams(text)
    if g is None:
        return None
    values = (1 + np.log(g[1])) * idf[g[0]]
    return g[0], values / np.sqrt(values @ values)


@dataclass
class Model:
    classes: list[str] = dataclass_field(default_factory=list)
    idf: np.ndarray = dataclass_field(default_factory=lambda: np.ones(DIMS))
    weights: np.ndarray = dataclass_field(default_factory=lambda: np.zeros((DIMS + 1, 0)))
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        v = vector(text, self.idf) if self.classes else None
        if v is None:
            return UNKNOWN, 0.0
        p = softmax((v[1] @ self.weights[v[0]] + self.weights[DIMS]) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], min(1.0, float(p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader with an adaptive rate per weight and an elastic net."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= _L1, 0.0, -(z - np.sign(z) * _L1) / ((_BETA + np.sqrt(n)) / _ALPHA + _L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, DIMS), np.append(values, 0.1)  # the last weight is the class's own
        w = self.weights(at)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / _ALPHA * w
        self.n[at] = grown


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which unseen labels are likeliest; golden-section search of its logarithm.

    One further example is taken to be wrong, so that a faultless sample does not make all scores 1.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + k) / (k - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + k)

    def loss(t: float) -> float:
        return -float((target * np.log(np.maximum(softmax(logits / math.exp(t)), 1e-300))).sum())

    lo, hi, ratio = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def train(
    df: DataFrame, fits: Column, calibrates: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> Model:
    """Learns from the rows with a language for which ``fits`` or ``calibrates`` holds.

    The driver gets document frequencies (``DIMS`` numbers), the languages with their counts and
    the weights. Without labelled rows the model answers ``und``.
    """
    rows = df.select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(fits, F.lit(False)).alias("fits"), F.coalesce(calibrates, F.lit(False)).alias("calibrates"),
    ).where("lang IS NOT NULL AND text IS NOT NULL AND (fits OR calibrates)")
    # without a letter a text teaches nothing
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(sizes)
    if not classes:
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("langid")
        seen, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for a, z in slices(b.column(0)):
                for text in b.column(0).slice(a, z - a).to_pylist():
                    g = grams(text)
                    if g is not None:
                        seen[g[0]] += 1
                        n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"gram": np.append(at, -1), "n": np.append(seen[at], n)})

    found = rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequency = np.zeros(DIMS + 1)
    for r in found.toLocalIterator():
        frequency[r.gram] = r.n  # -1 is the last place: the number of documents
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    part = F.lit(1.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(part)
    key = F.xxhash64("text")
    picked = rows.withColumn("key", key).where(F.pmod("key", F.lit(1 << 30)) < part * (1 << 30))
    # one row of each text, the same in every run
    picked = picked.groupBy("key", "lang").agg(F.max("text").alias("text"), F.max("fits").alias("fits"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column("text")):
                s, out = b.slice(a, z - a), []
                for key, lang, fit, text in zip(*(s.column(c).to_pylist() for c in ("key", "lang", "fits", "text")), strict=True):
                    v = vector(text, idf)
                    if v is not None:
                        out.append((key, lang, fit, v[0].astype(np.uint16).tobytes(), v[1].astype(np.float32).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "lang", "fits", "at", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, check = [], []
        for b in batches:
            for lang, fits, at, values in zip(*(b.column(c).to_pylist() for c in ("lang", "fits", "at", "values")), strict=True):
                (fit if fits else check).append((np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(values, np.float32).astype(float), classes.index(lang)))
        leader = Leader(len(classes))
        for _ in range(EPOCHS):
            for at, values, label in fit:
                leader.learn(at, values, label)
        w = leader.weights(slice(None))
        logits = np.array([values @ w[at] + w[DIMS] for at, values, _ in check]).reshape(-1, len(classes))
        t = temperature(logits, np.array([label for *_, label in check], int))
        at = np.flatnonzero(w.any(axis=1))
        yield pa.RecordBatch.from_pydict({"temperature": [t], "at": [at.astype("<i4").tobytes()], "weights": [w[at].astype("<f8").tobytes()]})

    vectors = picked.mapInArrow(featurise, "key long, lang string, fits boolean, at binary, values binary")
    learnt = vectors.repartition(1).sortWithinPartitions("key", "lang").mapInArrow(learn, "temperature double, at binary, weights binary").first()
    weights = np.zeros((DIMS + 1, len(classes)))
    weights[np.frombuffer(learnt.at, "<i4")] = np.frombuffer(learnt.weights, "<f8").reshape(-1, len(classes))
    return Model(classes, idf, weights, learnt.temperature)


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """``df`` with the language and its probability for every row.

    A text that is NULL or has no letter gets ``und`` and score 0. Of languages with equal probability the first
    by name wins. Columns of ``df`` that have the names of the new ones are replaced; all others stay as
    they are, NULL or not. No rows give no rows.
    """
    answer = T._parse_datatype_string("lang string, score double")

    @F.pandas_udf(answer)
    def guess(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    found = df.withColumn("__guess", guess(F.col(text_col)))
    return found.withColumn(lang_to, F.col("__guess.lang")).withColumn(score_to, F.col("__guess.score")).drop("__guess")


def fold(id_col: str) -> Column:
    """A document's fold, 0 to 4, from its id; a NULL id is in fold 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
