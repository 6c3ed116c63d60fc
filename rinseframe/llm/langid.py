"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all training rows. The weights are learned from a bounded sample per language by
follow-the-regularised-leader with elastic-net penalties, which leaves most of them zero; a temperature, fitted on rows
that the weights have not seen, turns scores into probabilities. Every document is classified where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.common import TEXT, map_texts, parts, stored

#: Buckets of hashed n-grams, longest n-gram, rows per language in the fit.
BUCKETS, LONGEST, PER_LANGUAGE = 1 << 16, 3, 1000
#: Step size, its offset, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.01, 4
#: One row in so many fits the temperature.
CALIBRATION = 5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
# ASCII that is no letter counts as a space.
_ASCII = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(128)], dtype=np.uint32)


def has_letters(text: bytes | None) -> bool:
    return text is not None and _LETTER.search(text.decode()) is not None


def grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a lowered text, and how often each occurs."""
    points = np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), dtype=np.uint32)
    points = np.where(points < 128, _ASCII[points & np.uint32(127)], points)
    rolled, found = points * np.uint32(2_654_435_761), []
    for n in range(1, LONGEST + 1):
        if n > 1:
            rolled = rolled[:-1] * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(2_654_435_761) + np.uint32(n)
        found.append((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(16))
        if len(rolled) < 2:
            break
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[buckets]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, text: bytes | None) -> np.ndarray:
        buckets, counts = grams(text)
        return self.features(buckets, counts) @ self.weights[buckets] + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """How many texts there are, and in how many each bucket occurs. Each task sums its own before anything moves."""
    source = docs.select(F.col(text).cast("string").cast("binary").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in parts(batch, TEXT):
                for value in part.column(TEXT).to_pylist():
                    seen[grams(value)[0]] += 1
                    total += 1
        buckets = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *buckets], pa.int64()), pa.array([total, *seen[buckets]], pa.int64())], names=["bucket", "n"])

    rows = source.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(BUCKETS), 0
    for r in rows:
        if r.bucket < 0:
            total = r.n
        else:
            out[r.bucket] = r.n
    return total, out


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> Model:
    """``rows``: language, buckets, counts. Every fifth row is left for the temperature."""
    k = len(languages)
    z, seen = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    model = Model(languages, idf, np.zeros((BUCKETS, k), np.float32), np.zeros(k), 1.0)
    known = [(y, np.append(b, BUCKETS), np.append(model.features(b, c), 1.0)) for y, b, c in rows]
    fitted = [r for i, r in enumerate(known) if i % CALIBRATION] or known
    held = [r for i, r in enumerate(known) if i % CALIBRATION == 0]

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) > L1, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(seen[at])) / ALPHA + L2), 0)

    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fitted)):
            y, at, x = fitted[i]
            w = weights(at)
            error = _softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            grown = seen[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(seen[at])) / ALPHA * w
            seen[at] = grown
    final = weights(slice(None))
    model.weights, model.bias = final[:-1].astype(np.float32), final[-1]
    if held:
        logits, y = np.array([x @ final[at] for _, at, x in held]), np.array([r[0] for r in held])
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 10, 120)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with a language and letters: about ``per_language`` rows of each, drawn by a hash of the id.

    Document frequencies are those of all given rows with a language. Without any such row every text is ``und``.
    """
    known = docs.where(F.col(lang).isNotNull())
    total, seen = document_frequencies(known, text)
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n)))) if sizes else None
    if share is None:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    draw = (F.pmod(F.xxhash64(F.col(doc_id), F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)) < share[F.col(lang)]
    sample = known.where(draw).select(F.col(lang).alias("__lang"), F.col(text).alias("__text")).limit(2 * per_language * len(sizes))

    def make():
        def work(texts):
            found = [grams(value) if has_letters(value) else ((), ()) for value in texts]
            return {"buckets": [f[0] for f in found], "counts": [f[1] for f in found]}

        return work

    rows = stored(map_texts(sample, make, {"buckets": "ints", "counts": "ints"}, ["__lang"], "__text"), "grams").where("size(buckets) > 0")
    languages = sorted(sizes)
    places = {name: i for i, name in enumerate(languages)}
    gathered = [(places[r["__lang"]], np.array(r.buckets, dtype=np.int32), np.array(r.counts, dtype=np.int32)) for r in rows.toLocalIterator()]
    # Parts of the sample arrive in no fixed order.
    gathered.sort(key=lambda r: (len(r[1]), r[0], r[1].tobytes()))
    return learn(gathered, languages, np.log((1 + total) / (1 + seen)) + 1)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every whole text; ``und`` and 0 for null or no letters."""
    keep = list(docs.columns) if keep is None else keep

    def make():
        def work(texts):
            found = [model.predict(value) for value in texts]
            return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    return map_texts(docs, make, {"lang_pred": "string", "score": "double"}, keep, text)
