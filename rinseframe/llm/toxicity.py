"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words and of the first letters of longer ones, hashed. Besides a weight for each term the model has a short vector for each, and
the products of vectors say what two terms mean together. It is fitted on a bounded sample of labelled documents: once
with the terms that tell the labels apart alone, and from there with all terms, as some do so only together. Labelled
documents that neither has seen decide between the two. Every document is then scored where it is read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.common import map_texts, stored
from rinseframe.llm.decontaminate import words

#: Buckets of hashed terms, labelled documents in the fit, length of a term's vector.
BUCKETS, MOST_LABELLED, RANK = 1 << 18, 20_000, 8
#: A term must be in so many labelled documents. It is strong alone if chance gives its chi-square once in a thousand times.
LEAST_DOCUMENTS, LEAST_CHI = 3, 10.83
#: First bytes of a word that are a term of their own.
STEM = 4
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 128, 0.08, 2e-5, 7
#: A small sample is gone through more often, for so many steps or epochs.
LEAST_STEPS, MOST_EPOCHS = 1000, 150
#: Spread of the vectors at the start; the same and the decay for all terms, most of which say nothing.
INITIAL, ALL_INITIAL, ALL_DECAY = 0.05, 0.01, 1e-3
#: One labelled document in so many decides between the machines.
CHECKED = 5
#: Scores from here on are toxic.
THRESHOLD = 0.3


def terms(text: bytes | None) -> np.ndarray:
    """Distinct buckets of a text's words and their stems, sorted."""
    ws = set(words(text))
    codes = [*map(zlib.crc32, ws), *(zlib.crc32(stem, 1) for stem in {w[:STEM] for w in ws if len(w) > STEM})]
    return np.unique(np.array(codes, dtype=np.uint32) & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of vector products, of the chosen terms in a document."""

    chosen: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.chosen, buckets)
        at[at == len(self.chosen)] = 0
        return at[self.chosen[at] == buckets] if len(self.chosen) else at[:0]

    def score(self, text: bytes | None) -> float:
        return self.score_terms(terms(text))

    def score_terms(self, buckets: np.ndarray) -> float:
        own = self.rows(buckets)
        v = self.vectors[own]
        total = v.sum(axis=0)
        logit = self.bias + self.weights[own].sum() + 0.5 * (total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _summed(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(place, rows[:, r], n) for r in range(rows.shape[1])], axis=1)


def train(
    documents: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, *, start: Machine | None = None, initial: float = INITIAL, decay: float = DECAY,
) -> Machine:
    """Logistic loss, mini-batches, one step size per coordinate. ``documents``: places in ``chosen`` of each one's terms.

    ``start``: a machine over some of the chosen terms to go on from.
    """
    rng, n = np.random.default_rng(SEED), len(chosen)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Machine(chosen, float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, initial, (n, RANK)))
    if not len(documents) or labels.min() == labels.max():
        model.vectors[:] = 0
        return model
    if start is not None:
        known = np.searchsorted(chosen, start.chosen)
        model.bias, model.weights[known], model.vectors[known] = start.bias, start.weights, start.vectors
    seen_b, seen_w, seen_v = 1.0, np.ones(n), np.ones((n, RANK))
    sizes = np.array([len(d) for d in documents])
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, LEAST_STEPS * BATCH // len(documents)))):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            which = np.repeat(np.arange(len(own)), sizes[own])
            place = np.concatenate([documents[i] for i in own])
            v = model.vectors[place]
            total = _summed(which, v, len(own))
            pairs = 0.5 * ((total**2).sum(1) - np.bincount(which, (v * v).sum(1), len(own)))
            logit = model.bias + np.bincount(which, model.weights[place], len(own)) + pairs
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) / len(own)
            touched, inverse = np.unique(place, return_inverse=True)
            by = error[which]
            grad_w = np.bincount(inverse, by, len(touched)) + decay * model.weights[touched]
            grad_v = _summed(inverse, by[:, None] * (total[which] - v), len(touched)) + decay * model.vectors[touched]
            seen_b += error.sum() ** 2
            seen_w[touched] += (BATCH * grad_w) ** 2
            seen_v[touched] += (BATCH * grad_v) ** 2
            model.bias -= RATE * BATCH * error.sum() / np.sqrt(seen_b)
            model.weights[touched] -= RATE * BATCH * grad_w / np.sqrt(seen_w[touched])
            model.vectors[touched] -= RATE * BATCH * grad_v / np.sqrt(seen_v[touched])
    return model


def _machine(documents: list[np.ndarray], labels: np.ndarray, over_all: bool) -> Machine:
    """A machine over the strong terms, or from there over all that are in enough documents."""
    n = np.zeros(BUCKETS)
    p = np.zeros(BUCKETS)
    for own, label in zip(documents, labels, strict=True):
        n[own] += 1
        p[own] += label
    total, positive = float(len(labels)), float(labels.sum())
    # Chi-square of the two-by-two table of term and label.
    spread = n * (total - n) * positive * (total - positive)
    chi = np.divide(total * (p * total - n * positive) ** 2, spread, out=np.zeros(BUCKETS), where=spread > 0)

    def over(chosen: np.ndarray, **how) -> Machine:
        places = np.full(BUCKETS, -1, dtype=np.int32)
        places[chosen] = np.arange(len(chosen))
        return train([at[at >= 0] for at in (places[own] for own in documents)], labels, chosen, **how)

    often = n >= LEAST_DOCUMENTS
    strong = over(np.flatnonzero(often & (chi >= LEAST_CHI)))
    return over(np.flatnonzero(often), start=strong, initial=ALL_INITIAL, decay=ALL_DECAY) if over_all else strong


def _loss(model: Machine, documents: list[np.ndarray], labels: np.ndarray) -> float:
    scores = np.array([model.score_terms(own) for own in documents])
    return float(-np.log(np.where(labels == 1, scores, 1 - scores)).sum())


def chosen_machine(documents: list[np.ndarray], labels: np.ndarray) -> Machine:
    """The machine over strong terms or over all terms, whichever does better on documents that it has not seen."""
    if not len(labels) or labels.min() == labels.max():
        return train(documents[:0], labels, np.zeros(0, dtype=np.int64))
    checked = np.random.default_rng(SEED).permutation(len(labels)) % CHECKED == 0
    parts = [([documents[i] for i in np.flatnonzero(which)], labels[which]) for which in (~checked, checked)]
    over_all = _loss(_machine(*parts[0], True), *parts[1]) < _loss(_machine(*parts[0], False), *parts[1])
    return _machine(documents, labels, over_all)


def fit(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    most_labelled: int = MOST_LABELLED,
) -> Machine:
    """A model of ``label`` (0 or 1) from at most ``most_labelled`` labelled ids, drawn by a hash of the id.

    Labels of other values or without an id, and ids without a document, are left out; of rows with one id one counts. Without labels, or with one
    value only, the model knows nothing but a smoothed share. Terms: all that are in enough of these documents are tried
    (see ``chosen_machine``), so that a term can count that says something with another one only.
    """
    labelled = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)")
    drawn = labelled.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(most_labelled)
    # At most most_labelled rows: small enough to send to every executor. Their texts become terms where they are read.
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__id")

    def make():
        return lambda texts: {"buckets": [terms(value).astype(np.int32).tobytes() for value in texts]}

    found = map_texts(own, make, {"buckets": "binary"}, ["__id", "__label"], "__text")
    rows = stored(found.groupBy("__id").agg(F.first("__label").alias("__label"), F.first("buckets").alias("buckets")), "labelled")
    documents, values = [], []
    for r in rows.orderBy("__id").toLocalIterator():
        documents.append(np.frombuffer(r.buckets, dtype=np.int32))
        values.append(r["__label"])
    return chosen_machine(documents, np.array(values, dtype=float))


def score(docs: DataFrame, model: Machine, *, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every whole text, 0 to 1. Null and empty texts get the score of no terms."""
    keep = list(docs.columns) if keep is None else keep

    def make():
        return lambda texts: {name: [model.score(value) for value in texts]}

    return map_texts(docs, make, {name: "double"}, keep, text)
