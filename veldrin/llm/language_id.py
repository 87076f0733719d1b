"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte 2- to 4-grams (letter case folded, runs of anything
but letters made one space), the classes' scores are linear in it. Embeddings and weights are trained by stochastic
gradient descent in numpy on the driver, on a bounded sample of labelled texts. As the mean and the scores are linear,
prediction sums one row of class scores per n-gram over the whole text.

Rejection is calibrated on the part of the sample kept back, on whole texts and on short cuts of them: a temperature,
so that scores are probabilities for short texts too; the least probability that all but a few right predictions reach;
and the share of 4-grams never seen in training that a text may have. That limit lies halfway between what all but a few
texts of the labels have and what texts of a label have when it alone is left out of training, with three standard
deviations for a text's length; texts in other languages and scripts are beyond it, whatever their score.

Defined results: null text or one without a letter is `und` with score 0 and is rejected; without any labelled row
(an empty table too) every text is `und`. Repeated rows get equal predictions. Extra columns pass through, but those
named lang_pred, score or accepted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_utf8, cleared, text_slices

BUCKETS = 1 << 16
#: Bytes of text that are scored at once, so that memory doesn't grow with a text.
BLOCK = 1 << 18
#: Bits of the hash by which 4-grams are known.
SEEN_BITS = 24
#: Bytes of the cuts that calibration uses beside whole texts.
CUTS = (24, 60, 200)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def _grams(raw: np.ndarray) -> np.ndarray:
    """(3, n) buckets of the 2-, 3- and 4-grams that begin at each byte; raw is folded and padded by three spaces."""
    b = raw.astype(np.uint32)
    two = b[:-3] | b[1:-2] << 8
    three = two | b[2:-1] << 16
    four = three | b[3:] << 24
    return np.stack([(g * m >> 16).astype(np.int32) for g, m in zip((two, three ^ 0x5BD1E995, four ^ 0x27D4EB2F), _MULT, strict=True)])


def _fours(raw: np.ndarray) -> np.ndarray:
    """Hashes of the 4-grams that begin at each byte."""
    b = raw.astype(np.uint32)
    return ((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(0x9E3779B1) >> (32 - SEEN_BITS)).astype(np.int32)


def _blocks(text: bytes) -> Iterator[np.ndarray]:
    raw = _FOLD[np.frombuffer(b" " + text + b"    ", np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    raw = np.concatenate([raw, np.full(3, 32, np.uint8)])
    for lo in range(0, len(raw) - 3, BLOCK):
        yield raw[lo : lo + BLOCK + 3]


@dataclass(frozen=True)
class LanguageModel:
    """Class scores of each bucket (embedding times weights), biases, temperature, the least probability accepted, the
    4-grams seen in training (a bit each) and the greatest share of others that is accepted."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0
    seen: np.ndarray | None = None
    foreign: float = 1.0

    def unknown(self, text: bytes) -> tuple[float, int]:
        """The share of a text's 4-grams that training didn't have, and their number."""
        if self.seen is None:
            return 0.0, 0
        known = n = 0
        for raw in _blocks(text):
            g = _fours(raw)
            known += int(np.count_nonzero(self.seen[g >> 3] >> (g & 7) & 1))
            n += len(g)
        return 1 - known / max(n, 1), n

    def familiar(self, text: bytes) -> bool:
        share, n = self.unknown(text)
        return share <= self.foreign + 3 * (self.foreign * (1 - self.foreign) / max(n, 1)) ** 0.5

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for raw in _blocks(text):
            g = _grams(raw)
            ones = np.ones(g.shape[1], np.float32)
            for row in g:
                total += ones @ self.table.take(row, axis=0)
            n += g.size
        return total / max(n, 1) + self.bias

    def probabilities(self, text: bytes) -> np.ndarray:
        z = self.logits(text) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def fit(texts: list[bytes], langs: list[str], dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7, false_rejections: float = 0.0005) -> LanguageModel:
    """Train on four fifths of the sample, calibrate on the rest."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    bags = []
    for t in texts:  # sparse bag of each text: distinct buckets and their shares
        ids, n = np.unique(np.concatenate([_grams(b).ravel() for b in _blocks(t)]), return_counts=True)
        bags.append((ids, (n / n.sum()).astype(np.float32)))
    order = rng.permutation(len(bags))
    kept_back = order[: len(order) // 5] if len(order) >= 10 else order
    learn = order[len(order) // 5 :] if len(order) >= 10 else order
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    weight = len(learn) / (len(names) * np.maximum(np.bincount(y[learn], minlength=len(names)), 1))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, share = bags[i]
            h = share @ emb[ids]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(weight[y[i]])
            back = w @ p
            w -= step * np.outer(h, p)
            bias -= 0.05 * step * p
            emb[ids] -= (step * np.minimum(share * len(ids), 4))[:, None] * back
    model = LanguageModel(names, np.ascontiguousarray(emb @ w), bias.astype(np.float64))
    whole = [(texts[k], y[k]) for k in kept_back]
    cuts = [(t[at : at + n], c) for t, c in whole for n in CUTS if len(t) > n for at in [int(rng.integers(len(t) - n))]]
    z = np.stack([model.logits(t) for t, _ in whole + cuts])
    right = np.array([c for _, c in whole + cuts])

    def prob(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.002, 20, 93)
    loss = [-np.log(np.maximum(prob(t)[np.arange(len(z)), right], 1e-12)).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))])
    p = prob(best)
    sure = p.max(axis=1)[p.argmax(axis=1) == right]
    floor = float(np.quantile(sure, false_rejections)) if len(sure) and len(names) > 1 else 0.0
    own = [np.unique(np.concatenate([_fours(b) for k in learn if y[k] == c for b in _blocks(texts[k])] or [np.zeros(0, np.int32)])) for c in range(len(names))]
    counts = np.zeros(1 << SEEN_BITS, np.uint8)
    for grams in own:
        counts[grams] += counts[grams] < 255
    model = LanguageModel(names, model.table, model.bias, best, floor, np.packbits(counts > 0, bitorder="little"))
    near = np.quantile([model.unknown(t)[0] for t, _ in whole], 1 - false_rejections)
    far = []
    for t, c in whole if len(names) > 1 else []:
        g = np.concatenate([_fours(b) for b in _blocks(t)])
        far.append((c, 1 - np.count_nonzero(counts[g] > np.isin(g, own[c])) / max(len(g), 1)))
    left_out = np.median([np.median([v for k, v in far if k == c]) for c in {k for k, _ in far}]) if far else 1.0
    return LanguageModel(names, model.table, model.bias, best, floor, model.seen, float(min(1.0, max(near, (near + left_out) / 2))))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = 400, longest: int = 20_000, languages: int = 200) -> LanguageModel:
    """Fit on at most about `per_language` labelled texts of each of the `languages` most frequent labels.

    The sample is bounded by these parameters and by `longest`, the most characters of a text that is learned from: it
    is drawn by a hash of the id, at a rate that follows from each label's count, so no label is gathered or sorted.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).where("_lang is not null and _text is not null and length(_text) <= %d" % longest)
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).collect()
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["_lang"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    sample = rows.where(F.col("_lang").isin([r["_lang"] for r in counts])).where(draw < F.element_at(rate, F.col("_lang"))).select("_id", as_utf8("_text").alias("_text"), "_lang").collect()
    sample.sort(key=lambda r: (str(r["_id"]), bytes(r["_text"]), r["_lang"]))
    if not sample:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    return fit([bytes(r["_text"]) for r in sample], [r["_lang"] for r in sample])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the calibrated probability) and accepted. Whole texts are read."""
    docs = cleared(docs, ["lang_pred", "score", "accepted"])
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "accepted": F.lit(False)})
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]  # by place: names may clash but for case
    source = docs.toDF(*names)
    body = source.columns[docs.columns.index(text)]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch, texts in text_slices(batches, batch_text):
            found = [("und", 0.0, False) if t is None else _one(m, t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=schema.names)

    batch_text = len(names)
    lettered: Column = F.when(F.col(body).rlike(r"\p{L}"), F.col(body)).cast("binary")
    return source.withColumn("_letters", lettered).mapInArrow(score, schema).toDF(*docs.columns, "lang_pred", "score", "accepted")


def _one(m: LanguageModel, text: bytes) -> tuple[str, float, bool]:
    p = m.probabilities(text)
    i = int(p.argmax())
    return m.languages[i], float(min(1.0, p[i])), bool(p[i] >= m.floor) and m.familiar(text)
