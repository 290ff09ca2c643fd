"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (code points, lower-cased) of the whole text, as relative frequency
times inverse document frequency; document frequencies are counted over all training rows. Weights are learned by
follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, so most of them are exactly 0; a temperature
fitted on a part of the sample kept from training calibrates the probabilities. The classifier is fitted on a bounded
sample of labelled rows, about ``SAMPLE`` in all and as many of each language: texts by hash, so a rare language is
learned and copies count once. Of sampled texts only n-gram counts (at most 2**BITS a text) reach the driver. Scoring
reads every document once, without a shuffle.

Edge cases: text that is null or has no letter gets ``und`` with score 0; no labelled rows at all: every text gets
``und``; one language only: that one. Repeated rows, and texts of a repeated doc_id, are judged each by its own text; a
null doc_id has no fold (held_out is null) and is never learned from. Very long texts are scored whole. Extra columns
are kept by ``with_language`` (lang_pred and score are replaced) and ignored by ``identify``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._spark import fold
from tessera.llm._text import chunks

BITS = 16
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
CHUNK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


def lower_table() -> np.ndarray:
    """Lower case of each code point below 2**16 that has one of one character."""
    return np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)


LOWER = lower_table()


def points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of UTF-8 texts raw[off[d]:off[d+1]], and where each text begins among them."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.concatenate((raw, np.zeros(3, np.uint8)))
    lead = b[at].astype(np.uint32)
    out = lead.copy()
    for size, least, most, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
        on = np.flatnonzero((lead >= least) & (lead < most))
        if len(on):
            x = lead[on] & bits
            for k in range(1, size):
                x = x << np.uint32(6) | (b[at[on] + k] & 0x3F)
            out[on] = x
    low = out < (1 << 16)
    out[low] = LOWER[out[low]]
    return out, np.searchsorted(at, off)


def slots(p: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams that start at each code point."""
    x = p * np.uint32(0x9E3779B1)
    out = [x >> np.uint32(32 - BITS)]
    for n, c in ((1, 0x85EBCA77), (2, 0xC2B2AE3D)):
        if len(p) <= n:
            break
        x = (x[:-1] + p[n:]) * np.uint32(c)
        x ^= x >> np.uint32(15)
        out.append(x * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
    return out


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    s = slots(points(raw, np.array([0, len(raw)]))[0])
    idx, n = np.unique(np.concatenate(s), return_counts=True)
    return idx, n / max(1, sum(map(len, s)))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (features, languages), idf and temperature folded in
    bias: np.ndarray
    temperature: float

    def logits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Scores of the texts raw[off[d]:off[d+1]]."""
        raw, off = points(raw, off)
        n = len(off) - 1
        out = np.zeros((n, len(self.langs)))
        size = np.diff(off)
        sums = np.zeros((n, len(self.langs)))
        for k, s in enumerate(slots(raw)):
            # n-grams of k+1 characters that start in text d and end there
            ends = np.maximum(off[1:] - k, off[:-1])
            c = np.zeros((len(s) + 1, len(self.langs)))
            np.cumsum(self.weights[s], axis=0, dtype=np.float64, out=c[1:])
            top = len(s)
            sums += c[np.minimum(ends, top)] - c[np.minimum(off[:-1], top)]
        total = np.maximum(1, size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0))
        out[:] = sums / total[:, None] + self.bias
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(data: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, seed: int = 4) -> Model | None:
    """data: the ``frequencies`` of each text."""
    langs = sorted(set(labels))
    if not langs:
        return None
    dim, k = 1 << BITS, len(langs)
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept = order[: len(data) // 5] if len(data) >= 50 else order[:0]
    train = order[len(kept) :]
    # FTRL-proximal, one feature row for all languages; the bias has no penalty
    z, n = np.zeros((dim, k)), np.zeros((dim, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(zr: np.ndarray, nr: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zr) <= L1, 0.0, -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(nr)) / ALPHA + L2))

    scale = 1.0 / max(1e-12, float(np.mean([np.linalg.norm(v * idf[idx]) for idx, v in data])))
    for _ in range(EPOCHS):
        for d in rng.permutation(train):
            idx, v = data[d]
            x = v * idf[idx] * scale
            w, b = weights(z[idx], n[idx]), -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            p = softmax(x @ w + b)
            p[y[d]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
            z[idx] += g - s * w
            n[idx] += g * g
            s = (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA
            zb += p - s * b
            nb += p * p
    w, b = weights(z, n) * (idf * scale)[:, None], -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    best = 1.0
    if len(kept) and k > 1:
        logits = np.array([data[d][1] @ w[data[d][0]] + b for d in kept])
        loss = lambda t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(kept)), y[kept]])).mean()
        best = float(min(np.exp(np.linspace(-4, 2, 61)), key=loss))
    return Model(langs, (w / best).astype(np.float32), b / best, best)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, texts that hold it); slot -1 has the number of texts."""
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, _, raw, off in chunks(batch.column("text"), CHUNK):
            p, off = points(raw, off)
            for a, b in zip(off[:-1], off[1:], strict=True):
                here = np.zeros(1 << BITS, bool)
                for s in slots(p[a:b]):
                    here[s] = True
                df += here
            n += len(off) - 1
    on = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *on.tolist()], pa.int64()), pa.array([n, *df[on].tolist()], pa.int64())], names=["slot", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [frequencies(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("lang"), pa.array([i.astype(np.uint32).tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["o", "lang", "i", "v"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on about ``sample`` different labelled texts of the training folds, as many of each language."""
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0) & (fold("doc_id", 4) != 2)
    rows = docs.where(known).select("text", "lang", F.xxhash64(F.col("text"), F.lit("langid")).alias("o"))
    langs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("o", 0.02).alias("n")).collect()}
    if not langs:
        return None
    # a language's texts whose hash lies below its share: about sample / len(langs) of them
    share = F.create_map(*(x for k, n in sorted(langs.items()) for x in (F.lit(k), F.lit(min(1.0, sample / len(langs) / max(1, n))))))
    chosen = rows.where(F.shiftrightunsigned("o", 11) < F.element_at(share, F.col("lang")) * float(1 << 53))
    got = chosen.mapInArrow(_sampled, "o long, lang string, i binary, v binary").dropDuplicates(["o", "lang"]).collect()
    got.sort(key=lambda r: (r.o, r.lang))
    df = {r.slot: r.n for r in rows.select("text").mapInArrow(_document_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    idf = np.full(1 << BITS, np.log(1.0 + n) + 1)
    idf[list(df)] = np.log((1 + n) / (1 + np.array(list(df.values())))) + 1
    return fit([(np.frombuffer(r.i, np.uint32), np.frombuffer(r.v, np.float64)) for r in got], [r.lang for r in got], idf)


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (replacing columns of these names)."""
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            langs, scores = [], []
            for lo, hi, raw, off in chunks(col, CHUNK):
                p = softmax(model.logits(raw, off)) if model else None
                for d, text in enumerate(col.slice(lo, hi - lo).to_pylist()):
                    if model is None or text is None or not _LETTER.search(text):
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        k = int(p[d].argmax())
                        langs.append(model.langs[k])
                        scores.append(float(p[d, k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    shape = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, shape)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every document."""
    return with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = predict(docs, learn(docs, sample))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
