"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's words, lower-cased, give their character n-grams (with word ends; short words are n-grams themselves) as
hashed subwords; the text is the mean of their embeddings, classified by a linear softmax. Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows (SAMPLE documents in expectation, twice as many at most,
shared evenly by the labels; whole texts, of SAMPLE_BYTES together at most, so that longer ones than an even share of
twice the sample don't enter it). A temperature and a rejection threshold are calibrated on a
part of the sample that isn't trained on: the score is the calibrated probability of the predicted language, and a
document is rejected if its score is below what all but REJECT of the rightly labelled calibration texts reach.

Predictions use the text only. Texts that are null or have no letter are `und`, score 0, and rejected. Without any
labelled row every text is `und`. Null labels and null doc_ids aren't learned from. Ties go to the lesser label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkforge.llm.common import fresh, read_table

#: Documents in the training sample, and the bytes that twice as many may have.
SAMPLE, SAMPLE_BYTES = 1200, 1 << 27
BITS = 15
BUCKETS, DIM, EPOCHS, RATE = 1 << BITS, 16, 3, 0.5
#: The share of good calibration texts that may be rejected, and the highest threshold it may lead to.
REJECT, MOST_THRESHOLD = 0.0005, 0.4
#: Lengths of the character n-grams, and the code points hashed at a time.
GRAMS, CHUNK = (2, 3, 4, 5), 1 << 16
STEP, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of a text's lower-cased words; a word's end counts as one character."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0)
    codes = np.concatenate(([0], codes[(codes != 0) | (np.concatenate(([0], codes[:-1])) != 0)], [0])).astype(np.uint64)
    if len(codes) > 2 and not codes[-2]:
        codes = codes[:-1]
    if not codes.any():
        return np.empty(0, np.int64)
    out = []
    for n in GRAMS:
        for at in range(0, len(codes) - n + 1, CHUNK):
            part = codes[at : at + CHUNK + n - 1]
            size = len(part) - n + 1
            hashed, inside = part[:size] + np.uint64(n), np.ones(size, bool)
            for k in range(1, n):
                if k > 1:
                    inside &= part[k - 1 : k - 1 + size] != 0
                hashed = hashed * STEP + part[k : k + size]
            out.append(((hashed[inside] * SPREAD) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, temperature: float = 1.0, threshold: float = 0.0) -> None:
        """weights: a bucket's contribution to each label's logit (embedding times softmax)."""
        self.labels, self.weights, self.temperature, self.threshold = labels, weights, temperature, threshold

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [], []
        for text in texts:
            ids = subwords(text)
            if not len(ids) or not self.labels:
                labels.append(UND)
                scores.append(0.0)
                continue
            total = np.bincount(ids, minlength=BUCKETS) @ self.weights if len(ids) > 4096 else self.weights[ids].sum(0)
            p = softmax((total / len(ids) / self.temperature)[None])[0]
            best = int(p.argmax())
            labels.append(self.labels[best])
            scores.append(float(p[best]))
        return labels, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _spans(words: list[str], draw: np.random.Generator) -> Iterator[list[str]]:
    """The whole text and short runs of it, so that short documents are learned too."""
    yield words
    for n in (3, 8, 20, 60):
        if len(words) > n:
            at = int(draw.integers(0, len(words) - n + 1))
            yield words[at : at + n]


def train(rows: list[tuple[int, str, str]], seed: int = 7) -> Model:
    """A model of (doc_id, text, label) rows; a fifth of them calibrates."""
    labels = sorted({label for _, _, label in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)))
    draw = np.random.default_rng(seed)
    fit, hold = [], []
    for k, (_, text, label) in enumerate(sorted(rows)):
        for span in _spans(text.split(), draw):
            ids, n = np.unique(subwords(" ".join(span)), return_counts=True)
            if len(ids):
                (hold if k % 5 == 4 else fit).append((ids, n / n.sum(), labels.index(label)))
    if not fit:
        return Model(labels, np.zeros((BUCKETS, len(labels))))
    emb = draw.normal(0, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, len(labels)))
    share = np.bincount([y for _, _, y in fit], minlength=len(labels)) / len(fit)
    even = 1 / np.maximum(share * len(labels), 1e-9)
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in draw.permutation(len(fit)).tolist():
            ids, part, y = fit[k]
            rate = RATE * (1 - step / steps) * min(even[y], 10.0)
            mean = part @ emb[ids]
            err = softmax((mean @ out)[None])[0]
            err[y] -= 1
            back = out @ err
            out -= rate * np.outer(mean, err)
            emb[ids] -= rate * len(ids) ** 0.5 * part[:, None] * back[None]
            step += 1
    model = Model(labels, emb @ out)
    _calibrate(model, hold or fit)
    return model


def _calibrate(model: Model, rows: list[tuple]) -> None:
    logits = np.array([part @ model.weights[ids] for ids, part, _ in rows])
    truth = np.array([y for _, _, y in rows])
    at = np.arange(len(rows))
    grid = np.geomspace(0.05, 20, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(softmax(logits / t)[at, truth], 1e-12)).mean()))
    p = softmax(logits / model.temperature)
    good = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    if len(good):
        model.threshold = min(float(np.quantile(good, REJECT)), MOST_THRESHOLD)


def is_held_out():
    """crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_sample(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled rows that aren't held out: an even, hashed share of each label's."""
    usable = docs.filter(~is_held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return train([])
    # Hash shares of 2^31: each label gives sample / labels rows in expectation, and the limit bounds the whole.
    rate = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample / len(counts) / n) * (1 << 31))))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 31))
    picked = usable.filter((draw < F.element_at(rate, F.col("lang"))) & (F.octet_length("text") <= SAMPLE_BYTES // (2 * sample)))
    rows = picked.select(draw.alias("draw"), "doc_id", "text", "lang").orderBy("draw", "doc_id", "lang", "text").limit(2 * sample).collect()
    return train([(r["doc_id"], r["text"], r["lang"]) for r in rows])


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs' columns `keep` with the prediction under `names`, from the whole text; the model is BUCKETS by labels in size.

    names must not be among keep. A text that is kept is shipped once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.temperature, model.threshold))
    inputs = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = inputs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            labels, scores = own.score(batch.column(at).to_pylist())
            rejected = [lab == UND or s < own.threshold for lab, s in zip(labels, scores, strict=True)]
            arrays = [*batch.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    added = zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)
    return inputs.mapInArrow(run, T.StructType([*inputs.schema.fields[: len(keep)], *(T.StructField(n, t) for n, t in added)]))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs, fit_sample(docs), ["doc_id"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that a model trained on them doesn't reject, with their columns."""
    cols = docs.columns
    names = fresh(cols, "lang_pred"), fresh(cols, "lang_score"), fresh(cols, "lang_rejected")
    return predict(docs, fit_sample(docs), cols, names).filter(~F.col(names[2])).select(*cols)
