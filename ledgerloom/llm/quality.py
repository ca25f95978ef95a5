"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed, and numbers on its form, among them its length
as the only metadata (label, language, source and key are never looked at). The machine's score is
    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
the sum-of-squares identity, so all pairwise interactions cost time linear in the features.

It is fitted on the driver with at most ``sample`` labelled rows, picked by the hash of their key. Executors turn
their texts into features, so what the driver sees of a row is at most ``SIZE`` numbers, however long its text;
scoring needs no shuffle, and what is broadcast has the fixed size of the weights.

Results for odd input: null text is empty text; an empty text has a score (that of the bias and of
its form); documents of any length are scored whole; equal texts get equal scores; without labels of
both kinds every score is the share of label 1 (0.5 without labels at all). Null and repeated keys are rows like others (of a
labelled key that repeats one text is learnt from); an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import text_slices, whole_row

#: Buckets of hashed words, factors of each feature, labelled rows fitted at most.
WORD_BUCKETS, FACTORS, SAMPLE = 1 << 14, 8, 3000
STATS = 24
SIZE = WORD_BUCKETS + STATS


def is_held_out(key: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the key as text is divisible by 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def structure(text: str, words: list[str], counts: Counter) -> np.ndarray:
    """Numbers on the form of a text, each about 0 to 1."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n, m = max(len(raw), 1), max(len(words), 1)
    b = np.bincount(raw, minlength=256)
    upper, digits, lower = b[65:91].sum(), b[48:58].sum(), b[97:123].sum()
    marks = b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()
    shares = b[b > 0] / n
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    out = np.array(
        [
            1.0,
            np.log1p(n) / 12,
            np.log1p(m) / 10,
            lengths.mean() / 10,
            min(lengths.std() / 10, 2.0),
            np.log1p(lengths.max()) / 5,
            upper / n * 2,
            upper / max(upper + lower, 1),
            digits / n * 4,
            marks / n * 4,
            b[ord("|")] / m,
            b[ord("!")] / m,
            (b[35] + b[36] + b[37] + b[38] + b[42]) / m,
            b[10] / m * 10,
            (b[ord(".")] + b[ord(",")]) / m * 2,
            b[128:].sum() / n,
            len(counts) / m,
            max(counts.values(), default=0) / m * 2,
            sum(map(eq, words, words[1:])) / m * 2,
            float(-(shares * np.log2(shares)).sum()) / 8 if len(raw) else 0.0,
            b[32] / n * 3,
            float(len(raw) == 0),
            (b[60] + b[62] + b[123] + b[125]) / m,
            (b[47] + b[58] + b[64]) / m,
        ]
    )
    return np.minimum(out, 3.0)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): words at equal small weights, then the numbers on its form."""
    words = text.split()
    counts = Counter(words)
    found = np.unique(np.fromiter((zlib.crc32(w.encode()) for w in counts), np.int64, len(counts)) % WORD_BUCKETS)
    index = np.concatenate((found, np.arange(WORD_BUCKETS, SIZE)))
    value = np.concatenate((np.full(len(found), 1 / np.sqrt(max(len(found), 1))), structure(text, words, counts)))
    return index, value


class Machine:
    """Weights of a factorisation machine, fitted by Adagrad on logistic loss."""

    def __init__(self, bias: float = 0.0, seed: int = 7):
        self.bias, self.w = bias, np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (SIZE, FACTORS))

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.v[index] * value[:, None]
        total = v.sum(0)
        return float(self.bias + self.w[index] @ value + 0.5 * (total @ total - np.einsum("ij,ij->", v, v)))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 12, batch: int = 32, rate: float = 0.15, decay: float = 1e-5) -> Machine:
        rng = np.random.default_rng(11)
        seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                part = order[start : start + batch]
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                begins = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in part])[:-1]))
                owner = np.repeat(np.arange(len(part)), np.diff(np.append(begins, len(index))))
                v = self.v[index] * value[:, None]
                total = np.add.reduceat(v, begins)
                margin = self.bias + np.add.reduceat(self.w[index] * value, begins) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), begins))
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
                pull = slope[owner] * value
                used, where = np.unique(index, return_inverse=True)
                gw = np.bincount(where, pull, len(used)) + decay * self.w[used]
                each = pull[:, None] * (total[owner] - v)
                gv = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(FACTORS)], 1) + decay * self.v[used]
                seen_w[used] += gw**2
                seen_v[used] += gv**2
                seen_b += float(slope.sum()) ** 2
                self.w[used] -= rate * gw / np.sqrt(seen_w[used])
                self.v[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
                self.bias -= rate * float(slope.sum()) / np.sqrt(seen_b)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, text: str, key: str) -> DataFrame:
    """(_id, _text, _label) of at most ``sample`` labelled rows that are not held out, picked by the hash of their key."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(F.col(key))).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label"))
    picked = known.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    return rows.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Machine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                rows = [features(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"h": part.column("h"), "y": part.column("_label"), "index": pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()), "value": pa.array([v.tobytes() for _, v in rows], pa.binary())})

    rows = labelled_sample(docs, labels, label, sample, text, key).withColumn("h", F.xxhash64("_id"))
    got = rows.select("h", "_label", "_text").mapInArrow(run, "h long, y int, index binary, value binary").toArrow().sort_by("h")
    y = got.column("y").to_numpy().astype(float)
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    machine = Machine(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        machine.v[:] = 0
        return machine
    return machine.fit([(np.frombuffer(i, np.int32), np.frombuffer(v)) for i, v in zip(got.column("index").to_pylist(), got.column("value").to_pylist(), strict=True)], y)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, score, predicted) of every row of ``docs``; row is the whole row, whatever its columns' names."""
    machine = fitted(docs, labels, label, sample, text, key)
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    def score(texts: list[str]) -> list[float]:
        m = Machine.__new__(Machine)
        m.bias, m.w, m.v = sent.value
        return [m.score(t) for t in texts]

    return scored(docs, text, threshold, score)


def scored(docs: DataFrame, text: str, threshold: float, score) -> DataFrame:
    """(row, score, predicted) by a function from texts to scores. No shuffle."""
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            both = pa.RecordBatch.from_arrays([rows, rows.field(place)], names=["row", "text"])
            for part in text_slices(both, "text"):
                s = score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["row", "score", "predicted"])

    return docs.select(whole_row(docs)).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``."""
    rows = quality_scores(docs.select(key, text), labels, threshold, "quality", sample, text, key)
    return rows.select(F.col(f"row.{key}").alias(key), is_held_out(F.col(f"row.{key}")).alias("held_out"), "score", "predicted")
