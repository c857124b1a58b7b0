"""Toxicity by multiple-instance learning: sentences joined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready
from .shingles import marked_words, release, slices

BITS = 18  # words are told apart by so many bits of their hashes
FOLDS = 5

_SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_ENDS = np.array([chr(c) in ".!?\n" for c in range(256)])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(chance of each sentence, edges of the texts among the sentences)."""
        features, lengths, edges = sentences(column)
        if not len(lengths):
            return np.zeros(0), edges
        starts = np.cumsum(lengths) - lengths
        z = self.bias + np.add.reduceat(self.weights[features], starts)
        return 1 / (1 + np.exp(-np.clip(z, -50, 30))), edges


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word features, words in each sentence, edges of the texts among the sentences).

    Words are runs of letters, digits and non-ASCII bytes; ``.``, ``!``, ``?`` and line ends close a
    sentence; sentences without a word count for nothing.
    """
    hashes, edges, ends = marked_words(column, _SEPARATORS, _ENDS)
    n = len(hashes)
    opens = np.zeros(n + 1, dtype=bool)
    opens[edges] = True
    opens[n] = True
    if n:
        opens[1:n] |= np.diff(ends) != 0
    starts = np.flatnonzero(opens)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.diff(starts), np.searchsorted(starts, edges)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is divisible by 5. No id: not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, budget: int = 32 << 20, steps: int = 250, decay: float = 1e-3) -> Model:
    """Learn from at most ``sample`` labelled documents of each label, in the order of a hash.

    Only documents outside the held-out fold serve as examples, whole and whatever their length, of each
    label as many as begin within ``budget`` bytes of text in that order. So the driver gets at most the
    words of ``2 * budget`` bytes and of two documents more. The labels' true shares weigh the examples. The likelihood of the document labels under the noisy-or of their sentences is climbed
    by full gradient steps. Words are left out that fewer than three examples hold, or whose share of
    toxic examples is within four standard errors of the mean. Without labels of both kinds, no text
    is toxic.
    """
    ready(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if len(shares) < 2:
        return Model(np.zeros(1 << BITS), -50.0)
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * sample rows
    order = F.xxhash64("doc_id")
    sizes = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("toxic", "doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    within = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).select("doc_id", "toxic")
    texts = docs.where("text IS NOT NULL").join(F.broadcast(within), "doc_id").select("toxic", "text")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            features, lengths, edges = sentences(batch.column(1))
            cut = np.cumsum(np.r_[0, lengths])[edges]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([features[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                pa.array([lengths[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            ], names=["toxic", "features", "lengths"])

    rows = texts.mapInArrow(shrink, "toxic int, features binary, lengths binary").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["features"])))
    if {r["toxic"] for r in rows} != {0, 1}:
        return Model(np.zeros(1 << BITS), -50.0)
    words_ = [np.frombuffer(r["features"], "<u4").astype(np.int64) for r in rows]
    lengths = [np.frombuffer(r["lengths"], "<u4").astype(np.int64) for r in rows]
    y = np.array([r["toxic"] for r in rows])
    weight = np.array([shares[k] / max(1, int((y == k).sum())) for k in (0, 1)])[y]
    weight *= len(y) / weight.sum()
    feature = np.concatenate(words_)
    sentence = np.repeat(np.arange(sum(map(len, lengths))), np.concatenate(lengths))
    document = np.repeat(np.arange(len(rows)), [len(x) for x in lengths])
    often, toxic_often = (np.bincount(np.concatenate([np.unique(w) for w, t in zip(words_, y) if t >= least]), minlength=1 << BITS) for least in (0, 1))
    share = y.mean()
    excess = (toxic_often - often * share) / np.sqrt(np.maximum(often * share * (1 - share), 1e-9))
    use = ((often >= 3) & (np.abs(excess) >= 4))[feature]
    kept, dense = np.unique(feature[use], return_inverse=True)
    sentence = sentence[use]
    w, b = np.zeros(len(kept)), float(np.log(max(1e-3, shares[1] / sum(shares.values())) / max(1.0, len(document) / len(rows))))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.clip(b + np.bincount(sentence, w[dense], minlength=len(document)), -50, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(rows))  # log chance of no toxic sentence
        some = np.maximum(-np.expm1(none), 1e-12)
        gz = p * np.where(y == 1, -np.exp(none) / some, 1.0)[document] * weight[document]
        g, gb = np.bincount(dense, gz[sentence], minlength=len(kept)) / len(rows) + decay / len(rows) * w, gz.sum() / len(rows)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.15 * min(1.0, 3 * (1 - (t - 1) / steps))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[kept] = w
    return Model(weights, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, n_offending`` for every document, in one pass.

    The score is the noisy-or of all sentences of the whole text: 0 for null, empty and wordless
    texts. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 2 ** BITS numbers, 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        own = Model(weights.astype(np.float64), bias)
        for batch in slices(batches):
            p, edges = own.sentence_scores(batch.column(2))
            total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
            many = np.concatenate([[0], np.cumsum(p >= 0.5)])
            out = np.clip(-np.expm1(total[edges[1:]] - total[edges[:-1]]), 0.0, 1.0) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(np.diff(edges)), pa.array(many[edges[1:]] - many[edges[:-1]])], names=["doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending"])
        release()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: ``doc_id, start, end, score, sentence``; code points, end exclusive.

    Null, empty and wordless texts have none; repeated rows are told each by itself.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans = [m.span() for m in re.finditer(r"[^.!?\n]+", text.as_py() or "")]
                parts = [text.as_py()[a:b] for a, b in spans]
                if parts:
                    p, edges = shared.value.sentence_scores(pa.array(parts, pa.string()))
                    for (a, b), part, i, j in zip(spans, parts, edges[:-1], edges[1:]):
                        if j > i and p[i] >= least:
                            rows.append((doc_id, a, b, float(p[i]), part))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "end", "score", "sentence"), r)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start int, end int, score double, sentence string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, then score every document."""
    return score(docs, fit(docs, labels))
