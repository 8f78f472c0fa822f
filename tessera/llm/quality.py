"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; the unlabelled set is web text as it comes, good and bad. A logistic
model on features of the text minimises the non-negative unbiased risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

whose minimum is the posterior of the positive class. The class prior is estimated first: among the texts that a plain
positive-against-unlabelled model ranks highest there are hardly any bad ones, so the share of the unlabelled above a
threshold over the share of the positives above it comes down to the prior.

The fit uses bounded samples, ``SAMPLE`` documents of either kind, chosen by a hash of their ids. Scoring reads all
whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, split_words

SAMPLE = 10_000
SHAPES = 256
ROUNDS, RATE, SHRINK = 400, 0.05, 5e-3

#: Features are scaled by their deviation, at least LEAST_SCALE (rare shapes would dominate else), and cut at +-CLIP.
LEAST_SCALE, CLIP = 0.05, 4.0

#: Score of every text when there is no positive to learn from.
NO_MODEL = 0.5


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: shares of its words with some property, sizes, and counts of word shapes hashed to
    ``SHAPES`` columns. A shape is the word with runs of capitals, other letters and digits as one character each."""
    codes, offsets, vocab = split_words(texts)
    n = np.diff(offsets).astype(np.float64)
    rows = np.repeat(np.arange(len(n)), np.diff(offsets))
    length = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.float64)

    def share(pattern):
        return pc.match_substring_regex(vocab, pattern).to_numpy(zero_copy_only=False).astype(np.float64)

    shape = vocab
    for pattern, by in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lt}\p{M}]+", "a"), (r"\p{N}+", "9"),
                        (r"([^Aa9])[^Aa9]+", r"\1+")):
        shape = pc.replace_substring_regex(shape, pattern, by)
    shape = shape.dictionary_encode()
    bucket = np.array([zlib.crc32(s.encode()) % SHAPES for s in shape.dictionary.to_pylist()], np.int64)
    bucket = bucket[shape.indices.to_numpy(zero_copy_only=False)] if len(vocab) else np.zeros(0, np.int64)
    words = np.maximum(n, 1)
    same = np.zeros(len(codes))
    if len(codes):
        same[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    pairs = np.unique(rows * np.int64(len(vocab) + 1) + codes) // (len(vocab) + 1) if len(codes) else rows
    distinct = np.bincount(pairs, minlength=len(n)).astype(np.float64)
    columns = [np.log1p(n), distinct / words, np.log1p(distinct) / np.maximum(np.log1p(n), 1),
               _per_row(same, offsets) / words, np.log1p(_per_row(length[codes], offsets) / words)]
    for pattern in (r"^\p{Lu}\p{Lu}+", r"[\p{L}\p{N}]$", r"[.,;:?!]$", r"[^\p{L}\p{N}.,;:?!'\"()-]", r"\p{N}",
                    r"^[^\p{L}\p{N}]+$", r"(.)[.!?,;:]{2,}$", r"https?:|www\.|@"):
        columns.append(_per_row(share(pattern)[codes], offsets) / words)
    counts = np.bincount(rows * SHAPES + bucket[codes], minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
    return np.column_stack([*columns, np.sqrt(counts / words[:, None])])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _sample(docs: DataFrame, ids: Column, total: int, seed: int) -> DataFrame:
    """About ``SAMPLE`` of ``total`` rows by a hash of the id, the same rows whatever the partitions."""
    return docs.filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), ids), 1) <= F.lit(sample_bound(total)))


def sample_bound(total: int) -> int:
    """Greatest 63-bit hash that is in a sample of ``SAMPLE`` of ``total`` rows."""
    whole = (1 << 63) - 1
    return whole if total <= SAMPLE else whole * SAMPLE // total


def _collect(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text")).astype("<f4")
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed], ["doc_id", "x"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))
    return np.array([np.frombuffer(r["x"], "<f4") for r in rows], np.float64).reshape(len(rows), -1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -CLIP, CLIP)


def descend(gradient, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Class prior of the positives among the unlabelled, from a logistic model of one against the other: the least
    share above a threshold of the unlabelled over that of the positives, where half of the positives or more are."""
    def gradient(w):
        up = pos.T @ (_sigmoid(pos @ w) - 1) / len(pos)
        down = unl.T @ _sigmoid(unl @ w) / len(unl)
        return up + down + SHRINK * w

    w = descend(gradient, pos.shape[1], ROUNDS // 4)
    p, u = np.sort(pos @ w), np.sort(unl @ w)
    at = np.quantile(p, np.linspace(0.02, 0.5, 49))
    above_p = 1 - np.searchsorted(p, at) / len(p)
    above_u = 1 - np.searchsorted(u, at) / len(u)
    return float(np.clip((above_u / np.maximum(above_p, 1e-9)).min(), 0.05, 0.99))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """Weights, scale and prior; None without positives. Only labels of rows that aren't held out are read, and of
    contradicting labels of one id none is a positive."""
    good = (labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("least"))
            .filter("least = 1").select("doc_id"))
    learn = docs.filter(~held_out(F.col("doc_id")))
    n_good, n_docs = good.count(), learn.count()
    if not n_good or not n_docs:
        return None
    ids = F.col("doc_id")
    some = _sample(learn, ids, n_good, 1).join(_sample(good, ids, n_good, 1), "doc_id", "left_semi")
    pos, unl = _collect(some), _collect(_sample(learn, ids, n_docs, 2))
    if not len(unl):
        raise RuntimeError(f"no row of {n_docs} is in the sample")
    if not len(pos):
        return None  # labels of other documents only
    mean, scale = unl.mean(0), np.maximum(unl.std(0), LEAST_SCALE)
    pos, unl = (np.column_stack([_scaled(x, mean, scale), np.ones(len(x))]) for x in (pos, unl))
    prior = estimate_prior(pos, unl)

    def gradient(w):
        s_pos, s_unl = _sigmoid(pos @ w), _sigmoid(unl @ w)
        # loss of calling a text bad, on the unlabelled less the positives' part of them: the bad texts' risk
        risk = -np.log1p(-np.minimum(s_unl, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(s_pos, 1 - 1e-12)).mean()
        g_bad = unl.T @ s_unl / len(unl) - prior * (pos.T @ s_pos) / len(pos)
        if risk < 0:
            return -g_bad  # climb back until the estimate is no longer negative
        return prior * (pos.T @ (s_pos - 1)) / len(pos) + g_bad + SHRINK * w

    return {"w": descend(gradient, pos.shape[1]), "mean": mean, "scale": scale, "prior": prior}


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on).

    Null texts count as empty; an empty text has features like any other. Repeated rows score alike. Without positives
    every score is ``NO_MODEL``. An empty table gives no rows; other columns are not read.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = scores(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def scores(texts: pa.Array, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), NO_MODEL)
    x = _scaled(features(texts), model["mean"], model["scale"])
    return _sigmoid(x @ model["w"][:-1] + model["w"][-1])


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    model, names = fit(docs, labels), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scores(part.column("text"), model) >= threshold))

    return docs.mapInArrow(run, names)
