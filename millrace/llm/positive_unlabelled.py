"""Classifiers from trusted positives and unlabelled text, by the non-negative unbiased risk, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm.arrays import hashes, lower, steps, texts, words

WORD_BITS = 17
#: First bytes of a longer word that are features of their own: stems in languages that build on them.
PREFIXES = (4, 5, 6, 7)
#: Features that a model has at most, the most telling ones, and the standard errors that each needs to be one.
MOST_FEATURES, LEAST_ERRORS = 1_000, 1.0
#: Bins of each measure of a text, and the measures.
BINS, MEASURES = 16, 40
WORDS = (1 + len(PREFIXES)) << WORD_BITS
WIDTH = WORDS + BINS * MEASURES

#: Kinds of bytes: others, line ends, digits, capitals, bytes above 127, and each of these marks.
_KINDS = [b"", b"\n", b"0123456789", bytes(range(65, 91)), bytes(range(128, 256)), *(bytes([x]) for x in b"|#$%&*()[]{}<>=+-_/\\~^@:;.,!?\"'")]
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of each text: the hashed words in it, A-Z as a-z, their first bytes,
    and one bin of each measure.

    Measures: words, distinct words among them, words equal to the one before, mean word length, and the shares of
    line ends, digits, capitals, bytes above 127, and each punctuation mark among the bytes. Empty texts have only
    the lowest bins.
    """
    n = len(off) - 1
    length = np.maximum(np.diff(off), 1)
    starts, ends, row = words(buf, off)
    low = lower(buf)
    word = hashes(low, starts, ends)
    drop = np.uint64(64 - WORD_BITS)
    keys = [(row << WORD_BITS) | (word >> drop).astype(np.int64)]
    for of in PREFIXES:
        long_enough = ends - starts > of
        head = hashes(low, starts[long_enough], starts[long_enough] + of)
        keys.append((row[long_enough] << WORD_BITS) | (head >> drop).astype(np.int64))
    found = [np.unique(k) for k in keys]
    r = found[0] >> WORD_BITS
    count = np.bincount(row, minlength=n)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])

    kinds = np.bincount(np.repeat(np.arange(n) * len(_KINDS), np.diff(off)) + _KIND[buf], minlength=n * len(_KINDS))
    kinds = kinds.reshape(n, len(_KINDS))[:, 1:] / length[:, None]

    def small(x: np.ndarray) -> np.ndarray:
        """Bins by halving: shares from 1 down to 2 ** -14, and 0."""
        return np.where(x > 0, np.clip(-np.log2(np.maximum(x, 1e-9)), 0, BINS - 2).astype(np.int64) + 1, 0)

    some = np.maximum(count, 1)
    measures = [
        np.clip(np.log2(count + 1), 0, BINS - 1).astype(np.int64),
        np.clip(np.bincount(r, minlength=n) / some * (BINS - 1), 0, BINS - 1).astype(np.int64),
        np.clip(np.bincount(row, again, n) / some * (BINS - 1), 0, BINS - 1).astype(np.int64) + 0,
        np.clip(np.bincount(row, ends - starts, n) / some, 0, BINS - 1).astype(np.int64),
        *(small(kinds[:, k]) for k in range(kinds.shape[1])),
    ]
    base = WORDS + np.arange(len(measures)) * BINS
    bins = np.stack(measures, axis=1) + base
    rows = [k >> WORD_BITS for k in found]
    those = [(k & ((1 << WORD_BITS) - 1)) + (i << WORD_BITS) for i, k in enumerate(found)]
    return np.concatenate([*rows, np.repeat(np.arange(n), len(measures))]), np.concatenate([*those, bins.ravel()])


@dataclass
class Model:
    """A linear model: a text's margin is the sum of its features' weights and ``bias``, its score the logistic of it."""

    weight: np.ndarray
    bias: float

    def margin(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(row, self.weight[feature], n)

    def score(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(row, feature, n), -40, 40)))


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, few: float = 1.0, most: int = MOST_FEATURES, least: float = LEAST_ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell most, and a scale of each for training.

    ``in_p`` and ``in_u`` count the rows with each feature among n_p positives and n_u unlabelled. What a feature tells
    is the difference of its shares in standard errors. Shares below ``few`` rows of the smaller side count as that for
    the error, and a feature of under 3 rows tells nothing. The scale grows with the square of the errors, so weak
    features are held back by the pull of weights to 0 rather than left out.
    """
    both = (in_p + in_u) / (n_p + n_u)
    likely = np.maximum(both * (1 - both), few / min(n_p, n_u))
    errors = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(likely * (1 / n_p + 1 / n_u))
    errors[(in_p + in_u < 3) | (errors < least)] = 0
    picked = np.argsort(-errors, kind="stable")[:most]
    picked = np.sort(picked[errors[picked] > 0])
    return picked, np.minimum((errors[picked] / 4) ** 2, 4)


def fit(row: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float, columns: np.ndarray, scale: np.ndarray, steps_taken: int = 200, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l(z) = log(1 + exp(-z)), by Adam.

    ``positive`` marks the trusted rows, the others are unlabelled; ``row`` has ``feature``, one of the sorted ``columns``
    with ``scale``. While the middle difference, the risk on negatives, is below 0, the step goes up its gradient
    instead. ``decay`` pulls the weights to 0.
    """
    n = len(positive)
    at = np.searchsorted(columns, feature)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, b = np.zeros(len(columns)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share_p, share_u, value = positive / n_p, ~positive / n_u, scale[at]
    for t in range(1, steps_taken + 1):
        g = b + np.bincount(row, w[at] * value, n)
        p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        loss_neg = np.logaddexp(0, g)
        on_negatives = share_u @ loss_neg - prior * (share_p @ loss_neg)
        slope_neg = share_u * p - prior * share_p * p
        slope = prior * share_p * (p - 1) + slope_neg if on_negatives >= 0 else -slope_neg
        full = np.append(np.bincount(at, slope[row] * value, len(w)) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weight = np.zeros(WIDTH)
    weight[columns] = w * scale
    return Model(weight, b)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``part``; rows without doc_id are never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % parts == part, F.lit(False))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


@shared.lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's trusted rows, and of all its rows, have each feature; feature WIDTH is the rows themselves."""
    in_p, in_u = np.zeros(WIDTH + 1, np.int64), np.zeros(WIDTH + 1, np.int64)
    for batch in batches:
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        buf, off = texts(batch.column("text"))
        for a, b in steps(off):
            row, feature = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            in_u += np.bincount(feature, minlength=WIDTH + 1)
            if trusted[a:b].any():
                in_p += np.bincount(feature[trusted[a:b][row]], minlength=WIDTH + 1)
        in_u[WIDTH] += batch.num_rows
        in_p[WIDTH] += trusted.sum()
    some = np.flatnonzero(in_u)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(in_p[some]), pa.array(in_u[some])], ["feature", "in_p", "in_u"])


@shared.lean
def _picked(batches: Iterator[pa.RecordBatch], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The features of each row that are among ``keep``, in order."""
    for batch in batches:
        buf, off = texts(batch.column("text"))
        for a, b in steps(off):
            row, feature = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            mine = np.isin(feature, keep)
            row, feature = row[mine], feature[mine]
            order = np.lexsort((feature, row))
            edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(feature[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "trusted", "drawn")), lists], ["doc_id", "trusted", "drawn", "features"])


def train(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, decay: float = 1e-3, sample: int = 12_000, seed: int = 7) -> Model:
    """A model for ``label`` from rows that aren't held out.

    Trusted positives are labelled rows with 1, about ``sample`` of them at most, chosen by a hash of their doc_id. The
    unlabelled are all rows of ``docs``, whose labels aren't looked at: which features tell is found from all of them,
    and the risk is minimised on about ``sample`` of them, so what reaches the driver is bounded. The class prior is the
    share of 1 among the labelled rows (a doc_id labelled twice counts by its largest label), between 0.001 and 0.999;
    labelled 0 have no other use. Without a trusted or an unlabelled row, or without a telling feature, every text
    scores the prior, 0.5 without labels.
    """
    shared.small_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    marks = marks.filter(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("label").alias("label"))
    count, ones = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    prior = float(np.clip(ones / count if count else 0.5, 0.001, 0.999))
    flat = Model(np.zeros(WIDTH), float(np.log(prior / (1 - prior))))
    pool = _text(docs).filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"), parts, part))
    n = pool.count()

    def chosen(of: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < F.lit(int(min(1.0, sample / max(1, of)) * (1 << 40)))

    ids = marks.filter("label = 1").filter(chosen(ones)).select("doc_id", F.lit(True).alias("trusted"))  # about ``sample`` rows at most
    rows = pool.join(F.broadcast(ids), "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), chosen(n).alias("drawn"))
    counts = rows.mapInArrow(_counted, "feature int, in_p long, in_u long").groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")).toArrow()
    in_p, in_u = np.zeros(WIDTH + 1, np.int64), np.zeros(WIDTH + 1, np.int64)
    in_p[counts.column("feature").to_numpy()] = counts.column("in_p").to_numpy()
    in_u[counts.column("feature").to_numpy()] = counts.column("in_u").to_numpy()
    n_p, n_u = int(in_p[WIDTH]), int(in_u[WIDTH])
    if not n_p or not n_u:
        return flat
    columns, scale = telling(in_p[:WIDTH], in_u[:WIDTH], n_p, n_u)
    if not len(columns):
        return flat
    got = rows.filter("trusted OR drawn").mapInArrow(partial(_picked, keep=columns), "doc_id long, trusted boolean, drawn boolean, features array<int>").toArrow()
    got = got.combine_chunks().sort_by("doc_id")
    lists = pa.concat_arrays(got.column("features").chunks)
    at = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy()))
    feature = lists.flatten().to_numpy().astype(np.int64)
    sides = [got.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("trusted", "drawn")]
    if not sides[1].any():
        return flat
    row, n_rows = [], 0
    for side in sides:  # a trusted row is unlabelled as well if it is drawn
        row.append((np.cumsum(side) - 1 + n_rows)[at[side[at]]])
        n_rows += int(side.sum())
    what = np.concatenate([feature[side[at]] for side in sides])
    return fit(np.concatenate(row), what, np.arange(n_rows) < int(sides[0].sum()), prior, columns, scale, decay=decay)


@shared.lean
def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = texts(batch.column("text"))
        parts = [model.score(*features(buf[off[a] : off[b]], off[a : b + 1] - off[a]), b - a) for a, b in steps(off)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row, row by row, no shuffle."""
    return _text(docs).mapInArrow(partial(_scored, model=model), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, decay: float = 1e-3, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Only texts are inputs of a score; null texts score as empty ones. Repeated rows give repeated rows; a row without
    doc_id is scored but never learnt from; an empty table gives no rows.
    """
    found = scores(docs, train(docs, labels, label, parts, part, decay))
    return found.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@shared.lean
def _marked(batches: Iterator[pa.RecordBatch], model: Model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = texts(batch.column(at).cast(pa.string()))
        parts = [model.score(*features(buf[off[a] : off[b]], off[a : b + 1] - off[a]), b - a) for a, b in steps(off)]
        score = np.concatenate(parts) if parts else np.zeros(0)
        yield batch.filter(pa.array(score < threshold))


def below(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, decay: float = 1e-3, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    model = train(docs, labels, label, parts, part, decay)
    at = docs.columns.index("text")
    return docs.mapInArrow(partial(_marked, model=model, at=at, threshold=threshold), docs.schema)
