"""Operator 7: toxic documents by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) with x_i = 1 where a document has term i (Rendle
2010). Terms are hashed, so no vocabulary is kept or joined. The pairwise part learns what additive weights can't: a
group's name beside an insult, though neither alone decides.

Training takes at most ``max_rows`` labelled rows, those of the least hashes, a bound that keeps the fit on one machine
whatever the corpus and however often a labelled document is repeated; scoring takes all documents, whole, in one pass without a shuffle. The terms that
enter the machine are screened first: those that are associated with the label, and those that are associated with it
among the documents that have one of the former, so that terms that act only together with others aren't lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import distinct, fresh, lean, mix, pieces, release, table, text_buffers, words

#: Labelled documents used for the fit, at most.
MAX_ROWS = 20_000
FACTORS = 8
#: Likelihood ratio (G squared) from which a term enters.
SCREEN = 24.0
THRESHOLD = 0.3


def short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


@dataclass
class Machine:
    """Terms (sorted hashes of 32 bits) with their weights and factors."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from distinct (row, index of a term)."""
        linear = self.w0 + np.bincount(row, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            linear += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return 1 / (1 + np.exp(-np.clip(linear, -30, 30)))

    def look_up(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, index) of the machine's terms among the words of texts."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = short(hashes)
        seen = np.zeros(1 << 20, bool)
        seen[self.terms & np.uint32((1 << 20) - 1)] = True
        maybe = np.flatnonzero(seen[hashes & np.uint32((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == hashes[maybe]
        keys = distinct(row[maybe[hit]].astype(np.int64) * len(self.terms) + at[hit])
        return keys // len(self.terms), keys % len(self.terms)

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for batch in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
            hashes, _, _, row = words(*text_buffers(pc.utf8_lower(batch.column(0))), "alnum")
            out.append(self.scores(*self.look_up(hashes, row), len(batch)))
        return np.concatenate(out)


def ratio(with_positive: np.ndarray, with_any: np.ndarray, positive: float, rows: float) -> np.ndarray:
    """The likelihood ratio of a term and the label, as a chi-squared value of one degree of freedom."""

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)

    a, b = with_positive, with_any - with_positive
    c, d = positive - with_positive, rows - positive - b
    return 2 * (part(a, with_any * positive / rows) + part(b, with_any * (rows - positive) / rows) + part(c, (rows - with_any) * positive / rows) + part(d, (rows - with_any) * (rows - positive) / rows))


def _screened(keys: np.ndarray, row: np.ndarray, label: np.ndarray, screen: float) -> np.ndarray:
    """Indexes of the terms that enter; keys are term indexes, distinct within a row."""
    terms = int(keys.max()) + 1 if len(keys) else 0

    def pick(use: np.ndarray) -> np.ndarray:
        if not use.any() or label[use].all() or not label[use].any():
            return np.zeros(terms, bool)
        of = use[row]
        count = np.bincount(keys[of], minlength=terms)
        positive = np.bincount(keys[of], label[row[of]], minlength=terms)
        return (count >= 5) & (ratio(positive, count, label[use].sum(), use.sum()) >= screen)

    first = pick(np.ones(len(label), bool))
    near = np.zeros(len(label), bool)
    near[row[first[keys]]] = True
    return np.flatnonzero(first | pick(near))


def fit(label: np.ndarray, hashes: np.ndarray, row: np.ndarray, factors: int = FACTORS, screen: float = SCREEN, rounds: int = 400) -> Machine:
    """A machine for documents' labels and their distinct (term hash, row). Without both labels, one that rejects nothing."""
    none = Machine(np.zeros(0, np.uint32), -30.0, np.zeros(0), np.zeros((0, factors)))
    if not len(label) or not label.any() or label.all():
        return none
    all_terms = distinct(hashes.copy())
    keys = np.searchsorted(all_terms, hashes).astype(np.int32)
    chosen = _screened(keys, row, label, screen)
    place = np.full(len(all_terms) + 1, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    term = place[keys]
    held = np.flatnonzero(term >= 0)
    row, term = row[held], term[held]
    n, m = len(label), len(chosen)
    # documents of the same label and the same chosen terms, such as those with none, are one row with a weight
    named = np.zeros(n, np.uint64)
    np.add.at(named, row, mix(term.astype(np.uint64) + np.uint64(1)))
    _, lead, of, weight = np.unique(named ^ mix(label.astype(np.uint64) + np.uint64(7)), return_index=True, return_inverse=True, return_counts=True)
    held = lead[of[row]] == row
    row, term, label, n = of[row[held]].astype(np.int64), term[held], label[lead], len(lead)
    rng = np.random.Generator(np.random.PCG64(7))
    theta = np.concatenate([np.zeros((m, 1)), rng.normal(0, 0.05, (m, factors))], axis=1)
    rate = np.average(label, weights=weight)
    w0, past0, past = float(np.log(rate / (1 - rate))), 1e-6, np.full(theta.shape, 1e-6)
    shrink = np.concatenate([[0.02], np.full(factors, 0.2)])
    machine = Machine(all_terms[chosen], w0, theta[:, 0], theta[:, 1:])
    for _ in range(rounds):
        machine.w0, machine.w, machine.v = w0, theta[:, 0], theta[:, 1:]
        error = weight * (machine.scores(row, term, n) - label)
        slope = shrink * theta + gradient(row, term, error, theta)
        past += slope**2
        theta = theta - 0.2 * slope / np.sqrt(past)
        past0 += error.sum() ** 2
        w0 -= 0.2 * error.sum() / np.sqrt(past0)
    machine.w0, machine.w, machine.v = float(w0), theta[:, 0], theta[:, 1:]
    return machine


def gradient(row: np.ndarray, term: np.ndarray, error: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Slopes of the loss by the weight and the factors of each term, from the rows' errors (the slopes by their scores)."""
    m, own = len(theta), np.bincount(term, error[row], len(theta))
    slope = np.empty_like(theta)
    slope[:, 0] = own
    for f in range(1, theta.shape[1]):
        total = np.bincount(row, theta[term, f], len(error))
        slope[:, f] = np.bincount(term, (error * total)[row], m) - theta[:, f] * own
    return slope


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole, 2)):
        hashes, _, _, row = words(*text_buffers(pc.utf8_lower(batch.column(2))), "alnum")
        at = np.searchsorted(row, np.arange(len(batch) + 1))
        packed = [distinct(short(hashes[a:b])).tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["place", "label", "terms"])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, term hashes and the rows of these, of at most ``max_rows`` labelled rows: four bytes for each distinct term of a document."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("gw_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the sample is of at most max_rows short rows, whatever the size of the tables
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id").alias("place"), F.col("gw_label"), "text")
    # a document may be repeated without bound: the rows are bounded after the join, too
    rows = found.mapInArrow(lean(_terms), "place long, label double, terms binary").orderBy("place", "terms").limit(max_rows).toArrow()
    label = rows["label"].to_numpy()
    terms = rows["terms"].combine_chunks()
    terms = pa.concat_arrays(terms.chunks) if isinstance(terms, pa.ChunkedArray) else terms
    sizes = pc.binary_length(terms).to_numpy(zero_copy_only=False) // 4
    hashes = np.frombuffer(b"".join(x.as_buffer() for x in terms), np.uint32)
    return label, hashes, np.repeat(np.arange(len(label), dtype=np.int32), sizes)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    return fit(*training_rows(docs, labels, max_rows))


def score(machine: Machine, text: Column) -> Column:
    """The machine's score of a text column; 0 for a null text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        made = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0.0, machine.of_texts(texts))
        release()
        return pa.array(made)

    return run(text)


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, any others) as (doc_id, score, toxic), toxic from ``threshold`` on.

    A null text scores 0, an empty one as one without terms, a long one by all of its terms. Labels that are null, or of
    documents that aren't there, have no effect; of several labels of a document the greatest counts. Without labels of
    both kinds nothing is toxic. Repeated rows score alike, and a labelled one is fitted as often as it stands there,
    within ``max_rows`` rows in all. Empty tables give an empty result (documents) or nothing toxic (labels). Other
    columns, whatever their names, have no effect.
    """
    scored = docs.select("doc_id", score(train(docs, labels, max_rows), F.col("text")).alias("score"))
    return scored.withColumn("toxic", F.col("score") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, whole, that ``toxic_documents`` doesn't call toxic; null and empty texts stay."""
    name = fresh(docs, "gw_score")
    return docs.withColumn(name, score(train(docs, labels, max_rows), F.col("text"))).where(F.col(name) < threshold).select(docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
