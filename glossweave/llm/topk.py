"""Operator 8: exact top-k by inner product, with norm-bucketed retrieval (LEMP, Teflioudi et al. 2015).

Vectors are sorted by length and cut into buckets, so that within a bucket lengths are alike. A query that already has
k products of at least t needs from a bucket of greatest length l only vectors whose cosine with it is t / (|q| l) or
more. Where that local threshold is over 1 the bucket, and all shorter ones, are skipped for the query. Else one of two
prunings is chosen for each bucket and query: by length, where the lengths within the bucket tell more, or by
coordinates: with a cosine of c or more, coordinate f of the vector's direction lies within
q_f c -+ sqrt((1 - q_f**2) (1 - c**2)), which is checked for the query's largest coordinates. What is left is verified.

The queries are the vectors whose id is divisible by ``every``, in blocks; all vectors are searched. A query first meets
the longest buckets, which gives it a k-th best product, and with it the length below which no vector can help it.
Queries are then sorted by that length and cut into blocks anew, and a block meets only those ranges of buckets in which
a vector is long enough for one of its queries: pairs of a block and a range are ruled out by two numbers, before any
vector moves. Each pair that is left is a group of bounded size. A query's best of each range are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import stored, table

K = 10
#: Queries are the vectors whose id is divisible by this.
EVERY = 100
#: Vectors of a bucket, and buckets of a range.
BUCKET, RANGE = 1024, 16
#: Coordinates that are checked, and the local threshold below which checking them isn't tried: nearly all would pass.
FOCUS, WORTH = 4, 0.8
#: Decimal places to which products are compared: beyond it the order of summation decides.
PLACES = 12

_BLOCKS = "part int, number int, dim int, top double, ids binary, vectors binary, need double, kth binary"
_MET = "id long, dim int, kth double, need double, v array<double>, near array<long>, score array<double>"
_SCORES = "query_id long, neighbor_id long, score double"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _block(part: int, number: int, ids: list, vectors: list, kth: list, need: list) -> pa.RecordBatch:
    v = np.array(vectors)
    top = float(np.sqrt((v * v).sum(axis=1)).max())
    row = {"part": part, "number": number, "dim": v.shape[1], "top": top, "ids": np.array(ids, np.int64).tobytes(), "vectors": v.tobytes(), "need": float(min(need)), "kth": np.array(kth).tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=_arrow(_BLOCKS))


def _pack(size: int):
    """Rows (id, v, kth, need), in order, as blocks of ``size`` vectors of the same dimension, numbered within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            values, ends = batch.column(1).flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch.column(1).value_lengths().to_numpy())))
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if held[0] and (len(held[0]) == size or len(held[1][0]) != b - a):
                    yield _block(part, number, *held)
                    held, number = ([], [], [], []), number + 1
                for column, x in zip(held, (batch.column(0)[i].as_py(), values[a:b], batch.column(2)[i].as_py(), batch.column(3)[i].as_py())):
                    column.append(x)
        if held[0]:
            yield _block(part, number, *held)

    return run


class Bucket:
    """Vectors of like lengths: ids, lengths, directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        length = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.direction = self.vectors / np.where(self.length > 0, self.length, 1)[:, None]


class Best:
    """The k best products of each query so far, ties going to the lesser id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def threshold(self) -> np.ndarray:
        return self.score[:, -1]

    def shown(self) -> np.ndarray:
        return np.isfinite(self.score)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of some queries, as many for each; -inf is none."""
        k = self.score.shape[1]
        score = np.concatenate([self.score[rows], scores], axis=1)
        both = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        if score.shape[1] > 4 * k:
            # all that are as good as the k-th best: ties stay for the sort
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            keep = score >= kth
            width = int(keep.sum(axis=1).max())
            first = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            score, both = np.take_along_axis(np.where(keep, score, -np.inf), first, 1), np.take_along_axis(both, first, 1)
        order = np.lexsort((both, -score), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(both, order, 1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.round(queries @ vectors.T, PLACES)


def search_bucket(q_ids: np.ndarray, q: np.ndarray, q_length: np.ndarray, bucket: Bucket, best: Best, start: np.ndarray, counts: dict[str, int]) -> None:
    """Adds a bucket's products to the best, of the queries that it isn't pruned for."""
    # a margin for rounding: nothing that ties with the k-th best is pruned
    threshold = np.maximum(best.threshold, start) - 10.0**-PLACES
    bound = q_length * bucket.length[0]
    open_ = np.flatnonzero(bound * (1 + 1e-9) + 1e-300 >= threshold)
    counts["skipped"] = counts.get("skipped", 0) + len(q) - len(open_)
    if not len(open_):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bound[open_] > 0, threshold[open_] / bound[open_], -1.0)
    by_coordinate = open_[local >= WORTH]
    by_length = open_[local < WORTH]
    if len(by_length):
        # lengths fall within the bucket: a prefix of it is left
        need = np.where(q_length[by_length] > 0, threshold[by_length] / np.where(q_length[by_length] > 0, q_length[by_length], 1), -np.inf)
        upto = int(np.searchsorted(-bucket.length, -(need.min() * (1 - 1e-9) if need.min() > 0 else need.min()), "right"))
        if upto:
            score = products(q[by_length], bucket.vectors[:upto])
            score[q_ids[by_length][:, None] == bucket.ids[None, :upto]] = -np.inf
            best.add(by_length, bucket.ids[:upto], score)
            counts["length"] = counts.get("length", 0) + score.size
    if len(by_coordinate):
        c = (np.minimum(threshold[by_coordinate] / bound[by_coordinate], 1.0) * (1 - 1e-9))[:, None]
        direction = q[by_coordinate] / q_length[by_coordinate, None]
        focus = np.argsort(-np.abs(direction), axis=1, kind="stable")[:, :FOCUS]
        left = np.ones((len(by_coordinate), len(bucket.ids)), bool)
        for f in focus.T:
            x = np.take_along_axis(direction, f[:, None], 1)
            spread = np.sqrt(np.maximum(0.0, (1 - x * x) * (1 - c * c))) + 1e-9
            low, high = np.where(-x >= c, -2.0, x * c - spread), np.where(x >= c, 2.0, x * c + spread)
            value = bucket.direction.T[f]
            left &= (value >= low) & (value <= high)
        left &= q_ids[by_coordinate][:, None] != bucket.ids[None]
        rows, columns = np.nonzero(left)
        counts["coordinate"] = counts.get("coordinate", 0) + len(rows)
        if len(rows):
            score = np.full(left.shape, -np.inf)
            score[rows, columns] = np.round(np.einsum("ij,ij->i", q[by_coordinate[rows]], bucket.vectors[columns]), PLACES)
            some = np.flatnonzero(left.any(axis=0))
            best.add(by_coordinate, bucket.ids[some], score[:, some])


def search(q_ids: np.ndarray, q: np.ndarray, buckets: list[Bucket], k: int, start: np.ndarray | None = None, counts: dict[str, int] | None = None) -> Best:
    """The k best of the buckets, which are in falling order of length, for each query but itself. start: known k-th best products."""
    best, counts = Best(len(q), k), {} if counts is None else counts
    start = np.full(len(q), -np.inf) if start is None else start
    q_length = np.sqrt((q * q).sum(axis=1))
    for bucket in buckets:
        search_bucket(q_ids, q, q_length, bucket, best, start, counts)
    return best


def _read(rows: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """(ids, vectors, k-th best products) of each block of a group, all of one dimension, the longest vectors first."""
    return [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"]), np.frombuffer(r["kth"], np.float64)) for r in sorted(rows.to_pylist(), key=lambda r: (r["part"], r["number"]))]


def _lead(k: int):
    """Queries with the longest buckets: what each found there, and the length that a vector needs to add to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        buckets = [Bucket(*x[:2]) for x in _read(right)]
        rows = []
        for ids, vectors, _ in _read(left):
            best = search(ids, vectors, buckets, k)
            length, kth, shown = np.sqrt((vectors * vectors).sum(axis=1)), best.threshold, best.shown()
            need = np.where((kth > 0) & (length > 0), (kth - 10.0**-PLACES) / np.where(length > 0, length, 1) * (1 - 1e-9), -1.0)
            rows += [{"id": int(i), "dim": vectors.shape[1], "kth": float(t), "need": float(n), "v": v, "near": x[s], "score": y[s]} for i, t, n, v, x, y, s in zip(ids, kth, need, vectors, best.id, best.score, shown)]
        return pa.Table.from_pylist(rows, schema=_arrow(_MET))

    return run


def _pair(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        buckets = [Bucket(*x[:2]) for x in _read(right)]
        for ids, vectors, kth in _read(left):
            best = search(ids, vectors, buckets, k, kth)
            shown = best.shown() & (best.score >= kth[:, None])
            columns.append((np.repeat(ids, shown.sum(axis=1)), best.id[shown], best.score[shown]))
        return pa.table([np.concatenate(c) for c in zip(*columns)], schema=_arrow(_SCORES))

    return run


def top_k(vectors: DataFrame, k: int = K, id_column: str = "vec_id", column: str = "embedding", bucket: int = BUCKET, buckets: int = RANGE, every: int = EVERY) -> DataFrame:
    """For each vector whose id is divisible by ``every``, the ``k`` others of greatest inner product: (query_id, rank, neighbor_id, score).

    Scores are rounded to 6 places; those that are equal to 12 places rank by id. Vectors that are null, empty, or hold
    a null or a number that isn't finite, and rows of a null id take no part. Vectors of each dimension are searched
    among their own kind, so those of a wrong one spoil nothing. Rows that repeat an id are one vector, the least by
    coordinates. Copies under other ids are neighbours. With fewer than k others, all are given; an empty table gives an
    empty result, as does one without a query. Zero vectors take part. Long vectors are taken whole. Other columns,
    whatever their names, have no effect.
    """
    v = F.col(column).cast("array<double>")
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    clean = clean.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).groupBy("id").agg(F.min("v").alias("v"))
    clean = stored(clean.withColumns({"dim": F.size("v"), "length": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))}))
    asked = clean.where(F.col("id") % every == 0)
    count = clean.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    parts, q_parts = (max(1, -(-n // (bucket * buckets))) for n in (count.n, count.q))
    none = (F.lit(float("-inf")).alias("kth"), F.lit(-1.0).alias("need"))

    def packed(rows: DataFrame, n: int, *order) -> DataFrame:
        sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        return sorted_.select("id", "v", "kth", "need").mapInArrow(_pack(bucket), _BLOCKS)

    by_length = ("dim", F.desc("length"), "id")
    numbers = stored(packed(clean.select("*", *none), parts, *by_length))
    place = F.row_number().over(W.partitionBy("dim").orderBy("part", "number"))
    leading = numbers.select("dim", "part", "number").withColumn("place", place).where(F.col("place") <= buckets).drop("place")
    lead = numbers.join(leading, ["dim", "part", "number"], "left_semi")
    rest = numbers.join(leading, ["dim", "part", "number"], "left_anti")
    first = stored(packed(asked.select("*", *none), q_parts, *by_length))
    chunks = first.select("dim", F.col("part").alias("q")).distinct()
    met = stored(first.groupBy("dim", "part").cogroup(lead.join(chunks, "dim").groupBy("dim", "q")).applyInArrow(_lead(k), _MET))
    again = stored(packed(met, q_parts, "dim", "need", "id"))
    blocks = again.groupBy("dim", F.col("part").alias("q")).agg(F.min("need").alias("need"))
    ranges = rest.groupBy("dim", F.col("part").alias("b")).agg(F.max("top").alias("top"))
    pairs = stored(blocks.join(ranges, "dim").where("top >= need").select("dim", "q", "b"))
    left = again.join(pairs.select("dim", F.col("q").alias("part"), F.col("b").alias("other")), ["dim", "part"])
    right = rest.join(pairs.select("dim", F.col("b").alias("part"), F.col("q").alias("asked")), ["dim", "part"])
    later = left.groupBy("dim", "part", "other").cogroup(right.groupBy("dim", "asked", "part")).applyInArrow(_pair(k), _SCORES)
    own = met.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "score")).alias("x")).select("query_id", F.col("x.near").alias("neighbor_id"), F.col("x.score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id"))
    return own.unionByName(later).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.round("score", 6).alias("score"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scores AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_dot_product(a.e, b.e), {PLACES}) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rank FROM scores)
SELECT query_id, rank::INT AS rank, neighbor_id, round(s, 6) AS score FROM ranked WHERE rank <= {K}
"""
