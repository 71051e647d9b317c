"""Sentence vectors: means of documents, how coherent a document's sentences are, and nearest neighbours within it.

A document's vectors are gathered to one array, as its measures compare sentences in order and with one another; these
are computed in numpy, row by row of Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import spread_out
from glossweave.blocks import whole
from glossweave.sources.corpus import sentence_table

MEASURES = (
    "thematic_dispersion", "centroid_distance_sd", "sequential_similarity", "mean_semantic_gap", "max_semantic_gap", "topic_drift", "mean_novelty", "n_topics", "convexity", "blob_convexity", "segment_support", "segment_occupancy",
    "local_convexity", "local_blob_convexity", "local_segment_support", "local_segment_occupancy",
)
#: Sentence pairs of a document that its convexity is measured on, at most, evenly spaced; consecutive sentences of a block; neighbours of a radius.
PAIRS, DRIFT, NEIGHBOURS = 500, 3, 10
#: Sentences that are compared with all others at once.
ROWS = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def encode(sentences: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(doc_id, sentence_id, embedding) of the first row of each sentence (doc_id, sentence_id, sentence), ``embed`` running on the executors."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        made = [v for i in range(0, len(rows), batch) for v in np.asarray(embed(rows[i : i + batch]), float).tolist()]
        return pa.array(made, pa.list_(pa.float64()))

    first = sentences.where("sentence is not null").groupBy("doc_id", "sentence_id").agg(F.min("sentence").alias("sentence"))
    return first.select("doc_id", "sentence_id", run("sentence").alias("embedding"))


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: words hashed to signed places of a vector."""

    known: dict[str, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        at, sizes = [], []
        for t in texts:
            words = t.lower().split()
            for w in words:
                h = known.get(w)
                if h is None:
                    if len(known) >= 1 << 17:
                        known.clear()
                    h = known[w] = zlib.crc32(w.encode())
                at.append(h)
            sizes.append(len(words))
        h = np.array(at, np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        return np.bincount(row * dim + h % dim, np.where(h >> 16 & 1, 1.0, -1.0), minlength=len(texts) * dim).reshape(len(texts), dim)

    return embed


def document_centroids(vectors: DataFrame, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """(doc_id, embedding): the mean vector of each document, place by place."""
    each = vectors.where(F.col(column).isNotNull()).select(key, F.posexplode(column).alias("at", "x"))
    means = each.groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p")).select(key, F.col("p.x").alias(column))


def sequential_similarity(vectors: DataFrame, key: str = "doc_id", order: str = "sentence_id", column: str = "embedding") -> DataFrame:
    """(doc_id, emb_sequential_similarity, emb_mean_semantic_gap, emb_max_semantic_gap) of vectors in their order; null for documents of one."""
    v = F.transform(column, lambda x: x.cast("double"))
    x = vectors.where(F.col(column).isNotNull()).select(key, order, v.alias("v")).withColumn("u", F.lag("v").over(W.partitionBy(key).orderBy(order)))
    s = F.when(F.col("u").isNotNull(), F.coalesce(F.try_divide(dot(F.col("u"), F.col("v")), norm(F.col("u")) * norm(F.col("v"))), F.lit(0.0)))
    return x.withColumn("s", s).groupBy(key).agg(F.avg("s").alias("emb_sequential_similarity"), (1 - F.avg("s")).alias("emb_mean_semantic_gap"), (1 - F.min("s")).alias("emb_max_semantic_gap"))


def sample_pairs(n: int, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of n sentences, all or ``most`` of them, evenly spaced in the order of j, then i."""
    total = n * (n - 1) // 2
    at = np.arange(total) if total <= most else np.unique(np.floor(np.linspace(0, total - 1, most)).astype(np.int64))
    # column j holds the j pairs (0, j) to (j - 1, j), after the j (j - 1) / 2 of the columns before
    j = np.floor((1 + np.sqrt(1 + 8 * at.astype(float))) / 2).astype(np.int64)
    j -= j * (j - 1) // 2 > at
    j += (j + 1) * j // 2 <= at
    return at - j * (j - 1) // 2, j


def _nearest(x: np.ndarray, points: np.ndarray, leave: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Greatest product and least distance of each point to the rows of x but two."""
    best, least = np.empty(len(points)), np.empty(len(points))
    own = (x * x).sum(axis=1)
    for a in range(0, len(points), ROWS):
        p = points[a : a + ROWS]
        dots = p @ x.T
        far = np.maximum((p * p).sum(axis=1)[:, None] + own - 2 * dots, 0)
        rows = np.arange(len(p))
        for side in leave:
            dots[rows, side[a : a + ROWS]] = -np.inf
            far[rows, side[a : a + ROWS]] = np.inf
        best[a : a + ROWS], least[a : a + ROWS] = dots.max(axis=1), np.sqrt(far.min(axis=1))
    return best, least


def _radii(x: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Distance of each row to its k-th neighbour, and the median cosine distance to the first."""
    k = min(k, len(x) - 1)
    radius, first = np.empty(len(x)), np.empty(len(x))
    for a in range(0, len(x), ROWS):
        dots = x[a : a + ROWS] @ x.T
        own = (x * x).sum(axis=1)
        far = np.sqrt(np.maximum(own[a : a + ROWS, None] + own - 2 * dots, 0))
        rows = np.arange(len(dots))
        dots[rows, a + rows], far[rows, a + rows] = -np.inf, np.inf
        radius[a : a + ROWS] = np.partition(far, k - 1, axis=1)[:, k - 1]
        first[a : a + ROWS] = 1 - dots.max(axis=1)
    return radius, float(np.median(first))


def _support(x: np.ndarray, i: np.ndarray, j: np.ndarray, radii: np.ndarray, blob: float) -> list[float]:
    middle = (x[i] + x[j]) / 2
    length = np.sqrt((middle * middle).sum(axis=1))
    best, least = _nearest(x, middle, (i, j))
    cosine = best / np.where(length > 0, length, 1)
    scale = np.maximum(np.sqrt(radii[i] * radii[j]), 1e-12)
    return [float(cosine.mean()), float((1 - cosine < blob).mean()), float(np.exp(-0.5 * (least / scale) ** 2).mean()), float((least <= scale).mean())]


def _topics(x: np.ndarray, most: int) -> int:
    """The number of clusters, up to ``most``, of the best mean silhouette above 0; clusters by Lloyd's steps from far points."""
    parts = []
    for k in range(2, most + 1):
        centres = x[[0]]
        while len(centres) < k:
            far = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.concatenate([centres, x[[far.argmax()]]])
        last = None
        for _ in range(20):
            of = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            if last is not None and (of == last).all():
                break  # the centres would stay where they are
            last = of
            centres = np.stack([x[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(k)])
        parts.append(of)
    # distances are worked out once for all numbers of clusters
    marks = [np.eye(k + 2)[of] for k, of in enumerate(parts)]
    sums = [np.zeros((len(x), k + 2)) for k in range(len(parts))]
    own_square = (x * x).sum(axis=1)
    for a in range(0, len(x), ROWS):
        far = np.sqrt(np.maximum(own_square[a : a + ROWS, None] + own_square - 2 * x[a : a + ROWS] @ x.T, 0))
        for s, mark in zip(sums, marks):
            s[a : a + ROWS] = far @ mark
    best, found = 0.0, 1
    for k, (of, total) in enumerate(zip(parts, sums), 2):
        sizes = np.bincount(of, minlength=k)
        own = total[np.arange(len(x)), of] / np.maximum(sizes[of] - 1, 1)
        other = np.where(np.arange(k) == of[:, None], np.inf, total / np.maximum(sizes, 1))
        other[:, sizes == 0] = np.inf
        out = other.min(axis=1)
        width = np.where((sizes[of] > 1) & np.isfinite(out), (out - own) / np.maximum(np.maximum(out, own), 1e-300), 0).mean()
        if width > best:
            best, found = float(width), k
    return found


def coherence(vectors: np.ndarray) -> dict[str, float | None]:
    """The measures of one document's vectors in order; all null for less than two, those of convexity for less than three."""
    out: dict[str, float | None] = dict.fromkeys(MEASURES)
    n = len(vectors)
    if n < 2:
        return out
    length = np.sqrt((vectors * vectors).sum(axis=1))
    x = vectors / np.where(length > 0, length, 1)[:, None]
    unit = lambda v: v / max(1e-300, float(np.sqrt((v * v).sum())))
    away = 1 - x @ unit(x.mean(axis=0))
    steps = (x[:-1] * x[1:]).sum(axis=1)
    running = np.cumsum(x, axis=0)[:-1]
    size = np.sqrt((running * running).sum(axis=1))
    new = np.where(size > 0, 1 - (x[1:] * running).sum(axis=1) / np.where(size > 0, size, 1), np.nan)
    out |= {"thematic_dispersion": float(away.mean()), "centroid_distance_sd": float(away.std(ddof=1)), "sequential_similarity": float(steps.mean()), "mean_semantic_gap": float(1 - steps.mean()), "max_semantic_gap": float((1 - steps).max())}
    out |= {"mean_novelty": float(np.nanmean(new)) if np.isfinite(new).any() else None, "n_topics": 1}
    if n >= 2 * DRIFT:
        blocks = x[: n // DRIFT * DRIFT].reshape(-1, DRIFT, x.shape[1]).mean(axis=1)
        size = np.sqrt((blocks * blocks).sum(axis=1))
        blocks = blocks / np.where(size > 0, size, 1)[:, None]
        out["topic_drift"] = float((1 - (blocks[:-1] * blocks[1:]).sum(axis=1)).mean())
    if min(5, n // 3) >= 2:
        out["n_topics"] = _topics(x, min(5, n // 3))
    if n >= 3:
        radii, blob = _radii(x, NEIGHBOURS)
        names = ("convexity", "blob_convexity", "segment_support", "segment_occupancy")
        i, j = sample_pairs(n)
        out |= dict(zip(names, _support(x, i, j, radii, blob)))
        out |= {f"local_{m}": v for m, v in zip(names, _support(x, np.arange(n - 1), np.arange(1, n), radii, blob))}
    return out


_KINDS = {m: "int" if m == "n_topics" else "double" for m in MEASURES}


def _measured(documents: list[np.ndarray | None]) -> pa.Array:
    found = [coherence(d) if d is not None else dict.fromkeys(MEASURES) for d in documents]
    clean = [{m: None if v is None or not math.isfinite(v) else v for m, v in f.items()} for f in found]
    return pa.array(clean, pa.struct([(m, pa.int32() if k == "int" else pa.float64()) for m, k in _KINDS.items()]))


def embedding_coherence(vectors: DataFrame, key: str = "doc_id", order: str = "sentence_id", column: str = "embedding") -> DataFrame:
    """(doc_id, emb_<measure>) of each document's sentence vectors in their order; rows with a null in them don't count."""
    @F.arrow_udf("struct<" + ",".join(f"{m}:{k}" for m, k in _KINDS.items()) + ">")
    def run(documents: pa.Array) -> pa.Array:
        return _measured([np.array(d, float) if d else None for d in documents.to_pylist()])

    whole = F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull())
    rows = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.when(whole, F.struct(order, F.transform(column, lambda x: x.cast("double")).alias("v"))))).alias("r"))
    return rows.select(key, run("r.v").alias("m")).select(key, *[F.col(f"m.{m}").alias(f"emb_{m}") for m in MEASURES])


def text_coherence(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """``embedding_coherence`` of the encoded sentences of (doc_id, text): encoded and measured where documents are read, so that no vector is shuffled."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, begin in whole(batches):
            texts, at = b.column(1).to_pylist(), [*np.flatnonzero(begin).tolist(), b.num_rows]
            vectors = np.concatenate([np.asarray(embed(texts[i : i + batch]), float) for i in range(0, len(texts), batch)])
            measured = _measured([vectors[i:j] for i, j in zip(at[:-1], at[1:])])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[:-1])), *measured.flatten()], names=["doc_id", *(f"emb_{m}" for m in MEASURES)])

    sentences = sentence_table(spread_out(docs)).where("sentence is not null").select("doc_id", "sentence", "sentence_id")
    return sentences.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"emb_{m} {k}" for m, k in _KINDS.items()))


_V = "WITH v AS (SELECT label AS doc_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
SQL = {
    "document_centroids": _V + ", x AS (SELECT doc_id, unnest(range(len(e)))::INT AS place, unnest(e) AS x FROM v) SELECT doc_id, place, round(avg(x), 9) + 0.0::DOUBLE AS x FROM x GROUP BY ALL",
    "sequential_similarity": _V + """, s AS (SELECT doc_id, e, lag(e) OVER (PARTITION BY doc_id ORDER BY vec_id) AS u FROM v), c AS (SELECT doc_id, CASE WHEN u IS NOT NULL THEN list_cosine_similarity(e, u) END AS s FROM s)
SELECT doc_id, round(avg(s), 9) + 0.0::DOUBLE AS emb_sequential_similarity, round(1 - avg(s), 9) + 0.0::DOUBLE AS emb_mean_semantic_gap, round(1 - min(s), 9) + 0.0::DOUBLE AS emb_max_semantic_gap FROM c GROUP BY doc_id""",
}
