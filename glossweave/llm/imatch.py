"""Operator 10: document fingerprints by I-Match with randomised lexicons.

Of a document's terms those count whose inverse document frequency lies in a band: very common ones say nothing, very
rare ones are where copies differ. The distinct terms that are left, sorted, are hashed to one signature (Chowdhury et
al. 2002). As a single term more or less changes it, each of several random subsets of the lexicon gives a signature
of its own (Kolcz et al. 2004); copies agree in at least one of them with a probability that grows with their number.

Document frequencies are counted over the whole corpus. The lexicon has at most (distinct terms of a document on
average) / (lowest share of documents) entries, however large the corpus. Up to ``max_lexicon`` entries it is sent to
every task, and signatures are made where the documents are read; a larger one is joined, with the same result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPLIT, distinct, lean, pieces, stored, table, text_buffers, words

#: Shares of the documents between which a term's frequency lies: inverse document frequencies of 2.3 and 6.9 nats.
LOW, HIGH = 0.001, 0.1
#: Random subsets of the lexicon, besides the whole; of 16 hash values of a term this many leave it out of a subset.
SUBSETS, LEFT_OUT = 4, 5
#: Terms that are sent to every task, at most (some 30 bytes each); beyond it the lexicon is joined.
MAX_LEXICON = 400_000


def document_terms(docs: DataFrame) -> DataFrame:
    """(term) once for each document that has it."""
    return docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), SPLIT))).alias("term")).where("term <> ''")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS) -> DataFrame:
    """(term, mask): the terms within the band; bit k of mask is set where subset k has the term, bit 0 always is."""
    total = docs.select(F.count(F.lit(1)).alias("n")).first().n
    counted = document_terms(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    inside = counted.where((F.col("n") >= F.lit(low * total)) & (F.col("n") <= F.lit(high * total)) & (F.col("n") > 1))
    digits = F.md5(F.col("term").cast("binary"))
    mask = F.lit(1)
    for k in range(1, subsets + 1):
        mask = mask + F.when(F.conv(F.substring(digits, k, 1), 16, 10).cast("int") >= LEFT_OUT, 1 << k).otherwise(0)
    return inside.select("term", mask.cast("int").alias("mask"))


def _signatures(packed: bytes, subsets: int):
    terms, masks = pickle.loads(packed)
    raw = np.frombuffer("\n".join(terms).encode(), np.uint8)
    hashes = words(raw, np.array([0, len(raw)]), "ink")[0]
    order = np.argsort(hashes)
    state = {"hashes": hashes[order], "term": order.astype(np.int64)}
    seen = np.zeros(1 << 22, bool)
    seen[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def one(texts: pa.Array) -> list[list[str | None]]:
        found, _, _, row = words(*text_buffers(pc.utf8_lower(texts)), "alnum")
        keys = np.zeros(0, np.int64)
        if len(terms):
            maybe = np.flatnonzero(seen[(found & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(state["hashes"], found[maybe]), len(terms) - 1)
            hit = state["hashes"][at] == found[maybe]
            # the lexicon is sorted, so that this brings each document's terms in order
            keys = distinct(row[maybe[hit]] * len(terms) + state["term"][at[hit]])
        border = np.searchsorted(keys, np.arange(len(texts) + 1) * max(1, len(terms)))
        out = []
        for a, b in zip(border[:-1], border[1:]):
            own = (keys[a:b] % len(terms)).tolist() if b > a else []
            held = [(terms[i], masks[i]) for i in own]
            signatures = []
            for k in range(subsets + 1):
                kept = [t for t, m in held if m >> k & 1]
                signatures.append(hashlib.md5(" ".join(kept).encode()).hexdigest() if kept else None)
            out.append((len(own), signatures))
        return out

    return one


def document_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS, max_lexicon: int = MAX_LEXICON) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, any others) as (doc_id, n_terms, signature_0, ..., signature_<subsets>).

    Terms are runs of letters and digits, in lower case. A term is in the lexicon when from ``low`` to ``high`` of all
    rows, and at least two, have it. n_terms is how many different ones a document has; signature_0 is of all of them,
    the others of those in each random subset; without a term there it is null, as for null and empty texts. Repeated
    rows count as documents and get equal signatures. An empty table gives an empty result. Other columns, whatever their
    names, have no effect.
    """
    chosen = stored(lexicon(docs, low, high, subsets))
    names = [f"signature_{k}" for k in range(subsets + 1)]
    if chosen.count() > max_lexicon:
        return _joined(docs, chosen, names)
    held = sorted((r.term, r.mask) for r in chosen.collect())
    packed = pickle.dumps(([t for t, _ in held], [m for _, m in held]))
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _signatures(sent.value, subsets)
        for whole in batches:
            for batch in pieces(whole, 1):
                made = make(batch.column(1))
                columns = [pa.array([s[k] for _, s in made], pa.string()) for k in range(subsets + 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int32()), *columns], names=["doc_id", "n_terms", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run), "doc_id long, n_terms int, " + ", ".join(f"{n} string" for n in names))


def _joined(docs: DataFrame, chosen: DataFrame, names: list[str]) -> DataFrame:
    """For a lexicon that is too large to send: documents of the same text share their signatures."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("gw_th"), "text")
    texts = keyed.where("text is not null").select("gw_th", F.explode(F.array_distinct(F.split(F.lower("text"), SPLIT))).alias("term"))
    held = texts.join(chosen, "term").groupBy("gw_th", "term").agg(F.first("mask").alias("mask"))
    per_text = held.groupBy("gw_th").agg(F.array_sort(F.collect_list(F.struct("term", "mask"))).alias("gw_terms"))
    out = keyed.drop("text").join(per_text, "gw_th", "left")

    def signature(k: int):
        kept = F.transform(F.filter("gw_terms", lambda x: x.mask.bitwiseAND(1 << k) != 0), lambda x: x.term)
        return F.when(F.size(kept) > 0, F.md5(F.array_join(kept, " ").cast("binary")))

    return out.select("doc_id", F.coalesce(F.when(F.col("gw_terms").isNotNull(), F.size("gw_terms")), F.lit(0)).alias("n_terms"), *[signature(k).alias(n) for k, n in enumerate(names)])


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


_MASKS = ", ".join(f"CAST('0x' || substr(md5(term), {k}, 1) AS INT) >= {LEFT_OUT} AS in_{k}" for k in range(1, SUBSETS + 1))
_SIGNED = ", ".join(f"md5(string_agg(term, ' ' ORDER BY term) FILTER (in_{k})) AS signature_{k}" for k in range(1, SUBSETS + 1))
OP10_SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
terms AS (SELECT r, unnest(list_distinct(regexp_split_to_array(lower(text), '{SPLIT}'))) AS term FROM rows WHERE text IS NOT NULL),
counted AS (SELECT term, count(*) AS n FROM terms WHERE term <> '' GROUP BY term),
lexicon AS (
  SELECT term, {_MASKS} FROM counted
  WHERE n >= {LOW}::DOUBLE * (SELECT count(*) FROM documents) AND n <= {HIGH}::DOUBLE * (SELECT count(*) FROM documents) AND n > 1),
signed AS (
  SELECT r, count(*)::INT AS n, md5(string_agg(term, ' ' ORDER BY term)) AS signature_0, {_SIGNED}
  FROM terms JOIN lexicon USING (term) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::INT AS n_terms, signature_0, {', '.join(f'signature_{k}' for k in range(1, SUBSETS + 1))}
FROM rows LEFT JOIN signed USING (r)
"""
