"""Surprisal of tags, dependency relations and attachments under trigram models.

A model is three small tables, of contexts of two, one and no symbols; a sequence is scored by looking them up, the
shorter contexts only for what the longer one hasn't seen. Tables are of symbols from closed sets, so they stay small
whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import PROLOGUE, prologue
from glossweave.blocks import RELS, UPOS, Block, Kernel, rounded
from glossweave.operators.trees import KEY, numbered

BOS, EOS = "<BOS>", "<EOS>"
EXCLUDED = ("PUNCT", "SYM")


@dataclass
class Model:
    """trigram (pos1, pos2, pos3, prob, context_entropy), bigram (pos2, pos3, prob, context_entropy), unigram (pos3, prob)."""

    trigram: DataFrame
    bigram: DataFrame
    unigram: DataFrame


def tag_contexts(tokens: DataFrame, exclude: tuple[str, ...] = (), boundaries: bool = False) -> DataFrame:
    """Tokens that have a tag, with pos1, pos2, pos3: the two tags before, in the sentence, and their own.

    With ``boundaries`` the sentence begins with two marks; else its first two tokens have no context and are left out.
    """
    t = tokens.where("upos is not null")
    t = t.where(~F.col("upos").isin(*exclude)) if exclude else t
    by = W.partitionBy("doc_id", "sentence_id").orderBy("term_id")
    start = F.lit(BOS if boundaries else None).cast("string")
    t = t.withColumns({"pos1": F.lag("upos", 2).over(by), "pos2": F.lag("upos", 1).over(by), "pos3": F.col("upos")})
    return t.withColumns({c: F.coalesce(c, start) for c in ("pos1", "pos2")}).where("pos1 is not null and pos2 is not null")


def pos_ngrams(tokens: DataFrame, exclude: tuple[str, ...] = (), boundaries: bool = True) -> DataFrame:
    """(pos1, pos2, pos3, n): the tag trigrams of a corpus; with ``boundaries`` also those that end a sentence."""
    rows = tag_contexts(tokens, exclude, boundaries).select("doc_id", "sentence_id", "term_id", "pos1", "pos2", "pos3")
    if boundaries:
        last = F.max_by(F.struct("pos2", "pos3"), "term_id").alias("x")
        ends = rows.groupBy("doc_id", "sentence_id").agg(last).select(F.col("x.pos2").alias("pos1"), F.col("x.pos3").alias("pos2"), F.lit(EOS).alias("pos3"))
        rows = rows.select("pos1", "pos2", "pos3").unionByName(ends)
    return rows.groupBy("pos1", "pos2", "pos3").agg(F.count(F.lit(1)).alias("n"))


def ngram_model(ngrams: DataFrame) -> Model:
    """Maximum likelihood of each symbol in contexts of two, one and none, with the contexts' entropies in bits."""

    def level(context: list[str]) -> DataFrame:
        counts = ngrams.groupBy(*context, "pos3").agg(F.sum("n").alias("n"))
        by = W.partitionBy(*context)
        with_p = counts.withColumn("prob", F.col("n") / F.sum("n").over(by))
        if not context:
            return with_p.select("pos3", "prob")
        return with_p.withColumn("context_entropy", -F.sum(F.col("prob") * F.log2("prob")).over(by) + 0.0).drop("n")

    return Model(level(["pos1", "pos2"]), level(["pos2"]), level([]))


def score(rows: DataFrame, model: Model, name: str, order: Column, backoff: float | None = None) -> DataFrame:
    """Adds <name>_surprisal (bits), <name>_entropy and <name>_entropy_reduction to rows with doc_id, sentence_id, pos1, pos2, pos3.

    Without ``backoff`` an unseen trigram has none of them. With it, its bigram counts, scaled by ``backoff``, or its
    unigram, scaled twice, which has no entropy. A reduction is from the token before in the sentence.
    """
    out = rows.join(F.broadcast(model.trigram), ["pos1", "pos2", "pos3"], "left")
    if backoff is not None:
        two = model.bigram.select("pos2", "pos3", F.col("prob").alias("prob2"), F.col("context_entropy").alias("entropy2"))
        out = out.join(F.broadcast(two), ["pos2", "pos3"], "left").join(F.broadcast(model.unigram.select("pos3", F.col("prob").alias("prob1"))), "pos3", "left")
        out = out.withColumns({"context_entropy": F.when(F.col("prob").isNotNull(), F.col("context_entropy")).otherwise(F.col("entropy2")), "prob": F.coalesce("prob", backoff * F.col("prob2"), backoff * backoff * F.col("prob1"))})
    before = F.lag("context_entropy").over(W.partitionBy("doc_id", "sentence_id").orderBy(order))
    out = out.withColumns({f"{name}_surprisal": -F.log2("prob") + 0.0, f"{name}_entropy_reduction": before - F.col("context_entropy")})
    return out.withColumnRenamed("context_entropy", f"{name}_entropy").drop("prob", "prob1", "prob2", "entropy2")


def summary(scored: DataFrame, name: str, *keys: str) -> DataFrame:
    """Means and deviations of the three scores by document or sentence."""
    columns = [f"{name}_surprisal", f"{name}_entropy", f"{name}_entropy_reduction"]
    return scored.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def pos_surprisal(tokens: DataFrame, model: Model, exclude: tuple[str, ...] = (), boundaries: bool = False, backoff: float | None = None) -> DataFrame:
    """Tokens with pos_surprisal, pos_entropy, pos_entropy_reduction. A sentence's context is its own, never another document's."""
    return score(tag_contexts(tokens, exclude, boundaries), model, "pos", F.col("term_id"), backoff)


def arcs(tokens: DataFrame, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(KEY, term_id, token_id, head_pos, dep_rel, dep_pos) of the arcs between tokens none of which is excluded."""
    t = numbered(tokens).where(F.col("upos").isNotNull() & ~F.col("upos").isin(*exclude)).select(*KEY, "term_id", "token_id", "id", "head", "dep_rel", "upos")
    asks = F.struct(F.col("head").alias("node"), F.struct("term_id", "token_id", "dep_rel", "upos").alias("own"), F.lit(None).cast("string").alias("told"))
    tells = F.struct(F.col("id").alias("node"), F.lit(None).cast("struct<term_id:int,token_id:string,dep_rel:string,upos:string>").alias("own"), F.col("upos").alias("told"))
    each = t.select(*KEY, F.inline(F.array(asks, tells))).where("node > 0")
    head = F.max("told").over(W.partitionBy(*KEY, "node"))
    return each.withColumn("head_pos", head).where("own is not null and head_pos is not null").select(*KEY, "own.term_id", "own.token_id", "head_pos", "own.dep_rel", F.col("own.upos").alias("dep_pos"))


def _roles(rows: DataFrame, last: str) -> DataFrame:
    roles = ("head_pos", "dep_rel", "dep_pos") if last == "dep_pos" else ("head_pos", "dep_pos", "dep_rel")
    return rows.withColumns({f"pos{i + 1}": F.col(c) for i, c in enumerate(roles)})


def arc_model(tokens: DataFrame, last: str, exclude: tuple[str, ...] = EXCLUDED) -> Model:
    """Of dep_pos in the context (head_pos, dep_rel), or of dep_rel in (head_pos, dep_pos)."""
    return ngram_model(_roles(arcs(tokens, exclude), last).groupBy("pos1", "pos2", "pos3").agg(F.count(F.lit(1)).alias("n")))


def deprel_surprisal(tokens: DataFrame, model: Model, exclude: tuple[str, ...] = EXCLUDED, backoff: float | None = 0.4) -> DataFrame:
    """Arcs with the surprisal of the dependent's tag, given its head's tag and their relation."""
    return score(_roles(arcs(tokens, exclude), "dep_pos"), model, "deprel", F.col("term_id"), backoff)


def attach_surprisal(tokens: DataFrame, model: Model, exclude: tuple[str, ...] = EXCLUDED, backoff: float | None = 0.4) -> DataFrame:
    """Arcs with the surprisal of the relation, given the tags of the head and of the dependent."""
    return score(_roles(arcs(tokens, exclude), "dep_rel"), model, "attach", F.col("term_id"), backoff)


def lookup(ngrams: DataFrame, *names: tuple[str, ...], backoff: float | None = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Surprisal and entropy of every (pos1, pos2, pos3) under ``ngram_model``, as ``score`` has them; NaN for none. Symbols are of closed sets, so tables are small."""
    rows = ngrams.groupBy("pos1", "pos2", "pos3").agg(F.sum("n").alias("n")).collect()
    at = [{x: i for i, x in enumerate(dict.fromkeys([*ns, *(r[j] for r in rows)]))} for j, ns in enumerate(names)]
    n = np.zeros([len(x) for x in at])
    for r in rows:
        n[at[0][r[0]], at[1][r[1]], at[2][r[2]]] = r[3]

    def level(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.where(counts > 0, counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1), np.nan)
        return p, np.where(counts > 0, -np.nansum(np.where(counts > 0, p * np.log2(p), 0), axis=-1, keepdims=True) + 0.0, np.nan)

    p, h = level(n)
    if backoff is not None:
        (p2, h2), (p1, _) = level(n.sum(axis=0)), level(n.sum(axis=(0, 1)))
        p, h = np.where(~np.isnan(p), p, np.where(~np.isnan(p2), backoff * p2, backoff * backoff * p1)), np.where(~np.isnan(p), h, h2)
    cut = tuple(slice(len(ns)) for ns in names)
    return (-np.log2(p) + 0.0)[cut], h[cut]


def _rows_scored(b: Block, kind: str, exclude: tuple[str, ...]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens that are scored, and their three symbols: of tags with two before them (pos), or of arcs (deprel, attach)."""
    if kind == "pos":
        at = np.flatnonzero(b.term > 2)
        return at, (b.upos[at - 2], b.upos[at - 1], b.upos[at])
    some = ~b.tagged(*exclude)
    at = np.flatnonzero(some & (b.head > 0) & some[b.up])
    head, dependent, rel = b.upos[b.up[at]], b.upos[at], b.rel[at]
    return at, (head, rel, dependent) if kind == "deprel" else (head, dependent, rel)


def scored_of(kind: str, tables: tuple[np.ndarray, np.ndarray], per: str = "token", exclude: tuple[str, ...] = EXCLUDED) -> Kernel:
    """``pos_surprisal``, ``deprel_surprisal`` or ``attach_surprisal`` of annotated documents, by token, or its ``summary`` by sentence or document."""
    names = [f"{kind}_surprisal", f"{kind}_entropy", f"{kind}_entropy_reduction"]

    def run(b: Block) -> dict:
        at, symbols = _rows_scored(b, kind, exclude)
        surprise, entropy = (t[symbols] for t in tables)
        s = b.s[at]
        less = np.full(len(at), np.nan)
        less[1:] = np.where(s[1:] == s[:-1], entropy[:-1] - entropy[1:], np.nan)
        scores = dict(zip(names, (surprise, entropy, less)))
        if per == "token":
            return b.place(at) | {n: rounded(x) for n, x in scores.items()}
        group = s if per == "sentence" else b.d[s]
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(at) else np.zeros(0, np.int64)
        first = s[begin]
        out = {"doc_id": b.doc.take(pa.array(first))} | ({"sentence_id": b.sentence_id[first]} if per == "sentence" else {})
        of = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(at)]))))
        total = lambda x: np.bincount(of, x, minlength=len(begin))
        for n, x in scores.items():
            there = ~np.isnan(x)
            count = total(there)
            mean = np.divide(total(np.where(there, x, 0)), count, out=np.full(len(begin), np.nan), where=count > 0)
            squares = total(np.where(there, (x - mean[of]) ** 2, 0))
            out |= {f"mean_{n}": rounded(mean), f"sd_{n}": rounded(np.sqrt(np.divide(squares, count - 1, out=np.full(len(begin), np.nan), where=count > 1)))}
        return out

    return run


def surprisal_kernel(norms: DataFrame, kind: str, per: str = "token") -> Kernel:
    """By the model of another corpus' tokens."""
    if kind == "pos":
        return scored_of(kind, lookup(pos_ngrams(norms), UPOS, UPOS, UPOS), per)
    last = "dep_pos" if kind == "deprel" else "dep_rel"
    ngrams = _roles(arcs(norms), last).groupBy("pos1", "pos2", "pos3").agg(F.count(F.lit(1)).alias("n"))
    return scored_of(kind, lookup(ngrams, UPOS, *((RELS, UPOS) if kind == "deprel" else (UPOS, RELS))), per)


_CONTEXTS = """(SELECT *, coalesce(lag(upos, 2) OVER s, {b}) AS pos1, coalesce(lag(upos, 1) OVER s, {b}) AS pos2, upos AS pos3 FROM {t} WHERE upos IS NOT NULL WINDOW s AS (PARTITION BY doc_id, sentence_id ORDER BY term_id))"""
_NGRAMS = f""", seen AS (SELECT pos1, pos2, pos3 FROM {_CONTEXTS.format(b="'<BOS>'", t='n_tokens')}
  UNION ALL SELECT pos2, pos3, '<EOS>' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY term_id DESC) AS k FROM {_CONTEXTS.format(b="'<BOS>'", t='n_tokens')}) WHERE k = 1),
ngrams AS (SELECT pos1, pos2, pos3, count(*) AS n FROM seen GROUP BY ALL)"""
_MODEL = """, tri AS MATERIALIZED (SELECT pos1, pos2, pos3, n / sum(n) OVER (PARTITION BY pos1, pos2) AS prob FROM ngrams),
trigram AS MATERIALIZED (SELECT *, -sum(prob * log2(prob)) OVER (PARTITION BY pos1, pos2) + 0.0::DOUBLE AS h FROM tri),
bi AS MATERIALIZED (SELECT pos2, pos3, n / sum(n) OVER (PARTITION BY pos2) AS prob FROM (SELECT pos2, pos3, sum(n) AS n FROM ngrams GROUP BY ALL)),
bigram AS MATERIALIZED (SELECT *, -sum(prob * log2(prob)) OVER (PARTITION BY pos2) + 0.0::DOUBLE AS h FROM bi),
unigram AS MATERIALIZED (SELECT pos3, sum(n) / (SELECT sum(n) FROM ngrams) AS prob FROM ngrams GROUP BY pos3)"""
_NORMS = "," + prologue("benchmark", "item_id", "n_")


def _scored(rows: str, name: str) -> str:
    return f""", looked AS (SELECT r.*, coalesce(t.prob, 0.4::DOUBLE * b.prob, 0.4::DOUBLE * 0.4::DOUBLE * u.prob) AS p, CASE WHEN t.prob IS NOT NULL THEN t.h ELSE b.h END AS {name}_entropy
  FROM {rows} r LEFT JOIN trigram t USING (pos1, pos2, pos3) LEFT JOIN bigram b ON b.pos2 = r.pos2 AND b.pos3 = r.pos3 LEFT JOIN unigram u ON u.pos3 = r.pos3),
scored AS (SELECT *, -log2(p) + 0.0::DOUBLE AS {name}_surprisal, lag({name}_entropy) OVER (PARTITION BY doc_id, sentence_id ORDER BY term_id) - {name}_entropy AS {name}_entropy_reduction FROM looked)"""


def _of(name: str, keys: str) -> str:
    columns = [f"{name}_surprisal", f"{name}_entropy", f"{name}_entropy_reduction"]
    return f" SELECT {keys}, " + ", ".join(f"round({f}({c}), 9) + 0.0::DOUBLE AS {n}_{c}" for c in columns for n, f in (("mean", "avg"), ("sd", "stddev_samp"))) + f" FROM scored GROUP BY {keys}"


def _arcs_sql(t: str, name: str, last: str) -> str:
    roles = "h.upos AS pos1, d.dep_rel AS pos2, d.upos AS pos3" if last == "dep_pos" else "h.upos AS pos1, d.upos AS pos2, d.dep_rel AS pos3"
    return f", {name} AS MATERIALIZED (SELECT d.doc_id, d.sentence_id, d.term_id, {roles} FROM {t} d JOIN {t} h ON h.doc_id = d.doc_id AND h.sentence_id = d.sentence_id AND h.term_id = d.head WHERE d.upos NOT IN ('PUNCT', 'SYM') AND h.upos NOT IN ('PUNCT', 'SYM'))"


_COUNT = ", ngrams AS (SELECT pos1, pos2, pos3, count(*) AS n FROM seen GROUP BY ALL)"
_TAGS = PROLOGUE + _NORMS + _NGRAMS + _MODEL + f", rows AS {_CONTEXTS.format(b='NULL', t='tokens')}, kept AS (SELECT * FROM rows WHERE pos1 IS NOT NULL)" + _scored("kept", "pos")
_THREE = lambda name: ", ".join(f"round({c}, 9) + 0.0::DOUBLE AS {c}" for c in (f"{name}_surprisal", f"{name}_entropy", f"{name}_entropy_reduction"))
_DEPREL = PROLOGUE + _NORMS + _arcs_sql("n_tokens", "seen", "dep_pos") + _COUNT + _MODEL + _arcs_sql("tokens", "kept", "dep_pos") + _scored("kept", "deprel")
_ATTACH = PROLOGUE + _NORMS + _arcs_sql("n_tokens", "seen", "dep_rel") + _COUNT + _MODEL + _arcs_sql("tokens", "kept", "dep_rel") + _scored("kept", "attach")
SQL = {
    "pos_ngrams": "WITH" + prologue("benchmark", "item_id", "n_") + _NGRAMS + " SELECT * FROM ngrams",
    "pos_model": "WITH" + prologue("benchmark", "item_id", "n_") + _NGRAMS + _MODEL + " SELECT pos1, pos2, pos3, round(prob, 9) AS prob, round(h, 9) + 0.0::DOUBLE AS context_entropy FROM trigram",
    "pos_surprisal_token": _TAGS + f" SELECT doc_id, sentence_id, term_id, {_THREE('pos')} FROM scored",
    "pos_surprisal_sent": _TAGS + _of("pos", "doc_id, sentence_id"),
    "pos_surprisal_doc": _TAGS + _of("pos", "doc_id"),
    "deprel_surprisal_token": _DEPREL + f" SELECT doc_id, sentence_id, term_id, {_THREE('deprel')} FROM scored",
    "deprel_surprisal": _DEPREL + _of("deprel", "doc_id"),
    "attach_surprisal": _ATTACH + _of("attach", "doc_id"),
}
