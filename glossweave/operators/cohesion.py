"""Lexical cohesion: what sentences share with the ones before them and with their document.

Tokens are counted once to cells (document, sentence, value); windows and set operations work on these. The sentences
before one are a range of a window's frame, not a table joined with itself.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import PROLOGUE
from glossweave.blocks import Block, Kernel, ratio, rounded

CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
ARGUMENTS = ("NOUN", "PRON")


def _cells(tokens: DataFrame, value: str) -> DataFrame:
    return tokens.groupBy("doc_id", "sentence_id", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _previous(cells: DataFrame, n_prev: int) -> Column:
    """The share of the ``n_prev`` sentences before a cell's that have its value; by the ids' arithmetic, 0 in the first sentence."""
    seen = F.count(F.lit(1)).over(W.partitionBy("doc_id", "value").orderBy("sentence_id").rangeBetween(-n_prev, -1))
    return F.coalesce(F.try_divide(seen, F.nullif(F.least(F.lit(n_prev), F.col("sentence_id") - 1), F.lit(0))), F.lit(0.0))


def _match(cells: DataFrame) -> Column:
    total = lambda *by: F.sum("n").over(W.partitionBy(*by))
    return F.try_divide(total("doc_id", "value") - F.col("n"), F.nullif(total("doc_id") - total("doc_id", "sentence_id"), F.lit(0)))


def _same() -> Column:
    return (F.col("doc_id") == F.col("gw_doc")) & (F.col("sentence_id") == F.col("gw_sentence"))


def document_match(tokens: DataFrame, value: str = "token") -> DataFrame:
    """Adds normalized_match: occurrences of a token's value in the other sentences of its document, over the tokens of these; null where there are none."""
    cells = _cells(tokens, value)
    found = cells.select(F.col("doc_id").alias("gw_doc"), F.col("sentence_id").alias("gw_sentence"), F.col("value").alias("gw_value"), _match(cells).alias("normalized_match"))
    return tokens.join(found, _same() & F.col(value).eqNullSafe(F.col("gw_value")), "left").drop("gw_doc", "gw_sentence", "gw_value")


def previous_sentence_match(tokens: DataFrame, value: str = "token", n_prev: int = 1, name: str | None = None) -> DataFrame:
    """Adds the share of the ``n_prev`` sentences before a token's that have its value."""
    name = name or f"{value}_prev{n_prev}_prop"
    cells = _cells(tokens, value)
    found = cells.select(F.col("doc_id").alias("gw_doc"), F.col("sentence_id").alias("gw_sentence"), F.col("value").alias("gw_value"), _previous(cells, n_prev).alias(name))
    return tokens.join(found, _same() & F.col(value).eqNullSafe(F.col("gw_value")), "left").drop("gw_doc", "gw_sentence", "gw_value")


def similarity(a: Column, b: Column, method: str = "cosine") -> Column:
    """Of two arrays as sets: cosine or jaccard; null where one, or for jaccard both, are empty."""
    common, x, y = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    if method == "cosine":
        return F.try_divide(common.cast("double"), F.sqrt(x) * F.sqrt(y))
    if method == "jaccard":
        return F.try_divide(common, F.size(F.array_union(a, b)))
    raise ValueError("method is cosine or jaccard")


def _adjacent(sets: DataFrame, value: Column) -> DataFrame:
    """(doc_id, sentence_id, a, b) of each sentence whose id plus one is a sentence of the document too."""
    by = W.partitionBy("doc_id").orderBy("sentence_id")
    pairs = sets.select("doc_id", "sentence_id", value.alias("a"), F.lead("sentence_id").over(by).alias("next"), F.lead(value).over(by).alias("b"))
    return pairs.where("next = sentence_id + 1").drop("next")


def argument_overlap(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, arg_overlap) for each sentence that has a next one: 1 if a noun's or pronoun's lemma is in both."""
    sets = tokens.groupBy("doc_id", "sentence_id").agg(F.collect_set(F.when(F.col("upos").isin(*ARGUMENTS), F.col("lemma"))).alias("s"))
    overlap = F.size(F.array_intersect("a", "b")) > 0
    return _adjacent(sets, F.col("s")).select("doc_id", "sentence_id", overlap.cast("int").alias("arg_overlap"))


def sentence_similarity(tokens: DataFrame, method: str = "cosine", value: str = "token") -> DataFrame:
    """(doc_id, sentence_id, similarity) of each sentence's set of tokens with the next one's."""
    sets = tokens.groupBy("doc_id", "sentence_id").agg(F.collect_set(value).alias("s"))
    return _adjacent(sets, F.col("s")).select("doc_id", "sentence_id", similarity(F.col("a"), F.col("b"), method).alias("similarity"))


def lexical_cohesion(tokens: DataFrame, contexts: tuple[int, ...] = (1, 5), content: tuple[str, ...] = CONTENT) -> DataFrame:
    """Overlaps, similarities and gaps of each document, of its countable tokens and, with ``content`` in the names, of content words."""
    if not contexts or min(contexts) < 1:
        raise ValueError("contexts are integers of 1 or more")
    words = tokens.where("compte")
    parts = []
    for mark, rows in (("", words), ("content", words.where(F.col("upos").isin(*content)))):
        heads = {"token": "token_sent_overlap" if not mark else "content_sent_overlap", "lemma": "lemma_sent_overlap" if not mark else "content_lemma_sent_overlap"}
        for value, head in heads.items():
            cells = _cells(rows, value)
            cells = cells.withColumns({f"p{k}": _previous(cells, k) for k in contexts} | ({"m": _match(cells)} if value == "token" else {}))
            mean = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("n"))))
            columns = [mean(f"p{k}").alias(f"{head}_prev{k}") for k in contexts]
            parts.append(cells.groupBy("doc_id").agg(*columns, *([mean("m").alias("content_doc_overlap" if mark else "token_doc_overlap")] if value == "token" else [])))
        parts.append(sentence_similarity(rows).groupBy("doc_id").agg(F.avg("similarity").alias("cosine_content" if mark else "cosine_sent")))
        parts.append(argument_overlap(rows).groupBy("doc_id").agg(F.avg("arg_overlap").alias("arg_overlap_content" if mark else "arg_overlap")))
    out = functools.reduce(lambda a, b: a.join(b, "doc_id", "full"), parts)
    if 1 in contexts:
        out = out.withColumns({"global_local_gap": F.col("token_doc_overlap") - F.col("token_sent_overlap_prev1"), "content_global_local_gap": F.col("content_doc_overlap") - F.col("content_sent_overlap_prev1")})
    return out


class Cells:
    """The distinct (document, value, sentence) of some of a block's tokens, in this order, and how often each is there."""

    def __init__(self, b: Block, rows: np.ndarray, code: np.ndarray):
        s, many = b.s[rows], len(b.d)
        key = (b.d[s] * (int(code.max(initial=0)) + 1) + code[rows]) * many + s
        found, self.of_row, self.n = np.unique(key, return_inverse=True, return_counts=True)
        value, self.s = found // many, found % many
        self.fresh = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
        self.group = np.cumsum(self.fresh) - 1
        self.d, self.at = b.d[self.s], b.sentence_id[self.s].astype(np.int64)
        self.b = b

    def previous(self, n_prev: int) -> np.ndarray:
        """``_previous``: of the cells of a value that come before one, so many at most are in range."""
        seen = np.zeros(len(self.s), np.int64)
        for j in range(1, min(n_prev, len(seen) - 1) + 1):
            seen[j:] += (self.group[j:] == self.group[:-j]) & (self.at[j:] - self.at[:-j] <= n_prev)
        return np.nan_to_num(ratio(seen, np.minimum(n_prev, self.at - 1)))

    def match(self) -> np.ndarray:
        """``_match``."""
        total = lambda by: np.bincount(by, self.n)[by]
        return ratio(total(self.group) - self.n, total(self.d) - total(self.s))

    def common(self) -> np.ndarray:
        """How many values each sentence shares with the one before it, where that has the number before its own."""
        near = ~self.fresh[1:] & (self.at[1:] - self.at[:-1] == 1)
        return np.bincount(self.s[1:][near], minlength=len(self.b.d))


def matched_of(b: Block) -> dict:
    """``document_match`` of the countable words of annotated documents."""
    rows = np.flatnonzero(b.compte)
    cells = Cells(b, rows, b.code)
    return b.place(rows) | {"normalized_match": rounded(cells.match())[cells.of_row]}


def previous_of(n_prev: int, name: str) -> Kernel:
    """``previous_sentence_match`` of the countable words of annotated documents."""

    def run(b: Block) -> dict:
        rows = np.flatnonzero(b.compte)
        cells = Cells(b, rows, b.code)
        return b.place(rows) | {name: rounded(cells.previous(n_prev))[cells.of_row]}

    return run


def cohesion_of(b: Block, contexts: tuple[int, ...] = (1, 5), content: tuple[str, ...] = CONTENT) -> dict:
    """``lexical_cohesion`` of annotated documents."""
    many = len(b.doc_at)
    total = lambda by, x: np.bincount(by, x, minlength=many)
    lemma, _ = b.coded(b.lemmas)
    out = {}
    next_to = np.concatenate(([False], (b.d[1:] == b.d[:-1]) & (np.diff(b.sentence_id) == 1)))
    for mark, rows in (("", np.flatnonzero(b.compte)), ("content", np.flatnonzero(b.compte & b.tagged(*content)))):
        there = np.bincount(b.s[rows], minlength=len(b.d)) > 0
        pair = next_to & there & np.concatenate(([False], there[:-1]))
        heads = {"token": ("token_sent_overlap", "content_sent_overlap"), "lemma": ("lemma_sent_overlap", "content_lemma_sent_overlap")}
        for value, code in (("token", b.code), ("lemma", lemma)):
            cells = Cells(b, rows, code)

            def mean(x: np.ndarray, cells: Cells = cells) -> np.ndarray:
                known = ~np.isnan(x)
                return ratio(total(cells.d, np.where(known, cells.n * x, 0)), total(cells.d, cells.n * known))

            for k in contexts:
                out[f"{heads[value][bool(mark)]}_prev{k}"] = mean(cells.previous(k))
            if value == "token":
                out["content_doc_overlap" if mark else "token_doc_overlap"] = mean(cells.match())
                size = np.bincount(cells.s, minlength=len(b.d)).astype(float)
                root = np.sqrt(size)
                near = ratio(cells.common(), root * np.concatenate(([0], root[:-1])))
                out["cosine_content" if mark else "cosine_sent"] = ratio(total(b.d[pair], near[pair]), total(b.d[pair], np.ones(pair.sum())))
        shared = Cells(b, rows[b.tagged(*ARGUMENTS)[rows]], lemma).common() > 0
        out["arg_overlap_content" if mark else "arg_overlap"] = ratio(total(b.d[pair], shared[pair]), total(b.d[pair], np.ones(pair.sum())))
    if 1 in contexts:
        out |= {"global_local_gap": out["token_doc_overlap"] - out["token_sent_overlap_prev1"], "content_global_local_gap": out["content_doc_overlap"] - out["content_sent_overlap_prev1"]}
    keep = total(b.d[b.s], b.compte) > 0
    return {"doc_id": b.docs.filter(pa.array(keep)), **{n: rounded(x[keep]) for n, x in out.items()}}


_ROUND = lambda names, source, keys="doc_id": f" SELECT {keys}, " + ", ".join(f"round({c}, 9) + 0.0::DOUBLE AS {c}" for c in names) + f" FROM {source}"
# sentences before one by joining each with each, as the definition has it
_WORDS = PROLOGUE + f", w AS MATERIALIZED (SELECT * FROM tokens WHERE compte), c AS MATERIALIZED (SELECT * FROM w WHERE upos IN {CONTENT})"


def _prev_sql(name: str, source: str, value: str, k: int) -> str:
    return f""", {name} AS (SELECT t.doc_id, t.sentence_id, t.term_id, coalesce(count(s.sentence_id) / nullif(least({k}, t.sentence_id - 1), 0), 0) AS x
  FROM {source} t LEFT JOIN (SELECT DISTINCT doc_id, sentence_id, {value} AS v FROM {source}) s ON s.doc_id = t.doc_id AND s.v = t.{value} AND s.sentence_id >= t.sentence_id - {k} AND s.sentence_id < t.sentence_id GROUP BY t.doc_id, t.sentence_id, t.term_id)"""


def _match_sql(name: str, source: str) -> str:
    return f""", {name} AS (SELECT doc_id, sentence_id, term_id, (count(*) OVER (PARTITION BY doc_id, token) - count(*) OVER (PARTITION BY doc_id, sentence_id, token))
  / nullif(count(*) OVER (PARTITION BY doc_id) - count(*) OVER (PARTITION BY doc_id, sentence_id), 0) AS x FROM {source})"""


def _cosine_sql(name: str, source: str, jaccard: bool = False) -> str:
    size = "len(list_intersect(a.l, b.l))"
    over = f"(len(a.l) + len(b.l) - {size})" if jaccard else "sqrt(len(a.l)) / sqrt(len(b.l))"
    return f""", {name}_s AS (SELECT doc_id, sentence_id, list(DISTINCT token) AS l FROM {source} GROUP BY ALL),
{name} AS (SELECT a.doc_id, a.sentence_id, {size} / {over} AS similarity FROM {name}_s a JOIN {name}_s b ON a.doc_id = b.doc_id AND b.sentence_id = a.sentence_id + 1)"""


def _arg_sql(name: str, source: str) -> str:
    return f""", {name}_s AS (SELECT doc_id, sentence_id, coalesce(list(DISTINCT lemma) FILTER (upos IN ('NOUN', 'PRON')), []) AS l FROM {source} GROUP BY ALL),
{name} AS (SELECT a.doc_id, a.sentence_id, (len(list_intersect(a.l, b.l)) > 0)::INT AS arg_overlap FROM {name}_s a JOIN {name}_s b ON a.doc_id = b.doc_id AND b.sentence_id = a.sentence_id + 1)"""


_DOC = {
    "token_sent_overlap_prev1": _prev_sql("q1", "w", "token", 1), "token_sent_overlap_prev5": _prev_sql("q2", "w", "token", 5), "lemma_sent_overlap_prev1": _prev_sql("q3", "w", "lemma", 1),
    "lemma_sent_overlap_prev5": _prev_sql("q4", "w", "lemma", 5), "content_sent_overlap_prev1": _prev_sql("q5", "c", "token", 1), "content_sent_overlap_prev5": _prev_sql("q6", "c", "token", 5),
    "content_lemma_sent_overlap_prev1": _prev_sql("q7", "c", "lemma", 1), "content_lemma_sent_overlap_prev5": _prev_sql("q8", "c", "lemma", 5), "token_doc_overlap": _match_sql("q9", "w"), "content_doc_overlap": _match_sql("q10", "c"),
}
_SIM = {"cosine_sent": ("q11", "similarity", _cosine_sql("q11", "w")), "cosine_content": ("q12", "similarity", _cosine_sql("q12", "c")), "arg_overlap": ("q13", "arg_overlap", _arg_sql("q13", "w")), "arg_overlap_content": ("q14", "arg_overlap", _arg_sql("q14", "c"))}
_COHESION = [*_DOC, *_SIM]
SQL = {
    "document_match": _WORDS + _match_sql("q", "w") + _ROUND(["normalized_match"], "(SELECT doc_id, sentence_id, term_id, x AS normalized_match FROM q)", "doc_id, sentence_id, term_id"),
    "previous_sentence_match": _WORDS + _prev_sql("q", "w", "token", 5) + _ROUND(["token_prev5_prop"], "(SELECT doc_id, sentence_id, term_id, x AS token_prev5_prop FROM q)", "doc_id, sentence_id, term_id"),
    "argument_overlap": _WORDS + _arg_sql("q", "w") + " SELECT * FROM q",
    "sentence_cosine": _WORDS + _cosine_sql("q", "w") + _ROUND(["similarity"], "q", "doc_id, sentence_id"),
    "sentence_jaccard": _WORDS + _cosine_sql("q", "w", True) + _ROUND(["similarity"], "q", "doc_id, sentence_id"),
    "lexical_cohesion": _WORDS + "".join(_DOC.values()) + "".join(x[2] for x in _SIM.values())
    + ", d AS (SELECT doc_id FROM w GROUP BY ALL)"
    + "".join(f", a{i} AS (SELECT doc_id, avg(x) AS {n} FROM q{i + 1} GROUP BY doc_id)" for i, n in enumerate(_DOC))
    + "".join(f", b{i} AS (SELECT doc_id, avg({c}) AS {n} FROM {q} GROUP BY doc_id)" for i, (n, (q, c, _)) in enumerate(_SIM.items()))
    + _ROUND([*_COHESION, "global_local_gap", "content_global_local_gap"], "(SELECT *, token_doc_overlap - token_sent_overlap_prev1 AS global_local_gap, content_doc_overlap - content_sent_overlap_prev1 AS content_global_local_gap FROM d"
    + "".join(f" LEFT JOIN a{i} USING (doc_id)" for i in range(len(_DOC))) + "".join(f" LEFT JOIN b{i} USING (doc_id)" for i in range(len(_SIM))) + ")"),
}
