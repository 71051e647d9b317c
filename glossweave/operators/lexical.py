"""Lexical databases: matching, imputation of what they lack, and lexical diversity."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import PROLOGUE, prologue
from glossweave.blocks import UPOS, Block, Kernel, ratio

LEVELS = ("exact", "token_only", "lemma_to_token", "token_to_lemma", "lemma_to_lemma")
DIVERSITY_CONTENT = ("NOUN", "VERB", "ADJ", "ADV")


def build_lexicon(tokens: DataFrame) -> DataFrame:
    """A lexicon (token, upos, lemma, freq, freq_u) of a corpus' own frequencies; freq_u is per million."""
    counts = tokens.where("compte and upos is not null").groupBy(F.col("lower_token").alias("token"), "upos").agg(F.count(F.lit(1)).alias("freq"), F.min("lemma").alias("lemma"))
    return counts.crossJoin(counts.agg(F.sum("freq").alias("n"))).select("token", "upos", "lemma", "freq", (F.col("freq") * 1e6 / F.col("n")).alias("freq_u"))


def expand_plurals(lexicon: DataFrame, freq: str = "freq_u") -> DataFrame:
    """The lexicon with regular plurals (-s, -x, -eau to -eaux, -al to -aux) of its tokens that it doesn't have.

    Of several tokens that would have the same plural the one whose rule comes first is its source, of these the first
    by letters; all of the source's rows are carried over, one a tag, the one of the highest frequency.
    """
    t = F.col("token")
    rules = F.array(
        F.struct(F.lit(1).alias("rule"), F.concat(t, F.lit("s")).alias("plural")),
        F.struct(F.lit(2).alias("rule"), F.concat(t, F.lit("x")).alias("plural")),
        F.struct(F.lit(3).alias("rule"), F.regexp_replace(t, "eau$", "eaux").alias("plural")),
        F.struct(F.lit(4).alias("rule"), F.regexp_replace(t, "al$", "aux").alias("plural")),
    )
    made = lexicon.select("token", F.explode(rules).alias("r")).where(F.col("r.plural") != t)
    sources = made.groupBy("r.plural").agg(F.min_by("token", F.struct("r.rule", "token")).alias("token"))
    new = sources.join(lexicon.select(F.col("token").alias("plural")).distinct(), "plural", "left_anti").join(lexicon, "token")
    keys = ["plural", "upos"] if "upos" in lexicon.columns else ["plural"]
    others = [c for c in lexicon.columns if c not in ("token", "upos")]
    row = F.max_by(F.struct(*others), F.struct(freq, *[c for c in others if c != freq]))
    best = new.groupBy(*keys).agg(row.alias("row")).select(F.col("plural").alias("token"), *keys[1:], "row.*")
    return lexicon.withColumn("is_generated_plural", F.lit(False)).unionByName(best.withColumn("is_generated_plural", F.lit(True)))


_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def unaccented(c: Column) -> Column:
    """Lower case without accents; ligatures as their two letters."""
    return F.replace(F.replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def match_lexicon(tokens: DataFrame, lexicon: DataFrame, freq: str = "freq_u", prefix: str = "lex", token: str = "lower_token", strip_accents: bool = False) -> DataFrame:
    """Adds the lexicon's columns, as <prefix>_<column>, and <prefix>_match_level, by the first of five lookups that succeeds.

    They are (token, tag), token, lemma as token, token as lemma, lemma as lemma, all in lower case, without accents if
    ``strip_accents``; of several entries for a key the most frequent counts, then the greatest by its other columns.
    The lookups are made once for each type (token, lemma, tag) of the corpus, not for each token, and the lexicon is
    brought to one row a key first: no row is looked up twice or multiplied.
    """
    bare = unaccented if strip_accents else F.lower
    sides = {
        "exact": (["token", "upos"], [token, "upos"]),
        "token_only": (["token"], [token]),
        "lemma_to_token": (["token"], ["lemma"]),
        "token_to_lemma": (["lemma"], [token]),
        "lemma_to_lemma": (["lemma"], ["lemma"]),
    }
    sides = {level: side for level, side in sides.items() if all(k in lexicon.columns for k in side[0])}
    row = F.max(F.struct(F.col(freq).alias("gw_order"), *[F.col(c).alias(c) for c in lexicon.columns]))
    types = tokens.select(F.col(token).alias("t_token"), F.col("lemma").alias("t_lemma"), F.col("upos").alias("t_upos")).distinct()
    out = types
    for level, (keys, own) in sides.items():
        side = lexicon.where(F.col(freq).isNotNull()).groupBy(*[bare(F.col(k)).alias(f"k_{k}") for k in keys]).agg(row.alias(level))
        names = {token: "t_token", "lemma": "t_lemma", "upos": "t_upos"}
        on = functools.reduce(lambda a, b: a & b, (bare(F.col(names[o])) == F.col(f"k_{k}") for k, o in zip(keys, own)))
        out = out.join(side, on, "left").drop(*[f"k_{k}" for k in keys])
    level = F.lit("none")
    for name in reversed(sides):
        level = F.when(F.col(name).isNotNull(), name).otherwise(level)
    found = out.select("t_token", "t_lemma", "t_upos", F.coalesce(*sides).alias("gw_row"), level.alias(f"{prefix}_match_level"))
    joined = tokens.join(found, F.col(token).eqNullSafe(F.col("t_token")) & F.col("lemma").eqNullSafe(F.col("t_lemma")) & F.col("upos").eqNullSafe(F.col("t_upos")), "left")
    added = [F.col(f"gw_row.{c}").alias(f"{prefix}_{c}") for c in lexicon.columns]
    return joined.select(*[tokens[c] for c in tokens.columns], *added, f"{prefix}_match_level")


def lexicon_stats(lexicon: DataFrame, freq: str = "freq", by_upos: bool = False) -> DataFrame:
    """n (total), v (entries), min_freq, n1 and n2, the numbers of entries of the two lowest rounded frequencies: one row, or one a tag.

    Without a column ``freq``, freq_u * 1e6 stands for it.
    """
    value = F.col(freq) if freq in lexicon.columns else F.col("freq_u") * 1e6
    keys = ["upos"] if by_upos else []
    rows = lexicon.where("upos is not null") if by_upos else lexicon
    spectrum = rows.select(*keys, value.alias("f")).groupBy(*keys, F.bround(F.col("f").cast("double")).alias("r")).agg(F.count(F.lit(1)).alias("rows"), F.count("f").alias("nr"), F.sum("f").alias("total"), F.min("f").alias("least"))
    # the spectrum has as many rows as there are different frequencies
    two = F.slice(F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "nr")))), 1, 2)
    one = spectrum.groupBy(*keys).agg(F.sum("total").alias("n"), F.sum("rows").alias("v"), F.min("least").alias("min_freq"), two.alias("two"))
    return one.select(*keys, "n", "v", "min_freq", F.coalesce(F.get("two", F.lit(0)).getField("nr"), F.lit(0)).alias("n1"), F.coalesce(F.get("two", F.lit(1)).getField("nr"), F.lit(0)).alias("n2"))


def frequency_spectrum(lexicon: DataFrame, freq: str = "freq") -> DataFrame:
    return lexicon.groupBy(F.bround(F.col(freq).cast("double")).cast("long").alias("r")).agg(F.count(F.lit(1)).alias("nr"))


METHODS = ("skip", "epsilon", "per_doc_gt", "fixed_gt", "sgt", "chao1", "chao2", "upos_gt")


def impute(matched: DataFrame, lexicon: DataFrame, column: str, method: str = "fixed_gt", freq: str = "freq", mode: str = "raw", epsilon: float | None = None, n: float | None = None, n1: float | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Adds <column>_imputed: ``column`` where it isn't null, else an estimate for a word that the lexicon lacks.

    skip leaves null; epsilon takes half the least value of the column, or a constant. The others give the unseen words
    the share n1 / n of Good and Turing: to each word (fixed_gt); split among those of a document (per_doc_gt); among as
    many as a log-linear spectrum (sgt) or a richness estimator, by abundance (chao1) or by the documents that a word
    occurs in (chao2), expects; or tag by tag (upos_gt).

    ``mode`` is "u" where ``column`` is per million, and estimates are then too; fixed_gt and upos_gt then give
    n1 / n * 1e6 / n, as the reference has it. ``freq`` is the lexicon's column of raw frequencies, ``n`` and ``n1``
    override its total and the entries of the lowest frequency. What epsilon and chao2 need of the whole corpus is taken
    from ``seen`` (``seen_of``) if given, and what per_doc_gt needs of a document from a column gw_missing.
    """
    if mode not in ("raw", "u"):
        raise ValueError(f"unknown mode {mode!r}, not raw or u")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, not one of {METHODS}")
    out, value = f"{column}_imputed", F.col(column).cast("double")
    if method == "skip":
        return matched.withColumn(out, value)
    stats = lexicon_stats(lexicon, freq).select((F.lit(n) if n is not None else F.col("n")).cast("double").alias("n"), (F.lit(n1) if n1 is not None else F.col("n1")).cast("double").alias("n1"), "n2")
    share, scale = F.col("n1") / F.col("n"), F.lit(1e6) if mode == "u" else F.col("n")
    per_token = 1e6 / F.col("n") if mode == "u" else F.lit(1.0)
    unseen_of = lambda a, b: F.when(b > 0, a * a / (2.0 * b)).otherwise(a * (a - 1) / 2.0)
    # one row of estimates, beside which each token is left as it is
    if method == "epsilon":
        one = matched.agg((F.lit(float(epsilon)) if epsilon is not None else F.min(value) / 2).alias("gw_value")) if seen is None or epsilon is not None else seen.agg((F.min("least") / 2).alias("gw_value"))
    elif method in ("fixed_gt", "upos_gt"):
        one = stats.select((share * per_token).alias("gw_value"))
    elif method == "chao1":
        one = stats.select((share / F.greatest(unseen_of(F.col("n1"), F.col("n2")), F.lit(1.0)) * scale).alias("gw_value"))
    elif method == "sgt":
        spectrum = frequency_spectrum(lexicon, freq).where("r > 0")
        line = spectrum.agg(F.regr_slope(F.log("nr"), F.log("r")).alias("slope"), F.regr_intercept(F.log("nr"), F.log("r")).alias("icept"), F.count(F.lit(1)).alias("points"))
        unseen = F.greatest(F.exp(F.col("icept") + F.col("slope") * F.log(F.lit(0.5))), F.lit(1.0))
        one = stats.crossJoin(line).select(F.when(F.col("points") < 5, share * per_token).otherwise(share / unseen * scale).alias("gw_value"))
    elif method == "chao2":
        each = seen.groupBy("lower_token").agg(F.sum("docs").alias("docs")) if seen is not None else None
        unknown = matched.where(value.isNull()).groupBy("lower_token").agg(F.countDistinct("doc_id").alias("docs")) if each is None else each.where("lower_token is not null")
        q = unknown.agg(F.count_if(F.col("docs") == 1).alias("q1"), F.count_if(F.col("docs") == 2).alias("q2"))
        docs = matched.agg(F.countDistinct("doc_id").alias("n_docs")) if each is None else each.where("lower_token is null").agg(F.sum("docs").alias("n_docs"))
        unseen = F.greatest((F.col("n_docs") - 1) / F.col("n_docs") * unseen_of(F.col("q1"), F.col("q2")), F.lit(1.0))
        one = stats.crossJoin(q).crossJoin(docs).select((share / unseen * scale).alias("gw_value"))
    else:
        one = stats.select("n1", per_token.alias("per_token"))
    with_one = matched.crossJoin(F.broadcast(one))
    estimate = F.col("gw_value") if method != "per_doc_gt" else None
    if method == "per_doc_gt":
        if "gw_missing" not in matched.columns:
            missing = matched.where(value.isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("gw_missing"))
            with_one = with_one.join(missing, "doc_id", "left")
        estimate = F.col("n1") / F.col("gw_missing") * F.col("per_token")
    elif method == "upos_gt":
        per_tag = lexicon_stats(lexicon, freq, by_upos=True).select(F.col("upos").alias("gw_upos"), F.col("n1").alias("tag_n1"), F.col("n").alias("tag_n"))
        # one row a tag
        per_tag = per_tag.crossJoin(stats.select("n")).select("gw_upos", F.when(F.col("tag_n") > 0, F.col("tag_n1") / F.col("tag_n") * 1e6 / F.col("n") if mode == "u" else F.col("tag_n1") / F.col("n")).alias("gw_tag"))
        with_one = with_one.join(F.broadcast(per_tag), F.col("upos") == F.col("gw_upos"), "left")
        estimate = F.coalesce("gw_tag", "gw_value")
    return with_one.select(*[F.col(c) for c in matched.columns], F.coalesce(value, estimate).alias(out))


def lexical_frequency(tokens: DataFrame, lexicon: DataFrame, freq: str = "freq", mode: str = "raw", method: str = "fixed_gt", prefix: str = "lex", **given) -> DataFrame:
    """``match_lexicon``, then ``impute`` of the column <prefix>_<freq>."""
    raw = freq if mode == "raw" else "freq"
    return impute(match_lexicon(tokens, lexicon, freq, prefix), lexicon, f"{prefix}_{freq}", method, raw, mode, **given)


def _diversity(tokens: DataFrame, suffix: str, wanted: tuple[str, ...]) -> DataFrame:
    types = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("f"))
    n, v = F.sum("f"), F.count(F.lit(1))
    columns = {
        "TTR": v / n,
        "maas": F.when(n > 1, (F.log(n) - F.log(v)) / F.log((n * n).cast("double"))),
        "simpsons_D": F.when(n > 1, F.sum(F.col("f") * (F.col("f") - 1)) / (n * (n - 1))),
    }
    return types.groupBy("doc_id").agg(*[columns[c].alias(c + suffix) for c in wanted])


def moving_ttr(tokens: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, MATTR): the mean type-token ratio of all windows of so many words; shorter texts are one window.

    In closed form: a word is the first of its type in those windows that begin after its last occurrence, so that
    counting windows word by word adds up to the sum of all windows' types. One lag a word, whatever the window.
    """
    order = W.partitionBy("doc_id").orderBy("sentence_id", "term_id")
    placed = tokens.select("doc_id", "token", F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(W.partitionBy("doc_id")).alias("n"))
    placed = placed.withColumns({"w": F.least(F.col("n"), F.lit(window)), "last": F.lag("i").over(W.partitionBy("doc_id", "token").orderBy("i"))})
    first = F.greatest(F.lit(0), F.least(F.col("i"), F.col("n") - F.col("w") + 1) - F.greatest(F.lit(1), F.col("i") - F.col("w") + 1, F.coalesce("last", F.lit(0)) + 1) + 1)
    return placed.groupBy("doc_id").agg((F.sum(first) / F.first(F.col("w") * (F.col("n") - F.col("w") + 1))).alias("MATTR"))


def lexical_diversity(tokens: DataFrame, content: tuple[str, ...] = DIVERSITY_CONTENT, window: int = 50) -> DataFrame:
    """TTR, maas, MATTR, simpsons_D of all countable words, of content words (_content), and maas and simpsons_D of verbs (_verb).

    Words are told apart as they are written (``post_process`` lowers their case). With a column ``start`` only tokens
    that have one count; without ``compte`` all but punctuation.
    """
    words = tokens.where("start is not null") if "start" in tokens.columns else tokens
    words = words.where("compte") if "compte" in words.columns else words.where("upos is null or upos <> 'PUNCT'")
    every = ("TTR", "maas", "simpsons_D")
    parts = [_diversity(words, "", every), moving_ttr(words, window)]
    lexical = words.where(F.col("upos").isin(*content))
    parts += [_diversity(lexical, "_content", every), moving_ttr(lexical, window).withColumnRenamed("MATTR", "MATTR_content"), _diversity(words.where("upos = 'VERB'"), "_verb", every[1:])]
    return functools.reduce(lambda a, b: a.join(b, "doc_id", "left"), parts)


def _diversity_of(b: Block, rows: np.ndarray, suffix: str, window: int | None) -> dict:
    """``_diversity`` and ``moving_ttr`` of some tokens of each of a block's documents; NaN where it has none."""
    many, d = len(b.doc_at), b.d[b.s[rows]]
    key = d * len(b.types) + b.code[rows]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], np.diff(key[order]) != 0)) if len(rows) else np.zeros(0, bool)
    f = np.diff(np.concatenate((np.flatnonzero(fresh), [len(rows)])))
    of = d[order][fresh]
    n, v = np.bincount(d, minlength=many), np.bincount(of, minlength=many)
    several = n > 1
    log = lambda x: np.log(np.maximum(x, 1).astype(float))
    out = {"TTR": ratio(v, n), "maas": np.where(several, ratio(log(n) - log(v), log(n * n)), np.nan), "simpsons_D": np.where(several, ratio(np.bincount(of, f * (f - 1), minlength=many), n * (n - 1)), np.nan)}
    if window:
        i = np.arange(len(rows)) - (np.cumsum(n) - n)[d] + 1
        last = np.zeros(len(rows), np.int64)
        last[order[1:]] = np.where(fresh[1:], 0, i[order[:-1]])
        w = np.minimum(n, window)
        first = np.maximum(0, np.minimum(i, (n - w + 1)[d]) - np.maximum(np.maximum(1, i - w[d] + 1), last + 1) + 1)
        out["MATTR"] = ratio(np.bincount(d, first, minlength=many), w * (n - w + 1))
    return {c + suffix: x for c, x in out.items()}


def diversity_of(b: Block, content: tuple[str, ...] = DIVERSITY_CONTENT, window: int = 50) -> dict:
    """``lexical_diversity`` of annotated documents."""
    word = b.compte
    out = _diversity_of(b, np.flatnonzero(word), "", window) | _diversity_of(b, np.flatnonzero(word & b.tagged(*content)), "_content", window) | _diversity_of(b, np.flatnonzero(word & b.tagged("VERB")), "_verb", None)
    keep = ~np.isnan(out["TTR"])
    return {"doc_id": b.docs.filter(pa.array(keep)), **{n: x[keep] for n, x in out.items()}}


class Found:
    """``match_lexicon`` by words: the value that a lexicon has for (lower-case token, lemma, tag), by the first of the five lookups that succeeds."""

    def __init__(self, lexicon: DataFrame, freq: str):
        self.levels: list[dict] = [{} for _ in LEVELS]
        for r in lexicon.where(F.col(freq).isNotNull()).select(F.lower("token"), "upos", F.lower("lemma"), F.col(freq).cast("double")).collect():
            for level, key in zip(self.levels, ((r[0], r[1]), r[0], r[0], r[2], r[2])):
                level[key] = max(r[3], level.get(key, r[3]))

    def value(self, token: str, lemma: str, upos: str) -> float:
        for level, key in zip(self.levels, ((token, upos), token, lemma, token, lemma)):
            if key in level:
                return level[key]
        return np.nan

    def __call__(self, b: Block) -> np.ndarray:
        """Of each token; NaN where it has none."""
        pairs, of = np.unique(b.code * len(UPOS) + b.upos, return_inverse=True)
        word, tag = pairs // len(UPOS), pairs % len(UPOS)
        return np.array([self.value(b.lowers[w], b.lemmas[w], UPOS[t]) for w, t in zip(word, tag)], float)[of]


def imputed_of(found: Found, column: str, estimates: dict[str, float | None], by_document: bool = False) -> Kernel:
    """``impute`` of annotated documents: what a lexicon has for each token, else the estimate of its tag, split among such tokens of the document if ``by_document``."""
    of_tag = np.array([np.nan if estimates[u] is None else estimates[u] for u in UPOS], float)

    def run(b: Block) -> dict:
        value = found(b)
        lacking = np.isnan(value)
        estimate = of_tag[b.upos[lacking]]
        if by_document:
            d = b.d[b.s[lacking]]
            estimate = estimate / np.bincount(d)[d] if len(d) else estimate
        value[lacking] = estimate
        return b.place() | {f"{column}_imputed": value}

    return run


def seen_of(found: Found, words: bool) -> Kernel:
    """What ``impute`` needs of a whole corpus, block by block: for a null word all documents and the least value; with ``words`` also (lower_token, docs) of those that the lexicon lacks."""

    def run(b: Block) -> dict:
        value = found(b)
        lacking = np.isnan(value)
        least = np.nanmin(value) if not lacking.all() else np.nan
        names: list = []
        docs = np.zeros(0, np.int64)
        if words:
            lower, names = b.coded(b.lowers)
            docs = np.bincount(np.unique(b.d[b.s[lacking]] * len(names) + lower[lacking]) % len(names), minlength=len(names))
        some = np.flatnonzero(docs)
        return {"lower_token": [*(names[i] for i in some), None], "docs": np.append(docs[some], len(b.doc_at)), "least": np.append(np.full(len(some), np.nan), least)}

    return run


#: The lexicon of the passages of ``benchmark``, a corpus of its own, so that words of ``documents`` are found on all levels or missed.
NORMS = "WITH" + prologue("benchmark", "item_id", "n_")
_COUNTED = """, counted AS (SELECT lower_token AS token, upos, count(*) AS freq, min(lemma) AS lemma FROM n_tokens WHERE compte GROUP BY lower_token, upos),
lexicon AS (SELECT token, upos, lemma, freq, freq * 1e6::DOUBLE / (SELECT sum(freq)::DOUBLE FROM counted) AS freq_u FROM counted)"""
_LEXICON = PROLOGUE + "," + prologue("benchmark", "item_id", "n_") + _COUNTED
# each level by itself over what the levels before it left, as the definition has it
_LEVEL = "SELECT r, {n} AS level, max(freq) AS f, max(freq_u) AS u FROM ids JOIN lexicon l ON {on} WHERE r NOT IN (SELECT r FROM {before}) GROUP BY r"
_ON = {"exact": "l.token = ids.lower_token AND l.upos = ids.upos", "token_only": "l.token = ids.lower_token", "lemma_to_token": "l.token = lower(ids.lemma)", "token_to_lemma": "l.lemma = ids.lower_token", "lemma_to_lemma": "l.lemma = lower(ids.lemma)"}


def _levels() -> str:
    out, before = "", "none_yet"
    for i, (name, on) in enumerate(_ON.items()):
        out += f", step_{i} AS MATERIALIZED (" + _LEVEL.format(n=f"'{name}'", on=on, before=before) + f"), upto_{i} AS MATERIALIZED (SELECT r FROM step_{i} UNION ALL SELECT r FROM {before})"
        before = f"upto_{i}"
    return out + ", found AS (" + " UNION ALL ".join(f"SELECT * FROM step_{i}" for i in range(len(_ON))) + ")"


_MATCHED = f""", ids AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT lower_token, lemma, upos FROM tokens)), none_yet AS (SELECT r FROM ids WHERE FALSE){_levels()},
matched AS MATERIALIZED (SELECT t.*, f.f AS lex_freq, f.u AS lex_freq_u, coalesce(f.level, 'none') AS lex_match_level
  FROM tokens t JOIN ids ON ids.lower_token = t.lower_token AND ids.lemma = t.lemma AND ids.upos = t.upos LEFT JOIN found f USING (r))"""
_STATS = """, spectrum AS (SELECT freq AS r, count(*) AS nr FROM lexicon GROUP BY freq),
stats AS (SELECT (SELECT sum(freq)::DOUBLE FROM lexicon) AS n, (SELECT nr::DOUBLE FROM spectrum ORDER BY r LIMIT 1) AS n1, coalesce((SELECT nr::DOUBLE FROM spectrum ORDER BY r LIMIT 1 OFFSET 1), 0) AS n2)"""


def _imputed_sql(method: str, mode: str) -> str:
    column = "lex_freq_u" if mode == "u" else "lex_freq"
    scale, by_token = ("1e6::DOUBLE", "* 1e6::DOUBLE / n") if mode == "u" else ("n", "")
    richness = "CASE WHEN {b} > 0 THEN {a} * {a} / (2.0::DOUBLE * {b}) ELSE {a} * ({a} - 1) / 2.0::DOUBLE END"
    tag = f"(SELECT s.nr{{}} FROM (SELECT upos, freq, count(*) AS nr FROM lexicon GROUP BY ALL) s WHERE s.upos = matched.upos ORDER BY s.freq LIMIT 1)"
    of_tag = "(SELECT sum(h.freq)::DOUBLE FROM lexicon h WHERE h.upos = matched.upos)"
    value = {
        "epsilon": f"(SELECT min({column}) FROM matched) / 2.0::DOUBLE",
        "fixed_gt": f"n1 / n {by_token}",
        "per_doc_gt": f"n1 / nullif(count(*) FILTER ({column} IS NULL) OVER (PARTITION BY doc_id), 0) {by_token}",
        "chao1": f"n1 / n / greatest({richness.format(a='n1', b='n2')}, 1.0::DOUBLE) * {scale}",
        "sgt": f"CASE WHEN (SELECT count(*) FROM spectrum) < 5 THEN n1 / n {by_token} ELSE n1 / n / greatest(exp((SELECT regr_intercept(ln(nr), ln(r)) FROM spectrum) + (SELECT regr_slope(ln(nr), ln(r)) FROM spectrum) * ln(0.5::DOUBLE)), 1.0::DOUBLE) * {scale} END",
        "chao2": f"""n1 / n / greatest((SELECT count(DISTINCT doc_id) - 1 FROM tokens) / (SELECT count(DISTINCT doc_id) FROM tokens) *
          (SELECT {richness.format(a="q1", b="q2")} FROM (SELECT (count(*) FILTER (d = 1))::DOUBLE AS q1, (count(*) FILTER (d = 2))::DOUBLE AS q2
           FROM (SELECT count(DISTINCT doc_id) AS d FROM matched WHERE {column} IS NULL GROUP BY lower_token))), 1.0::DOUBLE) * {scale}""",
        "upos_gt": f"coalesce({tag.format('')} / {of_tag} * 1e6::DOUBLE / n, n1 / n * 1e6::DOUBLE / n)" if mode == "u" else f"coalesce({tag.format('')} / n, n1 / n)",
        "skip": "NULL",
    }[method]
    return _LEXICON + _MATCHED + _STATS + f" SELECT doc_id, sentence_id, term_id, coalesce({column}::DOUBLE, {value}) AS {column}_imputed FROM matched, stats"


def _diversity_sql(name: str, where: str, suffix: str, wanted: tuple[str, ...]) -> str:
    columns = {
        "TTR": f"count(*) / sum(f) AS TTR{suffix}",
        "maas": f"CASE WHEN sum(f) > 1 THEN (ln(sum(f)::DOUBLE) - ln(count(*)::DOUBLE)) / ln((sum(f) * sum(f))::DOUBLE) END AS maas{suffix}",
        "simpsons_D": f"CASE WHEN sum(f) > 1 THEN sum(f * (f - 1)) / (sum(f) * (sum(f) - 1)) END AS simpsons_D{suffix}",
    }
    return f", {name} AS (SELECT doc_id, {', '.join(columns[c] for c in wanted)} FROM (SELECT doc_id, token, count(*) AS f FROM tokens WHERE {where} GROUP BY ALL) GROUP BY doc_id)"


def _mattr_sql(name: str, where: str, suffix: str) -> str:
    # window by window: the different words of each list of fifty
    return f""", {name}_l AS (SELECT doc_id, list(token ORDER BY sentence_id, term_id) AS l FROM tokens WHERE {where} GROUP BY doc_id),
{name}_w AS (SELECT doc_id, list_slice(l, i, i + least(len(l), 50) - 1) AS s FROM {name}_l, unnest(range(1, len(l) - least(len(l), 50) + 2)) t(i)),
{name} AS (SELECT doc_id, sum(len(list_distinct(s))) / sum(len(s)) AS MATTR{suffix} FROM {name}_w GROUP BY doc_id)"""


_C = f"compte AND upos IN {tuple(DIVERSITY_CONTENT)}"
_EVERY = ("TTR", "maas", "simpsons_D")
SQL = {
    "lexicon": NORMS + _COUNTED + " SELECT * FROM lexicon",
    "lexical_plurals": NORMS
    + _COUNTED
    + """, made AS (SELECT rule, token AS source, CASE rule WHEN 1 THEN token || 's' WHEN 2 THEN token || 'x' WHEN 3 THEN regexp_replace(token, 'eau$', 'eaux') ELSE regexp_replace(token, 'al$', 'aux') END AS plural
  FROM (SELECT DISTINCT token FROM lexicon), (VALUES (1), (2), (3), (4)) r(rule)),
fixed AS (SELECT DISTINCT ON (plural) plural, source FROM made WHERE plural <> source ORDER BY plural, rule, source)
SELECT token, upos, lemma, freq, freq_u, FALSE AS is_generated_plural FROM lexicon UNION ALL
SELECT plural, upos, lemma, freq, freq_u, TRUE FROM fixed JOIN lexicon ON token = source WHERE plural NOT IN (SELECT token FROM lexicon)""",
    "lexical_cascade": _LEXICON + _MATCHED + " SELECT doc_id, sentence_id, term_id, lex_freq_u, lex_match_level FROM matched",
    "frequency_spectrum": NORMS + _COUNTED + " SELECT freq AS r, count(*) AS nr FROM lexicon GROUP BY freq",
    "lexicon_stats": NORMS + _COUNTED + """, spectrum AS (SELECT freq AS r, count(*) AS nr FROM lexicon GROUP BY freq)
SELECT sum(r * nr)::BIGINT AS n, sum(nr)::BIGINT AS v, min(r) AS min_freq, (SELECT nr FROM spectrum ORDER BY r LIMIT 1) AS n1, (SELECT nr FROM spectrum ORDER BY r LIMIT 1 OFFSET 1) AS n2 FROM spectrum""",
    "lexicon_stats_by_upos": NORMS + _COUNTED + """, s AS (SELECT *, row_number() OVER (PARTITION BY upos ORDER BY freq) AS k FROM (SELECT upos, freq, count(*) AS nr FROM lexicon GROUP BY upos, freq))
SELECT upos, sum(freq * nr)::BIGINT AS n, sum(nr)::BIGINT AS v, min(freq) AS min_freq, sum(nr) FILTER (k = 1)::BIGINT AS n1, coalesce(sum(nr) FILTER (k = 2), 0)::BIGINT AS n2 FROM s GROUP BY upos""",
    **{f"impute_{m}{'_u' if mode == 'u' else ''}": _imputed_sql(m, mode) for m in METHODS for mode in ("raw", "u")},
    "lexical_diversity": PROLOGUE
    + _diversity_sql("a", "compte", "", _EVERY) + _mattr_sql("b", "compte", "") + _diversity_sql("c", _C, "_content", _EVERY) + _mattr_sql("d", _C, "_content") + _diversity_sql("e", "compte AND upos = 'VERB'", "_verb", _EVERY[1:])
    + " SELECT * FROM a LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN e USING (doc_id)",
}
