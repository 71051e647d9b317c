"""How words cluster: gaps between their occurrences, and how the first occurrence raises the odds of a second.

Gaps are counted before they are gathered: a word comes with its distinct gaps and how often each occurs, of which there
are at most about the square root of twice the corpus' length, however frequent the word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import PROLOGUE
from glossweave.scratch import stored

CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
#: The shape is looked for in this interval, by halving it so many times.
LOW, HIGH, HALVINGS = 1e-4, 20.0, 60


def _named(tokens: DataFrame, token: str, lowercase: bool) -> DataFrame:
    word = F.lower(token) if lowercase else F.col(token)
    return tokens.withColumn("word", word).where("word is not null and word <> ''")


def global_positions(tokens: DataFrame, token: str = "token", lowercase: bool = True) -> DataFrame:
    """(word, position) in the corpus' one stream of tokens, documents in the order of their ids.

    A document's offset is the sum of the lengths before it: within ranges of documents first, then over the ranges, so
    that no task sees more than a range.
    """
    t = _named(tokens, token, lowercase)
    sizes = stored(t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size")).repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    upto = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    within = F.sum("size").over(W.partitionBy("part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.join(F.broadcast(parts.select("part", F.coalesce(upto, F.lit(0)).alias("base"))), "part").select("doc_id", (F.col("base") + F.coalesce(within, F.lit(0))).alias("offset"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("sentence_id", "term_id"))
    return t.withColumn("place", place).join(offsets, "doc_id").select("word", (F.col("offset") + F.col("place")).alias("position"))


def weibull_shape(gaps: np.ndarray, times: np.ndarray) -> tuple[float | None, float | None]:
    """The maximum-likelihood shape and its standard error; None where there are less than two gaps, or all are the same."""
    n = times.sum()
    if n < 2 or len(gaps) < 2:
        return None, None
    logs = np.log(gaps)
    mean = (times * logs).sum() / n

    def sums(b: float) -> tuple[float, float, float]:
        power = times * np.exp(b * (logs - logs.max()))
        return power.sum(), (power * logs).sum(), (power * logs * logs).sum()

    def slope(b: float) -> float:
        s0, s1, _ = sums(b)
        return 1 / b + mean - s1 / s0

    low, high = LOW, HIGH
    if slope(low) < 0 or slope(high) > 0:
        return None, None
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    b = (low + high) / 2
    s0, s1, s2 = sums(b)
    information = n / b**2 - n * (s2 / s0 - (s1 / s0) ** 2)
    return b, 1 / float(np.sqrt(information)) if np.isfinite(information) and information > 0 else None


def burstiness_beta(tokens: DataFrame, token: str = "token", min_occurrences: int = 20, lowercase: bool = True) -> DataFrame:
    """(word, n_occ, mean_gap, beta, beta_se): the Weibull shape of the gaps between a word's occurrences in the corpus.

    Below 1 a word comes in bursts. Null for words of fewer occurrences. The standard error comes of n / beta**2 less n
    times the weighted variance of the logarithms, and is null where that isn't positive.
    """
    at = global_positions(tokens, token, lowercase)
    gap = F.col("position") - F.lag("position").over(W.partitionBy("word").orderBy("position"))
    counted = at.withColumn("gap", gap).groupBy("word", "gap").agg(F.count(F.lit(1)).alias("n"))
    words = counted.groupBy("word").agg(F.sum("n").alias("n_occ"), F.sum(F.col("gap") * F.col("n")).alias("sum"), F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("gap", "n")))).alias("gaps"))

    @F.arrow_udf("struct<beta:double,se:double>")
    def shapes(gaps: pa.Array, times: pa.Array) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(gaps.value_lengths().to_numpy())))
        g, t = gaps.flatten().to_numpy().astype(float), times.flatten().to_numpy().astype(float)
        found = [weibull_shape(g[i:j], t[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        return pa.array([{"beta": b, "se": s} for b, s in found], pa.struct([("beta", pa.float64()), ("se", pa.float64())]))

    some = F.filter("gaps", lambda x: F.col("n_occ") >= min_occurrences)
    out = words.withColumn("kept", some).withColumn("fit", shapes("kept.gap", "kept.n"))
    return out.select("word", "n_occ", F.try_divide("sum", F.nullif(F.col("n_occ") - 1, F.lit(0))).alias("mean_gap"), F.col("fit.beta").alias("beta"), F.col("fit.se").alias("beta_se"))


def adaptation_score(tokens: DataFrame, token: str = "token", min_docs: int = 10, lowercase: bool = True) -> DataFrame:
    """(word, n_docs, mean_count, var_count, nb_r, nb_p, p_x1, p_x2_given_x1, adaptation) under a negative binomial of a word's counts.

    Moments are over all documents. The probability of the binomial is 1 - nb_p, as the reference has it, so that
    P(0) = q**r and P(1) = r nb_p q**r with q = 1 - nb_p.
    """
    t = _named(tokens, token, lowercase)
    counts = t.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    words = counts.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    words = words.crossJoin(F.broadcast(t.agg(F.countDistinct("doc_id").alias("docs"))))
    mean = F.col("s") / F.col("docs")
    words = words.withColumns({"mean_count": mean, "var_count": F.col("s2") / F.col("docs") - mean * mean})
    wide = F.col("var_count") > F.col("mean_count")
    words = words.withColumns({"nb_r": F.when(wide, F.col("mean_count") * F.col("mean_count") / (F.col("var_count") - F.col("mean_count"))), "nb_p": F.when(wide, F.col("mean_count") / F.col("var_count"))})
    # both probabilities are small, so neither is taken as a difference from 1
    log_none = F.col("nb_r") * F.log1p(-F.col("nb_p"))
    known = wide & (F.col("n_docs") >= min_docs)
    words = words.withColumns({"p_x1": F.when(known, -F.expm1(log_none))})
    words = words.withColumns({"p_x2_given_x1": F.try_divide(F.when(known, F.col("p_x1") - F.col("nb_r") * F.col("nb_p") * F.exp(log_none)), F.col("p_x1"))})
    return words.select("word", "n_docs", "mean_count", "var_count", "nb_r", "nb_p", "p_x1", "p_x2_given_x1", F.try_divide("p_x2_given_x1", F.col("p_x1")).alias("adaptation"))


def word_norms(tokens: DataFrame, token: str = "token", min_occurrences: int = 20, min_docs: int = 10, lowercase: bool = True) -> DataFrame:
    """(word, beta, adaptation) of a reference corpus, to be kept and used on others."""
    beta = burstiness_beta(tokens, token, min_occurrences, lowercase).select("word", "beta")
    return beta.join(adaptation_score(tokens, token, min_docs, lowercase).select("word", "adaptation"), "word", "full")


def burstiness_features(tokens: DataFrame, norms: DataFrame, token: str = "token", content: tuple[str, ...] = CONTENT, threshold: float = 0.6, lowercase: bool = True) -> DataFrame:
    """Means, medians and shares of its words' norms (word, beta, adaptation) for each document."""
    t = _named(tokens, token, lowercase).select("doc_id", "word", "upos").join(norms, "word", "left")
    lexical = F.col("upos").isin(*content)
    bursty = (F.col("beta") < threshold).cast("int")
    return t.groupBy("doc_id").agg(
        F.avg("beta").alias("mean_beta"), F.median("beta").alias("median_beta"), F.avg(bursty).alias("prop_bursty"), F.avg("adaptation").alias("mean_adaptation"), F.median("adaptation").alias("median_adaptation"),
        F.avg(F.when(lexical, F.col("beta"))).alias("mean_beta_content"), F.avg(F.when(lexical, bursty)).alias("prop_bursty_content"), F.avg(F.when(lexical, F.col("adaptation"))).alias("mean_adaptation_content"),
    )


def burstiness_within_doc(tokens: DataFrame, token: str = "token", content: tuple[str, ...] = CONTENT, min_gaps: int = 2, lowercase: bool = True) -> DataFrame:
    """Goh and Barabasi's B = (sd - mean) / (sd + mean) of the gaps of each word in a document: mean, deviation and number by document."""
    t = _named(tokens, token, lowercase)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("sentence_id", "term_id"))
    t = t.select("doc_id", "word", "upos", place.alias("pos"))
    t = t.withColumn("gap", F.col("pos") - F.lag("pos").over(W.partitionBy("doc_id", "word").orderBy("pos")))
    g = t.groupBy("doc_id", "word").agg(F.count("gap").alias("n"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"), F.min_by("upos", "pos").alias("upos"))
    b = F.when((F.col("n") >= min_gaps) & (F.col("s") + F.col("m") != 0), (F.col("s") - F.col("m")) / (F.col("s") + F.col("m")))
    g = g.select("doc_id", b.alias("b"), F.col("upos").isin(*content).alias("lexical")).where("b is not null")
    of = F.when(F.col("lexical"), F.col("b"))
    columns: list[Column] = [F.avg("b").alias("mean_B"), F.stddev_samp("b").alias("sd_B"), F.count("b").alias("n_words_B"), F.avg(of).alias("mean_B_content"), F.stddev_samp(of).alias("sd_B_content"), F.nullif(F.count(of), F.lit(0)).alias("n_words_B_content")]
    return g.groupBy("doc_id").agg(*columns)


_NORMS = """, docs AS (SELECT count(DISTINCT doc_id) AS d FROM tokens), cnt AS (SELECT lower_token AS word, doc_id, count(*) AS c FROM tokens GROUP BY ALL),
m AS (SELECT word, count(*) AS n_docs, sum(c) / any_value(d) AS mean_count, sum(c * c) / any_value(d) - (sum(c) / any_value(d)) * (sum(c) / any_value(d)) AS var_count FROM cnt, docs GROUP BY word),
nb AS (SELECT *, CASE WHEN var_count > mean_count THEN mean_count * mean_count / (var_count - mean_count) END AS nb_r, CASE WHEN var_count > mean_count THEN mean_count / var_count END AS nb_p FROM m),
ln AS (SELECT *, -2 * atanh(nb_p / (2 - nb_p)) * nb_r AS l FROM nb),
px AS (SELECT *, CASE WHEN n_docs >= 10 THEN -2 * sinh(l / 2) * exp(l / 2) END AS p_x1, CASE WHEN n_docs >= 10 THEN -2 * sinh(l / 2) * exp(l / 2) - nb_r * nb_p * exp(l) END AS two FROM ln),
adapt AS MATERIALIZED (SELECT *, two / nullif(p_x1, 0) AS p_x2_given_x1, two / nullif(p_x1, 0) / nullif(p_x1, 0) AS adaptation FROM px),
spots AS MATERIALIZED (SELECT lower_token AS word, row_number() OVER (ORDER BY doc_id, sentence_id, term_id) AS position FROM tokens),
gaps AS MATERIALIZED (SELECT word, gap::DOUBLE AS gap, count(*) AS n FROM (SELECT word, position - lag(position) OVER (PARTITION BY word ORDER BY position) AS gap FROM spots) WHERE gap IS NOT NULL GROUP BY ALL),
occ AS MATERIALIZED (SELECT word, count(*) AS n_occ, (max(position) - min(position)) / nullif(count(*) - 1, 0) AS mean_gap FROM spots GROUP BY word),
able AS MATERIALIZED (SELECT word, sum(n) AS n, sum(n * ln(gap)) / sum(n) AS mean_log, max(ln(gap)) AS top FROM gaps JOIN occ USING (word) WHERE n_occ >= 20 GROUP BY word HAVING count(*) > 1),
bis AS (SELECT word, 1e-4::DOUBLE AS low, 20.0::DOUBLE AS high, 0 AS turn FROM able
  UNION ALL SELECT word, CASE WHEN slope > 0 THEN middle ELSE low END, CASE WHEN slope > 0 THEN high ELSE middle END, turn + 1 FROM (
    SELECT b.word, b.low, b.high, b.turn, (b.low + b.high) / 2 AS middle, 2 / (b.low + b.high) + any_value(a.mean_log) - sum(g.n * exp((b.low + b.high) / 2 * (ln(g.gap) - a.top)) * ln(g.gap)) / sum(g.n * exp((b.low + b.high) / 2 * (ln(g.gap) - a.top))) AS slope
    FROM bis b JOIN gaps g USING (word) JOIN able a USING (word) WHERE b.turn < 60 GROUP BY b.word, b.low, b.high, b.turn)),
shape AS MATERIALIZED (SELECT word, (low + high) / 2 AS beta FROM bis WHERE turn = 60 AND low > 1e-4 AND high < 20)"""
_BURST = PROLOGUE.replace("WITH", "WITH RECURSIVE", 1) + _NORMS
_R = lambda e, n: f"round({e}, 6) + 0.0::DOUBLE AS {n}"
_C = f"upos IN {CONTENT}"
SQL = {
    "burstiness_beta": _BURST + f" SELECT word, n_occ, {_R('mean_gap', 'mean_gap')}, {_R('beta', 'beta')} FROM occ LEFT JOIN shape USING (word)",
    "adaptation_score": PROLOGUE + _NORMS.split(",\nspots")[0] + f" SELECT word, n_docs, {', '.join(_R(c, c) for c in ('mean_count', 'var_count', 'nb_r', 'nb_p', 'p_x1', 'p_x2_given_x1', 'adaptation'))} FROM adapt",
    "burstiness_features": _BURST + f""", t AS (SELECT t.doc_id, t.upos, s.beta, a.adaptation FROM tokens t LEFT JOIN shape s ON s.word = t.lower_token LEFT JOIN adapt a ON a.word = t.lower_token)
SELECT doc_id, {_R('avg(beta)', 'mean_beta')}, {_R('median(beta)', 'median_beta')}, {_R('avg((beta < 0.6)::INT)', 'prop_bursty')}, {_R('avg(adaptation)', 'mean_adaptation')}, {_R('median(adaptation)', 'median_adaptation')},
  {_R(f'avg(beta) FILTER ({_C})', 'mean_beta_content')}, {_R(f'avg((beta < 0.6)::INT) FILTER ({_C})', 'prop_bursty_content')}, {_R(f'avg(adaptation) FILTER ({_C})', 'mean_adaptation_content')} FROM t GROUP BY doc_id""",
    "burstiness_within_doc": PROLOGUE + f""", p AS (SELECT doc_id, lower_token AS word, upos, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id, term_id) AS pos FROM tokens),
g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos) AS gap FROM p),
b AS (SELECT doc_id, word, arg_min(upos, pos) AS upos, CASE WHEN count(gap) >= 2 THEN (stddev_samp(gap) - avg(gap)) / (stddev_samp(gap) + avg(gap)) END AS b FROM g GROUP BY ALL)
SELECT doc_id, {_R('avg(b)', 'mean_B')}, {_R('stddev_samp(b)', 'sd_B')}, count(b) AS n_words_B, {_R(f'avg(b) FILTER ({_C})', 'mean_B_content')}, {_R(f'stddev_samp(b) FILTER ({_C})', 'sd_B_content')}, nullif(count(b) FILTER ({_C}), 0) AS n_words_B_content
FROM b WHERE b IS NOT NULL GROUP BY doc_id""",
}
