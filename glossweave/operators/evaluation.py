"""Agreement of raters, differences of groups, cross-validation and the choice of features."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kappa(first: DataFrame, second: DataFrame, item: str = "passage_id", group: str = "code", value: str = "applies") -> DataFrame:
    """(group, kappa, p_observed, n): Cohen's kappa of two raters' yes or no, for each group; null where chance agreement is 1."""
    side = lambda df, n: df.where(F.col(value).isNotNull()).select(item, group, F.col(value).cast("int").alias(n))
    n = F.count(F.lit(1))
    agreed, a, b = F.count_if(F.col("r1") == F.col("r2")), F.count_if(F.col("r1") != 0), F.count_if(F.col("r2") != 0)
    s = side(first, "r1").join(side(second, "r2"), [item, group]).groupBy(group).agg(n.alias("n"), (agreed / n).alias("p_observed"), ((a / n) * (b / n) + ((n - a) / n) * ((n - b) / n)).alias("p_e"))
    return s.select(group, F.when(F.col("p_e") != 1, (F.col("p_observed") - F.col("p_e")) / (1 - F.col("p_e"))).alias("kappa"), "p_observed", "n")


def weighted_kappa(df: DataFrame, true: str, predicted: str, levels: int = 5) -> DataFrame:
    """(qwk): quadratic weighted kappa of two columns of levels 1 to ``levels``; null where all are one level."""
    inside = df.where(F.col(true).between(1, levels) & F.col(predicted).between(1, levels))
    cells = inside.groupBy(F.col(true).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))  # levels squared rows
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.pow(F.col("t") - F.col("p"), F.lit(2)) * F.col("n")).alias("seen"))
    rows, columns = cells.groupBy("t").agg(F.sum("n").alias("nt")), cells.groupBy("p").agg(F.sum("n").alias("np"))
    expected = rows.crossJoin(columns).agg(F.sum(F.pow(F.col("t") - F.col("p"), F.lit(2)) * F.col("nt") * F.col("np")).alias("by_chance"))
    return total.crossJoin(expected).select((1 - F.try_divide(F.col("seen"), F.col("by_chance") / F.col("total"))).alias("qwk"))


def _moments(value: Column, mark: str, where: Column) -> list[Column]:
    v = F.when(where, value)
    return [F.count(v).alias(f"n_{mark}"), F.avg(v).alias(f"m_{mark}"), F.var_samp(v).alias(f"v_{mark}")]


def cohen_d() -> Column:
    """Of moments n, m, v of a and b: the difference of means in pooled deviations."""
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0))
    return F.try_divide(F.col("m_a") - F.col("m_b"), F.nullif(F.sqrt(pooled), F.lit(0.0)))


def _long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "feature", "value").where("value is not null and not isnan(value) and abs(value) <> double('inf')")


def _erfc(z: Column) -> Column:
    """The complementary error function, to 1.2e-7 of itself, by Chebyshev's fit of Numerical Recipes."""
    t = 1 / (1 + 0.5 * z)
    series = functools.reduce(lambda acc, c: F.lit(c) + t * acc, (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368), F.lit(0.0))
    return t * F.exp(-z * z - 1.26551223 + t * series)


def average_rank(order: Column, *keys: str) -> Column:
    """Ranks from 1, ties sharing their mean."""
    by = W.partitionBy(*keys)
    return F.rank().over(by.orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, order)) - 1) / 2


def compare_groups(df: DataFrame, group: str, a: str, b: str, features: list[str], pair: str | None = None) -> DataFrame:
    """(feature, d, p): Cohen's d of group a against b, and the p value of Wilcoxon's test, by its normal approximation with continuity and tie corrections.

    With ``pair``, rows of both groups that agree in it are compared with one another: d is of their two groups, p of
    the signed ranks of their differences. Null for groups of less than two.
    """
    some = df.where(F.col(group).isin(a, b))
    x = _long(some, [group, *([pair] if pair else [])], features)
    if pair:
        wide = x.groupBy("feature", pair).agg(F.max(F.when(F.col(group) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(group) == b, F.col("value"))).alias("b")).where("a is not null and b is not null")
        # effsize's estimate for pairs: mean difference over the pooled deviation, as for groups
        one = wide.groupBy("feature").agg(*_moments(F.col("a"), "a", F.lit(True)), *_moments(F.col("b"), "b", F.lit(True)))
        gap = wide.select("feature", (F.col("a") - F.col("b")).alias("g")).where("g <> 0")
        ranked = gap.withColumns({"r": average_rank(F.abs("g"), "feature"), "ties": F.count(F.lit(1)).over(W.partitionBy("feature", F.abs("g")))})
        n = F.count(F.lit(1))
        w = F.coalesce(F.sum(F.when(F.col("g") > 0, F.col("r"))), F.lit(0.0))
        tests = ranked.groupBy("feature").agg((w - n * (n + 1) / 4).alias("z"), (n * (n + 1) * (2 * n + 1) / 24 - F.sum((F.col("ties") * F.col("ties") - 1) / 48)).alias("v"))
    else:
        one = x.groupBy("feature").agg(*_moments(F.col("value"), "a", F.col(group) == a), *_moments(F.col("value"), "b", F.col(group) == b))
        ranked = x.withColumns({"r": average_rank(F.col("value"), "feature"), "ties": F.count(F.lit(1)).over(W.partitionBy("feature", "value"))})
        na, nb = F.count_if(F.col(group) == a), F.count_if(F.col(group) == b)
        n = na + nb
        w = F.sum(F.when(F.col(group) == a, F.col("r"))) - na * (na + 1) / 2
        tests = ranked.groupBy("feature").agg((w - na * nb / 2).alias("z"), (na * nb / 12 * ((n + 1) - F.sum(F.col("ties") * F.col("ties") - 1) / F.nullif(n * (n - 1), F.lit(0)))).alias("v"))
    z = F.greatest(F.abs("z") - 0.5, F.lit(0.0)) / F.nullif(F.sqrt("v"), F.lit(0.0))
    p = F.least(_erfc(z / F.sqrt(F.lit(2.0))), F.lit(1.0))
    enough = F.col("n_a") >= 2
    return one.join(tests, "feature", "left").select("feature", F.when(enough, cohen_d()).alias("d"), F.when(enough, p).alias("p"))


def report_effects(df: DataFrame, label: str = "class", features: list[str] | None = None) -> DataFrame:
    """(feature, r, cohen_d, corr_length) of the columns *_per100w: correlation with the class (1 or 2), difference of the classes, correlation with word_count."""
    features = features or [c for c in df.columns if c.endswith("_per100w")]
    length = F.col("word_count").cast("double") if "word_count" in df.columns else F.lit(None).cast("double")
    x = _long(df.withColumns({"gw_class": F.col(label).cast("double"), "gw_length": length}), ["gw_class", "gw_length"], features)
    one = x.groupBy("feature").agg(_corr("value", "gw_class").alias("r"), _corr("value", "gw_length").alias("corr_length"), *_moments(F.col("value"), "a", F.col("gw_class") == 1), *_moments(F.col("value"), "b", F.col("gw_class") == 2))
    return one.select("feature", "r", cohen_d().alias("cohen_d"), "corr_length")


def _corr(a: str, b: str) -> Column:
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def auc(df: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """(keys, auc): the Mann-Whitney statistic, ties sharing their ranks; null without both labels."""
    x = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    # equal scores are counted first, so that ranks are of distinct scores
    cells = x.groupBy(*keys, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pos, n = F.sum("pos"), F.sum("n")
    ranks = cells.withColumn("rank", before + (F.col("n") + 1) / 2).groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), pos.alias("p"), n.alias("n"))
    return ranks.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def folds(df: DataFrame, key: str, strata: str | None = None, k: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``fold``, 0 to k - 1, by a hash of the seed, the stratum and the key: each stratum is spread over all folds, and no rows are brought together."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col(strata).cast("string") if strata else F.lit(""), F.col(key).cast("string"))
    return df.withColumn("fold", (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("int"))


def cross_validate(df: DataFrame, key: str, strata: str | None, fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame], k: int = 10, seed: int = 42) -> DataFrame:
    """The rows of ``predict`` for each fold, by what ``fit`` made of the others."""
    dealt = folds(df, key, strata, k, seed)
    parts = [predict(fit(dealt.where(F.col("fold") != i)), dealt.where(F.col("fold") == i)) for i in range(k)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def mrmr(df: DataFrame, features: list[str], target: str, top: int = 5) -> list[tuple[str, float]]:
    """Features by greatest relevance less mean redundancy, both as mutual information of a correlation, -ln(1 - r**2) / 2.

    All correlations come of one pass; the greedy choice is among ``features``, on the driver.
    """
    names = [*features, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    row = complete.agg(*[_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    import math

    information = lambda r: -0.5 * math.log(max(1e-12, 1 - (r or 0.0) ** 2))
    mi = {frozenset(p): information(row[i]) for i, p in enumerate(pairs)}
    chosen: list[tuple[str, float]] = []
    while len(chosen) < min(top, len(features)):
        left = [f for f in features if f not in {c for c, _ in chosen}]
        value = {f: mi[frozenset((f, target))] - sum(mi[frozenset((f, c))] for c, _ in chosen) / max(1, len(chosen)) for f in left}
        best = max(left, key=lambda f: (value[f], f))
        chosen.append((best, value[best]))
    return chosen


def lasso(df: DataFrame, features: list[str], target: str, penalty: float = 0.01) -> list[tuple[str, float]]:
    """Features with the coefficients of a logistic regression with an L1 penalty, greatest first."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("label")).dropna()
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty).fit(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return sorted(zip(features, model.coefficients.toArray().tolist()), key=lambda x: -abs(x[1]))


def rank_biserial(df: DataFrame, a: str, b: str) -> DataFrame:
    """(r_rb, n): of pairs in two columns, 1 - 2 W / (n (n + 1) / 2), W being the rank sum of the negative differences."""
    gap = df.select((F.col(a) - F.col(b)).alias("g")).where("g is not null and g <> 0").withColumn("one", F.lit(1))
    n = F.count(F.lit(1))
    w = F.coalesce(F.sum(F.when(F.col("g") < 0, F.col("r"))), F.lit(0.0))
    return gap.withColumn("r", average_rank(F.abs("g"), "one")).agg((1 - F.try_divide(2 * w, n * (n + 1) / 2)).alias("r_rb"), n.alias("n"))


#: Rows for the queries: documents with their labels, and grades that follow from the numbers.
_LABELLED = "WITH x AS (SELECT d.doc_id, d.source, d.n_chars, l.quality, l.toxic, 1 + d.doc_id % 5 AS grade, 1 + (d.doc_id * 7 + l.quality) % 5 AS guess, d.doc_id % 97 AS a, d.n_chars % 97 AS b FROM documents d JOIN labels l USING (doc_id))"
_D = "(avg(v) FILTER ({a}) - avg(v) FILTER ({b})) / nullif(sqrt(((count(v) FILTER ({a}) - 1) * var_samp(v) FILTER ({a}) + (count(v) FILTER ({b}) - 1) * var_samp(v) FILTER ({b})) / nullif(count(v) FILTER ({a}) + count(v) FILTER ({b}) - 2, 0)), 0)"
SQL = {
    "kappa": _LABELLED + """, g AS (SELECT 'code' || doc_id % 3 AS code, quality = 1 AS r1, toxic = 0 AS r2 FROM x WHERE quality IS NOT NULL AND toxic IS NOT NULL),
s AS (SELECT code, count(*) AS n, avg((r1 = r2)::INT) AS p_observed, avg(r1::INT) * avg(r2::INT) + avg((NOT r1)::INT) * avg((NOT r2)::INT) AS p_e FROM g GROUP BY code) SELECT code, round((p_observed - p_e) / nullif(1 - p_e, 0), 9) AS kappa, round(p_observed, 9) AS p_observed, n FROM s""",
    "weighted_kappa": _LABELLED + ", o AS (SELECT sum((grade - guess) ** 2 / 16) AS seen, count(*) AS n FROM x), e AS (SELECT sum((a.grade - b.guess) ** 2 / 16) AS chance FROM x a, x b) SELECT round(1 - seen / (chance / n), 9) AS qwk FROM o, e",
    "compare_groups": _LABELLED + ", l AS (SELECT quality, 'n_chars' AS feature, n_chars::DOUBLE AS v FROM x UNION ALL SELECT quality, 'grade', grade FROM x) SELECT feature, round(" + _D.format(a="quality = 1", b="quality = 0") + ", 9) AS d FROM l GROUP BY feature",
    "auc_rank": _LABELLED + ", p AS (SELECT n_chars AS v FROM x WHERE quality = 1), q AS (SELECT n_chars AS v FROM x WHERE quality = 0) SELECT round(avg(CASE WHEN p.v > q.v THEN 1.0 WHEN p.v = q.v THEN 0.5 ELSE 0 END), 9) AS auc FROM p, q",
    "folds": "SELECT doc_id, (('0x' || substr(md5('42:' || source || ':' || doc_id), 1, 8))::BIGINT % 10)::INT AS fold FROM documents",
    "rank_biserial": _LABELLED + ", g AS (SELECT a - b AS g FROM x WHERE a <> b), r AS (SELECT g, rank() OVER (ORDER BY abs(g)) + (count(*) OVER (PARTITION BY abs(g)) - 1) / 2 AS r FROM g) SELECT round(1 - 2 * coalesce(sum(r) FILTER (g < 0), 0) / (count(*) * (count(*) + 1) / 2), 9) AS r_rb, count(*) AS n FROM r",
}
