"""Operator 9: URL filters by association rules.

The tokens of a labelled page's URL are the items of a transaction, and "bad" is one more item where its label says
so. Spark's FP-growth (Han et al. 2000; in parallel, Li et al. 2008) mines the token combinations that are frequent; the rules
"combination => bad" are kept that have the confidence and the support asked for, and no rule with part of their tokens
does as well. A URL is blocked by the first rule all of whose tokens it has. Rules are found by an inverted index: each is
filed under its rarest token, so that a URL meets only the rules of the tokens that it has.

Tokens that stand on just the same labelled pages, such as those of a URL that is there a thousand times, would bring
about all of their subsets, two to the power of their number. They are mined as one item, and the rules that come of
it are then written out with each of them: the subsets left out are those that the last condition drops anyway.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, stored, table

#: A rule holds for this share of the labelled pages that have its tokens, and for so many pages, and this share of all.
CONFIDENCE, SUPPORT_ROWS, SUPPORT = 0.5, 5, 0.0002
#: Likelihood ratio (G squared) of a combination and the label that mine_rules can ask for besides: among so many
#: combinations some are pure by chance. The query doesn't ask for it.
EVIDENCE = 24.0


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL in lower case: h: before those of the host, p: of the path, q: of the query and fragment."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    path = F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(bare, r"^[^?#]*(.*)$", 1)

    def parts(column: Column, mark: str) -> Column:
        split = F.filter(F.split(column, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), lambda x: x != "")
        return F.transform(split, lambda x: F.concat(F.lit(mark), F.when(x.rlike("^[0-9]+$"), F.lit("<n>")).otherwise(x)))

    tokens = F.array_distinct(F.concat(parts(host, "h:"), parts(path, "p:"), parts(rest, "q:")))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def _evidence(both: Column, tokens: Column, bad: int, n: int) -> Column:
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    good, others = n - bad, F.lit(n) - tokens
    return 2 * (part(both, tokens * bad / n) + part(tokens - both, tokens * good / n) + part(F.lit(bad) - both, others * bad / n) + part(F.lit(good) - tokens + both, others * good / n))


def mine_rules(pages: DataFrame, labels: DataFrame, confidence: float = CONFIDENCE, support: float = SUPPORT, support_rows: int = SUPPORT_ROWS, evidence: float = EVIDENCE) -> DataFrame:
    """(rule_id, tokens, rows, confidence) from pages (page_id, url) and labels (page_id, bad boolean).

    A page without a label, or with a null one, takes no part, nor does one whose URL is null or has no token; of several
    labels of a page the worst counts; a page that is there twice counts twice. Very long URLs are taken whole. Of rules
    that hold alike none is preferred: all are kept. Without a bad page, or on empty tables, there are no rules. With
    ``evidence`` above 0 a rule also needs that much, and more confidence than the share of bad pages; at 0, confidence
    and support decide alone.
    """
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("gw_bad"))
    rows = pages.select("page_id", url_tokens(F.col("url")).alias("gw_tokens")).join(known, "page_id")
    items = stored(rows.where(F.size("gw_tokens") > 0).select(F.monotonically_increasing_id().alias("gw_row"), "gw_bad", F.col("gw_tokens").alias("items")))
    counts = items.agg(F.count(F.lit(1)).alias("n"), F.count_if("gw_bad").alias("bad")).first()
    empty = "rule_id long, tokens array<string>, rows long, confidence double"
    if not counts.bad:
        return pages.sparkSession.createDataFrame([], empty)
    least = max(support_rows, support * counts.n)
    merged, classes = _merged(items)
    # a rule is a combination that is frequent among the bad pages: the others don't have to be mined
    bad = merged.where("gw_bad").select("items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / counts.bad), minConfidence=1.0).fit(bad)
    frequent = stored(model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("rows")))
    # all pages that have a combination's tokens, by way of the token that fewest pages have
    matched = _match(merged.select("gw_row", F.col("items").alias("gw_tokens")), frequent, "gw_row", "gw_tokens")
    with_all = frequent.join(matched.groupBy("tokens").agg(F.count(F.lit(1)).alias("all")), "tokens")
    holds = F.col("confidence") >= confidence
    if evidence > 0:
        holds &= (F.col("confidence") > counts.bad / counts.n) & (_evidence(F.col("rows"), F.col("all"), counts.bad, counts.n) >= evidence)
    good = stored(with_all.withColumn("confidence", F.col("rows") / F.col("all")).where(holds).select("tokens", "rows", "confidence"))
    # part of a rule that holds as well makes the rest of it superfluous
    parts = good.select(F.col("tokens").alias("short"), F.col("confidence").alias("short_confidence"))
    within = F.size(F.array_except("short", "tokens")) == 0
    wider = good.select(F.explode("tokens").alias("gw_first"), "tokens", "confidence").join(parts.withColumn("gw_first", F.element_at("short", 1)), "gw_first")
    redundant = wider.where(within & (F.size("short") < F.size("tokens")) & (F.col("short_confidence") >= F.col("confidence"))).select("tokens").distinct()
    rules = _written_out(good.join(redundant, "tokens", "left_anti"), classes)
    return stored(rules.select(F.xxhash64(F.array_join("tokens", " ")).alias("rule_id"), "tokens", "rows", "confidence"))


def _merged(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (gw_row, gw_bad, items) with one item for all tokens of the same rows, and (item, members) of those that stand for several."""
    each = items.select("gw_row", "gw_bad", F.explode("items").alias("token"))
    # two sums of hashes over the rows tell sets of rows apart
    sums = [F.sum(F.xxhash64(F.lit(i), "gw_row").cast("decimal(38,0)")) for i in (1, 2)]
    named = stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), sums[0].alias("a"), sums[1].alias("b")))
    classes = stored(named.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.element_at("members", 1).alias("item"), "members"))
    several = classes.where(F.size("members") > 1)
    dropped = several.select(F.explode(F.slice("members", 2, F.size("members") - 1)).alias("token"))
    left = each.join(dropped, "token", "left_anti").groupBy("gw_row", "gw_bad").agg(F.array_sort(F.collect_list("token")).alias("items"))
    return stored(left), several


def _written_out(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Each rule with each choice of one member for each of its items."""
    each = rules.select("tokens", F.explode("tokens").alias("item")).join(classes, "item", "left")
    choices = each.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("item", F.coalesce("members", F.array("item")).alias("members")))).getField("members").alias("choices"))
    grown = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda made, members: F.flatten(F.transform(made, lambda x: F.transform(members, lambda m: F.array_append(x, m)))))
    out = rules.join(choices.select("tokens", grown.alias("made")), "tokens").select(F.explode("made").alias("made"), "rows", "confidence")
    return out.select(F.array_sort("made").alias("tokens"), "rows", "confidence")


def _match(urls: DataFrame, rules: DataFrame, key: str, tokens: str) -> DataFrame:
    """The columns of urls and rules for each rule all of whose tokens a URL has. tokens of a rule are distinct."""
    each = urls.select(F.explode(tokens).alias("gw_token"))
    often = each.join(rules.select(F.explode("tokens").alias("gw_token")).distinct(), "gw_token", "left_semi").groupBy("gw_token").agg(F.count(F.lit(1)).alias("gw_n"))
    ranked = rules.select("tokens", F.explode("tokens").alias("gw_token")).join(often, "gw_token", "left")
    rarest = ranked.groupBy("tokens").agg(F.min_by("gw_token", F.struct(F.coalesce("gw_n", F.lit(0)), F.col("gw_token"))).alias("gw_token"))
    index = rules.join(rarest, "tokens")
    probes = urls.select(key, tokens, F.explode(tokens).alias("gw_token"))
    return probes.join(index, "gw_token").where(F.size(F.array_except("tokens", tokens)) == 0).drop("gw_token")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row of pages (page_id, url) as (page_id, url, blocked, rule_id, rule, confidence).

    Of several rules the one of the highest confidence is named, of these the one for more pages, then the one of the
    least id. A null or empty URL has no tokens and isn't blocked. Rows of the same URL fare alike. An empty table gives an
    empty result. Other columns, whatever their names, have no effect.
    """
    urls = pages.select("url").where("url is not null").distinct().select(F.col("url").alias("gw_url"), url_tokens(F.col("url")).alias("gw_tokens"))
    best = F.min_by(F.struct("rule_id", "tokens", "confidence"), F.struct(-F.col("confidence"), -F.col("rows"), F.col("rule_id")))
    verdict = _match(urls, rules, "gw_url", "gw_tokens").groupBy("gw_url").agg(best.alias("gw_best"))
    out = pages.select("page_id", "url").join(verdict, F.col("url") == F.col("gw_url"), "left")
    return out.select("page_id", "url", F.col("gw_best").isNotNull().alias("blocked"), F.col("gw_best.rule_id").alias("rule_id"), F.array_join("gw_best.tokens", " ").alias("rule"), F.col("gw_best.confidence").alias("confidence"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad when the document of its number is labelled as of low quality or toxic: the only labels there are."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, mine_rules(pages, labels, evidence=0.0))
