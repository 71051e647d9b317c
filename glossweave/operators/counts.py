"""Surface counts of documents: words, tags, tenses, sentence lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import PROLOGUE, UPOS_TAGS, sql_list

COUNT_CONTENT = ("NOUN", "VERB", "ADJ", "ADV", "PRON")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def simple_counts(tokens: DataFrame, content: tuple[str, ...] = COUNT_CONTENT) -> DataFrame:
    """Words, sentences, characters and their ratios of each document.

    Punctuation, and tokens without a tag such as the range row of a contraction, aren't words. The length of content
    words relates the characters of all words to the number of content words. Words are told apart as they are written
    (``post_process`` lowers their case). Without a column paragraph_id paragraph_count is null.
    """
    word = F.col("compte") & (F.col("upos") != "PUNCT")
    lexical = F.col("compte") & F.col("upos").isin(*content)
    lettered = F.col("compte") & ~F.col("upos").isin("PUNCT", "PART")
    counted = tokens.groupBy("doc_id").agg(
        count_where(word).alias("word_count"),
        F.countDistinct(F.when(word, F.col("token"))).alias("unique_word_count"),
        count_where(lexical).alias("content_word_count"),
        F.countDistinct(F.when(lexical, F.col("token"))).alias("unique_content_word_count"),
        F.countDistinct("sentence_id").alias("sentence_count"),
        (F.countDistinct("paragraph_id") if "paragraph_id" in tokens.columns else F.lit(None).cast("long")).alias("paragraph_count"),
        F.coalesce(F.sum(F.when(lettered, F.length("token"))), F.lit(0)).cast("long").alias("char_count"),
        F.coalesce(F.sum(F.when(lexical, F.length("token"))), F.lit(0)).cast("long").alias("char_count_content"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    return counted.withColumns({"avg_word_length": ratio("char_count", "word_count"), "avg_sentence_length": ratio("word_count", "sentence_count"), "avg_content_word_length": ratio("char_count", "content_word_count")})


def upos_distribution(tokens: DataFrame) -> DataFrame:
    """count_<tag> of each document, and prop_<tag> of all of its rows, for the seventeen universal tags."""
    n = F.count(F.lit(1))
    of = {t: count_where(F.col("upos") == t) for t in UPOS_TAGS}
    return tokens.groupBy("doc_id").agg(*[c.alias(f"count_{t}") for t, c in of.items()], *[(c / n).alias(f"prop_{t}") for t, c in of.items()])


TENSES = {
    "present_count": ("Tense=Pres",),
    "past_count": ("Tense=Past",),
    "future_count": ("Tense=Fut",),
    "conditional_count": ("Mood=Cnd",),
    "subjunctive_count": ("Mood=Sub",),
    "indicative_count": ("Mood=Ind",),
    "imperative_count": ("Mood=Imp",),
    "infinitive_count": ("VerbForm=Inf",),
    "past_participle_count": ("VerbForm=Part", "Tense=Past"),
    "present_participle_count": ("VerbForm=Part", "Tense=Pres"),
    "past_simple_count": ("Tense=Past", "Mood=Ind", "VerbForm=Fin"),
}


def verb_tenses(tokens: DataFrame) -> DataFrame:
    """Counts of tenses and moods, and their share of the document's words."""

    def has(parts: tuple[str, ...]) -> Column:
        found = F.col("feats").contains(parts[0])
        for p in parts[1:]:
            found = found & F.col("feats").contains(p)
        return found

    word = F.col("compte") & (F.col("upos") != "PUNCT")
    counted = tokens.groupBy("doc_id").agg(count_where(word).alias("word_count"), *[count_where(has(p)).alias(n) for n, p in TENSES.items()])
    shares = [F.try_divide(F.col(n), F.nullif("word_count", F.lit(0))).alias(n.replace("_count", "_prop")) for n in TENSES]
    return counted.select("doc_id", *TENSES, *shares)


def sentence_length_variability(tokens: DataFrame) -> DataFrame:
    """Spread of the sentence lengths of a document: deviation, relative to the mean, from one to the next, and their correlation."""
    lengths = tokens.where("compte").groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"))
    with_last = lengths.withColumn("last", F.lag("n").over(W.partitionBy("doc_id").orderBy("sentence_id")))
    return with_last.groupBy("doc_id").agg(
        F.stddev_samp("n").alias("sent_length_sd"),
        (F.stddev_samp("n") / F.avg("n")).alias("sent_length_cv"),
        F.avg(F.abs(F.col("n") - F.col("last"))).alias("sent_length_delta"),
        F.when(F.count(F.lit(1)) > 2, F.try_divide(F.covar_pop("n", "last"), F.stddev_pop(F.when(F.col("last").isNotNull(), F.col("n"))) * F.stddev_pop("last"))).alias("sent_length_autocor"),
    )


_W, _L = "compte AND upos <> 'PUNCT'", f"compte AND upos IN {sql_list(COUNT_CONTENT)}"
SQL = {
    "doc_counts": PROLOGUE
    + f""", c AS (SELECT doc_id, count(*) FILTER ({_W}) AS word_count, count(DISTINCT CASE WHEN {_W} THEN token END) AS unique_word_count,
  count(*) FILTER ({_L}) AS content_word_count, count(DISTINCT CASE WHEN {_L} THEN token END) AS unique_content_word_count,
  count(DISTINCT sentence_id) AS sentence_count, count(DISTINCT paragraph_id) AS paragraph_count,
  coalesce(sum(length(token)) FILTER (compte AND upos NOT IN ('PUNCT', 'PART')), 0)::BIGINT AS char_count,
  coalesce(sum(length(token)) FILTER ({_L}), 0)::BIGINT AS char_count_content FROM tokens GROUP BY doc_id)
SELECT *, char_count / nullif(word_count, 0) AS avg_word_length, word_count / nullif(sentence_count, 0) AS avg_sentence_length,
  char_count / nullif(content_word_count, 0) AS avg_content_word_length FROM c""",
    "upos_distribution": PROLOGUE
    + "SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (upos = '{t}') AS count_{t}, count(*) FILTER (upos = '{t}') / count(*) AS prop_{t}" for t in UPOS_TAGS)
    + " FROM tokens GROUP BY doc_id",
    "verb_tenses": PROLOGUE
    + ", c AS (SELECT doc_id, "
    + ", ".join("count(*) FILTER (" + " AND ".join(f"contains(feats, '{x}')" for x in p) + f") AS {n}" for n, p in TENSES.items())
    + f", count(*) FILTER ({_W}) AS words FROM tokens GROUP BY doc_id) SELECT doc_id, "
    + ", ".join(f"{n}, {n} / nullif(words, 0) AS {n.replace('_count', '_prop')}" for n in TENSES)
    + " FROM c",
    "sentence_length_variability": PROLOGUE
    + """, l AS (SELECT doc_id, sentence_id, count(*) AS n FROM tokens WHERE compte GROUP BY ALL),
  w AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY sentence_id) AS last FROM l)
SELECT doc_id, stddev_samp(n) AS sent_length_sd, stddev_samp(n) / avg(n) AS sent_length_cv, avg(abs(n - last)) AS sent_length_delta,
  CASE WHEN count(*) > 2 AND stddev_pop(n) FILTER (last IS NOT NULL) > 0 AND stddev_pop(last) > 0 THEN corr(n, last) END AS sent_length_autocor
FROM w GROUP BY doc_id""",
}
