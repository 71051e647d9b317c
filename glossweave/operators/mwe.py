"""Multi-word expressions: sequences of tokens that a lexicon lists, and how dense connectives are."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import PROLOGUE


def match_sequences(tokens: DataFrame, lexicon: DataFrame, token: str = "lower_token", cat_to_upos: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, sentence_id, token_id_start, token_id_end, matched_forme, and the lexicon's other columns) of every match.

    The lexicon has forme_lower, words joined by single blanks. Tokens without a number of their own are left out
    before sequences are made; matches may overlap, none crosses a sentence, and an entry that is listed twice matches
    twice. With ``cat_to_upos`` the first token must have the tag that the entry's ``cat`` stands for; other cats pass.

    A token probes only with sequences as long as some entry that begins with it.
    """
    lex = lexicon.withColumns({"gw_words": F.split("forme_lower", " +")}).withColumns({"gw_n": F.size("gw_words"), "gw_first": F.element_at("gw_words", 1)})
    longest = lex.agg(F.max("gw_n")).first()[0] or 0
    if not longest:
        others = "".join(f", {c} {t}" for c, t in lexicon.dtypes if c != "forme_lower")
        return tokens.sparkSession.createDataFrame([], "doc_id string, sentence_id int, token_id_start string, token_id_end string, matched_forme string" + others)
    by = W.partitionBy("doc_id", "sentence_id").orderBy("gw_id")
    t = tokens.withColumn("gw_id", F.expr("try_cast(token_id AS INT)")).where("gw_id is not null")
    ahead = by.rowsBetween(0, longest - 1)
    t = t.select("doc_id", "sentence_id", F.col("token_id").alias("token_id_start"), F.col("upos").alias("gw_upos"), F.col(token).alias("gw_first"), F.collect_list(F.struct(F.coalesce(token, F.lit("")).alias("w"), "token_id")).over(ahead).alias("gw_ahead"))
    lengths = lex.groupBy("gw_first").agg(F.collect_set("gw_n").alias("gw_lengths"))
    probes = t.join(F.broadcast(lengths) if longest else lengths, "gw_first").select("*", F.explode("gw_lengths").alias("gw_n")).where(F.size("gw_ahead") >= F.col("gw_n"))
    probes = probes.withColumns({"matched_forme": F.array_join(F.slice(F.col("gw_ahead.w"), 1, F.col("gw_n")), " "), "token_id_end": F.element_at("gw_ahead", F.col("gw_n")).getField("token_id")})
    entries = lex.select(F.array_join("gw_words", " ").alias("matched_forme"), *[c for c in lexicon.columns if c != "forme_lower"])
    found = probes.join(entries, "matched_forme")
    if cat_to_upos:
        wanted = functools.reduce(lambda a, kv: F.when(F.col("cat") == kv[0], kv[1]).otherwise(a), cat_to_upos.items(), F.lit(None).cast("string"))
        found = found.where(wanted.isNull() | (F.col("gw_upos") == wanted))
    return found.select("doc_id", "sentence_id", "token_id_start", "token_id_end", "matched_forme", *[c for c in entries.columns if c != "matched_forme"])


def connective_density(tokens: DataFrame, matches: DataFrame, groups: list[str] | None = None, cats: list[str] | None = None) -> DataFrame:
    """word_count, n_connectives and counts by relation_group and cat (cat_<name>) of each document, each also per 100 words.

    A place counts once however many entries match there, once a group, and once a cat. Without ``groups`` or ``cats``
    those that occur are columns.
    """
    keys = ["doc_id", "sentence_id", "token_id_start"]
    words = tokens.where("compte").groupBy("doc_id").agg(F.count(F.lit(1)).alias("word_count"))
    parts = [matches.select(*keys).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_connectives"))]
    for column, mark, values in (("relation_group", "", groups), ("cat", "cat_", cats)):
        if column in matches.columns:
            each = matches.select(*keys, column).distinct().withColumn(column, F.concat(F.lit(mark), column))
            pivoted = each.groupBy("doc_id").pivot(column, [mark + v for v in values] if values else None)
            parts.append(pivoted.agg(F.count(F.lit(1))))
    out = functools.reduce(lambda a, b: a.join(b, "doc_id", "left"), [words, *parts])
    counts = [c for c in out.columns if c not in ("doc_id", "word_count")]
    out = out.fillna(0, counts)
    return out.select("*", *[(F.col(f"`{c}`") / F.col("word_count") * 100).alias(f"{c}_per100w") for c in counts])


#: The lexicon of the queries: words of the annotator's closed lists, alone and in pairs.
ENTRIES = [(a, "one", "cat_a") for a in ("and", "et", "und", "y", "but", "mais")] + [(f"{a} {b}", "two", "cat_b") for a in ("of", "de", "in", "en", "to", "von") for b in ("the", "la", "le", "der", "los", "a")] + [("of the", "three", "cat_a"), ("and of the", "three", "cat_b")]
GROUPS, CATS = ["one", "two", "three"], ["cat_a", "cat_b"]
_LEX = ", lex(forme, relation_group, cat) AS (VALUES " + ", ".join(f"('{f}', '{g}', '{c}')" for f, g, c in ENTRIES) + ")"
_N = ", n AS (SELECT *, lead(lower_token, 1) OVER s AS w2, lead(lower_token, 2) OVER s AS w3, lead(token_id, 1) OVER s AS t2, lead(token_id, 2) OVER s AS t3 FROM tokens WINDOW s AS (PARTITION BY doc_id, sentence_id ORDER BY term_id))"
_ALL = """, grams AS (SELECT doc_id, sentence_id, token_id AS token_id_start, token_id AS token_id_end, lower_token AS g FROM n UNION ALL SELECT doc_id, sentence_id, token_id, t2, lower_token || ' ' || w2 FROM n WHERE t2 IS NOT NULL
  UNION ALL SELECT doc_id, sentence_id, token_id, t3, lower_token || ' ' || w2 || ' ' || w3 FROM n WHERE t3 IS NOT NULL),
found AS MATERIALIZED (SELECT doc_id, sentence_id, token_id_start, token_id_end, forme AS matched_forme, relation_group, cat FROM grams JOIN lex ON forme = g)"""
_COUNTS = {"n_connectives": "TRUE", **{g: f"relation_group = '{g}'" for g in GROUPS}, **{f"cat_{c}": f"cat = '{c}'" for c in CATS}}
SQL = {
    "match_sequences": PROLOGUE + _LEX + _N + _ALL + " SELECT * FROM found",
    "connective_density": PROLOGUE + _LEX + _N + _ALL + ", w AS (SELECT doc_id, count(*) AS word_count FROM tokens WHERE compte GROUP BY doc_id), f AS (SELECT doc_id, " + ", ".join(f"count(DISTINCT sentence_id || '-' || token_id_start) FILTER ({e}) AS {n}" for n, e in _COUNTS.items())
    + " FROM found GROUP BY doc_id) SELECT doc_id, word_count, " + ", ".join(f"coalesce({n}, 0) AS {n}, round(coalesce({n}, 0) / word_count * 100, 9) AS {n}_per100w" for n in _COUNTS) + " FROM w LEFT JOIN f USING (doc_id)",
}
