"""Prompts for language models and what is read out of their responses; scores of subwords as those of words."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTROPY_MODES = ("onset", "mean", "sum", "offset", "none")


def fill_template(template: str, columns: list[str]) -> Column:
    """The template with each {column} replaced by the row's value; a tag that isn't among ``columns`` is an error."""
    unknown = set(re.findall(r"\{(\w+)\}", template)) - set(columns)
    if unknown:
        raise ValueError(f"the template names {sorted(unknown)}, which aren't columns")
    tagged = [c for c in columns if "{" + c + "}" in template]
    return functools.reduce(lambda text, c: F.replace(text, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("NA"))), tagged, F.lit(template))


def parse_numbered_list(response: Column, n: int = 4) -> Column:
    """An array of the first lines numbered 1 to n ("2.", "2)", "**2:**"), without the number; null where there is none, and all null for a null response."""
    lines = F.coalesce(F.split(response, "\n"), F.array().cast("array<string>"))

    def item(k: int) -> Column:
        pattern = rf"^\s*\*{{0,2}}{k}[.):]+\*{{0,2}} *"
        return F.try_element_at(F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.trim(F.regexp_replace(x, pattern, ""))), F.lit(1))

    return F.array(*[item(k) for k in range(1, n + 1)])


def code_prompt(name: Column, definition: Column, passage: Column) -> Column:
    """The question whether a category applies to a passage, to be answered with reasons and one line of JSON."""
    ask = "Give one or two sentences of reasons for or against. End with one line of JSON, {\"applies\": true or false, \"rationale\": \"...\"}."
    return F.concat(F.lit("Category: "), name, F.lit("\nDefinition: "), definition, F.lit("\n\nPassage:\n"), passage, F.lit("\n\n" + ask))


def parse_code_response(raw: Column) -> Column:
    """struct(applies, rationale) from the first {...} of a response.

    applies is null where there is none, or where it isn't JSON with that key, and the rationale then the response;
    else it is true only for the literal true.
    """
    found = F.nullif(F.regexp_extract(raw, r"\{[^}]+\}", 0), F.lit(""))
    read = F.from_json(found, "applies string, rationale string")
    has = read.getField("applies").isNotNull()
    literal = found.rlike(r'"applies"\s*:\s*true\b')
    return F.struct(F.when(has, literal).alias("applies"), F.when(has, F.coalesce(read.getField("rationale"), F.lit(""))).when(found.isNull(), F.trim(raw)).otherwise(raw).alias("rationale"))


def ask(prompts: DataFrame, respond: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Adds response and error. ``respond`` runs on the executors, row by row; what it raises becomes the row's error."""

    @F.arrow_udf("struct<response:string,error:string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append({"response": respond(t), "error": None})
            except Exception as e:  # noqa: BLE001
                out.append({"response": None, "error": str(e)})
        return pa.array(out, pa.struct([("response", pa.string()), ("error", pa.string())]))

    return prompts.withColumn("gw_said", run(prompt)).select(*prompts.columns, "gw_said.response", "gw_said.error")


def unanswered(prompts: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The prompts that a sink has no answer for yet: what a run that was broken off goes on with."""
    return prompts.join(answers.where("error is null").select(key), key, "left_anti")


def code_corpus(passages: DataFrame, codebook: DataFrame, respond: Callable[[str], str]) -> DataFrame:
    """(passage_id, code, applies, rationale, error) for each passage and each of the codebook's few codes (code, definition)."""
    pairs = passages.crossJoin(F.broadcast(codebook)).withColumn("prompt", code_prompt(F.col("code"), F.col("definition"), F.col("text")))
    said = ask(pairs, respond).withColumn("x", parse_code_response(F.col("response")))
    return said.select("passage_id", "code", "x.applies", "x.rationale", "error")


def aggregate_to_words(pieces: DataFrame, keys: list[str], entropy: str = "onset", place: str = "piece") -> DataFrame:
    """(keys, surprisal, entropy, n_pieces) of words from their pieces' surprisal and entropy.

    Surprisals add up. The entropy is that of the first piece (onset), the last (offset), their mean or sum, or null
    (none). A word with a piece of null or NaN surprisal has neither, nor has, but for none, one with such an entropy.
    """
    if entropy not in ENTROPY_MODES:
        raise ValueError(f"unknown entropy {entropy!r}, not one of {ENTROPY_MODES}")
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    s, e = value("surprisal"), value("entropy")
    how = {"onset": F.min_by(e, place), "offset": F.max_by(e, place), "mean": F.avg(e), "sum": F.sum(e), "none": F.lit(None).cast("double")}[entropy]
    n = F.count(F.lit(1))
    whole = (F.count(s) == n) & ((F.count(e) == n) if entropy != "none" else F.lit(True))
    return pieces.groupBy(*keys).agg(F.when(whole, F.sum(s)).alias("surprisal"), F.when(whole, how).alias("entropy"), n.alias("n_pieces"))


#: Rows for the queries, out of the documents.
RESPONSE = "concat('Sure:', chr(10), '1. ', source, chr(10), ' **2)** ', lang, ' x', chr(10), CASE WHEN doc_id % 3 = 0 THEN '3: none' ELSE 'three' END, chr(10), '1. again')"
CODE_RESPONSE = """CASE doc_id % 5 WHEN 0 THEN concat('It does. {"applies": true, "rationale": "', lang, '"}') WHEN 1 THEN 'No. {"applies": false, "rationale": "off"} {"applies": true}' WHEN 2 THEN ' no json ' WHEN 3 THEN '{"applies": "yes"}' ELSE '{broken json}' END"""
_PIECES = "SELECT doc_id, sentence_id, term_id, piece, CASE WHEN (term_id + piece) % 13 <> 0 THEN length(substr(token, 4 * piece + 1, 4)) * 0.5::DOUBLE END AS surprisal, CASE WHEN (term_id * 3 + piece) % 17 <> 0 THEN (piece + 1) / 4.0::DOUBLE END AS entropy FROM tokens, unnest(range(0, ((length(token) + 3) // 4)::INT)) p(piece)"


def pieces_of(tokens: DataFrame) -> DataFrame:
    t = tokens.select("doc_id", "sentence_id", "term_id", "token", F.explode(F.expr("sequence(0, cast(floor((length(token) + 3) / 4) AS INT) - 1)")).alias("piece"))
    return t.select("doc_id", "sentence_id", "term_id", "piece", F.expr("CASE WHEN (term_id + piece) % 13 <> 0 THEN length(substr(token, 4 * piece + 1, 4)) * 0.5D END AS surprisal"), F.expr("CASE WHEN (term_id * 3 + piece) % 17 <> 0 THEN (piece + 1) / 4.0D END AS entropy"))


def words_sql(prologue: str, entropy: str) -> str:
    how = {"onset": "arg_min(entropy, piece)", "offset": "arg_max(entropy, piece)", "mean": "avg(entropy)", "sum": "sum(entropy)", "none": "NULL::DOUBLE"}[entropy]
    whole = "count(surprisal) = count(*)" + ("" if entropy == "none" else " AND count(entropy) = count(*)")
    return prologue + f", subwords AS ({_PIECES}) SELECT doc_id, sentence_id, term_id, CASE WHEN {whole} THEN sum(surprisal) END AS surprisal, CASE WHEN {whole} THEN {how} END AS entropy, count(*) AS n_pieces FROM subwords GROUP BY ALL"


_LINE = lambda k: rf"trim(regexp_replace(list_filter(l, lambda x: regexp_matches(x, '^\s*\*{{0,2}}{k}[.):]+\*{{0,2}} *'))[1], '^\s*\*{{0,2}}{k}[.):]+\*{{0,2}} *', ''))"
SQL = {
    "numbered_list_parse": f"WITH r AS (SELECT doc_id, string_split({RESPONSE}, chr(10)) AS l FROM documents) SELECT doc_id, " + ", ".join(f"{_LINE(k)} AS item_{k}" for k in (1, 2, 3, 4)) + " FROM r",
    "code_response_parse": f"WITH r AS (SELECT doc_id, {CODE_RESPONSE} AS raw FROM documents), f AS (SELECT *, regexp_extract(raw, '\\{{[^}}]+\\}}') AS j FROM r), v AS (SELECT *, CASE WHEN json_valid(j) THEN j END AS ok FROM f)"
    " SELECT doc_id, CASE WHEN (ok->'applies') IS NOT NULL THEN (ok->'applies')::VARCHAR = 'true' END AS applies, CASE WHEN (ok->'applies') IS NOT NULL THEN coalesce(ok->>'rationale', '') WHEN j = '' THEN trim(raw) ELSE raw END AS rationale FROM v",
    "template_fill": "SELECT doc_id, 'Document ' || doc_id || ' (' || lang || ') from ' || source || ': ' || doc_id AS prompt FROM documents",
}
