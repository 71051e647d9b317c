"""Raw text: files to (doc_id, text), cleaned, and sentences out of them."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a sentence ends: white space after a stop and before a capital.
BREAK = r"(?<=[.!?])\s+(?=\p{Lu})"
CHARSETS = ("utf-8", "cp1252", "latin-1")


def clean_text(text: Column) -> Column:
    """One line a paragraph, French quotation marks, and blanks where punctuation wants them, in a fixed order of replacements."""
    for pattern, by in (
        (r"\\", ""), (r"\r?\n(?=[^\r\n])", " "), (r"(\r?\n)\s+", "$1"), (r"\r", ""), (r"\n{3,}", "\n\n"), ("<<", "«"), (">>", "»"), ("’", "'"), ("''", "'"), ("«", " « "), ("»", " » "), ("!", "! "), (";", " ; "), (":", " : "),
        (r"\.(?=\s*[A-Z0-9ÀÉÈÙ])", ". "), (r",(?=[A-Za-zÀÉÈÙ0-9])", ", "), (r"\)(?=[A-Za-zÀÉÈÙ0-9])", ") "), (r" {3,}", "  "), (r" {2}", " "),
    ):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    return text


def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def utf8_normalize(text: Column, map_quotes: bool = True) -> Column:
    """Canonical composition, and curly quotes as straight ones."""
    composed = F.arrow_udf(_composed, "string")(text)
    return F.translate(composed, "‘’‚‛“”„‟", "''''\"\"\"\"") if map_quotes else composed


def _guessed(contents: pa.Array) -> pa.Array:
    out = []
    for raw in contents.to_pylist():
        found = {"text": None, "charset": None}
        for charset in CHARSETS if raw is not None else ():
            try:
                found = {"text": raw.decode(charset), "charset": charset}
                break
            except UnicodeDecodeError:
                continue
        out.append(found)
    return pa.array(out, pa.struct([("text", pa.string()), ("charset", pa.string())]))


def build_corpus(spark: SparkSession, path: str, clean: bool = True, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """(doc_id, text, charset) of a file or of a folder's files, doc_id being the file's name.

    With ``encoding`` "auto" each file is read as the first of ``CHARSETS`` that fits. Two files of one name are an error,
    for which names alone are counted.
    """
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    named = files.withColumn("doc_id", F.element_at(F.split("path", "/"), -1))
    twice = named.groupBy("doc_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"more than one file of the name {[r.doc_id for r in twice]}")
    if encoding == "auto":
        decoded = named.withColumn("x", F.arrow_udf(_guessed, "struct<text:string,charset:string>")("content")).select("doc_id", F.col("x.text").alias("text"), F.col("x.charset").alias("charset"))
    else:
        decoded = named.select("doc_id", F.decode("content", encoding).alias("text"), F.lit(encoding).alias("charset"))
    text = utf8_normalize(F.col("text"))
    return decoded.withColumn("text", clean_text(text) if clean else text)


def replaced_characters(corpus: DataFrame) -> DataFrame:
    """(doc_id, n): texts that hold the mark of bytes that couldn't be decoded."""
    return corpus.select("doc_id", F.regexp_count("text", F.lit("\ufffd")).alias("n")).where("n > 0")


def read_paired_tsv(spark: SparkSession, path: str, which: str = "both") -> DataFrame:
    """(doc_id, text) of lines id, hard text, id, easy text between tabs; texts may hold tabs, so lines are cut at the ids.

    ``which`` is hard, easy or both. Lines of another form, such as the header, are left out.
    """
    if which not in ("both", "hard", "easy"):
        raise ValueError("which is both, hard or easy")
    pattern = r"^(wiki_[^\t]+)\t(.*)\t(viki_[^\t]+)\t(.*)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    sides = {"hard": lines.select(part(1).alias("doc_id"), part(2).alias("text")), "easy": lines.select(part(3).alias("doc_id"), part(4).alias("text"))}
    return sides["hard"].unionByName(sides["easy"]) if which == "both" else sides[which]


def split_sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, BREAK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def count_words(text: Column) -> Column:
    """Runs of letters."""
    return F.regexp_count(text, F.lit(r"[A-Za-zÀ-ɏ]+"))


def sentence_table(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, sentence) of (doc_id, text); a text's line ends count as blanks."""
    flat = F.regexp_replace("text", r"\r?\n", " ")
    return docs.select("doc_id", F.posexplode(split_sentences(flat)).alias("at", "sentence")).select("doc_id", (F.col("at") + 1).alias("sentence_id"), "sentence")


def read_sentences(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """(doc_id, sentence_id, sentence) of one file."""
    return sentence_table(spark.read.text(path, wholetext=True).select(F.lit(doc_id).alias("doc_id"), F.col("value").alias("text")))


def whitespace_tokens(sentences: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, token_index, token) of a sentence table, cut at white space."""
    return sentences.select("doc_id", "sentence_id", F.posexplode(F.filter(F.split("sentence", r"\s+"), lambda x: x != "")).alias("at", "token")).select("doc_id", "sentence_id", (F.col("at") + 1).alias("token_index"), "token")


def write_tsv(df: DataFrame, path: str) -> None:
    """A table as tab-separated files with a header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def write_features(features: dict[str, DataFrame], path: str) -> None:
    """A bundle of feature tables, a Parquet folder each."""
    for name, df in features.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


_CLEAN_SQL = "text"
for _p, _by in (
    (r"\\", ""), (r"\r?\n([^\r\n])", r" \1"), (r"(\r?\n)\s+", r"\1"), (r"\r", ""), (r"\n{3,}", "' || chr(10) || chr(10) || '"), ("<<", "«"), (">>", "»"), ("’", "''"), ("''''", "''"), ("«", " « "), ("»", " » "), ("!", "! "), (";", " ; "), (":", " : "),
    (r"\.(\s*[A-Z0-9ÀÉÈÙ])", r". \1"), (r",([A-Za-zÀÉÈÙ0-9])", r", \1"), (r"\)([A-Za-zÀÉÈÙ0-9])", r") \1"), (r" {3,}", "  "), (r" {2}", " "),
):
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_p}', '{_by}', 'g')"
_SENTENCES_SQL = r"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r?\n', ' ', 'g'), '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents),
each AS (SELECT doc_id, list_filter(list_transform(l, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS l FROM cut),
sentences AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS sentence_id, unnest(l) AS sentence FROM each)"""
SQL = {
    "clean_text": f"SELECT doc_id, md5({_CLEAN_SQL}) AS cleaned, length({_CLEAN_SQL})::INT AS n FROM documents",
    "split_sentences": _SENTENCES_SQL + " SELECT * FROM sentences",
    "count_words": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]+'))::INT AS n_words FROM documents",
    "whitespace_tokens": _SENTENCES_SQL + r", w AS (SELECT doc_id, sentence_id, list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '') AS l FROM sentences) SELECT doc_id, sentence_id, unnest(range(1, len(l) + 1))::INT AS token_index, unnest(l) AS token FROM w",
}
