"""Token tables: the schema of annotated text, and a deterministic annotator that needs no model.

The annotator is synthetic: closed word lists, suffixes and arithmetic in place of a parser. It makes no linguistic
claim; it gives every operator a table of the right shape on any text, the same in Spark and in SQL. Real
annotations come from ``glossweave.sources.conllu`` or from an ``Annotator`` (``glossweave.plugins``).

A sentence lies in one row until its tokens and their heads are known, and is exploded last: no shuffle, no join, and
columns that a query doesn't ask for aren't made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a line ends a sentence: white space after a stop and before a capital.
BOUNDARY = r"(?<=[.!?])[ \t]+(?=\p{Lu})"
#: A run of letters, a number, or one other character that isn't white space.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
CONTENT = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")
UPOS_TAGS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


_WORDS = {
    "DET": "the a an this that le la les un une des du der die das ein eine el los las una".split(),
    "ADP": "of to in for on with by at from de en à dans sur avec pour par von mit im auf zu für con por".split(),
    "CCONJ": "and or but et ou mais und oder aber y o pero".split(),
    "SCONJ": "if because while que daß dass weil porque".split(),
    "PRON": "it he she they we you i qui il elle ce se es sie er sich ich lo".split(),
    "AUX": "is are was were be been has have est sont ist sind war hay son".split(),
    "PART": "not nicht ne pas no".split(),
    "INTJ": "oh ah hey wow ach ay".split(),
}
_MARKS = tuple(".,;:!?()[]{}-–—…«»“”„‘’\"") + ("'",)
_SIGNS = tuple("$€£¥%+=<>|@#*/&~^_`§°©®™\\")
_CLOSED = sorted({w for ws in _WORDS.values() for w in ws})


def upos_sql(token: str = "token", lower: str = "lower_token", place: str = "term_id") -> str:
    # DuckDB and Spark alike: a backslash is left out of the literals, it is a sign of its own by its code
    signs = sql_list(s for s in _SIGNS if s != "\\")
    marks = "(" + ", ".join("chr(39)" if m == "'" else f"'{m}'" for m in _MARKS) + ")"
    return (
        f"CASE WHEN {token} IN {marks} THEN 'PUNCT' WHEN {token} IN {signs} OR {token} = chr(92) THEN 'SYM' WHEN substr({token}, 1, 1) BETWEEN '0' AND '9' THEN 'NUM' "
        + " ".join(f"WHEN {lower} IN {sql_list(w)} THEN '{tag}'" for tag, w in _WORDS.items())
        + f" WHEN length({lower}) > 3 AND {lower} LIKE '%ly' THEN 'ADV'"
        + f" WHEN length({lower}) > 3 AND ({lower} LIKE '%ed' OR {lower} LIKE '%ing' OR {lower} LIKE '%er' OR {lower} LIKE '%ent') THEN 'VERB'"
        + f" WHEN length({lower}) > 4 AND ({lower} LIKE '%ble' OR {lower} LIKE '%eux' OR {lower} LIKE '%lich' OR {lower} LIKE '%ado') THEN 'ADJ'"
        + f" WHEN {place} > 1 AND {token} <> {lower} THEN 'PROPN' ELSE 'NOUN' END"
    )


UPOS_SQL = upos_sql()
LEMMA_SQL = (
    "CASE WHEN length(lower_token) > 5 AND lower_token LIKE '%ing' THEN substr(lower_token, 1, length(lower_token) - 3)"
    " WHEN length(lower_token) > 4 AND (lower_token LIKE '%ed' OR lower_token LIKE '%er' OR lower_token LIKE '%es') THEN substr(lower_token, 1, length(lower_token) - 2)"
    " WHEN length(lower_token) > 3 AND lower_token LIKE '%s' THEN substr(lower_token, 1, length(lower_token) - 1) ELSE lower_token END"
)
FEATS_SQL = (
    "CASE WHEN upos = 'VERB' AND lower_token LIKE '%ed' THEN 'Mood=Ind|Tense=Past|VerbForm=Fin'"
    " WHEN upos = 'VERB' AND lower_token LIKE '%ing' THEN 'Tense=Past|VerbForm=Part'"
    " WHEN upos = 'VERB' AND lower_token LIKE '%er' THEN 'VerbForm=Inf'"
    " WHEN upos = 'VERB' THEN 'Mood=Ind|Tense=Pres|VerbForm=Fin'"
    " WHEN upos = 'AUX' THEN 'Mood=Ind|Tense=Pres|VerbForm=Fin'"
    " WHEN upos = 'NOUN' AND lower_token LIKE '%s' THEN 'Number=Plur' WHEN upos = 'NOUN' THEN 'Number=Sing' END"
)
#: Content words are those that no closed list, mark, sign or number is. Content word k depends on content word k / 2, all
#: else on the next content word or, where there is none, the last.
HEAD_RANK_SQL = "CASE WHEN is_content = 1 THEN (rank - rank % 2) / 2 WHEN rank < total THEN rank + 1 ELSE total END"
DEP_REL_SQL = (
    "CASE WHEN head = 0 THEN 'root' WHEN upos = 'PUNCT' THEN 'punct' WHEN upos = 'DET' THEN 'det' WHEN upos = 'ADP' THEN 'case' WHEN upos = 'NUM' THEN 'nummod' WHEN upos = 'SYM' THEN 'dep'"
    " WHEN upos = 'CCONJ' THEN 'cc' WHEN upos = 'SCONJ' THEN 'mark' WHEN upos = 'PART' THEN 'advmod' WHEN upos = 'INTJ' THEN 'discourse'"
    " WHEN upos = 'AUX' THEN CASE WHEN head_upos = 'VERB' THEN 'aux' ELSE 'cop' END"
    " WHEN upos = 'PRON' THEN CASE WHEN head_upos = 'VERB' THEN 'nsubj' ELSE 'nmod' END"
    " WHEN upos = 'VERB' THEN CASE WHEN head_upos = 'VERB' AND term_id % 2 = 0 THEN 'conj' WHEN head_upos = 'VERB' THEN 'ccomp' WHEN head_upos = 'NOUN' THEN 'acl:relcl' ELSE 'advcl' END"
    " WHEN upos = 'ADJ' THEN 'amod' WHEN upos = 'ADV' THEN 'advmod'"
    " WHEN head_upos = 'VERB' THEN CASE WHEN term_id % 3 = 0 THEN 'obl' ELSE 'obj' END WHEN head_upos = upos THEN 'conj' ELSE 'nmod' END"
)
SENTENCE_KEY = ("doc_id", "paragraph_id", "sentence_id")


def spread_out(docs: DataFrame) -> DataFrame:
    """Texts of a table with fewer partitions than the session has cores, such as one small file, over all cores; others stay where they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    narrow = docs.select("doc_id", "text")
    return narrow.repartition(cores, "doc_id") if narrow.rdd.getNumPartitions() < cores else narrow


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_id, sentence_id, sentence) of (doc_id, text).

    A line is a paragraph, numbered from 1 with the empty ones; sentences, which are never blank, are counted through the document.
    """
    spread = spread_out(docs)
    lines = F.split("text", "\n")
    cut = F.flatten(F.transform(lines, lambda line, i: F.transform(F.split(line, BOUNDARY), lambda s: F.struct((i + 1).alias("paragraph"), s.alias("sentence")))))
    each = spread.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.filter(cut, lambda x: F.trim(F.translate(x.sentence, "\t\r", "  ")) != "")).alias("at", "x"))
    return each.select("doc_id", F.col("x.paragraph").alias("paragraph_id"), (F.col("at") + 1).alias("sentence_id"), F.col("x.sentence").alias("sentence"))


def annotate(docs: DataFrame) -> DataFrame:
    """The token table of (doc_id, text): one row a token, made where the documents are read."""
    # an inline of one struct keeps what is used several times below it from being written out, and computed, each time
    words = sentences(docs).select("doc_id", "paragraph_id", "sentence_id", F.inline(F.array(F.struct(F.regexp_extract_all("sentence", F.lit(TOKEN), 0).alias("w")))))
    open_class = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(r"^\p{L}") & ~F.lower(x).isin(_CLOSED), i + 1).otherwise(0)), lambda i: i > 0)
    placed = words.where(F.size("w") > 0).select("doc_id", "paragraph_id", "sentence_id", "w", F.inline(F.array(F.struct(open_class.alias("p")))))
    # run by run: what stands before content word k points to it, and it to content word k / 2; what is left points to the last
    heads = F.expr(
        "if(size(p) = 0, concat(array(0), array_repeat(1, size(w) - 1)), concat(flatten(transform(p, (at, k) ->"
        " concat(array_repeat(at, at - if(k = 0, 0, p[greatest(k - 1, 0)]) - 1), array(if(k = 0, 0, p[cast(floor((k + 1) / 2) AS INT) - 1]))))), array_repeat(p[size(p) - 1], size(w) - p[size(p) - 1])))"
    )
    zipped = placed.withColumn("h", heads).select("doc_id", "paragraph_id", "sentence_id", "w", F.posexplode("h").alias("at", "head"))
    token, head_token = F.get("w", F.col("at")), F.when(F.col("head") > 0, F.get("w", F.col("head") - 1))
    cased = F.struct((F.col("at") + 1).alias("term_id"), token.alias("token"), F.lower(token).alias("lower_token"), head_token.alias("head_token"), F.lower(head_token).alias("head_lower"))
    token = zipped.select("doc_id", "paragraph_id", "sentence_id", "head", F.inline(F.array(cased)))
    tags = F.struct(F.expr(UPOS_SQL).alias("upos"), F.expr(f"CASE WHEN head > 0 THEN {upos_sql('head_token', 'head_lower', 'head')} END").alias("head_upos"))
    tagged = token.select("doc_id", "paragraph_id", "sentence_id", "term_id", "token", "lower_token", "head", F.inline(F.array(tags)))
    return tagged.select(
        "doc_id", "paragraph_id", "sentence_id", "term_id", F.col("term_id").cast("string").alias("token_id"), "token", F.expr(LEMMA_SQL).alias("lemma"), "upos",
        F.expr(FEATS_SQL).alias("feats"), F.col("head").cast("string").alias("head_token_id"), F.expr(DEP_REL_SQL).alias("dep_rel"), (F.col("upos") != "PUNCT").alias("compte"), "lower_token",
    )


_IS_CONTENT = f"CASE WHEN regexp_matches(token, '^\\p{{L}}') AND lower_token NOT IN {sql_list(_CLOSED)} THEN 1 ELSE 0 END"


def prologue(source: str = "documents", key: str = "doc_id", p: str = "") -> str:
    """The same in DuckDB, heads by ranks and a join: common table expressions, without WITH, that end in ``<p>tokens``."""
    same = "h.doc_id = p.doc_id AND h.sentence_id = p.sentence_id"
    return f"""
{p}lines AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS paragraph_id, unnest(l) AS line
  FROM (SELECT CAST({key} AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS l FROM {source} WHERE text IS NOT NULL)),
{p}pieces AS (SELECT doc_id, paragraph_id, unnest(range(1, len(s) + 1)) AS place, unnest(s) AS sentence
  FROM (SELECT *, string_split(regexp_replace(line, '([.!?])[ \\t]+(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM {p}lines)),
{p}split_sentences AS (SELECT doc_id, paragraph_id, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, place))::INT AS sentence_id, sentence
  FROM {p}pieces WHERE trim(translate(sentence, chr(9) || chr(13), '  ')) <> ''),
{p}words AS (SELECT doc_id, paragraph_id, sentence_id, unnest(range(1, len(w) + 1))::INT AS term_id, unnest(w) AS token
  FROM (SELECT *, regexp_extract_all(sentence, '{TOKEN}') AS w FROM {p}split_sentences)),
{p}lowered AS (SELECT *, lower(token) AS lower_token FROM {p}words),
{p}tagged AS (SELECT *, {UPOS_SQL} AS upos FROM {p}lowered),
{p}featured AS (SELECT *, {LEMMA_SQL} AS lemma, {FEATS_SQL} AS feats, {_IS_CONTENT} AS is_content FROM {p}tagged),
{p}ranked AS (SELECT *, sum(is_content) OVER (PARTITION BY doc_id, sentence_id ORDER BY term_id) AS rank, sum(is_content) OVER (PARTITION BY doc_id, sentence_id) AS total FROM {p}featured),
{p}placed AS (SELECT *, CAST({HEAD_RANK_SQL} AS BIGINT) AS head_rank FROM {p}ranked),
{p}linked AS (SELECT p.*, CASE WHEN p.total > 0 THEN coalesce(h.term_id, 0) WHEN p.term_id = 1 THEN 0 ELSE 1 END AS head, coalesce(h.upos, CASE WHEN p.total = 0 AND p.term_id > 1 THEN f.upos END) AS head_upos
  FROM {p}placed p LEFT JOIN {p}placed h ON h.is_content = 1 AND {same} AND h.rank = p.head_rank
  LEFT JOIN {p}placed f ON f.term_id = 1 AND f.total = 0 AND {same.replace("h.", "f.")}),
{p}tokens AS MATERIALIZED (SELECT doc_id, paragraph_id, sentence_id, term_id, CAST(term_id AS VARCHAR) AS token_id, token, lemma, upos, feats,
  CAST(head AS VARCHAR) AS head_token_id, head, {DEP_REL_SQL} AS dep_rel, upos <> 'PUNCT' AS compte, lower_token FROM {p}linked)
"""


#: What a query over the tokens of documents begins with.
PROLOGUE = "WITH" + prologue()
