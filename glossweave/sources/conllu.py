"""CoNLL-U: annotated sentences in, token tables out, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.blocks import FEATS, RELS, UPOS, Block

COLUMNS = ("token_id", "token", "lemma", "upos", "xpos", "feats", "head_token_id", "dep_rel", "deps", "misc")


def parse_conllu(blocks: DataFrame) -> DataFrame:
    """Token rows of (doc_id, block): texts of sentences with an empty line between them.

    ``# newpar`` begins a paragraph, ``# newdoc id =`` names the document of what follows in its block. A sentence is
    numbered through the document's block, a token through the document (term_id); "_" is null, but for the token itself.
    """
    kind = f"doc_id {dict(blocks.dtypes)['doc_id']}, paragraph_id int, sentence_id int, term_id int, " + ", ".join(f"{c} string" for c in COLUMNS)
    return blocks.select("doc_id", "block").mapInArrow(_parsed, kind)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row by row of whole blocks, as many as make some 16 MB of text or one that is longer: a block's lines are never brought together."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, np.concatenate(([0], np.cumsum(sizes)))
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 24), "right")) - 1)
            yield _tokens(batch.slice(at, to - at))
            at = to


def _tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    lines = pc.split_pattern(pc.replace_substring(batch.column(1).cast(pa.large_string()), "\r\n", "\n"), "\n")
    file = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    line = lines.flatten()
    n = len(line)
    true = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    blank, named, comment, par = true(pc.equal(pc.utf8_trim(line, " "), "")), true(pc.starts_with(line, "# newdoc id")), true(pc.starts_with(line, "#")), true(pc.starts_with(line, "# newpar"))
    token, stop = ~blank & ~comment, blank | named
    begin = np.concatenate(([True], file[1:] != file[:-1])) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(begin, np.arange(n), 0)) if n else np.zeros(0, np.int64)

    def last(flag: np.ndarray) -> np.ndarray:
        """The line before, of the same file, that had a flag last; -1."""
        seen = np.maximum.accumulate(np.where(flag, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        seen = np.concatenate(([-1], seen[:-1])) if n else seen
        return np.where(seen >= start, seen, -1)

    tokens_before = last(token)
    first = token & ((tokens_before < 0) | (last(stop) > tokens_before))
    # counts begin anew with each file and each document that is named in it
    part = np.maximum.accumulate(np.where(begin | named, np.arange(n), 0)) if n else np.zeros(0, np.int64)

    def so_far(flag: np.ndarray) -> np.ndarray:
        total = np.cumsum(flag)
        return total - (total - flag)[part]

    keep = np.flatnonzero(token)
    name = batch.column(0).take(pa.array(file[keep]))
    if named.any():
        own = last(named | begin)
        own = np.where(named | begin, np.arange(n), own)[keep]
        given = pc.utf8_trim(pc.replace_substring_regex(line.take(pa.array(own)), "^# newdoc id *=?", ""), " ").cast(pa.string())
        name = pc.if_else(pa.array(named[own]), given, name)
    cells = pc.split_pattern(line.take(pa.array(keep)), "\t")
    flat, offsets = cells.flatten(), cells.offsets.to_numpy()
    width = np.diff(offsets)
    columns = []
    for i, c in enumerate(COLUMNS):
        value = flat.take(pa.array(np.where(width > i, offsets[:-1] + i, 0), mask=width <= i)).cast(pa.string())
        columns.append(value if c == "token" else pc.if_else(pc.not_equal(value, "_"), value, pa.scalar(None, pa.string())))
    numbers = [np.maximum(so_far(par), 1), so_far(first), so_far(token)]
    return pa.RecordBatch.from_arrays([name, *[pa.array(x[keep], pa.int32()) for x in numbers], *columns], names=["doc_id", "paragraph_id", "sentence_id", "term_id", *COLUMNS])


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """The token table of CoNLL-U files; a file is a document, or several where it says so."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.conllu$", "").alias("doc_id"), F.col("value").alias("block"))
    return parse_conllu(files)


def to_conllu(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, block): each sentence as CoNLL-U lines, ending with an empty one."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_")) if c in tokens.columns else F.lit("_")
    line = F.concat_ws("\t", *[value(c) for c in COLUMNS])
    rows = tokens.groupBy("doc_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("term_id", line.alias("line")))).alias("r"))
    return rows.select("doc_id", "sentence_id", F.concat(F.array_join(F.col("r.line"), "\n"), F.lit("\n\n")).alias("block"))


def texts_of(b: Block) -> dict:
    """(doc_id, block) of annotated documents: all of a document's sentences as ``to_conllu`` has them."""
    of = lambda names, at: pa.array(["_" if x is None else x for x in names], pa.large_string()).take(pa.array(at))
    numbers = [str(i) for i in range(int(b.term.max(initial=0)) + 1)]
    void = pa.array(np.zeros(b.n, np.int64))
    blank = pa.array(["_"], pa.large_string()).take(void)
    ends = np.zeros(b.n, np.int64)
    ends[b.off[1:] - 1] = 1
    columns = [of(numbers, b.term), of(b.types, b.code), of(b.lemmas, b.code), of(UPOS, b.upos), blank, of(FEATS, b.feats), of(numbers, b.head), of(RELS, b.rel), blank, blank]
    by = lambda x: pa.scalar(x, pa.large_string())
    line = pc.binary_join_element_wise(pc.binary_join_element_wise(*columns, by("\t")), of(["\n", "\n\n"], ends), by(""))
    offsets = pa.array(np.append(b.off[b.doc_at], b.n))
    return {"doc_id": b.docs, "block": pc.binary_join(pa.LargeListArray.from_arrays(offsets, line), by(""))}


def write_conllu(tokens: DataFrame, path: str) -> None:
    """One folder of files, sentences in the order of their documents."""
    to_conllu(tokens).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "sentence_id").select(F.regexp_replace("block", r"\n\z", "")).write.mode("overwrite").text(path)
