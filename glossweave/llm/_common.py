"""Helpers shared by the training-data operators: scratch tables, sizes and vectorised tokenising."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text that are hashed at once: the temporaries take some 40 bytes for each.
PIECE = 1 << 20

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32, *range(28, 32)]] = False
#: The split pattern of ``alnum`` tokens in lower-cased text; the same in Java, RE2 and Python.
SPLIT = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def release() -> None:
    """Gives memory that arrays have left back to the system: idle Python workers would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function of Arrow batches that keeps no memory once its task is done."""

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return batched


def lean_table(run: Callable) -> Callable:
    """The same for a function of the table of a group, or of the two tables of a cogroup; Spark counts its parameters."""

    def freed(made: pa.Table) -> pa.Table:
        release()
        return made

    if run.__code__.co_argcount == 1:
        return lambda rows: freed(run(rows))
    return lambda left, right: freed(run(left, right))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a single machine (tests) may have it unset, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glossweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage ends, and the loss of an executor costs nothing that was done before.

    The files go when the session ends, as what is read from them is lazy.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, that is deleted when the session ends."""
    path = f"{scratch_dir(spark)}/glossweave-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(named)
    return path


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins and ends; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    base = int(offsets[0])
    text = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None and data.size else np.zeros(0, np.uint8)
    return text, offsets - base


def words(text: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of whole texts: its 64-bit hash, first byte, end, and row.

    ``alnum`` words are runs of ASCII letters and digits and of all bytes from 128 on; ``ink`` words are runs of
    anything but ASCII white space. The hash is a polynomial of the bytes modulo 2**64, finalised; prefix sums give
    it for all words at once. Texts are cut for this only between words.
    """
    is_word = _ALNUM if kind == "alnum" else _INK
    hashes, begins, ends = [], [], []
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + PIECE)
        while to < n:
            cut = np.flatnonzero(~is_word[text[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
                break
            later = offsets[np.searchsorted(offsets, at, "right") :]
            inside = later[later <= to]
            if len(inside):
                to = int(inside[-1])
                break
            to = min(n, to + PIECE)
        piece = text[at:to]
        inked = is_word[piece]
        border = np.zeros(len(piece) + 1, bool)
        border[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
        before = np.concatenate(([False], inked))
        after = np.concatenate((inked, [False]))
        begin = np.flatnonzero(after & (~before | border))
        end = np.flatnonzero(before & (~after | border))
        up, down = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        hashes.append(mix((total[end] - total[begin]) * down[begin]))
        begins.append(begin + at)
        ends.append(end + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    begin = np.concatenate(begins)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(offsets, begin, "right") - 1


def word_starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all ``ink`` words of whole texts."""
    inked = _INK[text]
    before = np.concatenate(([False], inked[:-1])) if len(inked) else inked
    fresh_row = np.zeros(len(text) + 1, bool)
    fresh_row[offsets] = True
    return np.flatnonzero(inked & (~before | fresh_row[:-1]))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values; the array is sorted in place (np.unique hashes, which is twenty times slower here)."""
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most``; a row that is larger has a range of its own."""
    at, total = 0, np.concatenate(([0], np.cumsum(sizes)))
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, to
        at = to


def pieces(batch: pa.RecordBatch, column: int, most: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of whole rows of about so many bytes of text, which bounds what tokenising takes."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in slices(sizes, most):
        yield batch.slice(a, b - a)
