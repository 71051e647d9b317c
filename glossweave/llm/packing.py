"""Operator 6: bounded-space online packing of documents into windows of a fixed number of tokens.

A partition keeps a fixed number of open windows. A document goes where it leaves least room; where none has room for
it, and as many as are allowed are open, the fullest is emitted and a new one opened (best fit with bounded space,
Csirik and Johnson 2001). What is open in the end are the partition's leftovers; these are packed in the same way,
many partitions' at a time, until one partition has taken them all.

Texts move once, to a number of partitions that follows the input, and stream through the packer in an order that
depends on hashes of the documents alone, so that the windows are the same on any cluster; a task holds no more than
its open windows. Each round's windows and leftovers are stored at once, as one is the complement of the other; only the
leftovers move again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, pieces, stored, table, text_buffers, word_starts

#: Tokens of a window, and open windows of a partition.
CAPACITY, OPEN = 2048, 64
#: Bytes of text of a partition, as a target, and partitions whose leftovers are packed together.
OCTETS, FAN = 64_000_000, 64
#: Windows that are written at once.
CHUNK = 500

_LISTS = "doc_ids array<long>, starts array<int>, lengths array<int>, texts array<string>"
_PACKED = "part long, number int, done boolean, used int, " + _LISTS
_ARROW = pa.schema(
    [("part", pa.int64()), ("number", pa.int32()), ("done", pa.bool_()), ("used", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))]
)


class Windows:
    """The open windows of a partition: items go in one by one, windows come out."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.rooms: list[tuple[int, int]] = []  # (room, number) in order: the best fit is found by bisection, the fullest is first
        self.items: dict[int, list] = {}
        self.count = 0

    def add(self, size: int, item) -> Iterator[list]:
        number = self.count
        self.count += 1
        if size >= self.capacity:
            yield [item]
            return
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                yield self.items.pop(self.rooms.pop(0)[1])
            room = self.capacity
            self.items[number] = []
        self.items[number].append(item)
        if room == size:
            yield self.items.pop(number)
        else:
            insort(self.rooms, (room - size, number))

    def left(self) -> list[list]:
        return [self.items[number] for _, number in self.rooms]


def pack(sizes: list[int], capacity: int, most: int) -> tuple[list[list[int]], list[list[int]]]:
    """Indexes of the items in the windows that are emitted, and in those that are left open."""
    windows = Windows(capacity, most)
    done = [w for i, n in enumerate(sizes) for w in windows.add(n, i)]
    return done, windows.left()


def _documents(batch: pa.RecordBatch, capacity: int) -> Iterator[tuple[int, int, tuple[list, list, list, list]]]:
    """(partition, tokens, (doc_ids, starts, lengths, texts)) of the pieces of (part, doc_id, text) in order.

    A token is a run of anything but ASCII white space, and one more ends a document. A piece's text reaches to where
    the next one begins, so that the pieces of a document make up its text.
    """
    for rows in pieces(batch, 2):
        text, offsets = text_buffers(rows.column(2))
        begin = word_starts(text, offsets)
        first = np.searchsorted(begin, offsets)
        for i, (part, doc_id) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
            a, b = int(first[i]), int(first[i + 1])
            for start in range(0, b - a + 1, capacity):
                n = min(capacity, b - a + 1 - start)
                low = int(begin[a + start]) if start and a + start < b else int(offsets[i + 1 if start else i])
                high = int(begin[a + start + n]) if a + start + n < b else int(offsets[i + 1])
                yield part, n, ([doc_id], [start], [n], [text[low:high].tobytes().decode()])


def _leftovers(batch: pa.RecordBatch, capacity: int) -> Iterator[tuple[int, int, tuple[list, list, list, list]]]:
    for part, used, *lists in zip(*(c.to_pylist() for c in batch.columns)):
        yield part, used, tuple(lists)


def _packer(read, capacity: int, most: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, windows, number = None, Windows(capacity, most), 0

        def row(items: list, done: bool) -> tuple:
            nonlocal number
            lists = [[x for item in items for x in item[c]] for c in range(4)]
            number += 1
            return (at, number - 1, done or last, sum(lists[2]), *lists)

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()

        for batch in batches:
            for part, size, item in read(batch, capacity):
                if part != at:
                    rows += [row(w, False) for w in windows.left()]
                    at, windows, number = part, Windows(capacity, most), 0
                rows += [row(w, True) for w in windows.add(size, item)]
                if len(rows) >= CHUNK:
                    yield from flush()
        rows += [row(w, False) for w in windows.left()]
        if rows:
            yield from flush()

    return run


def packed_windows(docs: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, octets: int = OCTETS) -> DataFrame:
    """Windows of at most ``capacity`` tokens: (window_id, n_tokens, n_docs, doc_ids, starts, lengths, texts).

    A token is a run of anything but ASCII white space; one more, that ends the document, is counted with it. Each
    document lies in one window, or, where it is longer than a window, in several: its pieces of ``capacity`` tokens are
    windows of their own, and the rest is packed. The four lists run in parallel: starts has the token of the document
    at which a piece begins, texts the piece itself, so that the pieces of a document, by start, make up its text. Every
    window has an id of its own. Null texts have no tokens and are left out; an empty text has the one that ends it.
    Repeated rows are packed as often as they stand there, rows of a null doc_id as null. Documents are taken in the
    order of a hash of doc_id and text; those of equal hash by doc_id. An empty table gives an empty result. Other
    columns, whatever their names, have no effect.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    total = texts.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
    parts = max(1, int(-(-total // octets)))
    key = F.xxhash64("doc_id", "text")
    items = texts.select(F.pmod(key, F.lit(parts)).alias("part"), key.alias("key"), "doc_id", "text")
    ordered = items.repartition(parts, "part").sortWithinPartitions("part", "key", "doc_id").select("part", "doc_id", "text")
    out, turn, read = [], 0, _documents
    while True:
        packed = stored(ordered.mapInArrow(lean(_packer(read, capacity, most_open, parts == 1)), _PACKED))
        name = F.concat_ws("-", F.lit(str(turn)), F.col("part").cast("string"), F.col("number").cast("string"))
        out.append(packed.where("done").select(name.alias("window_id"), F.col("used").alias("n_tokens"), F.size("doc_ids").alias("n_docs"), "doc_ids", "starts", "lengths", "texts"))
        if parts == 1:
            break
        parts, turn, read = -(-parts // FAN), turn + 1, _leftovers
        # the emptiest first: fuller ones then find the room beside them
        items = packed.where("not done").select(F.floor(F.col("part") / FAN).alias("part"), "used", "doc_ids", "starts", "lengths", "texts")
        ordered = items.repartition(parts, "part").sortWithinPartitions("part", "used", "doc_ids", "starts", "lengths")
    windows = out[0]
    for more in out[1:]:
        windows = windows.unionByName(more)
    return windows


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_windows(table(spark, sf_dir, "documents"))
