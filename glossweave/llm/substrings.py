"""Operator 5: removal of repeated passages by fixed-block anchors.

A passage of at least ``2 * BLOCK - 1`` words holds a whole block of the partition of its document into blocks of
``BLOCK`` words. So the corpus is indexed by the hashes of its non-overlapping blocks, every rolling window of
``BLOCK`` words probes the index, and only around hits is it looked, word by word in both directions, how far the text
repeats: a run of windows of ``LEAST`` words, all of which occur earlier, side by side in one text, is a maximal repeat.

What moves: the rows once, by super-batches of texts; for the probes four bytes a word, packed into one row for each
super-batch and index partition; twenty-four bytes a window around hits, packed too. A hit goes back to its
super-batch as a hash, so nothing but the heavy texts below is broadcast, and no list of pairs is built: a passage in a
thousand documents brings a thousand rows. All three uses of the shuffled rows read one exchange.

A text whose copies would fill a super-batch by themselves is heavy. There are fewer such texts than super-batches, so
their hashes are known everywhere: one row of each is searched, and the others, of which it is known that they repeat it
as a whole, don't move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import distinct, fresh, lean_table, mix, powers, stored, table, text_buffers, words

#: Words of an anchor block, and of the shortest repeat that is reported; LEAST >= 2 * BLOCK - 1 makes the search exact.
BLOCK, LEAST = 25, 50
#: Bytes of text in a super-batch, at least. It grows with the square root of the corpus, so that the packed rows stay long.
BATCH = 8_000_000
_NULL = np.iinfo(np.int64).min


def batch_count(octets: int) -> int:
    return max(1, math.ceil(octets / max(BATCH, math.sqrt(120.0 * octets))))


class Texts:
    """The rows of a super-batch, in the order in which occurrences count as earlier: by text hash, then doc_id (null last)."""

    def __init__(self, rows: pa.Table, doc_id: str, text: str, th: str, block: int, least: int):
        ids = rows[doc_id].cast(pa.int64())
        hashes = rows[th].to_numpy().view(np.uint64)
        none = ids.is_null().to_numpy()
        ids = ids.fill_null(_NULL).to_numpy()
        self.order = np.lexsort((ids, none, hashes))
        self.rows = rows.take(pa.array(self.order))
        self.ids, hashes = ids[self.order], hashes[self.order]
        self.column = self.rows[text].combine_chunks()
        if isinstance(self.column, pa.ChunkedArray):
            self.column = pa.concat_arrays(self.column.chunks) if self.column.num_chunks else pa.array([], pa.string())
        self.text, self.offsets = text_buffers(self.column)
        self.hash, self.begin, self.end, self.row = words(self.text, self.offsets, "ink")
        n = np.bincount(self.row, minlength=len(rows))
        self.first = np.concatenate(([0], np.cumsum(n)))
        #: The first row of the same text, which stands for the others in the search.
        same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (n[1:] == n[:-1])))
        self.leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
        self.searched = (self.leader == np.arange(len(rows))) & (n >= least)
        self.copies = np.flatnonzero((self.leader != np.arange(len(rows))) & (n >= least))
        up, down = powers(len(self.hash) + 1)
        self.sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(self.hash)], out=self.sums[1:])
        self.down = down
        self.block, self.least = block, least

    def starts(self, size: int) -> np.ndarray:
        """Where windows of so many words begin in the texts that are searched."""
        if len(self.hash) < size:
            return np.zeros(0, np.int64)
        at = np.arange(len(self.hash) - size + 1)
        return at[(self.row[: len(at)] == self.row[size - 1 :]) & self.searched[self.row[: len(at)]]]

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at] + np.uint64(size))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _cut(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The columns by part, each part's packed into bytes."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 65536 else part, kind="stable")
    part = part[order]
    border = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, int)
    columns = [c[order] for c in columns]
    for a, b in zip(border[:-1], border[1:]):
        yield int(part[a]), [c[a:b].tobytes() for c in columns]


def _packed(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and the row of each."""
    raw = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(raw), dtype), np.repeat(np.arange(len(raw)), [len(x) // size for x in raw])


def _member(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the values that are in a sorted distinct array, and where they are in it; a bitmap spares most searches."""
    if not len(of) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 22, bool)
    low = values.dtype.type((1 << 22) - 1)
    seen[(of & low).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values & low).astype(np.int64)])
    at = np.minimum(np.searchsorted(of, values[maybe]), len(of) - 1)
    hit = of[at] == values[maybe]
    return maybe[hit], at[hit]


_PROBES = "part int, batch int, anchors binary, probes binary"
_LIVE = "batch int, part int, hashes binary"
_AROUND = "part int, batch int, hashes binary, at binary, ids binary, starts binary"
_EARLIER = "batch int, at binary, ids binary, starts binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _arrow(schema))], schema=_arrow(schema)) if rows else _arrow(schema).empty_table()


#: What ``words`` calls a word of the kind that counts here.
_INK_WORD = r"[^\x09-\x0d\x1c-\x20]+"


class Repeats:
    """The steps of one search, over rows that have the batch and the text hash in columns of these names."""

    def __init__(self, docs: DataFrame, block: int, least: int, parts: int | None, heavy: int | None = None):
        if not 0 < 2 * block - 1 <= least:
            raise ValueError("least must be 2 * block - 1 words or more")
        self.block, self.least = block, least
        octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = parts or batch_count(octets)
        self.batch, self.th = fresh(docs, "gw_batch"), fresh(docs, "gw_th")
        th = F.xxhash64("text")
        # at most one text for each ``heavy`` bytes of the corpus
        fill = max(BATCH, octets // self.parts) if heavy is None else heavy
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
        n = F.regexp_count("text", F.lit(_INK_WORD))
        sizes = docs.where(F.length("text") >= 2 * least - 1).groupBy(th.alias("gw_h")).agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("rows"), first.alias("first"))
        self.heavy = stored(sizes.where((F.col("size") >= fill) & (F.col("rows") > 1)).select("gw_h", F.col("first.id").alias("gw_first")))
        names = docs.columns
        hashed = docs.withColumn(self.th, th)
        if not self.heavy.isEmpty():
            of, lead = fresh(hashed, "gw_of"), fresh(hashed, "gw_lead")
            marked = hashed.join(F.broadcast(self.heavy.select(F.col("gw_h").alias(of), F.col("gw_first").alias(lead))), F.col(self.th) == F.col(of), "left")
            leaders = marked.where(F.col(of).isNotNull() & F.col("doc_id").eqNullSafe(F.col(lead))).withColumn(lead + "_n", n)
            row = F.first(F.struct(*[F.col(f"`{c}`") for c in names], F.col(lead + "_n").alias(lead + "_n"))).alias("gw_row")
            one = leaders.groupBy(F.col(self.th).alias("gw_h")).agg(row)
            # too few words to be reported: such texts are rows like any other, spread by doc_id
            long = stored(one.where(F.col(f"gw_row.{lead}_n") >= least))
            self.heavy = self.heavy.join(long.select("gw_h", F.col(f"gw_row.{lead}_n").cast("long").alias("gw_words")), "gw_h")
            light = hashed.join(F.broadcast(self.heavy.select(F.col("gw_h").alias(of))), F.col(self.th) == F.col(of), "left_anti")
            hashed = light.unionByName(long.select(*[F.col("gw_row").getField(c).alias(c) for c in names], F.col("gw_h").alias(self.th)))
        # texts that are too short for a window are spread by doc_id too: there may be very many of one
        short = (F.length("text") < 2 * least - 1) | (F.regexp_count("text", F.lit(_INK_WORD)) < least)
        by = F.when(F.col("text").isNull(), F.xxhash64("doc_id")).when(short, F.xxhash64("doc_id", "text")).otherwise(F.col(self.th))
        batch = F.shiftright(F.shiftrightunsigned(by, 32) * F.lit(self.parts).cast("long"), 32).cast("int")
        self.rows = hashed.withColumn(self.batch, batch).repartition(self.parts, self.batch)

    def heavy_copies(self, docs: DataFrame) -> DataFrame:
        """What is reported of the rows of heavy texts that aren't searched."""
        found = docs.join(F.broadcast(self.heavy), F.xxhash64("text") == F.col("gw_h")).groupBy("gw_h", "doc_id", "gw_first", "gw_words").agg(F.count(F.lit(1)).alias("gw_n"))
        again = F.col("gw_n") - F.col("doc_id").eqNullSafe(F.col("gw_first")).cast("long")
        rows = found.where(again > 0).select("*", F.explode(F.sequence(F.lit(1), again.cast("int"))))
        return rows.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("gw_words").alias("n_words"), F.col("gw_first").alias("source_doc_id"), F.lit(0).cast("long").alias("source_start"))

    def reader(self) -> Callable[[pa.Table], Texts]:
        return partial(Texts, doc_id="doc_id", text="text", th=self.th, block=self.block, least=self.least)

    def probes(self) -> DataFrame:
        read, batch, parts, block = self.reader(), self.batch, self.parts, self.block

        def run(rows: pa.Table) -> pa.Table:
            t, number = read(rows), rows[batch][0].as_py()
            at = t.starts(block)
            hashes = t.windows(at, block)
            part, low = _part(hashes, parts), hashes.astype(np.uint32)
            anchor = (at - t.first[t.row[at]]) % block == 0
            anchors = {p: x[0] for p, x in _cut(part[anchor], low[anchor])}
            return _table([(p, number, anchors.get(p, b""), x[0]) for p, x in _cut(part, low)], _PROBES)

        return self.rows.groupBy(batch).applyInArrow(lean_table(run), _PROBES)

    def live(self, probes: DataFrame) -> DataFrame:
        """Of the hashes that a super-batch probed, those of an indexed block that has another occurrence."""

        def run(rows: pa.Table) -> pa.Table:
            anchors = distinct(_packed(rows["anchors"], np.uint32)[0].copy())
            hashes, of = _packed(rows["probes"], np.uint32)
            found, at = _member(hashes, anchors)
            again = np.bincount(at, minlength=len(anchors)) > 1
            found, at = found[again[at]], at[again[at]]
            part = rows["part"][0].as_py()
            batches = rows["batch"].to_numpy()
            return _table([(int(batches[i]), part, x[0]) for i, x in _cut(of[found], hashes[found])], _LIVE)

        return probes.repartition(self.parts, "part").groupBy("part").applyInArrow(lean_table(run), _LIVE)

    def around(self, live: DataFrame) -> DataFrame:
        """The windows of ``least`` words that hold a hit."""
        read, batch, parts, block, least = self.reader(), self.batch, self.parts, self.block, self.least

        def run(rows: pa.Table, hits: pa.Table) -> pa.Table:
            if not len(rows) or not len(hits):
                return _table([], _AROUND)
            t, number = read(rows), rows[batch][0].as_py()
            low, of = _packed(hits["hashes"], np.uint32)
            known = distinct(hits["part"].to_numpy().astype(np.uint64)[of] << np.uint64(32) | low)
            at = t.starts(block)
            hashes = t.windows(at, block)
            found, _ = _member(_part(hashes, parts) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF)), known)
            hit = at[found]
            begin, end = np.maximum(t.first[t.row[hit]], hit - (least - block)), np.minimum(hit, t.first[t.row[hit] + 1] - least)
            depth = np.bincount(begin, minlength=len(t.hash) + 2) - np.bincount(end + 1, minlength=len(t.hash) + 2)
            at = np.flatnonzero(np.cumsum(depth) > 0)
            hashes = t.windows(at, least)
            row = t.row[at]
            cut = _cut(_part(hashes, parts), hashes, at.astype(np.uint32), t.ids[row], (at - t.first[row]).astype(np.uint32))
            return _table([(p, number, *x) for p, x in cut], _AROUND)

        return self.rows.groupBy(batch).cogroup(live.repartition(self.parts, "batch").groupBy("batch")).applyInArrow(lean_table(run), _AROUND)

    def earlier(self, around: DataFrame) -> DataFrame:
        """For each window that occurred before, its first occurrence. One that overlaps it in the same text doesn't count."""
        least = self.least

        def run(rows: pa.Table) -> pa.Table:
            hashes, of = _packed(rows["hashes"], np.uint64)
            at = _packed(rows["at"], np.uint32)[0].astype(np.int64)
            ids, starts = _packed(rows["ids"], np.int64)[0], _packed(rows["starts"], np.uint32)[0]
            batch = rows["batch"].to_numpy().astype(np.int64)[of]
            order = np.lexsort((at, batch, hashes))
            hashes, at, batch, ids, starts = hashes[order], at[order], batch[order], ids[order], starts[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
            source = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
            later = np.flatnonzero(~new & ((batch != batch[source]) | (at - at[source] >= least)))
            source = source[later]
            cut = _cut(batch[later], at[later].astype(np.uint32), ids[source], starts[source])
            return _table([(p, *x) for p, x in cut], _EARLIER)

        return around.repartition(self.parts, "part").groupBy("part").applyInArrow(lean_table(run), _EARLIER)

    def found(self, then, schema: T.StructType | str) -> DataFrame:
        """Applies ``then(texts, first word, words, source doc_id, source's first word, row)`` to the maximal repeats of each super-batch."""
        read, least = self.reader(), self.least

        def run(rows: pa.Table, before: pa.Table) -> pa.Table:
            t = read(rows)
            at = _packed(before["at"], np.uint32)[0].astype(np.int64)
            ids, starts = _packed(before["ids"], np.int64)[0], _packed(before["starts"], np.uint32)[0].astype(np.int64)
            order = np.argsort(at)
            at, ids, starts = at[order], ids[order], starts[order]
            row = t.row[at]
            joined = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]) & (ids[1:] == ids[:-1]) & (starts[1:] == starts[:-1] + 1)
            head = np.flatnonzero(np.concatenate(([True], ~joined))) if len(at) else np.zeros(0, int)
            tail = np.concatenate((head[1:], [len(at)])) - 1 if len(at) else head
            c = t.copies
            first = np.concatenate((at[head], t.first[c]))
            size = np.concatenate((at[tail] - at[head] + least, t.first[c + 1] - t.first[c]))
            of = np.concatenate((row[head], c))
            return then(t, first, size, np.concatenate((ids[head], t.ids[t.leader[c]])), np.concatenate((starts[head], np.zeros(len(c), np.int64))), of)

        before = self.earlier(self.around(self.live(self.probes())))
        return self.rows.groupBy(self.batch).cogroup(before.repartition(self.parts, "batch").groupBy("batch")).applyInArrow(lean_table(run), schema)


def repeated_passages(docs: DataFrame, block: int = BLOCK, least: int = LEAST, parts: int | None = None, heavy: int | None = None) -> DataFrame:
    """Every passage of ``least`` words or more that occurs earlier, as (doc_id, start, n_words, source_doc_id, source_start).

    Words are what stands between ASCII white space; start counts them from 0. Occurrences are ordered by an unsigned
    hash of their whole text, then by doc_id (null last), then by place, and the source is the first one; so all but the
    first are reported. A passage that continues beyond what it shares with its source, along another one, is reported
    in several rows, that overlap. A passage that repeats within a text counts from where it no longer overlaps its
    first occurrence. A later copy of a whole text is reported as one passage. Null and empty texts, and those of fewer
    words, have none. Repeated rows are copies. Long texts are searched whole. An empty table gives an empty result.
    ``docs`` needs doc_id (an integer) and text; nothing else has an effect. ``parts`` is the number of super-batches,
    ``heavy`` the bytes from which a text's copies are kept out of them: neither changes the result.
    """

    def then(t: Texts, first, size, source, source_start, of) -> pa.Table:
        ids = lambda x: pa.array(x, mask=x == _NULL)
        return pa.table({"doc_id": ids(t.ids[of]), "start": first - t.first[of], "n_words": size, "source_doc_id": ids(source), "source_start": source_start})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    search = Repeats(own, block, least, parts, heavy)
    found = search.found(then, "doc_id long, start long, n_words long, source_doc_id long, source_start long")
    return found if search.heavy.isEmpty() else found.unionByName(search.heavy_copies(own))


def drop_repeated_passages(docs: DataFrame, block: int = BLOCK, least: int = LEAST, parts: int | None = None, heavy: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the words of repeated passages (see ``repeated_passages``) cut from their texts.

    The white space after a passage goes with it. n_chars, if there is such a column, becomes the length of a text that
    was cut. Rows of which nothing but white space is left are dropped, so all but the first of a long text's copies;
    null and empty texts stay as they were. Other columns are carried along, whatever their names. An empty table gives
    an empty result.
    """
    names = docs.columns

    def then(t: Texts, first, size, source, source_start, of) -> pa.Table:
        depth = np.bincount(first, minlength=len(t.hash) + 2) - np.bincount(first + size, minlength=len(t.hash) + 2)
        gone = np.cumsum(depth)[: len(t.hash)] > 0
        texts = t.column.to_pylist()
        empty = np.zeros(len(texts), bool)
        cut = np.zeros(len(texts), bool)
        for i in distinct(np.asarray(of, np.int64).copy()):
            a, b = t.first[i], t.first[i + 1]
            lost = gone[a:b]
            # a word reaches to where the next one begins, the first from the start of the text
            edges = np.concatenate((t.begin[a:b], [t.offsets[i + 1]]))
            edges[0] = t.offsets[i]
            change = np.flatnonzero(np.concatenate(([True], lost[1:] != lost[:-1])))
            left = [t.text[edges[x] : edges[y]].tobytes() for x, y in zip(change, [*change[1:], b - a]) if not lost[x]]
            texts[i] = b"".join(left).decode()
            cut[i], empty[i] = True, lost.all()
        out = {n: t.rows[n] for n in names}
        out["text"] = pa.array(texts, pa.string())
        if "n_chars" in out:
            lengths = out["n_chars"].to_pylist()
            out["n_chars"] = pa.array([len(x) if c else n for x, c, n in zip(texts, cut, lengths)], out["n_chars"].type)
        return pa.table(out).filter(pa.array(~empty))

    return Repeats(docs, block, least, parts, heavy).found(then, docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
