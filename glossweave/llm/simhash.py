"""Operator 2: near-duplicate documents by SimHash and the pigeonhole principle.

A document's fingerprint has 256 bits: bit j is the sign of the sum, over the distinct lower-cased words, of a random
+1 or -1 that the word has for j (Charikar 2002). The share of bits in which two fingerprints differ estimates the
angle between the word sets. Fingerprints that differ in at most ``radius`` bits are neighbours, and the documents of
one connected component of the neighbour graph form a group. No neighbours are missed.

The fingerprint is cut into eight words of 32 bits. Were each word of a pair to differ in more bits than it may, at the
default radius 5 in five words and 4 in three, the pair would differ in 5 * 6 + 3 * 5 = 45 bits or more; so by the
pigeonhole principle neighbours have a word that differs in no more than that. A word is cut into three parts of 10 or
11 bits, and by the same principle one of them differs in at most one bit, or, where the word may differ in 4, the first
part not at all (Manku et al. 2007, with a bit flipped in place of longer tables). Fingerprints of one bucket, a value of a
part, are compared in numpy with all of the buckets that are so close: first in the word, then in all bits.

Distinct fingerprints are dealt into blocks of about ``BLOCK``, and each pair of blocks is a task; where there are few
blocks, parts of a pair are tasks of their own. A task returns the components of what it found, not all pairs, and
where copies crowd the buckets it searches breadth-first and leaves out what is known to be one component. The
comparisons grow with the square of the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import distinct, fresh, lean, mix, pieces, slices, stored, table, text_buffers, words
from .components import connected_components

BITS = 256
FEATURE_BITS = 18
#: Differing bits of 256 at which two documents are still near copies: a cosine of 0.86 between their word sets.
RADIUS = 44
WORD_BITS = 32
#: Bits of a part that are looked at, at most: its buckets have a table.
WIDEST = 12
#: Fingerprints of one block, as a target; a task holds two blocks.
BLOCK = 1 << 19
#: Tasks that the search is cut into, as far as there are parts.
TASKS = 12
#: Pairs that are compared at once.
CHUNK = 1 << 17
#: Neighbours found in a bucket from which on components take the place of pairs.
CROWD = 1 << 18

_SIGNS: list[np.ndarray] = []


def signs() -> np.ndarray:
    """1 (for +1) or 0 (for -1) for each hashed word and bit, a byte each and eight in an integer; the same in every process."""
    if not _SIGNS:
        seeds = mix(np.arange(1, 1 + (BITS // 64 << FEATURE_BITS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _SIGNS.append(np.unpackbits(seeds.view(np.uint8)).view(np.uint64).reshape(1 << FEATURE_BITS, BITS // 8))
    return _SIGNS[0]


def fingerprints(texts: pa.Array) -> list[bytes | None]:
    """The fingerprint of each text; None where it has no word."""
    n = len(texts)
    hashes, _, _, row = words(*text_buffers(pc.utf8_lower(texts)), "alnum")
    keys = distinct((row.astype(np.uint64) << np.uint64(FEATURE_BITS)) | (hashes & np.uint64((1 << FEATURE_BITS) - 1)))
    of, feature = (keys >> np.uint64(FEATURE_BITS)).astype(np.int64), (keys & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)
    counts = np.bincount(of, minlength=n)
    starts = np.concatenate(([0], np.cumsum(counts)))
    out: list[bytes | None] = [None] * n
    for a, b in slices(counts, 20_000):
        full = np.flatnonzero(counts[a:b]) + a
        if not len(full):
            continue
        # sums of up to 255 words fit the bytes of an integer; longer texts are the sums of such parts
        parts = -(-counts[full] // 255)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(starts[full], parts) + 255 * part - starts[a]
        ones = np.add.reduceat(signs().take(feature[starts[a] : starts[b]], axis=0), begin, axis=0).view(np.uint8)
        ones = np.add.reduceat(ones, np.cumsum(parts) - parts, axis=0, dtype=np.int32)
        for i, raw in zip(full, np.packbits(2 * ones > counts[full][:, None], axis=1)):
            out[i] = raw.tobytes()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        for batch in (piece for whole in batches for piece in pieces(whole, 2)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fingerprints(batch.column(2)), pa.binary())], names=["doc_id", "th", "fp"])
    finally:
        # 64 MB that an idle worker would keep through the stages that follow
        _SIGNS.clear()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) for every row; th is a hash of the text, fp null where the text is null or has no word."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(_fingerprint_batches), "doc_id long, th long, fp binary")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(a ^ b)
    return sum(ones[..., w].astype(np.int16) for w in range(BITS // 64))


def star_edges(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Of one block: edges from each member of a component of the neighbour graph to its first member.

    A breadth-first search that compares a member only with those not reached yet: as good as all pairs, and linear
    where the members are copies of one another.
    """
    left = np.arange(len(fp))
    while len(left):
        root, left = int(left[0]), left[1:]
        frontier = [root]
        while frontier and len(left):
            near = distances(fp[left], fp[frontier.pop()]) <= radius
            reached = left[near]
            left = left[~near]
            frontier += reached.tolist()
            for x in reached.tolist():
                yield x, root


def search_parts(radius: int) -> list[tuple[int, int, int, int, int]]:
    """(word, bits in which it may differ, first bit of a part of it, bits of the part, bits in which the part may differ).

    Neighbours meet the bounds of some word and of some part of it, as the bounds plus one sum to more than what is allowed.
    """
    out, words_ = [], BITS // WORD_BITS
    for word in range(words_):
        units = (radius + 1 + words_ - 1 - word) // words_
        parts = -(-units // 2)
        borders = [WORD_BITS * p // parts for p in range(parts + 1)] if parts else []
        for p in range(parts):
            out.append((word, units - 1, borders[p], min(borders[p + 1] - borders[p], WIDEST), int(p > 0 or units % 2 == 0)))
    return out


def word_values(fp: np.ndarray, word: int) -> np.ndarray:
    return np.ascontiguousarray(fp.view(np.uint32).reshape(len(fp), BITS // WORD_BITS)[:, word])


def joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each one's component, once edges (u, v) join those of ``root``."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def components_of(fp: np.ndarray, split: int, parts: list[tuple[int, int, int, int, int]], radius: int) -> np.ndarray:
    """The least member of each fingerprint's component, by the neighbours that parts find between the first ``split`` and the rest.

    Where ``split`` is all of them, the neighbours among them are found.
    """
    root, own = np.arange(len(fp)), split == len(fp)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    pending = 0

    def add(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal pending
        us.append(u)
        vs.append(v)
        pending += len(u)
        if pending > 200_000:
            settle()

    def settle() -> None:
        nonlocal root, pending
        if pending:
            root = joined(root, np.concatenate(us), np.concatenate(vs))
            us.clear()
            vs.clear()
            pending = 0

    xor, bits = np.empty(CHUNK, np.uint32), np.empty(CHUNK, np.uint8)

    def compare(x: np.ndarray, y: np.ndarray, x_word: np.ndarray, y_word: np.ndarray, most: int) -> list[tuple[np.ndarray, ...]]:
        """Finds the neighbours of x in y; or, where they are a crowd, returns what is left to compare."""
        seen = 0
        for c in range(0, len(y), CHUNK):
            wide = min(CHUNK, len(y) - c)
            step = max(1, CHUNK // wide)
            for a in range(0, len(x), step):
                tall = min(step, len(x) - a)
                n = tall * wide
                np.bitwise_xor(x_word[a : a + tall, None], y_word[None, c : c + wide], out=xor[:n].reshape(tall, wide))
                near = np.flatnonzero(np.bitwise_count(xor[:n], out=bits[:n]) <= most)
                if not len(near):
                    continue
                down = near // wide
                u, v = x[down + a], y[near - down * wide + c]
                close = (distances(fp[u], fp[v]) <= radius) & (u != v)
                if close.any():
                    add(u[close], v[close])
                seen += np.count_nonzero(close)
                if seen > CROWD:
                    settle()
                    both = np.union1d(x, y)
                    found, size = np.unique(root[both], return_counts=True)
                    of_x, of_y = root[x] == found[size.argmax()], root[y] == found[size.argmax()]
                    if 16 * np.count_nonzero(of_x) * np.count_nonzero(of_y) < len(x) * len(y):
                        add(*both[np.array([*star_edges(fp[both], radius)])].T)
                        return []
                    return [(x[~of_x], y, x_word[~of_x], y_word), (x[of_x], y[~of_y], x_word[of_x], y_word[~of_y])]
        return []

    for word, most, first, width, slack in parts:
        value = word_values(fp, word)
        part = value >> np.uint32(first) & np.uint32((1 << width) - 1)
        left = np.argsort(part[:split], kind="stable")
        right = left if own else split + np.argsort(part[split:], kind="stable")
        l_begin, begin = (np.searchsorted(part[side], np.arange((1 << width) + 1)).tolist() for side in (left, right))
        l_word, r_word = value[left], value[right]
        flips = [0] + [1 << b for b in range(width) if slack]
        for bucket in range(1 << width):
            # of two buckets of the same fingerprints, the lesser is compared with the other
            runs = [slice(begin[b], begin[b + 1]) for b in (bucket ^ f for f in flips) if begin[b] < begin[b + 1] and (b >= bucket or not own)]
            here = slice(l_begin[bucket], l_begin[bucket + 1])
            if runs and here.start < here.stop:
                todo = [(left[here], np.concatenate([right[r] for r in runs]), l_word[here], np.concatenate([r_word[r] for r in runs]))]
                while todo:
                    todo += compare(*todo.pop(), most)
        settle()
    return root


def _neighbours(radius: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, raws, group = [], [], 0
        for batch in batches:
            if len(batch):
                group = batch.column(0)[0].as_py() % groups
                sides.append(batch.column(1).to_numpy(zero_copy_only=False))
                raws.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(batch), BITS // 64))
        if not sides:
            return
        side, fp = np.concatenate(sides), np.concatenate(raws)
        raws.clear()
        split = int((side == 0).sum())
        if not split:
            return
        fp = np.ascontiguousarray(fp[np.argsort(side, kind="stable")])
        root = components_of(fp, split, search_parts(radius)[group::groups], radius)
        member = np.flatnonzero(root != np.arange(len(fp)))
        for at in range(0, len(member), 50_000):
            u = member[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in fp[some]], pa.binary()) for some in (u, root[u])], names=["u", "v"])

    return run


def neighbour_edges(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints; their components are those of all neighbours, without exception.

    Task (low, high, group) has the fingerprints of two blocks, or one, and looks at every ``groups``-th part. A task
    whose second block is empty compares the first one with itself, which adds nothing wrong.
    """
    nodes = stored(fps.where("fp is not null").select("fp").distinct())
    blocks = max(1, -(-nodes.count() // block))
    pairs = [(low, high) for low in range(blocks) for high in range(low, blocks)]
    groups = min(len(search_parts(radius)), max(1, -(-TASKS // len(pairs))))
    of = [[(t * groups + g, int(b == high != low)) for t, (low, high) in enumerate(pairs) if b in (low, high) for g in range(groups)] for b in range(blocks)]
    tasks = F.array(*(F.array(*(F.struct(F.lit(t).alias("task"), F.lit(side).alias("side")) for t, side in each)) for each in of))
    dealt = nodes.select(F.explode(tasks[F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int")]).alias("to"), "fp").select("to.task", "to.side", "fp")
    return dealt.repartitionById(len(pairs) * groups, "task").mapInArrow(lean(_neighbours(radius, groups)), "u binary, v binary")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, any others) as (doc_id, th, group_id, group_size, kept).

    group_id is the least doc_id of the group; the row that is kept is the one of the least doc_id, of the least text
    hash among these. A null doc_id comes last. A null text, or one without a word, is a group by itself and kept.
    Texts with the same words in another order or spelling of case are copies. Repeated rows are copies: one is kept.
    Long texts count with all of their words. A class of copies that holds much of the corpus is one row a fingerprint
    in the search, and its rows are counted before they are brought together. An empty table gives an empty result. Other columns, whatever their names, have no effect.
    """
    fps = stored(fingerprint_table(docs))
    nodes = connected_components(stored(neighbour_edges(fps, radius)))
    grouped = fps.join(nodes.select(F.col("node").alias("fp"), "root"), "fp", "left").select("doc_id", "th", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("h")))
    groups = grouped.where("root is not null").groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    copy = F.row_number().over(W.partitionBy("root", "doc_id", "th").orderBy("th"))
    some = grouped.where("root is not null").withColumn("copy", copy).join(groups, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.h")) & (F.col("copy") == 1)
    alone = grouped.where("root is null").select("doc_id", "th", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return some.select("doc_id", "th", F.col("first.id").alias("group_id"), "group_size", kept.alias("kept")).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, whole, without those that ``near_duplicates`` doesn't keep.

    Rows that agree in doc_id and text can't be told apart; all but one of them go, whichever. Null and empty texts stay,
    long ones are judged by all of their words; an empty table gives an empty result.

    The verdicts grow with the corpus, so they are never broadcast: at every size both sides are shuffled by doc_id and
    text hash and merged, which a hot key can't overload, as it is split.
    """
    verdicts = stored(near_duplicates(docs, radius))
    keys = verdicts.groupBy("doc_id", "th").agg(F.count_if("kept").alias("keep"), F.count(F.lit(1)).alias("rows"))
    fate = stored(keys.where("keep < rows"))
    th, ident, hashed = (fresh(docs, x) for x in ("gw_th", "gw_id", "gw_hash"))

    def against(rows: DataFrame, condition: str, how: str) -> DataFrame:
        named = fate.where(condition).select(F.col("doc_id").alias(ident), F.col("th").alias(hashed)).hint("merge")
        return rows.join(named, (F.col(th) == F.col(hashed)) & F.col("doc_id").eqNullSafe(F.col(ident)), how)

    own = docs.withColumn(th, F.xxhash64("text"))
    out = against(own, "true", "left_anti")
    if not fate.where("keep > 0").isEmpty():
        out = out.unionByName(against(own, "keep > 0", "left_semi").dropDuplicates(["doc_id", th]))
    return out.select(docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th")
