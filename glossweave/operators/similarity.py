"""Tree edit distance of dependency trees, by sentence pairs, against prototypes, and as a search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.blocks import Block, Kernel, U
from glossweave.operators.embeddings import PAIRS, sample_pairs

#: Trees to compare with: (head, tag, relation) of each word.
PROTOTYPES = {"sv": [(2, "PRON", "nsubj"), (0, "VERB", "root"), (2, "PUNCT", "punct")], "svo": [(2, "DET", "det"), (3, "NOUN", "nsubj"), (0, "VERB", "root"), (5, "DET", "det"), (3, "NOUN", "obj"), (3, "PUNCT", "punct")]}
TREE = "array<struct<id:int,head:int,label:string>>"


class _Ordered:
    """A tree in postorder: labels, the leftmost leaf below each node, and the roots of the subproblems."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        known = {i for i, _, _ in rows}
        below: dict[int, list[int]] = {}
        labels = {-1: "ROOT", **{i: x for i, _, x in rows}}
        for i, h, _ in rows:
            below.setdefault(h if h in known and h != i else -1, []).append(i)
        self.labels: list[str] = []
        self.left: list[int] = []
        # without recursion, as a sentence may be one long chain; what no root reaches hangs on none and is left out
        stack: list[tuple[int, int, int]] = [(-1, 0, -1)]
        while stack:
            node, at, leaf = stack.pop()
            children = below.get(node, [])
            if at < len(children):
                stack += [(node, at + 1, leaf), (children[at], 0, -1)]
                continue
            first = len(self.labels) if leaf < 0 else leaf
            self.labels.append(labels[node])
            self.left.append(first)
            if stack and stack[-1][2] < 0:
                stack[-1] = (*stack[-1][:2], first)
        seen: set[int] = set()
        self.keys = sorted(i for i in range(len(self.left) - 1, -1, -1) if self.left[i] not in seen and not seen.add(self.left[i]))


def tree_edit_distance(a: list[tuple[int, int, str]], b: list[tuple[int, int, str]], normalize: bool = True) -> float:
    """Zhang and Shasha's distance of unit costs between two trees of (id, head, label) under a common root.

    Words whose head isn't there hang on the root. Normalized it is over one more than the words of the longer sentence.
    """
    x, y = _Ordered(a), _Ordered(b)
    n, m = len(x.labels), len(y.labels)
    tree = [[0] * m for _ in range(n)]
    for i in x.keys:
        for j in y.keys:
            li, lj = x.left[i], y.left[j]
            rows, columns = i - li + 2, j - lj + 2
            d = [[0] * columns for _ in range(rows)]
            for s in range(1, rows):
                d[s][0] = s
            d[0] = list(range(columns))
            for s in range(1, rows):
                p = li + s - 1
                before, now = d[s - 1], d[s]
                for t in range(1, columns):
                    q = lj + t - 1
                    least = min(before[t], now[t - 1]) + 1
                    if x.left[p] == li and y.left[q] == lj:
                        now[t] = min(least, before[t - 1] + (x.labels[p] != y.labels[q]))
                        tree[p][q] = now[t]
                    else:
                        now[t] = min(least, d[x.left[p] - li][y.left[q] - lj] + tree[p][q])
    found = tree[n - 1][m - 1]
    return found / (max(len(a), len(b)) + 1) if normalize else float(found)


class Forest:
    """Trees under a common root in postorder, flat: off (where each begins; one more), left (the leftmost leaf below a node), label, and the roots of subproblems (keys) with their heights."""

    def __init__(self, off: np.ndarray, left: np.ndarray, label: np.ndarray, height: np.ndarray):
        self.off, self.left, self.label = off, left, label
        tree = np.repeat(np.arange(len(off) - 1), np.diff(off))
        last = np.zeros(len(left), np.int64)
        np.maximum.at(last, off[tree] + left, np.arange(len(left)))
        key = np.flatnonzero(last[off[tree] + left] == np.arange(len(left)))
        order = np.lexsort((key, height[key], tree[key]))
        self.key, self.key_height, self.key_tree = key[order], height[key][order], tree[key][order]

    def keys(self, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of one height, and where each tree's begin and how many they are."""
        some = self.key_height == height
        count = np.bincount(self.key_tree[some], minlength=len(self.off) - 1)
        return self.key[some], np.cumsum(count) - count, count

    @staticmethod
    def of_rows(rows: list[tuple[int, int, int]]) -> Forest:
        """One tree of (id, head, label) with numbers from 1, in the order of ids."""
        made = _Ordered([(i, h, str(x)) for i, h, x in rows])
        n = len(made.left)
        height = np.zeros(n, np.int64)
        for i in range(n):
            inner = [height[j] for j in range(made.left[i], i)]
            height[i] = 1 + max(inner) if inner else 0
        return Forest(np.array([0, n]), np.array(made.left), np.array([-1 if x == "ROOT" else int(x) for x in made.labels]), height)


def forest_of(b: Block) -> Forest:
    """The trees of a block's sentences, with tags as labels: places in postorder follow from the sizes of subtrees, level by level."""
    depth = b.path_sums(np.ones(b.n, np.int64))
    size, height = np.ones(b.n, np.int64), np.zeros(b.n, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.concatenate((np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 1)), [b.n]))
    levels = [by_depth[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
    for at in reversed(levels):
        np.add.at(size, b.parent[at], size[at])
        np.maximum.at(height, b.parent[at], height[at] + 1)
    start = np.zeros(b.n, np.int64)
    for at in levels:  # in the order of the text, so that siblings are
        at = at[np.argsort(b.parent[at], kind="stable")]
        total = np.cumsum(size[at]) - size[at]
        first = np.concatenate(([True], np.diff(b.parent[at]) != 0))
        start[at] = start[b.parent[at]] + total - np.maximum.accumulate(np.where(first, total, 0))
    off = b.off + np.arange(len(b.off))
    left, label, high = (np.empty(b.n + len(b.off) - 1, np.int64) for _ in range(3))
    node = off[b.s] + start + size - 1
    left[node], label[node], high[node] = start, b.upos, height
    top = off[1:] - 1
    left[top], label[top] = 0, -1
    high[top] = b.maxima(height) + 1
    return Forest(off, left, label, high)


#: Cells of forests' distances that are held at once.
CELLS = 1 << 20


def forest_distances(x: Forest, y: Forest, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Zhang and Shasha's distance of unit costs between trees a[i] of x and b[i] of y.

    Subproblems of two heights don't need one another's results but those of lesser heights, so all of them, of all
    pairs, are worked out at once, row by row; within a row, where a cell needs the one before it, by running minima.
    """
    out = np.zeros(len(a), np.int64)
    nx, ny = np.diff(x.off)[a], np.diff(y.off)[b]
    order = np.lexsort((nx, ny))
    area = np.cumsum((nx * ny)[order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(area, (area[at - 1] if at else 0) + 4 * CELLS, "right")))
        some = order[at:to]
        out[some] = _distances(x, y, a[some], b[some], nx[some], ny[some])
        at = to
    return out


def _distances(x: Forest, y: Forest, a: np.ndarray, b: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    area = nx * ny
    base = np.cumsum(area) - area
    kind = np.int16 if int((nx + ny).max()) < 30_000 else np.int32
    tree = np.zeros(int(area.sum()), kind)
    for hx in np.unique(x.key_height):
        kx, fx, cx = x.keys(hx)
        for hy in np.unique(y.key_height):
            ky, fy, cy = y.keys(hy)
            many = cx[a] * cy[b]
            pair = np.repeat(np.arange(len(a)), many)
            if not len(pair):
                continue
            k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            i, j = kx[fx[a[pair]] + k // cy[b[pair]]], ky[fy[b[pair]] + k % cy[b[pair]]]
            ox, oy = x.off[a[pair]], y.off[b[pair]]
            li, lj = x.left[i], y.left[j]
            rows, columns = i - ox - li + 1, j - oy - lj + 1
            if rows.max() == 1 and columns.max() == 1:  # a leaf and a leaf
                tree[base[pair] + li * ny[pair] + lj] = x.label[i] != y.label[j]
                continue
            # of like size, so that little is padding
            wide = np.ceil(np.log2(columns)).astype(np.int64)
            order = np.lexsort((rows, wide))
            ends = np.append(np.flatnonzero(np.diff(wide[order])) + 1, len(order))
            at = 0
            while at < len(order):
                e = order[at : ends[np.searchsorted(ends, at, "right")]]
                while len(e) > 1 and len(e) * int(rows[e[-1]] + 1) * int(columns[e].max() + 1) > 2 * CELLS:
                    e = e[: len(e) // 2]
                at += len(e)
                _subproblems(x, y, tree, kind, ox[e], oy[e], li[e], lj[e], rows[e], columns[e], base[pair[e]], ny[pair[e]])
    return tree[base + area - 1].astype(np.int64)


def _subproblems(x: Forest, y: Forest, tree: np.ndarray, kind: type, ox: np.ndarray, oy: np.ndarray, li: np.ndarray, lj: np.ndarray, rows: np.ndarray, columns: np.ndarray, base: np.ndarray, ny: np.ndarray) -> None:
    """Of subproblems in the order of their rows: those that have ended are the first."""
    n, r, c = len(ox), int(rows[-1]), int(columns.max())
    d = np.empty((r + 1, n, c + 1), kind)
    steps = np.arange(c + 1, dtype=kind)
    d[0] = steps
    t = np.arange(c)
    inside = t < columns[:, None]
    q = lj[:, None] + np.minimum(t, columns[:, None] - 1)
    yleft, ylabel = y.left[oy[:, None] + q], y.label[oy[:, None] + q].astype(np.int8)
    on_y = inside & (yleft == lj[:, None])
    places = np.arange(n)[:, None] * (c + 1) + np.where(inside, yleft - lj[:, None], 0)
    cell = base[:, None] + q
    flat = d.reshape(-1)
    for s in range(1, r + 1):
        k = int(np.searchsorted(rows, s))
        p = li[k:] + s - 1
        xleft, xlabel = x.left[ox[k:] + p], x.label[ox[k:] + p].astype(np.int8)
        on_x = xleft == li[k:]
        before, now = d[s - 1, k:], d[s, k:]
        at = cell[k:] + (p * ny[k:])[:, None]
        back = flat[places[k:] + ((xleft - li[k:]) * (n * (c + 1)))[:, None]]
        both = on_x[:, None] & on_y[k:]
        least = np.where(both, before[:, :-1] + (xlabel[:, None] != ylabel[k:]), back + tree[at])
        now[:, 0] = s
        np.minimum(least, before[:, 1:] + 1, out=now[:, 1:])
        now -= steps
        np.minimum.accumulate(now, axis=1, out=now)
        now += steps
        if on_x.any():
            tree[at[both]] = now[:, 1:][both]


def adjacent_of(b: Block) -> dict:
    """``sentence_pairs`` of neighbours in annotated documents, by tags."""
    one = np.flatnonzero(b.d[1:] == b.d[:-1])
    words = np.diff(b.off)
    far = forest_distances(f := forest_of(b), f, one, one + 1)
    return {"doc_id": b.doc.take(pa.array(one)), "sentence_a": b.sentence_id[one], "sentence_b": b.sentence_id[one + 1], "ted": far / (np.maximum(words[one], words[one + 1]) + 1)}


def prototype_of(prototype: str) -> Kernel:
    """``prototype_distances`` of annotated documents, by tags."""
    words = PROTOTYPES[prototype]

    def run(b: Block) -> dict:
        other = Forest.of_rows([(i + 1, h, U[u]) for i, (h, u, _) in enumerate(words)])
        every = np.arange(len(b.d))
        far = forest_distances(forest_of(b), other, every, np.zeros(len(b.d), np.int64))
        return {"doc_id": b.doc, "sentence_id": b.sentence_id, "ted": far / (np.maximum(np.diff(b.off), len(words)) + 1)}

    return run


def trees(tokens: DataFrame, label: str = "upos", include_punct: bool = True) -> DataFrame:
    """(doc_id, sentence_id, tree, place): sentences packed to arrays (id, head, label); ``label`` is upos, dep_rel or combined."""
    names: dict[str, Column] = {"upos": F.col("upos"), "dep_rel": F.col("dep_rel"), "combined": F.concat_ws("_", "upos", "dep_rel")}
    if label not in names:
        raise ValueError(f"label is one of {sorted(names)}")
    t = tokens if include_punct else tokens.where("upos is null or upos <> 'PUNCT'")
    t = t.withColumns({"id": F.expr("try_cast(token_id AS INT)"), "head": F.coalesce(F.expr("try_cast(head_token_id AS INT)"), F.lit(0))}).where("id is not null")
    packed = t.groupBy("doc_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("id", "head", names[label].alias("label")))).alias("tree"))
    return packed.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("sentence_id")))


def ted(a: Column, b: Column, normalize: bool = True) -> Column:
    """The distance of two columns of trees."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = lambda t: [(x["id"], x["head"], x["label"]) for x in t]
        known: dict[tuple, float] = {}
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            pair = (tuple(rows(x)), tuple(rows(y)))
            if pair not in known:
                known[pair] = tree_edit_distance(list(pair[0]), list(pair[1]), normalize)
            out.append(known[pair])
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def sentence_pairs(tokens: DataFrame, label: str = "upos", normalize: bool = True, adjacent: bool = True, include_punct: bool = True, most: int = PAIRS) -> DataFrame:
    """(doc_id, sentence_a, sentence_b, ted) of each sentence and the next one there is, or of a document's pairs.

    Of a document with more than ``most`` pairs so many are taken, evenly spaced.
    """
    t = trees(tokens, label, include_punct)
    if adjacent:
        by = W.partitionBy("doc_id").orderBy("sentence_id")
        pairs = t.select("doc_id", F.col("sentence_id").alias("sentence_a"), F.lead("sentence_id").over(by).alias("sentence_b"), F.col("tree").alias("a"), F.lead("tree").over(by).alias("b")).where("b is not null")
    else:

        def chosen(sizes: pa.Array) -> pa.Array:
            out = []
            for n in sizes.to_pylist():
                i, j = sample_pairs(n, most)
                out.append([{"i": int(x) + 1, "j": int(y) + 1} for x, y in zip(i, j)])
            return pa.array(out, pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))

        wanted = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.inline(F.arrow_udf(chosen, "array<struct<i:int,j:int>>")("n")))
        left = t.select("doc_id", F.col("place").alias("i"), F.col("sentence_id").alias("sentence_a"), F.col("tree").alias("a"))
        right = t.select("doc_id", F.col("place").alias("j"), F.col("sentence_id").alias("sentence_b"), F.col("tree").alias("b"))
        pairs = wanted.join(left, ["doc_id", "i"]).join(right, ["doc_id", "j"])
    return pairs.select("doc_id", "sentence_a", "sentence_b", ted(F.col("a"), F.col("b"), normalize).alias("ted"))


def document_similarity(tokens: DataFrame, label: str = "upos", include_punct: bool = True) -> DataFrame:
    """Mean distance, one less it, and number of pairs of each document: local of neighbours, global of all pairs."""
    parts = []
    for name, adjacent in (("local", True), ("global", False)):
        p = sentence_pairs(tokens, label, True, adjacent, include_punct)
        parts.append(p.groupBy("doc_id").agg(F.avg("ted").alias(f"{name}_ted"), (1 - F.avg("ted")).alias(f"{name}_similarity"), F.count("ted").alias(f"n_{name}_pairs")))
    return parts[0].join(parts[1], "doc_id", "full")


def prototype_distances(tokens: DataFrame, prototype: str | list[tuple[int, str, str]] = "svo", label: str = "upos", normalize: bool = True, include_punct: bool = True) -> DataFrame:
    """(doc_id, sentence_id, ted) of each sentence to a prototype, by name or as (head, tag, relation) of its words."""
    words = PROTOTYPES[prototype] if isinstance(prototype, str) else prototype
    name = {"upos": lambda u, r: u, "dep_rel": lambda u, r: r, "combined": lambda u, r: f"{u}_{r}"}[label]
    tree = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(h).alias("head"), F.lit(name(u, r)).alias("label")) for i, (h, u, r) in enumerate(words) if include_punct or u != "PUNCT"])
    return trees(tokens, label, include_punct).select("doc_id", "sentence_id", ted(F.col("tree"), tree, normalize).alias("ted"))


def find_by_structure(tokens: DataFrame, n: int = 10, **how) -> DataFrame:
    """The ``n`` sentences nearest to a prototype, ties in the order of the text."""
    return prototype_distances(tokens, **how).orderBy("ted", "doc_id", "sentence_id").limit(n)


def search_by_structure(tokens: DataFrame, threshold: float, n: int | None = None, output: str | None = None, **how) -> DataFrame:
    """The sentences within ``threshold`` of a prototype, nearest first, with their text, at most ``n``; also as a TSV file in ``output``."""
    near = prototype_distances(tokens, **how).where(F.col("ted") <= threshold + 1e-9)
    words = tokens.groupBy("doc_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "token"))).alias("w"))
    found = near.join(words, ["doc_id", "sentence_id"]).select("doc_id", "sentence_id", "ted", F.array_join(F.col("w.token"), " ").alias("sentence")).orderBy("ted", "doc_id", "sentence_id")
    found = found.limit(n) if n else found
    if output:
        found.coalesce(1).write.mode("overwrite").csv(output, sep="\t", header=True)
    return found
