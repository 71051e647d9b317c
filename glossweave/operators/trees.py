"""Dependency trees: paths to the root, heights, degrees, Yngve and memory costs, arc directions and distances.

All work on whole sentences at once. Tokens are partitioned by sentence once, and everything below reads that: windows,
the packing of a sentence into an array, and what a token's children add up to, for which no table is joined with itself.
In the array pointers double: after log2(n) steps every token knows the sum along its path, whatever the shape of the
tree; cycles and missing heads leave null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import PROLOGUE
from glossweave.blocks import Block, U, deviation, ratio
from glossweave.scratch import stored

KEY = ("doc_id", "paragraph_id", "sentence_id")
REFERENTS = ("NOUN", "PROPN", "VERB")


def numbered(tokens: DataFrame, ranges: bool = False) -> DataFrame:
    """Adds id and head as integers. Range rows (30-31) and empty nodes (8.1) have no such id; they are dropped unless ``ranges``."""
    t = tokens.withColumns({"id": F.expr("try_cast(token_id AS INT)"), "head": F.expr("try_cast(head_token_id AS INT)")})
    return (t if ranges else t.where("id is not null")).repartition(*KEY)


_PARENT = "CASE WHEN x.head = 0 THEN 0 WHEN x.head > 0 AND get(gw_t, x.head - 1).id = x.head THEN x.head ELSE cast(nullif(array_position(gw_t.id, x.head), 0) AS INT) END"
_STEPS = "sequence(1, cast(ceil(log2(size(gw_t))) AS INT) + 1)"


def _packed(t: DataFrame, extra: list[str]) -> DataFrame:
    row = F.struct(*[c for c in t.columns if c not in KEY and c not in extra])
    return t.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("id", "head", *extra, row.alias("row")))).alias("gw_t"))


def path_sums(tokens: DataFrame, **weights: Column) -> DataFrame:
    """Adds, to tokens with id and head, the sum of each weight over a token and its ancestors but the root; null where no root is reached."""
    names = [f"gw_{w}" for w in weights]
    t = tokens.withColumns({n: F.when(F.col("head") == 0, 0).otherwise(w).cast("int") for n, w in zip(names, weights.values())})
    zero = ", ".join(f"'{n}', gw_t.{n}" for n in names)
    step = ", ".join(f"'{n}', transform(s.{n}, (v, i) -> if(get(s.p, i) > 0, v + get(s.{n}, get(s.p, i) - 1), v))" for n in names)
    done = ", ".join(f"'{n}', if(get(s.p, i) = 0, get(s.{n}, i), NULL)" for n in names)
    summed = F.expr(
        f"aggregate({_STEPS}, named_struct('p', transform(gw_t, x -> {_PARENT}), {zero}),"
        f" (s, k) -> named_struct('p', transform(s.p, x -> if(x > 0, get(s.p, x - 1), x)), {step}),"
        f" s -> transform(gw_t, (x, i) -> named_struct('row', x.row, {done})))"
    )
    out = _packed(t, names).select(*KEY, F.explode(summed).alias("x"))
    return out.select(*KEY, "x.row.*", *[F.col(f"x.{n}").alias(w) for n, w in zip(names, weights)])


def nearest_flagged(tokens: DataFrame, flag: Column, name: str) -> DataFrame:
    """Adds the id of the token itself or its nearest ancestor for which ``flag`` holds; null where there is none."""
    t = tokens.withColumn("gw_flag", F.coalesce(flag, F.lit(False)))
    found = F.expr(
        f"aggregate({_STEPS}, transform(gw_t, (x, i) -> if(x.gw_flag, i + 1, {_PARENT})), (p, k) -> transform(p, x -> if(x > 0, get(p, x - 1), x)),"
        " p -> transform(gw_t, (x, i) -> named_struct('row', x.row, 'of', if(get(p, i) > 0 AND get(gw_t, get(p, i) - 1).gw_flag, get(gw_t, get(p, i) - 1).id, NULL))))"
    )
    return _packed(t, ["gw_flag"]).select(*KEY, F.explode(found).alias("x")).select(*KEY, "x.row.*", F.col("x.of").alias(name))


def with_children(t: DataFrame, passed: dict[str, Column], **aggregates: Column) -> DataFrame:
    """Adds aggregates over the ``passed`` values of a token's children, to tokens with id and head.

    Each token is there twice, under its own id and, with what it passes on, under its head's; grouping by id within the
    sentence brings both together, where they already are. Rows without an id have groups of their own.
    """
    child = F.struct(*[c.alias(n) for n, c in passed.items()])
    own = F.struct(*t.columns)
    node = F.coalesce(F.col("id"), -F.col("term_id") - 1) if "term_id" in t.columns else F.col("id")
    both = F.array(F.struct(node.alias("node"), own.alias("own"), F.lit(None).cast(_type(t, child)).alias("child")), F.struct(F.when(F.col("head") > 0, F.col("head")).alias("node"), F.lit(None).cast(_type(t, own)).alias("own"), child.alias("child")))
    each = t.select(*KEY, F.inline(both)).where("node is not null")
    grouped = each.groupBy(*KEY, "node").agg(F.first("own", ignorenulls=True).alias("own"), *[c.alias(n) for n, c in aggregates.items()])
    return grouped.where("own is not null").select("own.*", *aggregates)


def _type(t: DataFrame, c: Column) -> str:
    return t.select(c.alias("x")).schema["x"].dataType.simpleString()


def tree_tokens(tokens: DataFrame) -> DataFrame:
    """(KEY, id, head, punct, ref, depth, yngve) of the tokens that have an id and a head."""
    t = numbered(tokens.where("head_token_id is not null")).where("head is not null")
    punct = F.coalesce(F.col("upos") == "PUNCT", F.lit(True))  # a token without a tag counts with punctuation, where that is left out
    t = t.select(*KEY, "id", "head", punct.alias("punct"), F.coalesce(F.col("upos").isin(*REFERENTS), F.lit(False)).cast("int").alias("ref"))
    siblings = W.partitionBy(*KEY, "head")
    return path_sums(t.withColumn("right", F.count(F.lit(1)).over(siblings) - F.row_number().over(siblings.orderBy("id"))), depth=F.lit(1), yngve=F.col("right"))


def _variance(c: Column) -> Column:
    """The population's, of integers: exact up to the one division."""
    n, c = F.count(c), c.cast("long")
    return F.try_divide((n * F.sum(c * c) - F.sum(c) * F.sum(c)).cast("double"), (n * n).cast("double"))


def sentence_tree_stats(tokens: DataFrame, include_punct: bool = True) -> DataFrame:
    """Heights, degrees, Yngve depth and incomplete dependencies of each sentence.

    Depths and Yngve depths are those in the whole tree; tokens from which no root is reached, and punctuation where
    that is left out, are then not counted, and a sentence without a token that counts has zeros. Incomplete
    dependencies are Gibson's: at each place, over the arcs to a later head that are open there, the new referents since
    they opened; by running sums, not by comparing arcs with places.
    """
    t = tree_tokens(tokens)
    counts = F.col("depth").isNotNull() if include_punct else F.col("depth").isNotNull() & ~F.col("punct")
    by = W.partitionBy(*KEY).orderBy("id")
    t = t.withColumn("counts", counts).withColumn("refs", F.sum(F.when(F.col("counts"), F.col("ref")).otherwise(0)).over(by))
    left = F.col("counts") & (F.col("head") > F.col("id"))
    passed = {"counted": F.col("counts"), "closes": left.cast("int"), "closed": F.when(left, F.col("refs")).otherwise(0)}
    t = with_children(t, passed, degree=F.count_if("child.counted"), closes=F.coalesce(F.sum("child.closes"), F.lit(0)), closed=F.coalesce(F.sum("child.closed"), F.lit(0)))
    opens = left.cast("int")
    cost = F.col("refs") * (F.sum(opens).over(by) - F.sum("closes").over(by)) - (F.sum(opens * F.col("refs")).over(by) - F.sum("closed").over(by))
    t = t.withColumn("cost", cost)
    of = lambda c: F.when(F.col("counts"), F.col(c))
    n = F.count_if("counts")
    leaves = F.count_if(F.col("counts") & (F.col("degree") == 0))
    some = lambda c: F.coalesce(c, F.lit(0))
    return t.groupBy(*KEY).agg(
        some(F.max(of("depth"))).alias("max_path"),
        some(F.avg(of("depth"))).alias("avg_dependency_depth"),
        F.when(n > 1, F.sum(of("depth")) / F.nullif(n - 1, F.lit(0))).otherwise(0.0).alias("avg_dependency_depth_adj"),
        F.when(n > 1, F.stddev_samp(of("depth"))).otherwise(0.0).alias("sd_depth"),
        some(_variance(of("depth"))).alias("depth_var"),
        some(F.avg(of("degree"))).alias("branching_factor"),
        some(F.max(of("degree"))).alias("max_degree"),
        some(_variance(of("degree"))).alias("degree_var"),
        leaves.alias("leaf_count"),
        some(F.try_divide(leaves, n)).alias("prop_leaves"),
        some(F.sum(of("depth"))).alias("count_path"),
        n.alias("sentence_length"),
        some(F.max(of("cost"))).alias("max_incomplete_deps"),
        some(F.avg(of("cost"))).alias("avg_incomplete_deps"),
        some(F.max(of("cost")) / F.greatest(n, F.lit(1))).alias("max_incomplete_deps_adj"),
        some(F.avg(of("cost")) / F.greatest(n, F.lit(1))).alias("avg_incomplete_deps_adj"),
        some(F.avg(of("yngve"))).alias("yngve"),
        some(F.max(of("yngve"))).alias("max_yngve"),
        F.when(n > 1, F.stddev_samp(of("yngve"))).otherwise(0.0).alias("sd_yngve"),
    )


def arc_directions(tokens: DataFrame, include_punct: bool = False) -> DataFrame:
    """For each token: its place among the words, whether its head follows or precedes, how far it is, and the referents strictly in between.

    Punctuation has no place and no direction unless ``include_punct``; a word whose head is punctuation has a direction
    but no distance. Tokens without an id, or without a head, have neither.
    """
    t = numbered(tokens, ranges=True)
    word = F.col("id").isNotNull() & (F.lit(include_punct) | F.coalesce(F.col("upos") != "PUNCT", F.lit(False)))
    by = W.partitionBy(*KEY)
    ref = F.coalesce(F.col("upos").isin(*REFERENTS), F.lit(False)).cast("int")
    t = t.select(*KEY, "term_id", "token_id", "id", "head", ref.alias("ref"), word.alias("word"))
    running = by.orderBy(F.col("id").asc_nulls_first(), "term_id")
    t = t.withColumns({"sent_len": F.count_if("word").over(by), "at": F.sum(F.col("word").cast("int")).over(running), "refs": F.sum("ref").over(running)})
    # what a token needs of its head: each head passes its place on to the group of those that point to it
    asks = F.when((F.col("head") > 0) & F.col("word"), F.col("head"))
    own = F.struct("term_id", "token_id", "id", "head", "ref", "word", "sent_len", "at", "refs")
    told = F.struct(F.when(F.col("word"), F.col("at")).alias("at"), "ref", "refs")
    each = t.select(*KEY, F.inline(F.array(F.struct(F.coalesce(asks, -F.col("term_id") - 1).alias("node"), own.alias("own"), F.lit(None).cast(_type(t, told)).alias("told")), F.struct(F.col("id").alias("node"), F.lit(None).cast(_type(t, own)).alias("own"), told.alias("told")))))
    h = F.max("told").over(W.partitionBy(*KEY, "node"))
    t = each.where("node is not null").withColumn("h", h).where("own is not null").select(*KEY, "own.*", "h")
    dependent = F.col("word") & (F.col("head") > 0)
    later = F.when(dependent, F.col("head") > F.col("id"))
    before_head = F.col("h.refs") - F.col("h.ref") - F.col("refs")
    between = F.when(later, before_head).when(~later, F.col("refs") - F.col("ref") - F.col("h.refs"))
    return t.select(
        *KEY, "token_id", F.col("id").alias("token_id_num"), F.col("head").alias("head_token_id_num"), "sent_len", F.when(F.col("word"), F.col("at")).alias("dep_pos"),
        later.alias("head_final"), F.when(dependent, F.col("head") < F.col("id")).alias("head_initial"), F.when(dependent, F.abs(F.col("h.at") - F.col("at"))).alias("head_distance"),
        F.when(dependent, F.signum((F.col("head") - F.col("id")).cast("double")).cast("int")).alias("head_direction"), F.when(dependent, between).alias("integration_cost"),
    )


def tree_features(tokens: DataFrame) -> DataFrame:
    """Tree features of each document: sentences' shapes with punctuation, directions and distances of arcs without."""
    tokens = stored(tokens.select(*KEY, "term_id", "token_id", "head_token_id", "upos"))
    s = sentence_tree_stats(tokens)
    means = {"avg_sent_height": "max_path", "avg_sd_depth": "sd_depth", "avg_depth_var": "depth_var", "avg_branching_factor": "branching_factor", "avg_tree_degree": "max_degree", "avg_degree_var": "degree_var", "avg_leaf_count": "leaf_count", "prop_leaves": "prop_leaves", "avg_max_incomplete_deps": "max_incomplete_deps", "avg_incomplete_deps": "avg_incomplete_deps", "avg_yngve": "yngve", "avg_max_yngve": "max_yngve", "avg_sd_yngve": "sd_yngve"}
    heights = s.groupBy("doc_id").agg(F.stddev_samp("max_path").alias("sd_sent_height"), *[F.avg(c).alias(n) for n, c in means.items()], F.sum("sentence_length").alias("n"), F.count(F.lit(1)).alias("s"), F.sum("count_path").alias("total_paths"))
    heights = heights.withColumn("avg_dependency_depth", F.try_divide("total_paths", "n"))
    a = arc_directions(tokens)
    root = F.min(F.when(F.col("head_token_id_num") == 0, F.col("dep_pos")))
    per_sentence = a.groupBy(*KEY).agg(F.count("head_final").alias("arcs"), F.count_if("head_final").alias("finals"), F.count_if("head_initial").alias("initials"), F.sum("head_distance").alias("distance"), F.count("head_distance").alias("distances"), F.max("head_distance").alias("longest"), F.sum("integration_cost").alias("cost"), F.count("integration_cost").alias("costs"), F.first("sent_len").alias("len"), root.alias("root"))
    mdd = F.try_divide(F.col("distance"), F.col("distances"))
    ndd = F.abs(F.log(mdd / F.sqrt(F.col("root") * F.col("len"))))
    arcs = per_sentence.withColumn("ndd", ndd).groupBy("doc_id").agg(
        F.try_divide(F.sum("finals"), F.sum("arcs")).alias("prop_hf"),
        F.try_divide(F.sum("initials"), F.sum("arcs")).alias("prop_hi"),
        F.try_divide(F.sum("distance"), F.sum("distances")).alias("avg_head_distance"),
        F.max("longest").alias("max_head_distance"),
        F.try_divide(F.sum("cost"), F.sum("costs")).alias("avg_integration_cost"),
        F.avg("ndd").alias("avg_head_distance_adj"),
        F.avg("root").alias("avg_root_position"),
    )
    return heights.join(arcs, "doc_id")


def depth_variability(stats: DataFrame) -> DataFrame:
    """Mean sentence height of a document and its mean change from one sentence to the next."""
    last = F.lag("max_path").over(W.partitionBy("doc_id").orderBy("paragraph_id", "sentence_id"))
    return stats.withColumn("last", last).groupBy("doc_id").agg(F.avg("max_path").alias("avg_sent_height"), F.avg(F.abs(F.col("max_path") - F.col("last"))).alias("depth_delta"))


def _lesser_before(values: np.ndarray, bounds: np.ndarray) -> int:
    """How many pairs i < j have values[i] < bounds[j]: by merging halves, a sort for each of log2(n) levels."""
    total, width, n = 0, 1, len(values)
    low = min(values.min(), bounds.min())
    values, bounds = values - low, bounds - low
    span = int(max(values.max(), bounds.max())) + 1
    place = np.arange(n)
    while width < n:
        pair, second = place // (2 * width), place // width % 2 == 1
        left = np.sort(pair[~second] * span + values[~second])
        total += int((np.searchsorted(left, pair[second] * span + bounds[second]) - np.searchsorted(left, pair[second] * span)).sum())
        width *= 2
    return total


def count_crossings(lo: np.ndarray, hi: np.ndarray) -> int:
    """Pairs of arcs lo1 < lo2 < hi1 < hi2, in n log(n) squared steps."""
    if len(lo) < 2:
        return 0
    order = np.lexsort((-hi, lo))
    lo, hi = lo[order].astype(np.int64), hi[order].astype(np.int64)
    # of arcs with the same start the longer comes first, so that such pairs fall out
    return _lesser_before(hi, hi) - _lesser_before(hi, lo + 1)


def crossing_arcs(tokens: DataFrame) -> DataFrame:
    """(doc_id, paragraph_id, sentence_id, n_crossings): pairs of arcs lo1 < lo2 < hi1 < hi2 of each sentence that has words."""

    @F.arrow_udf("long")
    def crossings(lo: pa.Array, hi: pa.Array) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(lo.value_lengths().to_numpy())))
        a, b = lo.flatten().to_numpy(), hi.flatten().to_numpy()
        return pa.array([count_crossings(a[i:j], b[i:j]) for i, j in zip(ends[:-1], ends[1:])], pa.int64())

    arc = F.when(F.col("head") > 0, F.struct(F.least("id", "head").alias("lo"), F.greatest("id", "head").alias("hi")))
    packed = numbered(tokens).groupBy(*KEY).agg(F.collect_list(arc).alias("arcs"))
    return packed.select(*KEY, crossings("arcs.lo", "arcs.hi").alias("n_crossings"))


def child_flags(tokens: DataFrame, dep_rels: tuple[str, ...], lemmas: tuple[str, ...] | None = None, upos: tuple[str, ...] | None = None, only_counted: bool = False) -> DataFrame:
    """The distinct (sentence, token_id) that have a child of these relations, lemmas and tags."""
    c = tokens.where(F.col("dep_rel").isin(*dep_rels))
    c = c.where(F.col("lemma").isin(*lemmas)) if lemmas else c
    c = c.where(F.col("upos").isin(*upos)) if upos else c
    c = c.where("compte") if only_counted else c
    return c.select(*KEY, F.col("head_token_id").alias("token_id")).where("token_id is not null").distinct()


def stats_of(b: Block) -> dict:
    """``sentence_tree_stats`` of annotated documents, whose trees are whole."""
    ids, left = b.term, b.head > b.term
    depth = b.path_sums(np.ones(b.n, np.int64))
    order = np.lexsort((ids, b.head, b.s))
    family = np.concatenate(([True], (np.diff(b.s[order]) != 0) | (np.diff(b.head[order]) != 0)))
    last = np.concatenate((np.flatnonzero(family)[1:], [b.n]))[np.cumsum(family) - 1]
    right = np.empty(b.n, np.int64)
    right[order] = last - 1 - np.arange(b.n)
    yngve = b.path_sums(right)
    refs = b.running(b.tagged(*REFERENTS))
    opened = b.running(left) - b.running(b.children(left))
    cost = refs * opened - (b.running(np.where(left, refs, 0)) - b.running(b.children(left, refs)))
    degree = b.children(np.ones(b.n, bool))
    n, paths, degrees, leaves = np.diff(b.off), b.sums(depth), b.sums(degree), b.sums(degree == 0)
    sd = lambda x, total: np.where(n > 1, deviation(n, total, b.sums(x * x)), 0.0)
    variance = lambda x, total: (n * b.sums(x * x) - total * total) / (n * n).astype(float)
    most, costs, yngves = b.maxima(cost), b.sums(cost), b.sums(yngve)
    return {
        "doc_id": b.doc, "paragraph_id": b.paragraph, "sentence_id": b.sentence_id, "max_path": b.maxima(depth), "avg_dependency_depth": paths / n,
        "avg_dependency_depth_adj": np.where(n > 1, paths / np.maximum(n - 1, 1), 0.0), "sd_depth": sd(depth, paths), "depth_var": variance(depth, paths), "branching_factor": degrees / n, "max_degree": b.maxima(degree),
        "degree_var": variance(degree, degrees), "leaf_count": leaves, "prop_leaves": leaves / n, "count_path": paths, "sentence_length": n, "max_incomplete_deps": most, "avg_incomplete_deps": costs / n,
        "max_incomplete_deps_adj": most / n, "avg_incomplete_deps_adj": costs / n / n, "yngve": yngves / n, "max_yngve": b.maxima(yngve), "sd_yngve": sd(yngve, yngves),
    }


def _doc_mean(b: Block, x: np.ndarray) -> np.ndarray:
    there = ~np.isnan(x)
    return ratio(b.by_doc(np.where(there, x, 0.0)), b.by_doc(there))


def features_of(b: Block) -> dict:
    """``tree_features`` of annotated documents."""
    s = stats_of(b)
    means = {"avg_sent_height": "max_path", "avg_sd_depth": "sd_depth", "avg_depth_var": "depth_var", "avg_branching_factor": "branching_factor", "avg_tree_degree": "max_degree", "avg_degree_var": "degree_var", "avg_leaf_count": "leaf_count", "prop_leaves": "prop_leaves", "avg_max_incomplete_deps": "max_incomplete_deps", "avg_incomplete_deps": "avg_incomplete_deps", "avg_yngve": "yngve", "avg_max_yngve": "max_yngve", "avg_sd_yngve": "sd_yngve"}
    sentences, heights = b.by_doc(np.ones(len(b.d), bool)), s["max_path"]
    out = {"doc_id": b.docs, "sd_sent_height": deviation(sentences, b.by_doc(heights), b.by_doc(heights * heights)), **{n: b.by_doc(s[c]) / sentences for n, c in means.items()}}
    n, paths = b.by_doc(s["sentence_length"]), b.by_doc(s["count_path"])
    out |= {"n": n, "s": sentences, "total_paths": paths, "avg_dependency_depth": paths / n}
    ref = b.tagged(*REFERENTS).astype(np.int64)
    refs, word = b.running(ref), b.upos != U["PUNCT"]
    at, dependent, later = b.running(word), word & (b.head > 0), b.head > b.term
    far = np.where(dependent & word[b.up], np.abs(at[b.up] - at), 0)
    between = np.where(dependent, np.where(later, refs[b.up] - ref[b.up] - refs, refs - ref - refs[b.up]), 0)
    arcs, distance, distances, length = b.sums(dependent), b.sums(far), b.sums(far > 0), b.sums(word)
    root = b.sums(np.where((b.head == 0) & word, at, 0)).astype(float)
    root[root == 0] = np.nan
    ndd = np.full(len(root), np.nan)
    some = (distances > 0) & ~np.isnan(root)
    ndd[some] = np.abs(np.log(distance[some] / distances[some] / np.sqrt(root[some] * length[some])))
    over = lambda x, y: ratio(b.by_doc(x), b.by_doc(y))
    longest = np.maximum.reduceat(b.maxima(far), b.doc_at).astype(float)
    return out | {
        "prop_hf": over(b.sums(dependent & later), arcs), "prop_hi": over(b.sums(dependent & ~later), arcs), "avg_head_distance": over(distance, distances), "max_head_distance": np.where(longest > 0, longest, np.nan),
        "avg_integration_cost": over(b.sums(between), arcs), "avg_head_distance_adj": _doc_mean(b, ndd), "avg_root_position": _doc_mean(b, root),
    }


def variability_of(b: Block) -> dict:
    """``depth_variability`` of annotated documents."""
    height = b.maxima(b.path_sums(np.ones(b.n, np.int64))).astype(float)
    change = np.concatenate(([np.nan], np.abs(np.diff(height))))
    change[b.doc_at] = np.nan
    return {"doc_id": b.docs, "avg_sent_height": _doc_mean(b, height), "depth_delta": _doc_mean(b, change)}


#: Depths by following heads row by row, memory costs by comparing arcs with places: the definitions, not the methods above.
RECURSIVE = PROLOGUE.replace("WITH", "WITH RECURSIVE", 1)
_S = "doc_id, paragraph_id, sentence_id"
_STATS_SQL = RECURSIVE + f""", sib AS MATERIALIZED (SELECT {_S}, term_id, head, upos, count(*) OVER (PARTITION BY {_S}, head) - row_number() OVER (PARTITION BY {_S}, head ORDER BY term_id) AS r,
  sum(CASE WHEN upos IN ('NOUN', 'PROPN', 'VERB') THEN 1 ELSE 0 END) OVER (PARTITION BY {_S} ORDER BY term_id) AS refs FROM tokens),
paths AS (SELECT doc_id, sentence_id, term_id, 0 AS depth, 0 AS yngve FROM sib WHERE head = 0
  UNION ALL SELECT c.doc_id, c.sentence_id, c.term_id, p.depth + 1, (p.yngve + c.r)::INT FROM sib c JOIN paths p ON c.doc_id = p.doc_id AND c.sentence_id = p.sentence_id AND c.head = p.term_id),
costs AS (SELECT s.doc_id, s.sentence_id, s.term_id, sum(s.refs - d.refs) AS cost FROM sib s JOIN sib d ON d.doc_id = s.doc_id AND d.sentence_id = s.sentence_id
  AND d.head > d.term_id AND d.term_id <= s.term_id AND s.term_id < d.head GROUP BY ALL),
deg AS (SELECT doc_id, sentence_id, head AS term_id, count(*) AS degree FROM sib WHERE head > 0 GROUP BY ALL),
f AS (SELECT s.doc_id, s.paragraph_id, s.sentence_id, s.term_id, depth, yngve, coalesce(cost, 0) AS cost, coalesce(degree, 0) AS degree FROM sib s LEFT JOIN paths USING (doc_id, sentence_id, term_id) LEFT JOIN costs USING (doc_id, sentence_id, term_id) LEFT JOIN deg USING (doc_id, sentence_id, term_id)),
stats AS (SELECT {_S}, max(depth) AS max_path, avg(depth) AS avg_dependency_depth, CASE WHEN count(*) > 1 THEN sum(depth) / (count(*) - 1) ELSE 0 END AS avg_dependency_depth_adj, CASE WHEN count(*) > 1 THEN stddev_samp(depth) ELSE 0 END AS sd_depth,
  (count(depth) * sum(depth * depth) - sum(depth) * sum(depth))::DOUBLE / (count(depth) * count(depth))::DOUBLE AS depth_var, avg(degree) AS branching_factor, max(degree) AS max_degree, (count(degree) * sum(degree * degree) - sum(degree) * sum(degree))::DOUBLE / (count(degree) * count(degree))::DOUBLE AS degree_var, count(*) FILTER (degree = 0) AS leaf_count, count(*) FILTER (degree = 0) / count(*) AS prop_leaves,
  sum(depth)::BIGINT AS count_path, count(*) AS sentence_length, max(cost)::BIGINT AS max_incomplete_deps, avg(cost) AS avg_incomplete_deps, max(cost) / count(*) AS max_incomplete_deps_adj, avg(cost) / count(*) AS avg_incomplete_deps_adj,
  avg(yngve) AS yngve, max(yngve) AS max_yngve, CASE WHEN count(*) > 1 THEN stddev_samp(yngve) ELSE 0 END AS sd_yngve FROM f GROUP BY ALL)"""
_ARCS_SQL = f""", w AS MATERIALIZED (SELECT {_S}, term_id, head, CASE WHEN upos <> 'PUNCT' THEN count(*) FILTER (upos <> 'PUNCT') OVER (PARTITION BY {_S} ORDER BY term_id) END AS dep_pos,
  count(*) FILTER (upos <> 'PUNCT') OVER (PARTITION BY {_S}) AS sent_len, sum((upos IN ('NOUN', 'PROPN', 'VERB'))::INT) OVER (PARTITION BY {_S} ORDER BY term_id) AS refs, upos IN ('NOUN', 'PROPN', 'VERB') AS ref, upos <> 'PUNCT' AND head > 0 AS dependent FROM tokens),
arcs AS MATERIALIZED (SELECT w.doc_id, w.paragraph_id, w.sentence_id, w.term_id AS token_id_num, w.term_id::VARCHAR AS token_id, w.head AS head_token_id_num, w.sent_len, w.dep_pos,
  CASE WHEN w.dependent THEN w.head > w.term_id END AS head_final, CASE WHEN w.dependent THEN w.head < w.term_id END AS head_initial, CASE WHEN w.dependent THEN abs(h.dep_pos - w.dep_pos) END AS head_distance,
  CASE WHEN w.dependent THEN sign(w.head - w.term_id)::INT END AS head_direction,
  CASE WHEN w.dependent AND w.head > w.term_id THEN h.refs - h.ref::INT - w.refs WHEN w.dependent THEN w.refs - w.ref::INT - h.refs END::BIGINT AS integration_cost
  FROM w LEFT JOIN w h ON h.doc_id = w.doc_id AND h.sentence_id = w.sentence_id AND h.term_id = w.head)"""
SQL = {
    "sentence_tree_stats": _STATS_SQL + " SELECT * FROM stats",
    "arc_directions": PROLOGUE + _ARCS_SQL + " SELECT * FROM arcs",
    "tree_features": _STATS_SQL + _ARCS_SQL + f""", hs AS (SELECT doc_id, avg(max_path) AS avg_sent_height, stddev_samp(max_path) AS sd_sent_height, avg(sd_depth) AS avg_sd_depth, avg(depth_var) AS avg_depth_var, avg(branching_factor) AS avg_branching_factor,
  avg(max_degree) AS avg_tree_degree, avg(degree_var) AS avg_degree_var, avg(leaf_count) AS avg_leaf_count, avg(prop_leaves) AS prop_leaves, avg(max_incomplete_deps) AS avg_max_incomplete_deps, avg(avg_incomplete_deps) AS avg_incomplete_deps,
  avg(yngve) AS avg_yngve, avg(max_yngve) AS avg_max_yngve, avg(sd_yngve) AS avg_sd_yngve, sum(sentence_length)::BIGINT AS n, count(*) AS s, sum(count_path)::BIGINT AS total_paths, sum(count_path) / sum(sentence_length) AS avg_dependency_depth FROM stats GROUP BY doc_id),
ps AS (SELECT {_S}, avg(head_distance) AS mdd, min(sent_len) AS len, min(dep_pos) FILTER (head_token_id_num = 0) AS root FROM arcs GROUP BY ALL),
nd AS (SELECT doc_id, avg(abs(ln(mdd / sqrt(root * len)))) AS avg_head_distance_adj, avg(root) AS avg_root_position FROM ps GROUP BY doc_id),
ds AS (SELECT doc_id, avg(head_final::INT) AS prop_hf, avg(head_initial::INT) AS prop_hi, avg(head_distance) AS avg_head_distance, max(head_distance) AS max_head_distance, avg(integration_cost) AS avg_integration_cost FROM arcs GROUP BY doc_id)
SELECT * FROM hs JOIN nd USING (doc_id) JOIN ds USING (doc_id)""",
    "depth_variability": _STATS_SQL + ", l AS (SELECT *, lag(max_path) OVER (PARTITION BY doc_id ORDER BY paragraph_id, sentence_id) AS last FROM stats) SELECT doc_id, avg(max_path) AS avg_sent_height, avg(abs(max_path - last)) AS depth_delta FROM l GROUP BY doc_id",
    "crossing_arcs": PROLOGUE + f""", a AS (SELECT {_S}, least(term_id, head) AS lo, greatest(term_id, head) AS hi FROM tokens WHERE head > 0),
c AS (SELECT a.doc_id, a.sentence_id, count(*) AS n FROM a JOIN a b ON a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id AND a.lo < b.lo AND b.lo < a.hi AND a.hi < b.hi GROUP BY ALL)
SELECT DISTINCT {_S}, coalesce(n, 0) AS n_crossings FROM tokens LEFT JOIN c USING (doc_id, sentence_id)""",
    "auxiliary_heads": PROLOGUE + f" SELECT DISTINCT {_S}, head_token_id AS token_id FROM tokens WHERE dep_rel IN ('aux', 'aux:pass')",
}
