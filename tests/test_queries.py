"""Every query that has SQL, against DuckDB over the smallest tables; and shapes that are known by hand."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from glossweave import queries
from glossweave.operators import lexical, syntax, trees

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return float(x) if hasattr(x, "as_tuple") else x


def ordered(rows, columns):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in place) for r in rows), key=repr), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert ordered(got.collect(), got.columns) == ordered(want.fetchall(), columns)


def sentence(spark, words, heads, upos, rels, doc="d"):
    rows = [Row(doc_id=doc, paragraph_id=1, sentence_id=1, term_id=i + 1, token_id=str(i + 1), token=w, lemma=w, upos=u, feats=None, head_token_id=None if h is None else str(h), dep_rel=r, compte=u != "PUNCT", lower_token=w.lower()) for i, (w, h, u, r) in enumerate(zip(words, heads, upos, rels))]
    schema = "doc_id string, paragraph_id int, sentence_id int, term_id int, token_id string, token string, lemma string, upos string, feats string, head_token_id string, dep_rel string, compte boolean, lower_token string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def svo(spark):
    return sentence(spark, "le chat mange le poisson .".split(), [2, 3, 0, 5, 3, 3], "DET NOUN VERB DET NOUN PUNCT".split(), "det nsubj root det obj punct".split())


def test_tree_of_one_sentence(svo):
    r = trees.sentence_tree_stats(svo).first()
    assert (r.max_path, r.count_path, r.max_degree, r.leaf_count, r.max_yngve, r.max_incomplete_deps) == (2, 7, 3, 3, 2, 0)
    assert (r.avg_dependency_depth, r.avg_dependency_depth_adj, r.branching_factor, r.yngve) == pytest.approx((7 / 6, 7 / 5, 5 / 6, 1))
    f = trees.tree_features(svo).first()
    assert (f.avg_head_distance, f.prop_hf, f.prop_hi, f.avg_root_position, f.avg_head_distance_adj) == pytest.approx((1.25, 0.75, 0.25, 3, 1.130882), abs=1e-6)


def test_clauses_of_one_sentence(svo):
    t = syntax.tunit_features(svo).first()
    assert (t.n_tunits, t.mls, t.mlt, t.mlc, t.c_t, t.t_s) == (1, 5, 5, 5, 1, 1)
    s = syntax.syntactic_complexity(svo).first()
    assert (s.avg_dep_dist, s.avg_words_before_root, s.avg_dep_count) == (1.25, 2, 0.8)


@pytest.mark.parametrize(
    ("words", "heads", "upos", "rels", "units"),
    [
        ("Marie chante et danse", [2, 0, 4, 2], "PROPN VERB CCONJ VERB", "nsubj root cc conj", 1),
        ("Marie chante et Pierre danse", [2, 0, 5, 5, 2], "PROPN VERB CCONJ PROPN VERB", "nsubj root cc nsubj conj", 2),
        ("Marie chante Pierre danse et Jean rit", [2, 0, 4, 2, 7, 7, 2], "PROPN VERB PROPN VERB CCONJ PROPN VERB", "nsubj root nsubj conj cc nsubj conj", 3),
        ("Je crois que Marie chante et Jean danse", [2, 0, 5, 5, 2, 8, 8, 5], "PRON VERB SCONJ PROPN VERB CCONJ PROPN VERB", "nsubj root mark nsubj ccomp cc nsubj conj", 1),
    ],
)
def test_tunits(spark, words, heads, upos, rels, units):
    assert syntax.tunit_features(sentence(spark, words.split(), heads, upos.split(), rels.split())).first().n_tunits == units


def test_broken_trees(spark):
    """A cycle, a missing head and a null head leave depths null, and nothing fails."""
    t = sentence(spark, list("abcde"), [0, 3, 2, 99, None], ["NOUN"] * 5, ["root", "dep", "dep", "dep", "dep"])
    r = trees.sentence_tree_stats(t).first()
    assert (r.sentence_length, r.max_path, r.count_path, r.avg_dependency_depth_adj) == (1, 0, 0, 0.0)
    assert trees.tree_features(t).count() == 1
    assert {x.clause_id for x in syntax.split_clauses(t).collect()} == {1, None}


def test_punctuation_left_out(svo):
    """Depths and Yngve depths stay those of the whole tree; the full stop only isn't counted."""
    r = trees.sentence_tree_stats(svo, include_punct=False).first()
    assert (r.sentence_length, r.max_path, r.count_path, r.max_yngve, r.max_degree) == (5, 2, 6, 2, 2)
    assert (r.avg_dependency_depth, r.yngve, r.avg_dependency_depth_adj) == pytest.approx((6 / 5, 6 / 5, 6 / 4))


def test_one_word(spark):
    r = trees.sentence_tree_stats(sentence(spark, ["Viens"], [0], ["VERB"], ["root"])).first()
    assert (r.sentence_length, r.avg_dependency_depth_adj, r.sd_depth, r.sd_yngve, r.max_degree) == (1, 0, 0, 0, 0)


def test_contractions_are_words(spark):
    """Il mange du pain: the range row counts, its parts are the tree."""
    schema = "doc_id string, paragraph_id int, sentence_id int, term_id int, token_id string, token string, lemma string, upos string, feats string, head_token_id string, dep_rel string, compte boolean, lower_token string"
    rows = [("1", "Il", "PRON", "2", "nsubj", True), ("2", "mange", "VERB", "0", "root", True), ("3-4", "du", None, None, None, True), ("3", "de", "ADP", "5", "case", False), ("4", "le", "DET", "5", "det", False), ("5", "pain", "NOUN", "2", "obj", True)]
    t = spark.createDataFrame([("d", 1, 1, i + 1, at, w, w, u, None, h, r, c, w.lower()) for i, (at, w, u, h, r, c) in enumerate(rows)], schema)
    f = syntax.tunit_features(t).first()
    assert (f.n_tunits, f.mls, f.mlt) == (1, 4, 4)
    s = syntax.syntactic_complexity(t).first()
    assert (s.avg_clause_length, s.avg_words_before_root, s.avg_dep_dist) == pytest.approx((4, 1, 7 / 4))
    clauses = {r.token_id: (r.is_clause_head, r.clause_id) for r in syntax.split_clauses(t).collect()}
    assert len(clauses) == 6 and clauses["3-4"] == (None, None) and clauses["5"] == (False, 1) and clauses["2"] == (True, 1)
    assert {r.token_id: r.head_distance for r in trees.arc_directions(t).collect()} == {"1": 1, "2": None, "3-4": None, "3": 2, "4": 1, "5": 3}


def test_require_finite(spark):
    """A participle opens no clause of its own; the same with a finite copula does."""
    t = sentence(spark, "la pomme cueillie tombe".split(), [2, 4, 2, 0], "DET NOUN VERB VERB".split(), "det nsubj acl root".split()).withColumn("feats", F.when(F.col("token") == "cueillie", "VerbForm=Part"))
    assert [r.is_clause_head for r in syntax.split_clauses(t).orderBy("term_id").collect()] == [False, False, True, True]
    assert [r.is_clause_head for r in syntax.split_clauses(t, require_finite=True).orderBy("term_id").collect()] == [False, False, False, True]


def test_crossings_by_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 40, 200):
        ends = rng.integers(1, n + 2, (n, 2))
        ends = ends[ends[:, 0] != ends[:, 1]]
        lo, hi = ends.min(axis=1), ends.max(axis=1)
        want = sum(a < c < b < d for a, b in zip(lo, hi) for c, d in zip(lo, hi))
        assert trees.count_crossings(lo, hi) == want


def test_moving_ttr_by_windows(spark):
    words = "a b a c b a d e a b c a f a b".split()
    t = sentence(spark, words, [0] * len(words), ["NOUN"] * len(words), ["root"] * len(words))
    for w in (1, 3, 4, 50):
        width = min(w, len(words))
        windows = [words[i : i + width] for i in range(len(words) - width + 1)]
        want = sum(len(set(x)) / width for x in windows) / len(windows)
        assert lexical.moving_ttr(t, w).first().MATTR == pytest.approx(want)


@pytest.mark.parametrize(("method", "want"), [("epsilon", 4e5), ("fixed_gt", 2 / 10 * 1e6 / 10), ("per_doc_gt", 2 / 1 * 1e6 / 10), ("chao1", 2 / 10 / 2 * 1e6), ("sgt", 2 / 10 * 1e6 / 10), ("chao2", 2 / 10 * 1e6), ("upos_gt", 2 / 10 * 1e6 / 10)])
def test_imputed_per_million(spark, method, want):
    """n = 10, n1 = 2, n2 = 1; every word but one of the corpus is in the lexicon."""
    lexicon = spark.createDataFrame([("a", "NOUN", "a", 1, 1e5), ("b", "NOUN", "b", 1, 1e5), ("c", "NOUN", "c", 8, 8e5)], "token string, upos string, lemma string, freq long, freq_u double")
    matched = lexical.match_lexicon(sentence(spark, ["C", "c", "new"], [0, 1, 1], ["NOUN"] * 3, ["root", "dep", "dep"]), lexicon)
    out = {r.lower_token: r.lex_freq_u_imputed for r in lexical.impute(matched, lexicon, "lex_freq_u", method, mode="u").collect()}
    assert out == pytest.approx({"c": 8e5, "new": want})
    if method == "epsilon":
        assert {r.lex_freq_u_imputed for r in lexical.impute(matched, lexicon, "lex_freq_u", method, mode="u", epsilon=3).collect()} == {8e5, 3.0}
