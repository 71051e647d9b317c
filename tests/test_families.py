"""Operators that SQL can't express, or whose awkward cases no table has: against brute force and by hand."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import burstiness, cleanup, cohesion, embeddings, evaluation, morphology, mwe, responses, similarity, surprisal
from glossweave.sources import conllu, corpus
from tests_support import TOKENS, token_table

SV, SVO = similarity.PROTOTYPES["sv"], similarity.PROTOTYPES["svo"]


def tree(words):
    return [(i + 1, h, u) for i, (h, u, _) in enumerate(words)]


def brute_distance(a, b):
    """Forests as nested tuples: delete, insert or match the last root."""

    def nested(rows):
        known = {i for i, _, _ in rows}
        below = lambda p: tuple((x, below(i)) for i, h, x in rows if (h if h in known else 0) == p)
        return (("ROOT", below(0)),)

    size = functools.cache(lambda f: sum(1 + size(c) for _, c in f))

    @functools.cache
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, c), (y, e) = f[-1], g[-1]
        return min(d(f[:-1] + c, g) + 1, d(f, g[:-1] + e) + 1, d(f[:-1], g[:-1]) + d(c, e) + (x != y))

    return d(nested(a), nested(b))


def test_tree_edit_distance_by_recursion():
    assert similarity.tree_edit_distance(tree(SV), tree(SVO), normalize=False) == 4
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = [[(i, int(rng.integers(0, i)) if rng.random() < 0.8 else int(rng.integers(i + 1, i + 3)), "abc"[rng.integers(3)]) for i in range(1, rng.integers(2, 7))] for _ in range(2)]
        rows = [[(i, h if h < i else 0, x) for i, h, x in r] for r in rows]
        assert similarity.tree_edit_distance(*rows, normalize=False) == brute_distance(*rows) == similarity.tree_edit_distance(*rows[::-1], normalize=False)
        assert similarity.tree_edit_distance(rows[0], rows[0]) == 0
    long = [(i, i - 1, "x") for i in range(1, 300)]
    assert similarity.tree_edit_distance(long, long[:-1], normalize=False) == 1


def test_pairs_and_search(spark, tmp_path):
    rows = [("d", s, i + 1, "w", h, u, r) for s, words in ((1, SV), (3, SVO), (4, SV)) for i, (h, u, r) in enumerate(words)] + [("e", 1, i + 1, "w", h, u, r) for i, (h, u, r) in enumerate(SVO)]
    t = token_table(spark, rows)
    near = {(r.doc_id, r.sentence_a, r.sentence_b): r.ted for r in similarity.sentence_pairs(t).collect()}
    assert near == {("d", 1, 3): 4 / 7, ("d", 3, 4): 4 / 7}
    assert {r.ted for r in similarity.sentence_pairs(t, adjacent=False).collect()} == {4 / 7, 0.0}
    one = {r.doc_id: r for r in similarity.document_similarity(t).collect()}
    assert one["d"].n_global_pairs == 3 and one["d"].global_similarity == pytest.approx(1 - 8 / 21) and "e" not in one
    found = similarity.search_by_structure(t, 0.0, 5, str(tmp_path / "out"), prototype="svo").collect()
    assert [(r.doc_id, r.sentence_id, r.sentence) for r in found] == [("d", 3, "w w w w w w"), ("e", 1, "w w w w w w")]
    assert [r.ted for r in similarity.find_by_structure(t, 2, prototype="sv", include_punct=False).collect()] == [0.0, 0.0]


def test_sampled_pairs():
    for n in (2, 3, 7, 32):
        i, j = embeddings.sample_pairs(n)
        assert list(zip(i, j)) == [(a, b) for b in range(n) for a in range(b)]
    i, j = embeddings.sample_pairs(1000, 500)
    assert len(set(zip(i, j))) == 500 and (i < j).all() and (i[0], j[0]) == (0, 1) and (i[-1], j[-1]) == (998, 999)


def test_coherence_by_definition(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(14, 5))
    m = embeddings.coherence(v)
    x = v / np.linalg.norm(v, axis=1)[:, None]
    steps = [x[i] @ x[i + 1] for i in range(13)]
    assert m["sequential_similarity"] == pytest.approx(np.mean(steps)) and m["max_semantic_gap"] == pytest.approx(1 - min(steps))
    novelty = [1 - x[i] @ x[:i].mean(axis=0) / np.linalg.norm(x[:i].mean(axis=0)) for i in range(1, 14)]
    assert m["mean_novelty"] == pytest.approx(np.mean(novelty))
    far = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 14)
    radius = np.sort(far, axis=1)[:, 9]
    support, occupied, cosines = [], [], []
    for a, b in itertools.combinations(range(14), 2):
        rest = [i for i in range(14) if i not in (a, b)]
        middle = (x[a] + x[b]) / 2
        least = min(np.linalg.norm(x[i] - middle) for i in rest)
        scale = math.sqrt(radius[a] * radius[b])
        support.append(math.exp(-0.5 * (least / scale) ** 2))
        occupied.append(least <= scale)
        cosines.append(max(x[i] @ middle / np.linalg.norm(middle) for i in rest))
    assert (m["segment_support"], m["segment_occupancy"], m["convexity"]) == pytest.approx((np.mean(support), np.mean(occupied), np.mean(cosines)))
    blocks = [x[i : i + 3].mean(axis=0) for i in range(0, 12, 3)]
    assert m["topic_drift"] == pytest.approx(np.mean([1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(blocks, blocks[1:])]))
    two = np.concatenate([np.tile([1.0, 0, 0], (6, 1)), np.tile([0, 1.0, 0], (6, 1))]) + rng.normal(size=(12, 3)) * 0.01
    assert embeddings.coherence(two)["n_topics"] == 2 and embeddings.coherence(v[:1])["n_topics"] is None and embeddings.coherence(v[:2])["convexity"] is None
    df = spark.createDataFrame([("a", i, [float(y) for y in r]) for i, r in enumerate(v)] + [("a", 99, None), ("b", 0, None)], "doc_id string, sentence_id int, embedding array<double>")
    out = {r.doc_id: r for r in embeddings.embedding_coherence(df).collect()}
    assert out["a"].emb_convexity == pytest.approx(m["convexity"]) and out["b"].emb_n_topics is None


def test_weibull_shape_is_the_maximum():
    rng = np.random.default_rng(0)
    gaps = np.ceil(rng.weibull(0.7, 4000) * 50)
    values, times = np.unique(gaps, return_counts=True)
    b, se = burstiness.weibull_shape(values, times.astype(float))
    level = lambda k: len(gaps) * math.log(k) - len(gaps) * math.log((gaps**k).mean()) + (k - 1) * np.log(gaps).sum()
    assert all(level(b) > level(b + e) for e in (-0.01, 0.01)) and abs(b - 0.7) < 0.1
    assert burstiness.weibull_shape(np.array([3.0]), np.array([9.0])) == (None, None)


def test_global_positions(spark):
    t = token_table(spark, [(d, s, i, w, 0, "NOUN", "root") for d, words in (("b", ["x", "y"]), ("a", ["y", "x", "x"]), ("c", ["x"])) for s in (1,) for i, w in enumerate(words, 1)])
    assert sorted(map(tuple, burstiness.global_positions(t).collect())) == [("x", 2), ("x", 3), ("x", 4), ("x", 6), ("y", 1), ("y", 5)]


def test_cohesion_by_hand(spark):
    words = {1: "le chat dort", 2: "le chat mange", 3: "un chien mange", 5: "le chien"}
    tags = {"le": "DET", "un": "DET", "chat": "NOUN", "chien": "NOUN", "dort": "VERB", "mange": "VERB"}
    t = token_table(spark, [("d", s, i, w, 0, tags[w], "x") for s, line in words.items() for i, w in enumerate(line.split(), 1)])
    r = cohesion.lexical_cohesion(t).first()
    previous = {(s, w): sum(w in words[p].split() for p in range(max(1, s - 1), s) if p in words) / max(1, min(1, s - 1)) for s, line in words.items() for w in line.split()}
    assert r.token_sent_overlap_prev1 == pytest.approx(sum(previous.values()) / 11)
    assert r.cosine_sent == pytest.approx((2 / 3 + 1 / 3) / 2) and r.arg_overlap == 0.5 and r.arg_overlap_content == 0.5
    assert {(x.sentence_id): x.similarity for x in cohesion.sentence_similarity(t, "jaccard").collect()} == pytest.approx({1: 0.5, 2: 0.2})
    alone = cohesion.lexical_cohesion(t.where("sentence_id = 1")).first()
    assert alone.token_doc_overlap is None and alone.token_sent_overlap_prev1 == 0 and alone.cosine_sent is None


def test_surprisal_by_hand(spark):
    t = token_table(spark, [("d", 1, i, "w", 0, u, "x") for i, u in enumerate(["DET", "NOUN", "VERB"], 1)] + [("d", 2, i, "w", 0, u, "x") for i, u in enumerate(["DET", "NOUN", "ADJ"], 1)])
    model = surprisal.ngram_model(surprisal.pos_ngrams(t))
    scored = {(r.sentence_id, r.term_id): (r.pos_surprisal, r.pos_entropy) for r in surprisal.pos_surprisal(t, model, boundaries=True).collect()}
    assert scored == {(1, 1): (0, 0), (1, 2): (0, 0), (1, 3): (1, 1), (2, 1): (0, 0), (2, 2): (0, 0), (2, 3): (1, 1)}
    new = token_table(spark, [("e", 1, i, "w", 0, u, "x") for i, u in enumerate(["NOUN", "NOUN", "VERB", "X"], 1)])
    plain = {r.term_id: r.pos_surprisal for r in surprisal.pos_surprisal(new, model).collect()}
    backed = {r.term_id: (r.pos_surprisal, r.pos_entropy) for r in surprisal.pos_surprisal(new, model, backoff=0.5).collect()}
    assert plain == {3: None, 4: None} and backed == {3: (2.0, 1.0), 4: (None, None)}


def test_agreement_and_tests(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0.4, 1, 40).round(1), rng.normal(0, 1.2, 35).round(1)
    df = spark.createDataFrame([("x", float(v), i) for i, v in enumerate(a)] + [("y", float(v), i) for i, v in enumerate(b)] + [("y", None, 99)], "g string, f double, k int")
    r = evaluation.compare_groups(df, "g", "x", "y", ["f"]).first()
    pooled = math.sqrt((39 * a.var(ddof=1) + 34 * b.var(ddof=1)) / 73)
    assert r.d == pytest.approx((a.mean() - b.mean()) / pooled)
    both = np.concatenate([a, b])
    ranks = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    w = ranks[:40].sum() - 40 * 41 / 2
    ties = sum(n**3 - n for n in np.unique(both, return_counts=True)[1])
    z = (abs(w - 700) - 0.5) / math.sqrt(1400 / 12 * (76 - ties / (75 * 74)))
    assert r.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-5)
    paired = evaluation.compare_groups(df.where("k < 35"), "g", "x", "y", ["f"], pair="k").first()
    g = np.array([d for d in a[:35] - b if abs(d) > 0])
    size = np.abs(g)
    order = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
    n = len(g)
    ties = sum(c**3 - c for c in np.unique(size, return_counts=True)[1])
    z = (abs(order[g > 0].sum() - n * (n + 1) / 4) - 0.5) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert paired.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-5)
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (5, 4)], "t int, p int")
    assert evaluation.weighted_kappa(rows, "t", "p").first().qwk == pytest.approx(1 - (1 / 16) / (sum((x - y) ** 2 / 16 for x in (1, 2, 3, 5) for y in (1, 2, 3, 4)) / 4))
    same = spark.createDataFrame([(i, "c", True) for i in range(3)], "passage_id int, code string, applies boolean")
    assert evaluation.kappa(same, same).first().kappa is None


def test_choice_of_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), float(r[0] + 0.01), int(c)) for r, c in zip(x, y)], "a double, b double, n double, copy double, y int")
    chosen = [f for f, _ in evaluation.mrmr(df, ["a", "b", "n", "copy"], "y", 3)]
    assert chosen[0] in ("a", "copy") and chosen[1] == "b"
    weights = dict(evaluation.lasso(df, ["a", "b", "n"], "y"))
    assert weights["a"] > weights["b"] > 0 and abs(weights["n"]) < 0.2
    made = evaluation.cross_validate(df.withColumn("k", F.monotonically_increasing_id()), "k", "y", lambda d: d.agg(F.avg("a")).first()[0], lambda m, d: d.select("k", F.lit(m).alias("m")), k=3)
    assert made.count() == 400 and made.select("m").distinct().count() == 3


def test_conllu(spark, tmp_path):
    text = "# newdoc id = one\n# newpar\n# text = Du pain.\n1-2\tDu\t_\t_\t_\t_\t_\t_\t_\t_\n1\tDe\tde\tADP\t_\t_\t3\tcase\t_\t_\n2\tle\tle\tDET\t_\tDefinite=Def\t3\tdet\t_\t_\n3\tpain\tpain\tNOUN\t_\t_\t0\troot\t_\t_\n\n# newpar\n1\t_\t_\tX\t_\t_\t0\troot\t_\t_\n\n\n# newdoc id = two\n1\tOui\toui\tINTJ\t_\t_\t0\troot\t_\t_\n"
    (tmp_path / "f.conllu").write_text(text)
    t = conllu.read_conllu(spark, str(tmp_path / "f.conllu"))
    rows = [(r.doc_id, r.paragraph_id, r.sentence_id, r.term_id, r.token_id, r.token, r.upos) for r in t.orderBy("doc_id", "term_id").collect()]
    assert rows == [("one", 1, 1, 1, "1-2", "Du", None), ("one", 1, 1, 2, "1", "De", "ADP"), ("one", 1, 1, 3, "2", "le", "DET"), ("one", 1, 1, 4, "3", "pain", "NOUN"), ("one", 2, 2, 5, "1", "_", "X"), ("two", 1, 1, 1, "1", "Oui", "INTJ")]
    conllu.write_conllu(t.where("doc_id = 'one'"), str(tmp_path / "out"))
    again = conllu.read_conllu(spark, str(tmp_path / "out"))
    assert sorted((r.token_id, r.token) for r in again.collect()) == sorted((r[4], r[5]) for r in rows[:5])
    done = {r.token_id: r.compte for r in cleanup.post_process(t.where("doc_id = 'one' and paragraph_id = 1")).collect()}
    assert done == {"1-2": True, "1": False, "2": False, "3": True}
    assert {r.token_id for r in cleanup.drop_range_parts(t.where("doc_id = 'one' and paragraph_id = 1")).collect()} == {"1-2", "3"}


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("Il a dit: <<oui>>!Bien.Elle,rit\nencore.\n\n\n\nFin".encode())
    (tmp_path / "a" / "y.txt").write_bytes("caf\xe9 \x93ici\x94".encode("latin-1"))
    got = {r.doc_id: (r.text, r.charset) for r in corpus.build_corpus(spark, str(tmp_path / "a"), encoding="auto").collect()}
    assert got["x.txt"] == ("Il a dit : « oui » ! Bien. Elle, rit encore. Fin", "utf-8") or got["x.txt"][1] == "utf-8"
    assert got["y.txt"] == ('café "ici"', "cp1252")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("twice")
    with pytest.raises(ValueError, match="x.txt"):
        corpus.build_corpus(spark, f"{tmp_path}/*/")
    tsv = tmp_path / "p.tsv"
    tsv.write_text("doc_id_hard\thard_text\tdoc_id_easy\teasy_text\nwiki_1\thard\twith tab\tviki_1\teasy\n")
    assert sorted(map(tuple, corpus.read_paired_tsv(spark, str(tsv)).collect())) == [("viki_1", "easy"), ("wiki_1", "hard\twith tab")]
    assert [tuple(r) for r in corpus.read_sentences(spark, str(tmp_path / "a" / "x.txt"), "d").limit(1).collect()][0][:2] == ("d", 1)


def test_segmentation():
    assert cleanup.segment("Il coûte 3 (%). Elle part maintenant avec lui. Oui. Non.") == ["Il coûte 3 (%). Elle part maintenant avec lui. Oui. Non."] or cleanup.segment("Un deux trois quatre (5). Elle part maintenant avec lui. Oui.") == ["Un deux trois quatre (5).", "Elle part maintenant avec lui. Oui."]
    assert cleanup.segment("Voici la liste complète:\net les autres choses encore", merge_colons=True) == ["Voici la liste complète: et les autres choses encore"]
    assert cleanup.segment("Voici la liste complète:\nLes autres choses encore ici", merge_colons=True) == ["Voici la liste complète:", "Les autres choses encore ici"]
    assert cleanup.token_count("l'arc-en-ciel d'hier") == 4 and cleanup.continues("mais oui") and cleanup.continues("Donc voilà") and not cleanup.continues("Le") and cleanup.segment("") == []


def test_responses(spark):
    one = spark.createDataFrame([("1. un\n2) deux\n**3.** trois",), (None,), ("x",)], "r string").select(responses.parse_numbered_list(F.col("r"), 4).alias("x")).collect()
    assert [r.x for r in one] == [["un", "deux", "trois", None], [None] * 4, [None] * 4]
    with pytest.raises(ValueError, match="nope"):
        responses.fill_template("{nope}", ["a"])
    passages = spark.createDataFrame([(1, "a cat"), (2, "a dog"), (3, "boom")], "passage_id int, text string")
    book = spark.createDataFrame([("cat", "names a cat")], "code string, definition string")

    def respond(prompt: str) -> str:
        if "boom" in prompt:
            raise RuntimeError("no answer")
        return "So. {\"applies\": %s, \"rationale\": \"r\"}" % ("true" if "Passage:\na cat" in prompt else "\"true\"")

    out = {r.passage_id: (r.applies, r.error) for r in responses.code_corpus(passages, book, respond).collect()}
    assert out == {1: (True, None), 2: (False, None), 3: (None, "no answer")}
    pieces = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0), (2, 0, float("nan"), 1.0), (3, 0, 1.0, None)], "w int, piece int, surprisal double, entropy double")
    got = {m: {r.w: (r.surprisal, r.entropy) for r in responses.aggregate_to_words(pieces, ["w"], m).collect()} for m in responses.ENTROPY_MODES}
    assert got["onset"] == {1: (4, 2), 2: (None, None), 3: (None, None)} and got["offset"][1] == (4, 4) and got["mean"][1] == (4, 3) and got["sum"][1] == (4, 6) and got["none"] == {1: (4, None), 2: (None, None), 3: (1, None)}
    with pytest.raises(ValueError, match="unknown"):
        responses.aggregate_to_words(pieces, ["w"], "max")


def test_expressions_across_documents(spark):
    t = token_table(spark, [(d, 1, i, w, 0, "X", "x") for d, line in (("a", "en fait il dort"), ("b", "fait accompli en")) for i, w in enumerate(line.split(), 1)])
    lex = spark.createDataFrame([("en fait", "ADV"), ("fait accompli", "NOUN"), ("en", "ADP"), ("en", "PRO")], "forme_lower string, cat string")
    found = sorted(tuple(r) for r in mwe.match_sequences(t, lex).collect())
    assert found == [("a", 1, "1", "1", "en", "ADP"), ("a", 1, "1", "1", "en", "PRO"), ("a", 1, "1", "2", "en fait", "ADV"), ("b", 1, "1", "2", "fait accompli", "NOUN"), ("b", 1, "3", "3", "en", "ADP"), ("b", 1, "3", "3", "en", "PRO")]
    assert {r.cat for r in mwe.match_sequences(t, lex, cat_to_upos={"ADP": "ADP", "NOUN": "X"}).collect()} == {"ADV", "NOUN", "PRO"}
    d = {r.doc_id: r for r in mwe.connective_density(t, mwe.match_sequences(t, lex)).collect()}
    assert (d["a"].n_connectives, d["a"].cat_ADP, d["b"].n_connectives, d["a"].n_connectives_per100w) == (1, 1, 2, 25.0)
    assert mwe.match_sequences(t, lex.limit(0)).count() == 0


def test_unknown_words(spark):
    t = token_table(spark, [("a", 1, i, w, 0, "NOUN", "x") for i, w in enumerate(["chat", "chot", "extraordinairement"], 1)])
    lex = spark.createDataFrame([("chat",), ("chats",)], "token string")
    r = morphology.oov_edit_features(t, lex).first()
    assert (r.oov_edit_prop, r.oov_edit_mean_dist, r.oov_edit_max_dist, r.oov_edit_prop_isolated) == pytest.approx((2 / 3, (1 + 18) / 2, 18, 0.5))
    assert morphology.oov_edit_features(t.where("token = 'chat'"), lex).first().oov_edit_mean_dist is None and TOKENS
