"""Clauses, T-units and the ratios between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.annotate import sql_list
from glossweave.blocks import Block, ratio
from glossweave.operators.trees import KEY, RECURSIVE, nearest_flagged, numbered, path_sums, with_children

NOMINAL_UPOS = ("NOUN", "PROPN", "PRON")
NOMINAL_CHILDREN = ("amod", "nmod", "nmod:poss", "acl", "acl:relcl", "nummod", "appos", "compound", "det:nummod")
SUBJECTS = ("nsubj", "nsubj:pass", "nsubj:caus", "csubj", "csubj:pass", "expl", "expl:subj")
AUXILIARIES = ("aux", "aux:pass", "aux:tense", "aux:caus")
DEPENDENT_CLAUSES = ("ccomp", "advcl", "acl", "acl:relcl")
COORDINATED = ("NOUN", "PROPN", "PRON", "NUM", "ADJ", "ADV", "VERB", "AUX")
NOT_FINITE = r"VerbForm=(Inf|Part|Ger|Conv)(\||$)"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def with_clause_flags(tokens: DataFrame, count_parataxis: bool = False) -> DataFrame:
    """Adds what a token's children and the path to its root make it: one aggregate by head, one path sum, no join.

    Rows without an id of their own, such as the range row of a contraction, stay, outside of the tree: they can be counted.

    is_complex_nominal, has_own_subject, is_predicate, is_complex_verb, dep_count (counted children), base_rel,
    is_tunit_head (the root, or a predicate with a subject of its own that only coordination joins to it).
    """
    t = numbered(tokens, ranges=True).withColumn("base_rel", F.regexp_replace("dep_rel", ":.*$", ""))
    finite = F.col("upos").isin("VERB", "AUX") & ~_yes(F.col("feats").rlike(NOT_FINITE))
    rel = lambda rels: _yes(F.col("dep_rel").isin(*rels))
    passed = {"nominal": rel(NOMINAL_CHILDREN), "subject": rel(SUBJECTS), "cop": rel(("cop",)), "aux": rel(AUXILIARIES), "finite": _yes(finite), "counted": _yes(F.col("compte"))}
    has = lambda c: _yes(F.max(f"child.{c}"))
    t = with_children(t, passed, nominal_child=has("nominal"), has_own_subject=has("subject"), cop_child=has("cop"), aux_child=has("aux"), finite_child=has("finite"), dep_count=F.count_if("child.counted"))
    t = t.withColumns({
        "is_complex_nominal": _yes(F.col("upos").isin(*NOMINAL_UPOS)) & F.col("nominal_child"),
        "is_predicate": _yes(F.col("upos").isin("VERB", "AUX")) | F.col("cop_child"),
        "is_complex_verb": _yes(F.col("upos") == "VERB") & F.col("aux_child"),
        "is_finite": _yes(finite) | F.col("finite_child"),
    }).drop("nominal_child", "cop_child", "aux_child", "finite_child")
    joining = ("conj", "parataxis") if count_parataxis else ("conj",)
    t = path_sums(t, gaps=(~_yes(F.col("base_rel").isin(*joining))).cast("int"))
    joined = _yes(F.col("gaps") == 0)
    return t.withColumn("is_tunit_head", joined & ((F.col("head") == 0) | (F.col("is_predicate") & F.col("has_own_subject")))).drop("gaps")


def _tunits() -> Column:
    return 1 + F.count_if(F.col("is_tunit_head") & (F.col("head") > 0))


def syntactic_complexity(tokens: DataFrame, dependent: tuple[str, ...] = DEPENDENT_CLAUSES, count_parataxis: bool = False) -> DataFrame:
    """Clause lengths and densities, complex nominals and verbs, dependency distances of each document."""
    t = with_clause_flags(tokens, count_parataxis)
    counted = F.col("compte")
    # places among the words, so that punctuation in between counts for no distance
    word = F.col("id").isNotNull() & _yes(F.col("upos") != "PUNCT")
    at = F.sum(word.cast("int")).over(W.partitionBy(*KEY).orderBy(F.col("id").asc_nulls_first(), "term_id"))
    t = t.withColumns({"place": F.when(word, at), "arc": F.when(word & (F.col("head") > 0), F.col("head"))})
    places = F.map_from_arrays(F.collect_list(F.when(word, F.col("id"))), F.collect_list("place"))
    arcs = F.collect_list(F.when(F.col("arc").isNotNull(), F.struct("place", "arc")))
    root = F.min(F.when(F.col("dep_rel") == "root", F.col("id")))
    ids = F.collect_list(F.when(counted, F.col("id")))
    s = t.groupBy(*KEY).agg(
        F.count_if(counted).alias("n_tokens"), F.count_if(counted & F.col("dep_rel").isin(*dependent)).alias("n_dc"), F.count_if(counted & F.col("is_complex_nominal")).alias("n_cn"),
        F.count_if(counted & F.col("is_complex_verb")).alias("n_cv"), F.coalesce(F.sum(F.when(counted, F.col("dep_count"))), F.lit(0)).alias("deps"), _tunits().alias("n_tunits"),
        root.alias("root"), ids.alias("ids"), places.alias("places"), arcs.alias("arcs"),
    ).where("n_tokens > 0")
    far = F.transform("arcs", lambda x: F.abs(x.place - F.try_element_at("places", x.arc)))
    s = s.withColumn("far", F.filter(far, lambda x: x.isNotNull()))
    before = F.when(F.col("root").isNotNull(), F.size(F.filter("ids", lambda x: x < F.col("root"))))
    s = s.withColumns({"n_clause": F.col("n_tunits") + F.col("n_dc"), "before": before, "distance": F.aggregate("far", F.lit(0).cast("long"), lambda a, x: a + x), "n_dep": F.size("far")})
    over = lambda a, b: F.sum(a) / F.sum(b)
    return s.groupBy("doc_id").agg(
        over("n_tokens", "n_clause").alias("avg_clause_length"),
        F.avg("n_cn").alias("complex_nom_per_sent"),
        F.avg("n_cv").alias("complex_verb_per_sent"),
        F.try_divide(F.sum("distance"), F.sum("n_dep")).alias("avg_dep_dist"),
        over("deps", "n_tokens").alias("avg_dep_count"),
        F.avg("before").alias("avg_words_before_root"),
        (F.sum("n_clause") / F.count(F.lit(1))).alias("clausal_density"),
        over("n_dc", "n_clause").alias("dc_per_clause"),
        over("n_cn", "n_clause").alias("cn_per_clause"),
        over("n_cv", "n_clause").alias("cv_per_clause"),
    )


def tunit_features(tokens: DataFrame, count_parataxis: bool = False) -> DataFrame:
    """Lu's ratios of words, sentences, T-units, clauses, verb phrases, coordinate phrases and complex nominals by document."""
    t = with_clause_flags(tokens, count_parataxis)
    # the tag of the head, from the group of those that point to it
    told = F.max(F.when(F.col("is_head"), F.col("told"))).over(W.partitionBy(*KEY, "node"))
    names = t.columns
    node = F.coalesce(F.when(F.col("head") > 0, F.col("head")), -F.col("term_id") - 1)
    twice = F.array(F.struct(node.alias("node"), F.lit(False).alias("is_head"), F.lit(None).cast("string").alias("told")), F.struct(F.when(F.col("compte"), F.col("id")).alias("node"), F.lit(True).alias("is_head"), F.col("upos").alias("told")))
    t = t.select("*", F.inline(twice)).where("node is not null").withColumn("head_upos", told).where("not is_head").select(*names, "head_upos")
    conj, own, pred = F.col("base_rel") == "conj", F.col("has_own_subject"), F.col("is_predicate")
    verb = (F.col("upos") == "VERB") | ((F.col("upos") == "AUX") & ~F.col("dep_rel").isin(*AUXILIARIES))
    phrase = conj & ~(pred & own) & F.col("head_upos").isin(*COORDINATED)
    counted = F.col("compte")
    s = t.groupBy(*KEY).agg(
        _tunits().alias("tu"), F.count_if(counted).alias("w"), F.count_if(counted & verb & ~(conj & pred & ~own)).alias("vp"), F.count_if(counted & F.col("dep_rel").isin(*DEPENDENT_CLAUSES)).alias("dc"),
        F.countDistinct(F.when(counted & phrase, F.col("head"))).alias("cp"), F.count_if(counted & F.col("is_complex_nominal")).alias("cn"),
    )
    tu, dc, w, n = F.sum("tu"), F.sum("dc"), F.sum("w"), F.count(F.lit(1))
    ratios = {"mls": w / n, "mlt": w / tu, "mlc": w / (tu + dc), "c_s": (tu + dc) / n, "t_s": tu / n, "c_t": (tu + dc) / tu, "dc_c": dc / (tu + dc), "dc_t": dc / tu, "ct_t": F.count_if(F.col("dc") > 0) / tu, "vp_t": F.sum("vp") / tu, "cp_t": F.sum("cp") / tu, "cp_c": F.sum("cp") / (tu + dc), "cn_t": F.sum("cn") / tu, "cn_c": F.sum("cn") / (tu + dc), "prop_coord_sent": F.count_if(F.col("tu") > 1) / n}
    return s.groupBy("doc_id").agg(tu.alias("n_tunits"), n.alias("n_sentences"), *[c.alias(k) for k, c in ratios.items()])


def split_clauses(tokens: DataFrame, dependent: tuple[str, ...] = DEPENDENT_CLAUSES, count_parataxis: bool = False, require_finite: bool = False) -> DataFrame:
    """Adds is_clause_head and clause_id: the number, in the order of the text, of the nearest clause head above a token.

    Both are null for rows without an id of their own; clause_id also where no clause head is above.
    """
    t = with_clause_flags(tokens, count_parataxis)
    subordinate = _yes(F.col("dep_rel").isin(*dependent))
    if require_finite:
        subordinate = subordinate & F.col("is_finite")
    t = nearest_flagged(t.withColumn("is_clause_head", F.col("is_tunit_head") | subordinate), F.col("is_clause_head"), "of")
    numbers = F.sum(F.when(F.col("is_clause_head"), 1)).over(W.partitionBy(*KEY).orderBy(F.col("id").asc_nulls_first(), "term_id"))
    t = t.withColumn("own", F.when(F.col("is_clause_head"), numbers))
    # all whose nearest clause head is the same have its number
    clause = F.when(F.col("of").isNotNull(), F.max("own").over(W.partitionBy(*KEY, "of")))
    inside = F.when(F.col("id").isNotNull(), F.col("is_clause_head"))
    return t.withColumn("clause_id", clause).select(*tokens.columns, inside.alias("is_clause_head"), "clause_id")


def flags_of(b: Block) -> dict[str, np.ndarray]:
    """``with_clause_flags`` of annotated documents, whose tokens all have ids."""
    any_child = lambda flag: b.children(flag) > 0
    predicate = b.tagged("VERB", "AUX") | any_child(b.related("cop"))
    subject = any_child(b.related(*SUBJECTS))
    joined = b.path_sums(~b.related("conj")) == 0
    return {
        "nominal": b.tagged(*NOMINAL_UPOS) & any_child(b.related(*NOMINAL_CHILDREN)), "subject": subject, "predicate": predicate, "verb": b.tagged("VERB") & any_child(b.related(*AUXILIARIES)),
        "deps": b.children(b.compte), "tunit": joined & ((b.head == 0) | (predicate & subject)),
    }


def complexity_of(b: Block) -> dict:
    """``syntactic_complexity`` of annotated documents."""
    f, counted = flags_of(b), b.compte
    word = counted  # all but punctuation
    at, arc = b.running(word), word & (b.head > 0) & word[b.up]
    far = np.where(arc, np.abs(at - at[b.up]), 0)
    root = b.off[:-1] + b.sums(np.where(b.head == 0, b.term - 1, 0))
    n = b.sums(counted)
    there = n > 0
    of = lambda x: np.where(there, b.sums(x), 0)
    dc, cn, cv, tunits = of(counted & b.related(*DEPENDENT_CLAUSES)), of(counted & f["nominal"]), of(counted & f["verb"]), np.where(there, 1 + b.sums(f["tunit"] & (b.head > 0)), 0)
    before = of(counted & (np.arange(b.n) < root[b.s]))
    d = {k: b.by_doc(x) for k, x in {"s": there, "n": n, "dc": dc, "cn": cn, "cv": cv, "clauses": tunits + dc, "deps": of(np.where(counted, f["deps"], 0)), "before": before, "far": of(far), "arcs": of(arc)}.items()}
    keep = d["s"] > 0
    d = {k: x[keep] for k, x in d.items()}
    over = lambda x, y: ratio(d[x], d[y])
    return {
        "doc_id": b.docs.filter(pa.array(keep)), "avg_clause_length": over("n", "clauses"), "complex_nom_per_sent": over("cn", "s"), "complex_verb_per_sent": over("cv", "s"), "avg_dep_dist": over("far", "arcs"), "avg_dep_count": over("deps", "n"),
        "avg_words_before_root": over("before", "s"), "clausal_density": over("clauses", "s"), "dc_per_clause": over("dc", "clauses"), "cn_per_clause": over("cn", "clauses"), "cv_per_clause": over("cv", "clauses"),
    }


def tunits_of(b: Block) -> dict:
    """``tunit_features`` of annotated documents."""
    f, counted, conj = flags_of(b), b.compte, b.related("conj")
    pred, own = f["predicate"], f["subject"]
    verb = b.tagged("VERB") | (b.tagged("AUX") & ~b.related(*AUXILIARIES))
    phrase = conj & ~(pred & own) & (b.head > 0) & (counted & b.tagged(*COORDINATED))[b.up]
    s = {
        "tu": 1 + b.sums(f["tunit"] & (b.head > 0)), "w": b.sums(counted), "vp": b.sums(counted & verb & ~(conj & pred & ~own)), "dc": b.sums(counted & b.related(*DEPENDENT_CLAUSES)),
        "cp": b.sums(b.children(counted & phrase) > 0), "cn": b.sums(counted & f["nominal"]), "n": np.ones(len(b.d), bool),
    }
    s |= {"ct": s["dc"] > 0, "co": s["tu"] > 1, "c": s["tu"] + s["dc"]}
    d = {k: b.by_doc(x) for k, x in s.items()}
    over = {"mls": ("w", "n"), "mlt": ("w", "tu"), "mlc": ("w", "c"), "c_s": ("c", "n"), "t_s": ("tu", "n"), "c_t": ("c", "tu"), "dc_c": ("dc", "c"), "dc_t": ("dc", "tu"), "ct_t": ("ct", "tu"), "vp_t": ("vp", "tu"), "cp_t": ("cp", "tu"), "cp_c": ("cp", "c"), "cn_t": ("cn", "tu"), "cn_c": ("cn", "c"), "prop_coord_sent": ("co", "n")}
    return {"doc_id": b.docs, "n_tunits": d["tu"], "n_sentences": d["n"], **{k: d[x] / d[y] for k, (x, y) in over.items()}}


def clauses_of(b: Block) -> dict:
    """``split_clauses`` of annotated documents: the place of each token, is_clause_head and clause_id."""
    opens = flags_of(b)["tunit"] | b.related(*DEPENDENT_CLAUSES)
    of = b.nearest(opens)
    return b.place() | {"is_clause_head": opens, "clause_id": np.where(of >= 0, b.running(opens)[of], np.nan)}


_S = "doc_id, paragraph_id, sentence_id"
_FLAGS = RECURSIVE + f""", ch AS (SELECT doc_id, sentence_id, head AS term_id, bool_or(dep_rel IN {sql_list(NOMINAL_CHILDREN)}) AS nom, bool_or(dep_rel IN {sql_list(SUBJECTS)}) AS own, bool_or(dep_rel = 'cop') AS cop,
  bool_or(dep_rel IN {sql_list(AUXILIARIES)}) AS aux, count(*) FILTER (compte) AS deps FROM tokens WHERE head > 0 GROUP BY ALL),
fl AS MATERIALIZED (SELECT t.*, split_part(dep_rel, ':', 1) AS base, upos IN {sql_list(NOMINAL_UPOS)} AND coalesce(nom, FALSE) AS cn, coalesce(own, FALSE) AS own, upos IN ('VERB', 'AUX') OR coalesce(cop, FALSE) AS pred,
  upos = 'VERB' AND coalesce(aux, FALSE) AS cv, coalesce(deps, 0) AS deps FROM tokens t LEFT JOIN ch USING (doc_id, sentence_id, term_id)),
reach AS (SELECT doc_id, sentence_id, term_id FROM fl WHERE head = 0
  UNION ALL SELECT c.doc_id, c.sentence_id, c.term_id FROM fl c JOIN reach p ON c.doc_id = p.doc_id AND c.sentence_id = p.sentence_id AND c.head = p.term_id WHERE c.base = 'conj'),
tu AS MATERIALIZED (SELECT fl.*, r.term_id IS NOT NULL AND (fl.head = 0 OR (pred AND own)) AS th FROM fl LEFT JOIN reach r USING (doc_id, sentence_id, term_id))"""
_DC = sql_list(DEPENDENT_CLAUSES)
SQL = {
    "syntactic_complexity": _FLAGS + f""", roots AS (SELECT doc_id, sentence_id, min(term_id) AS root FROM tu WHERE dep_rel = 'root' GROUP BY ALL),
pos AS MATERIALIZED (SELECT doc_id, sentence_id, term_id, head, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY term_id) AS p FROM tokens WHERE upos <> 'PUNCT'),
dd AS (SELECT a.doc_id, sum(abs(a.p - b.p)) AS dist, count(*) AS nd FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id AND a.head = b.term_id GROUP BY ALL),
s AS (SELECT {_S}, count(*) FILTER (compte) AS w, count(*) FILTER (compte AND dep_rel IN {_DC}) AS dc, count(*) FILTER (compte AND cn) AS cn, count(*) FILTER (compte AND cv) AS cv, coalesce(sum(deps) FILTER (compte), 0) AS deps,
  1 + count(*) FILTER (th AND head > 0) AS t, CASE WHEN min(root) IS NOT NULL THEN count(*) FILTER (compte AND term_id < root) END AS br
  FROM tu LEFT JOIN roots USING (doc_id, sentence_id) GROUP BY ALL HAVING count(*) FILTER (compte) > 0)
SELECT doc_id, sum(w) / sum(t + dc) AS avg_clause_length, avg(cn) AS complex_nom_per_sent, avg(cv) AS complex_verb_per_sent, any_value(dist) / nullif(any_value(nd), 0) AS avg_dep_dist, sum(deps) / sum(w) AS avg_dep_count, avg(br) AS avg_words_before_root,
  sum(t + dc) / count(*) AS clausal_density, sum(dc) / sum(t + dc) AS dc_per_clause, sum(cn) / sum(t + dc) AS cn_per_clause, sum(cv) / sum(t + dc) AS cv_per_clause FROM s LEFT JOIN dd USING (doc_id) GROUP BY doc_id""",
    "tunit_features": _FLAGS + f""", u AS (SELECT tu.*, h.upos AS hu FROM tu LEFT JOIN tu h ON h.doc_id = tu.doc_id AND h.sentence_id = tu.sentence_id AND h.term_id = tu.head AND h.compte),
s AS (SELECT {_S}, 1 + count(*) FILTER (th AND head > 0) AS t, count(*) FILTER (compte) AS w, count(*) FILTER (compte AND (upos = 'VERB' OR (upos = 'AUX' AND dep_rel NOT IN {sql_list(AUXILIARIES)})) AND NOT (base = 'conj' AND pred AND NOT own)) AS vp,
  count(*) FILTER (compte AND dep_rel IN {_DC}) AS dc, count(DISTINCT head) FILTER (compte AND base = 'conj' AND NOT (pred AND own) AND hu IN {sql_list(COORDINATED)}) AS cp, count(*) FILTER (compte AND cn) AS cn FROM u GROUP BY ALL),
d AS (SELECT doc_id, sum(t)::BIGINT AS t, sum(dc)::BIGINT AS dc, sum(w)::BIGINT AS w, count(*) AS n, sum(vp) AS vp, sum(cp) AS cp, sum(cn) AS cn, count(*) FILTER (dc > 0) AS ct, count(*) FILTER (t > 1) AS co FROM s GROUP BY doc_id)
SELECT doc_id, t AS n_tunits, n AS n_sentences, w / n AS mls, w / t AS mlt, w / (t + dc) AS mlc, (t + dc) / n AS c_s, t / n AS t_s, (t + dc) / t AS c_t, dc / (t + dc) AS dc_c, dc / t AS dc_t, ct / t AS ct_t, vp / t AS vp_t, cp / t AS cp_t, cp / (t + dc) AS cp_c, cn / t AS cn_t, cn / (t + dc) AS cn_c, co / n AS prop_coord_sent FROM d""",
    "split_clauses": _FLAGS + f""", cl AS MATERIALIZED (SELECT *, th OR dep_rel IN {_DC} AS ich FROM tu),
walk AS (SELECT doc_id, sentence_id, term_id, CASE WHEN ich THEN term_id END AS near FROM cl WHERE head = 0
  UNION ALL SELECT c.doc_id, c.sentence_id, c.term_id, CASE WHEN c.ich THEN c.term_id ELSE p.near END FROM cl c JOIN walk p ON c.doc_id = p.doc_id AND c.sentence_id = p.sentence_id AND c.head = p.term_id),
num AS (SELECT doc_id, sentence_id, term_id AS near, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY term_id) AS clause_id FROM cl WHERE ich)
SELECT doc_id, sentence_id, term_id, ich AS is_clause_head, clause_id FROM cl LEFT JOIN walk USING (doc_id, sentence_id, term_id) LEFT JOIN num USING (doc_id, sentence_id, near)""",
}
