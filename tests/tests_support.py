from __future__ import annotations

TOKENS = "doc_id string, paragraph_id int, sentence_id int, term_id int, token_id string, token string, lemma string, upos string, feats string, head_token_id string, dep_rel string, compte boolean, lower_token string"


def token_table(spark, rows):
    """Of (doc_id, sentence_id, term_id, token, head, upos, dep_rel)."""
    return spark.createDataFrame([(d, 1, s, i, str(i), w, w.lower(), u, None, str(h), r, u != "PUNCT", w.lower()) for d, s, i, w, h, u, r in rows], TOKENS)
