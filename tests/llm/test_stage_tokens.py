"""The pipeline's last stage encodes and decodes."""

import corpus_pipeline
from riskframe.llm.pieces import Vocabulary


def test_last_stage_says_whether_ids_decode_to_the_text(spark, monkeypatch):
    own = Vocabulary(["▁", "a", "b"], [-1.0, -1.0, -1.0], None, 3, [0, 1, 2], 4)
    monkeypatch.setattr(corpus_pipeline.pieces, "read_vocabulary", lambda path: own)
    docs = spark.createDataFrame([(1, "ab a", "en", "s", 5), (2, "aéb", "fr", "s", 5), (3, None, None, "s", 5)], "doc_id long, text string, lang string, source string, more int")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").orderBy("doc_id").collect()
    assert out[0].asDict().keys() == {"doc_id", "lang", "source", "ids", "n_tokens", "same"}
    # Without byte pieces the second text has an unknown character, which does not come back.
    assert [(r["n_tokens"], r["same"]) for r in out] == [(5, True), (4, False), (0, True)]
