"""Executors need not have the package: every operator that sends a model runs from a folder of its own."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.append({root!r})
from pyspark.sql import functions as F
from riskframe.llm import ann, embed_dups, katz, langid, periodic, pieces, pii, simhash, tokens, whitening
from riskframe.session import local_session
spark = local_session(2, "travel", **{{"spark.sql.shuffle.partitions": "2"}})
docs = spark.createDataFrame([(i, f"word{{i}} and mail me{{i}}@x.org " * 3, "en") for i in range(40)], "doc_id long, text string, lang string")
vectors = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"), F.lit(1).alias("label"))
words = pieces.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
frames = [
    langid.with_language(docs, langid.fit_languages(docs)), ann.nearest(vectors, F.col("vec_id") % 20 == 0), tokens.token_counts(docs, words),
    pieces.round_trip(docs, words), simhash.near_duplicates(docs), pii.personal_data(docs, pii.fit_tagger(docs)), katz.katz_scores(docs, F.lit(True)),
    embed_dups.near_vectors(vectors), whitening.whiten(vectors), periodic.word_runs(docs),
]
for frame in frames:
    assert frame.count() and frame.collect()
print("all ran")
"""


def test_models_travel(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(root=root))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
