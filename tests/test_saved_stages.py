"""Train in one session, save, and predict in another process: the whole chain; writers of every stage; many levels."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskframe.ml import training
from riskframe.ml.chain import RiskPipeline, RiskPipelineModel
from riskframe.prep.encode import DateTimeEncoder, FeatureBuilder, NumericEncoder, OneHotEncoder
from riskframe.prep.select import FeatureSelection

ROOT = str(Path(__file__).resolve().parents[1])
PREDICT = """
import sys, json
sys.path.insert(0, {root!r})
from riskframe.session import local_session
from riskframe.ml.chain import RiskPipelineModel
spark = local_session(2, "predict", **{{"spark.sql.shuffle.partitions": "2"}})
model = RiskPipelineModel.load({model!r})
out = model.transform(spark.read.parquet({rows!r})).orderBy("SPT_RowID").collect()
print("RESULT" + json.dumps([list(r) for r in out]))
"""


def purchase_orders(spark, n=240):
    """Rows whose risk depends on amount, vendor class and month, with a free text, a unique code and nulls."""
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("SPT_RowID"), (F.pmod(F.hash(i), F.lit(9000)) / 7.0).alias("amount"),
        F.when(i % 11 != 0, F.element_at(F.array(*map(F.lit, ["Local", "Foreign", "One-time"])), (i % 3 + 1).cast("int"))).alias("vendor_class"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i * 7 % 300).cast("int")).alias("posted"), F.concat(F.lit("PO"), i.cast("string")).alias("code"),
        F.lit("a note of more than five words in every row").alias("note"),
    )
    noise = F.pmod(F.hash("SPT_RowID", F.lit(1)), F.lit(10)) == 0
    risky = ((F.col("amount") > 700) & (F.coalesce("vendor_class", F.lit("")) != "Local")) != noise
    return rows.withColumn("target", risky.cast("int"))


def test_train_save_and_predict_in_another_process(spark, tmp_path):
    rows = purchase_orders(spark)
    model = RiskPipeline("SPT_RowID", "target", ["amount"], algorithms=["Decision Tree", "Ada Boost"]).fit(rows)
    assert all(v > 0 for v in model.metrics.values())
    assert model.roles == {"amount": "numeric", "vendor_class": "categorical", "posted": "datetime", "code": "dropped", "note": "dropped"}
    # Rows to score have no target, and lack a column that training had.
    new = purchase_orders(spark, 50).drop("target", "note")
    want = [list(r) for r in model.transform(new).orderBy("SPT_RowID").collect()]
    assert [r[0] for r in want] == list(range(50)) and {r[1] for r in want} == {0, 1}
    model.save(str(tmp_path / "model"))
    new.write.parquet(str(tmp_path / "rows"))
    script = tmp_path / "predict.py"
    script.write_text(PREDICT.format(root=ROOT, model=str(tmp_path / "model"), rows=str(tmp_path / "rows")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    lines = [x for x in done.stdout.splitlines() if x.startswith("RESULT")]
    assert lines, done.stderr[-3000:]
    assert json.loads(lines[0][6:]) == want
    assert RiskPipelineModel.load(str(tmp_path / "model")).transform(new.drop("vendor_class")).count() == 50
    model.write().overwrite().save(str(tmp_path / "model"))


def test_every_stage_saves_and_loads(spark, tmp_path):
    rows = purchase_orders(spark, 120).drop("code", "note", "posted").withColumn("amount", F.col("SPT_RowID") % 3 + 0.5)
    stages = [
        NumericEncoder(["amount"]), DateTimeEncoder(["posted"]), OneHotEncoder(["vendor_class"]),
        FeatureBuilder("SPT_RowID", ["amount"], [], ["vendor_class"], "target"), RiskPipeline("SPT_RowID", "target", ["amount"]),
    ]
    for i, stage in enumerate(stages):
        stage.save(f"{tmp_path}/stage{i}")
        loaded = type(stage).load(f"{tmp_path}/stage{i}")
        assert loaded.uid == stage.uid and all(getattr(loaded, f) == getattr(stage, f) for f in stage.FACTS)
    builder = stages[3]
    chain = Pipeline(stages=[builder, FeatureSelection("SPT_RowID", "target")]).fit(rows)
    chain.save(f"{tmp_path}/chain")
    again = PipelineModel.load(f"{tmp_path}/chain")
    want = chain.transform(rows)
    assert again.transform(rows).columns == want.columns and again.transform(rows).exceptAll(want).count() == 0
    data = training.assemble(want.withColumn("label", F.col("target").cast("double")), chain.stages[1].features)
    boosted = training.AdaBoostClassifier(rounds=4).fit(data)
    trained = training.TrainedModel("Ada Boost", boosted, {"f1": 0.5}, chain.stages[1].features)
    training.save_trained(trained, spark, f"{tmp_path}/boosted")
    loaded = training.load_trained(spark, f"{tmp_path}/boosted")
    assert loaded.model.weights == boosted.weights
    columns = ["SPT_RowID", "prediction", "_p1"]
    assert loaded.model.transform(data).select(columns).exceptAll(boosted.transform(data).select(columns)).count() == 0


@pytest.mark.parametrize("levels, limit", [(100_000, 1_000), (12, 5)])
def test_many_levels_become_one_sparse_vector(spark, tmp_path, levels, limit):
    rows = spark.range(2 * levels).select("id", F.concat(F.lit("L"), F.format_string("%06d", F.col("id") % levels)).alias("code"), (F.col("id") % 3).cast("string").alias("few"))
    model = OneHotEncoder(["code", "few"], most_columns=limit).fit(rows)
    model.save(f"{tmp_path}/onehot")
    for one in (model, type(model).load(f"{tmp_path}/onehot")):
        assert one.vector_names == ["code=levels"] and one.feature_names == ["few=0", "few=1", "few=2"]
        new = spark.createDataFrame([(1, "L000003", "1"), (2, "unseen", "9"), (3, None, None)], "id int, code string, few string")
        got = {r["id"]: (r["code=levels"], r["few=1"]) for r in one.transform(new).collect()}
        assert got[1][0].size == levels and got[1][0].indices.tolist() == [3] and got[1][1] == 1
        assert got[2][0].indices.tolist() == got[3][0].indices.tolist() == [] and got[2][1] == got[3][1] == 0
    assert model.transform(rows).count() == 2 * levels
