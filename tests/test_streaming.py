import numpy as np

from kestrel.operators.scale import Scaler
from kestrel.plans.model_selection import TrainedModel
from kestrel.streaming.scoring import score_stream
from tests.conftest import SF001


def test_stream_scoring_matches_batch(spark, tmp_path):
    from kestrel.sources import tables

    emb = tables.embeddings(spark, SF001)
    scaler = Scaler().fit(emb)
    w = np.linspace(-1, 1, 65)
    model = TrainedModel("linear", w, 1.0, None, None, True)
    batch = {r.row_id: r.prediction for r in score_stream(emb, scaler, None, model).collect()}
    import shutil

    src_dir = tmp_path / "in"
    src_dir.mkdir()
    shutil.copy(f"{SF001}/embeddings.parquet", src_dir / "part-0.parquet")
    stream = spark.readStream.schema(spark.read.parquet(f"{SF001}/embeddings.parquet").schema).parquet(str(src_dir))
    src = stream.selectExpr("vec_id as row_id", "transform(embedding, x -> cast(x as double)) as features")
    q = score_stream(src, scaler, None, model).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = {r.row_id: r.prediction for r in spark.sql("select row_id, prediction from scored").collect()}
    assert got == batch
