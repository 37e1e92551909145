"""Writers and readers for the Spark ML stages of this package.

A stage names what it holds: plain facts go into the metadata that every stage of Spark ML writes, tables become Parquet
beside it, and stages that it is made of are written below it.  ``PipelineModel`` saves and loads such stages too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.param import Params
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class SavedStage(MLWritable, MLReadable):
    """Mixin of a stage whose attributes are facts (what JSON holds), tables (frames, or null) and parts (stages, or lists of them)."""

    FACTS: Sequence[str] = ()
    TABLES: Sequence[str] = ()
    PARTS: Sequence[str] = ()

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: SavedStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        stage = self.stage
        parts = {p: getattr(stage, p) for p in stage.PARTS}
        held = {p: len(v) if isinstance(v, list) else None for p, v in parts.items()}
        tables = [t for t in stage.TABLES if getattr(stage, t) is not None]
        facts = {"facts": {f: getattr(stage, f) for f in stage.FACTS}, "tables": tables, "parts": held}
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata=facts)
        for name in tables:
            getattr(stage, name).write.parquet(f"{path}/tables/{name}")
        for name, part in parts.items():
            for i, one in enumerate(part if isinstance(part, list) else [part]):
                one.write().save(f"{path}/parts/{name}{i}")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> SavedStage:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark, expectedClassName=f"{self.kind.__module__}.{self.kind.__name__}")
        stage = self.kind.__new__(self.kind)
        Params.__init__(stage)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        for name, value in metadata["facts"].items():
            setattr(stage, name, value)
        for name in self.kind.TABLES:
            setattr(stage, name, spark.read.parquet(f"{path}/tables/{name}") if name in metadata["tables"] else None)
        for name, many in metadata["parts"].items():
            read = [load_stage(f"{path}/parts/{name}{i}", spark) for i in range(1 if many is None else many)]
            setattr(stage, name, read[0] if many is None else read)
        return stage


def load_stage(path: str, spark):
    """Any saved stage or pipeline, of Spark ML or of this package."""
    kind = DefaultParamsReader.loadMetadata(path, spark)["class"]
    return PipelineModel.load(path) if kind.endswith("PipelineModel") else DefaultParamsReader.loadParamsInstance(path, spark)
