"""Fitted pipelines on disk, each with a contract that a loader has to meet."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.stored import shared_root

VERSION = 1


def without_summary(model: PipelineModel) -> PipelineModel:
    """The same pipeline, its logistic models written and read again: the summary of a fit refers to the session, which can't be sent to tasks any more once something has been observed in it."""
    root = shared_root(SparkSession.getActiveSession())

    def again(stage: Transformer) -> Transformer:
        if not isinstance(stage, LogisticRegressionModel):
            return without_summary(stage) if isinstance(stage, PipelineModel) else stage
        path = f"{root}/model-{uuid.uuid4().hex}"
        stage.write().save(path)
        return LogisticRegressionModel.load(path)

    return PipelineModel([again(s) for s in model.stages])


def save_model(model: PipelineModel | str, path: str, contract: dict) -> None:
    """Write a pipeline, or a model as text, to ``path``/model and its contract (columns, vocabulary, digest of its input) to ``path``/contract, wherever Spark can write."""
    spark = SparkSession.getActiveSession()
    if isinstance(model, str):
        spark.createDataFrame([(model,)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    text = json.dumps({**contract, "version": VERSION}, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load_model(spark: SparkSession, path: str, expected: dict, text: bool = False) -> PipelineModel | str:
    """The pipeline, or the text that was saved, if its version and every entry of ``expected`` are those of its contract; else a ValueError."""
    found = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    if wrong := sorted(k for k, v in {**expected, "version": VERSION}.items() if found.get(k) != v):
        raise ValueError(f"the model was made under another contract: {', '.join(wrong)}")
    return spark.read.parquet(f"{path}/model").first()["value"] if text else PipelineModel.load(f"{path}/model")


def score(model: PipelineModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The model's output for rows that have the columns it was fitted on; a ValueError names those that are missing."""
    if missing := sorted(set(columns) - set(rows.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return model.transform(rows)
