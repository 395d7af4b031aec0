"""Saved models: loading by kind, published versions."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewatch.operators import grown_forest, isolation_forest, random_forest
from tidewatch.operators.grown_forest import GrownForestModel
from tidewatch.operators.isolation_forest import IsolationForestModel, read_params
from tidewatch.operators.random_forest import RandomForestModel

LOG = logging.getLogger(__name__)
LOADERS = {
    isolation_forest.KIND: IsolationForestModel.load,
    random_forest.KIND: RandomForestModel.load,
    grown_forest.KIND: GrownForestModel.load,
}


def load_model(spark: SparkSession, path: str) -> IsolationForestModel | RandomForestModel | GrownForestModel:
    """The model saved at ``path``; its metadata says of which kind it is."""
    kind = read_params(spark, path)["kind"]
    if kind not in LOADERS:
        raise ValueError(f"unknown kind of model at {path}: {kind!r}")
    return LOADERS[kind](spark, path)


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The newest published version below ``root``."""
    try:
        return spark.read.schema("version int").json(f"{root}/published").agg(
            F.max("version")).first()[0]
    except AnalysisException:
        return None


def publish_model(spark: SparkSession, model, root: str) -> int:
    """Save a further version; it counts as published once its marker is written."""
    version = (latest_version(spark, root) or 0) + 1
    model.save(f"{root}/version={version}")
    (spark.createDataFrame([(version,)], "version int").coalesce(1)
     .write.mode("append").json(f"{root}/published"))
    return version


class PublishedModel:
    """The newest published model, looked up again at every use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version, self.model = spark, root, None, None

    def current(self):
        """The model in force. A version that cannot be loaded leaves the one before in place."""
        version = latest_version(self.spark, self.root)
        if version is not None and version != self.version:
            try:
                model = load_model(self.spark, f"{self.root}/version={version}")
            except Exception:
                if self.model is None:
                    raise
                LOG.exception("version %s cannot be loaded, version %s stays", version, self.version)
            else:
                if isinstance(self.model, IsolationForestModel):
                    self.model.release()
                self.model, self.version = model, version
        if self.model is None:
            raise FileNotFoundError(f"no published model below {self.root}")
        return self.model
