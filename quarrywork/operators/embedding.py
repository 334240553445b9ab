"""Embedding through a batch model, each distinct text once, with a content-addressed store.

A model is a function without arguments that loads it and returns a function from an array of texts to a
matrix with a row for each; Spark calls the first once a worker and the second with batches
(``predict_batch_udf``).  Texts are known by their sha256, so equal texts, in one run or in later ones, are
embedded once: what the store lacks is embedded, written as a new part, and named in the store's log; all
rows are then joined with the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import ship_package
from ..sources.versions import Versions

Model = Callable[[], Callable[[np.ndarray], np.ndarray]]


def guarded(model: Model, dim: int) -> Model:
    """A model that answers a text on which it fails with zeros: after a failed batch, texts are tried one by
    one, so that the others of the batch keep their vectors."""

    def load():
        embed = model()

        def tried(texts: np.ndarray) -> np.ndarray | None:
            try:
                out = np.asarray(embed(texts), np.float64)
            except Exception:
                return None
            return out if out.shape == (len(texts), dim) and np.isfinite(out).all() else None

        def safe(texts: np.ndarray) -> np.ndarray:
            texts = np.asarray(texts, object).reshape(-1)
            out = tried(texts)
            if out is None:
                one = [tried(texts[k : k + 1]) for k in range(len(texts))]
                out = np.array([np.zeros(dim) if x is None else x[0] for x in one]).reshape(-1, dim)
            return out

        return safe

    return load


def embedded_by(model: Model, dim: int, text: Column, batch_size: int = 64) -> Column:
    """Vectors of a column of texts (not null), by batches; zeros where the model fails.  Declared not
    deterministic, so that a filter on the vectors does not call the model a second time."""
    return predict_batch_udf(guarded(model, dim), return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size).asNondeterministic()(text)


class EmbeddingStore:
    """Vectors by digest of text: parts of a table, named in a log, so writers may work at the same time (a
    text that two of them embed counts once)."""

    def __init__(self, spark: SparkSession, root: str, model: Model, dim: int, batch_size: int = 64):
        self.spark, self.model, self.dim, self.batch_size = spark, model, dim, batch_size
        self.log = Versions(spark, root)

    def rows(self) -> DataFrame:
        """digest, vector: one row for each text that is known."""
        parts = self.log.log.newest()[1].get("parts", [])
        if not parts:
            return self.spark.createDataFrame([], "digest string, vector array<double>")
        return self.spark.read.schema("digest string, vector array<double>").parquet(*parts).dropDuplicates(["digest"])

    def add(self, texts: DataFrame, text: str) -> int:
        """Embeds what is not known yet, each distinct text once; returns how many texts that were.

        A text on which the model failed is not kept: it is tried again next time.
        """
        ship_package(self.spark)
        path = f"{self.log.root}/part-{uuid.uuid4().hex}"
        new = texts.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
        new = new.join(self.rows().select("digest"), "digest", "left_anti")
        vectors = new.select("digest", embedded_by(self.model, self.dim, F.col("text"), self.batch_size).alias("vector"))
        vectors.where(F.exists("vector", lambda x: x != 0)).write.parquet(path)
        added = self.spark.read.schema("digest string").parquet(path).count()
        if added:
            self.log._commit(lambda log: {**log, "parts": [*log.get("parts", []), path]})
        return added

    def embed(self, texts: DataFrame, text: str, out: str = "vector") -> DataFrame:
        """``texts`` with vectors; zeros for null texts and those on which the model failed."""
        self.add(texts, text)
        known = self.rows().select(F.col("digest").alias("__d"), F.col("vector").alias("__v"))
        zero = F.array_repeat(F.lit(0.0), self.dim)
        return texts.join(known, F.sha2(F.col(text), 256) == F.col("__d"), "left").withColumn(out, F.coalesce("__v", zero)).drop("__d", "__v")
