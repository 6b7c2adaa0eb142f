"""Fitted models as tables: coefficients with a digest, read only as the frozen recipe and digest say; nothing is unpickled."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.sources.manifests import ManifestError

MODEL = "place int, name string, mean double, scale double, weight double, intercept double, recipe string"


def _rows(model: dict, recipe: str) -> list[tuple]:
    return [(i, n, *model["scale"][n], w, model["intercept"], recipe) for i, (n, w) in enumerate(model["weights"].items())]


def digest(model: dict, recipe: dict) -> str:
    """SHA-256 over every number in full, the names in order and the recipe."""
    rows = _rows(model, json.dumps(recipe, sort_keys=True, allow_nan=False))
    return hashlib.sha256("\n".join("|".join(float(v).hex() if isinstance(v, float) else str(v) for v in r) for r in rows).encode()).hexdigest()


def save(spark: SparkSession, model: dict, recipe: dict, path: str) -> str:
    """Write a model of ``resampling.fit_logistic`` to a new folder and give back its digest, to be kept elsewhere."""
    text = json.dumps(recipe, sort_keys=True, allow_nan=False)
    spark.createDataFrame(_rows(model, text), MODEL).coalesce(1).write.mode("errorifexists").parquet(path)
    return digest(model, recipe)


def load(spark: SparkSession, path: str, expected: str, recipe: dict) -> dict:
    """The model, if its digest is the expected one and its recipe the given one; refused before any number is used."""
    rows: DataFrame = spark.read.schema(MODEL).parquet(path).orderBy("place")
    found = rows.collect()
    if not found or [r["place"] for r in found] != list(range(len(found))):
        raise ManifestError("the model is not whole")
    if {r["recipe"] for r in found} != {json.dumps(recipe, sort_keys=True, allow_nan=False)}:
        raise ManifestError("the model has another recipe")
    model = {"scale": {r["name"]: (r["mean"], r["scale"]) for r in found}, "weights": {r["name"]: r["weight"] for r in found}, "intercept": found[0]["intercept"]}
    if digest(model, recipe) != expected or not rows.filter(F.col("intercept") != found[0]["intercept"]).isEmpty():
        raise ManifestError("the model has another digest")
    return model
