"""Trained models as files: saved once, checked against new data, scored without fitting again."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from oreflow.functions.values import is_number
from oreflow.operators import cart, models

VERSION = 2
#: What the plain kinds hold besides their encoder; all of it can be written as JSON.
PLAIN: dict[type, tuple[str, ...]] = {
    models.gradient.Network: ("prefix", "target", "classes", "layers"),
    models.Svm: ("target", "classes", "planes"),
    models.KMeans: ("centres", "mean", "cut"),
    models.Anomaly: ("centres", "means", "cut"),
    cart.Cart: ("target", "numbers", "order", "classes", "nodes"),
}


def _inputs(model: Any) -> dict[str, bool]:
    """The input fields and whether each is a number."""
    if isinstance(model, models.NaiveBayes):
        return {f: True for f in model.numbers} | {f: False for f in model.texts}
    if isinstance(model, models.Chaid):
        return dict(model.ordered)
    if isinstance(model, cart.Cart):
        return {f: f in model.numbers for f in model.order}
    if isinstance(model, models.Rules):
        return {}
    return {f: f in model.encoder.numbers for f in model.encoder.order}


def check(model: Any, df: DataFrame) -> None:
    """Every input of ``model`` must be in ``df`` and of its type."""
    for f, number in _inputs(model).items():
        want = "number" if number else "string"
        if f not in df.columns:
            raise ValueError(f"The model reads {f}, which the data lack.")
        if is_number(df, f) != number:
            raise ValueError(f"The model reads {f} as a {want}, which it is not in the data.")


def score(model: Any, df: DataFrame) -> DataFrame:
    """``df`` with the model's fields; the target need not be there."""
    check(model, df)
    return model.transform(df)


def save(model: Any, path: str, spark: SparkSession) -> None:
    """Writes what the model learnt to the folder ``path``: numbers and names as JSON, tables as Parquet, MLlib's part by MLlib."""
    kind = type(model).__name__
    state: dict[str, Any] = {}
    if hasattr(model, "encoder"):
        state["encoder"] = vars(model.encoder)
    if type(model) in PLAIN:
        state |= {k: getattr(model, k) for k in PLAIN[type(model)]}
    elif isinstance(model, models.Supervised):
        state |= {"prefix": model.prefix, "target": model.target}
        model.model.write().save(f"{path}/model")
    elif isinstance(model, models.NaiveBayes):
        state |= {k: getattr(model, k) for k in ("target", "numbers", "texts", "classes", "prior", "bells")}
        state["unseen"] = {f: unseen for f, (_, unseen) in model.tables.items()}
        for i, f in enumerate(model.texts):
            model.tables[f][0].write.parquet(f"{path}/table-{i}")
    elif isinstance(model, models.Chaid):
        state |= {k: getattr(model, k) for k in ("target", "inputs", "ordered", "cuts", "values")}
        state["nodes"] = [n | ({"split": n["split"] | {"children": sorted(n["split"]["children"].items())}} if n.get("split") else {}) for n in model.nodes]
    elif isinstance(model, models.Neighbours):
        state |= {k: getattr(model, k) for k in ("target", "numeric", "k")}
        model.vectors.write.parquet(f"{path}/table-0")
    elif isinstance(model, models.Rules):
        model.rules.write.parquet(f"{path}/table-0")
    else:
        raise ValueError(f"There is no way to save a {kind}.")
    spark.createDataFrame([(json.dumps({"version": VERSION, "kind": kind, "state": state}),)], "value string").write.text(f"{path}/recipe")


def load(spark: SparkSession, path: str) -> Any:
    """The model that :func:`save` wrote."""
    recipe = json.loads(spark.read.text(f"{path}/recipe").first()["value"])
    if recipe.get("version") != VERSION:
        raise ValueError("This folder holds no model of this version.")
    kind, state = recipe["kind"], recipe["state"]
    if "encoder" in state:
        e = state.pop("encoder")
        state["encoder"] = models.Encoder({f: (m, s) for f, (m, s) in e["numbers"].items()}, e["texts"], e["order"])
    if kind == "Supervised":
        return models.Supervised(state["prefix"], state["target"], state["encoder"], PipelineModel.load(f"{path}/model"))
    cls = {c.__name__: c for c in (*PLAIN, models.NaiveBayes, models.Chaid, models.Neighbours, models.Rules)}[kind]
    model = cls.__new__(cls)
    if kind == "NaiveBayes":
        unseen = state.pop("unseen")
        state["tables"] = {f: (spark.read.parquet(f"{path}/table-{i}"), unseen[f]) for i, f in enumerate(state["texts"])}
        state["bells"] = {f: [tuple(x) if x else None for x in own] for f, own in state["bells"].items()}
    elif kind == "Chaid":
        for n in state["nodes"]:
            if n.get("split"):
                n["split"]["children"] = dict(map(tuple, n["split"]["children"]))
    elif kind == "Neighbours":
        state["vectors"] = spark.read.parquet(f"{path}/table-0")
    elif kind == "Rules":
        state["rules"] = spark.read.parquet(f"{path}/table-0")
    vars(model).update(state)
    return model
