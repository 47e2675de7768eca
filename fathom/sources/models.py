"""Saved models: parameters and learned state as one row of JSON, coefficients as a Parquet table.

Nothing saved is code: families and links are named, expressions are SQL, arrays are numbers. A file of an
older version is carried forward step by step; one of a version that this library does not know
is refused.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VERSION = 2
#: Attributes of a fitted model that are not saved.
_LEFT_OUT = ("design_", "_args", "family_instance_", "link_instance_", "family", "link")


def _sql(column) -> str:
    return column._jc.node().sql() if hasattr(column._jc, "node") else column._jc.expr().sql()


def _plain(value):
    """A value as JSON can hold it; ``_value`` reads it back."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "kind": str(value.dtype)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, tuple):
        return {"tuple": [_plain(v) for v in value]}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {"pairs": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"a {type(value).__name__} cannot be saved")


def _value(saved):
    if isinstance(saved, list):
        return [_value(v) for v in saved]
    if isinstance(saved, dict):
        if "array" in saved:
            return np.array(saved["array"], saved["kind"])
        if "tuple" in saved:
            return tuple(_value(v) for v in saved["tuple"])
        return {_value(k): _value(v) for k, v in saved["pairs"]}
    return saved


def _named(thing) -> dict:
    """A family or link by the name of its class and its numbers."""
    return {"class": type(thing).__name__, "own": not type(thing).__module__.startswith("fathom.functions."), "values": _plain({k: v for k, v in vars(thing).items() if isinstance(v, (int, float, str, np.generic))})}


def _made(saved: dict, module, given):
    if given is not None:
        return given
    if saved["own"] or not hasattr(module, saved["class"]):
        raise ValueError(f"{saved['class']} is not of this library: give an instance of it to load()")
    thing = object.__new__(getattr(module, saved["class"]))
    vars(thing).update(_value(saved["values"]))
    return thing


def to_json(model) -> str:
    """The whole fitted model as JSON."""
    design = model.design_
    factors = design.factors()
    order = {id(f): k for k, f in enumerate(factors)}
    by_key = {f.key or f.name: k for k, f in enumerate(factors)}
    listed = [{"name": f.name, "source": _sql(f.source), "columns": [[n, _sql(c)] for n, c in f.columns], "levels": None if f.levels is None else [_plain(x) for x in f.levels], "missing": f.missing, "method": f.method, "variable": f.variable, "ordered": f.ordered} for f in factors]
    terms = [[t, [order.get(id(f), by_key[f.key or f.name]) for f in fs], list(r)] for t, fs, r in design.terms]
    state = {}
    for name, value in vars(model).items():
        if name not in _LEFT_OUT:
            try:
                state[name] = _plain(value)
            except TypeError:
                continue  # Columns and other live objects belong to a session
    return json.dumps({"version": VERSION, "class": type(model).__name__, "state": state, "factors": listed, "terms": terms, "design": [design.interaction, design.format, design.missing_name], "family": _named(model.family_instance_), "link": _named(model.link_instance_)})


def _from_1(data: dict) -> dict:
    """Version 1 had no variables of factors: each stood for itself."""
    for f in data["factors"]:
        f.setdefault("variable", f["name"])
        f.setdefault("ordered", not f["name"].startswith("poly("))
    return data | {"version": 2}


#: What carries a saved model from a version to the next.
MIGRATIONS = {1: _from_1}


def from_json(text: str, family=None, link=None):
    """The model of :func:`to_json`; own families and links must be given."""
    from ..functions import families, links
    from ..operators.glm import GeneralizedLinearRegressor
    from ..operators.glm_cv import GeneralizedLinearRegressorCV
    from ..plans.design import Design, Factor

    data = json.loads(text)
    while data.get("version") in MIGRATIONS:
        data = MIGRATIONS[data["version"]](data)
    if data.get("version") != VERSION:
        raise ValueError(f"a saved model of version {data.get('version')!r} is not known; this library writes version {VERSION}")
    model = {c.__name__: c for c in (GeneralizedLinearRegressor, GeneralizedLinearRegressorCV)}[data["class"]]()
    vars(model).update({k: _value(v) for k, v in data["state"].items()})
    factors = [Factor(f["name"], F.expr(f["source"]), [(n, F.expr(c)) for n, c in f["columns"]], None if f["levels"] is None else [_value(x) for x in f["levels"]], f["missing"], f["method"], variable=f["variable"], ordered=f["ordered"]) for f in data["factors"]]
    model.design_ = Design([(t, [factors[k] for k in fs], tuple(r)) for t, fs, r in data["terms"]], *data["design"])
    model.family_instance_, model.link_instance_ = _made(data["family"], families, family), _made(data["link"], links, link)
    model.family, model.link = model.family_instance_, model.link_instance_
    return model


def save(model, spark: SparkSession, path: str) -> None:
    """Write ``path``/state and ``path``/coefficients."""
    spark.createDataFrame([(VERSION, to_json(model))], "version int, state string").write.mode("overwrite").parquet(f"{path}/state")
    model.export(spark).write.mode("overwrite").parquet(f"{path}/coefficients")


def load(spark: SparkSession, path: str, family=None, link=None):
    """A model of :func:`save`."""
    return from_json(spark.read.parquet(f"{path}/state").first().state, family, link)
