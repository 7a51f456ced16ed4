"""A store for fitted models and chains: a JSON header, Parquet tables for numbers and rows, library models in their own format.

Nothing is pickled: the header names classes and functions of this package, and only those are made again.
"""

from __future__ import annotations

import dataclasses
import importlib
import inspect
import json
import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
PACKAGE = "assaykit"
LIBRARY = "pyspark.ml"
# lists of numbers longer than this go to the table of numbers
SHORT = 32


def _name(thing: Any) -> str:
    return f"{thing.__module__}.{thing.__qualname__}"


def _find(name: str, package: str) -> Any:
    if not name.startswith(package + "."):
        raise ValueError(f"{name} is not part of {package}")
    module, _, rest = name.rpartition(".")
    found = getattr(importlib.import_module(module), rest)
    if getattr(found, "__module__", "") != module:
        raise ValueError(f"{name} is not defined there")
    return found


class _Writer:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.numbers: list[np.ndarray] = []
        self.parts = 0

    def _part(self, kind: str) -> str:
        self.parts += 1
        return f"{kind}-{self.parts}"

    def _array(self, x: np.ndarray) -> dict:
        self.numbers.append(x.astype(np.float64).ravel())
        return {"$array": len(self.numbers) - 1, "shape": list(x.shape), "dtype": x.dtype.str}

    def encode(self, x: Any) -> Any:
        if x is None or isinstance(x, (bool, str)):
            return x
        if isinstance(x, (np.bool_, np.integer, np.floating)):
            return self.encode(x.item())
        if isinstance(x, int):
            return x
        if isinstance(x, float):
            return x if math.isfinite(x) else {"$float": repr(x)}
        if isinstance(x, np.ndarray):
            if x.dtype.kind not in "fiub" or (x.dtype.kind in "iu" and x.size and np.abs(x.astype(np.float64)).max() >= 2**53):
                return {"$numpy": self.encode(x.tolist()), "dtype": x.dtype.str}
            return self._array(x)
        if isinstance(x, (list, tuple)):
            kind = "$list" if isinstance(x, list) else "$tuple"
            if len(x) > SHORT and all(type(v) is float for v in x):
                return {kind: self._array(np.array(x))}
            return {kind: [self.encode(v) for v in x]}
        if isinstance(x, dict):
            return {"$dict": [[self.encode(k), self.encode(v)] for k, v in x.items()]}
        if isinstance(x, DataFrame):
            part = self._part("rows")
            x.write.parquet(f"{self.path}/{part}")
            return {"$rows": part}
        if dataclasses.is_dataclass(x) and not isinstance(x, type):
            name = _name(type(x))
            _find(name, PACKAGE)
            return {"$class": name, "fields": {f.name: self.encode(getattr(x, f.name)) for f in dataclasses.fields(x)}}
        if inspect.ismethod(x):
            return {"$method": x.__name__, "of": self.encode(x.__self__)}
        if inspect.isfunction(x):
            if _find(_name(x), PACKAGE) is not x:
                raise TypeError(f"{x} cannot be found again by its name")
            return {"$function": _name(x)}
        if hasattr(x, "write") and type(x).__module__.startswith(LIBRARY + "."):
            part = self._part("library")
            x.write().save(f"{self.path}/{part}")
            return {"$library": _name(type(x)), "part": part}
        raise TypeError(f"a {type(x).__name__} cannot be stored")


class _Reader:
    def __init__(self, spark: SparkSession, path: str, numbers: list[np.ndarray]) -> None:
        self.spark, self.path, self.numbers = spark, path.rstrip("/"), numbers

    def decode(self, x: Any) -> Any:
        if not isinstance(x, dict):
            return x
        if "$float" in x:
            return float(x["$float"])
        if "$array" in x:
            return self.numbers[x["$array"]].astype(x["dtype"]).reshape(x["shape"])
        if "$numpy" in x:
            return np.array(self.decode(x["$numpy"]), dtype=x["dtype"])
        for kind, make in (("$list", list), ("$tuple", tuple)):
            if kind in x:
                return make(self.decode(x[kind]).tolist()) if isinstance(x[kind], dict) else make(self.decode(v) for v in x[kind])
        if "$dict" in x:
            return {self.decode(k): self.decode(v) for k, v in x["$dict"]}
        if "$rows" in x:
            return self.spark.read.parquet(f"{self.path}/{x['$rows']}")
        if "$class" in x:
            kind = _find(x["$class"], PACKAGE)
            if not dataclasses.is_dataclass(kind):
                raise ValueError(f"{x['$class']} is no stored class")
            return kind(**{k: self.decode(v) for k, v in x["fields"].items()})
        if "$method" in x:
            return getattr(self.decode(x["of"]), x["$method"])
        if "$function" in x:
            found = _find(x["$function"], PACKAGE)
            if not inspect.isfunction(found):
                raise ValueError(f"{x['$function']} is no function")
            return found
        if "$library" in x:
            return _find(x["$library"], LIBRARY).load(f"{self.path}/{x['part']}")
        raise ValueError(f"unknown entry {sorted(x)}")


def save_fitted(spark: SparkSession, thing: Any, path: str) -> str:
    """Store a fitted model, preparation, predictor or workflow below a new path; returns the path.

    ``header`` is one line of JSON, ``numbers`` (array, at, value) holds every array of numbers, ``rows-N`` are tables (such as the
    training rows of a neighbour model), ``library-N`` are models of the library.
    """
    writer = _Writer(spark, path)
    header = {"format": f"{PACKAGE}-model", "version": VERSION, "content": writer.encode(thing)}
    parts = [pd.DataFrame({"array": i, "at": np.arange(len(x)), "value": x}) for i, x in enumerate(writer.numbers) if len(x)]
    header["arrays"] = [len(x) for x in writer.numbers]
    table = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"array": [], "at": [], "value": []})
    spark.createDataFrame(table.astype({"array": "int32", "at": "int64", "value": "float64"}), "array int, at long, value double").write.parquet(f"{writer.path}/numbers")
    # the header comes last, so a store without one is not finished
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{writer.path}/header")
    return path


def load_fitted(spark: SparkSession, path: str) -> Any:
    """What ``save_fitted`` stored; a newer version or another format is an error."""
    header = json.loads(spark.read.text(f"{path.rstrip('/')}/header").first()["value"])
    if header.get("format") != f"{PACKAGE}-model" or header.get("version", 0) > VERSION:
        raise ValueError(f"{path} is no model this version can read")
    numbers = [np.zeros(n) for n in header["arrays"]]
    table = spark.read.parquet(f"{path.rstrip('/')}/numbers").toPandas()  # as many numbers as the model held in memory
    for i, part in table.groupby("array"):
        numbers[i][part["at"].to_numpy()] = part["value"].to_numpy()
    return _Reader(spark, path, numbers).decode(header["content"])


def stored_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(array, at, value): the numbers of a stored model, to be read without this package."""
    return spark.read.parquet(f"{path.rstrip('/')}/numbers").orderBy("array", "at").select("array", "at", F.col("value"))
