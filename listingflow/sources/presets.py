"""Presets and prompt documents: small configuration, read through Spark so that its store may be remote."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def read_document(spark: SparkSession, path: str) -> str:
    """The text of one prompt or side document."""
    return spark.read.text(path, wholetext=True).first()["value"]


def read_presets(spark: SparkSession, path: str) -> dict[str, dict]:
    """Presets by name, from a JSON object or a list of objects with a ``name``."""
    found = json.loads(read_document(spark, path))
    return {p["name"]: p for p in found} if isinstance(found, list) else {k: {"name": k, **v} for k, v in found.items()}


def preset(presets: dict[str, dict], name: str) -> dict:
    if name not in presets:
        raise KeyError(f"no preset {name}; there are {', '.join(sorted(presets)) or 'none'}")
    return presets[name]
