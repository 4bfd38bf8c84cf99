"""The intent configuration: names, descriptions, rules and examples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from parlova.schemas import SchemaError, intent_dimension


def read_intent_config(spark: SparkSession, path: str) -> DataFrame:
    """The intent table from a YAML or JSON file with a list ``intents``, read through Spark.

    Each entry has a ``name`` and may have ``description``, ``inclusion_rules``,
    ``exclusion_rules`` and ``examples``; other keys are ignored. YAML needs the yaml package.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.lower().endswith(".json"):
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text)
    rows = config.get("intents") if isinstance(config, dict) else None
    if not rows or any(not r.get("name") for r in rows):
        raise SchemaError("the configuration needs a list of intents, each with a name")
    return intent_dimension(spark, [{k: v for k, v in r.items() if v is not None} for r in rows])
