"""The facts document: one small JSON object, read once when a plan is built."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from askorpus.config import Settings
from askorpus.functions.rules import Rule, load_rules


def read_facts(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one facts document")
    return json.loads(rows[0][0])


def read_rules(spark: SparkSession, path: str, settings: Settings) -> tuple[Rule, ...]:
    return load_rules(read_facts(spark, path), settings.company_name, settings.company_short)
