"""How far each consumer has come: one small file per consumer, replaced when it moves on."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidemark.sinks import files


def save_position(spark: SparkSession, root: str, consumer: str, scn: int) -> None:
    """All changes below ``scn`` have reached ``consumer`` for good."""
    folder = f"{root.rstrip('/')}/consumer={consumer}"
    versions = files.numbered(spark, folder)
    n = versions[-1] + 1 if versions else 0
    files.write_text(spark, f"{folder}/{n}.json", json.dumps({"scn": scn}))
    for old in versions[:-1]:
        files.remove(spark, f"{folder}/{old}.json")


def positions(spark: SparkSession, root: str) -> dict[str, int]:
    found = {}
    for name in files.children(spark, root):
        versions = files.numbered(spark, f"{root.rstrip('/')}/{name}")
        if name.startswith("consumer=") and versions:
            text = files.read_text(spark, f"{root.rstrip('/')}/{name}/{versions[-1]}.json")
            found[name.removeprefix("consumer=")] = json.loads(text)["scn"]
    return found


def low_water(spark: SparkSession, root: str) -> int | None:
    """The change number that even the slowest consumer has passed; none if no consumer is known."""
    return min(positions(spark, root).values(), default=None)


def reset_position(spark: SparkSession, root: str, consumer: str, checkpoint: str | None = None) -> bool:
    """Forget a consumer, and with its checkpoint what its stream has read. False if it was not known."""
    if checkpoint:
        files.remove(spark, checkpoint)
    return files.remove(spark, f"{root.rstrip('/')}/consumer={consumer}")
