"""Relevance labels and settings from files, checked as they are read."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

LABELS = "query_id string, category string, query string, relevant array<struct<file:string,start_line:int,end_line:int>>"
CATEGORIES = ("nl", "symbol", "structural")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries from JSON, or from YAML where a reader for it is installed; anything odd raises ValueError."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("no YAML reader is installed") from e
            data = yaml.safe_load(f)
        else:
            data = json.load(f)
    rows, seen = [], set()
    for q in data["queries"] if isinstance(data, dict) else data:
        if q["id"] in seen:
            raise ValueError(f"repeated id {q['id']}")
        seen.add(q["id"])
        if q["category"] not in CATEGORIES or not q.get("relevant"):
            raise ValueError(f"{q['id']}: unknown category or no relevant file")
        relevant = []
        for r in q["relevant"]:
            a, b = r.get("lines") or (None, None)
            if a is not None and not 1 <= a <= b:
                raise ValueError(f"{q['id']}: lines {a} to {b}")
            relevant.append((r["path"], a, b))
        rows.append((q["id"], q["category"], q["query"], relevant))
    return spark.createDataFrame(rows, LABELS)


@dataclass(frozen=True)
class Settings:
    top_k: int = 10
    candidates: int = 50
    chunk_tokens: int = 800
    max_file_bytes: int = 1_048_576
    quiet_seconds: float = 2.0
    languages: tuple[str, ...] = ()


def load_settings(path: str | None = None) -> Settings:
    """Settings from TOML; unknown names and values of another type raise ValueError."""
    if path is None:
        return Settings()
    with open(path, "rb") as f:
        data = tomllib.load(f)
    known = {f.name: f for f in fields(Settings)}
    for k, v in data.items():
        if k not in known:
            raise ValueError(f"unknown setting {k}")
        want = type(getattr(Settings(), k))
        data[k] = tuple(v) if want is tuple and isinstance(v, list) else float(v) if want is float and isinstance(v, int) and not isinstance(v, bool) else v
        if not isinstance(data[k], want) or (want is int and isinstance(v, bool)):
            raise ValueError(f"{k} must be {want.__name__}")
    return Settings(**data)
