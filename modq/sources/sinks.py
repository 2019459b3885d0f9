"""Writers: examples per split, JSON reports, versioned artifacts (K1-K5)."""

from __future__ import annotations

import json
import platform
import subprocess
import sys
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame


def write_splits(df: DataFrame, path: str, force: bool = False, kind: str = "parquet") -> None:
    """One folder per split; an existing target fails unless ``force``."""
    df.write.mode("overwrite" if force else "errorifexists").partitionBy("split").format(kind).save(path)


def write_json(value: dict[str, Any], path: str | Path, ascii_only: bool = False) -> None:
    """Sorted keys, two spaces."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=ascii_only, default=str), encoding="utf-8")


def git_commit() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def environment() -> dict[str, str]:
    return {"python": sys.version.split()[0], "spark": pyspark.__version__, "platform": platform.platform()}


def save_model(model: Any, folder: str, config: dict, threshold: float, spark: Any, version: str = "v1") -> None:
    """Model, configuration, metadata and threshold in one versioned folder."""
    base = Path(folder) / version
    model.save(str(base / "model"), spark)
    write_json(config, base / "config.json")
    write_json({"version": version, "commit": git_commit(), "created": datetime.now(UTC).isoformat(), **environment()}, base / "metadata.json")
    write_json({"threshold": threshold}, base / "threshold.json")


def load_model(cls: type, folder: str, spark: Any, version: str = "v1") -> tuple[Any, dict, float]:
    base = Path(folder) / version

    def read(name: str) -> dict:
        return json.loads((base / name).read_text(encoding="utf-8"))

    return cls.load(str(base / "model"), spark), read("config.json"), read("threshold.json")["threshold"]
