"""Settings read from YAML files and the environment.

A settings file is flattened to dotted keys and laid over the known keys of its kind; every value takes the type of its default.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from typing import Any

# fixed values: keys and defaults that settings files of these kinds must agree with
KEYS: dict[str, dict[str, Any]] = {
    "terms": {
        "model_name": "terms-regression", "model_version": "v1", "tfidf.ngram_range": (1, 2), "tfidf.min_df": 2, "tfidf.max_df": 0.95, "tfidf.max_features": 20_000,
        "tfidf.sublinear_tf": True, "logistic_regression.C": 1.0, "logistic_regression.class_weight": "balanced", "logistic_regression.max_iter": 1000,
        "logistic_regression.random_state": 42, "label.target": "toxicity", "label.ground_truth_threshold": 0.5,
        "decision_threshold.candidates": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), "decision_threshold.selection_metric": "f1",
    },
    "head": {
        "model_name": "head", "model_version": "v1", "max_seq_length": 64, "hidden_dim": 256, "dropout": 0.1, "learning_rate": 1e-3, "num_epochs": 30, "batch_size": 64,
        "early_stopping_patience": 5, "seed": 42,
    },
    "run": {"log_level": "INFO", "environment": "dev"},
}
ENVIRONMENTS = ("dev", "staging", "production")
PREFIX = "MODQ_"


def flat(values: Mapping[str, Any], above: str = "") -> Iterator[tuple[str, Any]]:
    for name, value in values.items():
        key = f"{above}{name}"
        if isinstance(value, Mapping):
            yield from flat(value, key + ".")
        else:
            yield key, value


def _like(default: Any, value: Any, key: str) -> Any:
    """``value`` as the type of the default; null stays null."""
    if value is None:
        return None
    if isinstance(default, tuple):
        return tuple(value)
    if isinstance(default, bool):
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
        raise ValueError(f"{key}: {value!r} is neither true nor false")
    if isinstance(default, int) and int(value) != float(value):
        raise ValueError(f"{key}: {value!r} is no whole number")
    return type(default)(value)


def settings(kind: str = "terms", values: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """All keys of a kind with their values; unknown keys are an error."""
    known = KEYS[kind]
    given = dict(flat(values or {}))
    if extra := given.keys() - known.keys():
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return {k: _like(d, given[k], k) if k in given else d for k, d in known.items()}


def load(path: str, kind: str = "terms") -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(kind, yaml.safe_load(f) or {})


def run_settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings of a run: defaults, then a file if it exists, then variables with the prefix."""
    out = load(path, "run") if path and os.path.exists(path) else settings("run")
    variables = os.environ if environment is None else environment
    out.update({k: variables[PREFIX + k.upper()] for k in out if PREFIX + k.upper() in variables})
    if out["environment"] not in ENVIRONMENTS:
        raise ValueError(f"environment: {out['environment']!r} is none of {ENVIRONMENTS}")
    return out
