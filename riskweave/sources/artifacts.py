"""Saved models: where they may go, and round trips."""

from __future__ import annotations

from riskweave.sources.io import read_json, write_json


def resolve_suffix(suffix: str, promote: bool) -> str:
    """The file suffix of a run: a named candidate, or production, which has to be asked for.

    An empty suffix without promote, and a suffix with promote, are errors; call this before any data are loaded.
    """
    if suffix and promote:
        raise ValueError("a named candidate can't be promoted in the same run")
    if not suffix and not promote:
        raise ValueError("overwriting the production model needs promote")
    return f"_{suffix.lstrip('_')}" if suffix else ""


def save_artifact(value: dict, path: str) -> None:
    """A fitted mapping as JSON; parent folders are made."""
    write_json(value, path)


def load_artifact(path: str) -> dict:
    return read_json(path)


def save_model(model, path: str) -> None:
    """A pyspark.ml model, over an older one."""
    model.write().overwrite().save(path)
