"""Extension points by dotted path, and settings of evaluation sets."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

#: What a registered function takes and returns.
KINDS = ("table", "column", "group", "sink")


def load(path: str) -> Callable:
    """The function at module.name."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"not a dotted path: {path}")
    return getattr(importlib.import_module(module), name)


class Registry:
    """Named extension functions of a few kinds."""

    def __init__(self):
        self._found: dict[tuple[str, str], Callable] = {}

    def register(self, kind: str, name: str, function: Callable | str) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        self._found[kind, name] = load(function) if isinstance(function, str) else function

    def get(self, kind: str, name: str) -> Callable:
        return self._found[kind, name]

    def apply(self, df: DataFrame, *names: str) -> DataFrame:
        """Table functions, one after the other."""
        for name in names:
            df = self.get("table", name)(df)
        return df


def resolve_settings(sets: list[Mapping[str, Any]], defaults: Mapping[str, Any], args: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Settings of each evaluation set: its own, else the defaults', else the arguments'. name and path are needed."""
    out = []
    for one in sets:
        if "name" not in one or "path" not in one:
            raise ValueError("an evaluation set needs a name and a path")
        keys = dict.fromkeys([*one, *defaults, *args])
        first = {k: next((m[k] for m in (one, defaults, args) if m.get(k) is not None), None) for k in keys}
        extra = first.get("metadata_overrides") or {}
        if not isinstance(extra, Mapping):
            raise TypeError("metadata_overrides must be a mapping")
        out.append(first | {"metadata_overrides": dict(extra)})
    return out


def inject_metadata(metadata: Mapping[str, Any] | None, settings: Mapping[str, Any]) -> dict[str, Any]:
    """Metadata of a sample with the set's grader and overrides."""
    out = dict(metadata or {}) | dict(settings.get("metadata_overrides") or {})
    if settings.get("rm_type") is not None:
        out["rm_type"] = settings["rm_type"]
    return out


def due(step: int, interval: int | None, per_epoch: int | None = None) -> bool:
    """Whether a periodic action falls on a step: every interval steps, and at the end of an epoch."""
    if interval is None:
        return False
    return (step + 1) % interval == 0 or (per_epoch is not None and (step + 1) % per_epoch == 0)


def check_batch(prompts: int, samples: int, batch: int, steps: int) -> None:
    if prompts * samples != batch * steps:
        raise ValueError("prompts * samples must equal batch * steps")


def forward_flops(lengths: list[int], hidden: int, layers: int, heads: int, kv_heads: int, ffn: int, vocab: int) -> float:
    """Floating-point operations of a forward pass over sequences: embeddings, attention, gated feed-forward and head."""
    head = hidden // heads
    total = 0.0
    for n in lengths:
        qkv = 2 * n * hidden * (heads * head + 2 * kv_heads * head)
        attention = 2 * 2 * n * n * heads * head / 2
        total += layers * (qkv + attention + 2 * n * hidden * hidden + 2 * n * hidden * ffn * 3) + 2 * n * hidden * vocab
    return total
