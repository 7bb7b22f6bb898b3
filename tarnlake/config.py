"""Declarative description of sources and pipelines."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

LAYERS = ("bronze", "silver", "gold")


@dataclass(frozen=True)
class Source:
    """Where rows come from: ``type`` plus a path, URL or query and reader options."""

    name: str
    type: str
    path: str | None = None
    url: str | None = None
    query: str | None = None
    connection: Mapping[str, Any] = field(default_factory=dict)
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Quality:
    """Gate on a pipeline's output; unset checks are skipped."""

    completeness: float | None = None
    uniqueness: Sequence[str] = ()
    row_count_min: int | None = None
    custom_sql: str | None = None


@dataclass(frozen=True)
class Scd:
    """How rows meet those a table holds: kind 1 overwrites by key, kind 2 keeps versions of the tracked columns."""

    kind: int
    key: Sequence[str]
    ts: str
    tracked: Sequence[str] = ()


@dataclass(frozen=True)
class Pipeline:
    """source -> steps -> contract -> rules -> quality gate -> table in a layer."""

    name: str
    source: str
    transforms: Sequence[Mapping[str, Any]] = ()
    quality: Quality = field(default_factory=Quality)
    destination: str | None = None
    layer: str | None = None
    depends_on: Sequence[str] = ()
    schedule: str | None = None
    fetch_mode: str = "full"
    watermark_col: str | None = None
    partition_by: Sequence[str] = ()
    lateness: str | None = None
    rules: Sequence[Mapping[str, Any]] = ()
    contract: Mapping[str, str] = field(default_factory=dict)
    scd: Scd | None = None
    attempts: int = 1

    @property
    def target(self) -> str:
        return self.destination or self.name

    @property
    def target_layer(self) -> str:
        return layer_of(self.target, self.layer)


def layer_of(name: str, explicit: str | None = None) -> str:
    """Explicit layer, else the one the name starts with, else silver."""
    if explicit:
        if explicit not in LAYERS:
            raise ValueError(f"unknown layer {explicit!r}")
        return explicit
    prefix = name.split("_", 1)[0]
    return prefix if prefix in ("bronze", "gold") else "silver"


@dataclass(frozen=True)
class Project:
    sources: Mapping[str, Source]
    pipelines: Mapping[str, Pipeline]


def _names(value: str | Sequence[str] | None) -> tuple[str, ...]:
    """A list of names, or names in one text set apart by commas."""
    if isinstance(value, str):
        return tuple(n for n in map(str.strip, value.split(",")) if n)
    return tuple(value or ())


def _scd(raw: Mapping[str, Any] | None) -> Scd | None:
    if not raw:
        return None
    if raw["type"] not in (1, 2):
        raise ValueError(f"unknown kind of slowly changing dimension: {raw['type']!r}")
    return Scd(raw["type"], _names(raw["key"]), raw["ts"], _names(raw.get("tracked")))


def _pipeline(name: str, raw: Mapping[str, Any]) -> Pipeline:
    gate = dict(raw.get("quality") or {})
    known = {k: gate[k] for k in ("completeness", "row_count_min", "custom_sql") if k in gate}
    return Pipeline(
        name=name,
        source=raw["source"],
        transforms=tuple(raw.get("transforms") or ()),
        quality=Quality(uniqueness=_names(gate.get("uniqueness")), **known),
        destination=raw.get("destination"),
        layer=(raw.get("target") or {}).get("layer"),
        depends_on=_names(raw.get("depends_on")),
        schedule=raw.get("schedule"),
        fetch_mode=raw.get("fetch_mode", "full"),
        watermark_col=raw.get("watermark_col"),
        partition_by=_names(raw.get("partition_by")),
        lateness=raw.get("lateness"),
        rules=tuple(raw.get("rules") or ()),
        contract=dict(raw.get("contract") or {}),
        scd=_scd(raw.get("scd")),
        attempts=int(raw.get("retry_attempts", 1)),
    )


def project_from_dict(raw: Mapping[str, Any]) -> Project:
    data = raw.get("data", raw)
    sources = {
        name: Source(
            name=name,
            type=entry["type"],
            path=entry.get("path"),
            url=entry.get("url"),
            query=entry.get("query"),
            connection=entry.get("connection") or {},
            options=entry.get("options") or {},
        )
        for name, entry in (data.get("sources") or {}).items()
    }
    pipelines = {n: _pipeline(n, p) for n, p in (data.get("pipelines") or {}).items()}
    return Project(sources, pipelines)


def load_project(path: str) -> Project:
    """Read a project from JSON, or from YAML where PyYAML is installed."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML projects need PyYAML; use JSON instead") from error
        return project_from_dict(yaml.safe_load(text))
    return project_from_dict(json.loads(text))
