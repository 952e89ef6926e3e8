"""Typed settings from YAML with dotted overrides, and a fingerprint of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Tracking:
    num_blobs: int = 64
    num_hyperblobs: int = 4
    seed: int = 0
    stickiness: float = 0.0


@dataclass(frozen=True)
class Frames:
    max_len: int | None = None
    target_fps: float | None = None
    skip_frames: int = 0


@dataclass(frozen=True)
class Config:
    tracking: Tracking = field(default_factory=Tracking)
    frames: Frames = field(default_factory=Frames)


def scalar(text: str) -> Any:
    """true, false, null, a number (a float only with a point), else the text."""
    plain = {"true": True, "false": False, "null": None, "none": None}
    if text.lower() in plain:
        return plain[text.lower()]
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def _build(kind: type, values: dict) -> Any:
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise KeyError(f"no such setting: {sorted(extra)}")
    default = kind()
    return kind(**{k: _build(type(getattr(default, k)), v) if is_dataclass(getattr(default, k)) else v for k, v in values.items()})


def load(path: str | None = None, overrides: list[str] = ()) -> Config:
    """Settings of a YAML file, then `a.b=c` overrides."""
    values: dict = {}
    if path:
        import yaml

        values = yaml.safe_load(Path(path).read_text()) or {}
    for item in overrides:
        where, _, text = item.partition("=")
        *parents, last = where.split(".")
        at = values
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = scalar(text)
    return _build(Config, values)


def fingerprint(value: Any) -> str:
    """The same for equal settings."""
    plain = lambda v: {f.name: plain(getattr(v, f.name)) for f in fields(v)} if is_dataclass(v) else v
    return hashlib.md5(json.dumps(plain(value), sort_keys=True).encode()).hexdigest()
