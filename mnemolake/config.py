"""Configuration with the precedence stage, global, default; blank is unset."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


def layered(name: str, stage: str, settings: Mapping[str, str], default: str | None = None) -> str | None:
    """The stage's value, else the global one, else the default."""
    for key in (f"{stage}_{name}".upper(), name.upper()):
        value = (settings.get(key) or "").strip()
        if value:
            return value
    return default


def boolean(value: str | None, default: bool = False) -> bool:
    return default if not (value or "").strip() else value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class QueryOptions:
    """Parameters of graph and note retrieval."""

    mode: tuple[str, ...] = ("entity", "relation", "chunk")
    top_k: int = 20
    threshold: float = 0.2
    level: int = 2
    budget_text: int = 4000
    budget_relations: int = 4800
    budget_communities: int = 3200
    budget_naive: int = 12000
    budget_global: int = 16384
    most_reports: int = 512
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        known = {"entity", "relation", "chunk", "community", "one-hop"}
        bad = [m for m in self.mode if m not in known and not m.startswith("rank-")]
        if bad:
            raise ValueError(f"unknown modes {bad}")
        if self.top_k < 1 or not -1 <= self.threshold <= 1:
            raise ValueError("top_k must be positive, the threshold a similarity")

    def with_settings(self, settings: Mapping[str, str], stage: str) -> QueryOptions:
        """The options with numbers overridden by layered settings."""
        changed = {}
        for f in fields(self):
            if isinstance(f.default, (int, float)) and (v := layered(f.name, stage, settings)) is not None:
                changed[f.name] = type(f.default)(v)
        return replace(self, **changed)
