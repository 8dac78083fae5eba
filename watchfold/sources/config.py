"""The YAML configuration: event mappings and detection rules, checked as they are read."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml

CONFIG = Path(__file__).parent.parent / "config"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Mapping:
    class_uid: int
    description: str
    fields: dict[str, str]


@dataclass(frozen=True)
class Step:
    filter: str
    class_uid: int | None = None


@dataclass(frozen=True)
class Rule:
    """A detection rule; which fields it needs depends on its type."""

    id: str
    name: str
    type: str
    severity: str
    class_uid: int | None = None
    description: str = ""
    mitre: str | None = None
    filter: str | None = None
    threshold: int | None = None
    window: int | None = None
    group_by: str | None = None
    steps: tuple[Step, ...] = ()
    match_on: str | None = None

    def check(self) -> "Rule":
        need = {"atomic": ["filter"], "threshold": ["filter", "threshold", "window"], "chain": ["steps", "match_on", "window"]}
        if self.type not in need:
            raise ConfigError(f"{self.id}: unknown type {self.type!r}")
        missing = [n for n in need[self.type] if getattr(self, n) in (None, ())]
        if missing:
            raise ConfigError(f"{self.id}: a rule of type {self.type} needs {', '.join(missing)}")
        return self


def load_mappings(path: str | Path = CONFIG / "mappings.yaml") -> dict[str, Mapping]:
    events = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("events") or {}
    if not events:
        raise ConfigError("no event is mapped")
    out = {str(k): Mapping(v.get("class", 0), v.get("description", ""), v.get("fields") or {}) for k, v in events.items()}
    for event, mapping in out.items():
        if not mapping.class_uid:
            raise ConfigError(f"event {event} has no class")
    return out


def rule_of(entry: dict) -> Rule:
    steps = tuple(Step(entry[s]["filter"], entry[s].get("class")) for s in ("step_1", "step_2") if entry.get(s))
    if entry["type"] == "chain" and len(steps) < 2:
        steps = ()
    return Rule(
        id=entry["id"], name=entry["name"], type=entry["type"], severity=entry["severity"], class_uid=entry.get("class"),
        description=entry.get("description", ""), mitre=entry.get("mitre_attack"), filter=entry.get("filter"), threshold=entry.get("threshold"),
        window=entry.get("window"), group_by=entry.get("group_by"), steps=steps, match_on=entry.get("match_on")).check()


def parse_rules(text: str) -> list[Rule]:
    return [rule_of(e) for e in (yaml.safe_load(text) or {}).get("detection_rules") or []]


def load_rules(path: str | Path = CONFIG / "rules.yaml") -> list[Rule]:
    return parse_rules(Path(path).read_text(encoding="utf-8"))
