"""Sigma rules, in a subset, as atomic detection rules."""

from __future__ import annotations

import re

import yaml

from watchfold.sources.config import Rule


class SigmaError(ValueError):
    pass


def _text(value) -> str:
    if isinstance(value, bool):
        value = str(value).lower()
    if not isinstance(value, (str, int, float)):
        raise SigmaError(f"unsupported value {value!r}")
    return "'" + str(value).replace("'", "") + "'"  # the filter language has no escapes


def _field(name: str, value) -> str:
    field, _, modifier = name.partition("|")
    if isinstance(value, list):
        items = [_text(v) for v in value]
        if modifier == "contains":
            return "(" + " OR ".join(f"{field} CONTAINS {v}" for v in items) + ")"
        if not modifier:
            return f"{field} IN [{', '.join(items)}]"
    elif modifier in ("", "contains", "re"):
        return f"{field} {({'': '==', 'contains': 'CONTAINS', 're': '=~'})[modifier]} {_text(value)}"
    raise SigmaError(f"unsupported modifier in {name!r}")


def _selection(name: str, fields) -> str:
    if not isinstance(fields, dict):
        raise SigmaError(f"selection {name!r} is no map")
    return "(" + " AND ".join(_field(str(k), v) for k, v in fields.items()) + ")"


def _condition(condition: str, selections: dict[str, str]) -> str:
    condition = condition.strip()
    if condition == "all of them":
        return " AND ".join(selections.values())
    if condition in ("1 of them", "any of them"):
        return "(" + " OR ".join(selections.values()) + ")"
    if re.search(r"\|| count\(| near ", condition):
        raise SigmaError(f"unsupported condition {condition!r}")
    out = []
    for word in re.findall(r"[()]|[^\s()]+", condition):
        if word in ("and", "or", "not"):
            out.append(word.upper())
        elif word in "()":
            out.append(word)
        elif word in selections:
            out.append(selections[word])
        else:
            raise SigmaError(f"unknown selection {word!r}")
    return " ".join(out)


def compile_sigma(text: str) -> Rule:
    doc = yaml.safe_load(text)
    detection = doc.get("detection")
    if not isinstance(detection, dict):
        raise SigmaError("no detection")
    if not isinstance(detection.get("condition"), str):
        raise SigmaError("no condition")
    selections = {str(k): _selection(str(k), v) for k, v in detection.items() if k != "condition"}
    level = doc.get("level")
    severity = {"critical": "critical", "high": "high", "low": "low", "informational": "low"}.get(level, "medium")
    technique = next((t.removeprefix("attack.").upper() for t in doc.get("tags") or [] if t.startswith("attack.")), None)
    title = doc.get("title")
    return Rule(id=doc.get("id") or f"sigma-{title or 'rule'}", name=title or "Sigma rule", type="atomic", severity=severity,
                description=doc.get("description") or "", mitre=technique, filter=_condition(detection["condition"], selections)).check()
