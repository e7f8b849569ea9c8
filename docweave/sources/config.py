"""YAML files of triggers and access rules."""

from __future__ import annotations

import re
from pathlib import Path

import yaml

from ..model import InvalidQuery, Retry, Trigger
from ..operators.rules import Rule, check_trigger, rules_from

UNITS = {"ns": 1e-6, "us": 1e-3, "ms": 1.0, "s": 1000.0, "m": 60_000.0, "h": 3_600_000.0}


def duration_ms(value) -> int:
    """A duration such as "1m30s", or whole nanoseconds, in milliseconds."""
    if isinstance(value, int):
        return value // 1_000_000
    if not re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ns|us|ms|s|m|h))+", str(value)):
        raise InvalidQuery(f"bad duration {value!r}")
    return int(sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", value)))


def retry_of(d: dict | None, default: Retry = Retry()) -> Retry:
    d = d or {}
    return Retry(d.get("maxAttempts") or default.max_attempts, duration_ms(d["initialBackoff"]) if "initialBackoff" in d else default.initial_ms, duration_ms(d["maxBackoff"]) if "maxBackoff" in d else default.max_ms)


def load_triggers(text: str) -> list[Trigger]:
    """Triggers of one file; a retry policy of the file is the default of its triggers."""
    d = yaml.safe_load(text) or {}
    database = d.get("database", "default")
    default = retry_of(d.get("retryPolicy"))
    out = []
    for t in d.get("triggers", []):
        out.append(Trigger(t["id"], tuple(t["events"]), t["collection"], t["url"], t.get("condition", ""), database, retry_of(t.get("retryPolicy"), default), duration_ms(t["timeout"]) if "timeout" in t else 5000))
        check_trigger(out[-1])
    return out


def load_trigger_folder(path: str) -> dict[str, list[Trigger]]:
    """Triggers by database; two files of one database are an error."""
    out: dict[str, list[Trigger]] = {}
    for f in sorted([*Path(path).glob("*.yml"), *Path(path).glob("*.yaml")]):
        text = f.read_text()
        database = (yaml.safe_load(text) or {}).get("database", "default")
        if database in out:
            raise InvalidQuery(f"database {database} has two files")
        out[database] = load_triggers(text)
    return out


def load_rules(text: str) -> list[Rule]:
    d = yaml.safe_load(text) or {}
    return rules_from(d.get("match", {}), "")
