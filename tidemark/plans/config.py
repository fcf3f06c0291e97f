"""Job configuration: both file formats, migration, validation, merging, and a store with listeners."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Fixed values of the file formats: version numbers, and the ids of what a migration makes.
LEGACY_VERSION, MULTI_VERSION = "1.0", "2.0"
DEFAULT_SOURCE, DEFAULT_SINK, DEFAULT_JOB = "default-mysql", "default-es", "default-job"
LEGACY_FIELDS = {"host": "db_host", "port": "db_port", "user": "db_user", "password": "db_password", "database": "db_name", "server_id": "server_id", "table_filters": "table_filters"}
LEGACY_SINK_FIELDS = {"addresses": "es_addresses", "user": "es_user", "password": "es_password"}

KINDS = ("data_sources", "sinks", "jobs")


class ConfigError(ValueError):
    pass


def seconds(text: str | int | float) -> float:
    """A duration such as 30s, 1m30s, 500ms or 2h; a number is seconds."""
    if isinstance(text, int | float):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ConfigError(f"no duration: {text!r}")
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    return sum(float(a) * unit[b] for a, b in parts)


@dataclass
class MultiConfig:
    version: str = MULTI_VERSION
    data_sources: list[dict] = field(default_factory=list)
    sinks: list[dict] = field(default_factory=list)
    jobs: list[dict] = field(default_factory=list)
    options: dict = field(default_factory=dict)

    def find(self, kind: str, name: str) -> dict:
        for x in getattr(self, kind):
            if x.get("id") == name:
                return x
        raise ConfigError(f"{kind}: no {name!r}")

    def problems(self) -> list[str]:
        """Missing and repeated ids, and jobs whose source or sink isn't there."""
        found = []
        for kind in KINDS:
            ids = [x.get("id", "") for x in getattr(self, kind)]
            found += [f"{kind}: an item without id" for i in ids if not i]
            found += [f"{kind}: {i!r} is there {ids.count(i)} times" for i in sorted(set(ids)) if i and ids.count(i) > 1]
        for j in self.jobs:
            for key, kind in (("source_id", "data_sources"), ("sink_id", "sinks")):
                if j.get(key) not in {x.get("id") for x in getattr(self, kind)}:
                    found.append(f"job {j.get('id')!r}: unknown {key} {j.get(key)!r}")
        return found

    def dead_letters(self) -> dict:
        """enabled, storage_path, max_retries and retry_delay in seconds, with their defaults."""
        given = self.options.get("dlq_config") or {}
        return {"enabled": given.get("enabled", True), "storage_path": given.get("storage_path") or "dead_letters", "max_retries": given.get("max_retries") or 3, "retry_delay": seconds(given.get("retry_delay") or 30)}

    def to_json(self) -> str:
        value = asdict(self)
        value["global"] = value.pop("options")
        return json.dumps(value, indent=2, ensure_ascii=False)


def detect_version(text: str) -> str:
    """The version a file names, else that of its shape, else ``unknown``."""
    try:
        value = json.loads(text)
    except ValueError:
        return "unknown"
    if not isinstance(value, dict):
        return "unknown"
    return value.get("version") or (LEGACY_VERSION if value.get("db_host") else "unknown")


def migrate(legacy: dict) -> MultiConfig:
    """A single-source configuration as one source, one sink and one job."""
    source = {"id": DEFAULT_SOURCE, "type": "mysql", **{k: legacy[v] for k, v in LEGACY_FIELDS.items() if v in legacy}}
    sink = {"id": DEFAULT_SINK, "type": "index", **{k: legacy[v] for k, v in LEGACY_SINK_FIELDS.items() if v in legacy}}
    return MultiConfig(data_sources=[source], sinks=[sink], jobs=[{"id": DEFAULT_JOB, "source_id": DEFAULT_SOURCE, "sink_id": DEFAULT_SINK, "enabled": True}])


def load(text: str) -> MultiConfig:
    version = detect_version(text)
    if version == "unknown":
        raise ConfigError("no known configuration format")
    value = json.loads(text)
    if version == LEGACY_VERSION and "data_sources" not in value:
        return migrate(value)
    return MultiConfig(version, *[value.get(k) or [] for k in KINDS], value.get("global") or {})


def merge_keyed(new: list[dict], old: list[dict], dropped: str | None = None) -> list[dict]:
    """New items win by id; old ones with other ids stay, but for the default one."""
    ids = {x["id"] for x in new}
    return [*new, *[x for x in old if x["id"] not in ids and x["id"] != dropped]]


def merge(new: MultiConfig, old: MultiConfig) -> MultiConfig:
    dropped = dict(zip(KINDS, (DEFAULT_SOURCE, DEFAULT_SINK, DEFAULT_JOB)))
    return MultiConfig(new.version, *[merge_keyed(getattr(new, k), getattr(old, k), dropped[k]) for k in KINDS], new.options)


class ConfigStore:
    """A configuration file: replaced whole, backed up before a migration, polled for changes that others make."""

    def __init__(self, path: str):
        self.path, self.listeners = Path(path), []
        self.config = MultiConfig()
        self._seen = ""

    def open(self) -> MultiConfig:
        text = self.path.read_text()
        self.config, self._seen = load(text), hashlib.sha256(text.encode()).hexdigest()
        if detect_version(text) == LEGACY_VERSION and "data_sources" not in json.loads(text):
            shutil.copy(self.path, f"{self.path}.backup_{time.strftime('%Y%m%d_%H%M%S')}")
            self.save()
        return self.config

    def save(self) -> None:
        text = self.config.to_json()
        beside = self.path.with_suffix(".new")
        beside.write_text(text)
        os.replace(beside, self.path)
        self._seen = hashlib.sha256(text.encode()).hexdigest()

    def add(self, kind: str, item: dict) -> None:
        if any(x["id"] == item["id"] for x in getattr(self.config, kind)):
            raise ConfigError(f"{kind}: {item['id']!r} exists")
        getattr(self.config, kind).append(item)
        self.save()

    def remove(self, kind: str, name: str) -> None:
        getattr(self.config, kind).remove(self.config.find(kind, name))
        self.save()

    def listen(self, listener: Callable[[MultiConfig, MultiConfig], None]) -> None:
        self.listeners.append(listener)

    def poll(self) -> bool:
        """Reload a changed file that is valid and tell the listeners; an invalid one is left alone."""
        text = self.path.read_text()
        if (digest := hashlib.sha256(text.encode()).hexdigest()) == self._seen:
            return False
        try:
            new = load(text)
        except ConfigError:
            return False
        if new.problems():
            return False
        old, self.config, self._seen = self.config, new, digest
        for listener in self.listeners:
            listener(old, new)
        return True
