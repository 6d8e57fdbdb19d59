"""Configuration: YAML text or environment variables, with the documented defaults."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

from tidemark.functions.scripting import Computed
from tidemark.functions.types import Kind, parse_kind

#: Seconds between looks at a configuration that is kept at an address.
RELOAD = 60
#: Entries of a compaction that are sinks, where these stand beside its other settings.
SINKS = ("file", "s3", "gcs", "azure", "bigquery", "pubsub", "console", "noop", "peer")


@dataclass
class CompactConfig:
    sinks: list[dict[str, Any]] = field(default_factory=list)
    name_func: str | None = None
    interval: float = 30


@dataclass
class TableConfig:
    ttl: int = 3600
    hash_by: str = "event"
    sort_by: str = "tsi"
    schema: str | None = None
    compact: CompactConfig | None = None
    streams: list[dict[str, Any]] = field(default_factory=list)


@dataclass
class Config:
    env: str = ""
    app_name: str = "tidemark"
    domain: str = ""
    schema: str = "data"
    storage_dir: str = "/data"
    uri: str = ""
    writers: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, TableConfig] = field(default_factory=dict)
    computed: list[Computed] = field(default_factory=list)


def _compact(raw: Mapping[str, Any] | None) -> CompactConfig | None:
    """Sinks stand in a list, or by name beside the other settings; there an encoder is for all of them."""
    if raw is None:
        return None
    sinks = list(raw.get("sinks") or [])
    beside = {k: raw[k] or {} for k in SINKS if k in raw}
    if beside:
        shared = {"encoder": raw["encoder"]} if raw.get("encoder") else {}
        sinks.append({k: shared | v for k, v in beside.items()})
    return CompactConfig(sinks, raw.get("nameFunc"), raw.get("interval") or 30)


def _table(raw: Mapping[str, Any] | None) -> TableConfig:
    raw = raw or {}
    schema = raw.get("schema")
    return TableConfig(raw.get("ttl") or 3600, raw.get("hashBy", "event"), raw.get("sortBy", "tsi"), yaml.safe_dump(schema) if isinstance(schema, Mapping) else schema, _compact(raw.get("compact")), list(raw.get("streams") or []))


def parse(text: str, base: Config | None = None) -> Config:
    """A configuration from YAML; what it lacks is as in base."""
    raw = yaml.safe_load(text) or {}
    c = base or Config()
    presto = (raw.get("readers") or {}).get("presto") or {}
    computed = [Computed(x["name"], parse_kind(x.get("type", "")) or Kind.STRING, x.get("func", "")) for x in raw.get("computed") or []]
    return Config(
        env=raw.get("env", c.env),
        app_name=raw.get("appName", c.app_name),
        domain=raw.get("domain", c.domain),
        schema=presto.get("schema", c.schema),
        storage_dir=(raw.get("storage") or {}).get("dir", c.storage_dir),
        uri=raw.get("uri", c.uri),
        writers=raw.get("writers") or c.writers,
        tables={n: _table(t) for n, t in raw["tables"].items()} if raw.get("tables") else c.tables,
        computed=computed or c.computed,
    )


def from_env(key: str, environ: Mapping[str, str] | None = None, base: Config | None = None) -> Config:
    """The variable KEY holds YAML or a YAML file's path; failing that, KEY_ENV, KEY_STORAGE_DIR and so on hold single settings."""
    environ = os.environ if environ is None else environ
    if key in environ:
        text = environ[key]
        if os.path.exists(text):
            with open(text, encoding="utf-8") as f:
                text = f.read()
        return parse(text, base)
    c = base or Config()
    for name, variable in (("env", "ENV"), ("app_name", "APPNAME"), ("domain", "DOMAIN"), ("uri", "URI"), ("storage_dir", "STORAGE_DIR"), ("schema", "READERS_PRESTO_SCHEMA")):
        setattr(c, name, environ.get(f"{key}_{variable}", getattr(c, name)))
    return c


class Store:
    """Defaults, then the environment, then the YAML at the configured address, read again every minute."""

    def __init__(self, key: str, read: Callable[[str], str | None], environ: Mapping[str, str] | None = None):
        self.key, self.read, self.environ = key, read, environ
        self._stop = threading.Event()
        self.value = self.load()

    def load(self) -> Config:
        config = from_env(self.key, self.environ)
        text = self.read(config.uri) if config.uri else None
        return parse(text, config) if text else config

    def watch(self, seconds: float = RELOAD, changed: Callable[[Config], None] | None = None) -> Callable[[], None]:
        def loop() -> None:
            while not self._stop.wait(seconds):
                self.value = self.load()
                if changed:
                    changed(self.value)

        threading.Thread(target=loop, daemon=True).start()
        return self._stop.set
