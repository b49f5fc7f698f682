"""Plugins: connectors, transformers, quality checks and exporters by name.

A plugin's class has one method by its kind, which takes and gives frames, so its
work stays in Spark: ``read(spark, config)``, ``transform(df, config)``,
``check(df, config)`` with one row a check, ``export(df, config)`` with the place
written to.
"""

from __future__ import annotations

import importlib
import uuid
from dataclasses import dataclass, field

#: The method that each kind of plugin has.
METHODS = {"connector": "read", "transformer": "transform", "quality_check": "check", "exporter": "export"}
KINDS = tuple(METHODS)


@dataclass
class Plugin:
    name: str
    kind: str
    version: str
    module_path: str
    class_name: str
    tenant_id: str
    config_schema: dict = field(default_factory=dict)
    plugin_id: str = field(default_factory=lambda: uuid.uuid4().hex)


class PluginRegistry:
    """Registered classes; only modules under ``allowed`` prefixes are ever imported."""

    def __init__(self, allowed: tuple[str, ...] = ("sluiceway_plugins.",)):
        self.allowed = allowed
        self.plugins: dict[str, Plugin] = {}

    def register(self, name: str, kind: str, version: str, module_path: str, class_name: str, tenant_id: str, config_schema: dict | None = None) -> Plugin:
        if kind not in KINDS:
            raise ValueError(f"unknown plugin type {kind!r}; there are {', '.join(KINDS)}")
        if any(p.name == name and p.tenant_id == tenant_id for p in self.plugins.values()):
            raise ValueError(f"plugin {name!r} is registered already")
        plugin = Plugin(name, kind, version, module_path, class_name, tenant_id, config_schema or {})
        self.plugins[plugin.plugin_id] = plugin
        return plugin

    def get(self, plugin_id: str) -> Plugin:
        if plugin_id not in self.plugins:
            raise KeyError(f"no plugin {plugin_id}")
        return self.plugins[plugin_id]

    def list(self, tenant_id: str, kind: str | None = None) -> list[Plugin]:
        return sorted((p for p in self.plugins.values() if p.tenant_id == tenant_id and kind in (None, p.kind)), key=lambda p: p.name)

    def load(self, plugin_id: str) -> object:
        """An instance of the plugin's class."""
        p = self.get(plugin_id)
        if not any(p.module_path == a.rstrip(".") or p.module_path.startswith(a) for a in self.allowed):
            raise PermissionError(f"module {p.module_path!r} is not allowed")
        return getattr(importlib.import_module(p.module_path), p.class_name)()

    def named(self, tenant_id: str, name: str) -> Plugin:
        """A tenant's plugin by its name."""
        found = [p for p in self.list(tenant_id) if p.name == name]
        if not found:
            raise KeyError(f"no plugin {name!r} of {tenant_id}")
        return found[0]

    def execute(self, tenant_id: str, name: str, data: object, config: dict | None = None) -> object:
        """Run a tenant's plugin on a frame, or a connector on the session; keys its schema requires must be set."""
        p, config = self.named(tenant_id, name), config or {}
        missing = [k for k in p.config_schema.get("required", ()) if k not in config]
        if missing:
            raise ValueError(f"plugin {name!r} needs {', '.join(missing)}")
        method = getattr(self.load(p.plugin_id), METHODS[p.kind], None)
        if method is None:
            raise TypeError(f"{p.class_name} has no method {METHODS[p.kind]!r}")
        return method(data, config)

    def deregister(self, plugin_id: str, tenant_id: str) -> None:
        if self.get(plugin_id).tenant_id != tenant_id:
            raise PermissionError("only the owner may remove a plugin")
        del self.plugins[plugin_id]
