"""Reader plugins: found in folders by their manifests, checked, loaded and put together with the built-in readers.

A folder of plugins holds one folder for each, with a ``plugin.json``. Discovery runs no code. A manifest that
fails its checks, a plugin that can't be imported, an id that is there already: each is a line of the report and
leaves the others alone. What the manifest says of a plugin's readers (extensions, priority, permissions,
platforms) holds, whatever the readers say themselves. Disabled plugins are reported and take part in nothing.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
import re
import sys
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path
from types import ModuleType
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from leafpress.operators import runtime
from leafpress.sources import readers
from leafpress.sources.readers import ReaderSpec

MANIFEST = "plugin.json"
#: The version of the format, and the capability that readers offer.
API_VERSION, CAPABILITY = 1, "artifact.read.full"
BUILTIN, EXTERNAL = "builtin", "external"


class PluginError(ValueError):
    """A manifest or a plugin that can't be used."""


@dataclass(frozen=True)
class Manifest:
    """What a plugin declares of itself."""

    id: str
    name: str
    version: str
    module: str
    attribute: str
    extensions: tuple[str, ...]
    capabilities: tuple[tuple[str, int], ...]
    permissions: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    python: str = ""
    description: str = ""

    @staticmethod
    def of(data: Any) -> Manifest:
        """From parsed JSON; all that is wrong with it in one error."""
        if not isinstance(data, dict):
            raise PluginError("the manifest must be an object")
        entry, accepts = (data.get(k) if isinstance(data.get(k), dict) else {} for k in ("entrypoint", "accepts"))
        listed = lambda x: [str(v) for v in x] if isinstance(x, list) else []
        offers = [c for c in data.get("capabilities") or [] if isinstance(c, dict)]
        ids = [str(c.get("id") or "") for c in offers]
        extensions = [e.strip().lower().lstrip(".") for e in listed(accepts.get("extensions"))]
        permissions = listed(data.get("permissions"))
        problems = {
            "api_version": data.get("api_version") != API_VERSION,
            "id": not re.fullmatch(runtime.PLUGIN_ID, str(data.get("id") or "")),
            "name": not str(data.get("name") or "").strip(),
            "version": not re.fullmatch(runtime.VERSION, str(data.get("version") or "")),
            "entrypoint": not (entry.get("module") and entry.get("class")),
            "extensions": not extensions or not all(extensions),
            "capabilities": not offers or not all(ids) or not all(isinstance(c.get("priority", 100), int) for c in offers),
            "duplicate capability": len(set(ids)) < len(ids),
            "permissions": bool(set(permissions) - set(runtime.PERMISSIONS)),
        }
        if wrong := [k for k, bad in problems.items() if bad]:
            raise PluginError(f"bad manifest: {', '.join(wrong)}")
        python = data.get("runtime") if isinstance(data.get("runtime"), dict) else {}
        return Manifest(
            id=data["id"],
            name=data["name"],
            version=data["version"],
            module=str(entry["module"]),
            attribute=str(entry["class"]),
            extensions=tuple(dict.fromkeys(extensions)),
            capabilities=tuple((str(c["id"]), c.get("priority", 100)) for c in offers),
            permissions=tuple(permissions),
            platforms=tuple(listed(data.get("platforms"))),
            python=str(python.get("python") or ""),
            description=str(data.get("description") or ""),
        )

    def to_dict(self) -> dict[str, Any]:
        """The manifest in its own format."""
        # fixed values: the keys of manifests
        return {
            "id": self.id,
            "name": self.name,
            "version": self.version,
            "api_version": API_VERSION,
            "description": self.description,
            "entrypoint": {"module": self.module, "class": self.attribute},
            "accepts": {"extensions": [f".{e}" for e in self.extensions]},
            "capabilities": [{"id": i, "priority": p} for i, p in self.capabilities],
            "permissions": list(self.permissions),
            "platforms": list(self.platforms),
            "runtime": {"python": self.python},
        }


@dataclass(frozen=True)
class Found:
    """A plugin's folder, with its manifest or what is wrong with it."""

    folder: str
    manifest: Manifest | None
    error: str = ""
    raw: dict = field(default_factory=dict)

    @property
    def id(self) -> str:
        return self.manifest.id if self.manifest else str(self.raw.get("id") or Path(self.folder).name)


def discover(folders: Iterable[str]) -> list[Found]:
    """The plugins below the folders, in order; nothing is imported."""
    out = []
    for folder in map(Path, folders):
        if not folder.is_dir():
            out.append(Found(str(folder), None, "no such folder"))
            continue
        for own in sorted(p for p in folder.iterdir() if (p / MANIFEST).is_file()):
            data: Any = None
            try:
                data = json.loads((own / MANIFEST).read_text(encoding="utf-8"))
                out.append(Found(str(own), Manifest.of(data)))
            except (OSError, ValueError) as e:
                out.append(Found(str(own), None, str(e), data if isinstance(data, dict) else {}))
    return out


def module_of(folder: Path, name: str) -> ModuleType:
    """A plugin's module under a name of its own: a file, or a module of a package below the folder."""
    first, _, rest = name.partition(".")
    place = folder / first / "__init__.py" if rest else folder / f"{first}.py"
    if not place.is_file():
        raise PluginError(f"no file {place}")
    alias = f"leafpress_plugin_{uuid.uuid4().hex}"
    spec = importlib.util.spec_from_file_location(alias, place, submodule_search_locations=[str(place.parent)] if rest else None)
    module = importlib.util.module_from_spec(spec)
    sys.modules[alias] = module
    spec.loader.exec_module(module)
    module = importlib.import_module(f"{alias}.{rest}") if rest else module
    for loaded in {alias, module.__name__}:  # executors don't have the file
        cloudpickle.register_pickle_by_value(sys.modules[loaded])
    return module


def load(found: Found) -> list[ReaderSpec]:
    """The readers of a plugin, as its manifest has them."""
    m = found.manifest
    if m is None:
        raise PluginError(found.error)
    try:
        made = getattr(module_of(Path(found.folder), m.module), m.attribute, None)
        specs = list(made().readers()) if made is not None else None
    except PluginError:
        raise
    except Exception as e:  # a plugin's own code may fail in any way
        raise PluginError(f"{type(e).__name__}: {e}") from e
    if specs is None:
        raise PluginError(f"{m.module} has no {m.attribute}")
    if not specs or not all(isinstance(s, ReaderSpec) for s in specs):
        raise PluginError("readers() must give reader specs")
    priority = dict(m.capabilities).get(CAPABILITY)
    if priority is None:
        raise PluginError(f"the manifest does not declare {CAPABILITY}")
    reason = runtime.unavailable_here(list(m.platforms), m.python)
    held = {"plugin_id": m.id, "priority": priority, "extensions": m.extensions, "declared": m.permissions}
    return [replace(s, **held, **({"available": False, "reason": reason} if reason else {})) for s in specs]


@dataclass(frozen=True)
class Assembly:
    """The readers in use, and a line for every plugin: (plugin_id, name, version, source, state, load_error)."""

    specs: list[ReaderSpec]
    report: list[tuple[str, str, str, str, str, str]]
    folders: tuple[str, ...] = ()
    disabled: frozenset[str] = frozenset()

    def rescan(self) -> Assembly:
        """The folders as they are now."""
        return assemble(self.folders, self.disabled)

    def disable(self, plugin_id: str) -> Assembly:
        return assemble(self.folders, self.disabled | {plugin_id})

    def enable(self, plugin_id: str) -> Assembly:
        return assemble(self.folders, self.disabled - {plugin_id})

    def only_disabled(self, extension: str) -> bool:
        """Whether disabled plugins alone claim an extension."""
        bare = extension.lower().lstrip(".")
        off = [s.extensions for s in readers.registry() if s.owner in self.disabled]
        # manifests tell what disabled plugins claim, so none of them is imported
        off += [f.manifest.extensions for f in discover(self.folders) if f.manifest and f.manifest.id in self.disabled]
        return any(bare in own for own in off) and not any(bare in s.extensions for s in self.specs)

    def plugins(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.report, "plugin_id string, name string, version string, source string, state string, load_error string")

    def providers(self, spark: SparkSession) -> DataFrame:
        """The table that routing and status work on."""
        rows = [
            (
                s.owner, s.provider_id, CAPABILITY, s.priority, list(s.extensions), list(s.declared or s.required), list(s.required),
                s.available, s.reason
            )
            for s in self.specs
        ]
        return spark.createDataFrame(
            rows,
            "plugin_id string, provider_id string, capability string, priority int, extensions array<string>, permissions array<string>, required array<string>, available boolean, reason string"
        )


def assemble(folders: Iterable[str] = (), disabled: Iterable[str] = ()) -> Assembly:
    """Built-in readers, then those of plugins in order. The first of an id stays; each failure stands for itself."""
    folders, disabled = tuple(folders), frozenset(disabled)
    specs: list[ReaderSpec] = []
    report: list[tuple[str, str, str, str, str, str]] = []
    known: dict[str, str] = {}
    taken: set[str] = set()
    for s in readers.registry():
        if s.owner not in known:
            known[s.owner] = "disabled" if s.owner in disabled else "loaded"
            report.append((s.owner, s.owner, "", BUILTIN, known[s.owner], ""))
        if known[s.owner] == "loaded":
            specs.append(s)
            taken.add(s.provider_id)
    for found in discover(folders):
        m = found.manifest
        name, version = (m.name, m.version) if m else (str(found.raw.get("name") or ""), str(found.raw.get("version") or ""))
        line = (found.id, name, version, EXTERNAL)
        if m is None:
            report.append((*line, "failed", found.error))
        elif m.id in known:
            report.append((*line, "failed", f"duplicate plugin id, in {found.folder}"))
        elif m.id in disabled:
            known[m.id] = "disabled"
            report.append((*line, "disabled", ""))
        else:
            try:
                own = load(found)
                if twice := [s.provider_id for s in own if s.provider_id in taken]:
                    raise PluginError(f"duplicate reader {', '.join(twice)}")
            except PluginError as e:
                report.append((*line, "failed", str(e)))
                continue
            known[m.id] = "loaded"
            taken |= {s.provider_id for s in own}
            specs += own
            report.append((*line, "loaded", ""))
    return Assembly(specs, report, folders, disabled)
