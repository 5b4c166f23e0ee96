"""Settings and state kept as JSON on the driver: precedence, tolerant loading, atomic saving."""

from __future__ import annotations

import hashlib
import json
import os
import sys
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Names of the levels, and kinds of activity.
DEFAULT, USER, ENVIRONMENT, RUNTIME = "Default", "User Config", "Environment", "Runtime Argument"
ACTIVITY_TYPES = ("workspace", "artifact", "artifact_qa")


SCHEMA_VERSION = 1


def data_dir(env: Mapping[str, str] | None = None, platform: str | None = None) -> Path:
    """The user's folder for this engine: as the environment says, or the platform's custom."""
    env = os.environ if env is None else env
    if own := (env.get("LEAFPRESS_DATA_DIR") or "").strip():
        return Path(own).expanduser()
    if (platform or sys.platform).startswith("win"):
        return Path(env.get("APPDATA") or Path.home() / "AppData" / "Roaming") / "leafpress"
    return Path(env.get("XDG_DATA_HOME") or Path.home() / ".local" / "share") / "leafpress"


def config_path(env: Mapping[str, str] | None = None) -> Path:
    own = ((os.environ if env is None else env).get("LEAFPRESS_CONFIG") or "").strip()
    return Path(own).expanduser() if own else data_dir(env) / "config.json"


def state_path(env: Mapping[str, str] | None = None) -> Path:
    own = ((os.environ if env is None else env).get("LEAFPRESS_STATE") or "").strip()
    return Path(own).expanduser() if own else data_dir(env) / "state.json"


def logs_dir(env: Mapping[str, str] | None = None) -> Path:
    return data_dir(env) / "logs"


@dataclass(frozen=True)
class Field:
    """A setting: its default, the environment names that may set it, and whether it is text (set if not empty)."""

    default: Any
    env: tuple[str, ...] = ()
    text: bool = True


#: Environment names are this engine's own.
FIELDS = {
    "llm_base_url": Field("", ("LEAFPRESS_LLM_BASE_URL",)),
    "llm_model": Field("", ("LEAFPRESS_LLM_MODEL",)),
    "api_key_env": Field("LEAFPRESS_LLM_API_KEY"),
    "model_dir": Field("", ("LEAFPRESS_MODEL_DIR", "MODEL_DIR")),
    "disabled_plugin_ids": Field([]),
    "restore_last_workspace": Field(True, text=False),
    "recent_workspace_limit": Field(10, text=False),
    "recent_activity_limit": Field(20, text=False),
}


def resolve(
    user: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None, runtime: Mapping[str, Any] | None = None
) -> dict[str, tuple[Any, str, str]]:
    """Each field's value, source and detail: runtime before environment before user before default."""
    user, env, runtime = user or {}, os.environ if env is None else env, runtime or {}
    out = {}
    for name, f in FIELDS.items():
        from_env = next(((v, e) for e in f.env if (v := (env.get(e) or "").strip())), None)
        own = user.get(name)
        if runtime.get(name) is not None:
            out[name] = (runtime[name], RUNTIME, "")
        elif from_env:
            out[name] = (from_env[0], ENVIRONMENT, from_env[1])
        elif (own if f.text else own is not None) and own != (f.default if name == "api_key_env" else None):
            out[name] = (own, USER, "")
        else:
            out[name] = (f.default, DEFAULT, "")
    return out


def secret(settings: Mapping[str, tuple[Any, str, str]], env: Mapping[str, str] | None = None) -> str:
    """The key from the variable that the settings name; it is never saved."""
    env = os.environ if env is None else env
    return (env.get(str(settings["api_key_env"][0])) or "").strip()


def plugin_dirs(user: list[str] | None = None, env: Mapping[str, str] | None = None, runtime: list[str] | None = None) -> list[tuple[str, str]]:
    """Directories in order, each once, with the first source that named it."""
    listed = (os.environ if env is None else env).get("LEAFPRESS_PLUGIN_PATH", "").strip()
    out: dict[str, str] = {}
    for source, dirs in ((USER, user or []), (ENVIRONMENT, listed.split(os.pathsep) if listed else []), (RUNTIME, runtime or [])):
        for d in dirs:
            if d:
                out.setdefault(str(Path(d).expanduser()), source)
    return list(out.items())


def check(config: Any) -> list[str]:
    """What is wrong with a user's settings."""
    if not isinstance(config, dict):
        return ["the settings must be an object"]
    out = [f"unknown field {k}" for k in config if k not in FIELDS and k not in ("schema_version", "external_plugin_dirs")]
    if config.get("schema_version", SCHEMA_VERSION) != SCHEMA_VERSION:
        out.append(f"schema_version {config['schema_version']!r} is not {SCHEMA_VERSION}")
    for name, f in FIELDS.items():
        v = config.get(name)
        if v is not None and isinstance(f.default, str | bool) and not isinstance(v, type(f.default)):
            out.append(f"{name} must be {'a text' if isinstance(f.default, str) else 'true or false'}")
    url = config.get("llm_base_url")
    if isinstance(url, str) and url.strip() and not url.strip().startswith(("http://", "https://")):
        out.append("llm_base_url must begin with http:// or https://")
    for name in ("recent_workspace_limit", "recent_activity_limit"):
        v = config.get(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
            out.append(f"{name} must be a whole number from 0")
    for name in ("disabled_plugin_ids", "external_plugin_dirs"):
        if not all(isinstance(x, str) for x in config.get(name) or []):
            out.append(f"{name} must be a list of texts")
    return out


def save_json(data: Any, path: str | Path) -> None:
    """All or nothing: written beside, flushed, then put in place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".tmp")
    with open(part, "w", encoding="utf-8") as f:
        f.write(json.dumps(data, ensure_ascii=False, indent=2) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def persist_state(state: Any, path: str | Path) -> list[str]:
    """Save what an action has left; a failure is told and leaves the state in memory and the file as they were."""
    try:
        save_json(state, path)
    except OSError as e:
        return [f"the state can't be saved: {e}"]
    return []


def load_config(path: str | Path) -> tuple[dict, list[str]]:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return {}, []
    except (ValueError, OSError) as e:
        return {}, [f"settings can't be read: {e}"]
    return (data, check(data)) if isinstance(data, dict) else ({}, check(data))


def load_state(path: str | Path) -> tuple[dict, list[str]]:
    """Recent workspaces and activities; a broken file is set aside as ``.corrupt`` and the state begins empty."""
    path, empty = Path(path), {"recent_workspaces": [], "recent_activity": []}
    if not path.is_file():
        return empty, []
    try:
        data = json.loads(path.read_text(encoding="utf-8"))
    except (ValueError, OSError) as e:
        os.replace(path, path.with_name(path.name + ".corrupt"))
        return empty, [f"state is broken and was set aside: {e}"]
    if not isinstance(data, dict):
        return empty, ["the state must be an object"]
    errors, out = [], {k: [] for k in empty}
    for kind in empty:
        for item in data.get(kind) or []:
            if not isinstance(item, dict):
                errors.append(f"{kind} holds something else than objects")
            elif kind == "recent_activity" and item.get("activity_type") not in ACTIVITY_TYPES:
                errors.append(f"unknown activity {item.get('activity_type')!r}")
            else:
                item = migrated(item) if kind == "recent_workspaces" else {"entry_id": uuid.uuid4().hex[:12]} | item
                out[kind].append(
                    {
                        k: item[k]
                        for k in (
                            "workspace_id", "path", "display_name", "last_opened_at", "pinned", "last_artifact_path", "entry_id",
                            "activity_type", "workspace_path", "artifact_path", "title"
                        )
                        if k in item
                    }
                )
    return out, errors


def migrated(item: dict) -> dict:
    """A workspace with the id of today's form, made from its path where an older one, or none, is kept."""
    if str(item.get("workspace_id") or "").startswith("ws_"):
        return item
    path = str(item.get("path") or "")
    return item | {"workspace_id": "ws_" + hashlib.sha256(path.encode()).hexdigest()[:12]}


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Plugin manifests as rows; what can't be parsed is in ``_corrupt_record``."""
    schema = "id string, name string, version string, api_version int, entrypoint string, accepts struct<extensions:array<string>>, capabilities array<struct<id:string,priority:int>>, permissions array<string>, platforms array<string>, _corrupt_record string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
