"""Routing, permissions, fallback and status as DataFrame operations over a small provider table.

A provider row is (plugin_id, provider_id, capability, priority, extensions, permissions, required, platforms,
available, reason). Sides built from it are dimension tables of the process's own readers; their join with
artifacts stays an ordinary join, so the planner broadcasts by measured size.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Known permissions, and the formats of ids and versions.
PERMISSIONS = ("filesystem.read", "filesystem.write", "network", "process.execute", "office.com", "wps.com")
PLUGIN_ID = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9_-]*){1,5}$"
VERSION = r"^\d+\.\d+\.\d+$"
#: Failures after which the next provider is tried.
FALLBACK = ("ArtifactParseError", "EncryptedArtifactError", "ProviderExecutionError")
TRACES_KEPT = 200
#: What users see where a plugin takes no part.
WHY = {"Unavailable": "当前环境不可用", "Disabled": "已禁用：不参与路由", "Failed": "加载失败：未进入 Registry"}
MAX_BYTES = 50 * 1024 * 1024


def explode_providers(providers: DataFrame) -> DataFrame:
    return providers.withColumn("extension", F.explode("extensions")).drop("extensions")


def route(refs: DataFrame, providers: DataFrame, capability: str = "artifact.read") -> DataFrame:
    """Each ref with its chain: candidates that support it, in order, and why there is none."""
    own = explode_providers(providers.where(F.col("capability") == capability))
    pairs = refs.join(own, "extension", "left")
    usable = F.col("available") & F.col("provider_id").isNotNull()
    row = F.struct(
        (-F.col("priority")).alias("rank"), F.col("provider_id").alias("provider_id"), F.col("plugin_id").alias("plugin_id"),
        F.col("reason").alias("reason")
    )
    grouped = pairs.groupBy("artifact_id", "extension").agg(
        F.array_sort(F.collect_list(F.when(usable, row))).alias("chain"), F.array_sort(F.collect_list(F.when(~usable & F.col("provider_id").isNotNull(), row))).alias("unavailable")
    )
    error = F.when(F.size("chain") > 0, None).when(F.size("unavailable") > 0, "ProviderNotAvailableError").otherwise("CapabilityNotFoundError")
    return grouped.select(
        "artifact_id", "extension", F.get("chain", 0)["provider_id"].alias("selected"),
        F.array_join(F.transform("chain", lambda x: x["provider_id"]), ">").alias("chain"), error.alias("error_type"),
        F.when(F.size("chain") == 0, F.get("unavailable", 0)["reason"]).alias("reason")
    )


def fallback(attempts: DataFrame) -> DataFrame:
    """Traces of a chain: ``attempts`` (artifact_id, position, provider_id, missing, outcome) to those that happen.

    ``missing`` is the list of permissions not granted (the chain ends there), ``outcome`` null or an error type.
    """
    order = W.partitionBy("artifact_id").orderBy("position")
    error = F.when(F.size("missing") > 0, F.lit("PluginPermissionError")).otherwise(F.col("outcome"))
    out = attempts.withColumn("error_type", error)
    ends = F.when(F.col("error_type").isNull() | ~F.col("error_type").isin(*FALLBACK), 1).otherwise(0)
    out = out.withColumn("_ended", F.coalesce(F.sum(ends).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.where("_ended = 0").withColumn("fallback_from", F.lag("provider_id").over(order))
    return out.select(
        "artifact_id", "position", "provider_id", F.when(F.col("error_type").isNull(), "ok").otherwise("error").alias("status"),
        "error_type", "fallback_from"
    )


def outcome(traces: DataFrame) -> DataFrame:
    """One row per artifact: who read it, or the last error."""
    last = F.max_by(F.struct("provider_id", "status", "error_type", "fallback_from"), "position")
    return traces.groupBy("artifact_id").agg(last.alias("t"), F.count(F.lit(1)).alias("attempts")).select(
        "artifact_id", F.when(F.col("t.status") == "ok", F.col("t.provider_id")).alias("provider_id"), "t.fallback_from",
        F.when(F.col("t.status") != "ok", F.col("t.error_type")).alias("error_type"), "attempts"
    )


def effective_permissions(declared: Column, granted: list[str]) -> Column:
    return F.array_sort(F.array_intersect(declared, F.array(*[F.lit(g) for g in granted])))


def missing_permissions(required: Column, granted: list[str]) -> Column:
    return F.array_sort(F.array_except(required, F.array(*[F.lit(g) for g in granted])))


def unique_first(rows: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """First row of each key by ``order``, and the rejected duplicates."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def plugin_views(found: DataFrame, loaded: DataFrame, failures: DataFrame, disabled: DataFrame, broken: DataFrame) -> DataFrame:
    """A row per plugin (plugin_id, source, state, load_error), as semi and anti joins of what discovery and loading report.

    ``found`` (plugin_id, source); ``loaded`` and ``disabled`` (plugin_id); ``failures`` (plugin_id, place, error), of which
    the first counts, unless the plugin is disabled; ``broken`` (plugin_id, source, error): manifests that are no good,
    shown unless a plugin of that id has its row.
    """

    def state(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("plugin_id", "source", F.lit(name).alias("state"), F.lit("").alias("load_error"))

    off = disabled.distinct()
    first = failures.groupBy("plugin_id").agg(F.min_by("error", "place").alias("load_error"))
    failed = found.join(off, "plugin_id", "left_anti").join(first, "plugin_id")
    views = state(found.join(loaded.distinct(), "plugin_id", "left_semi"), "loaded").unionByName(state(found.join(off, "plugin_id", "left_semi"), "disabled"))
    views = views.unionByName(failed.select("plugin_id", "source", F.lit("failed").alias("state"), "load_error"))
    more = broken.join(views.select("plugin_id"), "plugin_id", "left_anti")
    return views.unionByName(more.select("plugin_id", "source", F.lit("failed").alias("state"), F.col("error").alias("load_error")))


def provider_views(providers: DataFrame, granted: list[str]) -> DataFrame:
    """Per plugin (plugin_id, views): its providers in order, whether each is available, why not, and its permissions in effect."""
    view = F.struct(
        "provider_id", "capability", "priority", "available", F.when(~F.col("available"), F.col("reason")).otherwise("").alias("reason"),
        F.array_join(effective_permissions(F.col("permissions"), granted), ",").alias("permissions")
    )
    return providers.groupBy("plugin_id").agg(F.array_sort(F.collect_list(view)).alias("views"))


def plugin_status(plugins: DataFrame, providers: DataFrame) -> DataFrame:
    """A row per plugin: ``plugins`` (plugin_id, source, state, load_error), state loaded, disabled or failed."""
    reasons = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("available"), F.struct("provider_id", "reason")))),
            lambda x: F.concat(x["provider_id"], F.lit(": "), x["reason"])
        ),
        "; "
    )
    seen = providers.groupBy("plugin_id").agg(F.bool_or("available").alias("any"), reasons.alias("reasons"), F.count(F.lit(1)).alias("n_providers"))
    joined = plugins.join(seen, "plugin_id", "left")
    status = (
        F.when(F.col("state") == "disabled", "Disabled").when((F.col("state") == "failed") & F.contains("load_error", F.lit("api_version")), "Incompatible").when(F.col("state") == "failed", "Load Failed").when(F.coalesce("any", F.lit(False)), "Enabled").otherwise("Unavailable")
    )
    why = F.when(status == "Enabled", "").when(
        status == "Unavailable", F.when(F.coalesce("reasons", F.lit("")) != "", F.col("reasons")).otherwise(WHY["Unavailable"])
    ).when(status == "Disabled", WHY["Disabled"]).otherwise(WHY["Failed"])
    return joined.select(
        "plugin_id", "source", status.alias("status"), why.alias("reason"),
        F.when(F.col("state") == "loaded", F.coalesce("n_providers", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_providers"),
        (F.col("source") == "builtin").alias("is_builtin")
    )


def system_status(plugins: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(f"plugins_{s}")
    return plugins.agg(n("loaded"), n("disabled"), n("failed"))


def guard(refs: DataFrame, root: str, workspace_id: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Why a ref may not be read (null: it may), from its metadata alone and before any content is read."""
    inside = (F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/")
    error = (
        F.when(F.col("workspace_id").isNotNull() & (F.col("workspace_id") != workspace_id), "WorkspaceBoundaryError").when(~inside, "WorkspaceBoundaryError").when(~F.col("exists"), "ArtifactNotFoundError").when(F.col("size") > max_bytes, "ArtifactTooLargeError")
    )
    return refs.withColumn("error_type", error)


def facade_error(error: Column, only_disabled: Column) -> Column:
    """The error a caller sees for an error of the runtime."""
    passed = (
        "ArtifactParseError", "EncryptedArtifactError", "WorkspaceBoundaryError", "ArtifactNotFoundError", "ArtifactTooLargeError",
        "PluginPermissionError"
    )
    return F.when(error.isNull(), None).when(
        (error == "CapabilityNotFoundError") & only_disabled, "PluginDisabledError"
    ).when(error == "CapabilityNotFoundError", "UnsupportedArtifactTypeError").when(error.isin(*passed), error).otherwise("ArtifactParseError")


def recent_traces(traces: DataFrame, kept: int = TRACES_KEPT) -> DataFrame:
    return traces.orderBy(F.col("started_at").desc(), F.col("trace_id").desc()).limit(kept)


def valid_manifest(m: DataFrame) -> DataFrame:
    """``problems`` of manifests (id, version, api_version, extensions, capabilities, permissions), empty if valid."""
    checks = {
        "id": ~F.coalesce(F.regexp_like("id", F.lit(PLUGIN_ID)), F.lit(False)),
        "version": ~F.coalesce(F.regexp_like("version", F.lit(VERSION)), F.lit(False)),
        "api_version": F.coalesce(F.col("api_version") != 1, F.lit(True)),
        "extensions": F.coalesce(F.size("extensions"), F.lit(0)) <= 0,
        "capabilities": F.coalesce(F.size("capabilities"), F.lit(0)) <= 0,
        "permissions": F.size(F.array_except(F.coalesce("permissions", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in PERMISSIONS]))) > 0,
        "duplicate capability": F.size(F.array_distinct("capabilities")) < F.size("capabilities"),
    }
    return m.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])))


def first_set(levels: list[tuple[str, Column]]) -> Column:
    """Value and source of the first level that is set (strings: non-empty; others: not null)."""
    return F.coalesce(
        *[
            F.when(c.isNotNull() & (c.cast("string") != ""), F.struct(c.cast("string").alias("value"), F.lit(name).alias("source")))
            for name, c in levels
        ]
    )


def keep_traces(traces: DataFrame, path: str) -> None:
    """Append traces to a log table."""
    traces.write.mode("append").parquet(path)


#: Names under which manifests know platforms.
PLATFORMS = {"windows": ("win32", "cygwin"), "win32": ("win32",), "linux": ("linux",), "macos": ("darwin",), "darwin": ("darwin",)}


def unavailable_here(platforms: list[str] | None, python: str | None, *, platform: str | None = None, version: tuple[int, ...] | None = None) -> str:
    """Why a provider can't run here ('' if it can). Of Python specs only ``>=X[.Y[.Z]]`` is understood, others pass."""
    here, now = (platform or sys.platform).lower(), version or sys.version_info[:3]
    wanted = [p.lower() for p in platforms or []]
    if wanted and not any(here.startswith(a) for p in wanted for a in PLATFORMS.get(p, (p,))):
        return f"made for {', '.join(wanted)}, but the platform is {here}"
    spec = re.fullmatch(r">=\s*(\d+(?:\.\d+){0,2})", (python or "").strip())
    least = tuple(map(int, spec[1].split("."))) if spec else ()
    return "" if tuple(now[: len(least)]) >= least else f"asks for python {python}, this one is {'.'.join(map(str, now))}"
