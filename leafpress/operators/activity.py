"""Recent workspaces and activities as queries over an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIVITIES = 20
WORKSPACES = 10
CAPS = {"file": 20, "activity": 10}


def recent_activity(log: DataFrame, limit: int = ACTIVITIES, owner: str = "user_id") -> DataFrame:
    """Newest entry of each (owner, type, workspace, artifact), newest first, ``limit`` per owner. Partial maxima go first, so only keys are shuffled."""
    newest = log.groupBy(owner, "activity_type", "workspace_key", "artifact_key").agg(F.max(F.struct("opened_at", "entry_id", "title")).alias("e"))
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.col("e.opened_at").desc(), F.col("e.entry_id").desc()))
    return newest.withColumn("position", rank).where(F.col("position") <= limit).select(
        owner, "position", "activity_type", "workspace_key", "artifact_key", "e.opened_at", "e.entry_id", "e.title"
    )


def recent_workspaces(opens: DataFrame, pins: DataFrame, limit: int = WORKSPACES) -> DataFrame:
    """Pinned ones first and never evicted, of the others the newest ``limit``."""
    last = opens.groupBy("workspace_key").agg(F.max("opened_at").alias("opened_at"), F.count(F.lit(1)).alias("opens"))
    pinned = last.join(
        pins.select("workspace_key").distinct().withColumn("pinned", F.lit(True)), "workspace_key", "left"
    ).withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    free = pinned.where("not pinned").orderBy(F.col("opened_at").desc(), "workspace_key").limit(limit)
    kept = pinned.where("pinned").unionByName(free)
    return kept.withColumn("position", F.row_number().over(W.orderBy(F.col("pinned").desc(), F.col("opened_at").desc(), "workspace_key")))


def pinned_only(recents: DataFrame) -> DataFrame:
    """What stays when the list is cleared."""
    return recents.where("pinned")


def removed(recents: DataFrame, workspace_key: str) -> DataFrame:
    return recents.where(F.col("workspace_key") != workspace_key)


def upsert(log: DataFrame, entry: DataFrame) -> DataFrame:
    """The log with one more entry; readers take the newest of a key, so an update is an append."""
    return log.unionByName(entry)


def search(query: str, *, workspaces: DataFrame | None = None, files: DataFrame | None = None, activities: DataFrame | None = None) -> DataFrame:
    """Metadata that holds the lower-cased query as a literal substring; never body text. An empty query finds nothing."""
    q = query.strip().lower()

    def found(df: DataFrame, kind: str, key: str, *fields: str) -> DataFrame:
        hit = F.lit(False)
        for f in fields:
            hit |= F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(q))
        return df.where(hit if q else F.lit(False)).select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(fields[0]).alias("label")
        )

    parts = []
    if workspaces is not None:
        parts.append(found(workspaces, "workspace", "workspace_id", "display_name", "path"))
    if files is not None:
        parts.append(found(files, "file", "artifact_id", "name", "relative_path", "extension"))
    if activities is not None:
        parts.append(found(activities, "activity", "entry_id", "title"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capped(results: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """What a result list shows: so many of each kind (workspaces, of which there are few, all). A kind's first ones are an ordered limit, so it isn't sorted in one task."""
    caps = CAPS if caps is None else caps
    out = results.where(~F.col("kind").isin(*caps)) if caps else results
    for kind, n in caps.items():
        out = out.unionByName(results.where(F.col("kind") == kind).orderBy("label", "key").limit(n))
    return out.withColumn("position", F.row_number().over(W.partitionBy("kind").orderBy("label", "key")))
