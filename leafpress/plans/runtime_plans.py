"""Queries over the provider table, routing and the activity log."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafpress import scratch
from leafpress.functions import text as T
from leafpress.operators import activity as A
from leafpress.functions import encodings as E
from leafpress.operators import runtime as R
from leafpress.operators import trigrams as G
from leafpress.plans.text_plans import read
from leafpress.sources import scan as S
from leafpress.streaming import recents as RS

EXTENSIONS = "array('.docx', '.pdf', '.TXT', '.md', '.xlsx', '.pptx', '.tmp', '', '.csv', '.zip', '.doc')"
PROVIDERS = """
    ('docx', 'docx.read', 100, 'docx', 'filesystem.read', 'filesystem.read', true, ''),
    ('doc_legacy', 'doc.read', 100, 'doc', 'filesystem.read,office.com', 'filesystem.read,office.com', false, 'platform windows required'),
    ('pdf', 'pdf.read', 100, 'pdf', 'filesystem.read,process.execute', 'filesystem.read', true, ''),
    ('pptx', 'pptx.read', 100, 'pptx', 'filesystem.read', 'filesystem.read', true, ''),
    ('xlsx', 'xlsx.read', 100, 'xlsx', 'filesystem.read', 'filesystem.read', true, ''),
    ('text', 'text.read', 50, 'txt,md,csv', 'filesystem.read', 'filesystem.read', true, ''),
    ('markdown_x', 'markdown.read', 80, 'md', 'filesystem.read,network', 'filesystem.read,network', true, ''),
    ('csv_x', 'csv.read', 50, 'csv', 'filesystem.read', 'filesystem.read', true, '')"""
_ROWS = "AS t(plugin_id, provider_id, priority, extensions, permissions, required, available, reason)"


def providers(spark):
    return spark.sql(
        f"SELECT plugin_id, provider_id, 'artifact.read' AS capability, priority, split(extensions, ',') AS extensions, split(permissions, ',') AS permissions, split(required, ',') AS required, available, reason FROM VALUES {PROVIDERS} {_ROWS}"
    )


def names(spark, sf_dir):
    """File names derived from documents, temporary and hidden ones among them."""
    name = F.expr(
        f"concat(element_at(array('', '', '', '', '~$', '.', ''), cast(doc_id % 7 + 1 as int)), 'f', doc_id, element_at({EXTENSIONS}, cast(doc_id % 11 + 1 as int)))"
    )
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("none")).alias("source"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), name.alias("name")
    )


def scan_filter(spark, sf_dir):
    claimed = R.explode_providers(providers(spark)).select("extension").distinct()
    return S.artifact_files(names(spark, sf_dir), claimed).select("doc_id", "name", "extension")


def refs(spark, sf_dir):
    files = S.visible(names(spark, sf_dir)).where("extension <> ''")
    path = F.concat(F.lit("/ws/"), "source", F.lit("/"), "name")
    return files.select("doc_id", path.alias("path"), T.artifact_id(path).alias("artifact_id"), "extension", "size")


def provider_routing(spark, sf_dir):
    return R.route(refs(spark, sf_dir), providers(spark))


def read_guards(spark, sf_dir):
    rows = refs(spark, sf_dir).withColumns(
        {
            "path": F.when(F.col("doc_id") % 13 == 0, F.lit("/etc/passwd")).otherwise(F.col("path")),
            "workspace_id": F.when(
                F.col("doc_id") % 5 == 0, T.workspace_id(F.when(F.col("doc_id") % 10 == 0, F.lit("/other")).otherwise(F.lit("/ws")))
            ),
            "exists": F.col("doc_id") % 17 != 0
        }
    )
    known = rows.sparkSession.sql("SELECT concat('ws_', substring(sha2('/ws', 256), 1, 12))").first()[0]
    return R.guard(rows, "/ws", known, max_bytes=8000).select("doc_id", "error_type")


def path_refs(spark, sf_dir):
    """Documents' paths, each with its ref if it is listed."""
    path = F.concat(F.lit("/ws/"), "source", F.lit("/"), "name")
    paths = names(spark, sf_dir).select(F.col("doc_id").alias("asked"), path.alias("path"))
    return S.refs_of(paths, refs(spark, sf_dir).drop("doc_id", "size")).select("asked", "path", "artifact_id", "extension", "listed")


def attempts(spark, sf_dir):
    granted = ["filesystem.read"]
    routed = refs(spark, sf_dir).join(R.explode_providers(providers(spark)).where("available"), "extension")
    position = F.expr("row_number() over (partition by artifact_id order by priority desc, provider_id)")
    fails = F.when(
        (F.col("doc_id") % 3 == 0) & (F.col("provider_id") != "text.read"), F.lit("ArtifactParseError")
    ).when(F.col("doc_id") % 19 == 0, F.lit("ArtifactNotFoundError"))
    return routed.select(
        "artifact_id", position.alias("position"), "provider_id", R.missing_permissions(F.col("required"), granted).alias("missing"),
        fails.alias("outcome")
    )


def fallback_chain(spark, sf_dir):
    return R.fallback(attempts(spark, sf_dir))


def fallback_outcome(spark, sf_dir):
    out = R.outcome(R.fallback(attempts(spark, sf_dir)))
    return out.withColumn("seen_as", R.facade_error(F.col("error_type"), F.lit(False)))


def trace_recent(spark, sf_dir):
    traces = read(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), F.col("ts").alias("started_at"), "event_type")
    return R.recent_traces(traces).select("trace_id", "event_type")


def activity_log(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("activity_type"),
        F.concat(F.lit("/ws/"), (F.col("event_id") % 5).cast("string")).alias("workspace_key"),
        F.concat(F.lit("/ws/f"), (F.col("event_id") % 23).cast("string")).alias("artifact_key"), F.col("ts").alias("opened_at"),
        F.col("event_id").alias("entry_id"), F.concat(F.lit("opened "), F.col("event_id").cast("string")).alias("title")
    )


def recent_activity(spark, sf_dir):
    return A.recent_activity(activity_log(spark, sf_dir), 5).select(
        "user_id", F.col("position").cast("long").alias("position"), "activity_type", "workspace_key", "artifact_key", "entry_id"
    )


def recents_streamed(spark, sf_dir):
    """Events as a stream in batches: each user's list as state, some entries always pinned."""
    at, rows = scratch.new_path(spark), read(spark, sf_dir, "events")
    rows.repartition(4, "event_id").write.parquet(at)
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
    entry = F.concat_ws("/", "event_type", ((F.col("event_id") + F.col("user_id")) % 23).cast("string"))
    rows = events.select(
        F.col("user_id").alias("owner"), entry.alias("entry"), F.col("ts").cast("timestamp").alias("opened_at"), F.col("event_id").alias("entry_id"),
        ((F.col("event_id") + F.col("user_id")) % 23 == 0).alias("pinned")
    )
    return RS.last_lists(RS.recents(rows, 4)).select(F.col("owner").alias("user_id"), "position", "entry", "entry_id", "pinned")


def recent_workspaces(spark, sf_dir):
    opens = read(spark, sf_dir, "events").select(
        F.concat(F.lit("/ws/"), F.col("user_id").cast("string")).alias("workspace_key"), F.col("ts").alias("opened_at"), "user_id"
    )
    out = A.recent_workspaces(opens, opens.where("user_id % 37 = 0"))
    return out.select("workspace_key", "pinned", "opens", F.col("position").cast("long").alias("position"))


def metadata_search(spark, sf_dir):
    files = names(spark, sf_dir).select(
        F.col("doc_id").alias("artifact_id"), "name", F.concat("source", F.lit("/"), "name").alias("relative_path"),
        F.lit("").alias("extension")
    )
    spaces = names(spark, sf_dir).select(
        F.col("source").alias("display_name"), F.concat(F.lit("/ws/"), "source").alias("path"), F.col("source").alias("workspace_id")
    ).distinct()
    return A.capped(
        A.search(" SRC1 ", workspaces=spaces, files=files, activities=activity_log(spark, sf_dir))
    ).select("kind", "key", "label", F.col("position").cast("long").alias("position"))


#: Queries of no, two, three and more letters, in several cases.
SOUGHT = ("", "1.", ".PDF", "src1", " Src1/f1", "f12", "nothing like it")


def metadata_search_indexed(spark, sf_dir):
    """File names that hold one of several queries, by trigrams; short queries scan."""
    files = names(spark, sf_dir).select("doc_id", "name", F.concat("source", F.lit("/"), "name").alias("relative_path"))
    own = G.index(files, "name", "relative_path")
    out = None
    for q in SOUGHT:
        found = G.find(own, q).select(F.lit(q).alias("query"), "doc_id", "name")
        out = found if out is None else out.unionByName(found)
    return out


def encodings_told(spark, sf_dir):
    """Documents as bytes in three encodings: the first that fits, and the text."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    data = F.when(k == 0, F.concat(F.lit(E.BOM), F.encode(text, "UTF-8"))).when(k == 1, F.encode(text, "UTF-8")).otherwise(F.encode(text, "UTF-16"))
    files = read(spark, sf_dir, "documents").select("doc_id", data.alias("content"))
    told = E.texts(files.where("doc_id % 3 < 2 OR octet_length(content) > 2"))
    return told.select("doc_id", E.kind(F.col("content")).alias("kind"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_filter, path_refs, provider_routing, read_guards, fallback_chain, fallback_outcome, trace_recent, recent_activity,
        recents_streamed, recent_workspaces, metadata_search, metadata_search_indexed, encodings_told
    )
}

_P = f"providers AS (SELECT plugin_id, provider_id, priority, string_split(extensions, ',') AS extensions, string_split(permissions, ',') AS permissions, string_split(required, ',') AS required, available, reason FROM (VALUES {PROVIDERS}) {_ROWS}), offered AS (SELECT *, unnest(extensions) AS extension FROM providers)"
_N = """names AS (SELECT doc_id, coalesce(source, 'none') AS source, strlen(coalesce(text, '')) AS size,
        ['', '', '', '', '~$', '.', ''][doc_id % 7 + 1] || 'f' || doc_id || ['.docx', '.pdf', '.TXT', '.md', '.xlsx', '.pptx', '.tmp', '', '.csv', '.zip', '.doc'][doc_id % 11 + 1] AS name FROM documents),
    visible AS (SELECT *, lower(regexp_extract(name, '[^.]\\.([^.]+)$', 1)) AS extension FROM names WHERE NOT starts_with(name, '.') AND NOT starts_with(name, '~$') AND lower(name) NOT IN ('.ds_store', 'desktop.ini', 'thumbs.db') AND NOT regexp_matches(lower(name), '\\.(tmp|temp|crdownload|partial)$')),
    refs AS (SELECT doc_id, '/ws/' || source || '/' || name AS path, 'a_' || substr(sha256('/ws/' || source || '/' || name), 1, 16) AS artifact_id, extension, size FROM visible WHERE extension <> '')""".replace("\\\\", "\\")
_TRY = """tries AS (SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY priority DESC, provider_id) AS position, provider_id,
        CASE WHEN len(list_filter(required, lambda x: x <> 'filesystem.read')) > 0 THEN 'PluginPermissionError' WHEN doc_id % 3 = 0 AND provider_id <> 'text.read' THEN 'ArtifactParseError' WHEN doc_id % 19 = 0 THEN 'ArtifactNotFoundError' END AS error_type
        FROM refs JOIN offered USING (extension) WHERE available),
    ended AS (SELECT *, coalesce(sum((error_type IS NULL OR error_type NOT IN ('ArtifactParseError', 'EncryptedArtifactError', 'ProviderExecutionError'))::INT) OVER (PARTITION BY artifact_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM tries),
    traces AS (SELECT artifact_id, position::INT AS position, provider_id, CASE WHEN error_type IS NULL THEN 'ok' ELSE 'error' END AS status, error_type, lag(provider_id) OVER (PARTITION BY artifact_id ORDER BY position) AS fallback_from FROM ended WHERE over = 0)"""

ORACLES = {
    "scan_filter": f"WITH {_P}, {_N} SELECT doc_id, name, extension FROM visible WHERE extension IN (SELECT extension FROM offered)",
    "path_refs": f"""
        WITH {_N} SELECT n.doc_id AS asked, '/ws/' || source || '/' || name AS path, artifact_id, r.extension, r.doc_id IS NOT NULL AS listed
        FROM names n LEFT JOIN refs r USING (doc_id)""",
    "provider_routing": f"""WITH {_P}, {_N} SELECT r.artifact_id, r.extension, first(provider_id ORDER BY priority DESC, provider_id) FILTER (WHERE available) AS selected,
        coalesce(string_agg(provider_id, '>' ORDER BY priority DESC, provider_id) FILTER (WHERE available), '') AS chain,
        CASE WHEN count(*) FILTER (WHERE available) > 0 THEN NULL WHEN count(provider_id) > 0 THEN 'ProviderNotAvailableError' ELSE 'CapabilityNotFoundError' END AS error_type,
        CASE WHEN count(*) FILTER (WHERE available) = 0 THEN first(reason ORDER BY priority DESC, provider_id) END AS reason
        FROM refs r LEFT JOIN offered o USING (extension) GROUP BY 1, 2""",
    "read_guards": f"""WITH {_N}, g AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '/etc/passwd' ELSE path END AS path, size, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN '/other' ELSE '/ws' END END AS root, doc_id % 17 <> 0 AS present FROM refs)
        SELECT doc_id, CASE WHEN root <> '/ws' OR NOT starts_with(path, '/ws/') THEN 'WorkspaceBoundaryError' WHEN NOT present THEN 'ArtifactNotFoundError' WHEN size > 8000 THEN 'ArtifactTooLargeError' END AS error_type FROM g""",
    "fallback_chain": f"WITH {_P}, {_N}, {_TRY} SELECT * FROM traces",
    "fallback_outcome": f"""WITH {_P}, {_N}, {_TRY}, l AS (SELECT artifact_id, max(position) AS position, count(*) AS attempts FROM traces GROUP BY 1)
        SELECT artifact_id, CASE WHEN status = 'ok' THEN provider_id END AS provider_id, fallback_from, error_type, attempts, error_type AS seen_as FROM l JOIN traces USING (artifact_id, position)""",
    "trace_recent": "SELECT event_id AS trace_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "recent_activity": """WITH log AS (SELECT user_id, event_type AS activity_type, '/ws/' || event_id % 5 AS workspace_key, '/ws/f' || event_id % 23 AS artifact_key, ts, event_id AS entry_id FROM events),
        newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, activity_type, workspace_key, artifact_key ORDER BY ts DESC, entry_id DESC) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, entry_id DESC) AS position FROM newest)
        SELECT user_id, position, activity_type, workspace_key, artifact_key, entry_id FROM ranked WHERE position <= 5""",
    "recents_streamed": """
        WITH log AS (SELECT user_id, event_type || '/' || (event_id + user_id) % 23 AS entry, ts, event_id AS entry_id, (event_id + user_id) % 23 = 0 AS pin FROM events),
        newest AS (
            SELECT *, bool_or(pin) OVER (PARTITION BY user_id, entry) AS pinned FROM log
            QUALIFY row_number() OVER (PARTITION BY user_id, entry ORDER BY ts DESC, entry_id DESC) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, pinned ORDER BY ts DESC, entry_id DESC) AS n FROM newest)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, n) AS position, entry, entry_id, pinned
        FROM ranked WHERE pinned OR n <= 4""",
    "recent_workspaces": """WITH last AS (SELECT '/ws/' || user_id AS workspace_key, max(ts) AS ts, count(*) AS opens, bool_or(user_id % 37 = 0) AS pinned FROM events GROUP BY 1),
        kept AS (SELECT * FROM last WHERE pinned UNION ALL (SELECT * FROM last WHERE NOT pinned ORDER BY ts DESC, workspace_key LIMIT 10))
        SELECT workspace_key, pinned, opens, row_number() OVER (ORDER BY pinned DESC, ts DESC, workspace_key) AS position FROM kept""",
    "metadata_search": f"""WITH {_N}, found AS (SELECT 'file' AS kind, doc_id::VARCHAR AS key, name AS label FROM names WHERE contains(lower(name), 'src1') OR contains(lower(source || '/' || name), 'src1')
        UNION ALL SELECT DISTINCT 'workspace', source, source FROM names WHERE contains(lower(source), 'src1')
        UNION ALL SELECT 'activity', event_id::VARCHAR, 'opened ' || event_id FROM events WHERE contains('opened ' || event_id, 'src1')),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY label, key) AS position FROM found)
        SELECT * FROM r WHERE kind = 'workspace' OR position <= CASE kind WHEN 'file' THEN 20 ELSE 10 END""",
    "metadata_search_indexed": f"""
        WITH {_N}, q AS (SELECT unnest({list(SOUGHT)}) AS query)
        SELECT query, doc_id, name FROM names, q
        WHERE trim(query) <> '' AND (contains(lower(name), lower(trim(query))) OR contains(lower(source || '/' || name), lower(trim(query))))""",
    "encodings_told": """
        SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'utf-8' ELSE 'other' END AS kind, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WHERE doc_id % 3 < 2 OR coalesce(text, '') <> ''""",
}
