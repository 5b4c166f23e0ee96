"""Queries of plugins, permissions, settings and text repairs, over providers made from parts and plugins made from suppliers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from leafpress.functions import text as T
from leafpress.operators import ocr as O
from leafpress.operators import runtime as R
from leafpress.operators import settings
from leafpress.plans.table_plans import html_grids
from leafpress.plans.text_plans import read

GRANTED = ["filesystem.read", "network"]


def some(**members):
    """An array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n.replace("__", "."))) for n, c in members.items()]))


def providers(spark, sf_dir):
    """A provider of a part, forty plugins' in all."""
    key = F.col("p_partkey")
    kind = lambda n: F.concat(F.lit("e"), n.cast("string"))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("plug"), (key % 40).cast("string")).alias("plugin_id"), F.concat(F.lit("prov"), key.cast("string")).alias("provider_id"),
        F.lit("artifact.read").alias("capability"), F.col("p_size").alias("priority"),
        F.array_distinct(F.array(kind(key % 7), kind(F.col("p_size") % 11))).alias("extensions"),
        some(filesystem__read="p_partkey % 2 = 0", network="p_partkey % 3 = 0", office__com="p_partkey % 5 = 0").alias("permissions"),
        some(filesystem__read="true", network="p_partkey % 4 = 0", ocr="p_partkey % 9 = 0").alias("required"), (key % 5 != 0).alias("available"),
        F.when(key % 5 != 0, "").otherwise(F.col("p_type")).alias("reason")
    )


def views(spark, sf_dir):
    """Plugins of suppliers: loaded ones, disabled ones, failures (some twice, some of disabled plugins), and manifests of nations that are no good."""
    s = read(spark, sf_dir, "supplier").withColumn("plugin_id", F.concat(F.lit("plug"), F.col("s_suppkey").cast("string")))
    found = s.select("plugin_id", F.when(F.col("s_suppkey") % 4 == 0, "builtin").otherwise("external").alias("source"))
    disabled = s.where("s_suppkey % 7 = 0").select("plugin_id")
    loaded = s.where("s_suppkey % 5 < 3 AND s_suppkey % 7 <> 0").select("plugin_id")
    failed = s.where("s_suppkey % 5 = 3").select(
        "plugin_id", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.when(F.col("s_suppkey") % 2 == 0, "api_version 0").otherwise("no entry point").alias("error")), F.struct(F.lit(2).alias("place"), F.lit("later").alias("error")))).alias("f")
    ).select("plugin_id", "f.place", "f.error")
    broken = read(spark, sf_dir, "nation").select(
        F.concat(F.when(F.col("n_nationkey") % 2 == 0, "plug").otherwise("broken"), F.col("n_nationkey").cast("string")).alias("plugin_id"),
        F.lit("external").alias("source"), F.when(F.col("n_nationkey") % 3 == 0, "api_version 9").otherwise("no JSON").alias("error")
    )
    return R.plugin_views(found, loaded, failed, disabled, broken)


def permissions_effective(spark, sf_dir):
    return providers(spark, sf_dir).select(
        "provider_id", F.array_join(R.effective_permissions(F.col("permissions"), GRANTED), ",").alias("effective"),
        F.array_join(R.missing_permissions(F.col("required"), GRANTED), ",").alias("missing")
    )


def plugin_status(spark, sf_dir):
    """Built-in ones first, then by name."""
    rows = R.plugin_status(views(spark, sf_dir), providers(spark, sf_dir))
    return rows.withColumn("position", F.expr("row_number() over (order by is_builtin desc, plugin_id)"))


def plugin_providers(spark, sf_dir):
    """What a plugin's view lists of its providers."""
    seen = R.provider_views(providers(spark, sf_dir), GRANTED).select("plugin_id", F.inline("views"))
    return seen.select("plugin_id", "provider_id", "available", "reason", "permissions")


def system_status(spark, sf_dir):
    return R.system_status(views(spark, sf_dir))


def capability_catalog(spark, sf_dir):
    """Providers of each extension, those of disabled plugins left out."""
    off = views(spark, sf_dir).where("state = 'disabled'").select("plugin_id")
    own = R.explode_providers(providers(spark, sf_dir)).join(off, "plugin_id", "left_anti")
    order = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "provider_id")))
    return own.groupBy("extension").agg(F.array_join(F.transform(order, lambda x: x["provider_id"]), ",").alias("providers"))


def manifest_problems(spark, sf_dir):
    key = F.col("p_partkey")
    pick = lambda n, yes, no: F.when(key % n == 0, yes).otherwise(no)
    array = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rows = read(spark, sf_dir, "part").select(
        F.concat(pick(4, F.lit("Bad Id "), F.lit("reader.p")), key.cast("string")).alias("id"),
        F.concat(F.lit("1."), pick(3, F.lit(""), F.lit("0.")), key.cast("string")).alias("version"), pick(5, 0, 1).alias("api_version"),
        pick(7, array(), array("x")).alias("extensions"), pick(6, array("artifact.read", "artifact.read"), array("artifact.read")).alias("capabilities"),
        pick(8, array("root"), array("filesystem.read")).alias("permissions")
    )
    return R.valid_manifest(rows).select("id", F.array_join("problems", ",").alias("problems"))


def effective_config(spark, sf_dir):
    """A setting for each nation at four levels, of which the first that is set counts."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    levels = [
        ("Runtime Override", F.when(key % 3 == 0, F.concat(F.lit("r"), key.cast("string")))), ("Environment", F.when(key % 2 == 0, F.upper(name)).otherwise("")),
        ("User Config", F.when(key % 5 != 0, F.lower(name))), ("Default", F.lit("d"))
    ]
    rows = read(spark, sf_dir, "nation")
    return rows.select("n_nationkey", R.first_set(levels).alias("p")).select("n_nationkey", "p.value", "p.source")


def config_resolved(spark, sf_dir):
    """``settings.resolve`` and ``settings.plugin_dirs`` for a user a nation."""

    def run(batches):
        for b in batches:
            rows = []
            for k, name in zip(*(b.column(c).to_pylist() for c in ("n_nationkey", "n_name")), strict=True):
                got = settings.resolve(
                    {"llm_model": name if k % 2 else "", "recent_workspace_limit": k % 4},
                    {"LEAFPRESS_LLM_MODEL": f" m{k} " if k % 3 == 0 else " ", "MODEL_DIR": "/m" if k % 4 == 0 else ""}, {"recent_activity_limit": k if k % 5 == 0 else None}
                )
                rows += [(k, n, str(got[n][0]), got[n][1]) for n in ("llm_model", "recent_workspace_limit", "model_dir", "recent_activity_limit")]
                dirs = settings.plugin_dirs(["/a", f"/u{k % 3}"], {"LEAFPRESS_PLUGIN_PATH": f"/u{k % 2}:/e"}, ["/a", "/r"])
                rows.append((k, "plugin_dirs", " ".join(d for d, _ in dirs), " ".join(s.split()[0] for _, s in dirs)))
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["n_nationkey", "name", "value", "source"])

    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "n_nationkey int, name string, value string, source string")


def plugin_dirs_merged(spark, sf_dir):
    """Folders named by suppliers in several spellings, each once, by the first that named it."""
    key, m = F.col("s_suppkey"), (F.col("s_suppkey") % 17).cast("string")
    spelled = F.when(key % 4 == 0, F.concat(F.lit("/u/"), m, F.lit("/"))).when(key % 4 == 1, F.concat(F.lit("/u//"), m)).when(
        key % 4 == 2, F.concat(F.lit("/u/./"), m)
    ).otherwise(F.concat(F.lit("/u/"), m))
    kept, _ = R.unique_first(read(spark, sf_dir, "supplier").select(key.alias("place"), T.path_key(spelled).alias("key")), "key", "place")
    return kept.select("place", "key")


def html_table_spans(spark, sf_dir):
    """A table of each nation with a cell over two rows and one over two columns."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    html = F.concat(
        F.lit("<table><tr><td rowspan=2>"), F.col("n_regionkey").cast("string"), F.lit("</td><td colspan='2'>"), "n_name", F.lit("</td></tr><tr>"),
        cell("n_nationkey"), cell("n_name"), F.lit("</tr></table>")
    )
    grids = html_grids(read(spark, sf_dir, "nation").select("n_nationkey", html.alias("html")), "n_nationkey")
    return grids.select("n_nationkey", F.array_join(F.transform("grid", lambda r: F.array_join(r, ",")), ";").alias("grid"))


#: Recognised texts, as they come and as they are meant.
REPAIRS = (
    ("第一一章", "第——章"), ("状态一一对应", "状态一一对应"), ("在Python和Go之间", "在 Python 和 Go 之间"), ("googlereader", "Google Reader"),
    ("结论一一（见附录）", "结论——（见附录）"), ("plain text", "plain text")
)


def recognised(spark, sf_dir):
    sample = F.element_at(F.array(*[F.lit(x) for x, _ in REPAIRS]), (F.col("p_partkey") % len(REPAIRS) + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(sample, F.lit("；"), F.col("p_partkey").cast("string")).alias("text"))


def ocr_text_norm(spark, sf_dir):
    return recognised(spark, sf_dir).select("k", O.repaired(F.col("text")).alias("text"))


def ocr_transformations(spark, sf_dir):
    return O.transformations(recognised(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        permissions_effective, plugin_status, plugin_providers, system_status, capability_catalog, manifest_problems, effective_config, config_resolved,
        plugin_dirs_merged, html_table_spans, ocr_text_norm, ocr_transformations
    )
}

_PROVIDERS = """providers AS (
        SELECT 'plug' || p_partkey % 40 AS plugin_id, 'prov' || p_partkey AS provider_id, p_size AS priority,
            list_distinct(['e' || p_partkey % 7, 'e' || p_size % 11]) AS extensions, p_partkey % 5 <> 0 AS available,
            CASE WHEN p_partkey % 5 <> 0 THEN '' ELSE p_type END AS reason,
            list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'filesystem.read' END, CASE WHEN p_partkey % 3 = 0 THEN 'network' END], lambda x: x IS NOT NULL) AS effective,
            CASE WHEN p_partkey % 9 = 0 THEN 'ocr' ELSE '' END AS missing FROM part)"""
_VIEWS = """s AS (SELECT 'plug' || s_suppkey AS plugin_id, CASE WHEN s_suppkey % 4 = 0 THEN 'builtin' ELSE 'external' END AS source, s_suppkey AS k FROM supplier),
    known AS (
        SELECT plugin_id, source, CASE WHEN k % 7 = 0 THEN 'disabled' WHEN k % 5 = 3 THEN 'failed' ELSE 'loaded' END AS state,
            CASE WHEN k % 7 <> 0 AND k % 5 = 3 THEN CASE WHEN k % 2 = 0 THEN 'api_version 0' ELSE 'no entry point' END ELSE '' END AS load_error
        FROM s WHERE k % 7 = 0 OR k % 5 <> 4),
    bad AS (
        SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'plug' ELSE 'broken' END || n_nationkey AS plugin_id, 'external' AS source, 'failed' AS state,
            CASE WHEN n_nationkey % 3 = 0 THEN 'api_version 9' ELSE 'no JSON' END AS load_error FROM nation),
    plugins AS (SELECT * FROM known UNION ALL SELECT * FROM bad WHERE plugin_id NOT IN (SELECT plugin_id FROM known))"""

ORACLES = {
    "permissions_effective": f"WITH {_PROVIDERS} SELECT provider_id, array_to_string(effective, ',') AS effective, missing FROM providers",
    "plugin_status": f"""
        WITH {_PROVIDERS}, {_VIEWS},
        seen AS (
            SELECT plugin_id, bool_or(available) AS usable, count(*) AS n,
                string_agg(provider_id || ': ' || reason, '; ' ORDER BY provider_id) FILTER (WHERE NOT available) AS reasons FROM providers GROUP BY 1),
        s2 AS (
            SELECT *, CASE WHEN state = 'disabled' THEN 'Disabled' WHEN state = 'failed' AND contains(load_error, 'api_version') THEN 'Incompatible'
                WHEN state = 'failed' THEN 'Load Failed' WHEN usable THEN 'Enabled' ELSE 'Unavailable' END AS status
            FROM plugins LEFT JOIN seen USING (plugin_id))
        SELECT plugin_id, source, status,
            CASE status WHEN 'Enabled' THEN '' WHEN 'Unavailable' THEN coalesce(reasons, '当前环境不可用')
                WHEN 'Disabled' THEN '已禁用：不参与路由' ELSE '加载失败：未进入 Registry' END AS reason,
            CASE WHEN state = 'loaded' THEN coalesce(n, 0) ELSE 0 END AS n_providers, source = 'builtin' AS is_builtin,
            row_number() OVER (ORDER BY source = 'builtin' DESC, plugin_id)::INT AS position FROM s2""",
    "plugin_providers": f"WITH {_PROVIDERS} SELECT plugin_id, provider_id, available, reason, array_to_string(effective, ',') AS permissions FROM providers",
    "system_status": f"""
        WITH {_VIEWS} SELECT count(*) FILTER (state = 'loaded') AS plugins_loaded, count(*) FILTER (state = 'disabled') AS plugins_disabled,
            count(*) FILTER (state = 'failed') AS plugins_failed FROM plugins""",
    "capability_catalog": f"""
        WITH {_PROVIDERS}, {_VIEWS}, offered AS (SELECT *, unnest(extensions) AS extension FROM providers)
        SELECT extension, string_agg(provider_id, ',' ORDER BY priority DESC, provider_id) AS providers
        FROM offered WHERE plugin_id NOT IN (SELECT plugin_id FROM plugins WHERE state = 'disabled') GROUP BY 1""",
    "manifest_problems": """
        SELECT CASE WHEN p_partkey % 4 = 0 THEN 'Bad Id ' ELSE 'reader.p' END || p_partkey AS id,
            array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'id' END, CASE WHEN p_partkey % 3 = 0 THEN 'version' END,
                CASE WHEN p_partkey % 5 = 0 THEN 'api_version' END, CASE WHEN p_partkey % 7 = 0 THEN 'extensions' END,
                CASE WHEN p_partkey % 8 = 0 THEN 'permissions' END, CASE WHEN p_partkey % 6 = 0 THEN 'duplicate capability' END],
                lambda x: x IS NOT NULL), ',') AS problems FROM part""",
    "effective_config": """
        SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_nationkey WHEN n_nationkey % 2 = 0 THEN upper(n_name)
                WHEN n_nationkey % 5 <> 0 THEN lower(n_name) ELSE 'd' END AS value,
            CASE WHEN n_nationkey % 3 = 0 THEN 'Runtime Override' WHEN n_nationkey % 2 = 0 THEN 'Environment'
                WHEN n_nationkey % 5 <> 0 THEN 'User Config' ELSE 'Default' END AS source FROM nation""",
    "config_resolved": """
        WITH n AS (SELECT n_nationkey AS k, n_name FROM nation)
        SELECT k AS n_nationkey, 'llm_model' AS name, CASE WHEN k % 3 = 0 THEN 'm' || k WHEN k % 2 = 1 THEN n_name ELSE '' END AS value,
            CASE WHEN k % 3 = 0 THEN 'Environment' WHEN k % 2 = 1 THEN 'User Config' ELSE 'Default' END AS source FROM n
        UNION ALL SELECT k, 'recent_workspace_limit', (k % 4)::VARCHAR, 'User Config' FROM n
        UNION ALL SELECT k, 'model_dir', CASE WHEN k % 4 = 0 THEN '/m' ELSE '' END, CASE WHEN k % 4 = 0 THEN 'Environment' ELSE 'Default' END FROM n
        UNION ALL SELECT k, 'recent_activity_limit', CASE WHEN k % 5 = 0 THEN k ELSE 20 END::VARCHAR, CASE WHEN k % 5 = 0 THEN 'Runtime Argument' ELSE 'Default' END FROM n
        UNION ALL SELECT k, 'plugin_dirs', '/a /u' || k % 3 || CASE WHEN k % 3 <> k % 2 THEN ' /u' || k % 2 ELSE '' END || ' /e /r',
            'User User' || CASE WHEN k % 3 <> k % 2 THEN ' Environment' ELSE '' END || ' Environment Runtime' FROM n""",
    "plugin_dirs_merged": "SELECT min(s_suppkey) AS place, '/u/' || s_suppkey % 17 AS key FROM supplier GROUP BY 2",
    "html_table_spans": "SELECT n_nationkey, n_regionkey || ',' || n_name || ';,' || n_nationkey || ',' || n_name AS grid FROM nation",
    "ocr_text_norm": f"SELECT p_partkey AS k, {[y for _, y in REPAIRS]}[p_partkey % {len(REPAIRS)} + 1] || '；' || p_partkey AS text FROM part",
    "ocr_transformations": f"""
        SELECT 'ocr.dash-confusion' AS rule_id, '1' AS version, count(*) AS n FROM part WHERE p_partkey % {len(REPAIRS)} IN (0, 4)
        UNION ALL SELECT 'ocr.english-spacing', '1', count(*) FROM part WHERE p_partkey % {len(REPAIRS)} IN (2, 3)""",
}
