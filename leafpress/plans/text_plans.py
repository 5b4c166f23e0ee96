"""Queries over ``documents`` and ``conversations`` as text artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafpress.functions import text as T
from leafpress.operators import blocks as B
from leafpress.operators import context as C
from leafpress.ship import prepare


def read(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def document_path():
    return F.concat(F.lit("/ws/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def artifacts(spark, sf_dir):
    return B.text_artifacts(read(spark, sf_dir, "documents"), document_path(), F.col("text"))


def artifact_refs(spark, sf_dir):
    path = document_path()
    return read(spark, sf_dir, "documents").select(
        T.artifact_id(path).alias("artifact_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), path.alias("path"),
        F.lit("txt").alias("artifact_type"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_sha256"), T.workspace_id(F.lit("/ws")).alias("workspace_id")
    )


def text_blocks(spark, sf_dir):
    return B.line_blocks(artifacts(spark, sf_dir))


def text_metadata(spark, sf_dir):
    return artifacts(spark, sf_dir).select(
        "artifact_id", "title", "artifact_type", F.col("line_count").cast("long").alias("line_count"),
        F.length("content").cast("long").alias("content_chars"), F.size("lines").cast("long").alias("n_blocks")
    )


def turn_blocks(spark, sf_dir):
    """Conversation turns as text blocks of a paged artifact: the page is turn / 2."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select(
        F.concat(F.lit("c_"), F.col("conv_id").cast("string")).alias("artifact_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / 2 + 1).cast("int").alias("page")
    )


def block_type_counts(spark, sf_dir):
    docs = B.type_counts(text_blocks(spark, sf_dir))
    turns = turn_blocks(spark, sf_dir).select(
        "artifact_id", F.when(F.col("role") == "system", F.lit("heading")).otherwise(F.lit("text_block")).alias("block_type")
    )
    return docs.unionByName(B.type_counts(turns))


def _columns(contexts, *more):
    return contexts.select(
        "artifact_id", *[F.col(c).cast("long").alias(c) for c in ("n_blocks", "consumed")], "truncated",
        F.col("omitted_blocks").cast("long").alias("omitted_blocks"), "reason", F.length("context").cast("long").alias("context_chars"),
        *more
    )


def context_budget(spark, sf_dir):
    return _columns(C.of_lines(artifacts(spark, sf_dir)))


def context_budget_small(spark, sf_dir):
    return _columns(C.of_lines(artifacts(spark, sf_dir), C.Policy(max_chars=1000)))


def context_max_blocks(spark, sf_dir):
    return _columns(C.of_lines(artifacts(spark, sf_dir), C.Policy(max_blocks=3)))


def context_text(spark, sf_dir):
    return C.of_lines(artifacts(spark, sf_dir), C.Policy(max_chars=2000)).select(
        "artifact_id", "context", F.array_join("warnings", "\n").alias("warnings")
    )


def qa_prompt(spark, sf_dir):
    out = C.prompt(C.of_lines(artifacts(spark, sf_dir), C.Policy(max_chars=1500)), "What is this about?")
    return out.select("artifact_id", F.length("prompt").cast("long").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


PAGED = C.Policy(max_chars=1200)


def context_paged(spark, sf_dir):
    """Pages of a conversation, page 2 without a text layer."""
    item = F.struct("turn", "role", "text", "page", F.concat(F.lit("[Text] "), F.col("text")).alias("rendered"))
    grouped = turn_blocks(spark, sf_dir).groupBy("artifact_id").agg(F.array_sort(F.collect_list(item)).alias("blocks"))
    grouped = grouped.withColumns({"name": F.concat("artifact_id", F.lit(".pdf")), "artifact_type": F.lit("pdf"), "ocr_pages": F.array(F.lit(2))})
    return _columns(C.build(grouped, PAGED, pages="ocr_pages"), F.sha2("context", 256).alias("context_sha256"))


def transcript(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(ordered, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("transcript")
    )


def content_joined(spark, sf_dir):
    blocks = turn_blocks(spark, sf_dir).withColumn("seq", F.col("turn"))
    return B.joined_content(blocks)


def artifact_summary(spark, sf_dir):
    return B.summary(
        artifacts(spark, sf_dir).withColumns(
            {"types": F.transform("lines", lambda x: F.lit("paragraph")), "provider_id": F.lit("text.read")}
        )
    )


def preview_model(spark, sf_dir):
    return B.preview(artifacts(spark, sf_dir)).select(
        "name", "kind", F.sha2("content", 256).alias("content_sha256"), F.col("n_chars").cast("long").alias("n_chars"), "supported"
    )


def size_labels(spark, sf_dir):
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * F.pow(F.lit(7), F.col("doc_id") % 9).cast("long")
    return read(spark, sf_dir, "documents").select(
        "doc_id", n.alias("size"), T.size_label(n).alias("label"), T.card_size_label(n).alias("card_label")
    )


def cell_collapse(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(T.collapse(F.coalesce("text", F.lit(""))), 256).alias("collapsed_sha256"),
        F.sha2(T.cell(F.col("text")), 256).alias("cell_sha256"),
        F.sha2(T.header_key(F.coalesce("text", F.lit(""))), 256).alias("header_key_sha256")
    )


def page_ocr_flags(spark, sf_dir):
    """Pages of conversations, short turns standing for pages without text; and the totals of the document."""
    pages = turn_blocks(spark, sf_dir).groupBy("artifact_id", "page").agg(
        F.sum(F.when(F.length("text") > 120, F.length("text")).otherwise(F.lit(0))).alias("text_chars")
    )
    return pages.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("text_chars").alias("text_chars"),
        F.sum(F.when(F.col("text_chars") == 0, 1).otherwise(0)).alias("ocr_pages"), (F.sum("text_chars") == 0).alias("requires_ocr")
    )


QUERIES = {
    f.__name__: f
    for f in (
        artifact_refs, text_blocks, text_metadata, block_type_counts, context_budget, context_budget_small, context_max_blocks,
        context_text, context_paged, qa_prompt, transcript, content_joined, artifact_summary, preview_model, size_labels, cell_collapse,
        page_ocr_flags
    )
}

_ARTIFACTS = r"""
    named AS (SELECT *, '/ws/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name,
        regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS body FROM documents),
    arts AS (SELECT *, 'a_' || substr(sha256(path), 1, 16) AS artifact_id, string_split(body, chr(10)) AS raw,
        regexp_replace(coalesce(text, ''), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS content FROM named),
    raw_lines AS (SELECT artifact_id, generate_subscripts(raw, 1) - 1 AS line_index, regexp_replace(unnest(raw), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS line FROM arts),
    blocks AS (SELECT artifact_id, line_index, line, row_number() OVER (PARTITION BY artifact_id ORDER BY line_index) AS seq FROM raw_lines WHERE line <> '')"""


def _contexts(max_chars: int, max_blocks: int) -> str:
    return (
        f"WITH {_ARTIFACTS},"
        + rf"""
    heads AS (SELECT artifact_id, '[Document]' || chr(10) || 'Name: ' || name || chr(10) || 'Type: TXT' || chr(10) || 'Artifact ID: ' || artifact_id || chr(10) || 'Title: ' || doc_id AS head FROM arts),
    items AS (SELECT b.artifact_id, seq, '[Paragraph] ' || line AS s, length(head) + coalesce(sum(13 + length(line)) OVER (PARTITION BY b.artifact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12 + length(line) AS v
        FROM blocks b JOIN heads USING (artifact_id)),
    stops AS (SELECT artifact_id, min(seq) FILTER (WHERE seq > {max_blocks} OR v > {max_chars}) AS stop, count(*) AS n FROM items GROUP BY artifact_id),
    made AS (SELECT h.artifact_id, coalesce(n, 0) AS n_blocks, coalesce(stop - 1, n, 0) AS consumed, stop IS NOT NULL AS truncated,
        CASE WHEN stop IS NULL THEN NULL WHEN stop > {max_blocks} THEN 'max_blocks={max_blocks} reached' ELSE 'max_chars={max_chars} reached' END AS reason,
        head || coalesce((SELECT string_agg(chr(10) || s, '' ORDER BY seq) FROM items i WHERE i.artifact_id = h.artifact_id AND (stop IS NULL OR seq < stop)), '') AS kept
        FROM heads h LEFT JOIN stops USING (artifact_id)),
    contexts AS (SELECT *, CASE WHEN truncated THEN n_blocks - consumed ELSE 0 END AS omitted_blocks,
        kept || CASE WHEN truncated THEN chr(10) || '[Context Truncated] truncated=true omitted_blocks=' || (n_blocks - consumed) || ' reason=' || reason ELSE '' END AS context FROM made)"""
    )


_BUDGET = " SELECT artifact_id, n_blocks, consumed, truncated, omitted_blocks, reason, length(context) AS context_chars FROM contexts"
_TURNS = "turns AS (SELECT 'c_' || conv_id AS artifact_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, (floor(turn / 2) + 1)::INT AS page FROM conversations)"
_NOTE = "'[Note] 第 2 页无文本层（requires_ocr=true），该页文本可能缺失。'"

ORACLES = {
    "artifact_refs": f"WITH {_ARTIFACTS} SELECT artifact_id, name, path, 'txt' AS artifact_type, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS file_sha256, 'ws_' || substr(sha256('/ws'), 1, 12) AS workspace_id FROM arts",
    "text_blocks": f"WITH {_ARTIFACTS} SELECT artifact_id, seq::INT AS seq, 'b' || CASE WHEN seq < 10000 THEN lpad(seq::VARCHAR, 4, '0') ELSE seq::VARCHAR END AS block_id, 'paragraph' AS block_type, line AS text, line_index::INT AS line_index FROM blocks",
    "text_metadata": f"WITH {_ARTIFACTS} SELECT artifact_id, doc_id::VARCHAR AS title, 'txt' AS artifact_type, len(raw) AS line_count, length(content) AS content_chars, (SELECT count(*) FROM blocks b WHERE b.artifact_id = a.artifact_id) AS n_blocks FROM arts a",
    "block_type_counts": f"WITH {_ARTIFACTS}, {_TURNS} SELECT artifact_id, 'paragraph' AS block_type, count(*) AS n_blocks FROM blocks GROUP BY 1 UNION ALL SELECT artifact_id, CASE WHEN role = 'system' THEN 'heading' ELSE 'text_block' END, count(*) FROM turns GROUP BY 1, 2",
    "context_budget": _contexts(20000, 500) + _BUDGET,
    "context_budget_small": _contexts(1000, 500) + _BUDGET,
    "context_max_blocks": _contexts(20000, 3) + _BUDGET,
    "context_text": _contexts(2000, 500) + " SELECT artifact_id, context, CASE WHEN truncated THEN 'context truncated: ' || reason || ' (omitted_blocks=' || omitted_blocks || ')' ELSE '' END AS warnings FROM contexts",
    "qa_prompt": _contexts(1500, 500) + ", prompts AS (SELECT artifact_id, context || chr(10) || chr(10) || '[Question]' || chr(10) || 'What is this about?' AS prompt FROM contexts) SELECT artifact_id, length(prompt) AS prompt_chars, sha256(prompt) AS prompt_sha256 FROM prompts",
    "context_paged": rf"""WITH {_TURNS},
        seqs AS (SELECT *, row_number() OVER w AS seq, page IS DISTINCT FROM lag(page) OVER w AS is_new FROM turns WINDOW w AS (PARTITION BY artifact_id ORDER BY turn, role, text)),
        items AS (SELECT artifact_id, seq, 0 AS k, '[Page ' || page || ']' AS s FROM seqs WHERE is_new
            UNION ALL SELECT artifact_id, seq, 1, {_NOTE} FROM seqs WHERE is_new AND page = 2
            UNION ALL SELECT artifact_id, seq, 2, '[Text] ' || text FROM seqs),
        heads AS (SELECT DISTINCT artifact_id, '[Document]' || chr(10) || 'Name: ' || artifact_id || '.pdf' || chr(10) || 'Type: PDF' || chr(10) || 'Artifact ID: ' || artifact_id AS head FROM turns),
        placed AS (SELECT i.*, row_number() OVER w AS rn, length(head) + coalesce(sum(1 + length(s)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(s) AS v FROM items i JOIN heads USING (artifact_id) WINDOW w AS (PARTITION BY artifact_id ORDER BY seq, k)),
        stops AS (SELECT artifact_id, min(rn) FILTER (WHERE k <> 1 AND v > 1200) AS stop, max(seq) AS n FROM placed GROUP BY artifact_id),
        made AS (SELECT h.artifact_id, n AS n_blocks, stop IS NOT NULL AS truncated, (SELECT count(*) FROM placed p WHERE p.artifact_id = h.artifact_id AND k = 2 AND (stop IS NULL OR rn < stop)) AS consumed,
            head || coalesce((SELECT string_agg(chr(10) || s, '' ORDER BY rn) FROM placed p WHERE p.artifact_id = h.artifact_id AND (stop IS NULL OR rn < stop)), '') AS kept FROM heads h JOIN stops USING (artifact_id)),
        contexts AS (SELECT *, CASE WHEN truncated THEN 'max_chars=1200 reached' END AS reason, CASE WHEN truncated THEN n_blocks - consumed ELSE 0 END AS omitted_blocks,
            kept || CASE WHEN truncated THEN chr(10) || '[Context Truncated] truncated=true omitted_blocks=' || (n_blocks - consumed) || ' reason=max_chars=1200 reached' ELSE '' END AS context FROM made)
        SELECT artifact_id, n_blocks, consumed, truncated, omitted_blocks, reason, length(context) AS context_chars, sha256(context) AS context_sha256 FROM contexts""",
    "transcript": "SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id",
    "content_joined": f"WITH {_TURNS} SELECT artifact_id, string_agg(text, chr(10) ORDER BY turn, text) AS content FROM turns GROUP BY 1",
    "artifact_summary": f"""WITH {_ARTIFACTS}, n AS (SELECT artifact_id, count(*) AS k FROM blocks GROUP BY 1)
        SELECT artifact_id, '文件：' || name || chr(10) || '类型：TXT' || chr(10) || '路径：' || path || chr(10) || '标题：' || doc_id || CASE WHEN k > 0 THEN chr(10) || chr(10) || '结构：' || chr(10) || '  - Paragraph: ' || k ELSE '' END
        || chr(10) || chr(10) || '解析信息：' || chr(10) || '  - Adapter: text.read' || chr(10) || '  - 耗时: ? ms' || chr(10) || '  - Artifact ID: ' || artifact_id
        || CASE WHEN content <> '' THEN chr(10) || chr(10) || '内容预览：' || chr(10) || left(content, 3000) ELSE '' END || CASE WHEN length(content) > 3000 THEN chr(10) || '…（预览已截断）' ELSE '' END AS summary FROM arts LEFT JOIN n USING (artifact_id)""",
    "preview_model": f"WITH {_ARTIFACTS} SELECT name, 'TXT' AS kind, sha256(content) AS content_sha256, length(content) AS n_chars, true AS supported FROM arts",
    "size_labels": """WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) * pow(7, doc_id % 9)::BIGINT AS size FROM documents)
        SELECT doc_id, size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.1f GB', size / 1073741824.0) END AS label,
        CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.0f KB', size / 1024.0) ELSE printf('%.1f MB', size / 1048576.0) END AS card_label FROM s""",
    "cell_collapse": r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)
        SELECT doc_id, sha256(array_to_string(parts, ' / ')) AS collapsed_sha256, sha256(replace(replace(coalesce(text, ''), chr(10), ' '), '|', '\|')) AS cell_sha256, sha256(lower(regexp_replace(coalesce(text, ''), '[\s：:（）()、，,。.]', '', 'g'))) AS header_key_sha256 FROM l""",
    "page_ocr_flags": f"WITH {_TURNS}, p AS (SELECT artifact_id, page, sum(CASE WHEN length(text) > 120 THEN length(text) ELSE 0 END)::BIGINT AS text_chars FROM turns GROUP BY 1, 2) SELECT artifact_id, count(*) AS n_pages, sum(text_chars)::BIGINT AS text_chars, sum((text_chars = 0)::INT)::BIGINT AS ocr_pages, sum(text_chars) = 0 AS requires_ocr FROM p GROUP BY 1",
}
