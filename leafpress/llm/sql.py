"""DuckDB SQL for the queries of license scans, conversation tries and importance resampling."""

from __future__ import annotations

from leafpress.llm import licenses, prefixes, resampling

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc32(text: str) -> str:
    """The CRC-32 of a string's UTF-8 bytes, four bits at a time."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    halves = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || reverse(x))::UBIGINT)"
    step = lambda now, half: f"xor({now} >> 4, ({table}::UBIGINT[])[(xor({now}, {half}) & 15)::BIGINT + 1])"
    return f"xor(4294967295::UBIGINT, list_reduce({halves}, lambda a, b: {step(step('a', 'b >> 4'), 'b')}, 4294967295::UBIGINT))"


# a key is the digests of the turns one after another, 65 letters each
TRIE = rf"""
    WITH t AS (
        SELECT conv_id AS c, turn, coalesce(role, '') AS role,
            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || '/' AS own,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, own) AS place FROM t),
    ids AS (
        SELECT c, c - c % {prefixes.SHARING} AS first_one, {crc32("c::VARCHAR")} % {prefixes.HEADS} AS h
        FROM (SELECT DISTINCT c FROM t)),
    turns AS (
        SELECT ids.c, place, own, words FROM ids JOIN placed p ON p.c = first_one WHERE place <= h
        UNION ALL SELECT c, place, own, words FROM ids JOIN placed USING (c) WHERE place > h),
    prefixes AS (
        SELECT c, 0 AS depth, '' AS key, 0 AS words FROM ids
        UNION ALL SELECT c, row_number() OVER w, string_agg(own, '') OVER w, words FROM turns
        WINDOW w AS (PARTITION BY c ORDER BY place ROWS UNBOUNDED PRECEDING)),
    lengths AS (SELECT c, max(depth) AS depth FROM prefixes GROUP BY c),
    ends AS (
        SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS members FROM prefixes JOIN lengths USING (c, depth) GROUP BY key),
    nodes AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM prefixes GROUP BY depth, key),
    children AS (SELECT substr(key, 1, 65 * (depth - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    tree AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
    sums AS (
        SELECT substr(key, 1, 65 * up) AS key, sum(n_children = 0)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(generate_series(0, depth)) AS up FROM tree) GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
        sha256(coalesce(members, '')) AS ends_sha256
    FROM tree n JOIN sums USING (key) LEFT JOIN ends USING (key)
    LEFT JOIN nodes p ON n.depth > 0 AND p.key = substr(n.key, 1, 65 * (n.depth - 1))"""


RESAMPLING = rf"""
    WITH texts AS (
        SELECT true AS ours, row_number() OVER () AS rid, doc_id, {WORDS.format("text")} AS w FROM documents
        UNION ALL SELECT false, row_number() OVER (), NULL, {WORDS.format("text")} FROM benchmark),
    features AS (
        SELECT ours, rid, array_to_string(w[place:place + n - 1], ' ') AS feature, count(*) AS k
        FROM (SELECT ours, rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS place FROM texts, range(1, {resampling.LONGEST + 1}) AS r(n))
        GROUP BY ALL),
    hashed AS (SELECT feature, {crc32("feature")} % {resampling.BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM features)),
    counts AS (SELECT ours, rid, bucket, sum(k)::BIGINT AS k FROM features JOIN hashed USING (feature) GROUP BY ALL),
    totals AS (SELECT bucket, coalesce(sum(k) FILTER (ours), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (NOT ours), 0)::DOUBLE AS t FROM counts GROUP BY bucket),
    whole AS (SELECT sum(s) + {resampling.BUCKETS} AS s_all, sum(t) + {resampling.BUCKETS} AS t_all FROM totals),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all)))::BIGINT AS gain FROM totals, whole),
    weights AS (SELECT rid, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM counts JOIN gains USING (bucket) WHERE ours GROUP BY rid),
    scored AS (
        SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM texts LEFT JOIN weights USING (rid) WHERE ours),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
        count(*) FILTER (n_words >= {resampling.LEAST_WORDS}) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score,
        CASE WHEN n_words >= {resampling.LEAST_WORDS} AND place <= {resampling.PERCENT} * n // 100 THEN place END AS rank FROM ranks"""


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_TEMPLATES = ", ".join(f"({k}, '{label}', {_quoted(licenses.words(text))})" for k, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in licenses.PHRASES)

LICENSES = rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format("text")} AS w FROM documents),
    phrases AS (SELECT * FROM (VALUES {_PHRASES}) AS p(label, phrase, n)),
    base AS (
        SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
        FROM (SELECT rid, w, label, phrase, n, unnest(generate_series(0, len(w) - n)) AS spot FROM d, phrases WHERE list_contains(w, 'license'))
        WHERE array_to_string(w[spot + 1:spot + n], ' ') = phrase GROUP BY rid),
    templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(template, label, t)),
    theirs AS (
        SELECT template, spot, array_to_string(t[spot + 1:spot + {licenses.ROLL}], ' ') AS run
        FROM (SELECT template, t, unnest(generate_series(0, len(t) - {licenses.ROLL})) AS spot FROM templates)),
    ours AS (
        SELECT rid, place, array_to_string(w[place + 1:place + {licenses.ROLL}], ' ') AS run
        FROM (SELECT rid, w, unnest(generate_series(0, len(w) - {licenses.ROLL})) AS place FROM d)),
    diagonals AS (SELECT DISTINCT rid, template, place - spot AS diagonal FROM ours JOIN theirs USING (run)),
    marked AS (
        SELECT *, coalesce((diagonal - lag(diagonal) OVER line > {licenses.DRIFT})::INT, 1) AS fresh
        FROM diagonals WINDOW line AS (PARTITION BY rid, template ORDER BY diagonal)),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS island FROM marked),
    verified AS (
        SELECT rid, template, island, count(DISTINCT spot) AS n
        FROM (SELECT *, unnest(generate_series(0, len(t) - 1)) AS spot FROM islands JOIN templates USING (template) JOIN d USING (rid))
        WHERE diagonal + spot >= 0 AND w[diagonal + spot + 1] = t[spot + 1] GROUP BY rid, template, island),
    spans AS (SELECT rid, label, n / len(t) AS share FROM verified JOIN templates USING (template) WHERE n / len(t) >= {licenses.LEAST}),
    named AS (
        SELECT rid, label FROM spans
        UNION SELECT rid, unnest(string_split(base_labels, ',')) FROM base)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN base USING (rid) LEFT JOIN (SELECT rid, max(share) AS score FROM spans GROUP BY rid) USING (rid)
    LEFT JOIN (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY rid) USING (rid)"""
