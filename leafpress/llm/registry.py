"""Queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from leafpress.llm import mixing, quality, sql
from leafpress.llm.chat import op7_chat_format
from leafpress.llm.decontaminate import op6_decontaminate
from leafpress.llm.licenses import op11_license_scan
from leafpress.llm.mixing import op10_mix_sources
from leafpress.llm.pii import op2_personal_data
from leafpress.llm.prefixes import op12_conversation_trie
from leafpress.llm.quality import op3_quality_rules
from leafpress.llm.resampling import op13_importance_resampling
from leafpress.llm.secrets import op8_secret_scan
from leafpress.llm.simhash import op9_simhash_near_dedup
from leafpress.llm.substrings import op5_substring_dedup
from leafpress.llm.suffixes import op4_suffix_array_dedup
from leafpress.llm.tokens import op1_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_personal_data, op3_quality_rules, op4_suffix_array_dedup, op5_substring_dedup, op6_decontaminate,
        op7_chat_format, op8_secret_scan, op9_simhash_near_dedup, op10_mix_sources, op11_license_scan, op12_conversation_trie,
        op13_importance_resampling
    )
}

_ISLANDS = """
        islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS island FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM repeated)),
        spans AS (SELECT rid, min(i) AS a, max(i) + {length} AS b FROM islands GROUP BY rid, island),
        gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 1) AS a, a AS b FROM spans UNION ALL SELECT rid, coalesce(max(b), 1), n + 1 FROM d LEFT JOIN spans USING (rid) GROUP BY rid, n),
        sums AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)"""

_LIMITS = quality.Limits()
_TOP = ", ".join(f"({n}, {x})" for n, x in _LIMITS.top.items())
_DUPLICATED = ", ".join(f"({n}, {x})" for n, x in _LIMITS.duplicated.items())



def _sainte_lague(units: str, share: str, key: str, seats: str, inside: str) -> str:
    """Quotas by all quotients: of each unit as many as there are seats, the highest ones in an ``inside`` win."""
    won = f"SELECT {inside}, {key}, row_number() OVER (PARTITION BY {inside} ORDER BY {share}::DOUBLE / (2 * k - 1) DESC, {key} NULLS LAST, k) <= {seats} AS won"
    quotients = f"{won} FROM (SELECT *, unnest(generate_series(1, {seats}::BIGINT)) AS k FROM {units} WHERE {share} > 0)"
    names = " AND ".join(f"u.{c} IS NOT DISTINCT FROM w.{c}" for c in (*inside.split(", "), key))
    return f"SELECT u.*, coalesce(n_won, 0) AS quota FROM {units} u LEFT JOIN (SELECT {inside}, {key}, count(*) AS n_won FROM ({quotients}) WHERE won GROUP BY ALL) w ON {names}"


def _number(text: str, seed: int) -> str:
    return f"('0x' || substr(md5({text} || ':{seed}'), 1, 15))::BIGINT"


def _drawn(at: str) -> str:
    """Words that the systematic draw takes before position ``at`` of the shard."""
    upto = lambda k: f"((({k}) + start)::HUGEINT * rest // blocks - start::HUGEINT * rest // blocks)"
    return f"({upto(f'({at}) // block')} * block + ({at}) % block * ({upto(f'({at}) // block + 1')} - {upto(f'({at}) // block')}))"


_MIX = rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS id FROM documents),
        sums AS (SELECT 0 AS one, source, sum(size)::BIGINT AS source_size, greatest(1, ceil(count(*) / {mixing.SHARD_ROWS}))::BIGINT AS shards, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
        weighed AS (SELECT *, CASE n % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END::DOUBLE AS weight, source_size * {mixing.MOST}::DOUBLE AS cap FROM sums),
        levels AS (SELECT *, ((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER w, 0)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level
            FROM weighed WINDOW w AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (SELECT *, coalesce(least(cap, weight * (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, n LIMIT 1)), cap) AS target,
            greatest(1, least({mixing.MAX_BLOCK}, floor(source_size / shards / {mixing.BLOCKS_PER_SHARD})))::BIGINT AS block, least({mixing.GROUP}, ceil(shards / {mixing.GROUP}))::BIGINT AS groups FROM levels),
        shares AS (SELECT *, target / block AS share, round(sum(target / block) OVER ()) AS seats FROM targets),
        s AS ({_sainte_lague("shares", "share", "source", "seats", "one")}),
        dealt AS (SELECT doc_id, d.source, size, source_size, target, block, groups, quota, {_number("id", 7)} % shards AS shard, {_number("id", 8)} AS place FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        rows AS (SELECT doc_id, source, size, source_size, target, block, quota AS source_quota, shard, shard % groups AS grp, place FROM dealt),
        grps AS (SELECT source, grp, sum(size)::BIGINT AS size, any_value(source_quota) AS seats FROM rows GROUP BY source, grp),
        g AS ({_sainte_lague("grps", "size", "grp", "seats", "source")}),
        shrds AS (SELECT r.source, r.grp, shard, sum(r.size)::BIGINT AS size, any_value(quota) AS seats, any_value(block) AS block FROM rows r JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.grp = g.grp GROUP BY r.source, r.grp, shard),
        q AS (SELECT *, greatest(1, ceil(size / block))::BIGINT AS blocks FROM ({_sainte_lague("shrds", "size", "shard", "seats", "source, grp")})),
        placed AS (SELECT r.*, blocks, least(quota, blocks * {mixing.MOST}) // blocks AS whole, least(quota, blocks * {mixing.MOST}) % blocks AS rest, {_number("coalesce(r.source, '') || ':' || r.shard", 9)} % blocks AS start,
            sum(r.size) OVER (PARTITION BY r.source, r.shard ORDER BY place, doc_id NULLS FIRST, r.size ROWS UNBOUNDED PRECEDING)::BIGINT AS till FROM rows r JOIN q ON r.source IS NOT DISTINCT FROM q.source AND r.shard = q.shard)
        SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 THEN size * whole + {_drawn("till")} - {_drawn("till - size")} ELSE 0 END::BIGINT AS taken FROM placed"""

ORACLES = {
    "op3_quality_rules": rf"""
        WITH d AS (SELECT *, len(w) AS n_words FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
        words AS (SELECT rid, generate_subscripts(w, 1) AS p, length(unnest(w)) AS c FROM d),
        sums AS (SELECT rid, sum(c)::BIGINT AS word_chars FROM words GROUP BY rid),
        grams AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(generate_series(1, n_words - n + 1)) AS p FROM d, (SELECT unnest(generate_series(2, 10)) AS n) WHERE n_words >= n)),
        counted AS (SELECT *, count(*) OVER (PARTITION BY rid, n, s) AS k FROM grams),
        covered AS (SELECT rid, n, sum(c)::DOUBLE AS chars, count(*) AS places FROM (SELECT DISTINCT rid, n, unnest(generate_series(p, p + n - 1)) AS p FROM counted WHERE k > 1 AND n <> 2 AND n <> 4) JOIN words USING (rid, p) GROUP BY rid, n),
        shares AS (SELECT rid, chars / greatest(word_chars, 1) / x AS share FROM covered JOIN (VALUES {_DUPLICATED}) AS l(n, x) USING (n) JOIN sums USING (rid)
            UNION ALL SELECT rid, max(k * (length(s) - n + 1))::DOUBLE / greatest(any_value(word_chars), 1) / any_value(x) FROM counted JOIN (VALUES {_TOP}) AS l(n, x) USING (n) JOIN sums USING (rid) WHERE k > 1 GROUP BY rid, n),
        worst AS (SELECT rid, max(share) AS share FROM shares GROUP BY rid),
        lines AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again FROM (SELECT rid, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT rid, string_split(t, chr(10)) AS l FROM d)) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        by_line AS (SELECT rid, count(*) AS n_lines, sum(again::INT)::BIGINT AS n_dup_lines, sum(length(line)) AS chars, sum(CASE WHEN again THEN length(line) ELSE 0 END) AS dup_chars FROM lines GROUP BY rid),
        base AS (SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(places, 0) AS n_repeat_words, coalesce(share, 0) AS share,
            coalesce(n_lines > 1 AND n_dup_lines > {_LIMITS.lines} * n_lines, false) OR coalesce(dup_chars > {_LIMITS.line_chars} * greatest(chars, 1), false) AS lines_over
            FROM d LEFT JOIN sums USING (rid) LEFT JOIN worst USING (rid) LEFT JOIN by_line USING (rid) LEFT JOIN (SELECT rid, places FROM covered WHERE n = 3) USING (rid)),
        judged AS (SELECT *, n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.repeat_words_percent} * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (share > 1 OR lines_over) AS kept, round(share, 6) AS coverage FROM judged""",
    # windows as hexadecimal text, told apart by MD5
    "op4_suffix_array_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        windows AS (SELECT rid, i, md5(substr(h, 2 * i - 1, 400)) AS w FROM (SELECT rid, h, unnest(generate_series(1, n - 199)) AS i FROM d WHERE n >= 200)),
        repeated AS (SELECT rid, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),{_ISLANDS.format(length=200)},
        kept AS (SELECT rid, string_agg(substr(h, (2 * a - 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS k FROM gaps JOIN d USING (rid) GROUP BY rid)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (rid) LEFT JOIN sums USING (rid)""",
    "op5_substring_dedup": rf"""
        WITH d AS (SELECT *, len(w) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
        windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS w FROM (SELECT rid, w, unnest(generate_series(1, n - 34)) AS i FROM d WHERE n >= 35)),
        repeated AS (SELECT rid, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),{_ISLANDS.format(length=35)},
        kept AS (SELECT rid, array_to_string(flatten(list(w[a:b - 1] ORDER BY a)), ' ') AS k FROM gaps JOIN d USING (rid) GROUP BY rid)
        SELECT doc_id, n AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(k) AS kept_sha256 FROM d JOIN kept USING (rid) LEFT JOIN sums USING (rid)""",
    "op6_decontaminate": r"""
        WITH texts AS (SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), coalesce(item_id::VARCHAR, ''), text FROM benchmark),
        split AS (SELECT kind, rid, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        item_windows AS (SELECT DISTINCT id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM split WHERE kind = 'i' AND len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM item_windows),
        doc_windows AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT rid, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM split, sizes WHERE kind = 'd' AND len(w) >= size)),
        found AS (SELECT rid, size, i, id FROM doc_windows JOIN item_windows USING (size, s)),
        hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY rid),
        items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM found) GROUP BY rid)
        SELECT id::BIGINT AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM split LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid) WHERE kind = 'd'""",
    "op7_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        formatted AS (
            SELECT *, length('<|turn|><|text|><|end|>')
                + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
                + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS attachment_tokens
        FROM formatted GROUP BY conv_id""",
    "op10_mix_sources": _MIX,
    "op11_license_scan": sql.LICENSES,
    "op12_conversation_trie": sql.TRIE,
    "op13_importance_resampling": sql.RESAMPLING,
}
