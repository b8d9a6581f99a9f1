"""SQL of the derived tables, to be put in front of a query as common table expressions."""

from __future__ import annotations

_CS = "((doc_id % 50) * 7 + i * 237)"
_CLOCK = f"printf('%02d:%02d:%02d.%02d', {_CS} // 360000, ({_CS} // 6000) % 60, ({_CS} // 100) % 60, {_CS} % 100)"

_MEDIA = "['mp4','mkv','avi','mov','flv','wmv','webm','ts','wav','mp3','flac','ogg','m4a','aac','wma']"

CTES = {
    "lines": """
        SELECT doc_id, lang, source, i, trim(parts[i + 1], ' ' || chr(9) || chr(13)) AS line
        FROM (SELECT doc_id, lang, source, parts, unnest(range(len(parts))) AS i
              FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))""",
    "plain": """
        SELECT doc_id, lang, source, i AS line_start,
               row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx, line AS text,
               md5(line || '|' || lang || '|0') AS cache_key
        FROM lines WHERE line <> ''""",
    "lrc": f"""
        SELECT doc_id, i AS line_start, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx,
               CASE WHEN i % 2 = 1 THEN {_CLOCK} ELSE '00:' || substr({_CLOCK}, 4) END AS ts_text, line AS text
        FROM lines WHERE line <> ''""",
    "block_lines": f"""
        SELECT doc_id, i, {_CLOCK} AS ts_text, line || CASE WHEN i % 7 = 6 THEN ' and more' ELSE '' END AS words
        FROM lines WHERE i % 5 <> 4""",
    "srt": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx, ts_text, words AS text
        FROM block_lines""",
    # A block after one without text picks up its own number: the time before it is still waiting for words.
    "vtt": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx, ts_text,
               CASE WHEN i > 0 AND i % 5 = 0 THEN (i + 1) || ' ' || words ELSE words END AS text
        FROM block_lines""",
    "stamped": """
        SELECT *, CAST(substr(ts_text, 1, 2) AS BIGINT) * 3600000 + CAST(substr(ts_text, 4, 2) AS BIGINT) * 60000
               + CAST(substr(ts_text, 7, 2) AS BIGINT) * 1000 + CAST(substr(ts_text, 10, 2) AS BIGINT) * 10 AS start_ms
        FROM lrc""",
    "media": f"""
        SELECT doc_id, '/media/' || source AS dir, 'doc' || doc_id AS stem,
               {_MEDIA}[CAST(doc_id % 15 + 1 AS INTEGER)] AS ext FROM documents""",
    "subs": """
        SELECT doc_id, '/media/' || source AS dir, 'doc' || doc_id AS stem, doc_id % 3 AS kind,
               'doc' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.lrc' WHEN 1 THEN '.zh.srt' ELSE '.md' END AS name
        FROM documents""",
    "doc_keys": """
        SELECT doc_id, source, text, lang, md5(text || '|' || lang || '|0') AS cache_key FROM documents""",
    "cache": """
        SELECT cache_key, arg_min(text, doc_id) AS text, '/cache/' || cache_key || '.wav' AS result_path,
               arg_min(lang, doc_id) AS model, min(doc_id) AS doc_id,
               length(arg_min(text, doc_id)) AS file_size, 1 AS use_count
        FROM doc_keys WHERE doc_id % 3 = 0 GROUP BY cache_key""",
    "files": """
        SELECT result_path AS path FROM cache WHERE substr(cache_key, 1, 1) NOT IN ('0', '1')""",
    "step_events": """
        SELECT l_orderkey AS task_id, (l_linenumber - 1) % 3 + 1 AS step,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'done' WHEN 'AO' THEN 'running'
                    WHEN 'RF' THEN 'failed' WHEN 'RO' THEN 'pending' WHEN 'NF' THEN 'skipped' ELSE 'done' END AS status,
               row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % 3
                   ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS newest
        FROM lineitem""",
    "wide": """
        SELECT task_id, max(CASE WHEN step = 1 THEN status END) AS s1, max(CASE WHEN step = 2 THEN status END) AS s2,
               max(CASE WHEN step = 3 THEN status END) AS s3
        FROM step_events WHERE newest = 1 GROUP BY task_id""",
    "tasks": """
        SELECT o_orderkey AS task_id, CAST(o_custkey AS VARCHAR) AS group_id, 'task' || o_orderkey AS source_name,
               CASE WHEN o_custkey % 10 = 0 THEN '/jobs/双语-c' ELSE '/jobs/c' END || o_custkey AS dir,
               CASE WHEN o_custkey % 10 = 0 THEN '/jobs/双语-c' ELSE '/jobs/c' END || o_custkey
                   || '/task' || o_orderkey || '.mp4' AS source_path,
               o_orderstatus <> 'P' AS from_folder, coalesce(s1, 'pending') AS s1, coalesce(s2, 'pending') AS s2,
               coalesce(s3, 'pending') AS s3
        FROM orders LEFT JOIN wide ON o_orderkey = task_id""",
    "job_events": """
        SELECT event_id, ts, CAST(user_id AS VARCHAR) AS task_id, event_id % 3 + 1 AS step, event_type AS kind,
               event_type <> 'error' AS ok, least(99, CAST(floor(value / 5) AS BIGINT)) AS pct,
               CASE event_type WHEN 'error' THEN '处理失败' WHEN 'signup' THEN '警告 signup'
                    WHEN 'purchase' THEN '完成 purchase' WHEN 'click' THEN (event_id % 100) || '/100'
                    ELSE value || '%' END AS msg
        FROM events""",
    "series": """
        SELECT CAST(user_id AS VARCHAR) AS signal_id, event_id, event_type, value * 50 AS value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no
        FROM events""",
    "ranked": """
        SELECT CAST(label AS VARCHAR) AS signal_id, vec_id, embedding,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings""",
    "blocks": """
        SELECT signal_id, vec_id, rn % 2 AS channel, rn // 2 AS block_no, embedding FROM ranked""",
    "samples": """
        SELECT signal_id, vec_id, channel, block_no, block_no * 64 + p AS frame_no,
               CAST(embedding[p + 1] AS DOUBLE) * 32767.0 AS value
        FROM (SELECT *, unnest(range(len(embedding))) AS p FROM blocks)""",
}

# What each table is built from, nearest first.
NEEDS = {
    "plain": ("lines",), "lrc": ("lines",), "block_lines": ("lines",), "srt": ("block_lines",),
    "vtt": ("block_lines",), "stamped": ("lrc",), "cache": ("doc_keys",), "files": ("cache",),
    "wide": ("step_events",), "tasks": ("wide",), "blocks": ("ranked",), "samples": ("blocks",),
}


def natural(expr: str) -> str:
    """SQL of the natural sort key."""
    return (
        f"list_transform(regexp_extract_all(lower({expr}), '([0-9]+|[^0-9]+)'), lambda r: "
        "CASE WHEN regexp_matches(r, '^[0-9]') THEN {'k': 0, 'n': length(ltrim(r, '0')), 'v': ltrim(r, '0')} "
        "ELSE {'k': 1, 'n': 0, 'v': r} END)"
    )


def with_tables(names: str, body: str, **more: str) -> str:
    """``body`` preceded by the tables it names and what those need; ``more`` adds its own tables."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
