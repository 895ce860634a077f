"""SQL of the queries over the stored layers."""

from __future__ import annotations

from engrava.functions.text import INVISIBLE
from engrava.operators.delivery import ROLE_NAMES
from engrava.operators.gates import SECRETS
from engrava.plans.store import CUTOFF

_SID = f"nullif(regexp_replace(session_id, '^[{INVISIBLE}]+|[{INVISIBLE}]+$', '', 'g'), '')"
_NAME = f"lower(regexp_replace(role, '^[{INVISIBLE}]+|[{INVISIBLE}]+$', '', 'g'))"
_ROLE = "CASE " + " ".join(f"WHEN {_NAME} IN ({', '.join(repr(n) for n in names)}) THEN '{plain}'" for plain, names in ROLE_NAMES.items()) + " END"
_SEC = """CASE WHEN "timestamp" IS NOT NULL AND isfinite("timestamp") THEN CASE WHEN abs("timestamp") >= 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END END"""
_NORM = r"trim(regexp_replace(lower({}), '[\s\x{{00A0}}\x{{0085}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0B\x1C-\x1F]+', ' ', 'g'))"


def norm(c: str) -> str:
    return _NORM.format(c)


def _front(text: str) -> str:
    return rf"regexp_extract({text}, '^---\n((?s:.*?))\n---(?:\n|$)', 1)"


def _field(name: str) -> str:
    return rf"nullif(trim(regexp_extract(chr(10) || {_front('text')} || chr(10), '\n{name}:[ ]*([^\n]*)\n', 1)), '')"


_BODY = r"regexp_replace(text, '^---\n(?s:.*?)\n---(?:\n|$)', '')"
_TITLE = rf"coalesce({_field('title')}, nullif(regexp_extract(chr(10) || {_BODY} || chr(10), '\n# +([^\n]+)\n', 1), ''), substring(trim({_BODY}), 1, 40))"
def flow(name: str) -> str:
    cut = rf"list_filter(list_transform(string_split(regexp_extract(coalesce({_field(name)}, ''), '^\[(.*)\]$', 1), ','), lambda t: trim(t)), lambda t: t <> '')"
    return f"list_filter({cut}, lambda t, i: list_position({cut}, t) = i)"


_TAGS = flow("tags")
_LINKS = r"list_distinct(list_transform(regexp_extract_all(text, '\[\[([^\]\[|#]+)(?:#[^\]\[|]*)?(?:\|[^\]\[]*)?\]\]', 1), lambda t: trim(string_split(t, '/')[-1])))"
_LATEST = """latest AS (SELECT id, count(*) AS n_exports, arg_max({x}, (coalesce(updated_at, ''), coalesce(imported_at, ''), coalesce(summary, ''))) AS x FROM candidates WHERE id IS NOT NULL GROUP BY id)"""
_WEIGHT = r"(length({0}) + 2 * length(regexp_replace({0}, '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g')))"

ORACLE = {
    "q03_vector_states": """SELECT coalesce(agent, 'unattributed') AS agent, CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 64 THEN 'wrong_width'
        WHEN NOT list_bool_and(list_transform(vector, lambda x: x IS NOT NULL AND isfinite(x))) THEN 'non_finite' WHEN NOT list_bool_or(list_transform(vector, lambda x: x <> 0)) THEN 'zero' ELSE 'usable' END AS state,
        count(*) AS n_facts FROM facts GROUP BY 1, 2""",
    "q24_content_dedup": f"SELECT arg_max(fact_id, (coalesce(\"timestamp\", ''), fact_id)) AS fact_id, count(*) AS copies FROM facts WHERE content IS NOT NULL GROUP BY {norm('content')}",
    "q25_fingerprints": f"SELECT fact_id, sha256({norm('content')}) AS fp FROM facts",
    "q26_tombstoned": f"""WITH t AS (SELECT fact_id, {norm('content')} AS text FROM facts WHERE content IS NOT NULL), p AS (SELECT DISTINCT {norm('content_prefix')} AS prefix FROM tombstones WHERE content_prefix IS NOT NULL)
        SELECT fact_id FROM t WHERE sha256(text) IN (SELECT fp FROM tombstones WHERE fp IS NOT NULL)
        OR EXISTS (SELECT 1 FROM p WHERE length(prefix) >= 40 AND length(text) >= 40 AND (starts_with(text, prefix) OR starts_with(prefix, text)))""",
    "q29_mirror_drift": f"""SELECT 'fact_without_message' AS drift, count(*) AS n FROM facts f WHERE source_rowid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.id = f.source_rowid)
        UNION ALL SELECT 'message_without_fact', count(*) FROM messages m WHERE {_ROLE} = 'user' AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.source_rowid = m.id)""",
    "q30_index_diff": """WITH s AS (SELECT path, coalesce(epoch_us(updated) / 1e6, 0.0) AS m FROM documents),
        i AS (SELECT source_path AS path, max(epoch_us(try_cast(updated_at AS TIMESTAMPTZ)) / 1e6) AS i FROM candidates WHERE source_path IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN i IS NULL THEN 'missing' WHEN m IS NULL THEN 'orphaned' WHEN abs(m - i) > 0.5 THEN 'stale' ELSE 'current' END AS state, count(*) AS n_paths FROM s FULL JOIN i USING (path) GROUP BY 1""",
    "q34_cooccurrence": f"""WITH {_LATEST.format(x="{'es': list_concat(coalesce(entities, []), coalesce(tags, []))}")}, e AS (SELECT DISTINCT o, unnest(es) AS e FROM (SELECT 'c' || id AS o, x.es AS es FROM latest UNION ALL SELECT 'd' || doc_id, {_TAGS} FROM documents WHERE text IS NOT NULL))
        SELECT a.e AS entity_a, b.e AS entity_b, count(*) AS weight FROM e a JOIN e b ON a.o = b.o AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 2""",
    "q35_topics": f"""SELECT origin, tag, count(*) AS n FROM (SELECT 'notes' AS origin, unnest({_TAGS}) AS tag FROM documents UNION ALL SELECT 'candidates', unnest(tags) FROM candidates) WHERE tag IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""",
    "q36_session_share": f"""WITH s AS (SELECT {_SID} AS session_id, count(*) AS n FROM messages GROUP BY 1), w AS (SELECT sum(n)::BIGINT AS n_rows FROM s)
        SELECT session_id, n AS n_top, n_rows, round(n / n_rows, 4) AS share, n / n_rows >= 0.5 AND n_rows >= 500 AS warn FROM s, w WHERE session_id IS NOT NULL ORDER BY n DESC, session_id DESC LIMIT 1""",
    "q37_recurrence": rf"""SELECT {norm(r"regexp_replace(lower(content), '[^\p{L}\p{N}\s]', '', 'g')")} AS wording, count(*) AS n, min(id) AS first_id, round(max({_SEC}), 3) AS last_seen FROM messages
        WHERE {_ROLE} = 'user' AND content IS NOT NULL AND regexp_matches(content, '[^{INVISIBLE}]') GROUP BY 1 HAVING count(*) >= 3 AND length(wording) >= 4""",
    "q38_categories": f"""SELECT CASE WHEN lower(trim(category)) IN ('meta', 'user', 'environment', 'tooling', 'project', 'workflow', 'reference') THEN lower(trim(category)) ELSE 'other' END AS category,
        count(*) AS n_facts, count(DISTINCT {norm('content')}) AS n_distinct FROM facts GROUP BY 1""",
    "q39_agents": """SELECT agent, sum(f)::BIGINT AS n_facts, sum(c)::BIGINT AS n_candidates FROM (SELECT coalesce(agent, 'unattributed') AS agent, 1 AS f, 0 AS c FROM facts
        UNION ALL SELECT coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.agent') END, 'unattributed'), 0, 1 FROM candidates) GROUP BY agent""",
    "q40_quality": f"""WITH t AS (SELECT fact_id, {norm("coalesce(content, '')")} AS text FROM facts), m AS (SELECT *, fact_id > min(fact_id) OVER (PARTITION BY text) AS repeats FROM t)
        SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN {_WEIGHT.format('text')} < 15 THEN 'short' WHEN length(text) > 500 THEN 'long' ELSE 'fit' END AS size_class, repeats, count(*) AS n_facts FROM m GROUP BY 1, 2""",
    "q44_secret_histogram": "SELECT pattern, count(*) AS n_texts FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern FROM (SELECT content AS text FROM messages UNION ALL SELECT text FROM documents) WHERE regexp_matches(text, '{p}')" for n, p in SECRETS.items()) + ") GROUP BY pattern",
    "q46_sentences": rf"""SELECT coalesce({_ROLE}, 'unknown') AS plain_role, count(*) AS n_sentences, count(DISTINCT s) AS n_distinct, sum(length(s))::BIGINT AS n_chars
        FROM (SELECT role, trim(unnest(regexp_split_to_array(content, '[.!?。！？\n]'))) AS s FROM messages WHERE content IS NOT NULL) WHERE length(s) BETWEEN 10 AND 500 GROUP BY 1""",
    "q48_provenance": f"""SELECT CASE WHEN source_rowid IS NULL THEN 'external' WHEN mid IS NULL THEN 'lost' WHEN f.role = mrole THEN 'agrees' WHEN f.role IS NULL THEN 'unset' ELSE 'differs' END AS state, count(*) AS n_facts
        FROM facts f LEFT JOIN (SELECT id AS mid, {_ROLE} AS mrole FROM messages) ON mid = source_rowid GROUP BY 1""",
    "q49_role_backfill": f"SELECT fact_id, new_role FROM facts JOIN (SELECT id, {_ROLE} AS new_role FROM messages) m ON m.id = source_rowid WHERE role IS NULL AND new_role IS NOT NULL",
    "q50_capacity": """SELECT fact_id, agent FROM (SELECT fact_id, coalesce(agent, '') AS agent, row_number() OVER (PARTITION BY coalesce(agent, '') ORDER BY coalesce("timestamp", '') DESC, fact_id DESC) AS place FROM facts) WHERE place > 100""",
    "q55_session_summary": f"""WITH r AS (SELECT id, {_SID} AS session_id, {_ROLE} AS r, length(content) AS n, {_SEC} AS sec FROM messages)
        SELECT session_id, arg_min(id, (coalesce(sec, 'infinity'::DOUBLE), id)) FILTER (WHERE r = 'user') AS first_user, arg_min(id, (-n, id)) FILTER (WHERE r = 'assistant' AND n IS NOT NULL) AS longest_assistant,
        round(max(sec), 3) AS last_time, count(*) AS n_rows FROM r WHERE session_id IS NOT NULL GROUP BY session_id""",
    "q56_valuable": rf"""SELECT {_SID} AS session_id, count(*) AS n_valuable, max(length(content)) AS longest FROM messages
        WHERE {_ROLE} = 'user' AND {_WEIGHT.format('content')} >= 50 AND regexp_matches(lower(content), '\b(always|never|must|prefers?|remember|because)\b|因为|除非|记住') GROUP BY 1""",
    "q57_notes": f"SELECT doc_id, {_TITLE} AS title, {_field('status')} AS status, len({_TAGS}) AS n_tags, len({_LINKS}) AS n_links FROM documents WHERE text IS NOT NULL",
    "q32_backlinks": rf"""WITH l AS (SELECT target, count(*) AS n_notes FROM (SELECT unnest({_LINKS}) AS target FROM documents WHERE text IS NOT NULL) GROUP BY target),
        k AS (SELECT regexp_extract(path, '([^/]+)\.md$', 1) AS target FROM documents WHERE text IS NOT NULL UNION SELECT {_TITLE} FROM documents WHERE text IS NOT NULL)
        SELECT target, n_notes, target IN (SELECT target FROM k WHERE target IS NOT NULL) AS known FROM l""",
    "q62_snapshot": 'SELECT fact_id, content, "timestamp" FROM facts ORDER BY "timestamp" DESC NULLS LAST, fact_id LIMIT 2000',
    "q63_retention": f"""WITH r AS (SELECT coalesce({_ROLE}, 'unknown') AS plain_role, {_SEC} AS sec FROM messages)
        SELECT plain_role, count(*) FILTER (WHERE sec < {CUTOFF}) AS n_expired, count(*) FILTER (WHERE sec IS NULL OR sec >= {CUTOFF}) AS n_kept FROM r GROUP BY 1""",
    "q65_usage": "SELECT user_id AS key, count(*) AS hits, max(epoch_us(ts)) AS last_used FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "q66_hour_buckets": f"WITH r AS (SELECT {_SID} AS sid, floor(({_SEC}) / 3600)::BIGINT AS hour FROM messages) SELECT hour, count(*) AS n_rows, count(DISTINCT sid) AS n_sessions FROM r WHERE hour IS NOT NULL GROUP BY 1",
    "q68_exports": f"""WITH {_LATEST.format(x="{'target': target, 'imported': imported, 'imported_at': imported_at}")}
        SELECT coalesce(lower(trim(x.target)), 'none') AS target, CASE WHEN NOT coalesce(x.imported, false) THEN 'open' WHEN x.imported_at IS NULL THEN 'imported_undated' ELSE 'imported' END AS state,
        count(*) AS n_candidates, sum(n_exports)::BIGINT AS n_exports FROM latest GROUP BY 1, 2""",
}
