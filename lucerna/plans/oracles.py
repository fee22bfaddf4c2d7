"""The queries of queries.py in SQL that DuckDB runs."""

from __future__ import annotations

import re

from lucerna.functions.text import METADATA, STOP_WORDS
from lucerna.operators.context import ANSWER_RULES, PROFILES, TITLES
from lucerna.operators.decide import CATEGORY_WORDS, UNSUPPORTED

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def excerpt(x: str, n: int) -> str:
    return rf"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n - 3}), '\s+$', '') || '...' END"


def tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({norm(x)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


def once(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def words(x: str) -> str:
    return f"len(list_filter(string_split(regexp_replace({x}, '\\s+', ' ', 'g'), ' '), lambda w: w <> ''))"


def score(q: str, c: str, boost: str) -> str:
    both = f"len(list_filter({q}, lambda t: list_contains({c}, t)))"
    near = f"len(list_filter({q}, lambda t: list_contains(list_slice({c}, 1, greatest(len({q}) * 4, 8)), t)))"
    return f"CASE WHEN len({q}) > 0 AND len({c}) > 0 THEN round(CAST({both} AS DOUBLE) / len({q}) * 1.6 + CAST({near} AS DOUBLE) / len({q}) * 0.6 + {boost}, 3) ELSE 0.0 END"


def holds(x: str) -> str:
    return f"coalesce(contains({norm(x)}, focus), false)"


def boost(x: str) -> str:
    return f"CASE WHEN {holds(x)} THEN CASE WHEN {words('focus')} >= 2 THEN 0.7 ELSE 0.4 END ELSE 0.0 END"


def unit_words(units: str) -> str:
    """The tokens of all four columns of units, without diacritics, with their weights."""
    found = r"unnest(list_filter(string_split(regexp_replace(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''))"
    weights = {"title": 1.0, "excerpt": 0.5, "content_text": 1.0, "search_text": 1.0}
    return " UNION ALL ".join(f"SELECT id, {found.format(c)} AS token, {w} AS weight FROM {units}" for c, w in weights.items())


SLUG = r"coalesce(nullif(substr(regexp_replace(regexp_replace({0}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), ''), 'item')"
EXT = r"lower(regexp_extract(trim(name), '\.([^.]*)$', 1))"
BASE = r"lower(regexp_replace(trim(name), '\.[^.]+$', ''))"

VIEWS = {
    "sessions": "SELECT source AS id, 'Session ' || upper(source) AS title, '2024-01-' || lpad(CAST(min(doc_id) % 28 + 1 AS VARCHAR), 2, '0') AS starts_at, CASE WHEN min(doc_id) % 3 = 0 THEN 'live' WHEN min(doc_id) % 3 = 1 THEN 'ended' ELSE 'scheduled' END AS status FROM documents GROUP BY source",
    "materials": f"SELECT 'doc' || CAST(doc_id AS VARCHAR) AS id, source AS session_id, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, CASE WHEN doc_id % 4 = 0 THEN 'slides' WHEN doc_id % 4 = 1 THEN 'handout' WHEN doc_id % 4 = 2 THEN 'code_example' ELSE 'reading' END || '_' || CAST(doc_id AS VARCHAR) || '.txt' AS source_label, {excerpt('text', 220)} AS content_text, doc_id AS order_index FROM documents",
    "chunks": "SELECT 'doc' || CAST(doc_id AS VARCHAR) || '_' || CAST(n - 1 AS VARCHAR) AS id, source AS session_id, 'doc' || CAST(doc_id AS VARCHAR) AS material_id, 'Part ' || CAST(n AS VARCHAR) AS heading, lang, line AS text, doc_id * 10000 + n - 1 AS order_index FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(line) <> ''",
    "glossary": "SELECT 'term' || CAST(item_id AS VARCHAR) AS id, 'src' || CAST(item_id % 20 AS VARCHAR) AS session_id, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS term, coalesce(string_split(text, ' ')[3], '') AS alias, len(string_split(text, ' ')) > 2 AS has_alias, text AS definition, item_id AS order_index FROM benchmark",
    "transcript": "SELECT 'turn_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS session_id, role AS speaker_label, text, turn * 30 AS started_at_seconds, conv_id * 1000 + turn AS order_index FROM conversations",
    "asked": "SELECT 'q' || CAST(order_index AS VARCHAR) AS question_id, session_id, definition AS question FROM glossary UNION ALL SELECT 'w' || CAST(order_index AS VARCHAR), session_id, 'What is ' || term || '?' FROM glossary",
    "stripped": f"SELECT question_id, session_id, question, {strip(rf'''regexp_replace({norm('question')}, '\?+$', '')''')} AS q FROM asked",
    "questions": f"SELECT question_id, session_id, question, {strip(r'''coalesce(nullif(regexp_extract(q, '^what is (.+)$', 1), ''), nullif(regexp_extract(q, '^what does (.+) mean$', 1), ''), nullif(regexp_extract(q, '^define (.+)$', 1), ''), nullif(regexp_extract(q, '^explain (.+)$', 1), ''))''')} AS focus, {once(tokens('question'))} AS qt FROM stripped",
    "g_cand": f"SELECT *, concat_ws(' ', term, alias, definition) AS candidate, {once(tokens('''concat_ws(' ', term, alias, definition)'''))} AS ct FROM glossary",
    "g_scored": f"SELECT q.question_id, g.id, g.term, g.definition, q.focus, g.order_index, g.candidate, (contains({norm('q.question')}, {norm('g.term')}) OR (g.has_alias AND contains({norm('q.question')}, {norm('g.alias')}))) AS exact, q.qt, g.ct FROM questions q JOIN g_cand g ON q.session_id = g.session_id",
    "g_match": f"SELECT * FROM (SELECT question_id, 'glossary_term' AS source_type, id AS source_record_id, 'Glossary: ' || term AS label, definition AS excerpt, {score('qt', 'ct', f'''(CASE WHEN exact THEN 1.4 ELSE 0.75 END + {boost('''term || ' ' || definition''')})''')} AS score, focus, order_index AS position, exact, {holds('candidate')} AS held FROM g_scored) WHERE score >= 0.8 AND (focus IS NULL OR exact OR held)",
    "m_cand": f"SELECT *, concat_ws(' ', heading, lang, text) AS candidate, {once(tokens('''concat_ws(' ', heading, lang, text)'''))} AS ct FROM chunks",
    "m_match": f"SELECT * FROM (SELECT q.question_id, 'material_chunk' AS source_type, m.id AS source_record_id, 'Material: ' || m.heading AS label, {excerpt('m.text', 420)} AS excerpt, {score('q.qt', 'm.ct', f'''(0.4 + {boost('''m.heading || ' ' || m.text''')})''')} AS score, q.focus, m.order_index AS position, {holds('m.candidate')} AS held FROM questions q JOIN m_cand m ON q.session_id = m.session_id) WHERE score >= 0.65 AND (focus IS NULL OR held)",
    "t_cand": f"SELECT *, concat_ws(' ', speaker_label, text) AS candidate, {once(tokens('''concat_ws(' ', speaker_label, text)'''))} AS ct FROM transcript",
    "t_match": f"SELECT * FROM (SELECT q.question_id, 'transcript_entry' AS source_type, t.id AS source_record_id, 'Transcript: ' || t.speaker_label AS label, {excerpt('t.text', 360)} AS excerpt, {score('q.qt', 't.ct', '0.1')} AS score, q.focus, t.order_index AS position, {holds('t.candidate')} AS held FROM questions q JOIN t_cand t ON q.session_id = t.session_id) WHERE score >= 0.55 AND (focus IS NULL OR held)",
    "e_match": f"SELECT b.question_id, 'evidence_unit' AS source_type, b.id AS source_record_id, u.title AS label, u.excerpt, greatest(1.0, 4 / greatest(b.rank, 0.25)) + {boost("u.title || ' ' || u.content_text")} + CASE WHEN u.modality IN ('image', 'video', 'slide', 'pdf') AND {holds("u.title || ' ' || u.content_text")} THEN 0.35 ELSE 0.0 END AS score, q.focus, b.place AS position FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank DESC, id) AS place FROM bm) b JOIN units u ON u.id = b.id JOIN questions q ON q.question_id = b.question_id WHERE b.place <= 18",
    "merged": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CASE source_type WHEN 'glossary_term' THEN 1 WHEN 'evidence_unit' THEN 2 WHEN 'material_chunk' THEN 3 ELSE 4 END, position, source_record_id) AS rank FROM (SELECT question_id, source_type, source_record_id, label, excerpt, score, focus, position FROM g_match UNION ALL SELECT question_id, source_type, source_record_id, label, excerpt, score, focus, position FROM m_match UNION ALL SELECT question_id, source_type, source_record_id, label, excerpt, score, focus, position FROM t_match UNION ALL SELECT question_id, source_type, source_record_id, label, excerpt, score, focus, position FROM e_match)) WHERE rank <= 18",
    "figures": f"SELECT question_id, max(score) AS strongest, avg(score) AS average, sum(score) AS total, count(*) FILTER (WHERE {holds('''label || ' ' || excerpt''')}) AS focused, count(DISTINCT source_type) AS kinds FROM merged WHERE rank <= 3 GROUP BY question_id",
    "supported": "SELECT q.question_id, coalesce(f.strongest, 0) AS strongest, coalesce(f.average, 0) AS average, coalesce(f.focused, 0) AS focused, coalesce(f.kinds, 0) AS kinds, coalesce(f.strongest, 0) >= 1.0 OR (coalesce(f.focused, 0) >= 1 AND coalesce(f.strongest, 0) >= 0.85) OR (coalesce(f.focused, 0) >= 2 AND coalesce(f.average, 0) >= 0.8) OR (q.focus IS NULL AND coalesce(f.kinds, 0) >= 2 AND coalesce(f.total, 0) >= 2.15) AS supported FROM questions q LEFT JOIN figures f ON q.question_id = f.question_id",
    "defined": f"SELECT question_id, CASE WHEN d = '' OR regexp_matches(d, '[.!?]$') THEN d ELSE d || '.' END AS definition FROM (SELECT question_id, {strip('excerpt')} AS d, row_number() OVER (PARTITION BY question_id ORDER BY tier, rank) AS n FROM (SELECT *, CASE WHEN source_type = 'glossary_term' AND {norm(r'''regexp_replace(label, '^(Glossary|Material|Transcript):\s*', '')''')} = focus THEN 0 WHEN {holds('''label || ' ' || excerpt''')} THEN 1 END AS tier FROM merged) WHERE tier IS NOT NULL) WHERE n = 1",
    "said": f"SELECT question_id, string_agg(x, ' ' ORDER BY n) AS generated FROM (SELECT question_id, {excerpt('excerpt', 140)} AS x, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS n FROM merged WHERE trim(excerpt) <> '') WHERE n <= 2 GROUP BY question_id",
    "assets": "SELECT CAST(doc_id AS VARCHAR) AS asset_id, source AS session_id, (['lecture_notes', 'glossary-terms', 'transcript 1', 'Course_Summary', 'public_qa', 'slide_deck', 'code-example', 'handout'])[doc_id % 8 + 1] || '_' || CAST(doc_id AS VARCHAR) || '.' || (['txt', 'md', 'csv', 'pdf', 'pptx', 'docx', 'png', 'mp4', 'zip'])[doc_id % 9 + 1] AS name, (['ready', 'pending', 'processing', 'failed', 'ready'])[doc_id % 5 + 1] AS status, doc_id, text FROM documents",
    "qa": "SELECT l.doc_id, l.quality, l.toxic, d.source, d.lang, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "qa_sources": "SELECT 's_' || CAST(doc_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS id, 'a' || CAST(doc_id AS VARCHAR) AS answer_id, source AS session_id, (['glossary_term', 'material_chunk', 'transcript_entry'])[(doc_id + k) % 3 + 1] AS source_type, 'doc' || CAST(doc_id AS VARCHAR) || '_0' AS source_record_id, CAST((doc_id * 7 + k * 3) % 10 AS DOUBLE) AS relevance_score, k FROM (SELECT doc_id, source, unnest(generate_series(0, doc_id % 3)) AS k FROM qa WHERE quality = 1)",
    "ranked_sources": "SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY CASE source_type WHEN 'glossary_term' THEN 0 WHEN 'material_chunk' THEN 1 WHEN 'transcript_entry' THEN 2 ELSE 99 END, relevance_score DESC, k, id) AS rank FROM qa_sources",
    "units": f"SELECT id, session_id, CASE WHEN order_index % 5 = 0 THEN 'pdf' ELSE 'text' END AS modality, material_id || ' ' || heading AS title, {excerpt('text', 240)} AS excerpt, text AS content_text, lower(text) AS search_text FROM chunks",
    "unit_words": unit_words("units"),
    "unit_index": "SELECT id, token, sum(weight) AS tf FROM unit_words GROUP BY id, token",
    "unit_sizes": "SELECT id, count(*) AS length FROM unit_words GROUP BY id",
    "asked_words": r"SELECT question_id, session_id, unnest(list_slice(p, 1, 8)) AS prefix FROM (SELECT question_id, session_id, list_filter(string_split(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2) AS p FROM asked)",
    "prefixes": "SELECT DISTINCT prefix, substr(prefix, 1, 2) AS head FROM asked_words",
    "pairs": "SELECT p.prefix, v.token FROM prefixes p JOIN (SELECT DISTINCT token, substr(token, 1, 2) AS head FROM unit_index) v ON p.head = v.head WHERE starts_with(v.token, p.prefix)",
    "hits": "SELECT p.prefix, i.id, sum(i.tf) AS tf FROM pairs p JOIN unit_index i ON p.token = i.token GROUP BY p.prefix, i.id",
    "dfs": "SELECT prefix, count(*) AS df FROM hits GROUP BY prefix",
    "bm": "SELECT a.question_id, h.id, round(sum(greatest(ln(((SELECT count(*) FROM units) - d.df + 0.5) / (d.df + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * s.length / ((SELECT sum(length) FROM unit_sizes) / (SELECT CAST(count(*) AS DOUBLE) FROM units))))), 9) AS rank FROM asked_words a JOIN hits h ON a.prefix = h.prefix JOIN units u ON u.id = h.id AND u.session_id = a.session_id JOIN dfs d ON d.prefix = a.prefix JOIN unit_sizes s ON s.id = h.id GROUP BY a.question_id, h.id",
    "dim": "SELECT 'lecture_material' AS type, id, title AS label, NULL AS parent_id FROM materials UNION ALL SELECT 'material_chunk', id, heading, material_id FROM chunks UNION ALL SELECT 'glossary_term', id, term, NULL FROM glossary UNION ALL SELECT 'transcript_entry', id, speaker_label, NULL FROM transcript UNION ALL SELECT 'evidence_unit', id, title, NULL FROM units",
}
_STEM = "['lecture_notes', 'glossary-terms', 'transcript 1', 'Course_Summary', 'public_qa', 'slide_deck', 'code-example', 'handout']"
_ENDING = "['txt', 'md', 'csv', 'pdf', 'pptx', 'docx', 'png', 'mp4', 'zip']"
#: Views that a view reads.
NEEDS = {
    "asked": ["glossary"], "stripped": ["asked"], "questions": ["stripped"], "g_cand": ["glossary"], "g_scored": ["questions", "g_cand"], "g_match": ["g_scored"], "m_cand": ["chunks"], "m_match": ["questions", "m_cand"],
    "t_cand": ["transcript"], "t_match": ["questions", "t_cand"], "e_match": ["bm", "units", "questions"], "merged": ["g_match", "m_match", "t_match", "e_match"], "figures": ["merged"], "supported": ["figures", "questions"], "defined": ["merged"], "said": ["merged"],
    "qa_sources": ["qa"], "ranked_sources": ["qa_sources"], "units": ["chunks"], "unit_words": ["units"], "unit_index": ["unit_words"], "unit_sizes": ["unit_words"], "asked_words": ["asked"], "prefixes": ["asked_words"],
    "pairs": ["prefixes", "unit_index"], "hits": ["pairs", "unit_index"], "dfs": ["hits"], "bm": ["asked_words", "hits", "units", "dfs", "unit_sizes"], "dim": ["materials", "chunks", "glossary", "transcript", "units"],
}

VIEWS["asset_names"] = "SELECT 'doc' || doc_id AS asset_id, (" + _STEM + "[doc_id % 8 + 1]) || '_' || doc_id || '.' || (" + _ENDING + "[doc_id % 9 + 1]) AS name FROM documents"
VIEWS["records"] = (
    "SELECT 'glossary_term' AS type, id, '- ' || term || ': ' || definition || CASE WHEN has_alias THEN ' Aliases: ' || alias || '.' ELSE '' END AS entry FROM glossary "
    "UNION ALL SELECT 'material_chunk', id, '- ' || heading || ': ' || text || coalesce(' Keywords: ' || lang || '.', '') FROM chunks "
    "UNION ALL SELECT 'transcript_entry', id, '- ' || speaker_label || ' at ' || started_at_seconds || 's: ' || text FROM transcript "
    "UNION ALL SELECT 'evidence_unit', u.id, '- ' || u.title || ': ' || u.content_text || ' Source file: ' || n.name || '.' || CASE WHEN c.order_index % 3 = 0 THEN ' Page ' || (c.order_index % 100) || '.' ELSE '' END FROM units u JOIN chunks c USING (id) JOIN asset_names n ON n.asset_id = c.material_id"
)
NEEDS["records"] = ["glossary", "chunks", "transcript", "units", "asset_names"]
#: The same over the units of a living index: those of the assets not deleted, a third of them written again.
_LIVING = ["units", "unit_words", "unit_index", "unit_sizes", "pairs", "hits", "dfs", "bm"]
_NUMBER = "CAST(regexp_extract(id, 'doc([0-9]+)_', 1) AS BIGINT)"
_AGAIN = f"{_NUMBER} % 3 = 0"
for _name in _LIVING:
    VIEWS[f"{_name}_now"] = re.sub(rf"\b({'|'.join(_LIVING)})\b(?! AS )", r"\1_now", VIEWS[_name])
    NEEDS[f"{_name}_now"] = [f"{n}_now" if n in _LIVING else n for n in NEEDS.get(_name, [])]
VIEWS["units_now"] = (
    f"SELECT id, session_id, title, CASE WHEN {_AGAIN} THEN '' ELSE excerpt END AS excerpt, CASE WHEN {_AGAIN} THEN array_to_string(list_reverse(string_split(content_text, ' ')), ' ') ELSE content_text END AS content_text, "
    f"CASE WHEN {_AGAIN} THEN '' ELSE search_text END AS search_text FROM units WHERE {_NUMBER} % 7 <> 0"
)
NEEDS["units_now"] = ["units"]


def sql(text: str, *views: str) -> str:
    """The query with the views it reads, and theirs, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    return ("WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order) + "\n" if order else "") + text


TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '')"
KIND = "CASE " + " ".join(
    rf"WHEN regexp_matches(base, '(^|[_\-\s])({w})([_\-\s]|$)') THEN '{k}'"
    for k, w in [("session", "session|metadata|meta"), ("glossary", "glossary|terms|definitions"), ("transcript", "transcript|captions|subtitles"), ("summaries", "summary|summaries|overview"), ("categories", "categories|category"), ("public_qa", "publicqa|public_qa|community|qa|q&a|questions")]
) + " ELSE 'material' END"
SHORT = "SELECT question_id, source_type, source_record_id, label, score FROM "
CLOCK = "lpad(CAST(({0}) // 60 AS VARCHAR), CAST(greatest(2, length(CAST(({0}) // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(({0}) % 60 AS VARCHAR), 2, '0')"
CATEGORY = "CASE key " + " ".join(f"WHEN '{k}' THEN " + " OR ".join(f"contains({norm('question')}, '{w}')" for w in ws) for k, ws in CATEGORY_WORDS.items()) + " ELSE false END"
FIRST_SENTENCE = r"regexp_extract({0}, '^(.*?[.!?])\s', 1)"
COUNTS = ", ".join(f"coalesce((SELECT count(*) FROM {t} x WHERE x.session_id = s.id), 0) AS {n}" for n, t in [("materials", "materials"), ("chunks", "chunks"), ("terms", "glossary"), ("entries", "transcript")])

ORACLES = {
    "F1_F4_F10_normalize_excerpt": f"SELECT doc_id, md5({norm('text')}) AS normalized, {excerpt('text', 180)} AS excerpt, md5({collapse('text')}) AS collapsed FROM documents",
    "F2_F3_tokens": f"SELECT conv_id, turn, array_to_string({tokens('text')}, ' ') AS tokens, CAST(len(list_distinct({tokens('text')})) AS BIGINT) AS n_distinct FROM conversations",
    "F5_F7_F9_ids_titles": sql(f"SELECT asset_id, {SLUG.format('lower(name)')} AS slug, 'material_' || {SLUG.format('lower(name)')} || CASE WHEN doc_id % 3 > 0 THEN '_' || CAST(doc_id % 3 AS VARCHAR) ELSE '' END AS built, session_id || '_' || asset_id AS scoped, {TITLE.format(strip(f'''regexp_replace({BASE}, '[_-]+', ' ', 'g')'''))} AS title FROM assets", "assets"),
    "F8_F37_digests": "SELECT page_id, sha256(html) AS checksum, sha256(CAST(page_id AS VARCHAR) || chr(31) || url) AS stable FROM pages",
    "F11_F12_W8_clock": f"SELECT conv_id, turn, {CLOCK.format('conv_id * 30 + turn')} AS clock, CAST(CASE WHEN (conv_id * 30 + turn) // 60 > 99 THEN ((conv_id * 30 + turn) // 60 % 100) * 60 + (conv_id * 30 + turn) % 60 ELSE conv_id * 30 + turn END AS BIGINT) AS seconds FROM conversations",
    "F13_T11_transcript_lines": f"SELECT conv_id, turn, role AS speaker, md5({strip('''string_split(text, chr(10))[1]''')}) AS text, CAST(turn * 75 AS BIGINT) AS started_at FROM conversations WHERE NOT contains(text, chr(10)) UNION ALL SELECT conv_id, turn, 'Lecture', md5('[' || {CLOCK.format('turn * 75')} || '] ' || role || ': ' || text), CAST(turn * 30 AS BIGINT) FROM conversations WHERE contains(text, chr(10))",
    "F14_F15_F22_split": rf"SELECT item_id, 'item ' || CAST(item_id AS VARCHAR) AS key, md5({strip('''' a; b ,' || text''')}) AS value, CAST(len(list_filter(list_transform(string_split(regexp_replace(' Item ' || CAST(item_id AS VARCHAR) || ' : a; b ,' || text, '[;,|]', chr(1), 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '')) AS BIGINT) AS parts, array_to_string(list_slice({once(r'''list_filter(string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), lambda w: w <> '')''')}, 1, 6), ' ') AS keywords FROM benchmark",
    "F16_F20_classify": sql(f"SELECT asset_id, extension, base, {KIND} AS kind, CASE WHEN extension IN ('ppt', 'key', 'doc', 'docx', 'xls', 'xlsx') THEN 'binary' WHEN extension NOT IN ('json', 'txt', 'md', 'markdown', 'csv', 'pdf', 'pptx', 'png', 'jpg', 'jpeg', 'webp', 'mp4', 'mov', 'm4v', 'avi', 'webm') THEN 'unsupported' END AS error, CASE WHEN extension IN ('pptx', 'png', 'jpg', 'jpeg', 'webp') OR regexp_matches(base, 'slide|deck|presentation') THEN 'slide_deck' WHEN regexp_matches(base, 'handout|worksheet') THEN 'handout' WHEN regexp_matches(base, 'code|snippet|example') THEN 'code_sample' ELSE 'reading' END AS type, CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'pptx' THEN 'slide' ELSE 'text' END AS modality FROM (SELECT asset_id, {EXT} AS extension, {BASE} AS base FROM assets)", "assets"),
    "F21_summary_kind": "SELECT doc_id, CASE WHEN contains(lower(text), 'exam') THEN 'exam_focus' WHEN contains(lower(text), 'key') THEN 'key_points' ELSE 'overview' END AS kind FROM documents",
    "F24_string_list": "SELECT event_id, event_type || '|x' AS strings FROM events",
    "F36_F38_labels": f"SELECT doc_id, 'Material: ' || lang AS label, lang AS name, CASE WHEN doc_id % 3 = 0 THEN 'page ' || CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'slide ' || CAST(doc_id AS VARCHAR) WHEN doc_id % 2 = 0 THEN {CLOCK.format('doc_id * 10')} || CASE WHEN doc_id % 4 = 0 THEN '-' || {CLOCK.format('doc_id * 10 + 5')} ELSE '' END END AS location FROM documents",
    "T1_paragraphs": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS order_index, text FROM (SELECT doc_id, n, {collapse('line')} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)) WHERE text <> ''",
    "T12_categories": "SELECT c_custkey // 20 AS asset_id, CAST(row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS INTEGER) AS order_index, " + SLUG.format("lower(c_name)") + " AS key, c_name AS label, c_mktsegment AS description FROM customer",
    "T15_A16_metadata": "SELECT o_custkey AS asset_id, CAST(max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR) AS f, CAST(max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR) AS o, CAST(max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS VARCHAR) AS p FROM orders GROUP BY o_custkey",
    "T16_materials": sql(f"SELECT session_id, 'material_' || {SLUG.format('base')} || CASE WHEN doc_id > 0 THEN '_' || CAST(doc_id AS VARCHAR) ELSE '' END AS id, {TITLE.format(strip('''regexp_replace(base, '[_-]+', ' ', 'g')'''))} AS title, CASE WHEN extension IN ('pptx', 'png') OR regexp_matches(base, 'slide|deck|presentation') THEN 'slide_deck' WHEN regexp_matches(base, 'handout|worksheet') THEN 'handout' WHEN regexp_matches(base, 'code|snippet|example') THEN 'code_sample' ELSE 'reading' END AS type, {excerpt('c', 220)} AS content_text, doc_id AS order_index FROM (SELECT session_id, doc_id, {BASE} AS base, {EXT} AS extension, {collapse('text')} AS c FROM assets) WHERE c <> ''", "assets"),
    "R4_R6_focus": sql(f"SELECT question_id, focus, {boost('''concat_ws(' ', 'About', focus)''')} AS boost, CAST(len(qt) AS BIGINT) AS n_tokens FROM questions", "questions"),
    "R1_R2_R3_R7_glossary": sql(SHORT + "g_match", "g_match"),
    "R8_J18_materials": sql(SHORT + "m_match", "m_match"),
    "R8_transcripts": sql(SHORT + "t_match", "t_match"),
    "R13_O15_L2_top_matches": sql("SELECT question_id, source_type, source_record_id, round(score, 6) AS score, rank FROM merged", "merged"),
    "J15_names": """
WITH d AS (SELECT doc_id, source AS session_id, 'f' || (doc_id // 60) || '.txt' AS file_name FROM documents)
SELECT d.doc_id, d.file_name, s.doc_id AS source, p.doc_id AS parsed FROM d JOIN (SELECT session_id, file_name, min(doc_id) AS doc_id FROM d WHERE doc_id % 2 = 0 GROUP BY ALL) s USING (session_id, file_name)
LEFT JOIN (SELECT session_id, file_name, max(doc_id) AS doc_id FROM d WHERE doc_id % 3 = 0 GROUP BY ALL) p USING (session_id, file_name)
""",
    "B2_J9_focused": sql(f"SELECT question_id, CAST(rank - 1 AS INTEGER) AS order_index, md5(CASE source_type {' '.join(f"WHEN '{k}' THEN '{t[0]}'" for k, t in TITLES.items())} END || chr(10) || r.entry) AS block FROM merged m JOIN records r ON r.type = m.source_type AND r.id = m.source_record_id WHERE rank <= 6", "merged", "records"),
    "B6_J11_digests": sql("""
, dig AS (SELECT 'dig' || doc_id AS id, source AS session_id, 'doc' || doc_id AS asset_id, 'Digest ' || doc_id AS title, """ + excerpt("text", 200) + """ AS text, doc_id FROM documents),
hit AS (SELECT DISTINCT m.question_id, regexp_extract(m.source_record_id, '^(doc[0-9]+)_', 1) AS asset_id FROM merged m WHERE m.source_type = 'evidence_unit'),
c AS (SELECT q.question_id, d.title, d.text, row_number() OVER (PARTITION BY q.question_id ORDER BY d.doc_id) - 1 AS n FROM questions q JOIN dig d ON d.session_id = q.session_id
  WHERE EXISTS (SELECT 1 FROM hit h WHERE h.question_id = q.question_id AND h.asset_id = d.asset_id) OR """ + holds("d.title || ' ' || d.text") + """)
SELECT question_id, 5 AS section, CAST(n AS INTEGER) AS order_index, md5('Asset digest' || chr(10) || '- ' || title || ': ' || text) AS block FROM c WHERE n < 4
UNION ALL SELECT q.question_id, 6, 0, md5('Session digest' || chr(10) || s.title) FROM questions q JOIN sessions s ON s.id = q.session_id
""", "merged", "questions", "sessions"),
    "R15_visual": sql("""
, seen AS (SELECT u.*, c.order_index, CASE WHEN c.order_index % 3 = 0 THEN c.order_index % 100 END AS page, """ + once(tokens("u.title || ' ' || u.search_text")) + """ AS ct, n.name FROM units u JOIN chunks c USING (id) JOIN asset_names n ON n.asset_id = c.material_id WHERE CAST(regexp_extract(c.material_id, '([0-9]+)$', 1) AS BIGINT) % 2 = 0),
one AS (SELECT m.question_id, min_by(m.source_record_id, m.rank) AS id FROM merged m WHERE m.source_type = 'evidence_unit' AND m.source_record_id IN (SELECT id FROM seen) GROUP BY 1),
q AS (SELECT *, """ + once(tokens("question")) + """ AS qt FROM questions WHERE question_id NOT IN (SELECT question_id FROM one)),
sc AS (SELECT q.question_id, s.id, s.title, """ + score("qt", "ct", "0.3 + " + boost("s.title || ' ' || s.search_text")) + """ AS score, """ + holds("s.title || ' ' || s.content_text") + """ AS held FROM q JOIN seen s ON s.session_id = q.session_id),
two AS (SELECT question_id, arg_min(id, (-score, title, id)) AS id FROM sc WHERE score >= 0.6 OR held GROUP BY 1),
every AS (SELECT question_id, 0 AS tier, id FROM one UNION ALL SELECT question_id, 1, id FROM two)
SELECT e.question_id, e.tier, e.id, 'file:/' || e.id AS uri, md5(concat_ws(' ', s.title, 'File: ' || s.name || '.', 'Page ' || s.page || '.', s.excerpt)) AS caption FROM every e JOIN seen s USING (id)
""", "merged", "questions", "units", "chunks", "asset_names"),
    "T10_columns": r"""
SELECT doc_id, md5(concat_ws(chr(10) || chr(10), rtrim('l ' || a) || chr(10) || rtrim('m ' || b) || chr(10) || chr(10) || rtrim('r ' || b) || chr(10) || rtrim('s ' || a), nullif(CASE WHEN regexp_matches(w, '^[0-9]+$') OR w = '-' THEN '' ELSE w END, ''))) AS text
FROM (SELECT doc_id, trim(substr(regexp_replace(coalesce(string_split(text, chr(10))[1], ''), '\s+', ' ', 'g'), 1, 50)) AS a, trim(substr(regexp_replace(coalesce(string_split(text, chr(10))[2], ''), '\s+', ' ', 'g'), 1, 50)) AS b, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS w FROM documents)
""",
    "T21_T17_J14_assembly": rf"""
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS n, coalesce(lang, 'none') AS lang, coalesce(text, '') AS raw, {strip("coalesce(text, '')")} AS t FROM documents),
u AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Course ' || n ELSE 'Notes ' || n END AS title, t <> '' AS full_text, doc_id % 2 = 0 AS listed FROM d),
s AS (SELECT *, 'session_' || lower(replace(title, ' ', '_')) AS sid, {collapse("raw")} AS one FROM u),
q AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'concepts' ELSE 'lang' END AS cat FROM s WHERE doc_id % 5 <> 0 AND listed)
SELECT 'lecture_sessions' AS name, sid AS id, sid AS session_id, title || '|' || CASE WHEN doc_id % 3 = 0 THEN 'ended' ELSE 'live' END || '|uploaded,ground-truth,' || CASE WHEN doc_id % 3 = 0 THEN 'x,' ELSE '' END || 'material,glossary,transcript' || CASE WHEN doc_id % 3 = 0 THEN ',session' ELSE '' END || CASE WHEN listed THEN ',categories' ELSE '' END || ',public-qa|Ground-truth lecture import assembled from ' || (4 + CAST(doc_id % 3 = 0 AS INTEGER) + CAST(listed AS INTEGER)) || ' uploaded files.' AS told FROM s
UNION ALL SELECT 'lecture_materials', sid || CASE WHEN full_text THEN '_material_notes_' || n ELSE '_material_imported_glossary' END, sid, CASE WHEN full_text THEN 'Notes ' || n || '|reading|notes_' || n || '.csv' ELSE 'Imported glossary|reading|generated-from-glossary' END FROM s
UNION ALL SELECT 'material_chunks', sid || CASE WHEN full_text THEN '_chunk_notes_' || n || '_part_1_0' ELSE '_chunk_glossary_term_' || n || '_0' END, sid, sid || CASE WHEN full_text THEN '_material_notes_' || n ELSE '_material_imported_glossary' END || '|' || md5(CASE WHEN full_text THEN t ELSE lang END) FROM s
UNION ALL SELECT 'glossary_terms', sid || '_glossary_term_' || n, sid, 'Term ' || n || '|' || lang FROM s
UNION ALL SELECT 'transcript_entries', sid || '_transcript_said_' || n || '_0', sid, CASE WHEN one <> '' THEN 'Dr. X|' || md5(one) ELSE 'Lecture|' || md5('Dr. X:') END || '|65' FROM s
UNION ALL SELECT 'qa_categories', sid || '_category_concepts', sid, 'concepts|' || CASE WHEN listed THEN 'c' ELSE 'Definitions and grounded lecture concepts.' END FROM s
UNION ALL SELECT 'qa_categories', sid || '_category_lang_1', sid, 'lang|' || lang FROM s WHERE listed
UNION ALL SELECT 'questions', sid || '_public_question_what_is_' || n || '_1', sid, sid || CASE WHEN cat = 'lang' THEN '_category_lang_1' ELSE '_category_concepts' END || '|What is ' || n || '?' FROM q
UNION ALL SELECT 'answers', sid || '_public_answer_what_is_' || n || '_1', sid, sid || '_public_question_what_is_' || n || '_1|It is.' FROM q
UNION ALL SELECT 'answer_sources', sid || '_public_answer_what_is_' || n || '_1_src_0', sid, sid || '_glossary_term_' || n || '|Glossary: Term ' || n || '|' || lang FROM q
UNION ALL SELECT 'questions', sid || '_public_question_what_is_' || n || '_1', sid, sid || '_category_concepts|What is ' || n || '?' FROM s WHERE doc_id % 5 <> 0 AND NOT listed AND doc_id % 4 = 0
""",
    "M9_J16_references": sql("""
, rk AS (SELECT id AS session_id, row_number() OVER (ORDER BY id <> 'src0', starts_at DESC, title, id) AS n FROM sessions),
a AS (SELECT doc_id, 'doc' || doc_id AS id, lang, text, n, lower('Notes ' || (doc_id // 3) || '.txt') AS name, ['ready', 'pending', 'processing', 'failed', 'ready'][doc_id % 5 + 1] AS status FROM documents JOIN rk ON rk.session_id = source),
f AS (SELECT *, min(n) OVER (PARTITION BY name) AS first FROM a),
h AS (SELECT name, max(doc_id) AS head FROM f WHERE n = first GROUP BY name),
fh AS (SELECT f.*, head, 'doc' || head AS head_id FROM f JOIN h USING (name)),
s AS (SELECT name, ['failed', 'pending', 'processing', 'ready'][max(list_position(['failed', 'pending', 'processing', 'ready'], status))] AS status FROM fh WHERE doc_id = head OR n > first GROUP BY name),
went AS (SELECT *, CASE WHEN n > first THEN head_id ELSE id END AS to_id FROM fh),
dg AS (SELECT to_id, min_by(doc_id, (n, doc_id)) AS doc_id, max_by(lang, (n, doc_id)) AS title, max_by(md5(text), (n, doc_id)) AS text FROM went GROUP BY to_id),
g AS (SELECT g.*, n, lower(trim(term)) AS norm FROM glossary g JOIN rk USING (session_id)),
gk AS (SELECT *, first_value(id) OVER (PARTITION BY norm ORDER BY n, order_index, id) AS kept FROM g)
SELECT 'uploaded_assets' AS name, id, CASE WHEN doc_id = head THEN s.status ELSE fh.status END AS refers FROM fh JOIN s USING (name) WHERE n = first
UNION ALL SELECT 'evidence_units', u.id, w.to_id FROM units u JOIN went w ON w.id = regexp_extract(u.id, '(doc[0-9]+)_', 1)
UNION ALL SELECT 'asset_digests', 'd' || doc_id, to_id || ' ' || text FROM dg
UNION ALL SELECT 'asset_digests', 'all', md5(string_agg(title || chr(10) || text, chr(10) || chr(10) ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0'))) FROM dg
UNION ALL SELECT 'bookmarks', 'm' || min_by(id, (n, -order_index, id)), kept FROM gk GROUP BY kept
UNION ALL SELECT 'questions', q.question_id, c.kept || '_concepts' FROM asked q JOIN rk USING (session_id), (SELECT min_by(session_id, n) AS kept FROM rk WHERE session_id IN (SELECT session_id FROM glossary)) c
""", "sessions", "glossary", "units", "asked"),
    "R10_ST5_living_index": sql("SELECT question_id, id, round(rank, 6) AS rank, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank DESC, id) AS place FROM bm_now) WHERE place <= 18", "bm_now"),
    "R9_R10_J2_bm25": sql("SELECT question_id, id, round(rank, 6) AS rank FROM bm", "bm"),
    "C1_D15_categorize": sql(f"SELECT question_id, session_id || '_' || key AS category_id FROM (SELECT question_id, session_id, key, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN {CATEGORY} THEN 0 ELSE 1 END, n) AS r FROM asked, (VALUES ('exam_prep', 0), ('applications', 1), ('logistics', 2), ('concepts', 3)) AS c(key, n)) WHERE r = 1", "asked"),
    "C2_C3_A5_A8_support": sql("SELECT question_id, round(strongest, 6) AS strongest, round(average, 6) AS average, focused, kinds, supported, CASE WHEN supported THEN 'grounded evidence found' ELSE 'not enough grounded evidence' END AS reason FROM supported", "supported"),
    "C4_definitions": sql("SELECT question_id, definition FROM defined", "defined"),
    "C7_extract": sql("SELECT question_id, generated FROM said", "said"),
    "P1_P6_lookup": sql("SELECT id, title FROM materials WHERE order_index IN (SELECT item_id FROM benchmark)", "materials"),
    "P2_P5_P8_filters": sql("SELECT asset_id, name AS file_name FROM assets WHERE status = 'ready' AND doc_id % 3 <> 0", "assets"),
    "P11_D13_known_sources": "SELECT l_orderkey AS order_id, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_sources FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE NOT l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)) = 0",
    "O1_Q11_sessions": sql("SELECT id, title, starts_at, status, row_number() OVER (ORDER BY starts_at DESC, title, id) AS rank FROM sessions", "sessions"),
    "O2_O3_J1_chunks": sql("SELECT c.session_id, c.id, row_number() OVER (PARTITION BY c.session_id ORDER BY m.order_index, c.order_index, c.id) AS rank FROM chunks c JOIN materials m ON c.material_id = m.id", "chunks", "materials"),
    "O10_P9_sources": sql("SELECT id, answer_id, rank FROM ranked_sources", "ranked_sources"),
    "A1_A2_counts": sql(
        "SELECT s.id AS session_id, coalesce(m.n, 0) AS materials, coalesce(c.n, 0) AS chunks, coalesce(g.n, 0) AS terms, coalesce(t.n, 0) AS entries, coalesce(q.n, 0) AS questions, coalesce(q.a, 0) AS answers FROM sessions s "
        + " ".join(f"LEFT JOIN (SELECT session_id, count(*) AS n FROM {v} GROUP BY session_id) {a} ON {a}.session_id = s.id" for a, v in (("m", "materials"), ("c", "chunks"), ("g", "glossary"), ("t", "transcript")))
        + " LEFT JOIN (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS a FROM qa GROUP BY source) q ON q.source = s.id", "sessions", "materials", "chunks", "glossary", "transcript", "qa",
    ),
    "A3_A4_Q9_indexing": sql("SELECT session_id, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status IN ('pending', 'processing')) AS processing, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS assets, bool_or(status IN ('pending', 'processing')) AS in_flight FROM assets GROUP BY session_id", "assets"),
    "A10_median": "SELECT l_suppkey, CAST(floor(median(CAST(l_extendedprice AS DOUBLE)) + 0.5) AS BIGINT) AS median FROM lineitem GROUP BY l_suppkey",
    "A14_U3_ordered_union": "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) GROUP BY user_id",
    "A17_status_lattice": sql("SELECT session_id, status FROM (SELECT session_id, status, row_number() OVER (PARTITION BY session_id ORDER BY CASE status WHEN 'failed' THEN 1 WHEN 'pending' THEN 2 WHEN 'processing' THEN 3 ELSE 4 END DESC, doc_id DESC) AS n FROM assets) WHERE n = 1", "assets"),
    "W5_latest_entries": sql("SELECT session_id, id, n AS from_end FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY order_index DESC, started_at_seconds DESC, id DESC) AS n FROM transcript) WHERE n <= 4", "transcript"),
    "Q1_J3_J5_J6_feed": sql("SELECT 'q' || CAST(q.doc_id AS VARCHAR) AS id, q.source AS session_id, 'Language ' || q.lang AS category, CASE WHEN q.quality = 1 THEN q.text END AS answer, coalesce(s.types, '') AS sources, row_number() OVER (PARTITION BY q.source ORDER BY lpad(CAST(q.doc_id AS VARCHAR), 12, '0') DESC) AS rank FROM qa q LEFT JOIN (SELECT answer_id, string_agg(source_type, ',' ORDER BY rank) AS types FROM ranked_sources GROUP BY answer_id) s ON s.answer_id = 'a' || CAST(q.doc_id AS VARCHAR) WHERE q.toxic = 0", "qa", "ranked_sources"),
    "Q2_J4_history": sql("SELECT 'q' || CAST(q.doc_id AS VARCHAR) AS id, q.source AS session_id, round((q.doc_id % 100) / 100.0, 2) AS confidence_score, q.doc_id % 3 + 1 AS n_sources, row_number() OVER (PARTITION BY q.source ORDER BY lpad(CAST(q.doc_id AS VARCHAR), 12, '0') DESC) AS rank FROM qa q WHERE q.doc_id % 2 = 1 AND q.quality = 1", "qa"),
    "Q5_J7_notes": sql("""SELECT CAST(e.event_id AS VARCHAR) AS id, CAST(e.user_id AS VARCHAR) AS session_id,
        coalesce(d.label, CASE e.event_id % 4 WHEN 0 THEN 'Session note' WHEN 1 THEN 'Lecture material' WHEN 2 THEN 'Material section' ELSE 'Glossary term' END) AS anchor_label,
        row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id % 3 = 0 DESC, lpad(CAST(e.event_id % 50 AS VARCHAR), 4, '0') DESC, e.event_id DESC) AS rank
      FROM events e LEFT JOIN dim d ON d.type = (['session', 'lecture_material', 'material_chunk', 'glossary_term'])[e.event_id % 4 + 1]
        AND d.id = CASE e.event_id % 4 WHEN 1 THEN 'doc' || CAST(e.event_id % 1500 AS VARCHAR) WHEN 2 THEN 'doc' || CAST(e.event_id % 1500 AS VARCHAR) || '_0' WHEN 3 THEN 'term' || CAST(e.event_id % 60 AS VARCHAR) END""", "dim"),
    "Q6_J8_source_detail": sql("SELECT s.id, d.label AS record_label, p.label AS parent_label, EXISTS (SELECT 1 FROM qa_sources b WHERE b.relevance_score > 5 AND b.session_id = s.session_id AND b.source_type = s.source_type AND b.source_record_id = s.source_record_id) AS bookmarked FROM qa_sources s JOIN dim d ON d.type = s.source_type AND d.id = s.source_record_id LEFT JOIN dim p ON p.type = 'lecture_material' AND p.id = d.parent_id", "qa_sources", "dim"),
    "M1_upsert": "SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'ordered', CAST(o_totalprice AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "M4_M5_cascade": sql("SELECT id, material_id FROM chunks WHERE material_id NOT IN (SELECT id FROM materials WHERE order_index % 5 = 0)", "chunks", "materials"),
    "M6_toggle": "SELECT CAST(user_id AS VARCHAR) AS session_id, 'event' AS target_type, event_type AS target_id, event_type AS label FROM events GROUP BY user_id, event_type HAVING (count(*) FILTER (WHERE event_id % 10 = 0) > 0) <> (count(*) % 2 = 1)",
    "M9_consolidate": sql("SELECT id, 'src0' AS session_id, term FROM (SELECT g.id, g.term, row_number() OVER (PARTITION BY lower(trim(g.term)) ORDER BY r.n, g.id) AS k FROM glossary g JOIN (SELECT id, row_number() OVER (ORDER BY id <> 'src0', starts_at DESC, title, id) AS n FROM sessions) r ON r.id = g.session_id) WHERE k = 1", "glossary", "sessions"),
    "U4_U5_J10_difference": "WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS session_id, n AS order_index FROM f UNION ALL SELECT o_orderkey, CAST(o.o_custkey AS VARCHAR), coalesce(l.next, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey % 1000, o_orderkey) - 1 FROM orders o LEFT JOIN (SELECT o_custkey, max(n) + 1 AS next FROM f GROUP BY o_custkey) l USING (o_custkey) WHERE o_orderstatus <> 'F'",
    "ST2_ST3_index_states": sql("SELECT asset_id, session_id, CASE WHEN trim(text) = '' THEN 'failed' ELSE 'ready' END AS status FROM assets", "assets"),
}
ORACLES["Q10_C5_C6_ask"] = sql(
    f"""SELECT question_id, ok AS supported, CASE WHEN ok THEN answer ELSE '{UNSUPPORTED}' END AS answer, CASE WHEN ok THEN confidence ELSE 0.0 END AS confidence, CASE WHEN ok THEN n ELSE 0 END AS n_sources FROM (
      SELECT s.question_id, s.supported AND t.n IS NOT NULL AND g.generated IS NOT NULL AS ok, array_to_string(list_slice(string_split(regexp_replace(trim(g.generated), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 6), ' ') AS answer, least(0.98, round(t.average / 2.5, 2)) AS confidence, t.n
      FROM supported s LEFT JOIN said g ON g.question_id = s.question_id LEFT JOIN (SELECT question_id, avg(score) AS average, count(*) AS n FROM merged WHERE rank <= 6 GROUP BY question_id) t ON t.question_id = s.question_id)""",
    "supported", "said", "merged",
)

FIVE = r"len(list_filter(string_split(regexp_replace({0}, '\s+', ' ', 'g'), ' '), lambda w: w <> ''))"
TERM = "string_split(text, '. ')[1]"
CLEAN = strip(rf"regexp_replace(regexp_replace(regexp_replace({TERM}, '^[-*]\s+', ''), '\s+', ' ', 'g'), '^[A-Z]\s+([A-Z][a-z])', '\1')")
METADATA_SQL = ", ".join(f"'{w}'" for w in METADATA)
KEEPS = r"(len(list_filter(string_split(regexp_replace({0}, '\s+', ' ', 'g'), ' '), lambda w: w <> '')) <= 7 AND {0} <> '' AND NOT regexp_matches({0}, '^[a-z]$') AND {0} NOT IN (" + METADATA_SQL + r") AND NOT regexp_matches({0}, '[.!?]') AND NOT contains({0}, 'glossary'))"
LONG_WORDS = r"list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2))"
ORACLES |= {
    "F23_F25_F26_F27_numbers": "SELECT l_orderkey, least(greatest(round(q / 40, 3), 0.0), 1.0) AS clamped, least(0.98, round(round(q / 10, 1) / 2.5, 2)) AS confidence, CASE WHEN floor(p) * 100000 > 0 THEN printf('%.2f GB', floor(p) * 100000 / 1073741824.0) END AS gigabytes FROM (SELECT l_orderkey, avg(CAST(l_quantity AS DOUBLE)) AS q, sum(CAST(l_extendedprice AS DOUBLE)) AS p FROM lineitem GROUP BY l_orderkey)",
    "F28_F29_F34_sentences": f"SELECT item_id, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN w[1] WHEN 2 THEN w[1] || ' and ' || w[2] ELSE w[1] || ', ' || w[2] || ', and ' || w[3] END AS spoken, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS sentence, {strip('''regexp_replace(t, '[.!?]+$', '')''')} AS bare, lower(substr(text, 1, 1)) || substr(text, 2) AS lowered, string_split(regexp_replace(t, '([.!?])" + r"\s+', '\1' || chr(1), 'g'), chr(1))[1] AS first FROM (SELECT item_id, text, " + f"{strip('text')} AS t, string_split(text, ' ') AS w FROM benchmark)",
    "F31_F33_F35_markup": r"""SELECT page_id, '{"id": ' || CAST(page_id AS VARCHAR) || '}' AS json, page_id % 2 = 0 AS refusal, CAST(len(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>')) AS BIGINT) AS runs, md5(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1(?:\s[^>]*)?>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&')) AS heading FROM pages""",
    "G1_G5_glossary_rules": sql(
        rf"SELECT id, c <> '' AND length(c) <= 96 AND {FIVE.format('c')} <= 10 AND regexp_matches(c, '[A-Za-z]') AND NOT regexp_matches(lower(c), '^(a|an|the)\s') AND NOT regexp_matches(c, '[.!?]$') AND NOT regexp_matches(c, '[.!?].+\s') AS is_term, length(d) >= 24 OR {FIVE.format('d')} >= 4 AS is_definition, "
        rf"t = '' OR d = '' OR t IN ({METADATA_SQL}) OR contains(t, 'glossary') OR starts_with(t, 'included ') OR regexp_matches(d, '^[0-9]+$') AS ignored, {KEEPS.format(norm(TERM))} AS keeps FROM (SELECT id, text, {collapse(TERM)} AS c, {collapse('text')} AS d, lower({CLEAN}) AS t FROM chunks)",
        "chunks",
    ),
    "A9_A11_arg_max": sql(
        f"SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first, norm) - 1 AS order_index, md5(definition) AS definition FROM (SELECT session_id, norm, min(n) OVER (PARTITION BY session_id, norm) AS first, definition, row_number() OVER (PARTITION BY session_id, norm ORDER BY length(definition) DESC, n) AS k FROM (SELECT session_id, order_index AS n, {norm('''string_split(text, ' ')[1]''')} AS norm, text AS definition FROM chunks WHERE {KEEPS.format(norm('''string_split(text, ' ')[1]'''))})) WHERE k = 1",
        "chunks",
    ),
    "R14_O18_lexical": sql(
        f"""SELECT question_id, id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY priority DESC, score DESC, order_index, lower(label), id) AS rank FROM (
          SELECT question_id, id, label, priority, order_index, round(plain + 0.25 * priority, 4) AS score FROM (
            SELECT *, round(0.7 * shared / len(q) + 0.3 * shared / len(c), 4) AS plain FROM (
              SELECT a.question_id, t.id, t.speaker_label AS label, t.order_index, CASE WHEN t.speaker_label = 'system' THEN 1.0 ELSE 0.0 END AS priority, a.q, t.c, len(list_filter(a.q, lambda w: list_contains(t.c, w))) AS shared
              FROM (SELECT question_id, session_id, {LONG_WORDS.format('question')} AS q FROM asked) a JOIN (SELECT *, {LONG_WORDS.format('text')} AS c FROM transcript) t ON a.session_id = t.session_id) WHERE len(q) > 0 AND len(c) > 0) WHERE plain > 0) WHERE score >= 0.08) WHERE rank <= 3""",
        "asked", "transcript",
    ),
    "Q4_Q12_J19_workspaces": sql(
        """SELECT s.id AS session_id, f.n AS n_files, m.n AS n_materials, a.ready, a.processing, a.failed, a.in_flight, CAST(m.n AS VARCHAR) || ' materials' AS subtitle,
          CASE WHEN a.assets = 0 THEN 'No uploads yet' WHEN a.ready = a.assets THEN CAST(a.assets AS VARCHAR) || ' sources indexed' ELSE CAST(a.ready AS VARCHAR) || ' of ' || CAST(a.assets AS VARCHAR) || ' sources indexed' END AS indexed_text
        FROM sessions s JOIN (SELECT session_id, count(*) AS n FROM materials GROUP BY session_id) m ON m.session_id = s.id
        JOIN (SELECT session_id, count(*) AS assets, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status IN ('pending', 'processing')) AS processing, count(*) FILTER (WHERE status = 'failed') AS failed, bool_or(status IN ('pending', 'processing')) AS in_flight FROM assets GROUP BY session_id) a ON a.session_id = s.id
        JOIN (SELECT session_id, count(DISTINCT name) AS n FROM (SELECT session_id, name FROM assets UNION ALL SELECT session_id, source_label FROM materials) GROUP BY session_id) f ON f.session_id = s.id""",
        "sessions", "materials", "assets",
    ),
    "B6_B11_A15_W6_digests": sql(
        f"SELECT session_id, asset_id, md5(string_agg(x, ' ' ORDER BY k)) AS text FROM (SELECT session_id, material_id AS asset_id, {collapse(excerpt('text', 240)).replace(excerpt('text', 240), '(' + excerpt('text', 240) + ')')} AS x, row_number() OVER (PARTITION BY material_id ORDER BY order_index, id) AS k FROM chunks) WHERE k <= 4 GROUP BY session_id, asset_id",
        "chunks",
    ),
}

DIGESTS = "SELECT asset_id, session_id, 'asset_summary' AS kind, name AS title, md5(text) AS text, lpad(asset_id, 12, '0') AS updated_at, status FROM assets"
ORACLES |= {
    "F32_answer_text": f"SELECT item_id, {collapse('text')} AS answer FROM benchmark",
    "F30_unit_payload": f"SELECT doc_id, title, md5(substr(c, 1, 240)) AS excerpt, md5(CASE WHEN c = '' THEN title ELSE c END) AS content_text, md5({strip("title || ' ' || c")}) AS search_text FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang ELSE source END AS title, {strip('text')} AS c FROM documents)",
    "M2_upsert_digest": sql(f"SELECT asset_id, session_id, kind, CASE WHEN status <> 'failed' THEN 'again' ELSE title END AS title, text, updated_at FROM ({DIGESTS})", "assets"),
    "M3_set_status": sql("SELECT asset_id AS id, CASE status WHEN 'processing' THEN 'ready' ELSE status END AS status, CASE WHEN status <> 'processing' THEN 'old' END AS error_message, CASE status WHEN 'processing' THEN '2' ELSE '1' END AS indexed_at, CASE status WHEN 'processing' THEN '2' ELSE lpad(asset_id, 12, '0') END AS updated_at FROM assets", "assets"),
    "M7_new_notes": f"SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS created_at, CASE WHEN turn % 2 = 0 THEN 'material_chunk' ELSE 'session' END AS anchor_type, md5(c) AS content, CASE WHEN c = '' THEN 'empty' WHEN turn % 2 = 0 AND turn % 4 <> 0 THEN 'no anchor' END AS reason FROM (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN {strip('text')} ELSE '' END AS c FROM conversations)",
    "M8_W3_append_materials": sql("SELECT m.id, m.session_id, CASE WHEN starts_with(m.source_label, 'slides') THEN m.order_index ELSE m.order_index + coalesce(n.n, 0) END AS order_index FROM materials m LEFT JOIN (SELECT session_id, max(order_index) + 1 AS n FROM materials WHERE starts_with(source_label, 'slides') GROUP BY session_id) n ON n.session_id = m.session_id", "materials"),
    "M8_J13_append_questions": "SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_type IN ('view', 'error') THEN 'old_' ELSE 'new_' END || CAST(user_id AS VARCHAR) || '_' || event_type AS category_id FROM events",
}


# --- texts packed into passages, blocks and summaries


def packed(parts: str, most: int, slack: int = 0) -> str:
    """The parts of a list that isn't empty, neighbours joined by a space up to `most` characters."""
    each = f"list_transform({parts}, lambda p: {{'done': CAST([] AS VARCHAR[]), 'now': p}})"
    step = f"lambda a, x: CASE WHEN length(a.now) + {1 + slack} + length(x.now) > {most} THEN {{'done': list_append(a.done, a.now), 'now': x.now}} ELSE {{'done': a.done, 'now': a.now || ' ' || x.now}} END"
    return f"list_transform([list_reduce({each}, {step})], lambda r: list_append(r.done, r.now))[1]"


def cleaned(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda c: {collapse('c')}), lambda c: c <> '')"


def cut_at(x: str, pattern: str, kept: str = "") -> str:
    return rf"string_split(regexp_replace({x}, '{pattern}', '{kept}' || chr(1), 'g'), chr(1))"


def sentences(x: str) -> str:
    return cleaned(cut_at(x, r"([.!?])\s+", r"\1"))


def spoken(x: str) -> str:
    return f"CASE len({x}) WHEN 0 THEN '' WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' and ' || {x}[2] ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', and ' || {x}[len({x})] END"


def sections(rows: str, key: str) -> str:
    """Sections of Markdown texts (key, text): key, section, heading, text."""
    return rf"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY section) - 1 AS order_index, heading, text FROM (
      SELECT {key}, section, coalesce(nullif(max(title), ''), 'Section') AS heading, coalesce({strip("string_agg(line, chr(10) ORDER BY n) FILTER (WHERE title IS NULL)")}, '') AS text FROM (
        SELECT *, count(title) OVER (PARTITION BY {key} ORDER BY n) AS section FROM (
          SELECT {key}, n, line, CASE WHEN regexp_matches(line, '^\s{{0,3}}#{{1,6}}\s+(.*)$') THEN {strip("regexp_extract(line, '^\\s{0,3}#{1,6}\\s+(.*)$', 1)")} END AS title FROM (
            SELECT {key}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ({rows}))))
      GROUP BY {key}, section) WHERE text <> ''"""


PASSAGES = f"""pl AS (SELECT key, {cleaned("string_split(text, chr(10))")} AS lines, {sentences("text")} AS told FROM whole),
pb AS (SELECT key, flatten(list_transform(CASE WHEN len(lines) >= 6 THEN lines ELSE told END, lambda l: CASE WHEN length(l) <= 420 THEN [l] ELSE {packed("CASE WHEN len(" + sentences("l") + ") > 1 THEN " + sentences("l") + " ELSE string_split(l, ' ') END", 420)} END)) AS parts FROM pl),
passages AS (SELECT key, {packed("parts", 900, 1)} AS ps FROM pb WHERE len(parts) > 0)"""
KEYWORDS = once(r"list_filter(string_split(regexp_replace(lower(heading), '\s+', ' ', 'g'), ' '), lambda w: w <> '')")
VIEWS["summary_rows"] = rf"""SELECT session_id, kind, CASE kind WHEN 'overview' THEN 'This session covers ' || {spoken("topics[1:4]")} || '. ' || array_to_string(told, ' ') WHEN 'key_points' THEN array_to_string(list_transform(told, lambda e: '- ' || e), chr(10)) ELSE 'Review ' || {spoken("topics[1:3]")} || '.' END AS text, place FROM (
  SELECT session_id, {once("list(topic ORDER BY n, k) FILTER (WHERE topic <> '')")} AS topics FROM (
    SELECT session_id, n, unnest([regexp_replace(heading, '[.!?]+$', ''), lang]) AS topic, unnest([1, 2]) AS k FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY order_index, id) AS n FROM chunks) WHERE n <= 8) GROUP BY session_id) t
  JOIN (SELECT session_id, list(CASE WHEN regexp_matches(e, '[.!?]$') THEN e ELSE e || '.' END ORDER BY part, n) AS told FROM (
    SELECT *, {excerpt("c", 140)} AS e, row_number() OVER (PARTITION BY session_id ORDER BY part, n) AS place FROM (
      SELECT session_id, 0 AS part, {collapse("text")} AS c, row_number() OVER (PARTITION BY session_id ORDER BY order_index, id) AS n FROM chunks QUALIFY n <= 3
      UNION ALL SELECT session_id, 1, {collapse("text")}, row_number() OVER (PARTITION BY session_id ORDER BY order_index, id) AS n FROM transcript QUALIFY n <= 2)) WHERE place <= 3 GROUP BY session_id) e USING (session_id),
  (VALUES ('overview', 0), ('key_points', 1), ('exam_focus', 2)) AS k(kind, place)"""
NEEDS["summary_rows"] = ["chunks", "transcript"]
_LIMITS = ", ".join(f"('{kind}', {n}, '{lead}', '{title}', {more}, {PROFILES['development'][kind][0]}, {PROFILES['development'][kind][1]})" for n, (kind, (lead, title, more)) in enumerate(TITLES.items(), 1))
_RULES = "".join(f" || chr(10) || '- {r.replace(chr(39), chr(39) * 2)}'" for r in ANSWER_RULES)
ORACLES |= {
    "T2_passages": f"WITH whole AS (SELECT doc_id AS key, text FROM documents), {PASSAGES} SELECT key AS doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS order_index, unnest(ps) AS text, 'Passage ' || generate_subscripts(ps, 1) AS heading FROM passages",
    "T3_T13_markdown": f"SELECT conv_id, CAST(order_index AS INTEGER) AS order_index, heading, md5(text) AS text, CASE WHEN contains(lower(heading), 'exam') THEN 'exam_focus' WHEN contains(lower(heading), 'key') THEN 'key_points' ELSE 'overview' END AS kind FROM ({sections("SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id", 'conv_id')})",
    "T4_material_chunks": sql(rf""", named AS (SELECT asset_id, name, {EXT} AS extension, {TITLE.format(strip(f"regexp_replace({BASE}, '[_-]+', ' ', 'g')"))} AS title, text, {cleaned(cut_at("text", "\\n\\s*\\n+"))} AS paragraphs FROM assets),
whole AS (SELECT asset_id AS key, text FROM named WHERE extension NOT IN ('md', 'pptx', 'png', 'mp4') AND len(paragraphs) <= 1), {PASSAGES},
every AS (SELECT asset_id, 0 AS order_index, title AS heading, CASE extension WHEN 'mp4' THEN 'Video' ELSE 'Image' END || ' source uploaded: ' || name AS text FROM named WHERE extension IN ('png', 'mp4')
  UNION ALL {sections("SELECT asset_id, text FROM named WHERE extension IN ('md', 'pptx')", "asset_id")}
  UNION ALL SELECT key, generate_subscripts(ps, 1) - 1, 'Passage ' || generate_subscripts(ps, 1), unnest(ps) FROM passages
  UNION ALL SELECT asset_id, generate_subscripts(paragraphs, 1) - 1, 'Passage ' || generate_subscripts(paragraphs, 1), unnest(paragraphs) FROM named WHERE extension NOT IN ('md', 'pptx', 'png', 'mp4') AND len(paragraphs) > 1)
SELECT asset_id, CAST(order_index AS INTEGER) AS order_index, heading, md5(text) AS text, array_to_string(list_slice({KEYWORDS}, 1, 6), ' ') AS keywords FROM every""", "assets"),
    "T18_T19_units": sql(rf""", parted AS (SELECT asset_id, session_id, name, {EXT} AS extension, {cleaned("string_split(text, chr(10))")} AS parts FROM assets),
u AS (SELECT * EXCLUDE (ps), generate_subscripts(ps, 1) - 1 AS n, unnest(ps) AS c FROM (SELECT asset_id, session_id, name, extension, {packed("parts", 900)} AS ps FROM parted WHERE len(parts) > 0))
SELECT sha256(asset_id || chr(31) || n) AS id, session_id, asset_id, 'upload' AS source_type, CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'pptx' THEN 'slide' ELSE 'text' END AS modality, name || ' | Passage ' || (n + 1) AS title, {excerpt("c", 240)} AS excerpt, md5(c) AS content_text,
  md5(lower(name || ' | Passage ' || (n + 1) || ' ' || c)) AS search_text, CAST(CASE WHEN extension = 'pptx' THEN n + 1 END AS INTEGER) AS slide_number, CAST(n AS INTEGER) AS order_index FROM u""", "assets"),
    "R11_R12_J17_evidence": sql("SELECT question_id, source_type, source_record_id, label, round(CASE WHEN position <= 6 THEN 20.0 - position ELSE score END, 6) AS score FROM e_match", "e_match"),
    "B7_prompt": sql(f"SELECT q.question_id, 'Evidence:' || chr(10) || coalesce(m.e, '') || chr(10) || 'Question: ' || q.question{_RULES} AS prompt FROM asked q LEFT JOIN (SELECT question_id, string_agg('[' || rank || '] ' || {excerpt('excerpt', 1000)}, chr(10) ORDER BY rank) AS e FROM merged WHERE rank <= 12 GROUP BY question_id) m ON m.question_id = q.question_id", "asked", "merged"),
    "B1_B5_context_blocks": sql(f""", limits AS (SELECT * FROM (VALUES {_LIMITS}) AS l(type, section, lead, title, boost, chars, most)),
cand AS (SELECT 'glossary_term' AS type, id, session_id, concat_ws(' ', term, definition) AS body FROM glossary UNION ALL SELECT 'material_chunk', id, session_id, concat_ws(' ', heading, text) FROM chunks
  UNION ALL SELECT 'transcript_entry', id, session_id, concat_ws(' ', speaker_label, text) FROM transcript UNION ALL SELECT 'evidence_unit', id, session_id, concat_ws(' ', title, search_text) FROM units),
told AS (SELECT *, {once(tokens("body"))} AS ct FROM cand JOIN records USING (type, id) JOIN limits USING (type)),
rest AS (SELECT q.question_id, t.*, {score("q.qt", "t.ct", "t.boost + " + boost("t.body"))} AS score, {holds("t.entry")} AS held FROM questions q JOIN told t ON t.session_id = q.session_id ANTI JOIN merged m ON m.question_id = q.question_id AND m.source_type = t.type AND m.source_record_id = t.id),
named AS (SELECT question_id, type, bool_or(held) AS about FROM rest GROUP BY ALL),
placed AS (SELECT *, sum(length(entry) + 1) OVER (PARTITION BY question_id, type ORDER BY score DESC, entry COLLATE en, id ROWS UNBOUNDED PRECEDING) - length(entry) AS before, row_number() OVER (PARTITION BY question_id, type ORDER BY score DESC, entry COLLATE en, id) AS n FROM rest),
lined AS (SELECT question_id, section, title || CASE WHEN about THEN ' (high relevance)' ELSE '' END AS head, chars, most, list(entry ORDER BY n) AS es FROM placed JOIN named USING (question_id, type) WHERE before < 2 * chars * most GROUP BY ALL),
blocks AS (SELECT question_id, section, list_slice(list_transform([list_reduce(list_transform(es, lambda e: {{'done': CAST([] AS VARCHAR[]), 'now': head || chr(10) || e, 'own': e}}),
  lambda a, x: CASE WHEN length(a.now) + length(x.own) + 2 > chars THEN {{'done': list_append(a.done, a.now), 'now': x.now, 'own': x.own}} ELSE {{'done': a.done, 'now': a.now || chr(10) || x.own, 'own': x.own}} END)], lambda r: list_append(r.done, r.now))[1], 1, most) AS bs FROM lined),
dig AS (SELECT source AS session_id, 'doc' || doc_id AS asset_id, 'Digest ' || doc_id AS title, {excerpt("text", 200)} AS text, doc_id FROM documents),
hit AS (SELECT DISTINCT question_id, regexp_extract(source_record_id, '^(doc[0-9]+)_', 1) AS asset_id FROM merged WHERE source_type = 'evidence_unit'),
picked AS (SELECT q.question_id, d.title, d.text, row_number() OVER (PARTITION BY q.question_id ORDER BY d.doc_id) - 1 AS n FROM questions q JOIN dig d ON d.session_id = q.session_id LEFT JOIN hit h ON h.question_id = q.question_id AND h.asset_id = d.asset_id WHERE h.asset_id IS NOT NULL OR {holds("d.title || ' ' || d.text")})
SELECT m.question_id, 0 AS section, CAST(rank - 1 AS INTEGER) AS order_index, lead || chr(10) || r.entry AS block FROM merged m JOIN records r ON r.type = m.source_type AND r.id = m.source_record_id JOIN limits l ON l.type = m.source_type WHERE rank <= {PROFILES["development"]["focused"]}
UNION ALL SELECT question_id, section, CAST(generate_subscripts(bs, 1) - 1 AS INTEGER), unnest(bs) FROM blocks
UNION ALL SELECT question_id, 5, CAST(n AS INTEGER), 'Asset digest' || chr(10) || '- ' || title || ': ' || text FROM picked WHERE n < 4
UNION ALL SELECT q.question_id, 6, 0, 'Session digest' || chr(10) || s.title FROM questions q JOIN sessions s ON s.id = q.session_id""", "merged", "records", "questions", "sessions", "glossary", "chunks", "transcript", "units"),
    "B8_B10_summaries": sql("SELECT session_id, kind, text FROM summary_rows", "summary_rows"),
    "Q3_overview": sql("SELECT s.id AS session_id, s.title, coalesce(m.n, 0) AS materials, coalesce(g.n, 0) AS terms, l.latest, r.summaries FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM materials GROUP BY session_id) m ON m.session_id = s.id LEFT JOIN (SELECT session_id, count(*) AS n FROM glossary GROUP BY session_id) g ON g.session_id = s.id LEFT JOIN (SELECT session_id, md5(string_agg(text, chr(10) ORDER BY order_index)) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY order_index DESC, started_at_seconds DESC, id DESC) AS n FROM transcript) WHERE n <= 4 GROUP BY session_id) l ON l.session_id = s.id LEFT JOIN (SELECT session_id, md5(string_agg(text, chr(10) ORDER BY place)) AS summaries FROM summary_rows GROUP BY session_id) r ON r.session_id = s.id", "sessions", "materials", "glossary", "transcript", "summary_rows"),
    "Q7_snapshot": sql("SELECT coalesce(m.session_id, c.session_id, g.session_id) AS session_id, lecture_materials, material_chunks, glossary_terms, bookmarks FROM (SELECT session_id, md5(string_agg(title, ',' ORDER BY order_index, title, id)) AS lecture_materials FROM materials GROUP BY session_id) m FULL JOIN (SELECT session_id, md5(string_agg(heading, ',' ORDER BY order_index, id)) AS material_chunks FROM chunks GROUP BY session_id) c ON c.session_id = m.session_id FULL JOIN (SELECT session_id, md5(string_agg(term, ',' ORDER BY order_index, term, id)) AS glossary_terms, md5(string_agg(term, ',' ORDER BY id DESC)) AS bookmarks FROM glossary GROUP BY session_id) g ON g.session_id = coalesce(m.session_id, c.session_id)", "materials", "chunks", "glossary"),
    "W2_W3_A13_append": sql(f""", w AS (SELECT id, session_id, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS term, lang, text, order_index FROM chunks),
one AS (SELECT session_id, {norm("term")} AS k, min_by(id, (order_index, id)) AS id, min_by(term, (order_index, id)) AS term, max_by(text, (length(text), -order_index)) AS definition, {once("list(lang ORDER BY order_index, id) FILTER (WHERE lang IS NOT NULL)")} AS aliases, min(order_index) AS seat FROM w GROUP BY ALL),
g AS (SELECT *, {norm("term")} AS k, CASE WHEN has_alias THEN [alias] ELSE [] END AS own FROM glossary),
l AS (SELECT session_id, max(order_index) + 1 AS next FROM g GROUP BY session_id),
j AS (SELECT g.session_id, g.id, g.term, g.definition, g.order_index, g.own, o.definition AS other, {once("list_concat(g.own, coalesce(o.aliases, []))")} AS joint FROM g LEFT JOIN one o ON o.session_id = g.session_id AND o.k = g.k)
SELECT session_id, id, term, md5(CASE WHEN coalesce(length(other) > length(definition), false) THEN other ELSE definition END) AS definition, array_to_string(joint, ',') AS aliases, order_index, CASE WHEN coalesce(length(other) > length(definition), false) OR len(joint) > len(own) THEN '2' ELSE '1' END AS updated_at FROM j
UNION ALL SELECT o.session_id, o.id, o.term, md5(o.definition), array_to_string(coalesce(o.aliases, []), ','), coalesce(l.next, 0) + row_number() OVER (PARTITION BY o.session_id ORDER BY o.seat, o.id) - 1, '2' FROM one o LEFT JOIN l ON l.session_id = o.session_id WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.session_id = o.session_id AND g.k = o.k)""", "chunks", "glossary"),
}


# --- files and packs of sessions, orders, keys


def _ordered(name: str, rows: str, order: str) -> str:
    return f"SELECT '{name}' AS name, session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS rank FROM ({rows})"


ORACLES |= {
    "S1_S2_T20_M10_packs": rf"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS n, 's' || doc_id AS session_id, coalesce(lang, 'none') AS lang, coalesce(nullif({strip("text")}, ''), 'none') AS body FROM documents WHERE doc_id % 5 <> 0)
SELECT 'lecture_sessions' AS name, session_id AS id, session_id, 'Course ' || n || '|1.0.0:p' || n || '.json|tag,' || lang AS told FROM d
UNION ALL SELECT 'lecture_materials', 'm' || n, session_id, md5({excerpt("body", 220)}) FROM d
UNION ALL SELECT 'material_chunks', 'c' || n, session_id, 'm' || n || '|' || md5(body) || '|' || lang FROM d
UNION ALL SELECT 'material_chunks', 'old' || doc_id, 's' || doc_id, 'old|' || md5('old') || '|' FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT 'glossary_terms', 'g' || n, session_id, 'Term ' || n || '|' || md5(body) || '|' || lang FROM d
UNION ALL SELECT 'transcript_entries', 't' || n, session_id, 'Dr. X|' || md5(body) FROM d
UNION ALL SELECT 'summaries', 'u' || n, session_id, 'overview|' || lang FROM d
UNION ALL SELECT 'qa_categories', 'k' || n, session_id, 'concepts' FROM d
UNION ALL SELECT 'questions', 'q' || n, session_id, CASE WHEN doc_id % 3 <> 0 THEN 'k' || n || '|' ELSE '' END || 'what is ' || n || '?' FROM d
UNION ALL SELECT 'answers', 'a' || n, session_id, 'q' || n || '|It is.' FROM d
UNION ALL SELECT 'answer_sources', 'a' || n || '_src_0', session_id, 'a' || n || '|g' || n || '|Glossary: Term ' || n || '|' || md5(md5(body)) FROM d
UNION ALL SELECT 'answer_sources', 'a' || n || '_src_1', session_id, 'a' || n || '|c' || n || CASE WHEN doc_id % 2 = 0 THEN '|Material: Part|' || md5(body) ELSE '|Indexed evidence|' || md5('Indexed lecture evidence') END FROM d""",
    "T14_public_qa": f"SELECT CAST(doc_id AS VARCHAR) AS asset_id, 0 AS order_index, 'public_question_what_is_' || doc_id || '_1' AS id, 'public_answer_what_is_' || doc_id || '_1' AS answer_id, 'What is ' || doc_id || '?' AS question, md5(t) AS answer, CASE WHEN doc_id % 2 = 0 THEN 'big_topic' ELSE 'general' END AS category, least(1.0, doc_id % 3 / 2.0 + 0.25) AS confidence_score, 1 AS n_sources FROM (SELECT doc_id, {strip('text')} AS t FROM documents) WHERE t <> ''",
    "T15_session_files": "SELECT CAST(doc_id AS VARCHAR) AS asset_id, 'Course ' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'ended' END AS status, CASE WHEN doc_id % 2 = 0 THEN lang END AS description, 'a,' || source AS tags FROM documents",
    "Q8_previews": sql(rf"""SELECT s.id, u.title AS record_label, 'file:/' || u.id AS preview_uri, concat_ws(' | ', u.modality, 'page ' || CASE WHEN s.o % 3 = 0 THEN s.o % 100 END, 'slide ' || CASE WHEN s.doc_id % 3 = 0 THEN s.doc_id END, CASE WHEN s.doc_id % 4 = 0 THEN 'frame' END) AS about,
  EXISTS (SELECT 1 FROM qa_sources b WHERE b.relevance_score > 5 AND b.session_id = s.session_id AND b.source_record_id = s.source_record_id) AS bookmarked
FROM (SELECT *, CAST(substr(answer_id, 2) AS BIGINT) AS doc_id, CAST(substr(answer_id, 2) AS BIGINT) * 10000 AS o FROM qa_sources) s JOIN units u ON u.id = s.source_record_id WHERE s.doc_id % 2 = 0""", "qa_sources", "units"),
    "O4_O14_orders": sql(" UNION ALL ".join([
        _ordered("glossary_terms", "SELECT * FROM glossary", "order_index, term, id"), _ordered("transcript_entries", "SELECT * FROM transcript", "order_index, started_at_seconds, id"), _ordered("summaries", "SELECT session_id, session_id || '_' || kind AS id, place FROM summary_rows", "place"),
        _ordered("qa_categories", "SELECT session_id, session_id || '_' || key AS id, n FROM (SELECT DISTINCT session_id FROM glossary), (VALUES ('exam_prep', 0), ('applications', 1), ('logistics', 2), ('concepts', 3)) AS c(key, n)", "n"),
        _ordered("questions", "SELECT source AS session_id, 'q' || doc_id AS id, doc_id FROM qa", "doc_id DESC"), _ordered("answers", "SELECT source AS session_id, 'a' || doc_id AS id, doc_id FROM qa WHERE quality = 1", "doc_id"),
        _ordered("notes", "SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS id, event_id FROM events", "event_id % 3 = 0 DESC, event_id % 50 DESC, event_id % 7 DESC, id DESC"),
        _ordered("bookmarks", "SELECT * FROM glossary", "order_index % 3 DESC, id"), _ordered("uploaded_assets", "SELECT session_id, asset_id AS id, status, name FROM assets", "status, name"), _ordered("evidence_units", "SELECT * FROM units", "modality, id"), _ordered("asset_digests", "SELECT session_id, asset_id AS id, status FROM assets", "status, id"),
    ]), "glossary", "transcript", "summary_rows", "qa", "assets", "units"),
    "P3_P4_keys": sql("SELECT 'question' AS name, 'q' || doc_id AS id, source AS session_id FROM qa WHERE toxic <> 1 AND doc_id % 2 = 1 UNION ALL SELECT 'bookmark', s.id, s.session_id FROM qa_sources s WHERE s.source_type = 'material_chunk' AND EXISTS (SELECT 1 FROM chunks c WHERE c.id = s.source_record_id AND c.session_id = s.session_id)", "qa", "qa_sources", "chunks"),
    "U5_put_first": "WITH e AS (SELECT user_id, event_type, min(event_id) AS at FROM events GROUP BY ALL), l AS (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id) SELECT e.user_id AS session_id, e.event_type AS key, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_type <> l.event_type, e.at) - 1 AS place FROM e JOIN l ON l.user_id = e.user_id",
}
