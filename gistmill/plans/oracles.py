"""For each query, standalone SQL over the same test tables with the same result.

Written for DuckDB and independently of the Spark side: ignore rules go through GLOB and a
cross product of path prefixes and rules, merges through joins of common table expressions.
"""

from __future__ import annotations

from gistmill import fixed_values as fv
from gistmill.plans.testbed import DIRECTORIES, EXTENSIONS, PART_BYTES, RUN_TIME


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


_BLANKS = _quoted(fv.WHITESPACE)
_WORD = _quoted("[^" + "".join(f"\\x{{{ord(c):X}}}" for c in fv.WHITESPACE) + "]+")
_CONTROL = _quoted("[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]")
_RUN = f"TIMESTAMP '{RUN_TIME:%Y-%m-%d %H:%M:%S}'"
_STAMP = "'%Y-%m-%d %H:%M:%S'"
_MB = 1024 * 1024
_LIMIT = 0.01

# Documents as files: key, content, size, checksum; then decoded text, tokens, binary flag.
_FILES = f"""
named AS (
  SELECT doc_id, text, lang, source, @CORPUS@ AS corpus_id,
    {_list(DIRECTORIES)}[doc_id % 6 + 1] || '/' || source || '/doc_' || doc_id
      || {_list(EXTENSIONS)}[(doc_id // 6) % 8 + 1] AS relative_path
  FROM documents),
varied AS (
  SELECT *,
    CASE WHEN doc_id % 13 = 0 THEN '## File: ' || relative_path || chr(10) || chr(10) || '  ' ELSE '' END
    || CASE WHEN doc_id % 10 = 0 THEN replace(text, '. ', '.' || chr(13))
            WHEN doc_id % 5 = 0 THEN replace(text, '. ', '.' || chr(13) || chr(10)) ELSE text END
    || CASE WHEN doc_id % 11 = 0 THEN chr(10) || '## Notes' || chr(10) || chr(10) || 'see doc ' || doc_id ELSE '' END
    || CASE WHEN doc_id % 7 <> 0 THEN '' WHEN (doc_id // 7) % 3 = 0 THEN chr(0)
            WHEN (doc_id // 7) % 3 = 1 THEN repeat(chr(1), length(text) // 5 + 1) ELSE chr(2) END AS body
  FROM named),
files AS (
  SELECT *, sha256(body) AS checksum, CAST(strlen(body) AS BIGINT) AS size,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS modified_time,
    replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS file_text
  FROM varied)"""

_READ = f"""
readings AS (
  SELECT *, len(regexp_extract_all(file_text, {_WORD})) + length(file_text) // 4 AS tokens,
    contains(file_text, chr(0))
      OR len(regexp_extract_all(file_text, {_CONTROL})) * 10 > length(file_text) AS is_binary
  FROM files)"""

_PAGES = """
page_files AS (
  SELECT 'pages' AS corpus_id, regexp_replace(url, '^[a-z]+://', '') || '/page_' || page_id || '.html' AS relative_path,
    CAST(strlen(html) AS BIGINT) AS size, TIMESTAMP '2024-03-01' AS modified_time, sha256(html) AS checksum
  FROM pages),
all_files AS (
  SELECT corpus_id, relative_path, size, modified_time, checksum FROM files
  UNION ALL SELECT corpus_id, relative_path, size, modified_time, checksum FROM page_files)"""

_STATE = """
entries AS (
  SELECT doc_id, corpus_id, relative_path, checksum, (doc_id // 48) % 4 AS kind,
    TIMESTAMP '2023-06-01' + to_hours(doc_id % 5000) AS summary_date, sha256('old ' || doc_id) AS other,
    'Earlier summary of doc ' || doc_id
      || CASE WHEN doc_id % 11 = 0 THEN chr(10) || '## Usage' || chr(10) || 'run it' ELSE '' END AS content
  FROM files),
state AS (
  SELECT corpus_id, relative_path, summary_date,
    CASE kind WHEN 1 THEN other WHEN 3 THEN checksum END AS checksum, content FROM entries WHERE kind <> 0
  UNION ALL
  SELECT corpus_id, 'gone/doc_' || doc_id, summary_date, other, content FROM entries WHERE doc_id % 10 = 0
  UNION ALL
  SELECT 'retired', 'old/doc_' || doc_id, summary_date, other, content FROM entries WHERE doc_id % 50 = 0)"""

_OWN_RULES = f"""
own_rules AS (
  SELECT DISTINCT corpus_id, pattern FROM (
    SELECT lang AS corpus_id, trim(CASE doc_id % 5 WHEN 0 THEN '  src/' || source || '/* ' WHEN 1 THEN '# comment'
      WHEN 2 THEN ' ' || chr(9) WHEN 3 THEN 'doc_?' || (doc_id % 7) || '.[jm]*' ELSE chr(9) || '*.rs ' END, {_BLANKS}) AS pattern
    FROM documents)
  WHERE pattern <> '' AND NOT starts_with(pattern, '#'))"""

_DEFAULTS = f"defaults AS (SELECT unnest({_list(fv.DEFAULT_IGNORE_RULES)}) AS pattern)"

_RULES = """
corpora AS (SELECT DISTINCT lang AS corpus_id FROM documents),
rules AS (
  SELECT corpus_id, pattern FROM corpora CROSS JOIN defaults UNION SELECT corpus_id, pattern FROM own_rules)"""


def _hit(path: str) -> str:
    """Whether the rule in ``pattern`` hits a path."""
    folder = "left(pattern, length(pattern) - 2)"
    return (
        f"CASE WHEN ends_with(pattern, '/*') THEN {path} GLOB {folder} OR starts_with({path}, {folder} || '/')"
        f" ELSE {path} GLOB pattern OR list_last(string_split({path}, '/')) GLOB pattern END"
    )


def _classes(source: str, rules: str) -> str:
    """Scan class of each path of ``source`` under rules with ``corpus_id`` or for all."""
    same = "AND r.corpus_id = p.corpus_id" if rules == "rules" else ""
    own_name = f"list_last(string_split(part, '/')) = {_quoted(fv.DIGEST_FILE)}"
    return f"""
parts AS (
  SELECT corpus_id, relative_path, len(string_split(relative_path, '/')) AS depth,
    unnest(range(1, len(string_split(relative_path, '/')) + 1)) AS k FROM {source}),
prefixes AS (
  SELECT corpus_id, relative_path, k = depth AS itself,
    array_to_string(string_split(relative_path, '/')[1:k], '/') AS part FROM parts),
hits AS (
  SELECT p.corpus_id, p.relative_path, bool_or(itself AND hit) AS self_hit, bool_or(NOT itself AND hit) AS above_hit
  FROM (SELECT p.*, {own_name} OR EXISTS (SELECT 1 FROM {rules} r WHERE {_hit('part')} {same}) AS hit FROM prefixes p) p
  GROUP BY ALL),
classes AS (
  SELECT corpus_id, relative_path,
    CASE WHEN above_hit THEN 'pruned' WHEN self_hit THEN 'ignored' ELSE 'kept' END AS scan_class FROM hits)"""


_KEPT = f"""{_DEFAULTS}, {_classes('files', 'defaults')},
kept AS (SELECT r.* FROM readings r JOIN classes USING (corpus_id, relative_path) WHERE scan_class = 'kept')"""

_STATUS = """
statuses AS (
  SELECT k.*, s.relative_path IS NOT NULL AS known, s.summary_date AS old_date, s.checksum AS old_checksum,
    s.content AS old_content,
    CASE WHEN s.relative_path IS NULL THEN 'new'
         WHEN s.checksum IS NOT NULL AND s.checksum <> k.checksum THEN 'outdated' ELSE 'up-to-date' END AS status
  FROM kept k LEFT JOIN state s USING (corpus_id, relative_path))"""


def _strip_header(content: str, path: str) -> str:
    return (
        f"CASE WHEN starts_with({content}, '## File: ' || {path}) AND contains({content}, chr(10))"
        f" THEN ltrim(substr({content}, instr({content}, chr(10)) + 1), {_BLANKS}) ELSE {content} END"
    )


def _size_message(size: str, limit: str) -> str:
    return f"'File size (' || printf('%.1f', {size} / {_MB}.0) || 'MB) exceeds limit ({limit}MB)'"


def _size_label(size: str) -> str:
    return (
        f"CASE WHEN {size} < 1024 THEN {size} || 'B' WHEN {size} < {_MB} THEN ({size} // 1024) || 'K'"
        f" ELSE ({size} // {_MB}) || 'M' END"
    )


def _entry(content: str = "content") -> str:
    return (
        "'## ' || relative_path || chr(10) || chr(10) || 'Summarized on ' || strftime(summary_date, "
        f"{_STAMP}) || CASE WHEN coalesce(checksum, '') <> '' THEN ' (checksum: ' || checksum || ')' ELSE '' END"
        f" || chr(10) || chr(10) || {_strip_header(content, 'relative_path')}"
    )


_ROUTE = (
    f"CASE WHEN is_binary THEN 'skip' WHEN size > {_LIMIT} * {_MB} THEN 'oversize'"
    f" WHEN tokens < {fv.TOKEN_THRESHOLD} THEN 'raw' ELSE 'summarise' END"
)


def _fresh(source: str, copy: bool = False, name: str = "fresh") -> str:
    """Entries written now for the rows of ``source``."""
    last = "file_text" if copy else f"CASE WHEN tokens < {fv.TOKEN_THRESHOLD} THEN file_text ELSE {_quoted(fv.MOCK_SUMMARY)} END"
    return f"""
{name} AS (
  SELECT corpus_id, relative_path, {_RUN} AS summary_date, checksum,
    CASE WHEN size > {_LIMIT} * {_MB} THEN {_size_message('size', str(_LIMIT))} ELSE {last} END AS content
  FROM {source} WHERE NOT is_binary)"""


_DATED = f"corpus_id, relative_path, strftime(summary_date, {_STAMP}) AS summary_date, checksum, content"


def _merge(due: str) -> str:
    """Digest of a run over ``statuses``; corpora without current files keep their entries."""
    return f"""
due AS (SELECT * FROM statuses WHERE {due}), {_fresh('due')},
digest AS (
  SELECT s.corpus_id, s.relative_path,
    CASE WHEN f.relative_path IS NOT NULL THEN f.summary_date ELSE s.old_date END AS summary_date,
    CASE WHEN f.relative_path IS NOT NULL THEN f.checksum ELSE s.old_checksum END AS checksum,
    CASE WHEN f.relative_path IS NOT NULL THEN f.content ELSE s.old_content END AS content
  FROM statuses s LEFT JOIN fresh f USING (corpus_id, relative_path)
  WHERE f.relative_path IS NOT NULL OR s.known
  UNION ALL
  SELECT * FROM state WHERE corpus_id NOT IN (SELECT corpus_id FROM kept))"""


_LINES = f"""
lines AS (
  SELECT corpus_id, '' AS relative_path, '# Project Summary' || chr(10) || chr(10) || 'Generated by gistmill on '
    || strftime({_RUN}, {_STAMP}) || chr(10) || chr(10) || 'Total files processed: ' || count(*) || chr(10) || chr(10)
    || '---' || chr(10) || chr(10) AS value
  FROM state GROUP BY corpus_id
  UNION ALL
  SELECT corpus_id, relative_path, e || CASE WHEN ends_with(e, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END
  FROM (SELECT corpus_id, relative_path, {_entry()} AS e FROM state)),
texts AS (SELECT corpus_id, string_agg(value, '' ORDER BY relative_path) AS document FROM lines GROUP BY corpus_id)"""

_ATTEMPTS = f"""
raw_attempts AS (
  SELECT *, 'c' || (conv_id % 4) AS corpus_id, 'conv_' || conv_id AS relative_path,
    CAST((turn + 1) // 2 AS INTEGER) AS attempt, (conv_id * 7 + turn * 3) % 11 AS kind
  FROM conversations WHERE role = 'assistant'),
attempts AS (
  SELECT *,
    CASE WHEN kind > 8 OR kind = 8 AND conv_id % 4 = 3 THEN trim(CASE WHEN conv_id % 3 = 0 THEN text ELSE text END, {_BLANKS}) END AS answer,
    CASE kind WHEN 0 THEN 'API error 500: busy' WHEN 1 THEN 'API error 429: slow down'
      WHEN 2 THEN 'API request timed out after 30.0s' WHEN 3 THEN 'Connection error: no route'
      WHEN 4 THEN 'API request failed: no route' WHEN 5 THEN 'Unexpected error: no route'
      WHEN 6 THEN '{fv.NO_CHOICES}' WHEN 7 THEN '{fv.NO_CHOICES}'
      WHEN 8 THEN CASE conv_id % 4 WHEN 2 THEN '{fv.NO_TEXT}' WHEN 3 THEN NULL ELSE '{fv.REQUEST_FAILED}{fv.NOT_JSON}' END END AS failure
  FROM raw_attempts)"""


_FOLDED = f"""
folded AS (
  SELECT corpus_id, relative_path,
    arg_min(answer, attempt) FILTER (WHERE answer IS NOT NULL) AS summary,
    CASE WHEN count(answer) = 0 THEN arg_max(failure, attempt) END AS error,
    coalesce(min(attempt) FILTER (WHERE answer IS NOT NULL), max(attempt)) AS attempts
  FROM attempts WHERE attempt <= {fv.RETRY_ATTEMPTS} GROUP BY corpus_id, relative_path)"""


# Fixed value: what an entry looks like, written out independently of the engine's own pattern.
# A digest text cut at its second-level headings; sections without an entry mark are, as in
# a single regular expression over the text, the beginning of the next entry's path.
_MARK = r"\n\nSummarized on (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?: \(checksum: ([a-f0-9]{64}|unreadable)\))?\n\n"
_IMPORT = f"""
sections AS (
  SELECT corpus_id, unnest(string_split(document, chr(10) || '## ')) AS part,
    unnest(range(1, len(string_split(document, chr(10) || '## ')) + 1)) AS place FROM texts),
marked AS (SELECT *, regexp_matches(part, {_quoted(_MARK)}) AS has_mark FROM sections WHERE place > 1),
grouped AS (
  SELECT *, count(*) FILTER (WHERE has_mark) OVER (
    PARTITION BY corpus_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM marked),
joined AS (
  SELECT corpus_id, g, string_agg(part, chr(10) || '## ' ORDER BY place) AS e FROM grouped
  GROUP BY corpus_id, g HAVING bool_or(has_mark)),
imported AS (
  SELECT corpus_id, g, regexp_extract(e, {_quoted('(?s)^(.+?)' + _MARK + '(.*)$')}, ['path', 'date', 'checksum', 'content']) AS f
  FROM joined),
numbered AS (
  SELECT corpus_id, f, row_number() OVER (PARTITION BY corpus_id, f.path ORDER BY g DESC) AS newest FROM imported)"""


def _with(*parts: str, corpus: str = "lang") -> str:
    return "WITH " + ", ".join(part.strip() for part in parts).replace("@CORPUS@", corpus) + "\n"


def oracle_sql() -> dict[str, str]:
    files = _with(_FILES)
    read = _with(_FILES, _READ)
    everything = _with(_FILES, _PAGES)
    state = _with(_FILES, _STATE)
    status = _with(_FILES, _READ, _STATE, _KEPT, _STATUS)
    fine = _with(_FILES, _READ, _STATE, _KEPT, _STATUS, corpus="lang || '/' || source")
    attempts = _with(_ATTEMPTS)
    due = "status IN ('new', 'outdated')"
    return {
        # sources and sinks
        "corpus_scan": everything + f"SELECT corpus_id, relative_path, size, strftime(modified_time, {_STAMP}) AS modified, checksum FROM all_files",
        "tree_listing": _with(_FILES, _DEFAULTS, _classes("files", "defaults"))
        + "SELECT corpus_id, relative_path, size, checksum FROM files JOIN classes USING (corpus_id, relative_path) WHERE scan_class <> 'pruned'",
        "store_listing": _with(_FILES, _DEFAULTS, _classes("files", "defaults"))
        + "SELECT corpus_id, relative_path, size, checksum FROM files JOIN classes USING (corpus_id, relative_path) WHERE scan_class <> 'pruned'",
        "ignore_rules": _with(_DEFAULTS, _OWN_RULES, _RULES) + "SELECT corpus_id, pattern FROM rules",
        "digest_lines": _with(_FILES, _STATE, _LINES) + "SELECT corpus_id, relative_path, value FROM lines",
        "digest_import": _with(_FILES, _STATE, _LINES, _IMPORT) + f"""
SELECT corpus_id, f.path AS relative_path, f.date AS summary_date, nullif(f.checksum, '') AS checksum,
  trim(f.content, {_BLANKS}) AS content FROM numbered WHERE newest = 1""",
        "digest_files": _with(_FILES, _STATE, _LINES, _IMPORT) + f"""
SELECT corpus_id, f.path AS relative_path, f.date AS summary_date, nullif(f.checksum, '') AS checksum,
  trim(f.content, {_BLANKS}) AS content FROM numbered WHERE newest = 1""",
        # filters
        "ignore_match": _with(_FILES, _PAGES, _DEFAULTS) + f"""
SELECT corpus_id, relative_path, EXISTS (SELECT 1 FROM defaults WHERE {_hit('relative_path')}) AS ignored FROM all_files""",
        "ignore_match_by_corpus": _with(_FILES, _OWN_RULES) + f"""
SELECT corpus_id, relative_path FROM files f
WHERE EXISTS (SELECT 1 FROM own_rules r WHERE r.corpus_id = f.corpus_id AND {_hit('relative_path')})""",
        "scan_class": _with(_FILES, _PAGES, _DEFAULTS, _classes("all_files", "defaults"))
        + "SELECT corpus_id, relative_path, scan_class FROM classes",
        "scan_class_by_corpus": _with(_FILES, _DEFAULTS, _OWN_RULES, _RULES, _classes("files", "rules"))
        + "SELECT corpus_id, relative_path, scan_class FROM classes",
        "own_output": _with(_FILES, _READ, _KEPT) + "SELECT corpus_id, relative_path FROM kept WHERE NOT ends_with(relative_path, '/doc_0.py')",
        "text_only": read + "SELECT corpus_id, relative_path, length(file_text) AS characters FROM readings WHERE NOT is_binary",
        "oversize": everything + f"SELECT corpus_id, relative_path, size FROM all_files WHERE size > {_LIMIT} * {_MB}",
        "needs_update": status + f"SELECT corpus_id, relative_path, status FROM statuses WHERE {due}",
        "needs_update_strict": status + "SELECT corpus_id, relative_path, checksum FROM statuses WHERE NOT known OR old_checksum IS NULL OR old_checksum <> checksum",
        "below_threshold": read + f"SELECT corpus_id, relative_path FROM readings WHERE tokens < {fv.TOKEN_THRESHOLD}",
        "drop_failed": """
SELECT 'c' || (conv_id % 4) AS corpus_id, 'conv_' || conv_id || '/' || turn AS relative_path, text AS summary
FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 4 <> 0""",
        # projections
        "checksum": files + "SELECT corpus_id, relative_path, checksum FROM files",
        "decode_text": """
WITH bytes AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0
UNION ALL
SELECT doc_id, chr(255) || chr(254) || ' ' || array_to_string(list_transform(range(0, length(h) // 2),
  lambda i: chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER))), '') FROM bytes""",
        "size_label": everything + f"""
SELECT corpus_id, relative_path, {_size_label('size')} AS as_is, {_size_label('(size % 1100)')} AS small,
  {_size_label('(size * 1024)')} AS large FROM all_files""",
        "modified_label": files + "SELECT corpus_id, relative_path, strftime(modified_time, '%m-%d %H:%M') AS modified FROM files",
        "normalise_newlines": files + "SELECT corpus_id, relative_path, file_text AS text FROM files",
        "token_estimate": read + "SELECT corpus_id, relative_path, CAST(tokens AS BIGINT) AS tokens FROM readings",
        "route": status + f"""
SELECT corpus_id, relative_path, {_ROUTE} AS route,
  CASE {_ROUTE} WHEN 'raw' THEN file_text WHEN 'oversize' THEN {_size_message('size', str(_LIMIT))} END AS payload FROM kept""",
        "oversize_message": everything + f"""
SELECT corpus_id, relative_path, {_size_message('(size * 1021)', '10.0')} AS message,
  {_size_message('(size * 262144)', '0.5')} AS tie_message FROM all_files""",
        "chat_request": files + f"""
SELECT corpus_id, relative_path, 'some-model' AS model, {_quoted(fv.SYSTEM_PROMPT)} AS instruction, 'user' AS role,
  'Path: ' || relative_path || chr(10) || '----- text of the file -----' || chr(10) || file_text || chr(10)
    || '----- end of the file -----' AS question,
  CAST({fv.TEMPERATURE} AS DOUBLE) AS temperature, {fv.MAX_ANSWER_TOKENS} AS max_tokens FROM files""",
        "chat_response": attempts + "SELECT corpus_id, relative_path, attempt, answer FROM attempts",
        "error_class": attempts + "SELECT corpus_id, relative_path, attempt, failure AS error FROM attempts",
        "strip_header": files + f"SELECT corpus_id, relative_path, {_strip_header('file_text', 'relative_path')} AS content FROM files",
        "entry_format": state + f"SELECT corpus_id, relative_path, {_entry()} AS entry FROM state",
        "entry_path": state + """
SELECT corpus_id, relative_path FROM state
UNION ALL
SELECT 'c' || (conv_id % 4), trim(substr(string_split(text, chr(10))[1], 4)) FROM conversations
WHERE role = 'assistant' AND (conv_id + turn) % 4 <> 0 AND starts_with(text, '## ')""",
        # joins and merges
        "file_status": status + "SELECT corpus_id, relative_path, status FROM statuses",
        "new_files": status + "SELECT corpus_id, relative_path FROM kept ANTI JOIN state USING (corpus_id, relative_path)",
        "stale_entries": status + "SELECT corpus_id, relative_path FROM state ANTI JOIN kept USING (corpus_id, relative_path)",
        "digest_merge": _with(_FILES, _READ, _STATE, _KEPT, _fresh("kept")) + f"""
SELECT {_DATED} FROM (
  SELECT * FROM fresh
  UNION ALL
  SELECT s.* FROM state s SEMI JOIN kept USING (corpus_id, relative_path) ANTI JOIN fresh USING (corpus_id, relative_path))""",
        "digest_upsert": _with(_FILES, _READ, _STATE, _KEPT, _fresh("kept")) + f"""
SELECT {_DATED} FROM (
  SELECT * FROM fresh UNION ALL SELECT s.* FROM state s ANTI JOIN fresh USING (corpus_id, relative_path))""",
        # counts and lists
        "status_counts": status + """
SELECT corpus_id, count(*) FILTER (WHERE status = 'up-to-date') AS up_to_date,
  count(*) FILTER (WHERE status = 'outdated') AS outdated, count(*) FILTER (WHERE status = 'new') AS "new"
FROM statuses GROUP BY corpus_id""",
        "scan_counts": _with(_FILES, _DEFAULTS, _OWN_RULES, _RULES, _classes("files", "defaults")) + """
SELECT corpus_id, count(*) FILTER (WHERE scan_class = 'kept') AS kept,
  count(*) FILTER (WHERE scan_class = 'ignored') AS ignored, any_value(n) AS patterns
FROM classes JOIN (SELECT corpus_id, count(DISTINCT pattern) AS n FROM rules GROUP BY corpus_id) USING (corpus_id)
GROUP BY corpus_id""",
        "outcome_counts": _with(_ATTEMPTS, _FOLDED) + """
SELECT corpus_id, count(summary) AS completed, count(f.relative_path) - count(summary) AS error,
  count(*) - count(f.relative_path) AS pending
FROM (SELECT DISTINCT 'c' || (conv_id % 4) AS corpus_id, 'conv_' || conv_id AS relative_path FROM conversations)
LEFT JOIN folded f USING (corpus_id, relative_path) GROUP BY corpus_id""",
        "completion_stats": status + f"""
SELECT corpus_id, count(*) FILTER (WHERE {due} AND NOT is_binary) AS processed,
  count(*) FILTER (WHERE status = 'up-to-date') AS up_to_date FROM statuses GROUP BY corpus_id""",
        "digest_document": _with(_FILES, _STATE, _LINES) + f"""
, placed AS (
  SELECT *, sum(strlen(value)) OVER (PARTITION BY corpus_id ORDER BY relative_path) - strlen(value) AS begins FROM lines),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY corpus_id ORDER BY begins // {PART_BYTES}) - 1 AS part FROM placed)
SELECT corpus_id, CAST(part AS INTEGER) AS part, string_agg(value, '' ORDER BY relative_path) AS document
FROM numbered GROUP BY corpus_id, part""",
        "attention_list": fine + f"""
, numbered AS (
  SELECT *, {due} AS is_due, count(*) OVER c AS n, count(*) FILTER (WHERE {due}) OVER c AS n_due,
    count(*) FILTER (WHERE {due}) OVER (PARTITION BY corpus_id ORDER BY relative_path) AS place
  FROM statuses WINDOW c AS (PARTITION BY corpus_id))
SELECT corpus_id, relative_path, status, n AS files, n_due AS due,
  CASE WHEN n <= {fv.SMALL_CORPUS_FILES} THEN 0 ELSE greatest(n_due - {fv.ATTENTION_ROWS}, 0) END AS more
FROM numbered WHERE n <= {fv.SMALL_CORPUS_FILES} OR (is_due AND place <= {fv.ATTENTION_ROWS})""",
        "run_plan": fine + f"""
, due AS (SELECT *, count(*) OVER (PARTITION BY corpus_id) AS to_process FROM statuses WHERE {due})
SELECT corpus_id, relative_path, status, to_process FROM due WHERE to_process <= {fv.SHORT_PLAN_ROWS}
UNION ALL
SELECT DISTINCT corpus_id, NULL, NULL, to_process FROM due WHERE to_process > {fv.SHORT_PLAN_ROWS}""",
        # summaries
        "mock_digest": _with(_FILES, _READ, _KEPT, _fresh("kept")) + f"SELECT {_DATED} FROM fresh",
        "copy_digest": _with(_FILES, _READ, _KEPT, _fresh("kept", copy=True)) + f"SELECT {_DATED} FROM fresh",
        "retry_outcome": _with(_ATTEMPTS, _FOLDED) + "SELECT corpus_id, relative_path, summary, error, attempts FROM folded",
        "model_answers": _with(_FILES, _READ, _KEPT) + f"""
SELECT corpus_id, relative_path, CASE WHEN doc_id % 4 <> 1 THEN '- **Role**: ' || relative_path END AS summary,
  CASE WHEN doc_id % 4 = 1 THEN 'API error 503: busy' END AS error,
  CAST([1, 3, 3, 2][doc_id % 4 + 1] AS INTEGER) AS attempts
FROM kept WHERE {_ROUTE} = 'summarise'""",
        # jobs
        "status_report": _with(_FILES, _READ, _STATE, _DEFAULTS, _OWN_RULES, _RULES, _classes("files", "rules"),
                               "kept AS (SELECT r.*, scan_class FROM readings r JOIN classes USING (corpus_id, relative_path) WHERE scan_class <> 'pruned')",
                               _STATUS) + """
SELECT corpus_id, count(*) FILTER (WHERE scan_class = 'kept' AND status = 'up-to-date') AS up_to_date,
  count(*) FILTER (WHERE scan_class = 'kept' AND status = 'outdated') AS outdated,
  count(*) FILTER (WHERE scan_class = 'kept' AND status = 'new') AS "new",
  count(*) FILTER (WHERE scan_class = 'ignored') AS ignored, any_value(n) AS patterns
FROM statuses JOIN (SELECT corpus_id, count(DISTINCT pattern) AS n FROM rules GROUP BY corpus_id) USING (corpus_id)
GROUP BY corpus_id""",
        "status_attention": status + f"""
, numbered AS (
  SELECT *, {due} AS is_due, count(*) OVER c AS n, count(*) FILTER (WHERE {due}) OVER c AS n_due,
    count(*) FILTER (WHERE {due}) OVER (PARTITION BY corpus_id ORDER BY relative_path) AS place
  FROM statuses WINDOW c AS (PARTITION BY corpus_id))
SELECT corpus_id, relative_path, {_size_label('size')} AS size, strftime(modified_time, '%m-%d %H:%M') AS modified, status,
  n AS files, n_due AS due,
  CASE WHEN n <= {fv.SMALL_CORPUS_FILES} THEN 0 ELSE greatest(n_due - {fv.ATTENTION_ROWS}, 0) END AS more
FROM numbered WHERE n <= {fv.SMALL_CORPUS_FILES} OR (is_due AND place <= {fv.ATTENTION_ROWS})""",
        "status_together": _with(_FILES, _READ, _STATE, _DEFAULTS, _OWN_RULES, _RULES, _classes("files", "rules"),
                                 "kept AS (SELECT r.*, scan_class FROM readings r JOIN classes USING (corpus_id, relative_path) WHERE scan_class <> 'pruned')",
                                 _STATUS) + f"""
, marked AS (SELECT *, scan_class = 'kept' AS k, scan_class = 'kept' AND {due} AS is_due FROM statuses),
numbered AS (
  SELECT *, count(*) FILTER (WHERE k) OVER c AS n, count(*) FILTER (WHERE is_due) OVER c AS n_due,
    count(*) FILTER (WHERE is_due) OVER (PARTITION BY corpus_id ORDER BY relative_path) AS place
  FROM marked WINDOW c AS (PARTITION BY corpus_id))
SELECT corpus_id, count(*) FILTER (WHERE k AND status = 'up-to-date') AS up_to_date,
  count(*) FILTER (WHERE k AND status = 'outdated') AS outdated, count(*) FILTER (WHERE k AND status = 'new') AS "new",
  count(*) FILTER (WHERE NOT k) AS ignored, any_value(n) AS files, any_value(n_due) AS due,
  CASE WHEN any_value(n) <= {fv.SMALL_CORPUS_FILES} THEN 0 ELSE greatest(any_value(n_due) - {fv.ATTENTION_ROWS}, 0) END AS more,
  coalesce(string_agg(relative_path || '|' || {_size_label('size')} || '|' || strftime(modified_time, '%m-%d %H:%M') || '|' || status, chr(10)
    ORDER BY relative_path) FILTER (WHERE k AND (n <= {fv.SMALL_CORPUS_FILES} OR (is_due AND place <= {fv.ATTENTION_ROWS}))), '') AS listed,
  any_value(p) AS patterns
FROM numbered JOIN (SELECT corpus_id, count(DISTINCT pattern) AS p FROM rules GROUP BY corpus_id) USING (corpus_id)
GROUP BY corpus_id""",
        "stored_update": _with(_FILES, _READ, _STATE, _KEPT, _STATUS, _merge(due)) + f"SELECT {_DATED} FROM digest",
        "stored_run_log": status + f"""
SELECT corpus_id, relative_path, status, CASE WHEN {due} THEN {_ROUTE} END AS route,
  CASE WHEN {due} THEN CASE WHEN is_binary THEN 'error' ELSE 'completed' END END AS outcome FROM statuses
UNION ALL
SELECT corpus_id, relative_path, NULL, NULL, NULL FROM state WHERE corpus_id NOT IN (SELECT corpus_id FROM kept)""",
        "update_digest": _with(_FILES, _READ, _STATE, _KEPT, _STATUS, _merge(due)) + f"SELECT {_DATED} FROM digest",
        "rebuild_digest": _with(_FILES, _READ, _STATE, _KEPT, _STATUS, _merge("true")) + f"SELECT {_DATED} FROM digest",
        "process_files_update": _with(_FILES, _READ, _STATE, _KEPT, _STATUS,
                                      "strict AS (SELECT * FROM statuses WHERE NOT known OR old_checksum IS NULL OR old_checksum <> checksum)",
                                      _fresh("strict")) + f"SELECT corpus_id, relative_path, {_entry()} AS entry FROM fresh",
    }
