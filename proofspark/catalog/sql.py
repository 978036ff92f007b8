"""Shared pieces of the comparison SQL."""

from proofspark import constants as K
from proofspark.plans.fixtures import RULE_ROWS

DOCS = """
docs AS (
  SELECT doc_id, doc_id % 150 AS user_id, concat(source, '_', doc_id, '.txt') AS original_name,
         ['txt','docx','pdf'][doc_id % 3 + 1] AS document_format,
         ['general','academic','financial'][doc_id % 3 + 1] AS analysis_profile,
         replace(translate(text, '.,', '。，'), chr(10), chr(10) || chr(10)) AS text
  FROM documents)"""

LONG_DOCS = DOCS.replace("chr(10) || chr(10)", "''")

PARAS = """
pieces AS (
  SELECT doc_id, string_split_regex(text, '\\n\\n+') AS p, regexp_extract_all(text, '\\n\\n+') AS s FROM docs WHERE length(text) > 0),
piece_rows AS (
  SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(list_transform(p, lambda x: length(x))) AS n,
         unnest(list_transform(range(1, len(p) + 1), lambda j: coalesce(length(s[j]), 0))) AS gap FROM pieces),
placed AS (
  SELECT doc_id, i, n, coalesce(sum(n + gap) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
  FROM piece_rows),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pno, s, s + n AS e, n > 4000 AS long FROM placed WHERE n > 0)"""

CHUNKS = PARAS + """,
pack AS (
  SELECT doc_id, pno, CASE WHEN NOT long THEN s END AS st, e AS en, s AS core, s AS ps, e AS pe,
         NULL::BIGINT AS c_s, NULL::BIGINT AS c_e, NULL::BIGINT AS c_core FROM paras WHERE pno = 1
  UNION ALL
  SELECT p.doc_id, p.pno,
         CASE WHEN p.long THEN NULL WHEN a.st IS NULL THEN p.s
              WHEN p.e - a.st > 3000 THEN CASE WHEN a.pe - a.ps <= 500 AND p.e - a.ps <= 4000 THEN a.ps ELSE p.s END
              ELSE a.st END,
         p.e, CASE WHEN a.st IS NOT NULL AND NOT p.long AND p.e - a.st <= 3000 THEN a.core ELSE p.s END, p.s, p.e,
         CASE WHEN p.long OR p.e - a.st > 3000 THEN a.st END,
         CASE WHEN p.long OR p.e - a.st > 3000 THEN a.en END,
         CASE WHEN p.long OR p.e - a.st > 3000 THEN a.core END
  FROM pack a JOIN paras p ON p.doc_id = a.doc_id AND p.pno = a.pno + 1),
cut_at AS (
  SELECT p.doc_id, p.pno, p.e AS pe, p.s AS pos, p.s AS core,
         CASE WHEN p.s + 4000 >= p.e THEN p.e ELSE p.s + coalesce(nullif(3500 + length(regexp_extract(substring(d.text, p.s + 3501, 500), '(?s)^.*[。！？!?；;]')), 3500), 4000) END AS en
  FROM paras p JOIN docs d USING (doc_id) WHERE p.long
  UNION ALL
  SELECT c.doc_id, c.pno, c.pe, c.en - 500, c.en - 250,
         CASE WHEN c.en - 500 + 4000 >= c.pe THEN c.pe ELSE c.en - 500 + coalesce(nullif(3500 + length(regexp_extract(substring(d.text, c.en - 500 + 3501, 500), '(?s)^.*[。！？!?；;]')), 3500), 4000) END
  FROM cut_at c JOIN docs d USING (doc_id) WHERE c.en < c.pe),
ranges AS (
  SELECT doc_id, c_s AS s, c_e AS e, c_core AS cs, c_e AS ce FROM pack WHERE c_s IS NOT NULL
  UNION ALL
  SELECT doc_id, st, en, core, en FROM (SELECT *, max(pno) OVER (PARTITION BY doc_id) AS last FROM pack) WHERE pno = last AND st IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, en, core, CASE WHEN en < pe THEN en - 250 ELSE en END FROM cut_at),
chunks AS (
  SELECT doc_id, analysis_profile, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS chunk_index,
         s::BIGINT AS source_start, e::BIGINT AS source_end, cs::BIGINT AS core_start, ce::BIGINT AS core_end, ctext AS text
  FROM (SELECT r.*, d.analysis_profile, substring(d.text, r.s + 1, r.e - r.s) AS ctext FROM ranges r JOIN docs d USING (doc_id))
  WHERE regexp_matches(ctext, '\\S'))"""


def _text(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


RULES = "rules(rule_no, needle, category, subtype, suggestion, confidence) AS (VALUES " + ", ".join(
    f"({no}, {_text(n)}, {_text(c)}, {_text(sub)}, {_text(sug)}, {conf})" for no, n, c, sub, sug, conf in RULE_ROWS) + ")"

OCCURRENCES = """
occ AS (
  SELECT doc_id, chunk_index, rule_no, needle, text, instr(text, needle) AS pos FROM chunks, rules WHERE contains(text, needle)
  UNION ALL
  SELECT doc_id, chunk_index, rule_no, needle, text, pos + instr(substring(text, pos + 1), needle) FROM occ
  WHERE contains(substring(text, pos + 1), needle)),
framed AS (
  SELECT doc_id, chunk_index, rule_no, needle, text, pos - 1 AS pos, substring(text, greatest(pos - 12, 1), pos - greatest(pos - 12, 1)) AS before,
         substring(text, pos + length(needle), 12) AS after,
         count(*) OVER (PARTITION BY doc_id, chunk_index, rule_no) AS n,
         (row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY rule_no, pos) - 1)::BIGINT AS candidate_index FROM occ),
rivals AS (
  SELECT a.doc_id, a.chunk_index, a.candidate_index, count(*) AS fits
  FROM framed a JOIN framed b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND a.rule_no = b.rule_no
   AND (a.pos = b.pos OR (ends_with(substring(b.text, 1, b.pos), a.before) AND starts_with(substring(b.text, b.pos + length(b.needle) + 1), a.after)))
  GROUP BY ALL),
resolved AS (
  SELECT f.doc_id, c.analysis_profile, f.chunk_index, f.candidate_index, f.rule_no, f.needle AS quote, f.text, f.pos,
         c.source_start + f.pos AS char_start, c.source_start + f.pos + length(f.needle) AS char_end
  FROM framed f JOIN rivals r USING (doc_id, chunk_index, candidate_index) JOIN chunks c USING (doc_id, chunk_index)
  WHERE (f.n = 1 OR r.fits = 1)
    AND c.source_start + f.pos + length(f.needle) // 2 >= c.core_start AND c.source_start + f.pos + length(f.needle) // 2 < c.core_end)"""

def _re2(pattern: str) -> str:
    """A pattern of the constants in the dialect of the SQL engine; the texts hold ASCII digits and white space only, so its
    classes agree with the Unicode-aware ones."""
    for java, other in (("(?Uiu)", "(?i)"), ("(?U)", ""), ("(?iu:", "(?i:"), (r"\p{IsHan}", r"\p{Han}"), (r"[\s\S]", "(?s:.)"),
                        ("(?<![0-9A-Za-z_])", r"\b"), ("(?![0-9A-Za-z_])", r"\b"), ("'", "''")):
        pattern = pattern.replace(java, other)
    return pattern


def _spans(pattern: str, where: str) -> str:
    return f"""
  SELECT doc_id, chunk_index, pos + coalesce(gap, 0) AS s, pos + coalesce(gap, 0) + hit AS e FROM (
    SELECT doc_id, chunk_index, gap, hit, coalesce(sum(gap + hit) OVER (PARTITION BY doc_id, chunk_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (
      SELECT doc_id, chunk_index, unnest(range(1, len(hits) + 1)) AS i, unnest(list_transform(hits, lambda h: length(h))) AS hit,
             unnest(list_transform(gaps[1:len(hits)], lambda g: length(g))) AS gap FROM (
        SELECT doc_id, chunk_index, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM chunks WHERE {where})))"""


_BASE, _ACADEMIC, _FINANCIAL = (_re2(p) for p in (K.BASE_PATTERN, K.ACADEMIC_PATTERN, K.FINANCIAL_PATTERN))
SPANS = ("\nspans AS (" + _spans(_BASE, "true") + "\n  UNION ALL" + _spans(_ACADEMIC, "analysis_profile = 'academic'")
         + "\n  UNION ALL" + _spans(_FINANCIAL, "analysis_profile = 'financial'") + ")")

#: Protected spans of whole texts by scene, NULL for all scenes; ``chunks`` has a row a text.
SCENE_SPANS = f"""
marks AS MATERIALIZED (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id ORDER BY s) AS i FROM ({_spans(r"(?s)\\.|\$\$|\$", "contains(text, '$')")}) t
  JOIN chunks c USING (doc_id) WHERE substring(c.text, (s + 1)::BIGINT, 1) = '$'),
pairs AS (SELECT a.doc_id, a.i, a.s, b.e, a.e - a.s AS w, b.e - b.s AS v, substring(c.text, (a.e + 1)::BIGINT, (b.s - a.e)::BIGINT) AS inner_text, substring(c.text, (b.e + 1)::BIGINT, 1) AS behind
  FROM marks a JOIN marks b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN chunks c ON c.doc_id = a.doc_id),
closing AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM pairs WHERE w = v AND regexp_matches(inner_text, '\\S') AND (w = 2 OR (
    regexp_matches(inner_text, '^\\S') AND regexp_matches(inner_text, '\\S$') AND NOT regexp_matches(inner_text, '{K.INLINE_MATH_STOPS}')
    AND NOT regexp_matches(inner_text, '{_re2(K.AMOUNT_THEN_PROSE_PATTERN)}') AND NOT regexp_matches(behind, '[0-9０-９]')))),
-- a formula that closed does not open the next one
formulas AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS nth FROM closing) WHERE nth % 2 = 1),
scene_spans AS MATERIALIZED (SELECT doc_id, NULL AS scene, s, e FROM ({_spans(_BASE, "true")}) UNION ALL SELECT doc_id, NULL, s, e FROM formulas
  UNION ALL SELECT doc_id, 'academic', s, e FROM ({_spans(_ACADEMIC, "true")}) UNION ALL SELECT doc_id, 'financial', s, e FROM ({_spans(_FINANCIAL, "true")}))"""

ISSUES = SPANS + """,
flagged AS (
  SELECT r.*, u.category, u.subtype, u.suggestion, u.confidence AS candidate_confidence, EXISTS (
    SELECT 1 FROM spans s WHERE s.doc_id = r.doc_id AND s.chunk_index = r.chunk_index AND CASE WHEN u.category = 'grammar'
      THEN s.s <= r.pos AND s.e >= r.pos + length(r.quote) ELSE s.s < r.pos + length(r.quote) AND s.e > r.pos END) AS protected,
    40 + (r.doc_id * 31 + r.char_start * 17 + r.rule_no * 7) % 61 AS conf, (r.doc_id + r.rule_no) % 11 = 0 AS flips
  FROM resolved r JOIN rules u USING (rule_no)),
judged AS (
  SELECT doc_id, chunk_index, candidate_index, char_start, char_end, quote, suggestion, conf AS confidence,
         CASE WHEN flips THEN 'typo' ELSE category END AS new_category, CASE WHEN NOT flips THEN subtype END AS new_subtype,
         CASE WHEN candidate_confidence >= 80 AND conf >= 80 AND NOT (flips AND category <> 'typo') AND NOT protected
               AND category <> 'paragraph' AND coalesce(subtype, '') NOT IN ('ambiguity','illogical','word_misuse')
              THEN 'confirmed' ELSE 'suspected' END AS level
  FROM flagged WHERE conf >= 50),
members AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, new_category, new_subtype, suggestion ORDER BY char_start, char_end, confidence DESC, chunk_index, candidate_index) AS i,
         hash(doc_id, new_category, coalesce(new_subtype, ''), suggestion) AS k FROM judged),
fold AS (
  SELECT k, i, [{'s': char_start, 'e': char_end, 'c': confidence, 'ci': chunk_index, 'ki': candidate_index}] AS acc FROM members WHERE i = 1
  UNION ALL
  SELECT k, i, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(acc, x)
                    WHEN x.c > acc[hit].c THEN list_concat(list_append(acc[1:hit - 1], x), acc[hit + 1:]) ELSE acc END
  FROM (SELECT m.k, m.i, f.acc, {'s': m.char_start, 'e': m.char_end, 'c': m.confidence, 'ci': m.chunk_index, 'ki': m.candidate_index} AS x,
               list_position(list_transform(f.acc, lambda a: a.s < m.char_end AND m.char_start < a.e), true) AS hit
        FROM fold f JOIN members m ON m.k = f.k AND m.i = f.i + 1)),
kept AS (
  SELECT k, unnest(acc) AS x FROM (SELECT *, max(i) OVER (PARTITION BY k) AS last FROM fold) WHERE i = last),
issues AS (
  SELECT m.doc_id, m.chunk_index, m.candidate_index, m.new_category AS category, m.new_subtype AS grammar_subtype, m.level,
         m.char_start, m.char_end, m.quote AS original_text, m.suggestion, m.confidence
  FROM members m JOIN kept ON kept.k = m.k AND kept.x.ci = m.chunk_index AND kept.x.ki = m.candidate_index)"""


def with_recursive(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def with_plain(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
DOCUMENTS = "(SELECT max(doc_id) + 1 FROM documents)"
TERMINAL = "('completed','failed','cancelled','expired')"
RUNNING = "('extracting','analyzing','verifying','merging','rendering')"

LINE_ISSUES = f"""
li AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY ALL),
iss AS (SELECT doc_id || '-' || n AS issue_id, doc_id, n, pk, sk, qty, doc_id % 150 AS user_id, {_list(K.CATEGORIES)}[pk % 4 + 1] AS category,
  CASE WHEN pk % 4 = 2 THEN {_list(K.GRAMMAR_SUBTYPES)}[sk % 10 + 1] END AS grammar_subtype, CASE WHEN qty >= 25 THEN 'confirmed' ELSE 'suspected' END AS level,
  (n * 37 + pk) % 500 AS char_start, (n * 37 + pk) % 500 + 1 + sk % 20 AS char_end, least(qty * 2, 100) AS confidence,
  CASE WHEN (doc_id + n) % 2 = 0 THEN {_list(K.FEEDBACK_VERDICTS)}[pk % 3 + 1] END AS feedback FROM li)"""

JOBS = f"""
jobs0 AS (SELECT o_orderkey AS k, o_custkey, {_list(K.STATUSES)}[o_orderkey % 11 + 1] AS status, {AS_OF} - to_minutes(o_orderkey * 7 % 400) AS created_at FROM orders),
jobs AS (SELECT k AS job_id, o_custkey % 150 AS user_id, k % {DOCUMENTS} AS document_id, {_list(K.PROFILES)}[k % 3 + 1] AS analysis_profile, status, status AS stage, k % 101 AS progress,
  k % 9 AS completed_chunks, CASE WHEN status <> 'queued' THEN 'w' || (k % 10) END AS worker_id, CASE WHEN status <> 'queued' THEN {AS_OF} + to_minutes(k % 5 - 2) END AS lease_until,
  created_at, CASE WHEN status <> 'queued' THEN created_at + to_minutes(5) END AS started_at, CASE WHEN status IN {TERMINAL} THEN created_at + to_minutes(k % 90 + 6) END AS completed_at,
  created_at + to_minutes(120) AS timeout_at, CASE WHEN k % 13 = 0 THEN 'WORKER_LEASE_EXPIRED' END AS error_code, CASE WHEN status = 'completed' THEN k END AS report_id FROM jobs0)"""

REPORTS = f"""
reports AS (SELECT o_orderkey AS report_id, o_orderkey AS job_id, o_custkey % 150 AS user_id, o_orderdate AS created_at, o_orderdate + to_days(180) AS expires_at
  FROM orders WHERE {_list(K.STATUSES)}[o_orderkey % 11 + 1] = 'completed')"""

STORED = DOCS + f""",
stored AS (SELECT doc_id, user_id, original_name, document_format, text, CASE WHEN doc_id % 4 <> 0 THEN 'f/' || doc_id END AS storage_path,
  CASE WHEN doc_id % 6 <> 0 THEN {AS_OF} + to_hours(24 - doc_id % 72) END AS input_expires_at FROM docs)"""

STORED_CHUNKS = """
stored_chunks AS (SELECT o_orderkey AS job_id, c AS chunk_index, 'text ' || o_orderkey AS content, CASE WHEN o_orderkey % 3 <> 0 THEN '{}' END AS candidate_output,
  CASE WHEN o_orderkey % 3 <> 0 THEN '[]' END AS verifier_output, CASE WHEN (o_orderkey + c) % 4 = 0 THEN 'completed' ELSE 'pending' END AS status FROM orders, range(0, 2) t(c))"""

USAGE = """
usage AS (SELECT l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'candidate' WHEN 'N' THEN 'verification' ELSE 'repair' END AS pass,
  ['openai_compatible','openai_responses','anthropic'][l_partkey % 3 + 1] AS provider_kind, 'm' || (l_suppkey % 4) AS model,
  CASE WHEN l_linenumber % 5 <> 0 THEN (l_quantity * 10)::INT END AS prompt_tokens, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity::INT END AS completion_tokens,
  floor(l_extendedprice)::BIGINT AS duration_ms, 1 + l_linenumber % 3 AS attempt, l_linestatus = 'F' AS success FROM lineitem)"""

ATTEMPTS = """
attempts AS (SELECT event_id AS attempt_id, 'User' || user_id AS username, (user_id % 40)::VARCHAR AS ip, event_type <> 'error' AS success, ts AS attempted_at FROM events)"""

STATUS_EVENTS = """
status_events AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'analyzing' WHEN 'view' THEN 'verifying'
  WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, event_id % 3 AS progress FROM events)"""
