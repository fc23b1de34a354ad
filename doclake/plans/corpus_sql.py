"""The derived catalog's rules as SQL common table expressions, for the oracles."""

from __future__ import annotations


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def key(x: str) -> str:
    """alnum_key: folded letters and digits, the sharp s written out."""
    return rf"regexp_replace(replace(strip_accents(lower({x})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def pick(names: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][({index}) % {len(names)} + 1]"


CORPUS = r"""
d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source, coalesce(n_chars, 0) AS n_chars,
         sha256(coalesce(text, '')) AS artifact_id FROM documents),
root AS (
  SELECT source AS root_id, 'root ' || source AS label, CASE WHEN n % 7 = 3 THEN 'unavailable' ELSE 'online' END AS status,
         n % 2 = 0 AS allow_organize, n % 5 = 4 AS never_scanned
  FROM (SELECT DISTINCT source, coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) AS n FROM d)),
location AS (
  SELECT 'loc-' || doc_id AS location_id, source AS root_id,
         lang || '/' || source || '/doc_' || doc_id || '.' || ['pdf', 'txt', 'PDF', 'docx', 'csv', 'bin'][doc_id % 6 + 1] AS relative_path,
         lower(lang || '/' || source || '/doc_' || doc_id || '.' || ['pdf', 'txt', 'PDF', 'docx', 'csv', 'bin'][doc_id % 6 + 1]) AS path_key,
         artifact_id, n_chars AS size,
         CASE WHEN doc_id % 13 = 5 THEN 'missing' WHEN doc_id % 17 = 3 THEN 'inaccessible' ELSE 'active' END AS state,
         doc_id % 19 = 7 AS ended, CASE WHEN doc_id % 19 = 7 THEN CASE WHEN doc_id % 2 = 1 THEN 'replaced' ELSE 'moved' END END AS end_reason,
         CASE WHEN doc_id % 19 = 7 AND doc_id % 38 <> 26 THEN 'loc-' || (doc_id + 1) END AS successor_location_id,
         doc_id + (doc_id * 7) % 50 AS last_seen, doc_id AS seq FROM d),
artifact AS (
  SELECT artifact_id, no, size, CASE WHEN no % 6 < 4 THEN 'pdf' WHEN no % 6 = 4 THEN 'text' ELSE 'image' END AS content_kind
  FROM (SELECT artifact_id, min(doc_id) AS no, max(n_chars) AS size FROM d GROUP BY artifact_id)),
document_artifact AS (
  SELECT 'doc-' || owner AS document_id, artifact_id, owner AS no, no = owner AND no % 31 <> 9 AS canonical
  FROM (SELECT *, no - CASE WHEN no % 10 = 9 THEN 1 ELSE 0 END AS owner FROM artifact)),
document AS (
  SELECT document_id, no, no % 23 = 11 OR before IS NOT NULL AS retired,
         coalesce(before, CASE WHEN no % 23 = 11 AND no % 46 <> 11 THEN 'doc-' || (no - 1) END) AS merged_into
  FROM (SELECT DISTINCT document_id, no FROM document_artifact)
  LEFT JOIN (SELECT document_id, lag(document_id) OVER (ORDER BY no) AS before FROM (SELECT DISTINCT document_id, no FROM document_artifact) WHERE no BETWEEN 120 AND 170)
  USING (document_id)),
live AS (SELECT document_id, no FROM document WHERE NOT retired),
page AS (
  SELECT artifact_id, no, no * 4294967296 + pdf_page AS page_id, pdf_page, text, length(trim(text)) AS chars
  FROM (SELECT a.artifact_id, no, unnest(string_split(d.text, chr(10))) AS text,
               generate_subscripts(string_split(d.text, chr(10)), 1) AS pdf_page FROM d JOIN artifact a ON d.doc_id = a.no)),
extraction AS (
  SELECT artifact_id, no, count(*) + CASE WHEN no % 47 = 8 THEN 1 ELSE 0 END AS page_count, sum(chars) AS chars,
         CASE WHEN no % 41 = 7 THEN 'failed' WHEN no % 37 = 5 THEN 'partial' ELSE 'ok' END AS status,
         CASE WHEN no % 9 = 4 THEN 'imported' ELSE 'native' END AS source, CASE WHEN no % 11 = 2 THEN 'old' ELSE 'current' END AS profile_id
  FROM page WHERE no % 43 <> 6 GROUP BY artifact_id, no),
titled AS (
  SELECT document_id, no, trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '')) AS title, lang, source
  FROM document JOIN d ON doc_id = no),
looked_at AS (SELECT * FROM titled WHERE no % 37 <> 1),
metadata_value AS (
  SELECT document_id, no, field, value, CASE WHEN no % 2 = 0 THEN 'provider' ELSE 'pdf_info' END AS source, no % 16 = 3 AS locked,
         CASE WHEN no % 4 = 1 THEN 'user' ELSE 'rule:safe' END AS accepted_by,
         CASE WHEN no % 5 = 2 THEN md5('cand-' || no || '-0') END AS source_candidate_id
  FROM (
    SELECT document_id, no, 'title' AS field, title AS value FROM looked_at WHERE no % 7 <> 0 AND title <> ''
    UNION ALL SELECT document_id, no, 'year', (1990 + no % 35)::VARCHAR FROM looked_at WHERE no % 8 <> 0
    UNION ALL SELECT document_id, no, 'doi', '10.5555/doc.' || (no % 300) FROM looked_at WHERE no % 3 <> 0
    UNION ALL SELECT document_id, no, 'type', CASE no % 12 WHEN 0 THEN 'book' WHEN 1 THEN 'book-chapter' WHEN 2 THEN 'posted-content'
                                              ELSE 'journal-article' END FROM looked_at WHERE no % 5 <> 0
    UNION ALL SELECT document_id, no, 'container', 'Journal of ' || source FROM looked_at WHERE no % 4 <> 0
    UNION ALL SELECT document_id, no, 'authors', '[{"family":"Fam' || (no % 50) || '","given":"G"},{"name":"Team ' || lang || '"}]'
              FROM looked_at WHERE no % 6 <> 0)),
metadata_candidate AS (
  SELECT *, md5('cand-' || no || '-' || k) AS candidate_id, left(sha256(field || chr(31) || value || chr(31) || source), 20) AS evidence_key,
         CASE WHEN k = 2 THEN CASE no % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'ambiguous' ELSE 'foreign' END ELSE 'own' END AS classification,
         ['exact', 'high', 'medium', 'low', 'ambiguous'][(no + k) % 5 + 1] AS confidence,
         CASE WHEN (no + k) % 3 = 0 THEN 'safe' ELSE 'required' END AS review,
         ['accepted', 'rejected', 'stale', 'set_aside', 'proposed', 'proposed', 'proposed'][(no + k * 2) % 7 + 1] AS status,
         ((no * 3 + k) % 10)::BIGINT AS priority,
         CASE WHEN k = 2 AND no % 4 = 2 THEN '{"shared_by_documents":' || (no % 7) || '}' ELSE '{}' END AS evidence
  FROM (
    SELECT document_id, no, k, ['title', 'title', 'doi', 'year'][k + 1] AS field, ['pdf_layout', 'pdf_info', 'pdf_text_doi', 'provider'][k + 1] AS source,
           CASE k WHEN 0 THEN title
                  WHEN 1 THEN CASE no % 4 WHEN 0 THEN title || ' .' WHEN 1 THEN 'Other title number ' || no ELSE title END
                  WHEN 2 THEN '10.5555/doc.' || (no % 100)
                  ELSE (1990 + no % 35 + CASE WHEN no % 9 = 0 THEN 1 ELSE 0 END)::VARCHAR END AS value
    FROM looked_at, range(4) r(k) WHERE title <> '')),
document_tag AS (
  SELECT document_id, lower(trim(regexp_replace(tag, '\s+', ' ', 'g'))) AS tag_key, min(tag) AS tag
  FROM (SELECT document_id, unnest([CASE WHEN quality = 1 THEN 'Good  Text' END, CASE WHEN toxic = 1 THEN 'Toxic' END,
                                    CASE WHEN doc_id % 5 = 0 THEN 'good text' END]) AS tag
        FROM labels JOIN document ON no = doc_id) WHERE tag IS NOT NULL GROUP BY 1, 2),
collection AS (SELECT DISTINCT 'col-' || lang AS collection_id, 'Texts in ' || lang AS name, lang = 'es' AS retired FROM d),
collection_member AS (SELECT 'col-' || lang AS collection_id, document_id FROM titled WHERE no % 3 = 1),
document_relation AS (
  SELECT 'rel-' || s.no AS relation_id, s.document_id AS source_id, t.document_id AS target_id,
         ['part_of', 'supplement_of', 'version_of', 'related_to'][s.no % 4 + 1] AS kind, s.no % 29 = 3 AS retracted
  FROM document s JOIN document t ON t.document_id = 'doc-' || (s.no // 2) WHERE s.no > 1
  UNION ALL SELECT 'chain-' || no, document_id, before, 'part_of', false
  FROM (SELECT *, lag(document_id) OVER (ORDER BY no) AS before FROM document WHERE no BETWEEN 0 AND 100) WHERE before IS NOT NULL
  UNION ALL SELECT 'ring-' || no, document_id, after, 'supplement_of', false
  FROM (SELECT *, coalesce(lead(document_id) OVER (ORDER BY no), (SELECT arg_min(document_id, no) FROM document WHERE no BETWEEN 100 AND 119)) AS after
        FROM document WHERE no BETWEEN 100 AND 119)),
candidate_source AS (
  SELECT candidate_id, document_id, CASE WHEN no % 53 = 7 THEN sha256('gone-' || no) ELSE artifact_id END AS artifact_id FROM metadata_candidate JOIN artifact USING (no)),
run AS (
  SELECT 'run-' || root_id || '-' || i AS run_id, root_id, i * 100 + n AS started,
         CASE WHEN (i + n) % 5 = 3 THEN 'running' WHEN (i + n) % 7 = 2 THEN 'interrupted' ELSE 'completed' END AS status
  FROM (SELECT root_id, coalesce(TRY_CAST(regexp_extract(root_id, '([0-9]+)$', 1) AS BIGINT), 0) AS n FROM root), range(3) r(i)),
relation_candidate AS (
  SELECT 'rc-' || no AS candidate_id, CASE WHEN no % 10 = 0 THEN 'group' ELSE 'document' END AS level,
         CASE no % 4 WHEN 0 THEN 'same_document' WHEN 1 THEN 'version_of' ELSE 'related_to' END AS kind,
         document_id AS source_id, 'doc-' || (no + 1) AS target_id,
         ['exact', 'high', 'medium', 'low', 'ambiguous'][no % 5 + 1] AS confidence,
         CASE no % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' ELSE 'stale' END AS status,
         ['doc-' || no, 'doc-' || (no + 1), 'doc-' || (no + 2)] AS members
  FROM document)
"""


WALK = """walk(start, node, depth) USING KEY (start, node) AS (
  SELECT DISTINCT source_id, target_id, 1 FROM document_relation WHERE kind = '{kind}' AND NOT retracted
  UNION SELECT w.start, e.target_id, w.depth + 1 FROM walk w JOIN document_relation e ON e.source_id = w.node AND e.kind = '{kind}' AND NOT e.retracted
        LEFT JOIN recurring.walk r ON r.start = w.start AND r.node = e.target_id WHERE r.start IS NULL AND w.node <> w.start)"""
CHAIN = """chain(document_id, survivor, depth) AS (
  SELECT document_id, merged_into, 1 FROM document WHERE merged_into IS NOT NULL
  UNION SELECT c.document_id, m.merged_into, depth + 1 FROM chain c JOIN document m ON m.document_id = c.survivor
        WHERE m.merged_into IS NOT NULL AND depth <= (SELECT count(*) FROM document))"""


def sql(query: str, *more: str) -> str:
    """``query`` over the catalog's tables, with further table expressions in between."""
    return "WITH RECURSIVE " + ",\n".join([CORPUS.strip(), *more]) + "\n" + query
