"""The views of ``fixtures`` in DuckDB's SQL."""

from __future__ import annotations

import re


def _stamp(n: str) -> str:
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    return f"'20' || {two(f'({n}) // 29030400 % 80 + 20')} || '-' || {two(f'({n}) % 12 + 1')} || '-' || {two(f'({n}) // 12 % 28 + 1')} || 'T' || {two(f'({n}) // 336 % 24')} || ':' || {two(f'({n}) // 8064 % 60')} || ':' || {two(f'({n}) // 483840 % 60')} || 'Z'"


VIEWS = {
    "papers": f"""SELECT 'p' || d.doc_id AS id, d.doc_id AS seq, substring(split_part(d.text, chr(10), 1), 1, 80) AS title, substring(d.text, 1, 1000) AS abstract_text,
 CAST(2000 + d.doc_id % 26 AS INTEGER) AS year, d.source AS venue,
 CASE d.doc_id % 6 WHEN 0 THEN 'https://doi.org/10.1/X' || (d.doc_id // 12) WHEN 1 THEN 'doi:10.1/x' || (d.doc_id // 12) WHEN 2 THEN '10.1/X' || (d.doc_id // 12) WHEN 3 THEN ' http://dx.doi.org/10.1/x' || (d.doc_id // 12) || ' ' END AS doi,
 CASE WHEN d.doc_id % 5 = 0 THEN '2301.' || lpad(CAST(d.doc_id AS VARCHAR), 5, '0') || 'v1' END AS arxiv_id,
 CASE WHEN d.doc_id % 7 = 0 THEN 's' || d.doc_id END AS s2_id, CASE WHEN d.doc_id % 11 = 0 THEN '/pdf/' || d.doc_id || '.pdf' END AS pdf_path,
 CASE WHEN d.doc_id % 13 = 0 THEN 'https://example.org/' || d.doc_id END AS url, CASE WHEN d.doc_id % 4 = 0 THEN 'https://openalex.org/W' || d.doc_id END AS openalex_id,
 CASE d.doc_id % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'abstract_read' WHEN 2 THEN 'skimmed' WHEN 3 THEN 'read' ELSE 'deep_read' END AS status,
 CASE d.doc_id // 5 % 5 WHEN 0 THEN 'unread' WHEN 1 THEN 'queued' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'completed' ELSE 'abandoned' END AS reading_status,
 '' AS notes, d.lang, d.source, 0.5::DOUBLE AS relevance_score, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN CAST(1 + d.doc_id % 5 AS INTEGER) END AS rating,
 CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.lang || '; ' || d.source END AS keywords, {_stamp("d.doc_id")} AS created_at, {_stamp("d.doc_id * 7919 % 1000")} AS updated_at
 FROM documents d""",
    "topics": "SELECT 'r' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_topic_id, 0 AS depth, (r_regionkey % 10) / 10.0::DOUBLE AS priority FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 1, (n_nationkey % 10) / 10.0::DOUBLE FROM nation",
    "topic_papers": "SELECT 'n' || (doc_id % 25) AS topic_id, 'p' || doc_id AS paper_id, (doc_id * 37 % 100) / 100.0::DOUBLE AS relevance FROM documents",
    "bodies": "SELECT 'p' || conv_id AS paper_id, string_agg('<!-- page ' || (turn + 1) || ' -->' || chr(10) || '## ' || role || chr(10) || text || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id",
    "citations": "SELECT 'p' || l_orderkey AS citing, 'p' || l_partkey AS cited, CASE min(l_returnflag) WHEN 'A' THEN 'background' WHEN 'R' THEN 'methodology' ELSE '' END AS context, CAST(min(l_linenumber) AS BIGINT) AS seq, l_orderkey AS order_key FROM lineitem GROUP BY l_orderkey, l_partkey",
    "gaps": "SELECT 'g' || o_orderkey AS id, 'gap ' || o_orderkey || ' ' || o_orderpriority AS description, 'n' || c_nationkey AS topic_id, CASE o_orderpriority WHEN '2-HIGH' THEN 'unanswered_question' WHEN '3-MEDIUM' THEN 'methodology_gap' WHEN '4-NOT SPECIFIED' THEN 'connection_gap' ELSE 'missing_literature' END AS gap_type, greatest(0.0, least(1.0, o_totalprice / 400000)) AS priority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS discovered_at FROM orders JOIN customer ON o_custkey = c_custkey",
    "state": "SELECT 'n' || n_nationkey AS topic_id, n_nationkey % 7 AS papers_read, n_nationkey % 5 AS papers_queued, 0 AS gaps_identified, (n_nationkey % 10) / 10.0::DOUBLE AS coverage_score FROM nation WHERE n_nationkey % 2 = 0",
    "reports": "SELECT 'rep' || r_regionkey AS id, r_name AS title, CASE WHEN r_regionkey = 0 THEN '# T' || chr(10) || chr(10) || 'plain ' || r_regionkey ELSE '# ' || r_name || chr(10) || 'lead' || chr(10) || '## Scope ' || chr(10) || 'All of ' || r_name || chr(10) || 'and more' || chr(10) || chr(10) || '## Open questions' || chr(10) || chr(10) || 'Number ' || r_regionkey || chr(10) END AS content, '2024-01-0' || r_regionkey AS generated_at FROM region",
    "incoming": "SELECT 'i' || doc_id AS id, replace(substring(split_part(text, chr(10), 1), 1, 80), ' ', ' - ') || ' !' AS title, CASE WHEN doc_id % 6 < 4 THEN 'https://dx.doi.org/10.1/X' || (doc_id // 12) END AS doi, CASE WHEN doc_id % 11 = 0 THEN '/pdf/' || doc_id || '.pdf' END AS pdf_path, doc_id AS seq FROM documents UNION ALL SELECT 'b' || item_id, substring(text, 1, 80), NULL, NULL, item_id + 1000000000 FROM benchmark",
    "remote_items": "SELECT 'z' || k || '-' || c AS key, '10.1/X' || k AS doi, k + c AS version, CASE WHEN k % 5 = 0 THEN list_concat([' en ', ''], list_concat([('src' || i) for i in range(20)], ['de', 'fr', 'es'])) ELSE [' en ', ' ', 'kept'] END AS tags FROM (SELECT DISTINCT doc_id // 12 AS k FROM documents) CROSS JOIN range(2) t(c) WHERE k % 4 <> 0 AND (c = 0 OR k % 9 = 1)",
}


def with_views(sql: str) -> str:
    """The statement with definitions of the views that it names, in an order that lets views use views."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = re.sub(r"^\s*WITH(\s+RECURSIVE)?\s+", "", sql, flags=re.I) if sql.lstrip().upper().startswith("WITH") else None
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not used:
        return sql
    return f"WITH {recursive}{heads}, {body}" if body else f"WITH {heads} {sql}"


#: White space of any script, one by one.
SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def doi(x: str) -> str:
    ends = f"^[{SPACES}]+|[{SPACES}]+$"
    return rf"nullif(lower(regexp_replace(regexp_replace(regexp_replace({x}, '{ends}', '', 'g'), '^(https?://(dx\.)?doi\.org/|doi:)', ''), '{ends}', '', 'g')), '')"


def title(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}{SPACES}]', '', 'g'), '[{SPACES}]+', ' ', 'g')))"
