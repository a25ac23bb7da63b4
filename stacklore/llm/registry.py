"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from importlib import import_module

NAMES = {
    "op1_quality_rules": "quality_rules",
    "op2_jaccard_join": "jaccard_join",
    "op3_resharding": "resharding",
    "op4_secret_scan": "secrets",
    "op5_token_counts": "token_counts",
    "op6_private_data": "private_data",
    "op7_quality_classifier": "line_crf",
    "op8_decontamination": "decontamination",
    "op9_main_text": "html_text",
    "op10_packing": "packing",
    "op11_merkle_manifest": "merkle",
    "op12_fill_in_middle": "fill_in_middle",
    "op13_suffix_dedup": "suffix_dedup",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


#: Every pair of texts that share a shingle, counted exactly; classes by walking the links.
JACCARD_SQL = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT id, id FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN d.doc_id ELSE c.class_id END AS class_id, coalesce(k.n_links, 0) AS n_links, coalesce(t.n_copies, 1) AS n_copies
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN (SELECT id, min(root) AS class_id FROM r GROUP BY id) c ON c.id = t.id LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) k ON k.a = t.id
"""


def oracle_sql() -> dict[str, str]:
    """The other operators compile, learn, solve or align; tests/llm holds them against brute force."""
    return {"op2_jaccard_join": JACCARD_SQL} | {name: import_module(f"{__package__}.{NAMES[name]}").SQL for name in ("op11_merkle_manifest", "op12_fill_in_middle")}
