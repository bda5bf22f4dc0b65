"""The queries of this subpackage, by name."""

from __future__ import annotations

from . import html, jaccard, licences, media, mixing, neighbours, packing, pii, quality, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_documents,
    "op2_licence_scan": licences.op2_licence_scan,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
    "op10_packing": packing.op10_packing,
    "op7_quality": quality.op7_quality,
    "op8_media_columns": media.op8_media_columns,
}
#: All pairs that share a shingle, and every root that links lead to: for small tables only.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.size + y.size - c)),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b, root FROM reached JOIN links ON a = doc_id)
SELECT r.doc_id, coalesce(min(n.size), 0) AS n_shingles, min(root) AS component_id FROM reached r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
ORACLES: dict[str, str] = {"op6_jaccard_join": JACCARD}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
