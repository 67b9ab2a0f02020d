"""Registered queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from . import (conversation_repair, decontaminate, host_rules, jaccard_join, lm_scoring, packing, pii, repair_output, substrings,
               token_counts, toxicity, vantage, whitening)

QUERIES = {
    "op1_repair_output": repair_output.query,
    "op2_decontaminate": decontaminate.query,
    "op3_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_substrings": substrings.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_token_counts": token_counts.query,
    "op8_lm_scoring": lm_scoring.query,
    "op9_host_rules": host_rules.query,
    "op10_pii": pii.query,
    "op11_vantage_points": vantage.query,
    "op12_whitening": whitening.query,
    "op13_conversation_repair": conversation_repair.query,
}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE = {
    "op2_decontaminate": rf"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOW}, '{_PLAIN}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, list_slice(w, k, least(k + 9, len(w))) AS win
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(win) AS n FROM win),
doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '{_PLAIN}'), []) AS w FROM documents),
place AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM place JOIN win USING (win)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op5_substrings": rf"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS w FROM documents),
place AS (SELECT doc_id, k, list_slice(w, k, k + 12) AS win
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM doc WHERE len(w) >= 13)),
source AS (SELECT win, min(doc_id) AS lo FROM place GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 12)) AS p FROM place JOIN source USING (win) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM doc),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)""",
}
