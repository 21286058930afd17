"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from strandgrid.llm.chat_windows import op2_budgeted_windows
from strandgrid.llm.fm_decontamination import op3_fm_index_leaks
from strandgrid.llm.hash_forest import op8_hash_prefix_forest
from strandgrid.llm.quality_classifier import op9_subword_quality
from strandgrid.llm.sharding import op6_hash_tree_shards
from strandgrid.llm.signature_join import op10_signature_tree_join
from strandgrid.llm.speculative_bpe import op4_speculative_bpe
from strandgrid.llm.suffix_dedup import LENGTH, op5_suffix_family_dedup
from strandgrid.llm.token_counts import op1_transducer_counts
from strandgrid.llm.url_filter import RULES, SOFT, SOFT_LIMIT, STRICT, op7_url_vocabulary

QUERIES = {
    f.__name__: f
    for f in (
        op1_transducer_counts,
        op2_budgeted_windows,
        op3_fm_index_leaks,
        op4_speculative_bpe,
        op5_suffix_family_dedup,
        op6_hash_tree_shards,
        op7_url_vocabulary,
        op8_hash_prefix_forest,
        op9_subword_quality,
        op10_signature_tree_join,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


_WORDS = f"regexp_extract_all({{}}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH items AS (SELECT item_id, {_WORDS.format(low("text"))} AS ws FROM benchmark),
cut AS (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 7) + 1)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + 7], ' ') AS w, len(ws[i : i + 7]) AS n FROM cut),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(low("text"))} AS ws FROM documents),
spots AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n),
hits AS (SELECT DISTINCT r, i, spots.n, item_id FROM (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM spots) spots JOIN windows USING (w)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


#: Strings of bytes are hex digits here; windows are counted by a 128-bit digest.
OP5 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
sizes AS (SELECT r, doc_id, h, length(h) // 2 AS n FROM docs),
spots AS (SELECT r, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM sizes WHERE n >= {LENGTH}),
windows AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS w FROM spots),
hits AS (SELECT r, i FROM windows SEMI JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) again USING (w)),
begun AS (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{2 * LENGTH}) + {LENGTH})::INT AS new FROM hits),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM begun),
spans AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM spans),
kept AS (SELECT r, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS head, max(b) AS rest, count(*) AS n_spans, sum(b - a) AS n_removed FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * rest + 1), h))) AS kept_sha256
FROM sizes LEFT JOIN kept USING (r)
"""


def _rule_sql(verdict: str, host: str, path: str) -> str:
    return f"SELECT '{host}{path}' AS rule, '{verdict}' AS said, '{host}' AS rule_host, '{path}' AS rule_path"


def _term_sql(term: str) -> str:
    return f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')"


OP7 = f"""
WITH rules AS ({" UNION ALL ".join(_rule_sql(*r) for r in RULES)}),
parts AS (SELECT row_number() OVER () AS r, page_id, {low("url")} AS u, coalesce(url, '') AS url,
                 regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', ['host', 'path']) AS p FROM pages),
split AS (SELECT r, page_id, u, {low("p.host")} AS host, p.path AS path FROM parts),
best AS (SELECT r, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said FROM split, rules
         WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN {" OR ".join(map(_term_sql, STRICT))} OR {" + ".join(f"{_term_sql(t)}::INT" for t in SOFT)} >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (r)
"""

OP10 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({low("text")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM docs WHERE len(ws) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(docs.doc_id, coalesce(m, docs.doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = docs.doc_id
"""

#: The others have no SQL: tokenizers, windows of tokens, Spark's own hash, approximate search, a model.
ORACLE_SQL: dict[str, str] = {"op3_fm_index_leaks": OP3, "op5_suffix_family_dedup": OP5, "op7_url_vocabulary": OP7, "op10_signature_tree_join": OP10}
