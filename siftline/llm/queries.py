"""Queries over the operators of this subpackage, each over its whole tables."""

from __future__ import annotations

from siftline.llm import contamination, credentials, documented, generated, invalid, mixture, neighbors, repetition, splitting
from siftline.session import read

QUERIES = {
    "p1_found": lambda s, d: credentials.found(read(s, d, "chunks")),
    "p1_findings": lambda s, d: credentials.find(read(s, d, "chunks")),
    "p1_redacted": lambda s, d: credentials.redact(read(s, d, "chunks")),
    "p2_found": lambda s, d: generated.found(read(s, d, "chunks")),
    "p2_reasons": lambda s, d: generated.judged(read(s, d, "chunks")),
    "p3_found": lambda s, d: invalid.found(read(s, d, "chunks")),
    "p3_flags": lambda s, d: invalid.flags(read(s, d, "chunks")),
    "p3_rates": lambda s, d: invalid.rates(read(s, d, "chunks")),
    "p4_found": lambda s, d: splitting.found(read(s, d, "code_chunks")),
    "p4_pieces": lambda s, d: splitting.pieces(read(s, d, "code_chunks")),
    "p5_found": lambda s, d: neighbors.found(read(s, d, "chunks")),
    "p5_neighbors": lambda s, d: neighbors.search(read(s, d, "chunks"), 5, "id % 20 = 0", share=neighbors.SHARE),
    "p6_found": lambda s, d: documented.found(read(s, d, "chunks")),
    "p6_pairs": lambda s, d: documented.pairs(read(s, d, "chunks")),
    "p8_found": lambda s, d: contamination.found(read(s, d, "documents"), read(s, d, "eval_items")),
    "p8_leaks": lambda s, d: contamination.leaks(read(s, d, "documents"), read(s, d, "eval_items")),
    "p9_found": lambda s, d: mixture.found(read(s, d, "documents"), read(s, d, "source_weights")),
    "p9_drawn": lambda s, d: mixture.drawn(mixture.tokens(read(s, d, "documents")), read(s, d, "source_weights")),
    "p9_shares": lambda s, d: mixture.shares(mixture.tokens(read(s, d, "documents")), read(s, d, "source_weights")),
    "p10_found": lambda s, d: repetition.found(read(s, d, "documents")),
    "p10_measures": lambda s, d: repetition.measure(read(s, d, "documents")),
}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SQL: dict[str, str] = {
    "p4_found": """
        SELECT DISTINCT chunk_id FROM code_chunks
        WHERE strlen(content) > 4 * CASE lower(trim(token_budget)) WHEN 'small' THEN 256 WHEN 'medium' THEN 512 WHEN 'large' THEN 1024
              ELSE coalesce(nullif(try_cast(CASE WHEN regexp_full_match(trim(token_budget), '[0-9]{1,9}') THEN trim(token_budget) END AS INTEGER), 0), 512) END""",
    "p5_found": """
        WITH v AS (SELECT id, embedding::DOUBLE[] AS e, len(embedding) AS n FROM chunks WHERE id IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0),
        p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.n = b.n AND a.id <> b.id),
        r AS (SELECT a, b, c FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE c >= 0.9""",
    "p8_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM d)),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    # sizes in characters: the sources that fall short are the same by any such size
    "p9_found": """
        WITH n AS (SELECT lower(trim(source)) AS source, sum(coalesce(length(text), 0)) AS n FROM documents WHERE trim(source) <> '' GROUP BY 1)
        SELECT w.source FROM source_weights w LEFT JOIN n ON n.source = lower(trim(w.source)) WHERE w.max_repeats * coalesce(n.n, 0) < w.target_share * (SELECT sum(n) FROM n)""",
    "p10_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        r AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
        again AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(k) OVER (PARTITION BY doc_id, g) AS first FROM r) WHERE k > first),
        marked AS (SELECT DISTINCT doc_id, k + j AS p FROM again, range(0, 8) AS t(j))
        SELECT doc_id FROM d JOIN (SELECT doc_id, count(*) AS n FROM marked GROUP BY doc_id) USING (doc_id)
        WHERE len(w) >= 40 AND n * 10 >= len(w) * 3""",
}
