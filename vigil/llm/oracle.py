"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as q

_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    """Counts by text functions and windows; the binomial bound as a plain sum of its terms."""
    signals = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "upper_share": "n_upper / greatest(n_letters, 1)",
               "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
               "repeat_share": "n_repeat_words / greatest(n_words, 1)"}
    levels = " ".join(
        f"WHEN {' OR '.join(f'CAST({s} AS DOUBLE) > {q.LEVELS[name][t]!r}' for name, s in signals.items())} THEN {t}"
        for t in range(q.N_LEVELS))
    strata = ", ".join(f"'{s}'" for s in q.STRATA)
    p, error = q.MAX_FALSE_REJECTION, q.ERROR / (len(q.STRATA) + 1)
    return f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split) AS a),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) AS b GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum, len(w) AS n_words,
         CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
rated AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                 CASE {levels} ELSE {q.N_LEVELS} END AS level FROM counted),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL
         GROUP BY doc_id HAVING min(quality) = 1),
holdout AS (SELECT stratum, level FROM rated WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
tests AS (SELECT s.stratum, t.t, count(h.level) AS n, count(*) FILTER (h.level <= t.t) AS k
          FROM (SELECT unnest([{strata}, 'other']) AS stratum) AS s
          CROSS JOIN (SELECT unnest(range({q.N_LEVELS})) AS t) AS t
          LEFT JOIN holdout h ON h.stratum = s.stratum GROUP BY ALL),
judged AS (SELECT stratum, t, n = 0 OR list_sum([exp(lgamma(n + 1)
             - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN j = n THEN 0 ELSE lgamma(n - j + 1) END
             + j * ln({p}) + (n - j) * ln(1 - {p})) FOR j IN range(0, k + 1)]) > {error} AS failed FROM tests),
cut AS (SELECT stratum, coalesce(min(t) FILTER (failed), {q.N_LEVELS}) - 1 AS certified FROM judged GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND level > certified AS kept, rated.stratum, CAST(level AS INTEGER) AS level,
       CAST(certified AS INTEGER) AS certified
FROM rated JOIN cut ON rated.stratum = cut.stratum"""


HARD_NEGATIVES = """
WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
              FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                  CAST(list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
           FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
       p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3"""

ORACLE = {"op1_quality_rules": quality_rules_sql(), "op13_hard_negatives": HARD_NEGATIVES}
