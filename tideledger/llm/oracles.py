"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from tideledger.llm.quality import CUTOFFS, Promise
from tideledger.llm.queries import URL_RULES


def _quality() -> str:
    promise = Promise()
    rules = list(CUTOFFS)
    grid = ", ".join(f"('{r}', {j}, {c})" for r in rules for j, c in enumerate(CUTOFFS[r]))
    risk, level = promise.risk / len(rules), promise.error / len(rules)
    picks = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS cut_{r}" for r in rules)
    hits = " ".join(f"WHEN {r} > cut_{r} THEN '{r}'" for r in rules)
    return rf"""
WITH words AS (
  SELECT rowid AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
), places AS (
  SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words
), triples AS (
  SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY rid ORDER BY i)
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM triples WHERE c IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid
), lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words
), m AS (
  SELECT rid, doc_id, stratum, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), s AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_symbols // n_words END AS symbols,
         CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END AS repeats,
         CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END AS dup_lines,
         CASE WHEN n_words = 0 THEN 0 ELSE 1000 * word_chars // n_words END AS long_words,
         -CASE WHEN n_words = 0 THEN 0 ELSE 1000 * word_chars // n_words END AS short_words
  FROM m
), known AS (
  SELECT doc_id, min(quality) >= 1 AS good FROM labels
  WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), scored AS (
  SELECT stratum, good, rule, score FROM (
    SELECT stratum, good, {", ".join(rules)} FROM s JOIN known USING (doc_id) WHERE NOT base_failed)
  UNPIVOT (score FOR rule IN ({", ".join(rules)}))
), counts AS (
  SELECT stratum, rule, place, cutoff, count(*) FILTER (good) AS n,
         count(*) FILTER (good AND score > cutoff) AS k, count(*) FILTER (NOT good AND score > cutoff) AS bad
  FROM scored JOIN (VALUES {grid}) AS g(rule, place, cutoff) USING (rule) GROUP BY ALL
), tested AS (
  SELECT *, CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS p
  FROM counts
), chosen AS (
  SELECT stratum, rule, cutoff, row_number() OVER (
           PARTITION BY stratum, rule ORDER BY bad - {promise.good_weight} * k DESC, place) AS r
  FROM tested
  WHERE p <= {level} / (SELECT count(DISTINCT stratum) FROM counts) AND bad - {promise.good_weight} * k > 0
), cuts AS (
  SELECT stratum, {picks} FROM chosen WHERE r = 1 GROUP BY stratum
), judged AS (
  SELECT s.*, CASE {hits} END AS rule FROM s LEFT JOIN cuts USING (stratum)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rule IS NULL AS kept, rule FROM judged"""


def _urls() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return rf"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT rid, page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), fits AS (
  SELECT rid, r.host || r.path AS rule, verdict, row_number() OVER (
           PARTITION BY rid ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
  FROM split JOIN (VALUES {rules}) AS r(host, path, verdict)
    ON (split.host = r.host OR ends_with(split.host, '.' || r.host)) AND starts_with(split.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rid)"""


def _warc() -> str:
    bits = "((('0x' || substr(sha, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)"
    return f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS sha,
         max(page_id) OVER (PARTITION BY payload) AS keep FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {bits}, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d"""


def _interactions() -> str:
    pairs = " AND ".join(f"{a}.f <> {b}.f" for i, a in enumerate("pqrst") for b in "pqrst"[:i])
    return rf"""
WITH filters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks GROUP BY ALL
), orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM filters p, filters q, filters r, filters s, filters t
  WHERE {pairs}
), steps AS (
  SELECT filter_order, step, bit, (SELECT coalesce(sum(g.bit), 0) FROM filters g
           WHERE strpos(filter_order, g.f) < step) AS before
  FROM orders, range(1, 6) AS k(step) JOIN filters ON f = substr(filter_order, step, 1)
), counted AS (
  SELECT part, filter_order, step::INT AS step, bit,
         sum(CASE WHEN mask & (before + bit)::INT = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before::INT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before::INT <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before::INT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before::INT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted"""


ORACLES = {"op3_warc": _warc(), "op1_quality_rules": _quality(), "op5_url_filter": _urls(),
           "op11_filter_interactions": _interactions()}
