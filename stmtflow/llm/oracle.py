"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from stmtflow.llm import quality_rules as q
from stmtflow.llm import url_filters as u

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _base9(docs: str) -> str:
    return rf"""
base9 AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM {docs}
), lines9 AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM base9)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), at9 AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base9)
), twice9 AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM at9) WHERE n > 1
), cover9 AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice9, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid
), count9 AS (
  SELECT b.rid, doc_id, coalesce(lang, '(none)') AS stratum, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper
  FROM base9 b LEFT JOIN lines9 l USING (rid) LEFT JOIN cover9 c USING (rid)
), rows9 AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_share,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_length
  FROM count9
)"""


def _verdict9() -> str:
    grid = ", ".join(f"('{rule}', {i}, {cut}::DOUBLE)" for rule, cuts in q.GRID.items() for i, cut in enumerate(cuts))
    p, names = q.RISK / len(q.GRID), ", ".join(q.GRID)
    over = " OR ".join(f"coalesce({rule} > max(cutoff) FILTER (WHERE rule = '{rule}'), false)" for rule in q.GRID)
    return f"""
good9 AS (
  SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), held9 AS (
  SELECT stratum, rule, v FROM (SELECT stratum, {names} FROM rows9 WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good9))
  UNPIVOT (v FOR rule IN ({names}))
), grid9(rule, step, cutoff) AS (VALUES {grid}
), tests9 AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE v > cutoff) AS k
  FROM held9 JOIN grid9 USING (rule) GROUP BY ALL
), tails9 AS (
  SELECT *, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END AS tail FROM tests9
), cut9 AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM (
    SELECT *, min(CASE WHEN tail > {q.LEVEL} / ((SELECT count(DISTINCT stratum) FROM rows9) * {len(q.GRID)}) THEN step END)
      OVER (PARTITION BY stratum, rule) AS stop FROM tails9)
  WHERE stop IS NULL OR step < stop GROUP BY stratum, rule
), judged9 AS (
  SELECT rid, r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({over}) AS kept
  FROM rows9 r LEFT JOIN cut9 c USING (stratum)
  GROUP BY rid, r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {names}
)"""


def op9() -> str:
    return f"WITH {_base9('documents')}, {_verdict9()} SELECT * EXCLUDE (rid) FROM judged9"


def op8() -> str:
    def host(x: str) -> str:
        return f"translate(regexp_extract({x}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    rules = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in u.RULES)
    link = r"""'(?i)\b(?:href|src)\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)'"""
    steps, last = [], "seeds"
    for i in range(u.STEPS):
        steps.append(f"""r{i} AS (SELECT kind, host, sum(rank) AS rank FROM (
          SELECT kind, host, rank * {1 - u.DAMPING} AS rank FROM seeds
          UNION ALL SELECT r.kind, m.target, r.rank * m.part * {u.DAMPING} FROM {last} r JOIN moves m ON m.kind = r.kind AND m.host = r.host
        ) GROUP BY kind, host)""")
        last = f"r{i}"
    return f"""
WITH rules(verdict, host, path, rule) AS (VALUES {rules}),
seen AS (
  SELECT row_number() OVER () AS rid, page_id, html, coalesce({host('url')}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (
  SELECT s.*, (SELECT struct_pack(rule := r.rule, verdict := r.verdict) FROM rules r
    WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
    ORDER BY length(r.rule) DESC, r.rule LIMIT 1) AS m FROM seen s
), links AS (
  SELECT host AS source, {host("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS target
  FROM (SELECT host, unnest(regexp_extract_all(html, {link}, 1)) AS link FROM ruled)
), edges AS (
  SELECT source, target, count(*) AS links FROM links WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL
), ways AS (
  SELECT 'trust' AS kind, source AS host, target, links FROM edges UNION ALL SELECT 'distrust', target, source, links FROM edges
), moves AS (
  SELECT kind, host, target, links / sum(links) OVER (PARTITION BY kind, host) AS part FROM ways
), seeds AS (
  SELECT CASE m.verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS rank
  FROM ruled WHERE m IS NOT NULL GROUP BY ALL
), {", ".join(steps)}, bad AS (
  SELECT host FROM {last} GROUP BY host
  HAVING round(coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) / (sum(rank) + {u.GOODWILL}), 9) >= {u.THRESHOLD}
)
SELECT page_id, host, path, m.rule AS rule,
  coalesce(m.verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


def op13() -> str:
    """Every product of a query and a vector; sums of integers that doubles hold exactly."""
    return """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), asked AS (
  SELECT DISTINCT vec_id AS query_id, e AS q FROM usable WHERE vec_id % 100 = 0
), scored AS (
  SELECT query_id, q, vec_id, CAST(list_dot_product(q, e) AS BIGINT) AS score
  FROM asked JOIN usable ON vec_id <> query_id AND len(e) = len(q)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""


SQL: dict[str, str] = {"op13_inner_products": op13(), "op8_url_filters": op8(), "op9_quality_rules": op9()}
