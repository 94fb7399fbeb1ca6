"""DuckDB SQL for those operators whose results SQL can tell."""

from __future__ import annotations

from .hosts import ADDRESS, LOWER, RULES, SUFFIXES, UPPER

_COMPONENTS = """
ends AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reached AS (SELECT u, v FROM ends UNION SELECT r.u, e.v FROM reached r JOIN ends e ON r.v = e.u),
lowest AS (SELECT u, least(u, min(v)) AS component FROM reached GROUP BY u)
"""

OP1 = f"""
WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM x WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(e, lambda y: y <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
{_COMPONENTS},
degree AS (SELECT u, count(*) AS n FROM ends GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON degree.u = vec_id LEFT JOIN lowest ON lowest.u = vec_id
"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM one p JOIN one q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_COMPONENTS}
SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM s LEFT JOIN lowest ON u = doc_id
"""


def op6(limit: float = 0.5, z: float = 1.645) -> str:
    """The same shrinkage: suffixes towards all pages, domains towards suffixes, hosts towards domains."""
    rules = ", ".join(f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in RULES)
    sums = "sum({g}) AS g, sum({n}) AS m, count(*) AS k, round(sum(CAST({g} AS DOUBLE) * {g} / {n}), 6) AS gg, sum(CAST({n} AS DOUBLE) * {n}) AS mm"
    # rho by moments, bounded; then (1 - rho) / rho
    rho = "CASE WHEN k > 1 AND g < m AND g > 0 AND m - mm / m > k - 1 THEN least(0.5, greatest(1 / 1001.0, ((gg - g * (g / m)) - (g / m) * (1 - g / m) * (k - 1)) / ((g / m) * (1 - g / m) * (m - mm / m - (k - 1))))) ELSE 1 / 1001.0 END"
    level = lambda name, source, parent: f"{name} AS (SELECT {parent}, g, m, (1 - rho) / rho AS s FROM (SELECT *, {rho} AS rho FROM (SELECT {parent}, {sums.format(g='good', n='n')} FROM {source} GROUP BY {parent})))"
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
known AS (SELECT p.host, CAST(coalesce(quality, 0) = 1 AND coalesce(toxic, 1) = 0 AS BIGINT) AS good FROM p JOIN labels ON labels.doc_id = TRY_CAST(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1) AS BIGINT) WHERE host <> ''),
names AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
seen AS (SELECT host, CASE WHEN address THEN name WHEN listed THEN array_to_string(split(name, '.')[-3:], '.') ELSE two END AS domain, CASE WHEN address THEN 'address' WHEN listed THEN two ELSE split(name, '.')[-1] END AS suffix
  FROM (SELECT *, regexp_matches(name, '{ADDRESS}') AS address, two IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) AS listed FROM (SELECT *, array_to_string(split(name, '.')[-2:], '.') AS two FROM names))),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS good FROM known JOIN seen USING (host) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 0 AS one, sum(n) AS n, sum(good) AS good FROM domains GROUP BY suffix),
{level("root", "suffixes", "one")}, {level("mid", "domains", "suffix")}, {level("low", "hosts", "domain")},
mid_rate AS (SELECT suffix, mid.s, (mid.g + root.s * (root.g / root.m)) / (mid.m + root.s) AS rate FROM mid JOIN root ON true),
low_rate AS (SELECT domain, low.s, (low.g + mid_rate.s * mid_rate.rate) / (low.m + mid_rate.s) AS rate FROM low JOIN (SELECT DISTINCT domain, suffix FROM seen) USING (domain) JOIN mid_rate USING (suffix)),
prior AS (SELECT host, coalesce(hosts.n, 0) AS n, coalesce(hosts.good, 0) AS good, coalesce(low_rate.rate, mid_rate.rate, root.g / root.m) AS rate, coalesce(low_rate.s, mid_rate.s, root.s) AS s
  FROM seen JOIN root ON root.m > 0 LEFT JOIN hosts USING (host) LEFT JOIN low_rate ON low_rate.domain = seen.domain LEFT JOIN mid_rate ON mid_rate.suffix = seen.suffix),
post AS (SELECT host, (good + s * rate) / (n + s) AS mean, n + s AS total FROM prior),
blocked AS (SELECT host FROM post WHERE least(1.0, mean + {z} * sqrt(mean * (1 - mean) / (total + 1))) < {limit}),
rules(rule_host, rule_path, verdict, rule) AS (VALUES {rules}),
fits AS (SELECT DISTINCT ON (host, path) host, path, rule, verdict FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) ORDER BY host, path, len(rule) DESC)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN p.host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path
"""


def op8(table: list[int]) -> str:
    """The lookup table as a list, and the same portable hash."""
    slot = f"(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {len(table)})"
    return f"WITH t AS (SELECT {table} AS owners) SELECT doc_id, source, n_chars, CAST({slot} AS INTEGER) AS slot, CAST(owners[{slot} + 1] AS INTEGER) AS shard FROM documents, t"
