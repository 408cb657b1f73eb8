"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from loomdex.llm.license_scan import TEMPLATES
from loomdex.llm.url_reputation import SUFFIXES

_WORD = r"[^\x20\x09-\x0D]+"

MIX = rf"""WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
 FROM r WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT first(level ORDER BY cap / w, level DESC) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, n, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * w) END AS target FROM l, f),
j AS (SELECT doc_id, key, size, d.source, source_size, n, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate, md5(key || '#0') AS h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, rate - floor(rate) AS f, CAST(('0x' || substring(h, 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u, CAST(floor(CAST(('0x' || substring(h, 14, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE * greatest(1, n // 64)) AS BIGINT) AS cell FROM j),
v AS (SELECT * EXCLUDE (u), row_number() OVER (PARTITION BY source, cell ORDER BY size DESC, u, doc_id NULLS LAST) - 1 AS number FROM u),
t2 AS (SELECT *, number // 256 AS turn, CAST(number % 256 + 1 AS INTEGER) AS place, CAST(('0x' || substring(md5(key || '@' || CAST(number AS VARCHAR) || '#0'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM v),
c AS (SELECT source, cell, turn, any_value(f) AS f, list({{'p': 0.0::DOUBLE, 'size': CAST(size AS DOUBLE), 'place': place, 'u': u, 'out': CAST([] AS INTEGER[])}} ORDER BY place) AS own FROM t2 GROUP BY ALL),
e AS (SELECT source, cell, turn, list_reduce(own, lambda a, x: CASE WHEN x.size = 0 THEN {{'p': a.p, 'size': a.size, 'place': a.place, 'u': a.u, 'out': CASE WHEN x.u < f THEN list_append(a.out, x.place) ELSE a.out END}}
 WHEN a.place = 0 THEN {{'p': f, 'size': x.size, 'place': x.place, 'u': x.u, 'out': a.out}}
 WHEN x.u * (least(1.0 - a.p, f * (x.size / a.size)) + least(a.p, (1.0 - f) * (x.size / a.size))) < least(a.p, (1.0 - f) * (x.size / a.size)) THEN
  CASE WHEN 1.0 - a.p <= f * (x.size / a.size) THEN {{'p': greatest(0.0, f - (1.0 - a.p) / (x.size / a.size)), 'size': x.size, 'place': x.place, 'u': a.u, 'out': list_append(a.out, a.place)}} ELSE {{'p': a.p + f * (x.size / a.size), 'size': a.size, 'place': a.place, 'u': a.u, 'out': a.out}} END
 ELSE CASE WHEN a.p <= (1.0 - f) * (x.size / a.size) THEN {{'p': least(1.0, f + a.p / (x.size / a.size)), 'size': x.size, 'place': x.place, 'u': a.u, 'out': a.out}} ELSE {{'p': a.p - (1.0 - f) * (x.size / a.size), 'size': a.size, 'place': a.place, 'u': a.u, 'out': list_append(a.out, x.place)}} END END,
 {{'p': 0.0::DOUBLE, 'size': 1.0::DOUBLE, 'place': CAST(0 AS INTEGER), 'u': 0.0::DOUBLE, 'out': CAST([] AS INTEGER[])}}) AS d FROM c),
r2 AS (SELECT t2.*, CASE WHEN list_contains(d.out, place) OR (d.u < d.p AND d.place = place) THEN 1 ELSE 0 END AS take FROM t2 JOIN e ON t2.source IS NOT DISTINCT FROM e.source AND t2.cell = e.cell AND t2.turn = e.turn)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + take) * size AS BIGINT) AS taken FROM r2"""


def _level(name: str, key: str, parent: str, groups: str, parents: str) -> str:
    """Posterior of one level under its parents, as ``_shrunk`` computes it."""
    return f"""{name}_m AS (SELECT g.*, p.a / (p.a + p.b) AS mu FROM ({groups}) g JOIN {parents} p USING ({parent})),
{name}_k AS (SELECT coalesce(greatest(1.0, least(1000.0, 1 / greatest(1e-6, least(1.0, sum(n * (bad / n - mu) ** 2 - mu * (1 - mu)) / nullif(sum((n - 1) * mu * (1 - mu)), 0))) - 1)), 1000.0) AS k FROM {name}_m WHERE n > 1),
{name} AS (SELECT {key}, k * mu + bad AS a, k * (1 - mu) + n - bad AS b FROM {name}_m, {name}_k)"""


_SUMS = "CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad"
_OUT = "CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad"
URLS = f"""WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM p JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT) GROUP BY 1),
g AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two, regexp_matches(host, '^[0-9.]+$') AS address, 0 AS top FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT host, n, bad, top, CASE WHEN address THEN host WHEN two IN {SUFFIXES} THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain,
 CASE WHEN address THEN '' WHEN two IN {SUFFIXES} THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM g),
root AS (SELECT top, 1.0 + sum(bad) AS a, 1.0 + sum(n) - sum(bad) AS b FROM h GROUP BY top),
{_level("suffixes", "suffix", "top", f"SELECT suffix, top, {_SUMS} FROM h GROUP BY 1, 2", "root")},
{_level("domains", "domain", "suffix", f"SELECT domain, suffix, {_SUMS} FROM h GROUP BY 1, 2", "suffixes")},
{_level("hosts", "host", "domain", f"SELECT host, domain, {_OUT} FROM h", "domains")},
rules(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best AS (SELECT page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY 1)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > (SELECT a / (a + b) FROM root) THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN hosts USING (host) LEFT JOIN best USING (page_id)"""

_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
_SPEAKS = "(?i)licen[sc]e|copyright|public domain|permission is hereby|SPDX"
_COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--)"
# no path of these documents is named as a licence file, so whole files and paragraphs have no part here
LICENSES = f"""WITH t AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || '.txt') AS path, coalesce(length(text), 0) AS size, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{_SPEAKS}')) AS mine FROM t),
f AS (SELECT doc_id, path, size, mine, CASE WHEN len(list_filter(mine, lambda x: regexp_matches(x, '{_COMMENT}'))) > 0 THEN list_filter(string_split(array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{_COMMENT}') THEN x ELSE chr(1) END), chr(10)), chr(1)),
 lambda b: regexp_matches(b, '{_SPEAKS}') AND contains(trim(b, chr(10)), chr(10))) ELSE [] END AS blocks FROM g),
e AS (SELECT doc_id, path, size, 0 AS kind, unnest(mine) AS line FROM f UNION ALL SELECT doc_id, path, size, 1, unnest(blocks) FROM f),
l AS (SELECT line, count(*) AS uses FROM e GROUP BY 1),
m(template, license, line) AS (VALUES {_VALUES}),
lt AS (SELECT line, uses, term, count(*) AS tf FROM (SELECT line, uses, unnest({_TERMS.format("line")}) AS term FROM l) GROUP BY ALL),
mt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_TERMS.format("line")}) AS term FROM m) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT coalesce(sum(uses), 0) FROM l) + {len(TEMPLATES)}) / sum(uses)) AS idf FROM (SELECT term, uses FROM lt UNION ALL SELECT term, 1 FROM mt) GROUP BY 1),
a AS (SELECT line, term, tf * idf AS w FROM lt JOIN idf USING (term)), b AS (SELECT template, license, term, tf * idf AS v FROM mt JOIN idf USING (term)),
c AS (SELECT a.line, b.license, round(sum(w * v) / (any_value(na.x) * any_value(nb.x)), 9) AS score FROM a JOIN b USING (term) JOIN (SELECT line, sqrt(sum(w ** 2)) AS x FROM a GROUP BY 1) na ON na.line = a.line
 JOIN (SELECT template, sqrt(sum(v ** 2)) AS x FROM b GROUP BY 1) nb ON nb.template = b.template GROUP BY a.line, b.template, b.license),
k AS (SELECT line, license, score FROM c QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
s AS (SELECT e.doc_id, e.path, e.size, e.kind, e.line, k.license, k.score FROM e JOIN k ON k.line = e.line WHERE k.score >= 0.6),
own AS (SELECT doc_id, any_value(path) AS path, any_value(size) AS size, sum(CASE WHEN kind = 0 THEN length(line) ELSE 0 END) AS stated, first(license ORDER BY score DESC, license) AS own, max(score) AS own_score FROM s GROUP BY 1),
r AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, first(own ORDER BY own_score DESC, own) AS dir_license, max(own_score) AS dir_score FROM own WHERE stated >= 0.8 * size GROUP BY 1),
up AS (SELECT f.doc_id, d AS directory, unnest(range(len(p))) AS steps, unnest(p) AS dir FROM (SELECT doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, list_transform(range(len(string_split(path, '/')) - 1, -1, -1), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/')) AS p FROM f) f),
n AS (SELECT up.doc_id, r.directory, dir_license, dir_score FROM up JOIN r ON r.directory = up.dir QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY steps) = 1)
SELECT f.doc_id, f.path, coalesce(own, dir_license) AS license, coalesce(own_score, dir_score) AS score, CASE WHEN own IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN own IS NULL THEN n.directory END AS directory
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN n USING (doc_id)"""



def _round(i: int) -> str:
    """One round: ``a`` has each vector's nearest centroid of ``c``, and the next ``c`` the floored means."""
    return f"""d{i} AS MATERIALIZED (SELECT r, c, sum((x - y) * (x - y)) AS distance FROM x JOIN c{i} USING (i) GROUP BY 1, 2),
a{i} AS MATERIALIZED (SELECT r, c, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1),
s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{i} LEFT JOIN s{i} USING (c, i))"""


CENTROIDS = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
x AS MATERIALIZED (SELECT r, i, CAST(v[i] AS HUGEINT) AS x FROM v, (SELECT unnest(range(1, 65)) AS i)),
c0 AS MATERIALIZED (SELECT c, i, CAST(v[i] AS HUGEINT) AS y FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < 16), (SELECT unnest(range(1, 65)) AS i)),
{", ".join(_round(i) for i in range(4))},
g AS (SELECT c, sum(distance) AS inertia FROM a3 GROUP BY 1), h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS digest FROM c3 GROUP BY 1)
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(g.inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(inertia) FROM g) AS BIGINT) AS inertia, digest AS centroid_sha256
FROM v JOIN a3 USING (r) JOIN g ON g.c = a3.c JOIN h ON h.c = a3.c"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"


RANKED = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS terms FROM documents),
s AS (SELECT CAST(count_if(len(terms) > 0) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
p AS MATERIALIZED (SELECT r, doc_id, size, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS size, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT row_number() OVER () AS q, item_id, {_terms("text")} AS terms FROM benchmark),
t AS (SELECT q, item_id, term, count(*) AS uses FROM (SELECT q, item_id, unnest(terms) AS term FROM q) GROUP BY ALL),
w AS (SELECT q, item_id, term, uses, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM t JOIN f USING (term), s),
g AS (SELECT q, item_id, r, doc_id, CAST(sum(uses * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * docs) // total)))) AS BIGINT) AS score FROM w JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0 QUALIFY rank <= 20"""

ORACLE_SQL = {"op12_ranked_search": RANKED, "op13_centroid_clusters": CENTROIDS, "op4_license_scan": LICENSES, "op9_source_mix": MIX, "op10_url_reputation": URLS}
