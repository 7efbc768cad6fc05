"""DuckDB SQL for the registered queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]|[^\x00-\x7F]') AS c,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM g),
x AS (SELECT r, ms.m, unnest(range(1, len(w) - ms.m + 2)) AS i, w FROM d, ms WHERE len(w) >= ms.m),
h AS (SELECT x.r, x.i, x.m, g.item FROM (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS gram FROM x) x JOIN g ON g.m = x.m AND g.gram = x.gram),
hw AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
    sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.r = d.r LEFT JOIN hi ON hi.r = d.r
"""

ORACLES["op7_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS lo FROM x GROUP BY g),
c AS (SELECT DISTINCT r, k FROM (SELECT x.r, unnest(range(x.i, x.i + 50)) AS k FROM x JOIN m ON m.g = x.g WHERE x.doc_id > m.lo)),
k AS (SELECT e.r, string_agg(e.word, ' ' ORDER BY e.k) AS kept, count(*) AS n
    FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) e ANTI JOIN c ON c.r = e.r AND c.k = e.k GROUP BY e.r)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""

ORACLES["op9_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS k FROM d),
l AS (SELECT r, line, k, doc_id::hugeint * 1000000000 + k AS pos,
    regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM x),
f AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, len(any_value(w)) AS n, min(pos) AS fst FROM l WHERE len(w) >= 1 GROUP BY 1),
v AS (SELECT s, n, fst, i, array_to_string(w[:i - 1] || w[i + 1:], ' ') AS less FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 5)),
sub AS (SELECT n, i, less, min(fst) AS least FROM v GROUP BY ALL HAVING count(*) > 1),
near AS (SELECT v.s FROM v JOIN sub ON sub.n = v.n AND sub.i = v.i AND sub.less = v.less WHERE v.fst > sub.least
    UNION SELECT v.s FROM v JOIN f ON f.s = v.less AND f.n >= 5 WHERE f.fst < v.fst
    UNION SELECT f.s FROM f JOIN v ON v.less = f.s WHERE f.n >= 5 AND v.fst < f.fst),
g AS (SELECT l.r, l.k, l.line, len(l.w) >= 1 AND (l.pos > f.fst OR near.s IS NOT NULL) AS gone
    FROM l LEFT JOIN f ON f.s = array_to_string(l.w, ' ') LEFT JOIN near ON near.s = f.s),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY k) FILTER (NOT coalesce(gone, false)) AS text, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed FROM g GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.ls IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
"""

# the pages of these tables have one article element each, and nothing in it is left out
ORACLES["op6_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|br|h1)>', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM b)
SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(h, '\s+', ' ', 'g'))) AS n_chars FROM c
"""
