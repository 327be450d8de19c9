"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g FROM d WHERE len(w) > 0),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
  e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS doc_id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id),
  k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: windows of ten words, found exactly, and nearly: each word within three of its place, two of ten may be missing
POSITIONAL = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  v AS MATERIALIZED (SELECT item_id, w[k + 1:k + 10] AS g, array_to_string(w[k + 1:k + 10], ' ') AS key FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
  x AS MATERIALIZED (SELECT key, any_value(g) AS g, any_value(len(g)) AS n FROM v GROUP BY key),
  a AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS spot FROM d, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
  h AS MATERIALIZED (SELECT doc_id, spot, x.n, key FROM (SELECT doc_id, spot, n, array_to_string(w[spot + 1:spot + n], ' ') AS key FROM a) b JOIN x USING (n, key)),
  y AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS p FROM h) GROUP BY doc_id),
  z AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM h JOIN v USING (key) GROUP BY doc_id),
  t AS (SELECT key, n, unnest(g) AS word, unnest(range(n)) AS k FROM x), o AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS spot FROM d),
  f AS MATERIALIZED (SELECT doc_id, key FROM (SELECT doc_id, unnest(list_distinct(w)) AS word FROM d) JOIN t USING (word) GROUP BY doc_id, key, n HAVING count(*) >= n - n * 2 // 10),
  c AS (SELECT doc_id, key FROM (SELECT doc_id, key, n, k, unnest(range(spot - k - 3, spot - k + 4)) AS start FROM f JOIN t USING (key) JOIN o USING (doc_id, word)) GROUP BY doc_id, key, n, start HAVING count(DISTINCT k) >= n - n * 2 // 10),
  q AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM c JOIN v USING (key) GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN q USING (doc_id)"""

ORACLES = {"op6_count_vector_join": NGRAM_JOIN, "op7_positional_index": POSITIONAL}
