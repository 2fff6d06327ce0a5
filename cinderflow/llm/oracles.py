"""SQL (DuckDB) for the queries that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_suffix_trees": f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM hit)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n.n, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_induced_sort": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 198)) AS i FROM d WHERE len(h) >= 400)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
run AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS new FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM (SELECT doc_id, i, sum(new::int) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM run) GROUP BY doc_id, k),
edge AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a + 1) AS n, count(*) AS c FROM span GROUP BY doc_id),
part AS (SELECT d.doc_id, array_to_string(list_transform(range(0, len(a) + 1), lambda k: substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * b[k] + 1 END, CASE WHEN k = len(a) THEN len(h) ELSE 2 * (a[k + 1] - 1 - CASE WHEN k = 0 THEN 0 ELSE b[k] END) END)), '') AS t FROM d JOIN edge USING (doc_id))
SELECT d.doc_id, (len(h) // 2)::bigint AS n_bytes, coalesce(edge.n, 0)::bigint AS n_removed, coalesce(c, 0)::bigint AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN edge USING (doc_id) LEFT JOIN part USING (doc_id)""",
    "op7_setsketch": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=FOLDED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b),
low AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, low.c AS component_id, low.c = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN low ON low.id = d.doc_id""",
    "op11_conversation_repair": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda ch: ord(ch)::bigint)), lambda acc, b: list_reduce(list_prepend(xor(acc, b), [k::bigint for k in range(8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::bigint) ELSE x >> 1 END)), 4294967295::bigint) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare, left(role, 1) AS initial FROM d),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM faulty GROUP BY conv_id),
legal(s, r, t) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
chain AS (SELECT s, s AS t, '' AS made FROM (VALUES ('-'), ('s'), ('u'), ('a')) AS x(s) UNION ALL SELECT s, t, r FROM legal WHERE r <> 's' UNION ALL SELECT x.s, y.t, x.r || y.r FROM legal x JOIN legal y ON y.s = x.t WHERE x.r <> 's' AND y.r <> 's'),
way AS (SELECT chain.s, own.role AS own, legal.t, 2 * len(made) + act.cost AS cost, repeat('I', len(made)) || act.letter AS letters FROM chain JOIN legal ON legal.s = chain.t CROSS JOIN (VALUES ('s'), ('u'), ('a'), ('x')) AS own(role) JOIN (VALUES ('K', 0), ('R', 2)) AS act(letter, cost) ON (letter = 'K' AND legal.r = own.role) OR (letter = 'R' AND legal.r <> 's')),
walk AS (
  SELECT conv_id, 0::bigint AS i, '-' AS s, {'cost': 0::bigint, 'audit': ''} AS best FROM facts
  UNION ALL
  SELECT w.conv_id, w.i + 1, o.t, min({'cost': w.best.cost + o.cost, 'audit': w.best.audit || o.letters})
  FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN (SELECT s, own, false AS must, t, cost, letters FROM way UNION ALL SELECT x.s, own, must, x.s, 3, 'D' FROM (VALUES ('-'), ('s'), ('u'), ('a')) AS x(s), (VALUES ('s'), ('u'), ('a'), ('x')) AS y(own), (VALUES (true), (false)) AS z(must)) AS p
    ON p.s = w.s AND p.own = CASE WHEN f.initial IN ('s', 'u', 'a') THEN f.initial ELSE 'x' END AND p.must = (f.fault IN ('blank', 'duplicate'))
  CROSS JOIN LATERAL (SELECT p.t, p.letters, p.cost + CASE WHEN f.fault = 'truncated' AND p.letters <> 'D' THEN 1 ELSE 0 END AS cost) AS o
  GROUP BY w.conv_id, w.i, o.t),
done AS (SELECT walk.conv_id, min({'cost': best.cost + 2 * n, 'audit': best.audit || repeat('I', n)}) AS best FROM walk JOIN facts ON facts.conv_id IS NOT DISTINCT FROM walk.conv_id AND i = size JOIN (VALUES ('-', 0), ('a', 0), ('u', 1), ('s', 2)) AS e(s, n) USING (s) GROUP BY walk.conv_id),
letter AS (SELECT conv_id, k, x, sum((x <> 'I')::int) OVER (PARTITION BY conv_id ORDER BY k) AS i, sum((x <> 'D')::int) OVER (PARTITION BY conv_id ORDER BY k) AS nth FROM (SELECT conv_id, unnest(range(1, len(best.audit) + 1)) AS k, substr(best.audit, k, 1) AS x FROM done)),
turns AS (SELECT l.conv_id, k, x, nth, f.role, f.text, max(CASE WHEN x = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS sys FROM letter l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE x <> 'D'),
rebuilt AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (nth - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(best.cost, 0)::bigint AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rebuilt ON rebuilt.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
