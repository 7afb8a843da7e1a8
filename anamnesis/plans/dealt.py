"""Queries of the general data problems: attribute history (1) and hierarchies (5)."""

from __future__ import annotations

from anamnesis.operators.hierarchy import link_hierarchy
from anamnesis.operators.history import note_history
from anamnesis.session import table


def p1_found(spark, sf_dir):
    return note_history(table(spark, sf_dir, "notes"))


def p5_found(spark, sf_dir):
    return link_hierarchy(table(spark, sf_dir, "summaries"), table(spark, sf_dir, "summary_parents"), "summary_id", "summary_id", "parent_summary_id")


P1_SQL = """
WITH RECURSIVE r AS (
  SELECT note_id, epoch_us(created_at) c, epoch_us(updated_at) u, superseded_by s,
         epoch_us(coalesce(updated_at, created_at)) t,
         [coalesce('1' || category, '0'), coalesce('1' || content, '0'), coalesce('1' || confidence, '0'), coalesce('1' || owner, '0')] st
  FROM notes WHERE note_id IS NOT NULL AND coalesce(updated_at, created_at) IS NOT NULL),
b AS (SELECT note_id, coalesce(min(c), min(u)) b FROM r GROUP BY 1),
nx AS (
  SELECT r.note_id, r.s, b.b, o.b ob, min(r.t) set_at FROM r JOIN b USING (note_id) LEFT JOIN b o ON o.note_id = r.s
  WHERE r.s IS NOT NULL GROUP BY ALL),
e AS (
  SELECT b.note_id, b.b,
    (SELECT min(ob) FROM nx WHERE nx.note_id = b.note_id AND ob > nx.b) next_b,
    (SELECT arg_min(s, ob) FROM nx WHERE nx.note_id = b.note_id AND ob > nx.b) next_id,
    (SELECT min(set_at) FROM nx WHERE nx.note_id = b.note_id AND ob IS NULL) out_at
  FROM b),
d AS (SELECT note_id, t, any_value(st) st FROM r GROUP BY 1, 2),
w AS (SELECT *, lag(st) OVER x p, row_number() OVER x k FROM d WINDOW x AS (PARTITION BY note_id ORDER BY t)),
v AS (
  SELECT w.note_id, CASE WHEN k = 1 THEN e.b ELSE t END f, coalesce(next_b, out_at, -1) en
  FROM w JOIN e USING (note_id)
  WHERE k = 1 OR (st <> p AND (coalesce(next_b, out_at) IS NULL OR t < coalesce(next_b, out_at)))),
line AS (
  SELECT note_id, note_id root, 0 pos FROM e WHERE note_id NOT IN (SELECT next_id FROM e WHERE next_id IS NOT NULL)
  UNION ALL
  SELECT e.next_id, line.root, pos + 1 FROM line JOIN e ON e.note_id = line.note_id WHERE e.next_id IS NOT NULL)
SELECT root AS root_note_id, row_number() OVER (PARTITION BY root ORDER BY pos, f) AS version_no, v.note_id,
  f AS valid_from_us, coalesce(lead(f) OVER (PARTITION BY v.note_id ORDER BY f), en) AS valid_to_us
FROM v JOIN line ON line.note_id = v.note_id
"""

P5_SQL = """
WITH RECURSIVE n AS (SELECT DISTINCT summary_id id FROM summaries WHERE summary_id IS NOT NULL),
l AS (SELECT DISTINCT summary_id p, parent_summary_id c FROM summary_parents
      WHERE summary_id IN (SELECT id FROM n) AND parent_summary_id IN (SELECT id FROM n)),
reach AS (SELECT p, c FROM l UNION SELECT reach.p, l.c FROM reach JOIN l ON l.p = reach.c),
circ AS (SELECT p id FROM reach WHERE p = c),
bad AS (SELECT id FROM circ UNION SELECT c FROM reach WHERE p IN (SELECT id FROM circ)),
below AS (SELECT p, count(*) k FROM reach GROUP BY 1),
way AS (
  SELECT id, id root, 0 lev, id path FROM n WHERE id NOT IN (SELECT c FROM l) AND id NOT IN (SELECT id FROM bad)
  UNION ALL
  SELECT l.c, root, lev + 1, path || '/' || l.c FROM way JOIN l ON l.p = way.id WHERE l.c NOT IN (SELECT id FROM bad))
SELECT id AS summary_id, root AS root_id, lev::BIGINT AS node_level, path AS node_path, coalesce(k, 0)::BIGINT AS n_below
FROM way LEFT JOIN below ON below.p = way.id
UNION ALL SELECT id, '', -1, '', -1 FROM bad
"""

QUERIES = {"p1_found": p1_found, "p5_found": p5_found}
SQL = {"p1_found": P1_SQL, "p5_found": P5_SQL}
