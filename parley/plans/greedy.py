"""SQL of greedy scans over words: where a scan can act, where it goes on from there, and which words it leaves out.

A scan acts only at few places of a text. Window functions find these places and how far each one reaches; a recursive
query then goes from the first place to the next one behind its reach, so its steps are those of the scan.
"""

from __future__ import annotations

#: One row for each word of a table `{src}` (id, w), and whether it equals the word one to five places later.
WORDS = """p AS (SELECT id, i, w[i] AS x, len(w) AS n FROM {src}, unnest(range(1, len(w) + 1)) AS r(i)),
q AS (SELECT id, i, n, {same} FROM p WINDOW k AS (PARTITION BY id ORDER BY i)),"""

#: From places `e` (id, i, past: where the scan goes on, cut: first word left out) to the words that stay.
WALK = """f AS MATERIALIZED (SELECT e.id, e.i, e.cut, e.past, g.i AS following FROM e ASOF LEFT JOIN e g ON e.id = g.id AND e.past <= g.i),
t AS (SELECT id, i, cut, past, following FROM f WHERE i = (SELECT min(i) FROM e WHERE e.id = f.id)
  UNION ALL SELECT f.id, f.i, f.cut, f.past, f.following FROM t JOIN f ON f.id = t.id AND f.i = t.following),
gone AS (SELECT id, unnest(range(cut, past)) AS i FROM t),
kept AS (SELECT id, list(x ORDER BY i) AS w FROM p ANTI JOIN gone USING (id, i) GROUP BY id)"""


def _same(*steps: int) -> str:
    return ", ".join(f"coalesce(x = lead(x, {s}) OVER k, false) AS same{s}" for s in steps)


def phrases(src: str) -> str:
    """`kept` (id, w): phrases of two to five words that follow themselves are kept once, the shortest first."""
    whole = " ".join(f"WHEN sum(CAST(same{s} AS INTEGER)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {s - 1} FOLLOWING) = {s} THEN {s}" for s in range(2, 6))
    places = f"e AS MATERIALIZED (SELECT id, i, i + size AS cut, i + 2 * size AS past FROM (SELECT id, i, CASE {whole} END AS size FROM q) WHERE size IS NOT NULL),"
    return "\n".join([WORDS.format(src=src, same=_same(2, 3, 4, 5)), places, WALK])


def older(src: str) -> str:
    """`kept` (id, w): runs of a word and of a pair are kept once; a pair that ends the text stays after its run."""
    until = "min(i) FILTER (NOT same{s}) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    places = f"""z AS (SELECT *, {until.format(s=1)} AS last1, {until.format(s=2)} AS last2 FROM q),
e AS MATERIALIZED (SELECT id, i, i + 1 AS cut, last1 + 1 AS past FROM z WHERE same1
  UNION ALL SELECT id, i, i + 2, i + least((last2 - i) // 2 * 2 + 2, greatest(4, (n - i) // 2 * 2)) FROM z WHERE NOT same1 AND last2 - i >= 2),"""
    return "\n".join([WORDS.format(src=src, same=_same(1, 2)), places, WALK])
