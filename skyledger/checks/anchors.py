"""Anchor selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import anchors
from skyledger.plans.views import load, oracle
from skyledger.session import cut

QUERIES = {}
ORACLES = {}

CHOSEN = """
pool AS (SELECT * FROM anchor_pool WHERE lower(trim(reporting_type)) <> 'arp'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY lat) AS rn, count(*) OVER (PARTITION BY edition) AS n FROM pool),
med AS (SELECT edition, lat AS med, n FROM ranked WHERE rn = n // 2 + 1),
half AS (
  SELECT p.*, 'north' AS sheet FROM pool p JOIN med m ON m.edition = p.edition WHERE p.lat >= m.med
  UNION ALL SELECT p.*, 'south' AS sheet FROM pool p JOIN med m ON m.edition = p.edition WHERE p.lat < m.med
),
span AS (SELECT edition, sheet, min(lat) AS lo, max(lat) AS hi FROM half GROUP BY 1, 2),
cand AS (
  SELECT h.* FROM half h JOIN span s ON s.edition = h.edition AND s.sheet = h.sheet
  WHERE CASE WHEN h.sheet = 'north' THEN h.lat >= lo + (hi - lo) / 3 ELSE h.lat <= lo + (hi - lo) * 2 / 3 END
)"""
QUERIES["anchor_candidates"] = lambda spark, sf: anchors.anchor_candidates(load(spark, sf, "anchor_pool")).select(
    "edition", "sheet", "ord", "code"
)
ORACLES["anchor_candidates"] = oracle(
    "WITH " + CHOSEN.lstrip() + " SELECT edition, sheet, ord, code FROM cand", "anchor_pool"
)
PAIRED = CHOSEN + """,
middle AS (SELECT edition, sheet, avg(lat) AS mid FROM cand GROUP BY 1, 2),
pair AS (
  SELECT a.edition, a.sheet, a.code AS ac, b.code AS bc, a.ord AS ao, b.ord AS bo, mid,
    sqrt(pow((a.lon - b.lon) * cos(radians(mid)) * 111, 2) + pow((a.lat - b.lat) * 111, 2)) AS km
  FROM cand a JOIN cand b ON a.edition = b.edition AND a.sheet = b.sheet AND a.ord < b.ord JOIN middle m ON m.edition = a.edition AND m.sheet = a.sheet
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY edition, sheet ORDER BY CASE WHEN km BETWEEN 24 AND 88 THEN 0 WHEN km BETWEEN 18 AND 110 THEN 1 ELSE 2 END, abs(km - 48), ao, bo) AS rn
  FROM pair WHERE km BETWEEN 12 AND 180
)"""


def pairs(spark, sf):
    return anchors.anchor_pairs(anchors.anchor_candidates(load(spark, sf, "anchor_pool"))).select(
        "edition", "sheet", "first_code", "second_code", F.round("km", 6).alias("km")
    )


QUERIES["anchor_pairs"] = pairs
ORACLES["anchor_pairs"] = oracle("WITH " + PAIRED.lstrip() + """
SELECT edition, sheet, CASE WHEN lower(ac) > lower(bc) THEN bc ELSE ac END AS first_code, CASE WHEN lower(ac) > lower(bc) THEN ac ELSE bc END AS second_code, round(km, 6) AS km
FROM best WHERE rn = 1
""", "anchor_pool")


def spread(spark, sf):
    cand = cut(anchors.anchor_candidates(load(spark, sf, "anchor_pool")))
    return anchors.spread_anchors(cand, anchors.anchor_pairs(cand), 4).select("edition", "sheet", "pos", "code")


_far = lambda c: f"sqrt(pow((c.lon - {c}.lon) * cos(radians(mid)) * 111, 2) + pow((c.lat - {c}.lat) * 111, 2))"
QUERIES["anchor_spread"] = spread
ORACLES["anchor_spread"] = oracle("WITH " + PAIRED.lstrip() + f""",
seed AS (
  SELECT edition, sheet, mid, CASE WHEN lower(ac) > lower(bc) THEN bo ELSE ao END AS o0, CASE WHEN lower(ac) > lower(bc) THEN ao ELSE bo END AS o1 FROM best WHERE rn = 1
),
third AS (
  SELECT s.*, c.ord AS o2, row_number() OVER (PARTITION BY s.edition, s.sheet ORDER BY least({_far('a')}, {_far('b')}) DESC, c.ord) AS rn
  FROM seed s JOIN cand a ON a.edition = s.edition AND a.sheet = s.sheet AND a.ord = o0 JOIN cand b ON b.edition = s.edition AND b.sheet = s.sheet AND b.ord = o1
  JOIN cand c ON c.edition = s.edition AND c.sheet = s.sheet AND c.ord NOT IN (o0, o1)
),
fourth AS (
  SELECT t.*, c.ord AS o3, row_number() OVER (PARTITION BY t.edition, t.sheet ORDER BY least({_far('a')}, {_far('b')}, {_far('d')}) DESC, c.ord) AS rn4
  FROM third t JOIN cand a ON a.edition = t.edition AND a.sheet = t.sheet AND a.ord = o0 JOIN cand b ON b.edition = t.edition AND b.sheet = t.sheet AND b.ord = o1
  JOIN cand d ON d.edition = t.edition AND d.sheet = t.sheet AND d.ord = o2
  JOIN cand c ON c.edition = t.edition AND c.sheet = t.sheet AND c.ord NOT IN (o0, o1, o2) WHERE t.rn = 1
),
flat AS (SELECT edition, sheet, unnest([0, 1, 2, 3]) AS pos, unnest([o0, o1, o2, o3]) AS ord FROM fourth WHERE rn4 = 1)
SELECT f.edition, f.sheet, CAST(pos AS INT) AS pos, c.code FROM flat f JOIN cand c ON c.edition = f.edition AND c.sheet = f.sheet AND c.ord = f.ord
""", "anchor_pool")
QUERIES["anchor_overlap"] = lambda spark, sf: anchors.overlap_anchors(load(spark, sf, "anchor_pool")).select(
    "edition", "pos", "code"
)
ORACLES["anchor_overlap"] = oracle("""
WITH u AS (
  SELECT *, count(*) OVER (PARTITION BY edition) AS n FROM anchor_pool
  WHERE lower(code) IN ('sdrot', 'ommer', 'engdi') AND lower(trim(reporting_type)) <> 'arp' AND lat BETWEEN 31.27e0 - 1e-9 AND 31.55e0 + 1e-9
)
SELECT edition, CAST(row_number() OVER (PARTITION BY edition ORDER BY lon, lower(code)) - 1 AS INT) AS pos, code FROM u WHERE n = 3
""", "anchor_pool")
