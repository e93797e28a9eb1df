"""Geo-referencing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import sqltext
from skyledger.operators import calib, tiles
from skyledger.plans.views import load, oracle

QUERIES = {}
ORACLES = {}

# Normal equations from raw centred sums (means first), unlike the operator's moments.
FITTED = sqltext.LCC.lstrip() + f""",
xy AS (SELECT a.*, {sqltext.lcc_x('lat', 'lon')} AS px, {sqltext.lcc_y('lat', 'lon')} AS py FROM anchor a, lcc),
mean AS (
  SELECT edition, sheet, count(*) AS n, count(DISTINCT upper(trim(code))) AS nc, avg(px) AS mx, avg(py) AS my, avg(u) AS mu, avg(v) AS mv
  FROM xy GROUP BY 1, 2
),
sums AS (
  SELECT edition, sheet, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv,
    sum((px - mx) * (px - mx)) AS xx, sum((px - mx) * (py - my)) AS xy_, sum((py - my) * (py - my)) AS yy,
    sum((px - mx) * (u - mu)) AS xu, sum((py - my) * (u - mu)) AS yu, sum((px - mx) * (v - mv)) AS xv, sum((py - my) * (v - mv)) AS yv
  FROM xy JOIN mean USING (edition, sheet) WHERE n >= 3 AND nc = n GROUP BY edition, sheet
),
coef AS (
  SELECT *, (yy * xu - xy_ * yu) / det AS a, (xx * yu - xy_ * xu) / det AS b, (yy * xv - xy_ * yv) / det AS c, (xx * yv - xy_ * xv) / det AS d
  FROM (SELECT *, xx * yy - xy_ * xy_ AS det FROM sums) q WHERE abs(det) >= 1e-18
),
aff AS (
  SELECT edition, sheet, n, a, b, c, d, mu - a * mx - b * my AS tx, mv - c * mx - d * my AS ty, a * d - b * c AS dd
  FROM coef WHERE abs(a * d - b * c) >= 1e-18
),
fit AS (SELECT *, d / dd AS ia, -b / dd AS ib, -c / dd AS ic, a / dd AS id, -(d / dd * tx - b / dd * ty) AS itx, -(-c / dd * tx + a / dd * ty) AS ity FROM aff)"""


def _fits(spark, sf):
    return calib.fit_sheets(load(spark, sf, "anchor"))


def sheet_fits(spark, sf):
    return _fits(spark, sf).select(
        "edition", "sheet", "n_anchors",
        *[(F.round(c, 5) + 0.0).alias(c) for c in ("a", "b", "c", "d", "tx", "ty", "ia", "ib", "ic", "id")],
        F.round("residual_uv", 7).alias("residual_uv"),
    )


QUERIES["sheet_fits"] = sheet_fits
ORACLES["sheet_fits"] = oracle("WITH " + FITTED + """,
res AS (
  SELECT edition, sheet, sqrt(sum(pow(a * px + b * py + tx - u, 2) + pow(c * px + d * py + ty - v, 2)) / count(*)) AS r
  FROM xy JOIN fit USING (edition, sheet) GROUP BY 1, 2
)
SELECT edition, sheet, n AS n_anchors, round(a, 5) + 0e0 AS a, round(b, 5) + 0e0 AS b, round(c, 5) + 0e0 AS c, round(d, 5) + 0e0 AS d, round(tx, 5) + 0e0 AS tx, round(ty, 5) + 0e0 AS ty,
  round(ia, 5) + 0e0 AS ia, round(ib, 5) + 0e0 AS ib, round(ic, 5) + 0e0 AS ic, round(id, 5) + 0e0 AS id, round(r, 7) AS residual_uv
FROM fit JOIN res USING (edition, sheet)
""", "anchor")


def overlap(spark, sf):
    return calib.align_overlap(load(spark, sf, "anchor"), load(spark, sf, "sheet_size")).select(
        "edition", "n_shared", F.round("scale", 6).alias("scale"), F.round("shift_x", 4).alias("shift_x"),
        F.round("shift_y", 4).alias("shift_y"), F.round("residual_px", 4).alias("residual_px"),
    )


# Cramer's rule on the 3 x 3 normal equations of (scale, shift_x, shift_y).
QUERIES["overlap_alignment"] = overlap
ORACLES["overlap_alignment"] = oracle("""
WITH sh AS (
  SELECT n.edition, s.u * south_w - south_w / 2 AS ax, s.v * south_h - south_h / 2 AS ay, n.u * north_w - south_w / 2 AS bx, n.v * north_h - south_h / 2 AS by_
  FROM anchor n JOIN anchor s ON n.edition = s.edition AND upper(trim(n.code)) = upper(trim(s.code)) JOIN sheet_size z ON z.edition = n.edition
  WHERE n.sheet = 'north' AND s.sheet = 'south'
),
m AS (
  SELECT edition, count(*) AS n, sum(ax * ax + ay * ay) AS q, sum(ax) AS sx, sum(ay) AS sy, sum(ax * bx + ay * by_) AS ab, sum(bx) AS tx, sum(by_) AS ty
  FROM sh GROUP BY 1
),
sol AS (
  SELECT edition, n, (ab * n * n - sx * tx * n - sy * ty * n) / det AS scale,
    (q * tx * n - sx * ab * n + sx * sy * ty - sy * sy * tx) / det AS shift_x, (q * n * ty - sx * sx * ty + sx * tx * sy - sy * n * ab) / det AS shift_y
  FROM (SELECT *, q * n * n - sx * sx * n - sy * sy * n AS det FROM m WHERE n >= 2) d WHERE abs(det) >= 1e-18
)
SELECT edition, any_value(sol.n) AS n_shared, round(any_value(scale), 6) AS scale, round(any_value(shift_x), 4) AS shift_x, round(any_value(shift_y), 4) AS shift_y,
  round(sqrt(sum(pow(ax * scale + shift_x - bx, 2) + pow(ay * scale + shift_y - by_, 2)) / count(*)), 4) AS residual_px
FROM sh JOIN sol USING (edition) WHERE scale > 0 GROUP BY edition
""", "anchor", "sheet_size")


def _layout(spark, sf):
    """Fits with pixel sizes; the south sheet is scaled and moved under the north one."""
    size = load(spark, sf, "sheet_size")
    north = F.col("sheet") == "north"
    return (
        _fits(spark, sf)
        .join(size, "edition")
        .withColumn("width", F.when(north, F.col("north_w")).otherwise(F.col("south_w")))
        .withColumn("height", F.when(north, F.col("north_h")).otherwise(F.col("south_h")))
        .withColumn("pos_x", F.when(north, 0.0).otherwise(30.0))
        .withColumn("pos_y", F.when(north, 0.0).otherwise(4500.0))
        .withColumn("scale", F.when(north, 1.0).otherwise(0.97))
    )


LAID = FITTED + """,
laid AS (
  SELECT f.*, CASE WHEN sheet = 'north' THEN north_w ELSE south_w END AS width, CASE WHEN sheet = 'north' THEN north_h ELSE south_h END AS height,
    CASE WHEN sheet = 'north' THEN 0e0 ELSE 30e0 END AS pos_x, CASE WHEN sheet = 'north' THEN 0e0 ELSE 4500e0 END AS pos_y,
    CASE WHEN sheet = 'north' THEN 1e0 ELSE 0.97e0 END AS scale
  FROM fit f JOIN sheet_size z ON z.edition = f.edition
)"""


def projected(spark, sf):
    items = load(spark, sf, "chart_item").select("item_id", "edition", "sheet", "u", "v")
    return calib.project_arrows(items, _fits(spark, sf)).select(
        "item_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


_X = "ia * i.u + ib * i.v + itx"
_Y = "ic * i.u + id * i.v + ity"
QUERIES["uv_to_position"] = projected
ORACLES["uv_to_position"] = oracle("WITH " + FITTED + f"""
SELECT item_id, round({sqltext.unlcc_lat(_X, _Y)}, 6) AS lat, round({sqltext.unlcc_lon(_X, _Y)}, 6) AS lon
FROM chart_item i JOIN fit f ON f.edition = i.edition AND f.sheet = i.sheet, lcc
""", "anchor", "chart_item")


def _assigned(mode, cols):
    def run(spark, sf):
        items = load(spark, sf, "chart_item").select("item_id", "edition", *cols)
        out = calib.assign_sheet(items, _layout(spark, sf), mode)
        extra = ["on_chart"] if mode == "centre" else []
        geo_cols = ["lat", "lon"] if mode == "scene" else []
        return out.select(
            "item_id", "sheet", *[(F.round(c, 9) + 0.0).alias(c) for c in ("u", "v", *geo_cols)], *extra
        )

    return run


SEEN = LAID + f""",
seen AS (
  SELECT i.item_id, f.sheet, a * {sqltext.lcc_x('i.lat', 'i.lon')} + b * {sqltext.lcc_y('i.lat', 'i.lon')} + tx AS u,
    c * {sqltext.lcc_x('i.lat', 'i.lon')} + d * {sqltext.lcc_y('i.lat', 'i.lon')} + ty AS v
  FROM chart_item i JOIN laid f ON f.edition = i.edition, lcc
)"""
QUERIES["assign_sheet_scene"] = _assigned("scene", ["scene_x", "scene_y"])
ORACLES["assign_sheet_scene"] = oracle("WITH " + LAID + f""",
loc AS (
  SELECT i.item_id, f.*, (i.scene_x - pos_x - (1 - scale) * width / 2) / scale / width AS u, (i.scene_y - pos_y - (1 - scale) * height / 2) / scale / height AS v
  FROM chart_item i JOIN laid f ON f.edition = i.edition
),
pick AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sheet DESC) AS rn FROM loc WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1)
SELECT item_id, sheet, round(u, 9) + 0e0 AS u, round(v, 9) + 0e0 AS v,
  round({sqltext.unlcc_lat('ia * u + ib * v + itx', 'ic * u + id * v + ity')}, 9) AS lat,
  round({sqltext.unlcc_lon('ia * u + ib * v + itx', 'ic * u + id * v + ity')}, 9) AS lon
FROM pick, lcc WHERE rn = 1
""", "anchor", "sheet_size", "chart_item")
QUERIES["assign_sheet_position"] = _assigned("position", ["lat", "lon"])
ORACLES["assign_sheet_position"] = oracle("WITH " + SEEN + """
SELECT item_id, sheet, round(u, 9) + 0e0 AS u, round(v, 9) + 0e0 AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN 0 ELSE 1 END, sheet DESC) AS rn FROM seen
) t WHERE rn = 1
""", "anchor", "sheet_size", "chart_item")
QUERIES["assign_sheet_centre"] = _assigned("centre", ["lat", "lon"])
ORACLES["assign_sheet_centre"] = oracle("WITH " + SEEN + """,
scored AS (
  SELECT *, u BETWEEN -0.01e0 AND 1.01e0 AND v BETWEEN -0.01e0 AND 1.01e0 AS inb, sqrt(pow(u - 0.5e0, 2) + pow(v - 0.5e0, 2)) AS cd,
    sqrt(pow(greatest(0e0, -u, u - 1), 2) + pow(greatest(0e0, -v, v - 1), 2)) AS od FROM seen
)
SELECT item_id, sheet, round(u, 9) + 0e0 AS u, round(v, 9) + 0e0 AS v, inb AS on_chart FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN inb THEN 0 ELSE 1 END, CASE WHEN inb THEN cd ELSE od END, sheet) AS rn FROM scored
) t WHERE rn = 1
""", "anchor", "sheet_size", "chart_item")


def seam(spark, sf):
    layout = load(spark, sf, "sheet_size").select(
        "edition", F.lit(4700.0).alias("seam_y"), F.lit(90.0).alias("extension_px"), F.col("north_h").alias("north_height")
    )
    items = load(spark, sf, "chart_item").select("item_id", "edition", "lat", "lon")
    return calib.seam_owner(items, _fits(spark, sf), layout).select("item_id", "north_keeps", "south_keeps")


QUERIES["seam_owner"] = seam
ORACLES["seam_owner"] = oracle("WITH " + FITTED + f""",
y AS (
  SELECT i.item_id, (c * {sqltext.lcc_x('i.lat', 'i.lon')} + d * {sqltext.lcc_y('i.lat', 'i.lon')} + ty) * north_h AS y
  FROM lcc, chart_item i JOIN sheet_size z ON z.edition = i.edition LEFT JOIN fit f ON f.edition = i.edition AND f.sheet = 'north'
)
SELECT item_id, y IS NOT NULL AND y < 4790 AS north_keeps, y IS NULL OR y >= 4700 AS south_keeps FROM y
""", "anchor", "sheet_size", "chart_item")


def placement(spark, sf):
    t = load(spark, sf, "chart_item").select("edition", "sheet", "z", "x", "y")
    cols = ("m11", "m12", "m21", "m22", "m31", "m32", "residual_px")
    return tiles.tile_placement(t, _layout(spark, sf)).select(
        "edition", "sheet", "z", "x", "y", *[F.round(c, 4).alias(c) for c in cols]
    )


# The twin solves the two perspective terms first and substitutes back corner by corner.
_corner = lambda fx, fy: (
    f"degrees(atan(sinh(pi() * (1e0 - 2e0 * (t.y + {fy}) / pow(2e0, t.z)))))",
    f"((t.x + {fx}) / pow(2e0, t.z) * 360e0 - 180e0)",
)


def _px(n, fx, fy):
    la, lo = _corner(fx, fy)
    x, y = sqltext.lcc_x(la, lo), sqltext.lcc_y(la, lo)
    return f"(a * {x} + b * {y} + tx) * width AS x{n}, (c * {x} + d * {y} + ty) * height AS y{n}"


QUERIES["tile_placement"] = placement
ORACLES["tile_placement"] = oracle("WITH " + LAID + f""",
q AS (
  SELECT t.edition, t.sheet, t.z, t.x, t.y, {_px(0, '0e0', '0e0')}, {_px(1, '1e0', '0e0')}, {_px(2, '1e0', '1e0')}, {_px(3, '0e0', '1e0')}, {_px(4, '0.5e0', '0.5e0')}
  FROM chart_item t JOIN laid f ON f.edition = t.edition AND f.sheet = t.sheet, lcc
),
p AS (
  SELECT *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS g,
    ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS h FROM q
),
m AS (SELECT *, (x1 * (1 + g) - x0) / 256 AS m11, (y1 * (1 + g) - y0) / 256 AS m12, (x3 * (1 + h) - x0) / 256 AS m21, (y3 * (1 + h) - y0) / 256 AS m22 FROM p)
SELECT edition, sheet, z, x, y, round(m11, 4) AS m11, round(m12, 4) AS m12, round(m21, 4) AS m21, round(m22, 4) AS m22, round(x0, 4) AS m31, round(y0, 4) AS m32,
  round(sqrt(pow((m11 * 128 + m21 * 128 + x0) / (g / 2 + h / 2 + 1) - x4, 2) + pow((m12 * 128 + m22 * 128 + y0) / (g / 2 + h / 2 + 1) - y4, 2)), 4) AS residual_px
FROM m
""", "anchor", "sheet_size", "chart_item")


def under_sheets(spark, sf):
    return tiles.sheet_tiles(_fits(spark, sf), [9])


QUERIES["sheet_tiles"] = under_sheets
_cu = lambda u, v: (f"ia * {u} + ib * {v} + itx", f"ic * {u} + id * {v} + ity")
_lats = ", ".join(sqltext.unlcc_lat(*_cu(u, v)) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)))
_lons = ", ".join(sqltext.unlcc_lon(*_cu(u, v)) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)))
ORACLES["sheet_tiles"] = oracle("WITH " + FITTED + f""",
hull AS (SELECT edition, sheet, least({_lats}) AS la0, greatest({_lats}) AS la1, least({_lons}) AS lo0, greatest({_lons}) AS lo1 FROM fit, lcc),
cols AS (
  SELECT edition, sheet, unnest(generate_series({sqltext.tile_x('lo0', '9')}, {sqltext.tile_x('lo1', '9')})) AS x, {sqltext.tile_y('la1', '9')} AS y0, {sqltext.tile_y('la0', '9')} AS y1
  FROM hull
)
SELECT edition, sheet, 9 AS z, CAST(x AS INT) AS x, CAST(unnest(generate_series(y0, y1)) AS INT) AS y FROM cols
""", "anchor")
