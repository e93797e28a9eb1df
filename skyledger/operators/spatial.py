"""Point snapping and chart-arrow extraction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import grid

SHEET = ["edition", "sheet"]

# Fixed values.
SNAP_NM = 1.0
REMOVE_NM = 4.0
WHOLE_PLAN_ROWS = 64
ALTITUDE_MIN_FT, ALTITUDE_MAX_FT, ALTITUDE_STEP_FT = 300, 9500, 100
SIDE_MIN_PT, SIDE_MAX_PT, ASPECT_MAX = 4.0, 28.0, 4.0
PATH_ITEMS_MAX = 15
CURVE_OPS = ("c", "qu")
YELLOW_R_MIN, YELLOW_G_MIN, YELLOW_B_MAX = 0.85, 0.75, 0.55
CONCAVE_MIN_DEG = 25.0


def nearest_waypoint(points: DataFrame, waypoints: DataFrame, max_nm: float = SNAP_NM) -> DataFrame:
    """Closest waypoint strictly within ``max_nm``; ties go to the catalogue's order. Equal points keep a row each."""
    return grid.nearest(points, waypoints, max_nm, target_order="idx", target_cols=["code"])


def nearest_plan_point(clicks: DataFrame, points: DataFrame, max_nm: float = REMOVE_NM, whole_rows: int = WHOLE_PLAN_ROWS) -> DataFrame:
    """Closest point of the same plan, strictly within ``max_nm``, lowest position on ties.

    A plan of up to ``whole_rows`` points (``n_points``) is one row that its clicks are
    joined with and look through, so a click is shuffled once and has no copies. Clicks
    on longer plans meet points by grid cells.
    """
    if "n_points" not in points.columns:
        points = points.join(points.groupBy("plan_id").agg(F.count("*").alias("n_points")), "plan_id")
    longer = F.col("n_points") > whole_rows
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    plans = points.where(there & ~longer).groupBy("plan_id").agg(F.collect_list(F.struct("lat", "lon", "seq")).alias("_points"))
    # the distance is at least that of the parallels, which costs no trigonometry
    beside = F.filter("_points", lambda p: F.abs(p["lat"] - F.col("lat")) <= grid.band_height(max_nm))
    measured = F.transform(beside, lambda p: F.struct(geo.great_circle_nm(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("nm"), p["seq"].alias("seq")))
    best = F.array_min(F.filter(measured, lambda m: m["nm"] < max_nm))
    ids = points.where(longer).select("plan_id").distinct()
    whole = clicks.join(ids, "plan_id", "left_anti").join(plans, "plan_id", "left").select(*clicks.columns, F.explode(F.array(best)).alias("_best"))
    whole = whole.select(*clicks.columns, F.col("_best.seq").alias("near_seq"), F.col("_best.nm").alias("near_nm"))
    celled = grid.nearest(
        clicks.join(ids, "plan_id", "left_semi").select(*clicks.columns), points.where(longer), max_nm, keys=["plan_id"], target_order="seq", target_cols=["seq"], copy_points=True
    )
    return whole.unionByName(celled.select(*clicks.columns, "near_seq", "near_nm"))


# --- arrows printed on a chart ----------------------------------------------------------


def arrow_shapes(drawings: DataFrame) -> DataFrame:
    """Drawings that can be an altitude arrow: yellow, arrow-sized, straight-edged, simple."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rgb = [F.get("fill", i) for i in range(3)]
    return (
        drawings.where(w.between(SIDE_MIN_PT, SIDE_MAX_PT) & h.between(SIDE_MIN_PT, SIDE_MAX_PT))
        .where(F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-6)) <= ASPECT_MAX)
        .where((rgb[0] >= YELLOW_R_MIN) & (rgb[1] >= YELLOW_G_MIN) & (rgb[2] <= YELLOW_B_MAX))
        .where((F.size("items") <= PATH_ITEMS_MAX) & ~F.exists("items", lambda i: i["op"].isin(*CURVE_OPS)))
    )


def altitude_labels(spans: DataFrame) -> DataFrame:
    """Text spans that read as a plausible altitude, with their centre."""
    t = F.trim("text")
    alt = t.try_cast("int")
    return spans.where(
        t.rlike(r"^\d{1,5}$") & alt.between(ALTITUDE_MIN_FT, ALTITUDE_MAX_FT) & (alt % ALTITUDE_STEP_FT == 0)
    ).select(
        *SHEET, "span_id", alt.alias("altitude_ft"), F.col("y0").alias("top_y"),
        ((F.col("x0") + F.col("x1")) * 0.5).alias("cx"), ((F.col("y0") + F.col("y1")) * 0.5).alias("cy"),
    )


def labels_in_shapes(shapes: DataFrame, spans: DataFrame) -> DataFrame:
    """Altitudes printed inside each shape, top to bottom.

    Both sides are keyed by a square as large as the largest shape, so a shape
    is copied to at most a few squares and the join is an equi-join. Of two or
    more labels those below a third of the highest are fragments and go.
    """
    cell = lambda c: F.floor(c / SIDE_MAX_PT).cast("int")
    spread = (
        shapes.withColumn("gx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
        .withColumn("gy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    )
    labels = altitude_labels(spans).withColumn("gx", cell(F.col("cx"))).withColumn("gy", cell(F.col("cy")))
    rest = [c for c in shapes.columns if c not in (*SHEET, "drawing_id")]
    inside = spread.join(labels, [*SHEET, "gx", "gy"]).where(
        F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))
    )
    alts = F.transform(F.array_sort("_l"), lambda e: e["altitude_ft"])
    return (
        inside.groupBy(*SHEET, "drawing_id")
        .agg(
            F.first(F.struct(*rest)).alias("_s"),
            F.collect_list(F.struct("top_y", "span_id", "altitude_ft")).alias("_l"),
        )
        .select(*SHEET, "drawing_id", "_s.*", alts.alias("_alts"))
        .withColumn(
            "altitudes_ft", F.filter("_alts", lambda a: a >= F.floor(F.array_max("_alts") / 3))
        )
        .drop("_alts")
    )


def _vertices(items: Column) -> Column:
    """Outline points: the end of each line, the four corners of each rectangle."""

    def of(item: Column) -> Column:
        p = item["pts"]
        xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        a, b = F.get(p, 0), F.get(p, 1)
        corners = F.array(xy(a["x"], a["y"]), xy(b["x"], a["y"]), xy(b["x"], b["y"]), xy(a["x"], b["y"]))
        return (
            F.when(b.isNull(), F.array().cast("array<struct<x:double,y:double>>"))
            .when(item["op"] == "l", F.array(xy(b["x"], b["y"])))
            .when(item["op"] == "re", corners)
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )

    return F.flatten(F.transform(items, of))


def _signed_area2(ring: Column) -> Column:
    return F.aggregate(
        ring, F.lit(0.0), lambda s, c: s + c["p"]["x"] * c["next"]["y"] - c["next"]["x"] * c["p"]["y"]
    )


def with_outline(shapes: DataFrame) -> DataFrame:
    """Add direction and anchor of each shape, stage by stage.

    A notch (the sharpest concave corner, 25 degrees or more) makes a directed
    arrow pointing from the notch through the centre, anchored where the line
    from the centre through the notch leaves the box. Without a notch the shape
    is bidirectional: longest diagonal, anchored at the centre.
    """
    v, ring = F.col("_v"), F.col("_ring")
    n = F.size(v)
    cx, cy = (F.col("x0") + F.col("x1")) * 0.5, (F.col("y0") + F.col("y1")) * 0.5

    def corner(c: Column, i: Column) -> Column:
        e1x, e1y = c["p"]["x"] - c["prev"]["x"], c["p"]["y"] - c["prev"]["y"]
        e2x, e2y = c["next"]["x"] - c["p"]["x"], c["next"]["y"] - c["p"]["y"]
        return F.struct(
            (e1x * e2y - e1y * e2x).alias("turn"), F.hypot(e1x, e1y).alias("l1"), F.hypot(e2x, e2y).alias("l2"),
            (e1x * e2x + e1y * e2y).alias("dot"), i.alias("i"), c["p"].alias("p"),
        )

    def bend(c: Column) -> Column:
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c["dot"] / (c["l1"] * c["l2"])))
        return F.struct(F.acos(cos).alias("bend"), (-c["i"]).alias("first"), c["p"].alias("p"))

    def diagonals() -> Column:
        def from_vertex(a: Column, i: Column) -> Column:
            return F.transform(
                F.filter(v, lambda _, k: k > i),
                lambda b, j: F.struct(
                    (F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0))).alias("d2"),
                    (-i).alias("i"), (-j).alias("j"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"),
                ),
            )

        return F.array_max(F.flatten(F.transform(v, from_vertex)))

    def compass(dx: Column, dy: Column) -> Column:
        return F.pmod(F.degrees(F.atan2(dx, -dy)), F.lit(360.0))

    def edge(unit: Column, lo: Column, hi: Column, mid: Column) -> Column:
        step = F.when(unit > 1e-12, (hi - mid) / F.when(unit > 1e-12, unit)).when(
            unit < -1e-12, (lo - mid) / F.when(unit < -1e-12, unit)
        )
        return F.when(step > 0.0, step)

    area = F.col("_area")
    notch = F.col("_notch")
    norm = F.hypot(notch["x"] - cx, notch["y"] - cy)
    df = (
        shapes.withColumn("_v", _vertices(F.col("items")))
        .withColumn(
            "_ring",
            F.arrays_zip(
                v.alias("p"),
                F.concat(F.slice(v, F.greatest(n, F.lit(1)), F.lit(1)), F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("prev"),
                F.concat(F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(v, 1, 1)).alias("next"),
            ),
        )
        .withColumn("_area", _signed_area2(ring))
        .withColumn(
            "_bends",
            F.transform(
                F.filter(
                    F.transform(ring, corner),
                    lambda c: (c["turn"] * F.signum(area) < 0.0) & (c["l1"] >= 1e-9) & (c["l2"] >= 1e-9),
                ),
                bend,
            ),
        )
        .withColumn("_sharpest", F.array_max("_bends"))
        .withColumn(
            "_notch",
            F.when(
                (n >= 4) & (F.abs(area) >= 1e-6) & (F.col("_sharpest.bend") >= math.radians(CONCAVE_MIN_DEG)),
                F.col("_sharpest.p"),
            ),
        )
        .withColumn("_norm", F.when(norm >= 1e-9, norm))
        .withColumn("_ux", (notch["x"] - cx) / F.col("_norm"))
        .withColumn("_uy", (notch["y"] - cy) / F.col("_norm"))
        .withColumn(
            "_step",
            F.least(
                edge(F.col("_ux"), F.col("x0"), F.col("x1"), cx), edge(F.col("_uy"), F.col("y0"), F.col("y1"), cy)
            ),
        )
        .withColumn("_diag", diagonals())
        .withColumn("bidirectional", F.col("_norm").isNull())
        .withColumn(
            "bearing_deg",
            F.when(F.col("bidirectional"), F.when(F.col("_diag.d2") >= 1e-12, compass(F.col("_diag.dx"), F.col("_diag.dy"))))
            .otherwise(compass(-F.col("_ux"), -F.col("_uy"))),
        )
        .withColumn("anchor_x", cx + F.when(F.col("bidirectional"), 0.0).otherwise(F.coalesce(F.col("_ux") * F.col("_step"), F.lit(0.0))))
        .withColumn("anchor_y", cy + F.when(F.col("bidirectional"), 0.0).otherwise(F.coalesce(F.col("_uy") * F.col("_step"), F.lit(0.0))))
    )
    return df.drop("_v", "_ring", "_area", "_bends", "_sharpest", "_notch", "_norm", "_ux", "_uy", "_step", "_diag")


def extract_arrows(drawings: DataFrame, spans: DataFrame, crops: DataFrame) -> DataFrame:
    """Vector drawings + text spans -> arrows in sheet coordinates.

    ``crops``: edition, sheet, render_dpi, offset_x, offset_y, cropped_w,
    cropped_h. Shapes without a label, direction or place on the crop fall away.
    The geometry is carried through the label aggregate, which keeps the later
    filters from repeating it.
    """
    labelled = labels_in_shapes(with_outline(arrow_shapes(drawings)).drop("items", "fill"), spans)
    scale = F.col("render_dpi") / 72.0
    u = (F.col("anchor_x") * scale - F.col("offset_x")) / F.col("cropped_w")
    v = (F.col("anchor_y") * scale - F.col("offset_y")) / F.col("cropped_h")
    return (
        labelled.where(F.col("bearing_deg").isNotNull())
        .join(crops.where((F.col("cropped_w") > 0) & (F.col("cropped_h") > 0)), SHEET)
        .withColumn("u", u)
        .withColumn("v", v)
        .where(F.col("u").between(0.0, 1.0) & F.col("v").between(0.0, 1.0))
        .select(*SHEET, F.col("drawing_id").alias("arrow_no"), "u", "v", "bearing_deg", "altitudes_ft", "bidirectional")
    )


def union_arrows(*sheets: DataFrame, sheet_order: tuple[str, ...] = ("north", "south")) -> DataFrame:
    """All sheets' arrows with one ordinal: sheet order first, then the row's own number."""
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s)
    rank = F.array_position(F.array(*[F.lit(s) for s in sheet_order]), F.col("sheet"))
    return out.withColumn("arrow_ord", F.struct(rank.cast("int").alias("sheet_no"), F.col("arrow_no").cast("bigint").alias("arrow_no")))
