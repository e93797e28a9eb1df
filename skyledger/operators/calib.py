"""Chart geo-referencing: sheet fits, overlap alignment, projection, ownership.

Every fit is a handful of grouped moments. Spark's ``covar_pop``/``var_pop``
centre the data while they aggregate and merge partial results, so a fit is a
single map-side combined aggregate with no second pass for the means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo

SHEET = ["edition", "sheet"]

# Fixed values.
MIN_ANCHORS = 3
MIN_SHARED = 2
SINGULAR = 1e-18

FIT_FIELDS = ("a", "b", "c", "d", "tx", "ty", "ia", "ib", "ic", "id", "itx", "ity")


def _with_xy(df: DataFrame) -> DataFrame:
    x, y = geo.lcc_xy(F.col("lat"), F.col("lon"))
    return df.withColumn("X", x).withColumn("Y", y)


def fit_sheets(anchors: DataFrame) -> DataFrame:
    """Least-squares affine (X, Y) -> (u, v) per sheet, its inverse and RMS residual."""
    pts = _with_xy(anchors)
    m = pts.groupBy(*SHEET).agg(
        F.count("*").alias("n"),
        F.count_distinct(F.upper(F.trim("code"))).alias("n_codes"),
        *[F.avg(c).alias(f"m{c}") for c in ("X", "Y", "u", "v")],
        F.var_pop("X").alias("xx"),
        F.var_pop("Y").alias("yy"),
        F.covar_pop("X", "Y").alias("xy"),
        *[F.covar_pop(s, d).alias(f"{s.lower()}{d}") for s in ("X", "Y") for d in ("u", "v")],
    )
    ok = m.where((F.col("n") >= MIN_ANCHORS) & (F.col("n_codes") == F.col("n")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = ok.withColumn("det", det).where(F.abs(F.col("det")) * F.col("n") * F.col("n") >= SINGULAR)
    solved = ok.select(
        *SHEET,
        "n",
        "mX", "mY", "mu", "mv",
        ((F.col("yy") * F.col("xu") - F.col("xy") * F.col("yu")) / F.col("det")).alias("a"),
        ((F.col("xx") * F.col("yu") - F.col("xy") * F.col("xu")) / F.col("det")).alias("b"),
        ((F.col("yy") * F.col("xv") - F.col("xy") * F.col("yv")) / F.col("det")).alias("c"),
        ((F.col("xx") * F.col("yv") - F.col("xy") * F.col("xv")) / F.col("det")).alias("d"),
    )
    fit = solved.select(
        *SHEET, F.col("n").alias("n_anchors"), "a", "b", "c", "d",
        (F.col("mu") - F.col("a") * F.col("mX") - F.col("b") * F.col("mY")).alias("tx"),
        (F.col("mv") - F.col("c") * F.col("mX") - F.col("d") * F.col("mY")).alias("ty"),
    )
    fit = with_inverse(fit)
    err = (
        F.pow(F.col("a") * F.col("X") + F.col("b") * F.col("Y") + F.col("tx") - F.col("u"), F.lit(2.0))
        + F.pow(F.col("c") * F.col("X") + F.col("d") * F.col("Y") + F.col("ty") - F.col("v"), F.lit(2.0))
    )
    # The coefficients leave through this aggregate as plain values, so later
    # expressions and filters never pull their formulas into themselves.
    fields = ["n_anchors", *FIT_FIELDS]
    return (
        pts.join(fit, SHEET)
        .groupBy(*SHEET)
        .agg(F.first(F.struct(*fields)).alias("_fit"), F.sqrt(F.avg(err)).alias("residual_uv"))
        .select(*SHEET, "_fit.*", "residual_uv")
    )


def with_inverse(fit: DataFrame) -> DataFrame:
    """Add the inverse affine; singular sheets are dropped."""
    det = F.col("a") * F.col("d") - F.col("b") * F.col("c")
    return (
        fit.withColumn("_det", det)
        .where(F.abs(F.col("_det")) >= SINGULAR)
        .withColumn("ia", F.col("d") / F.col("_det"))
        .withColumn("ib", -F.col("b") / F.col("_det"))
        .withColumn("ic", -F.col("c") / F.col("_det"))
        .withColumn("id", F.col("a") / F.col("_det"))
        .withColumn("itx", -(F.col("ia") * F.col("tx") + F.col("ib") * F.col("ty")))
        .withColumn("ity", -(F.col("ic") * F.col("tx") + F.col("id") * F.col("ty")))
        .drop("_det")
    )


def _f(fit: str | None, name: str) -> Column:
    return F.col(f"{fit}.{name}" if fit else name)


def uv_of(lat: Column, lon: Column, fit: str | None = None) -> tuple[Column, Column]:
    """Sheet coordinates of a position, with the fit's columns (or struct) at hand."""
    X, Y = geo.lcc_xy(lat, lon)
    return (
        _f(fit, "a") * X + _f(fit, "b") * Y + _f(fit, "tx"),
        _f(fit, "c") * X + _f(fit, "d") * Y + _f(fit, "ty"),
    )


def latlon_of(u: Column, v: Column, fit: str | None = None) -> tuple[Column, Column]:
    return geo.lcc_latlon(
        _f(fit, "ia") * u + _f(fit, "ib") * v + _f(fit, "itx"),
        _f(fit, "ic") * u + _f(fit, "id") * v + _f(fit, "ity"),
    )


def align_overlap(anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Uniform scale and shift laying the south sheet on the north one, per edition.

    ``sizes``: edition, north_w, north_h, south_w, south_h (pixels).
    """
    key = F.upper(F.trim("code"))
    side = lambda s: anchors.where(F.col("sheet") == s).select(
        "edition", key.alias("code"), F.col("u").alias(f"{s}_u"), F.col("v").alias(f"{s}_v")
    )
    shared = side("north").join(side("south"), ["edition", "code"])
    px = shared.join(
        sizes.where((F.col("north_w") > 0) & (F.col("north_h") > 0) & (F.col("south_w") > 0) & (F.col("south_h") > 0)),
        "edition",
    ).select(
        "edition",
        (F.col("south_u") * F.col("south_w") - F.col("south_w") / 2.0).alias("ax"),
        (F.col("south_v") * F.col("south_h") - F.col("south_h") / 2.0).alias("ay"),
        (F.col("north_u") * F.col("north_w") - F.col("south_w") / 2.0).alias("bx"),
        (F.col("north_v") * F.col("north_h") - F.col("south_h") / 2.0).alias("by"),
    )
    fit = (
        px.groupBy("edition")
        .agg(
            F.count("*").alias("n_shared"),
            (F.var_pop("ax") + F.var_pop("ay")).alias("spread"),
            (F.covar_pop("ax", "bx") + F.covar_pop("ay", "by")).alias("cov"),
            *[F.avg(c).alias(f"m{c}") for c in ("ax", "ay", "bx", "by")],
        )
        .where((F.col("n_shared") >= MIN_SHARED) & (F.col("spread") > 0.0))
        .withColumn("scale", F.col("cov") / F.col("spread"))
        .where((F.col("scale") > 0.0) & (F.col("scale") < float("inf")))
        .select(
            "edition", "n_shared", "scale",
            (F.col("mbx") - F.col("scale") * F.col("max")).alias("shift_x"),
            (F.col("mby") - F.col("scale") * F.col("may")).alias("shift_y"),
        )
    )
    err = F.pow(F.col("ax") * F.col("scale") + F.col("shift_x") - F.col("bx"), F.lit(2.0)) + F.pow(
        F.col("ay") * F.col("scale") + F.col("shift_y") - F.col("by"), F.lit(2.0)
    )
    residual = px.join(fit, "edition").groupBy("edition").agg(F.sqrt(F.avg(err)).alias("residual_px"))
    return fit.join(residual, "edition")


# --- projection and assignment ------------------------------------------------------

LAYOUT_FIELDS = ("pos_x", "pos_y", "scale", "width", "height")


def sheets_by_edition(fits: DataFrame) -> DataFrame:
    """One row per edition with a ``north`` and a ``south`` struct (NULL when not fitted)."""
    fields = [c for c in (*FIT_FIELDS, *LAYOUT_FIELDS) if c in fits.columns]
    pick = lambda s: F.max(F.when(F.col("sheet") == s, F.struct(*fields))).alias(s)
    return fits.groupBy("edition").agg(pick("north"), pick("south"))


def project_arrows(arrows: DataFrame, fits: DataFrame) -> DataFrame:
    """Sheet coordinates -> positions; the arrow's bearing is kept as it is."""
    lat, lon = latlon_of(F.col("u"), F.col("v"))
    out = arrows.join(fits.select(*SHEET, *FIT_FIELDS), SHEET).withColumn("lat", lat).withColumn("lon", lon)
    return out.where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    ).drop(*FIT_FIELDS)


def _inside(u: Column, v: Column, eps: float = 0.0) -> Column:
    return F.coalesce(u.between(-eps, 1.0 + eps) & v.between(-eps, 1.0 + eps), F.lit(False))


def assign_sheet(points: DataFrame, fits: DataFrame, mode: str) -> DataFrame:
    """Pick the sheet for each point (two sheets per edition, so one row-wise choice).

    ``scene``: points (scene_x, scene_y) -> first of south, north that covers
    them, with lat/lon. ``position``: points (lat, lon) -> first covering sheet,
    else the first fitted one. ``centre``: best-centred covering sheet, else the
    one that misses by least. Points no sheet serves are dropped.
    """
    joined = points.join(sheets_by_edition(fits), "edition")
    if mode == "scene":
        for s in ("south", "north"):
            for axis, size, uv in (("x", "width", "u"), ("y", "height", "v")):
                half = F.col(f"{s}.{size}") / 2.0
                local = (F.col(f"scene_{axis}") - F.col(f"{s}.pos_{axis}") - (1.0 - F.col(f"{s}.scale")) * half) / F.col(f"{s}.scale")
                joined = joined.withColumn(f"_{s}_{uv}", local / F.col(f"{s}.{size}"))
    else:
        for s in ("south", "north"):
            u, v = uv_of(F.col("lat"), F.col("lon"), s)
            joined = joined.withColumn(f"_{s}_u", u).withColumn(f"_{s}_v", v)

    def uv(s: str) -> tuple[Column, Column]:
        return F.col(f"_{s}_u"), F.col(f"_{s}_v")

    if mode == "scene":
        choice = F.when(_inside(*uv("south")), "south").when(_inside(*uv("north")), "north")
    elif mode == "position":
        choice = (
            F.when(_inside(*uv("south")), "south")
            .when(_inside(*uv("north")), "north")
            .when(F.col("_south_u").isNotNull(), "south")
            .when(F.col("_north_u").isNotNull(), "north")
        )
    elif mode == "centre":
        centre = lambda s: F.hypot(uv(s)[0] - 0.5, uv(s)[1] - 0.5)
        off = lambda c: F.greatest(F.lit(0.0), -c, c - 1.0)
        miss = lambda s: F.hypot(off(uv(s)[0]), off(uv(s)[1]))
        n_in, s_in = _inside(*uv("north"), 1e-2), _inside(*uv("south"), 1e-2)
        choice = (
            F.when(n_in & s_in, F.when(centre("north") <= centre("south"), "north").otherwise("south"))
            .when(n_in, "north")
            .when(s_in, "south")
            .when(F.col("_south_u").isNull() & F.col("_north_u").isNotNull(), "north")
            .when(F.col("_north_u").isNull() & F.col("_south_u").isNotNull(), "south")
            .when(F.col("_north_u").isNotNull(), F.when(miss("north") <= miss("south"), "north").otherwise("south"))
        )
        joined = joined.withColumn("on_chart", n_in | s_in)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = joined.withColumn("sheet", choice).where(F.col("sheet").isNotNull())
    south = F.col("sheet") == "south"
    out = out.withColumn("u", F.when(south, F.col("_south_u")).otherwise(F.col("_north_u"))).withColumn(
        "v", F.when(south, F.col("_south_v")).otherwise(F.col("_north_v"))
    )
    if mode == "scene":
        lat_s, lon_s = latlon_of(F.col("u"), F.col("v"), "south")
        lat_n, lon_n = latlon_of(F.col("u"), F.col("v"), "north")
        out = out.withColumn("lat", F.when(south, lat_s).otherwise(lat_n)).withColumn(
            "lon", F.when(south, lon_s).otherwise(lon_n)
        )
    extra = ["on_chart"] if mode == "centre" else ["lat", "lon"] if mode == "scene" else []
    return out.select(*points.columns, "sheet", "u", "v", *extra)


def seam_owner(items: DataFrame, fits: DataFrame, layout: DataFrame) -> DataFrame:
    """Which sheet draws each item near the seam.

    ``layout``: edition, seam_y, extension_px, north_height. Exactly one sheet
    owns an item outside the extension strip, both inside it; items the north
    fit cannot place belong to the south.
    """
    north = sheets_by_edition(fits).select("edition", "north")
    _, v = uv_of(F.col("lat"), F.col("lon"), "north")
    y = F.col("_y")
    lost = y.isNull() | F.isnan(y)
    return (
        items.join(layout, "edition")
        .join(north, "edition", "left")
        .withColumn("_y", v * F.col("north_height"))
        .withColumn("north_keeps", ~lost & F.coalesce(y < F.col("seam_y") + F.col("extension_px"), F.lit(False)))
        .withColumn("south_keeps", lost | F.coalesce(y >= F.col("seam_y"), F.lit(False)))
        .select(*items.columns, "north_keeps", "south_keeps")
    )
