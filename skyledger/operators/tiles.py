"""Tile inventories, requests and attempt logs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo, mercator
from skyledger.operators import blocks

TILE = ["z", "x", "y"]
PROVIDER_TILE = ["provider", *TILE]

# Fixed values.
IMAGERY_TEMPLATE = "https://tiles.example/{z}/{y}/{x}"
MIN_TILE_BYTES = 256
DEFAULT_BACKOFF_S = 30.0
NETWORK_BACKOFF_S = 5.0
MAX_TRANSIENT_RETRIES = 3

Box = tuple[float, float, float, float]


def tile_range(box: Box, z: int) -> tuple[int, int, int, int] | None:
    """x0, x1, y0, y1 of the tiles touching a box; None for an inverted one."""
    lat0, lat1, lon0, lon1 = box
    if lat1 < lat0 or lon1 < lon0:
        return None
    n = 2**z

    def x(lon: float) -> int:
        return math.floor((lon + 180.0) / 360.0 * n)

    def y(lat: float) -> int:
        lat = max(-mercator.MAX_LAT, min(mercator.MAX_LAT, lat))
        return math.floor((1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * n)

    return x(lon0), x(lon1), y(lat1), y(lat0)


def tile_count(box: Box, z: int) -> int:
    r = tile_range(box, z)
    return 0 if r is None else (r[1] - r[0] + 1) * (r[3] - r[2] + 1)


def parse_tile_paths(files: DataFrame) -> DataFrame:
    """``path, length, modificationTime`` -> inventory; other files fall away."""
    name = r"([^/]+)/([0-9]+)/([0-9]+)/([0-9]+)\.jpg$"
    part = lambda i: F.regexp_extract("path", name, i)
    return files.where(F.col("length") > 0).where(F.col("path").rlike(name)).select(
        part(1).alias("provider"),
        part(2).try_cast("int").alias("z"),
        part(3).try_cast("int").alias("x"),
        part(4).try_cast("int").alias("y"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("mtime"),
    ).where(F.col("z").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())


def tile_density(points: DataFrame, z: int) -> DataFrame:
    """Points per tile; counts are combined before the shuffle, so a crowded tile is cheap."""
    return (
        points.select(
            F.lit(z).alias("z"), mercator.tile_x(F.col("lon"), F.lit(z)).alias("x"), mercator.tile_y(F.col("lat"), F.lit(z)).alias("y")
        )
        .groupBy(*TILE)
        .agg(F.count("*").alias("n_points"))
    )


def tiles_for_boxes(boxes: DataFrame, zooms: Sequence[int], spread: bool = False) -> DataFrame:
    """Every tile touching each box (edges included); inverted boxes give none.

    Columns are expanded first and rows second, so the arrays stay as long as
    one side of a box. ``spread`` redistributes the column strips before the
    second expansion, for boxes that cover a large part of the world.
    """
    ok = boxes.where((F.col("max_lat") >= F.col("min_lat")) & (F.col("max_lon") >= F.col("min_lon")))
    strips = (
        ok.withColumn("z", F.explode(F.array(*[F.lit(int(z)) for z in zooms])))
        .withColumn("y0", mercator.tile_y(F.col("max_lat"), F.col("z")))
        .withColumn("y1", mercator.tile_y(F.col("min_lat"), F.col("z")))
        .withColumn(
            "x",
            F.explode(
                F.sequence(mercator.tile_x(F.col("min_lon"), F.col("z")), mercator.tile_x(F.col("max_lon"), F.col("z")))
            ),
        )
    )
    if spread:
        strips = strips.repartition("z", "x")
    return strips.select("box_id", "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def missing_tiles(required: DataFrame, inventory: DataFrame, template: str = IMAGERY_TEMPLATE) -> DataFrame:
    """Required tiles (provider, z, x, y) that their provider has not cached, with their download address."""
    cached = inventory.where(F.col("bytes") > 0).select(*PROVIDER_TILE)
    return (
        required.select(*PROVIDER_TILE)
        .distinct()
        .join(cached, PROVIDER_TILE, "left_anti")
        .withColumn("url", mercator.tile_url(template, F.col("z"), F.col("x"), F.col("y")))
    )


def viewport_tiles(viewports: DataFrame, inventory: DataFrame, z: int, pad: float = 0.5) -> DataFrame:
    """Tiles under each viewport (view_id, provider, box) grown by ``pad`` of its size, marked cached by that provider or not."""
    zc = F.lit(z)
    x0, x1 = mercator.world_x(F.col("min_lon"), zc), mercator.world_x(F.col("max_lon"), zc)
    y0, y1 = mercator.world_y(F.col("max_lat"), zc), mercator.world_y(F.col("min_lat"), zc)
    limit = 2**z - 1

    def tile(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(limit), F.floor(v / mercator.TILE_PX))).cast("int")

    seen = (
        viewports.select("view_id", "provider", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
        .where((F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0")))
        .withColumn("px", (F.col("x1") - F.col("x0")) * pad)
        .withColumn("py", (F.col("y1") - F.col("y0")) * pad)
        .select(
            "view_id",
            "provider",
            zc.alias("z"),
            tile(F.col("y0") - F.col("py")).alias("ty0"),
            tile(F.col("y1") + F.col("py")).alias("ty1"),
            F.explode(F.sequence(tile(F.col("x0") - F.col("px")), tile(F.col("x1") + F.col("px")))).alias("x"),
        )
        .select("view_id", "provider", "z", "x", F.explode(F.sequence("ty0", "ty1")).alias("y"))
    )
    cached = (
        inventory.where((F.col("bytes") > 0) & (F.col("z") == z)).select(*PROVIDER_TILE).distinct().withColumn("cached", F.lit(True))
    )
    return seen.join(cached, PROVIDER_TILE, "left").select(
        "view_id", *PROVIDER_TILE, F.coalesce("cached", F.lit(False)).alias("cached")
    )


def tile_coverage(inventory: DataFrame, box: Box, zooms: Sequence[int]) -> DataFrame:
    """Cached share of a box per provider and zoom.

    Totals are closed-form, so nothing is enumerated, and one pass with a
    counter per zoom level leaves a zoom without tiles in the result as 0.
    """
    rows = []
    aggs = []
    for z in zooms:
        r = tile_range(box, z)
        total = tile_count(box, z)
        inside = (
            F.lit(False)
            if r is None
            else (F.col("z") == z) & F.col("x").between(r[0], r[1]) & F.col("y").between(r[2], r[3]) & (F.col("bytes") > 0)
        )
        aggs.append(F.count_if(inside).alias(f"c{z}"))
        cached = F.greatest(F.lit(0), F.least(F.lit(total), F.col(f"c{z}")))
        rows.append(
            F.struct(
                F.lit(int(z)).alias("z"),
                F.lit(total).cast("bigint").alias("total"),
                cached.cast("bigint").alias("cached"),
                (F.lit(total > 0) & (cached >= total)).alias("done"),
            )
        )
    return inventory.groupBy("provider").agg(*aggs).select("provider", F.inline(F.array(*rows)))


def inventory_size(inventory: DataFrame) -> DataFrame:
    """Files and bytes per provider."""
    return inventory.groupBy("provider").agg(
        F.count("*").alias("n_files"), F.sum("bytes").alias("total_bytes")
    )


def eviction_plan(inventory: DataFrame, target_bytes: int) -> DataFrame:
    """Files to drop, oldest first, until each provider fits ``target_bytes``.

    A file goes iff more than the target would remain after dropping every
    older one. Instead of one running sum over a provider's files, the last
    file to go is located by narrowing totals: day, then second, then
    (time, zoom, column), then row. Each step orders grouped totals only; the
    result is a comparison with that file's position.
    """
    order = ["mtime", "z", "x", "y"]
    files = inventory.withColumn("_day", F.to_date("mtime")).withColumn("_sec", F.date_trunc("second", "mtime"))
    state = (
        files.groupBy("provider")
        .agg((F.sum("bytes") - F.lit(int(target_bytes))).alias("need"))
        .where(F.col("need") > 0)
    )
    fixed: list[str] = []
    for level in (["_day"], ["_sec"], ["mtime", "z", "x"], ["y"]):
        w = Window.partitionBy("provider").orderBy(*level)
        groups = (
            files.join(state, ["provider", *fixed])
            .groupBy("provider", *fixed, *level, "need")
            .agg(F.sum("bytes").alias("_sum"))
            .withColumn("_cum", F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .where(F.col("_cum") >= F.col("need"))
        )
        state = (
            groups.groupBy("provider")
            .agg(F.min_by(F.struct(*fixed, *level, (F.col("need") - F.col("_cum") + F.col("_sum")).alias("need")), F.struct(*level)).alias("g"))
            .select("provider", *[F.col(f"g.{c}").alias(c) for c in [*fixed, *level]], F.col("g.need").alias("need"))
        )
        fixed += level
    last = state.select("provider", F.struct(*order).alias("_last"))
    return (
        inventory.join(last, "provider").where(F.struct(*order) <= F.col("_last")).drop("_last")
    )


# --- attempts --------------------------------------------------------------------


def attempt_outcomes(log: DataFrame) -> DataFrame:
    """Classify download attempts (status, bytes, retry_after, error)."""
    wait = F.trim("retry_after").try_cast("double")
    outcome = (
        F.when(F.col("error").isNotNull(), "network_error")
        .when(F.col("status").isin(404, 410), "missing")
        .when(F.col("status") == 429, "rate_limited")
        .when(F.col("status").between(500, 599), "network_error")
        .when(F.col("status") != 200, "http_error")
        .when(F.col("bytes") < MIN_TILE_BYTES, "missing")
        .when(F.col("status") == 200, "fetched")
        .otherwise("network_error")
    )
    return (
        log.withColumn("outcome", outcome)
        .withColumn("transient", F.col("outcome").isin("rate_limited", "network_error"))
        .withColumn(
            "backoff_s",
            F.when(
                F.col("outcome") == "rate_limited",
                F.when(wait > 0.0, wait).otherwise(F.lit(DEFAULT_BACKOFF_S)),
            ).when(F.col("outcome") == "network_error", F.lit(min(DEFAULT_BACKOFF_S, NETWORK_BACKOFF_S))),
        )
    )


def with_give_up(outcomes: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Mark the attempts at which a tile is given up (every third transient failure in a row); such an attempt has no wait.

    Failures are counted, whatever numbers the attempts have. Attempts are numbered
    within blocks; a block gets the count of the failures it continues, so one tile
    with very many attempts spreads out.
    """
    df = outcomes.withColumn("block", blocks.block_of(F.col("attempt_no"), block_rows))
    w = blocks.in_block(TILE, "attempt_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = blocks.over_blocks(TILE).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_r", F.row_number().over(w))
    solid = F.when(~F.col("transient"), F.col("_r"))
    carry = (
        df.groupBy(*TILE, "block")
        .agg(F.count("*").alias("n"), F.max(solid).alias("m"))
        .withColumn("_n", F.sum("n").over(earlier))
        .withColumn("_m", F.max(F.coalesce("_n", F.lit(0)) + F.col("m")).over(earlier))
        .where(F.col("_n").isNotNull())
        .select(*TILE, "block", (F.col("_n") - F.coalesce("_m", F.lit(0))).alias("c_run"))
    )
    run = F.when(F.col("_solid").isNotNull(), F.col("_r") - F.col("_solid")).otherwise(F.col("_r") + F.coalesce("c_run", F.lit(0)))
    return (
        df.withColumn("_solid", F.max(solid).over(so_far))
        .join(carry, [*TILE, "block"], "left")
        .withColumn("gave_up", F.col("transient") & (run > 0) & (run % MAX_TRANSIENT_RETRIES == 0))
        .withColumn("backoff_s", F.when(~F.col("gave_up"), F.col("backoff_s")))
        .drop("_solid", "c_run", "_r", "block")
    )


def attempt_summary(log: DataFrame, total: int | None = None, prior: int = 0, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Per zoom: attempts by outcome, tiles given up, errors, and capped progress."""
    cap = F.lit(total) if total is not None else F.col("n_fetched") + prior
    return (
        with_give_up(attempt_outcomes(log), block_rows)
        .groupBy("z")
        .agg(
            F.count("*").alias("n_attempts"),
            F.count_if(F.col("outcome") == "fetched").alias("n_fetched"),
            F.count_if(F.col("outcome") == "missing").alias("n_missing"),
            F.count_if(F.col("outcome") == "rate_limited").alias("n_rate_limited"),
            F.count_if(F.col("outcome") == "network_error").alias("n_network_error"),
            F.count_if(F.col("gave_up") | (F.col("outcome") == "http_error")).alias("n_errors"),
            F.count_if("gave_up").alias("n_given_up"),
            F.sum(F.coalesce("backoff_s", F.lit(0.0))).alias("backoff_s"),
        )
        .withColumn("progress", F.least(F.col("n_fetched") + prior, cap))
    )


# --- placement on a sheet ------------------------------------------------------------


def _square_to_quad(p: list[tuple[Column, Column]], side: float) -> dict[str, Column]:
    """Projective map of the square (0,0)-(side,side) onto a quadrilateral, in closed form."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p
    ux, uy, vx, vy = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    det = ux * vy - vx * uy
    det = F.when(F.abs(det) > 1e-12, det)
    g, h = (sx * vy - vx * sy) / det, (ux * sy - sx * uy) / det
    return {
        "m11": (x1 - x0 + g * x1) / side, "m21": (x3 - x0 + h * x3) / side, "m31": x0,
        "m12": (y1 - y0 + g * y1) / side, "m22": (y3 - y0 + h * y3) / side, "m32": y0,
        "m13": g / side, "m23": h / side,
    }


def tile_placement(tiles: DataFrame, fits: DataFrame, keys: Sequence[str] = ("edition", "sheet")) -> DataFrame:
    """Transform from tile pixels to sheet pixels, with the error at the tile's centre.

    ``fits`` needs the sheet's affine (a..ty) and ``width``/``height`` in
    pixels. Tiles whose corners collapse are dropped.
    """
    joined = tiles.join(fits.where((F.col("width") > 0) & (F.col("height") > 0)), list(keys))

    def on_sheet(fx: float, fy: float) -> tuple[Column, Column]:
        lon = mercator.lon_of((F.col("x") + fx) * float(mercator.TILE_PX), F.col("z"))
        lat = mercator.lat_of((F.col("y") + fy) * float(mercator.TILE_PX), F.col("z"))
        X, Y = geo.lcc_xy(lat, lon)
        return (
            (F.col("a") * X + F.col("b") * Y + F.col("tx")) * F.col("width"),
            (F.col("c") * X + F.col("d") * Y + F.col("ty")) * F.col("height"),
        )

    # Corners first, as plain columns: the coefficients reuse each of them several times.
    corner = {"nw": (0.0, 0.0), "ne": (1.0, 0.0), "se": (1.0, 1.0), "sw": (0.0, 1.0), "mid": (0.5, 0.5)}
    placed = joined
    for name, (fx, fy) in corner.items():
        px, py = on_sheet(fx, fy)
        placed = placed.withColumn(f"{name}_x", px).withColumn(f"{name}_y", py)
    quad = [(F.col(f"{n}_x"), F.col(f"{n}_y")) for n in ("nw", "ne", "se", "sw")]
    m = _square_to_quad(quad, float(mercator.TILE_PX))
    c = mercator.TILE_PX / 2.0
    w = F.col("m13") * c + F.col("m23") * c + 1.0
    return (
        placed.select(*keys, *TILE, "mid_x", "mid_y", *[v.alias(k) for k, v in m.items()], F.lit(1.0).alias("m33"))
        .where(F.col("m13").isNotNull())
        .withColumn(
            "residual_px",
            F.hypot(
                (F.col("m11") * c + F.col("m21") * c + F.col("m31")) / w - F.col("mid_x"),
                (F.col("m12") * c + F.col("m22") * c + F.col("m32")) / w - F.col("mid_y"),
            ),
        )
        .drop("mid_x", "mid_y")
    )


def sheet_tiles(fits: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Tiles under each sheet: those touching the box around its four corners."""
    box = fits
    for i, (u, v) in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))):
        X = F.col("ia") * u + F.col("ib") * v + F.col("itx")
        Y = F.col("ic") * u + F.col("id") * v + F.col("ity")
        lat, lon = geo.lcc_latlon(X, Y)
        box = box.withColumn(f"lat{i}", lat).withColumn(f"lon{i}", lon)
    lats, lons = [f"lat{i}" for i in range(4)], [f"lon{i}" for i in range(4)]
    boxes = box.select(
        F.struct("edition", "sheet").alias("box_id"),
        F.least(*lats).alias("min_lat"), F.greatest(*lats).alias("max_lat"),
        F.least(*lons).alias("min_lon"), F.greatest(*lons).alias("max_lon"),
    )
    return tiles_for_boxes(boxes, zooms).select("box_id.edition", "box_id.sheet", *TILE)


