"""Grid keys that turn a distance join into an equi-join.

Rows are latitude bands a little taller than the search radius; inside a band
the cell width is fixed by the band's most poleward latitude, so no pass over
the data is needed to size the cells. One side keeps one row; the other is
copied into the cells it can be seen from. The antimeridian and
the poles are not supported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo

CELL_MARGIN = 1.001


def band_height(nm: float) -> float:
    """Degrees of latitude a little more than ``nm`` apart."""
    return nm / geo.NM_PER_DEGREE * CELL_MARGIN


def _cell_width(band: Column, nm: float) -> Column:
    h = band_height(nm)
    poleward = F.least(F.greatest(F.abs(band * h), F.abs((band + 1) * h)) + h, F.lit(89.0))
    return h / F.cos(F.radians(poleward))


def band_of(lat: Column, nm: float) -> Column:
    return F.floor(lat / band_height(nm)).cast("int")


def cell_of(lat: Column, lon: Column, nm: float) -> tuple[Column, Column]:
    band = band_of(lat, nm)
    return band, F.floor(lon / _cell_width(band, nm)).cast("int")


def cells_in_reach(lat: Column, lon: Column, nm: float) -> Column:
    """Array of the cells, of twice the radius, that hold everything within ``nm``: four.

    A cell of that size reaches past its middle as far as ``nm``, so only the
    neighbours on the point's own side of the middle, in both directions, matter.
    """
    wide = 2.0 * nm
    y = lat / band_height(wide)
    own = F.floor(y).cast("int")
    cells = []
    for band in (own, own + F.when(y - own < 0.5, -1).otherwise(1)):
        x = lon / _cell_width(band, wide)
        column = F.floor(x).cast("int")
        cells += [F.struct(band.alias("gy"), c.alias("gx")) for c in (column, column + F.when(x - column < 0.5, -1).otherwise(1))]
    return F.array(*cells)


def cell_of_reach(lat: Column, lon: Column, nm: float) -> tuple[Column, Column]:
    """The one cell of that grid that a point lies in."""
    return cell_of(lat, lon, 2.0 * nm)


def with_cells_along(df: DataFrame, ends: tuple[Column, Column, Column, Column], pad: Column, pad_lon: Column, nm: float) -> DataFrame:
    """One row per cell (gy, gx) within ``pad`` degrees (``pad_lon`` in longitude) of the line between two places.

    Walks the bands the line crosses; in each, only the columns beside the part of
    the line that lies in the band, so a long slanting line has as many rows as
    cells along it, not as many as its box.
    """
    a_lat, a_lon, b_lat, b_lon = ends
    height, width = band_height(nm), _cell_width(F.col("gy"), nm)
    south, north = F.least(a_lat, b_lat) - pad, F.greatest(a_lat, b_lat) + pad
    rows = df.withColumns({"_pad": pad, "_pad_lon": pad_lon}).withColumn("gy", F.explode(F.sequence(band_of(south, nm), band_of(north, nm))))
    # where the line enters and leaves the band and its margin, 0 at the first place and 1 at the second
    rise = F.when(b_lat != a_lat, b_lat - a_lat)
    at = lambda lat: (lat - a_lat) / rise
    enter, leave = at(F.col("gy") * height - F.col("_pad")), at((F.col("gy") + 1) * height + F.col("_pad"))
    first = F.coalesce(F.greatest(F.least(enter, leave), F.lit(0.0)), F.lit(0.0))
    last = F.coalesce(F.least(F.greatest(enter, leave), F.lit(1.0)), F.lit(1.0))
    rows = rows.withColumns({"_p": a_lon + first * (b_lon - a_lon), "_q": a_lon + last * (b_lon - a_lon)})
    west, east = F.least("_p", "_q") - F.col("_pad_lon"), F.greatest("_p", "_q") + F.col("_pad_lon")
    columns = F.sequence(F.floor(west / width).cast("int"), F.floor(east / width).cast("int"))
    return rows.withColumn("gx", F.explode(columns)).drop("_p", "_q", "_pad", "_pad_lon")


def nearest(
    points: DataFrame,
    targets: DataFrame,
    max_nm: float,
    *,
    keys: Sequence[str] = (),
    target_order: str,
    target_cols: Sequence[str],
    keep_all: bool = True,
    copy_points: bool = False,
) -> DataFrame:
    """Nearest target strictly closer than ``max_nm`` for every point.

    Both sides need ``lat`` and ``lon``; ``keys`` restrict matches to the same
    group (a plan, an edition). Ties go to the lowest ``target_order``. Points
    without a match keep their row with NULLs unless ``keep_all`` is off.

    Places meet, not rows: targets at one spot are reduced to the first of them,
    which the others can't beat, and points at one spot are looked up once; the rows
    get the answer by a join on their place. One side has four copies, the targets
    or, with ``copy_points``, the points: name the smaller one.
    """
    cols = [c for c in dict.fromkeys([target_order, *target_cols]) if c not in keys]
    own, reach = cell_of_reach(F.col("lat"), F.col("lon"), max_nm), F.explode(cells_in_reach(F.col("lat"), F.col("lon"), max_nm))

    def placed(df: DataFrame, copies: bool) -> DataFrame:
        if copies:
            return df.withColumn("_cell", reach).withColumns({"gy": F.col("_cell.gy"), "gx": F.col("_cell.gx")}).drop("_cell")
        return df.withColumns({"gy": own[0], "gx": own[1]})

    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    spots = targets.where(there).groupBy(*keys, "lat", "lon").agg(F.min_by(F.struct(*cols), F.col(target_order)).alias("_t"))
    spots = placed(spots, not copy_points).withColumnsRenamed({"lat": "_tlat", "lon": "_tlon"})
    asked = points.where(there).select(*keys, "lat", "lon").distinct()
    dist = geo.great_circle_nm(F.col("lat"), F.col("lon"), F.col("_tlat"), F.col("_tlon"))
    hits = (
        placed(asked, copy_points)
        .join(spots, [*keys, "gy", "gx"])
        .withColumn("_d", dist)
        .where(F.col("_d") < max_nm)
        .groupBy(*keys, "lat", "lon")
        .agg(F.min(F.struct(F.col("_d").alias("d"), F.col(f"_t.{target_order}").alias("o"), F.col("_t").alias("t"))).alias("_best"))
    )
    return points.join(hits, [*keys, "lat", "lon"], "left" if keep_all else "inner").select(
        *[F.col(c) for c in points.columns], *[F.col(f"_best.t.{c}").alias(f"near_{c}") for c in cols], F.col("_best.d").alias("near_nm")
    )
