"""Choice of calibration anchors from a waypoint catalogue, all editions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut

SHEET = ["edition", "sheet"]

# Fixed values.
KM_PER_DEGREE = 111.0
LAT_BUFFER = 0.35
TARGET_KM = 48.0
BANDS_KM = ((24.0, 88.0), (18.0, 110.0), (12.0, 180.0))
OVERLAP_CODES = ("SDROT", "OMMER", "ENGDI")
OVERLAP_LATS = (31.27, 31.55)
MIN_ANCHORS = 3


def _pool(waypoints: DataFrame) -> DataFrame:
    return waypoints.where(F.lower(F.trim(F.coalesce("reporting_type", F.lit("")))) != "arp")


def _upper_median(pool: DataFrame) -> DataFrame:
    """Element n // 2 of the sorted latitudes per edition.

    Latitudes are counted by value first, so the ordered window sees each
    distinct value once however many rows share it.
    """
    counts = pool.groupBy("edition", "lat").agg(F.count("*").alias("c"))
    w = Window.partitionBy("edition").orderBy("lat")
    totals = pool.groupBy("edition").agg(F.count("*").alias("n"))
    return (
        counts.withColumn("cum", F.sum("c").over(w))
        .join(totals, "edition")
        .where(F.col("cum") > F.floor(F.col("n") / 2))
        .groupBy("edition")
        .agg(F.min("lat").alias("med"), F.first("n").alias("n"))
    )


def anchor_candidates(waypoints: DataFrame) -> DataFrame:
    """Waypoints each sheet may use: its half by latitude, less the band near the seam.

    ``waypoints``: edition, ord, code, reporting_type, lat, lon. Aerodromes are
    out. A half with fewer than two rows is widened by 0.35 degrees, and failing
    that the whole pool is used; the seam third is left in when too little remains.
    """
    pool = _pool(waypoints)
    stats = _upper_median(pool)
    placed = pool.join(stats, "edition")
    north, south = F.col("lat") >= F.col("med"), F.col("lat") < F.col("med")
    wide_north, wide_south = F.col("lat") >= F.col("med") - LAT_BUFFER, F.col("lat") < F.col("med") + LAT_BUFFER
    sizes = placed.groupBy("edition").agg(
        *[F.count_if(c).alias(n) for n, c in (("nn", north), ("ns", south), ("wn", wide_north), ("ws", wide_south))]
    )
    sided = placed.join(sizes, "edition").withColumn("sheet", F.explode(F.array(F.lit("north"), F.lit("south"))))
    is_north = F.col("sheet") == "north"
    half = F.when(is_north, north).otherwise(south)
    wide = F.when(is_north, wide_north).otherwise(wide_south)
    n_half = F.when(is_north, F.col("nn")).otherwise(F.col("ns"))
    n_wide = F.when(is_north, F.col("wn")).otherwise(F.col("ws"))
    chosen = sided.where(
        F.when(F.col("n") < 2, True).when(n_half >= 2, half).when(n_wide >= 2, wide).otherwise(True)
    ).withColumn("banded", (F.col("n") >= 2) & ((n_half >= 2) | (n_wide >= 2)))
    spans = chosen.groupBy(*SHEET).agg(F.min("lat").alias("lo"), F.max("lat").alias("hi"), F.count("*").alias("m"))
    span = F.col("hi") - F.col("lo")
    outer = F.when(is_north, F.col("lat") >= F.col("lo") + span / 3.0).otherwise(
        F.col("lat") <= F.col("lo") + span * (2.0 / 3.0)
    )
    joined = chosen.join(spans, SHEET).withColumn("outer", outer)
    kept = joined.groupBy(*SHEET).agg(F.count_if("outer").alias("n_outer"))
    use_band = F.col("banded") & (F.col("m") >= 2) & (span >= 1e-7) & (F.col("n_outer") >= 2)
    cols = [c for c in waypoints.columns if c not in SHEET]
    return joined.join(kept, SHEET).where(~use_band | F.col("outer")).select(*SHEET, *cols)


def _km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, mid: Column) -> Column:
    # not hypot, whose last bit differs: of distances equal but for that, the wrong one would win a choice
    dx, dy = (lon_a - lon_b) * F.cos(F.radians(mid)) * KM_PER_DEGREE, (lat_a - lat_b) * KM_PER_DEGREE
    return F.sqrt(F.pow(dx, F.lit(2.0)) + F.pow(dy, F.lit(2.0)))


def anchor_pairs(candidates: DataFrame, cell_km: float = 12.0) -> DataFrame:
    """Per sheet the pair nearest 48 km apart in the first of three bands that has one.

    Rows at one spot are reduced to the first. Cells of a grid are compared
    before rows: one representative per cell bounds the best score, and only
    cell pairs that can reach that bound expand to rows, so a crowded sheet does
    not compare all of its rows with each other.
    """
    candidates = cut(candidates)  # read several times below
    mid = candidates.groupBy(*SHEET).agg(F.avg("lat").alias("mid"))
    size = cell_km / KM_PER_DEGREE
    spots = (
        candidates.groupBy(*SHEET, "lat", "lon")
        .agg(F.min(F.struct("ord", "code")).alias("f"))
        .join(mid, SHEET)
        .select(
            *SHEET, "mid", "lat", "lon", "f.ord", "f.code",
            F.floor(F.col("lat") / size).alias("cy"),
            F.floor(F.col("lon") * F.cos(F.radians("mid")) / size).alias("cx"),
        )
    )
    spots = cut(spots)
    # One row per occupied cell: the number of cells is bounded by the sheet's area.
    cells = spots.groupBy(*SHEET, "mid", "cy", "cx").agg(F.min(F.struct("ord", "lat", "lon")).alias("r"))
    other = cells.select(*SHEET, F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("r").alias("o"))
    gap = lambda a, b: F.greatest(F.abs(a - b) - 1, F.lit(0)) * cell_km
    far = lambda a, b: (F.abs(a - b) + 1) * cell_km
    lo = F.hypot(gap(F.col("cy"), F.col("oy")), gap(F.col("cx"), F.col("ox")))
    hi = F.hypot(far(F.col("cy"), F.col("oy")), far(F.col("cx"), F.col("ox")))
    widest = BANDS_KM[-1]
    # a chart covers some hundred cells; only those in a ring that the widest band can reach are partners
    cell_pairs = cells.join(other, SHEET).where((lo <= widest[1]) & (hi >= widest[0]))
    d = _km(F.col("r.lat"), F.col("r.lon"), F.col("o.lat"), F.col("o.lon"), F.col("mid"))
    band = _band(F.col("_d"))
    bound = (
        cell_pairs.withColumn("_d", d)
        .withColumn("_band", band)
        .where(F.col("_band").isNotNull())
        .groupBy(*SHEET)
        .agg(F.min(F.struct(F.col("_band").alias("band"), F.abs(F.col("_d") - TARGET_KM).alias("score"))).alias("b"))
    )
    best = F.col("b.score") * (1.0 + 1e-9) + 1e-9

    def reaches(low: Column, high: Column) -> Column:
        return (lo <= high) & (hi >= low)

    # a pair wins in a better band, or nearer to the target in the same one
    can_win = reaches(F.lit(widest[0]), F.lit(widest[1]))
    for number in range(len(BANDS_KM)):
        low, high = TARGET_KM - best, TARGET_KM + best
        if number:
            low, high = F.least(low, F.lit(BANDS_KM[number - 1][0])), F.greatest(high, F.lit(BANDS_KM[number - 1][1]))
        can_win = F.when(F.col("b.band") == number, reaches(low, high)).otherwise(can_win)
    open_pairs = (
        cell_pairs.join(bound, SHEET, "left").where(can_win).select(*SHEET, "cy", "cx", "oy", "ox")
    )
    a = spots.select(*SHEET, "mid", "cy", "cx", *[F.col(c).alias(f"a_{c}") for c in ("ord", "code", "lat", "lon")])
    b = spots.select(
        *SHEET, F.col("cy").alias("oy"), F.col("cx").alias("ox"), *[F.col(c).alias(f"b_{c}") for c in ("ord", "code", "lat", "lon")]
    )
    pairs = (
        open_pairs.join(a, [*SHEET, "cy", "cx"])
        .join(b, [*SHEET, "oy", "ox"])
        .where(F.col("a_ord") < F.col("b_ord"))
        .withColumn("_d", _km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), F.col("mid")))
        .withColumn("_band", band)
        .where(F.col("_band").isNotNull())
    )
    pick = F.struct(
        F.col("_band").alias("band"), F.abs(F.col("_d") - TARGET_KM).alias("score"), "a_ord", "b_ord",
        "a_code", "a_lat", "a_lon", "b_code", "b_lat", "b_lon", F.col("_d").alias("km"),
    )
    swap = F.lower("p.a_code") > F.lower("p.b_code")
    side = lambda n, x, y: F.when(swap, F.col(f"p.{y}_{n}")).otherwise(F.col(f"p.{x}_{n}"))
    return pairs.groupBy(*SHEET).agg(F.min(pick).alias("p")).select(
        *SHEET,
        *[side(n, "a", "b").alias(f"first_{n}") for n in ("code", "lat", "lon")],
        *[side(n, "b", "a").alias(f"second_{n}") for n in ("code", "lat", "lon")],
        F.col("p.km").alias("km"),
    )


def _band(d: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(BANDS_KM))):
        out = F.when(d.between(lo, hi), i).otherwise(out)
    return out


def spread_anchors(candidates: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Extend each seed pair to ``n`` anchors, each time the row farthest from those chosen.

    One round per further anchor for all sheets together: candidates join the
    short list of chosen anchors and a partial aggregate finds the farthest.
    """
    if n < MIN_ANCHORS:
        raise ValueError(f"need at least {MIN_ANCHORS} anchors")
    anchor = lambda p: F.struct(
        F.col(f"{p}_code").alias("code"), F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lon").alias("lon")
    )
    candidates = cut(candidates)  # read once per round
    stats = candidates.groupBy(*SHEET).agg(F.avg("lat").alias("mid"), F.count("*").alias("m"))
    chosen = (
        pairs.join(stats.where(F.col("m") >= MIN_ANCHORS), SHEET)
        .select(*SHEET, "mid", "m", F.array(anchor("first"), anchor("second")).alias("chosen"))
    )
    rows = candidates.select(*SHEET, "ord", "code", "lat", "lon")
    for _ in range(n - 2):
        apart = F.array_min(
            F.transform("chosen", lambda c: _km(F.col("lat"), F.col("lon"), c["lat"], c["lon"], F.col("mid")))
        )
        free = ~F.exists("chosen", lambda c: F.lower(c["code"]) == F.lower(F.col("code")))
        best = F.max_by(
            F.struct("code", "lat", "lon"), F.when(free, F.struct(apart.alias("d"), (-F.col("ord")).alias("o")))
        )
        chosen = (
            chosen.join(rows, SHEET)
            .groupBy(*SHEET)
            .agg(F.first(F.struct("mid", "m", "chosen")).alias("_s"), best.alias("_next"))
            .select(
                *SHEET, "_s.mid", "_s.m",
                F.when(F.col("_next").isNull() | (F.size("_s.chosen") >= F.col("_s.m")), F.col("_s.chosen"))
                .otherwise(F.array_append("_s.chosen", F.col("_next")))
                .alias("chosen"),
            )
        )
    return chosen.select(*SHEET, F.posexplode("chosen").alias("pos", "c")).select(*SHEET, "pos", "c.*")


def overlap_anchors(
    waypoints: DataFrame,
    allow_list: Sequence[str] = OVERLAP_CODES,
    n: int = 3,
    lats: tuple[float, float] = OVERLAP_LATS,
) -> DataFrame:
    """The first ``n`` usable codes of the allow list per edition, or none; by (lon, code)."""
    if n < 1 or n > len(allow_list):
        return waypoints.limit(0).select("edition", F.lit(0).alias("pos"), "code", "lat", "lon")
    codes = [c.lower() for c in allow_list]
    key = F.lower("code")
    first = (
        waypoints.where(key.isin(codes))
        .groupBy("edition", key.alias("k"))
        .agg(F.min(F.struct("ord", "code", "lat", "lon", "reporting_type")).alias("w"))
        .select("edition", F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("k")).alias("rank"), "w.*")
    )
    usable = _pool(first).where(F.col("lat").between(lats[0] - 1e-9, lats[1] + 1e-9))
    entry = F.struct("rank", "lon", F.lower("code").alias("k"), "code", "lat")
    # At most one row per allow-listed code reaches the list.
    lists = usable.groupBy("edition").agg(F.array_sort(F.collect_list(entry)).alias("l")).where(F.size("l") >= n)
    ordered = F.array_sort(
        F.transform(F.slice("l", 1, n), lambda e: F.struct(e["lon"].alias("lon"), e["k"].alias("k"), e["code"].alias("code"), e["lat"].alias("lat")))
    )
    return lists.select("edition", F.posexplode(ordered).alias("pos", "a")).select("edition", "pos", "a.code", "a.lat", "a.lon")


def select_anchors(waypoints: DataFrame, n: int, allow_list: Sequence[str] = OVERLAP_CODES, n_overlap: int = 3) -> DataFrame:
    """Edge anchors of each sheet followed by the overlap anchors it does not have yet."""
    candidates = cut(anchor_candidates(waypoints))
    edge = spread_anchors(candidates, anchor_pairs(candidates), n)
    shared = overlap_anchors(waypoints, allow_list, n_overlap)
    extra = (
        edge.select(*SHEET)
        .distinct()
        .join(shared, "edition")
        .withColumn("_k", F.lower("code"))
        .join(edge.select(*SHEET, F.lower("code").alias("_k")), [*SHEET, "_k"], "left_anti")
        .withColumn("pos", F.col("pos") + n)
    )
    return edge.unionByName(extra.select(*edge.columns))
