"""Plan lines -> points -> legs -> totals.

Points travel as rows ``(plan_id, n_points, block, seq, is_wp, code, name, lat,
lon)``. Everything ordered runs per (plan_id, block), see ``blocks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import assembly, blocks

PLAN = ["plan_id"]
PLAN_BLOCK = ["plan_id", "block"]

# Fixed values.
CODE_PATTERN = r"^[A-Z]{4,5}$"
ORPHAN_BASE = "VIA"
SPEED_LIMIT_KTS = 180.0
FALLBACK_PLAN_NAME = "flight-plan"
BEARING_PATTERN = r"^\d{1,3}$"
ALTITUDES_PATTERN = r"^\d{1,5}(\s*,\s*\d{1,5})*$"
DISTANCE_PATTERN = r"^\d{1,4}(\.\d{1,2})?$"
FREQUENCY_PATTERN = r"^\d{3}\.(\d{3}|\d)$"
UNKNOWN_ALTITUDE = "unknown"

# --- plan text ----------------------------------------------------------------


def parse_plans(
    plans: DataFrame, block_rows: int = blocks.BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Split plan lines into tokens; a plan with any bad token yields one error row.

    A line is one row, so finding its first bad token needs no shuffle: the
    token array is checked in place and only valid plans are exploded.
    """
    line = F.regexp_replace(F.col("text"), r"^\s+|\s+$", "")

    def problem(tok: Column) -> Column:
        lat, _ = geo.parse_coord(tok)
        return (
            F.when(tok == "", "empty token")
            .when(tok.rlike(CODE_PATTERN), F.lit(None))
            .when(lat.isNotNull(), F.lit(None))
            .when(tok.rlike(geo.COORD_PATTERN), "coordinate out of range")
            .otherwise("not a code or coordinate")
        )

    split = plans.select("plan_id", F.split(line, " ", -1).alias("toks"), (line == "").alias("blank"))
    checked = split.withColumn(
        "bad",
        F.get(
            F.filter(
                F.transform(
                    "toks",
                    lambda t, i: F.struct((i + 1).alias("position"), t.alias("token"), problem(t).alias("reason")),
                ),
                lambda e: e.reason.isNotNull(),
            ),
            0,
        ),
    )
    errors = checked.where(F.col("blank") | F.col("bad").isNotNull()).select(
        "plan_id",
        F.when(~F.col("blank"), F.col("bad.position")).alias("position"),
        F.when(~F.col("blank"), F.col("bad.token")).alias("token"),
        F.when(F.col("blank"), "empty plan").otherwise(F.col("bad.reason")).alias("reason"),
    )
    rows = checked.where(~F.col("blank") & F.col("bad").isNull()).select(
        "plan_id", F.size("toks").alias("n_points"), F.posexplode("toks").alias("pos", "token")
    )
    lat, lon = geo.parse_coord(F.col("token"))
    is_code = F.col("token").rlike(CODE_PATTERN)
    tokens = rows.select(
        "plan_id",
        "n_points",
        blocks.block_of(F.col("pos"), block_rows).alias("block"),
        (F.col("pos") + 1).alias("position"),
        F.when(is_code, "code").otherwise("coord").alias("kind"),
        F.when(is_code, F.col("token")).alias("code"),
        F.when(~is_code, lat).alias("lat"),
        F.when(~is_code, lon).alias("lon"),
        "token",
    )
    return tokens, errors


def resolve_plans(tokens: DataFrame, waypoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace codes by catalogue positions; one unknown code rejects its plan."""
    catalogue = (
        waypoints.groupBy(F.upper(F.trim("code")).alias("_code"))
        .agg(
            F.min_by(
                F.struct("code", "name_he", "lat", "lon"),
                F.struct(F.coalesce("name_he", F.lit("")), F.col("idx")),
            ).alias("w")
        )
    )
    # one look-up of all tokens; coordinates have no key, so they meet nothing and stay spread
    keyed = tokens.withColumn("_code", F.when(F.col("kind") == "code", F.upper("code")))
    keyed = keyed.join(catalogue, "_code", "left")
    unknown = F.when((F.col("kind") == "code") & F.col("w").isNull(), F.struct("position", "token"))
    first = F.min(unknown)
    errors = (
        keyed.groupBy("plan_id").agg(first.alias("e")).where(F.col("e").isNotNull())
        .select("plan_id", "e.position", "e.token", F.lit("unknown code").alias("reason"))
    )
    # a plan was one row of text, so its tokens may be looked at together
    whole = keyed.withColumn("e", first.over(blocks.Window.partitionBy("plan_id"))).where(F.col("e").isNull())
    points = whole.select(
        "plan_id", "n_points", "block", (F.col("position") - 1).alias("seq"), (F.col("kind") == "code").alias("is_wp"),
        "w.code", F.col("w.name_he").alias("name"), F.coalesce("w.lat", "lat").alias("lat"), F.coalesce("w.lon", "lon").alias("lon"),
    )
    return points, errors


# --- assembly -------------------------------------------------------------------


def assemble_plans(points: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Drop repeats the way an editor refuses them, see ``assembly.walked``."""
    return assembly.walked(points, block_rows).drop("label", "next_is_wp", "next_lat", "next_lon", "next_label")


def assembled_labels(points: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Assembled points with their labels, from the same pass."""
    return assembly.walked(points, block_rows).drop("next_is_wp", "next_lat", "next_lon", "next_label")


# --- labels and legs --------------------------------------------------------------


def _label(last_wp: Column, seq: Column, is_wp: Column, code: Column) -> Column:
    n = F.when(last_wp.isNull(), seq + 1).otherwise(seq - last_wp.seq)
    return F.when(is_wp, code).otherwise(
        F.concat(F.coalesce(last_wp.code, F.lit(ORPHAN_BASE)), F.lit("."), n.cast("string"))
    )


def _with_context(points: DataFrame, block_rows: int) -> DataFrame:
    """Add ``last_wp`` (code, seq) and the next point, across blocks."""
    w = blocks.in_block(PLAN, "seq")
    wp = F.when(F.col("is_wp"), F.struct("code", "seq"))
    point = F.struct("is_wp", "code", "lat", "lon")
    carry = (
        blocks.long_groups(points, block_rows)
        .groupBy(*PLAN_BLOCK)
        .agg(F.max_by(wp, F.when(F.col("is_wp"), F.col("seq"))).alias("lw"), F.min_by(point, "seq").alias("first"))
        .select(
            *PLAN_BLOCK,
            F.last("lw", ignorenulls=True)
            .over(blocks.over_blocks(PLAN).rowsBetween(blocks.Window.unboundedPreceding, -1))
            .alias("c_wp"),
            F.lead("first").over(blocks.over_blocks(PLAN)).alias("c_next"),
        )
    )
    return (
        points.withColumn("_wp", F.last(wp, ignorenulls=True).over(w))
        .withColumn("_next", F.lead(point).over(w))
        .join(carry, PLAN_BLOCK, "left")
        .withColumn("last_wp", F.coalesce("_wp", "c_wp"))
        .withColumn("next", F.coalesce("_next", "c_next"))
        .drop("_wp", "_next", "c_wp", "c_next")
    )


def label_points(points: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Waypoints show their code, intermediates ``<last code>.<n>``."""
    return (
        _with_context(points, block_rows)
        .withColumn("label", _label(F.col("last_wp"), F.col("seq"), F.col("is_wp"), F.col("code")))
        .drop("last_wp", "next")
    )


def _measured(pairs: DataFrame, magvar: float) -> DataFrame:
    """Distance and bearings of rows with from_* and to_* columns."""
    a_lat, a_lon, b_lat, b_lon = (F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon"))
    return pairs.withColumns({
        "distance_nm": geo.great_circle_nm(a_lat, a_lon, b_lat, b_lon),
        "true_bearing_deg": geo.true_bearing_deg(a_lat, a_lon, b_lat, b_lon),
    }).withColumn("mag_bearing_deg", F.pmod(F.col("true_bearing_deg") - magvar, F.lit(360.0)))


def legs(
    points: DataFrame,
    magvar: float = geo.DEFAULT_MAGVAR_E,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """One row per adjacent pair of points, with labels, distance and bearings."""
    ctx = _with_context(points, block_rows).where(F.col("next").isNotNull())
    pairs = ctx.select(
        "plan_id",
        "n_points",
        "block",
        (F.col("seq") + 1).alias("leg_no"),
        _label(F.col("last_wp"), F.col("seq"), F.col("is_wp"), F.col("code")).alias("from_label"),
        _label(F.col("last_wp"), F.col("seq") + 1, F.col("next.is_wp"), F.col("next.code")).alias("to_label"),
        F.col("is_wp").alias("from_is_wp"),
        F.col("next.is_wp").alias("to_is_wp"),
        F.col("lat").alias("from_lat"),
        F.col("lon").alias("from_lon"),
        F.col("next.lat").alias("to_lat"),
        F.col("next.lon").alias("to_lon"),
    )
    return _measured(pairs, magvar)


def kept_legs(points: DataFrame, magvar: float = geo.DEFAULT_MAGVAR_E, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Assembled points (``from_*``), each with the leg that begins there; the last of a plan has no ``to_*``."""
    pairs = assembly.walked(points, block_rows).select(
        "plan_id", "n_points", "block", (F.col("seq") + 1).alias("leg_no"), F.col("label").alias("from_label"), F.col("next_label").alias("to_label"),
        F.col("is_wp").alias("from_is_wp"), F.col("next_is_wp").alias("to_is_wp"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"),
        F.col("next_lat").alias("to_lat"), F.col("next_lon").alias("to_lon"),
    )
    return _measured(pairs, magvar)


def plan_legs(points: DataFrame, magvar: float = geo.DEFAULT_MAGVAR_E, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Assemble and measure in one go: the pass that keeps points also pairs them."""
    return kept_legs(points, magvar, block_rows).where(F.col("to_label").isNotNull())


def with_times(legs_df: DataFrame, speed_kts: float | Column) -> DataFrame:
    """Leg time in seconds and as HH:MM:SS, and the whole-degree heading."""
    return (
        legs_df.withColumn("seconds", geo.leg_seconds(F.col("distance_nm"), speed_kts))
        .withColumn("time_text", geo.hms(F.col("seconds")))
        .withColumn("shown_bearing", geo.shown_bearing(F.col("mag_bearing_deg")))
    )


# --- overrides and totals -----------------------------------------------------------


def _one_decimal(v: Column) -> Column:
    """Tenths of a typed distance, rounded as a correctly rounded ``%.1f`` prints it.

    Decimal ties are decided by the side on which the nearest double lies: the
    exact error of ``v * 100`` comes from splitting v into two halves.
    """
    cents = F.bround(v * 100.0, 0)
    big = v * 134217729.0
    hi = big - (big - v)
    prod = v * 100.0
    err = (prod - cents) + ((hi * 100.0 - prod) + (v - hi) * 100.0)
    tenths = F.floor(cents / 10.0)
    rest = cents - tenths * 10.0
    up = (rest > 5.0) | (
        (rest == 5.0) & ((err > 0.0) | ((err == 0.0) & (F.pmod(tenths, F.lit(2)) == 1)))
    )
    return (tenths + F.when(up, 1).otherwise(0)).cast("int")


def parse_override(column: str, text: Column) -> Column:
    """Canonical stored text of a typed override, NULL when it is to be ignored."""
    t = _typed(text)
    return _canonical(column, t, _distance(t))


def _distance(t: Column) -> Column:
    """Value of a well-formed distance; a cast of any other text would cost an exception."""
    return F.when(t.rlike(DISTANCE_PATTERN), t.try_cast("double"))


def _typed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _canonical(column: str, t: Column, v: Column) -> Column:
    """The same of a text without blanks around it and its value as a distance."""
    if column == "bearing":
        n = t.try_cast("int")
        return F.when(t.rlike(BEARING_PATTERN) & (n <= 360), F.lpad(n.cast("string"), 3, "0"))
    if column == "altitude":
        values = F.transform(F.split(t, ","), lambda p: F.trim(p).try_cast("int"))
        return F.when(
            t.rlike(ALTITUDES_PATTERN) & F.forall(values, lambda v: v > 0),
            F.array_join(F.transform(values, lambda v: v.cast("string")), ","),
        )
    if column == "distance":
        tenths = F.when(v > 0.0, _one_decimal(v))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    if column == "frequency":
        return F.when(t.rlike(FREQUENCY_PATTERN), t)
    if column == "controller":
        return F.nullif(t, F.lit(""))
    raise ValueError(f"unknown override column {column!r}")


OVERRIDE_FIELDS = {
    "bearing": "bearing",
    "altitude": "altitude",
    "distance": "distance",
    "ctr": "controller",
    "freq": "frequency",
    "new_ctr": "controller",
    "new_freq": "frequency",
}


def apply_overrides(legs_df: DataFrame, overrides: DataFrame, speed_kts: float | Column) -> DataFrame:
    """Join hand-typed values onto legs and recompute what depends on them.

    ``overrides``: plan_id, from_label, to_label, field, text, edit_no. Invalid
    texts leave the earlier value alone, so the last *valid* edit of a field
    wins. Repeated legs share their key and therefore their overrides.
    """
    stored = F.lit(None).cast("string")
    for kind in dict.fromkeys(OVERRIDE_FIELDS.values()):
        fields = [f for f, k in OVERRIDE_FIELDS.items() if k == kind]
        stored = F.when(F.col("field").isin(fields), _canonical(kind, F.col("_t.text"), F.col("_t.value"))).otherwise(stored)
    key = ["plan_id", "from_label", "to_label"]
    distance = F.col("field").isin([f for f, k in OVERRIDE_FIELDS.items() if k == "distance"])
    # exploded, so that a text is parsed once and not in every place that reads the result
    cleaned = overrides.select(*key, "field", "edit_no", F.explode(F.array(_typed(F.col("text")))).alias("text"))
    cleaned = cleaned.select(*key, "field", "edit_no", F.explode(F.array(F.struct("text", F.when(distance, _distance(F.col("text"))).alias("value")))).alias("_t"))
    parsed = cleaned.select(*key, "field", "edit_no", F.explode(F.array(stored)).alias("stored")).where(F.col("stored").isNotNull())
    last = parsed.groupBy(*key, "field").agg(F.max(F.struct("edit_no", "stored")).alias("e"))
    side = last.groupBy(*key).agg(*[F.max(F.when(F.col("field") == f, F.col("e.stored"))).alias(f"set_{f}") for f in OVERRIDE_FIELDS])
    # The stored distance is validated again when used: "0.0" and five digits fall back.
    nm = F.when(
        F.col("set_distance").rlike(DISTANCE_PATTERN), F.col("set_distance").try_cast("double")
    )
    alts = F.transform(F.split("set_altitude", ","), lambda p: p.try_cast("int"))
    base_alts = F.col("altitudes_ft") if "altitudes_ft" in legs_df.columns else F.array().cast("array<int>")
    return (
        legs_df.join(side, key, "left")
        .withColumn("eff_distance_nm", F.when(nm > 0.0, nm).otherwise(F.col("distance_nm")))
        .withColumn(
            "eff_bearing",
            F.coalesce(F.col("set_bearing").try_cast("int"), geo.shown_bearing(F.col("mag_bearing_deg"))),
        )
        .withColumn("eff_altitudes_ft", F.coalesce(alts, base_alts))
        .withColumn("eff_seconds", geo.leg_seconds(F.col("eff_distance_nm"), speed_kts))
        .withColumnsRenamed({f"set_{f}": f for f in ("ctr", "freq", "new_ctr", "new_freq")})
        .drop("set_bearing", "set_altitude", "set_distance")
    )


def route_totals(eff_legs: DataFrame, speed_kts: float | Column) -> DataFrame:
    """Distance, time, highest altitude and over-speed flag per plan."""
    speed = speed_kts if isinstance(speed_kts, Column) else F.lit(float(speed_kts))
    top = F.array_max("eff_altitudes_ft") if "eff_altitudes_ft" in eff_legs.columns else F.lit(None).cast("int")
    has_eff = "eff_distance_nm" in eff_legs.columns
    dist = F.col("eff_distance_nm" if has_eff else "distance_nm")
    return eff_legs.groupBy("plan_id").agg(
        F.count("*").alias("n_legs"),
        F.sum(dist).alias("total_nm"),
        F.sum(geo.leg_seconds(dist, speed)).alias("total_seconds"),
        F.max(top).alias("max_altitude_ft"),
        F.coalesce(F.max(speed > SPEED_LIMIT_KTS), F.lit(False)).alias("over_speed"),
    )


# --- strings ---------------------------------------------------------------------------


def plan_strings(points: DataFrame, include_intermediates: bool = True, filed: bool = False) -> DataFrame:
    """Plan line and local-name line, one row per plan; with ``filed`` also the line of the waypoints only, NULL without any.

    Blocks become texts first; only these are put together, so a long plan is
    sorted in many tasks.
    """
    coord = geo.format_coord(F.col("lat"), F.col("lon"))
    df = points if include_intermediates else points.where(F.col("is_wp"))
    entry = F.struct(
        "seq",
        F.when(F.col("is_wp"), F.col("code")).otherwise(coord).alias("code"),
        F.when(F.col("is_wp"), F.coalesce(F.nullif("name", F.lit("")), "code")).otherwise(coord).alias("name"),
        "is_wp",
    )
    texts = [F.array_join("e.code", " ").alias("plan"), F.array_join("e.name", " ").alias("local")]
    whole = [F.array_join("p.plan", " ").alias("plan_text"), F.array_join("p.local", " ").alias("local_text")]
    if filed:
        of = lambda e: F.transform(e, lambda x: x["code"])
        ways = F.filter("e", lambda x: x["is_wp"])
        texts.append(F.when(F.exists("e", lambda x: x["is_wp"]), F.array_join(of(ways), " ")).alias("filed"))
        # blocks without a waypoint are NULL, which joining leaves out
        whole.append(F.when(F.exists("p.filed", lambda t: t.isNotNull()), F.array_join("p.filed", " ")).alias("filed_text"))
    parts = df.groupBy(*PLAN_BLOCK).agg(F.array_sort(F.collect_list(entry)).alias("e")).select("plan_id", F.struct("block", *texts).alias("p"))
    return parts.groupBy("plan_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("plan_id", *whole)


def plan_names(points: DataFrame) -> DataFrame:
    """Name of each plan from its first and last waypoint (a file suffix is the caller's)."""
    at = F.when(F.col("is_wp"), F.col("seq"))
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    ends = points.groupBy("plan_id").agg(
        clean(F.min_by("code", at)).alias("a"), clean(F.max_by("code", at)).alias("b")
    )
    return ends.select(
        "plan_id",
        F.when(F.col("a").isNull() | (F.col("a") == "") | (F.col("b") == ""), FALLBACK_PLAN_NAME)
        .when(F.col("a") == F.col("b"), F.col("a"))
        .otherwise(F.concat("a", F.lit("-"), "b"))
        .alias("plan_name"),
    )
