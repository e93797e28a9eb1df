"""Feed cleaning, wake lookup, labels and per-snapshot reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_BOX = (29.0, 34.0, 33.5, 36.5)  # min lat, max lat, min lon, max lon
GROUND_SPEED_KTS = {"L": 50, "M": 100, "H": 120, "J": 140, "unknown": 50}
UNKNOWN_WAKE = "unknown"
WHITESPACE = " \t\r\n\f\x0b"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("entry", f"$.{path}", kind)


def _whole(path: str) -> Column:
    """Integer, else a truncated number, else 0."""
    return F.coalesce(
        _get(path, "bigint"), _get(path, "double").try_cast("bigint"), F.lit(0).cast("bigint")
    )


def _text(path: str) -> Column:
    return F.coalesce(_get(path, "string"), F.lit(""))


def clean_pilots(entries: DataFrame) -> DataFrame:
    """Validate and coerce feed entries; rows without id or position are dropped."""
    picked = F.coalesce(
        *[
            F.nullif(_get(f"flight_plan.{name}", "string"), F.lit(""))
            for name in ("aircraft_short", "aircraft_faa", "aircraft")
        ]
    )
    return entries.select(
        *[c for c in entries.columns if c != "entry"],
        _get("cid", "bigint").alias("cid"),
        _text("callsign").alias("callsign"),
        _text("name").alias("name"),
        _get("latitude", "double").alias("lat"),
        _get("longitude", "double").alias("lon"),
        _whole("altitude").alias("altitude_ft"),
        _whole("groundspeed").alias("groundspeed_kts"),
        F.pmod(_whole("heading"), F.lit(360)).cast("int").alias("heading_deg"),
        _text("transponder").alias("transponder"),
        F.nullif(_strip(picked), F.lit("")).alias("aircraft_type"),
        _text("flight_plan.flight_rules").alias("flight_rules"),
        _text("flight_plan.departure").alias("departure"),
        _text("flight_plan.arrival").alias("arrival"),
    ).where(F.col("cid").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def with_wake(pilots: DataFrame, wake: DataFrame) -> DataFrame:
    """Wake category from the first slash-separated part of the type that is known.

    The lookup runs once per distinct type text (a partial aggregate, so even a
    type that fills a third of the rows collapses before the shuffle); pilots
    then join the small result. Whether that side is broadcast is left to the
    size Spark measures at run time.
    """
    types = pilots.where(F.col("aircraft_type").isNotNull()).select("aircraft_type").distinct()
    parts = types.select("aircraft_type", F.posexplode(F.split("aircraft_type", "/")).alias("part_no", "part"))
    found = (
        parts.join(wake, F.upper(_strip(F.col("part"))) == F.col("type_code"))
        .groupBy("aircraft_type")
        .agg(F.min_by("wake", "part_no").alias("wake"))
    )
    return pilots.join(found, "aircraft_type", "left").select(
        *pilots.columns, F.coalesce("wake", F.lit(UNKNOWN_WAKE)).alias("wake")
    )


def in_bbox(df: DataFrame, box: tuple[float, float, float, float] = DEFAULT_BOX, pad: float = 0.0) -> DataFrame:
    """Rows inside the box, edges included; the bounds reach the scan."""
    lat0, lat1, lon0, lon1 = box
    return df.where(
        F.col("lat").between(lat0 - pad, lat1 + pad) & F.col("lon").between(lon0 - pad, lon1 + pad)
    )


def on_ground() -> Column:
    limit = F.lit(GROUND_SPEED_KTS[UNKNOWN_WAKE])
    for wake, kts in GROUND_SPEED_KTS.items():
        limit = F.when(F.col("wake") == wake, kts).otherwise(limit)
    return F.col("groundspeed_kts") < limit


def traffic_board(pilots: DataFrame) -> DataFrame:
    """Ground state and the texts shown for each aircraft."""
    height = F.greatest(F.lit(0), F.col("altitude_ft"))
    feet = F.concat(height.cast("string"), F.lit("ft"))
    level = F.floor(height / 100).cast("string")
    level = F.when(F.length(level) >= 3, level).otherwise(F.lpad(level, 3, "0"))
    altitude = (
        F.when(F.col("on_ground"), "GRND")
        .when(F.col("aircraft_type").isNull() | (F.upper(_strip(F.col("flight_rules"))) == "V"), feet)
        .otherwise(F.concat(F.lit("FL"), level))
    )
    kind = _strip(F.coalesce("aircraft_type", F.lit("")))
    ends = F.when(
        (F.col("departure") != "") | (F.col("arrival") != ""),
        F.concat(
            F.coalesce(F.nullif("departure", F.lit("")), F.lit("?")),
            F.lit(" → "),
            F.coalesce(F.nullif("arrival", F.lit("")), F.lit("?")),
        ),
    )
    detail = F.concat_ws(
        "\n",
        "callsign",
        F.concat(F.coalesce("aircraft_type", F.lit("(no flight plan)")), F.lit(" · "), "wake"),
        F.format_string(
            "ALT %d ft · GS %d kt · HDG %03d°", "altitude_ft", "groundspeed_kts", "heading_deg"
        ),
        ends,
    )
    return (
        pilots.withColumn("on_ground", on_ground())
        .withColumn("altitude_text", altitude)
        .withColumn("top_line", F.when(kind != "", F.concat("callsign", F.lit("/"), kind)).otherwise(F.col("callsign")))
        .withColumn(
            "bottom_line",
            F.concat(
                "altitude_text", F.lit("/"), F.greatest(F.lit(0), F.col("groundspeed_kts")).cast("string"), F.lit("kt")
            ),
        )
        .withColumn("detail_text", detail)
    )


def snapshot_chain(pilots: DataFrame) -> DataFrame:
    """Each distinct snapshot time with its number (from 1) and the time after it.

    Times are numbered within their day and days add up, so no task orders all of them.
    """
    times = pilots.select("snapshot_ts").distinct().withColumn("_day", F.to_date("snapshot_ts"))
    days = times.groupBy("_day").agg(F.count("*").alias("n")).select(
        "_day",
        F.coalesce(F.sum("n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = F.row_number().over(Window.partitionBy("_day").orderBy("snapshot_ts"))
    numbered = times.withColumn("_at", within).join(days, "_day").select("snapshot_ts", (F.col("_before") + F.col("_at")).alias("ordinal"))
    after = numbered.select((F.col("ordinal") - 1).alias("ordinal"), F.col("snapshot_ts").alias("next_ts"))
    return numbered.join(after, "ordinal", "left")


def presence_changes(pilots: DataFrame) -> DataFrame:
    """Callsigns missing from the following snapshot ('lost') or new in it ('appeared')."""
    seen = pilots.select("callsign", "snapshot_ts").distinct().join(snapshot_chain(pilots), "snapshot_ts")
    order = Window.partitionBy("callsign").orderBy("ordinal")  # a row per snapshot at most
    step = lambda f, n: F.coalesce(f("ordinal").over(order) == F.col("ordinal") + n, F.lit(False))
    change = lambda ts, name: F.struct(F.col(ts).alias("snapshot_ts"), F.lit(name).alias("change"))
    lost = F.when(F.col("next_ts").isNotNull() & ~step(F.lead, 1), change("next_ts", "lost"))
    appeared = F.when((F.col("ordinal") > 1) & ~step(F.lag, -1), change("snapshot_ts", "appeared"))
    return seen.select("callsign", lost.alias("lost"), appeared.alias("appeared")).select(
        "callsign", F.explode(F.array_compact(F.array("lost", "appeared"))).alias("c")
    ).select("callsign", "c.snapshot_ts", "c.change")


def traffic_counts(pilots: DataFrame) -> DataFrame:
    """Aircraft per snapshot, wake category and ground state."""
    return pilots.groupBy("snapshot_ts", "wake", on_ground().alias("on_ground")).agg(
        F.count("*").alias("n_aircraft")
    )


def traffic_rollup(pilots: DataFrame) -> DataFrame:
    """Counts per snapshot and wake with subtotals (NULL wake = whole snapshot)."""
    return pilots.rollup("snapshot_ts", "wake").agg(
        F.count("*").alias("n_aircraft"), F.grouping_id().cast("int").alias("level")
    )


SKETCH_BITS = 12  # 4096 registers: a standard error of 1.04 / 64, 1.6 percent


def traffic_sketches(pilots: DataFrame, width: str, *by: str) -> DataFrame:
    """(window_start, window_end, by..., sketch): which callsigns a time window saw, as a mergeable sketch of fixed size."""
    return (
        pilots.groupBy(F.window("snapshot_ts", width).alias("w"), *by)
        .agg(F.hll_sketch_agg("callsign", SKETCH_BITS).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "sketch")
    )


def distinct_traffic(sketches: DataFrame, width: str, *by: str) -> DataFrame:
    """(window_start, by..., n_aircraft): estimated different callsigns of longer windows, from the sketches of their parts.

    ``width`` should be a multiple of the sketches' width. The estimate is within
    5 percent, three standard errors, in 99.7 of 100 cases.
    """
    return (
        sketches.groupBy(F.window("window_start", width).alias("w"), *by)
        .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_aircraft"))
        .select(F.col("w.start").alias("window_start"), *by, "n_aircraft")
    )


def current_traffic(pilots: DataFrame) -> DataFrame:
    """Rows of the newest snapshot; its time is one row, found by a partial aggregate."""
    newest = pilots.agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return pilots.join(F.broadcast(newest), "snapshot_ts")


def dedupe_snapshots(entries: DataFrame) -> DataFrame:
    """Keep one copy of each snapshot's entries when a document landed twice."""
    return entries.dropDuplicates(["snapshot_ts", "pos"])
