"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import waypoints
from skyledger.plans.views import load, oracle

QUERIES = {}
ORACLES = {}

# Per kind: meta cells (x0, text) and the expected (name, type) for mixed and for cell-wise text.
NAMES = [
    ([(1.0, "חובה צומת גולני"), (2.0, "12 abc")], ("צומת גולני", "חובה"), ("צומת גולני", "חובה")),
    ([(1.0, "ARP"), (2.0, "ראש פינה")], ("ראש פינה", "ARP"), ("ראש פינה", "ARP")),
    ([(1.0, "כפר סבא ("), (2.0, "דרישה")], ("כפר סבא", "דרישה"), ("כפר סבא (", "דרישה")),
    ([(1.0, "שדה"), (2.0, "בוקר")], ("שדה בוקר", ""), ("בוקר שדה", "")),
    ([(1.0, "ב נמל אשדוד"), (2.0, "")], ("נמל אשדוד", ""), ("נמל אשדודב", "")),
    ([(1.0, "מגדלימ"), (2.0, "חובה")], ("מגדלים", "חובה"), ("מגדלים", "חובה")),
    ([(1.0, "שפך")], ("שפך", ""), ("שפך", "")),
    ([(1.0, "בית שמש רז רדז"), (2.0, "חובה")], ("בית שמש רז רדז", "חובה"), ("בית שמש רז רדז", "חובה")),
    ([(1.0, 'כרם מהר"ל')], ("כרם מהר", ""), ('כרם מהר"ל', "")),
    ([(1.0, "דור*"), (2.0, "דרישה")], ("דור", "דרישה"), ("דור", "דרישה")),
    ([(1.0, "א אור עקיב")], ("אור עקיב", ""), ("אור עקיבא", "")),
    ([(1.0, "| גילת")], ("גילת", ""), ("גילת", "")),
    ([(1.0, "7 עין גדי"), (2.0, "חובה")], ("עין גדי", "חובה"), ("עין גדי", "חובה")),
    ([(1.0, "xx ווו מחלף ינאי היד")], ("מחלף ינאי", ""), ("ווו מחלף ינאי היד", "")),
    ([(1.0, "ים המלחימ - צפונ"), (2.0, "דרישה")], ("ים המלחים צפון", "דרישה"), ("ים המלחים - צפון", "דרישה")),
    ([(1.0, "(a) אל כפר סבא"), (2.0, "חובה")], ("אל כפר סבא", "חובה"), ("אל כפר סבא", "חובה")),
    ([(1.0, "(a) אל7 כפר סבא"), (2.0, "חובה")], ("כפר סבא", "חובה"), ("אל7 כפר סבא", "חובה")),
]


def cells(spark, sf):
    meta = F.lit(None)
    for kind, (parts, _, _) in enumerate(NAMES):
        arr = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(t).alias("text")) for x, t in parts])
        meta = F.when(F.col("name_kind") == kind, arr).otherwise(meta)
    return load(spark, sf, "cell").withColumn("meta", meta)


def clean(spark, sf):
    return waypoints.clean_waypoints(cells(spark, sf))


def _expected(which: int, part: int) -> str:
    whens = " ".join(f"WHEN {k} THEN '{row[which][part]}'" for k, row in enumerate(NAMES))
    return f"CASE name_kind {whens} END"


CLEANED = f"""
cleaned AS (
  SELECT edition, mode_id, sheet, sheet_ord, ord, code,
    CASE WHEN strategy = 'vector' THEN {_expected(1, 0)} ELSE {_expected(2, 0)} END AS name_he,
    {_expected(1, 1)} AS reporting_type,
    d + m / 60e0 + CASE WHEN strategy = 'vector' THEN s + 0.5e0 ELSE s END / 3600e0 AS lat, od + om / 60e0 + s / 3600e0 AS lon,
    CASE WHEN strategy = 'vector' THEN d || '° ' || printf('%02d', m) || '''' || printf('%02d', s) || '.5" N' ELSE d || '° ' || printf('%02d', m) || ''' ' || printf('%02d', s) || '" N' END AS lat_dms,
    CASE WHEN strategy = 'vector' THEN od || '° ' || om || '''' || printf('%02d', s) || '" E' ELSE od || '° ' || printf('%02d', om) || ''' ' || printf('%02d', s) || '" E' END AS lon_dms
  FROM cell WHERE k % 29 <> 3 AND k % 31 <> 4 AND k % 17 <> 3
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY edition, mode_id, code, round_even(lat * 1e5, 0), round_even(lon * 1e5, 0) ORDER BY sheet_ord, ord) AS rn FROM cleaned
),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY edition, mode_id ORDER BY sheet_ord, ord) AS INT) AS idx FROM ranked WHERE rn = 1)"""

_COLS = "code, name_he, reporting_type, round(lat, 7) AS lat, round(lon, 7) AS lon, lat_dms, lon_dms"


def _rounded(df, *keys):
    return df.select(
        *keys, "code", "name_he", "reporting_type", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"),
        "lat_dms", "lon_dms",
    )


QUERIES["waypoint_clean"] = lambda spark, sf: _rounded(clean(spark, sf), "edition", "sheet_ord", "ord")
ORACLES["waypoint_clean"] = oracle("WITH " + CLEANED.lstrip() + f" SELECT edition, sheet_ord, ord, {_COLS} FROM cleaned", "cell")


def merged(spark, sf):
    return waypoints.merge_waypoints(clean(spark, sf))


QUERIES["waypoint_merge"] = lambda spark, sf: _rounded(merged(spark, sf), "edition", "mode_id", "idx")
ORACLES["waypoint_merge"] = oracle("WITH " + CLEANED.lstrip() + f" SELECT edition, mode_id, idx, {_COLS} FROM merged", "cell")

QUERIES["waypoint_classes"] = lambda spark, sf: waypoints.classify_waypoints(
    load(spark, sf, "waypoint").select("idx", F.when(F.col("idx") % 7 == 0, "LLBG").otherwise(F.col("code")).alias("code"),
                                       "name_he", F.when(F.col("rtype") == "M", waypoints.TYPE_MANDATORY)
                                       .when(F.col("rtype") == "R", F.lit(" דרישה ")).when(F.col("idx") % 22 == 0, "arp")
                                       .otherwise(F.col("rtype")).alias("reporting_type"), "lat", "lon"), "google"
).select("idx", "class", "airport", "label", "map_url")
ORACLES["waypoint_classes"] = oracle("""
SELECT idx, CASE rtype WHEN 'M' THEN 'mandatory' WHEN 'R' THEN 'on_demand' WHEN 'ARP' THEN 'arp' ELSE 'unknown' END AS class,
  rtype = 'ARP' OR idx % 7 = 0 AS airport, CASE WHEN name_he = '' THEN CASE WHEN idx % 7 = 0 THEN 'LLBG' ELSE code END ELSE name_he END AS label,
  'https://www.google.com/maps/@' || lat || ',' || lon || ',14.8z/data=!3m1!1e3' AS map_url
FROM waypoint
""", "waypoint")


QUERIES["waypoint_sorted"] = lambda spark, sf: waypoints.sort_waypoints(load(spark, sf, "waypoint"), "name_he").select(
    "idx", "code", "name_he"
)
ORACLES["waypoint_sorted"] = oracle("SELECT idx, code, name_he FROM waypoint ORDER BY lower(name_he), idx", "waypoint")
