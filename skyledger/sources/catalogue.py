"""Readers and writers for catalogue cells, plan lines, leg sheets and waypoint tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import routes, waypoints

MIN_CELLS = 5

# Column order of the exported files.
WAYPOINT_COLUMNS = ("Code", "Name", "Type", "Lat °", "Lon °", "Lat DMS", "Lon DMS")
LEG_COLUMNS = (
    "From", "To", "Reporting", "Type", "CTR", "Freq", "New CTR", "New Freq", "MAG BRG", "Alt (ft)", "Dist (nm)", "Time",
)


def table_rows(cells: DataFrame) -> DataFrame:
    """Data rows of raw tables: the first row of each table is a header, short rows go."""
    return cells.where((F.col("row_no") > 0) & (F.size("meta") + 3 >= MIN_CELLS))


def read_waypoint_cells(spark: SparkSession, path: str) -> DataFrame:
    """Raw reporting-point cells stored as parquet."""
    return table_rows(spark.read.parquet(path))


def write_waypoints(df: DataFrame, table: str) -> None:
    """Replace a waypoint table, one partition per mode, sorted by code for point lookups."""
    (
        df.repartition("mode_id", "code")
        .sortWithinPartitions("mode_id", "code")
        .write.mode("overwrite")
        .partitionBy("mode_id")
        .saveAsTable(table)
    )


def write_waypoint_files(df: DataFrame, path: str) -> None:
    """The same layout as files: a folder per mode, ranges of codes apart, so that a look-up opens few files."""
    df.repartitionByRange("mode_id", "code").sortWithinPartitions("mode_id", "code").write.mode("overwrite").partitionBy("mode_id").parquet(path)


def waypoints_by_code(spark: SparkSession, path: str, mode_id, codes: list[str]) -> DataFrame:
    """Rows of one mode with one of a few codes (upper case, no blanks); the mode prunes folders, codes reach the scan."""
    wanted = sorted({c.strip().upper() for c in codes})
    return spark.read.parquet(path).where((F.col("mode_id") == mode_id) & F.col("code").isin(wanted))


def waypoint_sheet(df: DataFrame) -> DataFrame:
    """The seven export columns, in export order."""
    fixed = lambda c: F.format_string("%.6f", F.col(c))
    return df.orderBy(*waypoints.name_order()).select(
        *[
            c.alias(n)
            for n, c in zip(
                WAYPOINT_COLUMNS,
                (F.col("code"), F.coalesce("name_he", F.lit("")), F.col("reporting_type"), fixed("lat"), fixed("lon"),
                 F.col("lat_dms"), F.col("lon_dms")),
            )
        ]
    )


def export_waypoints_csv(df: DataFrame, path: str) -> None:
    """CSV with header, in name order across the part files (no byte-order mark)."""
    waypoint_sheet(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """One plan line per file; the file's path is the plan's id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("plan_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")
    )


def export_plans(points: DataFrame, path: str, include_intermediates: bool = True) -> None:
    """Plan lines with their derived names as parquet."""
    lines = routes.plan_strings(points, include_intermediates)
    lines.join(routes.plan_names(points), "plan_id").write.mode("overwrite").parquet(path)


def leg_sheet(legs_df: DataFrame) -> DataFrame:
    """The twelve leg columns as text, from legs with applied overrides.

    Optional columns (to_name, to_type, ctr, freq, new_ctr, new_freq) are blank when absent.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in legs_df.columns else F.lit("")
    brg = F.concat(F.lpad((F.col("eff_bearing") % 360).cast("string"), 3, "0"), F.lit("°M"))
    alts = F.array_join(F.transform("eff_altitudes_ft", lambda a: a.cast("string")), ",")
    values = (
        F.col("from_label"), F.col("to_label"), blank("to_name"), blank("to_type"), blank("ctr"), blank("freq"),
        blank("new_ctr"), blank("new_freq"), brg, F.when(alts == "", routes.UNKNOWN_ALTITUDE).otherwise(alts),
        F.format_string("%.1f", F.col("eff_distance_nm")), geo.hms(F.col("eff_seconds")),
    )
    return legs_df.select("plan_id", "leg_no", *[v.alias(n) for n, v in zip(LEG_COLUMNS, values)])


def export_legs(legs_df: DataFrame, path: str) -> None:
    """Tab-separated leg sheets: plan id and leg number, then the twelve columns."""
    (
        leg_sheet(legs_df)
        .repartitionByRange("plan_id", "leg_no")
        .sortWithinPartitions("plan_id", "leg_no")
        .write.mode("overwrite")
        .option("sep", "\t")
        .option("header", True)
        .csv(path)
    )
