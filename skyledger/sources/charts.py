"""Stored arrows, calibration anchors, tile folders, and what of it has to be read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import calib, tiles
from skyledger.session import cut

# Fixed values.
ARROW_FORMAT = 7
LAYOUT_SHIFT, LAYOUT_SCALE = 0.5, 1e-4
CROP_FIELDS = ("offset_x", "offset_y", "source_w", "source_h", "cropped_w", "cropped_h")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.try_parse_json("value").alias("v")
    )


def arrow_rows(docs: DataFrame, crops: DataFrame) -> DataFrame:
    """Arrows of stored documents (doc_id, edition, sheet, v) that match the current crop.

    ``crops``: edition, sheet, render_dpi and the six crop numbers. Another
    format version, resolution or crop skips the document; a malformed arrow
    skips itself.
    """
    num = lambda p, t: F.try_variant_get("v", p, t)
    match = (num("$.render_dpi", "double") == F.col("render_dpi"))
    for f in CROP_FIELDS:
        match = match & (num(f"$.crop.{f}", "int") == F.col(f))
    current = docs.where(num("$.format_version", "int") == ARROW_FORMAT).join(crops, ["edition", "sheet"]).where(match)
    entries = current.select(
        "edition", "sheet", F.posexplode(F.try_variant_get("v", "$.arrows", "array<variant>")).alias("arrow_no", "e")
    )
    get = lambda p, t: F.try_variant_get("e", p, t)
    return (
        entries.select(
            "edition", "sheet", "arrow_no",
            get("$.u", "double").alias("u"), get("$.v", "double").alias("v"), get("$.bearing_deg", "double").alias("bearing_deg"),
            get("$.altitudes_ft", "array<int>").alias("altitudes_ft"),
            F.coalesce(get("$.bidirectional", "boolean"), F.lit(False)).alias("bidirectional"),
        )
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("bearing_deg").isNotNull())
        .where(F.col("altitudes_ft").isNotNull() & ~F.exists("altitudes_ft", lambda a: a.isNull()))
    )


def read_arrows(spark: SparkSession, path: str, crops: DataFrame) -> DataFrame:
    """Stored arrow files ``.../<edition>/...<sheet>.json``."""
    docs = _documents(spark, path).select(
        "doc_id", "v",
        F.regexp_extract("doc_id", r"([^/]+)/[^/]*$", 1).alias("edition"),
        F.regexp_extract("doc_id", r"(north|south)[^/]*\.json$", 1).alias("sheet"),
    )
    return arrow_rows(docs, crops)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Anchors of calibration documents (edition, v); a sheet with a bad or too short list is dropped.

    The list is judged as one value of its document, before it is expanded.
    """
    sheets = docs.withColumn("sheet", F.explode(F.array(F.lit("north"), F.lit("south")))).withColumn(
        "pts",
        F.when(F.col("sheet") == "north", F.try_variant_get("v", "$.north.points", "array<variant>")).otherwise(
            F.try_variant_get("v", "$.south.points", "array<variant>")
        ),
    )
    get = lambda e, p, t: F.try_variant_get(e, p, t)
    rows = F.transform(
        "pts",
        lambda e: F.struct(
            get(e, "$.code", "string").alias("code"), get(e, "$.lat", "double").alias("lat"), get(e, "$.lon", "double").alias("lon"),
            get(e, "$.u", "double").alias("u"), get(e, "$.v", "double").alias("v"),
        ),
    )
    bad = lambda r: r["code"].isNull() | r["lat"].isNull() | r["lon"].isNull() | r["u"].isNull() | r["v"].isNull()
    return (
        # exploded, so that the filter does not read the list a second time
        sheets.select("edition", "sheet", F.explode(F.array(rows)).alias("rows"))
        .where((F.size("rows") >= calib.MIN_ANCHORS) & ~F.exists("rows", bad))
        .select("edition", "sheet", F.posexplode("rows").alias("ord", "r"))
        .select("edition", "sheet", "ord", "r.*")
    )


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Calibration files ``.../<edition>/<name>.json``."""
    return anchor_rows(
        _documents(spark, path).select(F.regexp_extract("doc_id", r"([^/]+)/[^/]*$", 1).alias("edition"), "v")
    )


def read_tile_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Tile files below ``root``; only the listing is read, never the images."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    return tiles.parse_tile_paths(files)


def write_tile_table(inventory: DataFrame, path: str) -> None:
    """Keep an inventory as files: a folder per provider and zoom, columns of tiles in order and ranges apart."""
    order = ["provider", "z", "x", "y"]
    inventory.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("provider", "z").parquet(path)


def tiles_in_range(spark: SparkSession, path: str, provider: str, zoom: int, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Stored tiles of a rectangle: folders are pruned by provider and zoom, files by their ranges of x and y."""
    stored = spark.read.parquet(path)
    return stored.where((F.col("provider") == provider) & (F.col("z") == zoom) & F.col("x").between(*x) & F.col("y").between(*y))


def update_tile_table(spark: SparkSession, path: str, listing: DataFrame) -> DataFrame:
    """Fold a newer listing (provider, z, x, y, bytes, mtime) of some folders into the table; returns what changed.

    ``listing`` is complete for every (provider, z) that it names, so folders that
    did not change need no listing. Only folders with a change (``change``: new,
    changed or gone) are written again; the rest stays as it lies.
    """
    key = ["provider", "z", "x", "y"]
    folders = listing.select("provider", "z").distinct()
    held = spark.read.parquet(path).join(folders, ["provider", "z"], "left_semi")
    both = held.select(*key, F.struct("bytes", "mtime").alias("old")).join(listing.select(*key, F.struct("bytes", "mtime").alias("new")), key, "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    # written first: the table is written over below
    changed = cut(both.select(*key, change.alias("change")).where(F.col("change").isNotNull()))
    touched = changed.select("provider", "z").distinct()
    fresh = listing.join(touched, ["provider", "z"], "left_semi")
    columns = [c for c in spark.read.parquet(path).columns if c not in ("provider", "z")]
    ordered = fresh.select(*columns, "provider", "z").repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "z").parquet(path)
    return changed


def canonical_url(url: Column) -> Column:
    """Percent-encode what is not allowed in a path, query or fragment; scheme in lower case.

    Encoded sequences stay as they are, so raw and encoded forms of one address agree.
    """
    t = F.regexp_replace(url, r"^\s+|\s+$", "")
    scheme = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    host = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?", 1)
    rest = F.substr(t, F.length(scheme) + F.when(scheme == "", 1).otherwise(2) + F.length(host))
    # url_encode works like a form encoder; undo it for the characters that stay.
    safe = F.transform(
        F.regexp_extract_all(rest, F.lit(r"([A-Za-z0-9/%\-._~!$&'()*+,;=:@?#]+|[^A-Za-z0-9/%\-._~!$&'()*+,;=:@?#]+)"), F.lit(1)),
        lambda p: F.when(p.rlike(r"^[A-Za-z0-9/%\-._~!$&'()*+,;=:@?#]"), p).otherwise(
            F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
        ),
    )
    return F.concat(F.lower(scheme), F.when(scheme == "", "").otherwise(":"), host, F.array_join(safe, ""))


def stale_sources(current: DataFrame, recorded: DataFrame, check_layout: bool = True) -> DataFrame:
    """Sources to ingest again: (edition, sheet, reason).

    ``current``: edition, sheet, mtime_ns, size, url, layout_x, layout_y,
    layout_scale (a missing file has no row or a NULL size). ``recorded``: the
    same plus version_ok and valid. Paths are not compared. An edition whose
    recorded set of sheets differs from the present one is stale as a whole.
    """
    c = current.select(
        "edition", "sheet", *[F.col(n).alias(f"c_{n}") for n in ("mtime_ns", "size", "url", "layout_x", "layout_y", "layout_scale")],
        F.lit(True).alias("c_here"),
    )
    r = recorded.select(
        "edition", "sheet",
        *[F.col(n).alias(f"r_{n}") for n in ("mtime_ns", "size", "url", "layout_x", "layout_y", "layout_scale", "version_ok", "valid")],
        F.lit(True).alias("r_here"),
    )
    both = c.join(r, ["edition", "sheet"], "full_outer")
    here, known = F.coalesce("c_here", F.lit(False)) & F.col("c_size").isNotNull(), F.coalesce("r_here", F.lit(False))
    moved = ~(
        (F.abs(F.col("c_layout_x") - F.col("r_layout_x")) <= LAYOUT_SHIFT)
        & (F.abs(F.col("c_layout_y") - F.col("r_layout_y")) <= LAYOUT_SHIFT)
        & (F.abs(F.col("c_layout_scale") - F.col("r_layout_scale")) <= LAYOUT_SCALE)
    )
    no_layout = lambda p: F.col(f"{p}_layout_x").isNull() | F.col(f"{p}_layout_y").isNull() | F.col(f"{p}_layout_scale").isNull()
    reason = (
        F.when(~here | ~known, "missing")
        .when(~F.coalesce("r_version_ok", F.lit(False)), "version")
        .when(F.col("r_url").isNotNull() & ~canonical_url(F.col("r_url")).eqNullSafe(canonical_url(F.col("c_url"))), "moved address")
        .when(~(F.col("c_mtime_ns").eqNullSafe(F.col("r_mtime_ns")) & F.col("c_size").eqNullSafe(F.col("r_size"))), "changed")
        .when(~F.coalesce("r_valid", F.lit(False)), "invalid")
    )
    if check_layout:
        reason = F.coalesce(
            reason, F.when(no_layout("r") | no_layout("c"), "no layout"), F.when(moved, "moved")
        )
    judged = both.select("edition", "sheet", (here != known).alias("odd"), reason.alias("reason"))
    # At most a few sheets per edition: the set comparison is one small aggregate.
    sets = judged.groupBy("edition").agg(F.bool_or("odd").alias("odd_set"))
    return (
        judged.join(sets, "edition")
        .withColumn("reason", F.coalesce("reason", F.when(F.col("odd_set"), "sheet set differs")))
        .where(F.col("reason").isNotNull())
        .select("edition", "sheet", "reason")
    )
