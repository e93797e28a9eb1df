"""Printed altitudes for route legs.

Legs of all plans meet the chart's arrows through a grid equi-join; everything
after that is grouping and joining on (plan, leg) and (plan, arrow), for plans of
equal legs once. Only the bend rescue depends on the order of a plan's legs; it
reads an already small candidate list as a sorted stream and remembers just the
arrows it has used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import grid
from skyledger.session import cut, spread

LEG = ["plan_id", "leg_no"]
OWNED = ["plan_id", "arrow_ord"]
SHAPE = ["from_is_wp", "to_is_wp", "from_lat", "from_lon", "to_lat", "to_lon", "true_bearing_deg"]

# Fixed values (nm and degrees).
RADIUS_WAYPOINT, RADIUS_INTERMEDIATE = 0.65, 1.30
PARALLEL_DEG, PARALLEL_PAST_END_DEG = 30.0, 15.0
OVERSHOOT_MAX = 0.30
STACK_RADIUS, STACK_DEG = 0.55, 15.0
DEGREE_WEIGHT = 0.01
BEND_MIN_DEG, BISECTOR_DEG, BEND_RADIUS = 30.0, 15.0, 0.5
CORRIDOR_RIGHT, CORRIDOR_LEFT, CORRIDOR_DEG = 1.8, 0.90, 20.0
REACH = 2.0  # no rule looks further from a leg than 1.30 + 0.55 or 1.8
CELL_NM = 4.0


def _ends() -> tuple[Column, Column, Column, Column]:
    return F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")


def _measured(pairs: DataFrame, reach: float) -> DataFrame:
    """Legs beside arrows, with the measures of each pair within ``reach`` in place of the arrow's columns."""
    a_lat, a_lon, b_lat, b_lon = _ends()
    p_lat, p_lon = F.col("lat"), F.col("lon")
    within = (
        pairs.withColumn("d_nm", geo.leg_distance_nm(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon))
        .where(F.col("d_nm") <= reach)
        .withColumn("overshoot_nm", geo.leg_overshoot_nm(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon))
        .withColumn("side", geo.leg_side(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon))
        .withColumn("fwd", geo.circular_diff_deg(F.col("bearing_deg"), F.col("true_bearing_deg")))
        .withColumn("diff_deg", F.when(F.col("bidirectional"), F.least("fwd", 180.0 - F.col("fwd"))).otherwise(F.col("fwd")))
        .withColumn("real", F.col("from_is_wp") & F.col("to_is_wp"))
    )
    radius = F.when(F.col("real"), RADIUS_WAYPOINT).otherwise(RADIUS_INTERMEDIATE)
    past = F.col("overshoot_nm") > 0.0
    return within.withColumns({
        "cls": F.when(F.col("bidirectional"), 2).when(F.col("side") < 0, 0).otherwise(1),
        "tier": F.when(past, 1).otherwise(0),
        "score": F.col("d_nm") + DEGREE_WEIGHT * F.col("diff_deg"),
        "fits": (F.col("d_nm") <= radius)
        & (F.col("overshoot_nm") <= OVERSHOOT_MAX)
        & (F.col("diff_deg") <= PARALLEL_DEG)
        & ~(past & (F.col("diff_deg") > PARALLEL_PAST_END_DEG)),
    }).drop("lat", "lon", "bearing_deg", "fwd")


def arrow_leg_candidates(
    legs: DataFrame, arrows: DataFrame, reach: float = REACH, refine: Callable[[DataFrame], DataFrame] = lambda measured: measured
) -> DataFrame:
    """Every (leg, arrow) pair within ``reach``, with its measures and whether it fits.

    ``arrows``: arrow_ord (orderable), lat, lon, bearing_deg, bidirectional. Legs
    of one geometry, which many plans share, meet the arrows once; the geometries are
    numbered, and a leg gets its pairs by that number. A leg is copied
    to the cells along its line, an arrow sits in one cell. ``refine`` filters the pairs or
    works on their columns while there is one for all legs of a geometry.
    """
    a_lat, _, b_lat, _ = _ends()
    pad = F.lit(reach / geo.NM_PER_DEGREE * 1.02)
    pad_lon = pad / F.cos(F.radians(F.greatest(F.abs(a_lat), F.abs(b_lat)) + 1.0))
    # written, as the numbers must be the same for both that read them
    shapes = cut(legs.select(*SHAPE).distinct().withColumn("_shape", F.monotonically_increasing_id()))
    celled = grid.with_cells_along(spread(shapes), _ends(), pad, pad_lon, CELL_NM)
    gy, gx = grid.cell_of(F.col("lat"), F.col("lon"), CELL_NM)
    side = arrows.select(
        "arrow_ord", "lat", "lon", "bearing_deg", "bidirectional", gy.alias("gy"), gx.alias("gx")
    )
    measured = refine(_measured(celled.join(side, ["gy", "gx"]), reach).drop("gy", "gx", *SHAPE))
    return legs.select(*LEG, *SHAPE).join(shapes, SHAPE).select(*LEG, "_shape").join(measured, "_shape").drop("_shape")


def arrow_owners(candidates: DataFrame) -> DataFrame:
    """Best leg of each arrow within a plan by (class, tier, score), then lower leg number."""
    return (
        candidates.where(F.col("fits"))
        .groupBy(*OWNED)
        .agg(F.min(F.struct("cls", "tier", "score", "leg_no", "real", "side", "bidirectional")).alias("o"))
        .select(*OWNED, "o.*")
    )


def arrow_neighbours(arrows: DataFrame) -> DataFrame:
    """Pairs of arrows of one kind close enough to be stacked (both directions, no self pairs)."""
    near = arrows.select(
        "arrow_ord", "lat", "lon", "bearing_deg", "bidirectional",
    )
    gy, gx = grid.cell_of_reach(F.col("lat"), F.col("lon"), STACK_RADIUS)
    one = near.withColumn("gy", gy).withColumn("gx", gx)
    other = near.select(
        *[F.col(c).alias(f"o_{c}") for c in near.columns],
        F.explode(grid.cells_in_reach(F.col("lat"), F.col("lon"), STACK_RADIUS)).alias("_cell"),
    ).select("*", "_cell.gy", "_cell.gx").drop("_cell")
    return (
        one.join(other, ["gy", "gx"])
        .where((F.col("bidirectional") == F.col("o_bidirectional")) & (F.col("arrow_ord") != F.col("o_arrow_ord")))
        .withColumn("apart_nm", geo.great_circle_nm(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")))
        .where(F.col("apart_nm") <= STACK_RADIUS)
        .where(
            F.col("bidirectional")
            | (geo.circular_diff_deg(F.col("o_bearing_deg"), F.col("bearing_deg")) <= STACK_DEG)
        )
        .select(F.col("arrow_ord").alias("primary"), F.col("o_arrow_ord").alias("arrow_ord"), "apart_nm")
    )


def _primaries(owners: DataFrame) -> DataFrame:
    return (
        owners.groupBy(*LEG)
        .agg(F.min(F.struct("cls", "tier", "score", "arrow_ord", "side", "bidirectional")).alias("p"))
        .select(*LEG, F.col("p.arrow_ord").alias("primary"), F.col("p.side").alias("p_side"), F.col("p.bidirectional").alias("p_bidir"))
    )


def _mates(primaries: DataFrame, neighbours: DataFrame, legs: DataFrame, arrows: DataFrame) -> DataFrame:
    """Arrows stacked on each leg's primary, on the same side of the leg; few enough to be measured anew."""
    places = arrows.select("arrow_ord", "lat", "lon", "bearing_deg", "bidirectional")
    beside = primaries.join(neighbours, "primary").join(places, "arrow_ord").join(legs.select(*LEG, *SHAPE).dropna(subset=SHAPE), LEG)
    return _measured(beside, REACH).drop(*SHAPE).where(F.col("p_bidir") | (F.col("p_side") * F.col("side") >= 0))


def promote(owners: DataFrame, neighbours: DataFrame, legs: DataFrame, arrows: DataFrame) -> DataFrame:
    """Let waypoint legs take over stacked arrows that intermediate legs own.

    Legs act in order, but an arrow once taken by a waypoint leg stays there and
    a leg's primary is never among the arrows taken from it, so each arrow
    simply goes to the lowest leg number that wants it.
    """
    wanted = _mates(_primaries(owners.where(F.col("real"))), neighbours, legs, arrows)
    loose = owners.where(~F.col("real")).select(*OWNED)
    taken = (
        wanted.join(loose, OWNED, "left_semi")
        .groupBy(*OWNED)
        .agg(F.min(F.struct("leg_no", "cls", "tier", "score", "real", "side", "bidirectional")).alias("t"))
        .select(*OWNED, "t.*")
    )
    stay = owners.join(taken.select(*OWNED), OWNED, "left_anti")
    return stay.unionByName(taken)


def collect_stacks(owners: DataFrame, neighbours: DataFrame, legs: DataFrame, arrows: DataFrame) -> DataFrame:
    """Altitudes per leg: the primary's list, then unseen ones of its stack by distance."""
    primaries = _primaries(owners)
    owner_of = owners.select(*OWNED, F.col("leg_no").alias("owner_leg"))
    texts = arrows.select("arrow_ord", "altitudes_ft")
    mates = (
        _mates(primaries, neighbours, legs, arrows)
        .join(owner_of, OWNED, "left")
        .where(F.col("owner_leg").isNull() | (F.col("owner_leg") == F.col("leg_no")))
        .join(texts, "arrow_ord")
        .groupBy(*LEG)
        .agg(F.array_sort(F.collect_list(F.struct("apart_nm", "arrow_ord", "altitudes_ft"))).alias("m"))
        .select(*LEG, F.flatten(F.col("m.altitudes_ft")).alias("more"))
    )
    first = F.col("altitudes_ft")
    return (
        primaries.join(texts, primaries["primary"] == texts["arrow_ord"])
        .select(*LEG, "altitudes_ft")
        .join(mates, LEG, "left")
        .select(*LEG, F.concat(first, F.array_except(F.coalesce("more", F.array().cast("array<int>")), first)).alias("altitudes_ft"))
    )


def _bend_fold():
    """Walk bends in leg order; each takes its best arrow that no earlier bend took.

    Built as a closure, so that it travels to workers that do not have this package.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, used, done = None, set(), -1
        for pdf in batches:
            out = []
            for pid, leg, s, a in zip(pdf.plan_id, pdf.leg_no, pdf.sheet_no, pdf.arrow_no):
                if pid != plan:
                    plan, used, done = pid, set(), -1
                if leg <= done or (s, a) in used:
                    continue
                used.add((s, a))
                done = leg + 1  # both legs of the bend now have altitudes
                out.append((pid, leg, s, a))
            yield pd.DataFrame(out, columns=["plan_id", "leg_no", "sheet_no", "arrow_no"])

    return fold


def rescue_bends(
    legs: DataFrame, filled: DataFrame, owners: DataFrame, candidates: DataFrame, arrows: DataFrame, bisector: Callable[[Column, Column], Column] = geo.bisector_deg
) -> DataFrame:
    """Arrows drawn along the bisector of a bend between two waypoint legs without altitudes."""
    real = legs.where(F.col("from_is_wp") & F.col("to_is_wp"))
    empty = real.join(filled.select(*LEG), LEG, "left_anti").select(
        *LEG, "from_lat", "from_lon", "to_lat", "to_lon", "true_bearing_deg"
    )
    nxt = empty.select(
        "plan_id", (F.col("leg_no") - 1).alias("leg_no"),
        F.col("from_lat").alias("n_lat"), F.col("from_lon").alias("n_lon"), F.col("true_bearing_deg").alias("n_brg"),
    )
    bends = (
        empty.join(nxt, LEG)
        .where(
            (F.abs(F.col("to_lat") - F.col("n_lat")) <= 1e-9)
            & (F.abs(F.col("to_lon") - F.col("n_lon")) <= 1e-9)
            & (geo.circular_diff_deg(F.col("true_bearing_deg"), F.col("n_brg")) >= BEND_MIN_DEG)
        )
        .select(*LEG, bisector(F.col("true_bearing_deg"), F.col("n_brg")).alias("bisector"))
    )
    close = candidates.where((F.col("d_nm") <= BEND_RADIUS) & ~F.col("bidirectional")).select(*LEG, "arrow_ord", "d_nm")
    both = close.unionByName(close.withColumn("leg_no", F.col("leg_no") - 1))
    options = (
        bends.join(both, LEG)
        .groupBy(*LEG, "arrow_ord", "bisector")
        .agg(F.min("d_nm").alias("d_nm"))
        .join(owners.select(*OWNED), OWNED, "left_anti")
        .join(arrows.select("arrow_ord", "bearing_deg"), "arrow_ord")
        .withColumn("off", geo.circular_diff_deg(F.col("bearing_deg"), F.col("bisector")))
        .where(F.col("off") <= BISECTOR_DEG)
        .withColumn("score", F.col("d_nm") + DEGREE_WEIGHT * F.col("off"))
        .select(*LEG, "score", "arrow_ord.sheet_no", "arrow_ord.arrow_no")
        .repartition("plan_id")
        .sortWithinPartitions("plan_id", "leg_no", "score", "sheet_no", "arrow_no")
    )
    kind = options.schema["plan_id"].dataType.simpleString()
    leg_kind = options.schema["leg_no"].dataType.simpleString()
    return options.mapInPandas(
        _bend_fold(), f"plan_id {kind}, leg_no {leg_kind}, sheet_no int, arrow_no bigint"
    ).select(*LEG, F.struct("sheet_no", "arrow_no").alias("arrow_ord"))


def wide_corridor(filled: DataFrame, used: DataFrame, candidates: DataFrame) -> DataFrame:
    """Last chance for empty waypoint legs: parallel unowned arrows in a wider corridor."""
    cap = F.when(F.col("side") < 0, CORRIDOR_RIGHT).when(F.col("side") > 0, CORRIDOR_LEFT)
    choice = (
        candidates.where(
            F.col("real") & ~F.col("bidirectional") & (F.col("overshoot_nm") <= 0.0)
            & (F.col("d_nm") <= cap) & (F.col("diff_deg") <= CORRIDOR_DEG)
        )
        .join(used.select(*OWNED), OWNED, "left_anti")
        .join(filled.select(*LEG), LEG, "left_anti")
        .groupBy(*OWNED)
        .agg(F.min(F.struct("score", "leg_no")).alias("c"))
        .select(*OWNED, "c.score", "c.leg_no")
    )
    return (
        choice.groupBy(*LEG)
        .agg(F.min(F.struct("score", "arrow_ord")).alias("b"))
        .select(*LEG, F.col("b.arrow_ord").alias("arrow_ord"))
    )


def _copied_plans(legs: DataFrame) -> DataFrame:
    """(plan_id, like): plans whose legs are, by number and geometry, those of a plan of smaller number.

    A plan is known by the count of its legs and four sums of 48-bit hashes of their texts, so a
    long plan takes no more room than a short one, and unlike plans do not agree in 192 bits by chance.
    """
    known = ["_n", "_h0", "_h1", "_h2", "_h3"]
    text = F.struct("leg_no", *SHAPE).cast("string")
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(i), "_text"), 16)).alias(f"_h{i}") for i in range(4)]
    plans = legs.where(F.col("plan_id").isNotNull()).select("plan_id", text.alias("_text")).groupBy("plan_id").agg(F.count("*").alias("_n"), *sums)
    first = plans.groupBy(*known).agg(F.min("plan_id").alias("like"))
    return plans.join(first, known).where(F.col("plan_id") != F.col("like")).select("plan_id", "like")


def match_altitudes(legs: DataFrame, arrows: DataFrame, bisector: Callable[[Column, Column], Column] = geo.bisector_deg) -> DataFrame:
    """``legs`` plus ``altitudes_ft`` (empty where the chart gives none).

    ``arrows``: arrow_ord struct<sheet_no, arrow_no>, lat, lon, bearing_deg,
    altitudes_ft, bidirectional. Plans of equal legs are matched once. Of the (leg, arrow)
    pairs, as many as legs times arrows nearby, only those are written that a leg
    without altitudes may still use. Tables that several steps read (legs, owners)
    are written to the shared folder once instead of being built anew.
    ``bisector`` is the direction half-way between two bearings; rules differ for opposite ones.
    """
    every, arrows = cut(legs), cut(arrows)
    copied = cut(_copied_plans(every))
    legs = cut(every.join(copied, "plan_id", "left_anti").select(*LEG, *SHAPE))
    neighbours = cut(arrow_neighbours(arrows))
    fitting = arrow_leg_candidates(legs, arrows, refine=lambda m: m.where(F.col("fits")))
    owners = cut(promote(cut(arrow_owners(fitting)), neighbours, legs, arrows))
    stacked = cut(collect_stacks(owners, neighbours, legs, arrows).where(F.size("altitudes_ft") > 0))
    empty = legs.where(F.col("from_is_wp") & F.col("to_is_wp")).join(stacked.select(*LEG), LEG, "left_anti").select(*LEG).distinct()
    # what the last two steps can use: arrows near a bend, or beside a leg
    late = (F.col("d_nm") <= BEND_RADIUS) | ((F.col("overshoot_nm") <= 0.0) & (F.col("diff_deg") <= CORRIDOR_DEG))
    left = cut(arrow_leg_candidates(legs.join(empty, LEG, "left_semi"), arrows, refine=lambda m: m.where(~F.col("bidirectional") & late)))
    rescued = cut(rescue_bends(legs, stacked, owners, left, arrows, bisector))
    texts = arrows.select("arrow_ord", "altitudes_ft")
    bend_pairs = rescued.unionByName(rescued.withColumn("leg_no", F.col("leg_no") + 1))
    bend = bend_pairs.join(texts, "arrow_ord").select(*LEG, "altitudes_ft")
    filled = stacked.select(*LEG).unionByName(bend.select(*LEG))
    used = owners.select(*OWNED).unionByName(rescued.select(*OWNED))
    wide = wide_corridor(filled, used, left).join(texts, "arrow_ord").select(*LEG, "altitudes_ft")
    found = stacked.unionByName(bend).unionByName(wide).withColumnsRenamed({"plan_id": "_like"})
    return (
        every.join(copied, "plan_id", "left")
        .withColumn("_like", F.coalesce("like", "plan_id"))
        .drop("like")
        .join(found, ["_like", "leg_no"], "left")
        .select(*every.columns, F.coalesce("altitudes_ft", F.array().cast("array<int>")).alias("altitudes_ft"))
    )
