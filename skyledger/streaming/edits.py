"""Replaying route edits (add / remove / clear clicks) into routes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skyledger.functions import geo
from skyledger.operators import spatial
from skyledger.operators.assembly import SAME_POINT_DEG
from skyledger.streaming.traffic import use_rocksdb

ROUTE_SCHEMA = "plan_id bigint, seq int, is_wp boolean, code string, lat double, lon double"


def _route(remove_nm: float, tolerance: float, radius_km: float, km_per_nm: float, degree_nm: float, margin: float):
    """The class of a route that edits are applied to, as a closure for workers."""
    import math

    height = remove_nm / degree_nm * margin

    def width(band: int) -> float:
        poleward = min(max(abs(band * height), abs((band + 1) * height)) + height, 89.0)
        return height / math.cos(math.radians(poleward))

    def nm(a: float, o: float, b: float, q: float) -> float:
        p, r = math.radians(a), math.radians(b)
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin(math.radians(q - o) / 2) ** 2
        return 2 * radius_km / km_per_nm * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    class Route:
        """Points (is_wp, code, lat, lon) by a rising order key, and their keys by grid cell.

        A removal looks at the cells around the click, not at the whole route.
        """

        def __init__(self):
            self.points: dict[int, tuple] = {}
            self.cells: dict[tuple, set] = {}
            self.next = 0

        def _cell(self, lat: float, lon: float) -> tuple:
            band = math.floor(lat / height)
            return band, math.floor(lon / width(band))

        def append(self, point: tuple, key: int | None = None) -> None:
            key = self.next if key is None else key
            self.points[key] = point
            self.cells.setdefault(self._cell(point[2], point[3]), set()).add(key)
            self.next = key + 1

        def last(self):
            return self.points[next(reversed(self.points))] if self.points else None

        def remove_near(self, lat: float, lon: float) -> None:
            best = None
            band = math.floor(lat / height)
            for b in (band - 1, band, band + 1):
                column = math.floor(lon / width(b))
                for c in (column - 1, column, column + 1):
                    for key in self.cells.get((b, c), ()):
                        p = self.points[key]
                        d = nm(lat, lon, p[2], p[3])
                        if d < remove_nm and (best is None or (d, key) < best):
                            best = d, key
            if best is not None:
                p = self.points.pop(best[1])
                at = self._cell(p[2], p[3])
                self.cells[at].discard(best[1])
                if not self.cells[at]:
                    del self.cells[at]

        def apply(self, action: str, lat: float, lon: float, code, wp_lat, wp_lon) -> None:
            if action == "clear":
                self.points.clear()
                self.cells.clear()
            elif action == "remove":
                self.remove_near(lat, lon)
            elif action == "add":
                last = self.last()
                if isinstance(code, str):
                    if not (last and last[0] and last[1] == code):
                        self.append((True, code, wp_lat, wp_lon))
                elif last and (abs(last[2] - lat) >= tolerance or abs(last[3] - lon) >= tolerance):
                    self.append((False, None, lat, lon))

    return Route


def _new_route(remove_nm: float):
    return _route(remove_nm, SAME_POINT_DEG, geo.EARTH_RADIUS_KM, geo.KM_PER_NM, geo.NM_PER_DEGREE, spatial.grid.CELL_MARGIN)


def snapped_edits(edits: DataFrame, waypoints: DataFrame, snap_nm: float = spatial.SNAP_NM) -> DataFrame:
    """Resolve every add click against the catalogue in one grid join.

    ``edits``: plan_id, edit_no, action, lat, lon, unique by (plan_id, edit_no).
    """
    places = waypoints.groupBy("idx").agg(
        F.first("code").alias("code"), F.first("lat").alias("lat"), F.first("lon").alias("lon")
    ).withColumns({"wp_lat": F.col("lat"), "wp_lon": F.col("lon")})
    hits = spatial.grid.nearest(
        edits, places, snap_nm, target_order="idx", target_cols=["code", "wp_lat", "wp_lon"]
    )
    return hits.select(
        *edits.columns,
        *[F.when(F.col("action") == "add", F.col(f"near_{c}")).alias(c) for c in ("code", "wp_lat", "wp_lon")],
    )


def replay_edits(edits: DataFrame, waypoints: DataFrame, snap_nm: float = spatial.SNAP_NM, remove_nm: float = spatial.REMOVE_NM) -> DataFrame:
    """Final route of every plan after its ordered edits.

    Only the edits after a plan's last clear matter; the rest is dropped before
    the shuffle. What remains is read as a sorted stream that holds one route
    at a time, never a plan's whole log: a removal looks at the route as it
    stands, so these steps cannot be reordered. An edit costs the same however
    long the route is: points lie in grid cells.
    """
    cleared = (
        edits.where(F.col("action") == "clear")
        .groupBy("plan_id")
        .agg(F.max("edit_no").alias("_clear"))
    )
    live = (
        edits.where(F.col("action") != "clear")
        .join(cleared, "plan_id", "left")
        .where(F.col("_clear").isNull() | (F.col("edit_no") > F.col("_clear")))
        .drop("_clear")
    )
    ordered = (
        snapped_edits(live, waypoints, snap_nm)
        .select(F.col("plan_id").cast("bigint").alias("plan_id"), "edit_no", "action", "lat", "lon", "code", "wp_lat", "wp_lon")
        .repartition("plan_id")
        .sortWithinPartitions("plan_id", "edit_no")
    )
    Route = _new_route(remove_nm)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["plan_id", "seq", "is_wp", "code", "lat", "lon"]
        plan, route = None, Route()
        for pdf in batches:
            out = []
            for row in zip(pdf.plan_id, pdf.action, pdf.lat, pdf.lon, pdf.code, pdf.wp_lat, pdf.wp_lon):
                if row[0] != plan:
                    out += [(plan, i, *p) for i, p in enumerate(route.points.values())]
                    plan, route = row[0], Route()
                route.apply(*row[1:])
            yield pd.DataFrame(out, columns=cols)
        yield pd.DataFrame([(plan, i, *p) for i, p in enumerate(route.points.values())], columns=cols)

    return ordered.mapInPandas(fold, ROUTE_SCHEMA)


CHANGE_SCHEMA = "plan_id bigint, version bigint, seq int, removed boolean, is_wp boolean, code string, lat double, lon double"


def edit_stream(edits: DataFrame, waypoints: DataFrame, snap_nm: float = spatial.SNAP_NM, remove_nm: float = spatial.REMOVE_NM, buckets: int = 1024) -> DataFrame:
    """Streaming replay: the changes of every route, row by row, once its edits are final.

    ``edits``: plan_id, edit_no, action, lat, lon and ``edit_ts``, which needs a
    watermark. An edit waits in the state until the watermark has passed its time;
    a timer then applies what is due in order of time and number, so edits of files that land late within the watermark's delay take their place.
    A changed row of a route is (plan_id, version, seq, removed = false, point); a
    row that a shorter route no longer has is a retraction (removed = true), so a
    cleared plan retracts all of its rows. ``version`` rises with every change of
    a plan: the newest row of (plan_id, seq) holds.

    Each click meets the catalogue's spots (waypoints at one place count once, as the
    first of them) in a stream-static join, from which only hits within reach and
    edits without a hit come out; the state keeps the nearest hit. Plans share ``buckets``
    timers, as a call per plan and batch costs more than its few edits. A bucket's edits
    wait in packs of one day of event time, each a state entry of its own, so that a new pack
    costs the same however many wait; a day's packs are opened together when they
    are due, and a list of days says which. A pack holds arrays, one a column. Its routes lie in the state one by one.
    """
    use_rocksdb(edits.sparkSession)
    spots = waypoints.groupBy("lat", "lon").agg(F.min(F.struct("idx", "code")).alias("_w"))
    places = spots.select(
        "_w.idx", "_w.code", F.col("lat").alias("wp_lat"), F.col("lon").alias("wp_lon"),
        F.explode(spatial.grid.cells_in_reach(F.col("lat"), F.col("lon"), snap_nm)).alias("_cell"),
    ).select("idx", "code", "wp_lat", "wp_lon", F.col("_cell.gy").alias("_gy"), F.col("_cell.gx").alias("_gx"))
    gy, gx = spatial.grid.cell_of_reach(F.col("lat"), F.col("lon"), snap_nm)
    nm = geo.great_circle_nm(F.col("lat"), F.col("lon"), F.col("wp_lat"), F.col("wp_lon"))
    met = (F.col("gy") == F.col("_gy")) & (F.col("gx") == F.col("_gx")) & (F.col("action") == "add") & (nm < snap_nm)
    rows = (
        edits.withColumn("gy", gy)
        .withColumn("gx", gx)
        .join(places, met, "left")
        .withColumn("nm", F.when(F.col("_gy").isNotNull(), nm))
        .select(F.col("plan_id").cast("bigint").alias("plan_id"), "edit_ts", "edit_no", "action", "lat", "lon", "idx", "code", "wp_lat", "wp_lon", "nm")
        .withColumn("bucket", F.pmod(F.xxhash64("plan_id"), F.lit(buckets)))
    )
    Route = _new_route(remove_nm)

    day = 86_400_000
    names = ["plan_id", "edit_no", "action", "lat", "lon", "idx", "code", "wp_lat", "wp_lon", "nm"]

    def nearest(columns: list[np.ndarray]) -> list[np.ndarray]:
        """The edits in order of (ms, plan, number), each with its nearest waypoint, of equal ones the first."""
        ms, plan, number, idx, nm = (columns[i] for i in (0, 1, 2, 6, 10))
        order = np.lexsort((idx, nm, number, plan, ms))  # an edit without a waypoint has no nm and comes last
        ms, plan, number = ms[order], plan[order], number[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (ms[1:] != ms[:-1]) | (plan[1:] != plan[:-1]) | (number[1:] != number[:-1])
        return [c[order[first]] for c in columns]

    def not_undone(columns: list[np.ndarray]) -> list[np.ndarray]:
        """Ordered edits without those that a later clear of the same plan undoes."""
        place, clear = np.arange(len(columns[0])), columns[3] == "clear"
        plans, at = np.unique(columns[1], return_inverse=True, equal_nan=False)
        last = np.full(len(plans), -1)
        np.maximum.at(last, at[clear], place[clear])
        return [c[place >= last[at]] for c in columns]

    class Replay(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.due = handle.getMapState("due", "day bigint, part bigint", "edits binary")
            # per day the number of its packs and its earliest time; the timer is that of the earliest of all
            self.days = handle.getValueState("days", "day array<bigint>, parts array<bigint>, first array<bigint>")
            # per plan the number of its last change and the route's points (is_wp, code, lat, lon)
            self.routes = handle.getMapState("routes", "plan_id bigint", "version bigint, points binary")

        def waiting(self) -> dict[int, tuple[int, int]]:
            held = self.days.get() if self.days.exists() else None
            return {d: (n, ms) for d, n, ms in zip(*held)} if held else {}

        def keep(self, waiting: dict[int, tuple[int, int]]) -> None:
            self.days.update((list(waiting), [n for n, _ in waiting.values()], [ms for _, ms in waiting.values()]))

        def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            waiting = self.waiting()
            timer = min((ms for _, ms in waiting.values()), default=None)
            for pdf in batches:  # each goes to the state by itself
                ms = pdf["edit_ts"].to_numpy().astype("datetime64[ms]").astype("int64")
                best = nearest([ms, *[pdf[c].to_numpy() for c in names]])
                days = best[0] // day
                for number in np.unique(days).tolist():
                    pack = [c[days == number] for c in best]
                    parts, first = waiting.get(number, (0, int(pack[0][0])))
                    self.due.updateValue((number, parts), (pickle.dumps(pack),))
                    waiting[number] = parts + 1, min(first, int(pack[0][0]))
            first = min((ms for _, ms in waiting.values()), default=None)
            if first != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
            self.keep(waiting)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            waiting = self.waiting()
            opened: dict[int, tuple] = {}  # plan -> (version, points before, route)
            for number in sorted(n for n, (_, first) in waiting.items() if first <= now):
                packs = []
                for part in range(waiting.pop(number)[0]):
                    packs.append(pickle.loads(bytes(self.due.getValue((number, part))[0])))
                    self.due.removeKey((number, part))
                columns = [np.concatenate(c) for c in zip(*packs)]
                ready = columns[0] <= now
                if not ready.all():
                    rest = [c[~ready] for c in columns]
                    self.due.updateValue((number, 0), (pickle.dumps(rest),))
                    waiting[number] = 1, int(rest[0].min())
                todo = not_undone(nearest([c[ready] for c in columns]))
                for plan, action, lat, lon, code, wp_lat, wp_lon in zip(*[todo[i].tolist() for i in (1, 3, 4, 5, 7, 8, 9)]):
                    if plan not in opened:
                        held = self.routes.getValue((plan,)) if self.routes.containsKey((plan,)) else None
                        version, before = (held[0], pickle.loads(bytes(held[1]))) if held else (0, [])
                        route = Route()
                        for p in before:
                            route.append(p)
                        opened[plan] = version + 1, before, route
                    opened[plan][2].apply(action, lat, lon, code, wp_lat, wp_lon)
            out = []
            for plan, (version, before, route) in opened.items():
                after = list(route.points.values())
                out += [(plan, version, i, False, *p) for i, p in enumerate(after) if i >= len(before) or before[i] != p]
                out += [(plan, version, i, True, None, None, None, None) for i in range(len(after), len(before))]
                self.routes.updateValue((plan,), (version, pickle.dumps(after)))
            self.keep(waiting)
            if waiting:
                self.handle.registerTimer(min(ms for _, ms in waiting.values()))
            columns = ["plan_id", "version", "seq", "removed", "is_wp", "code", "lat", "lon"]
            return iter([pd.DataFrame(out, columns=columns)] if out else ())

        def close(self) -> None:
            pass

    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Replay(), outputStructType=CHANGE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def current_routes(changes: DataFrame) -> DataFrame:
    """The routes that a table of changes leaves: the newest row of each place, unless it is a retraction."""
    newest = changes.groupBy("plan_id", "seq").agg(F.max_by(F.struct("removed", "is_wp", "code", "lat", "lon"), "version").alias("r"))
    return newest.where(~F.col("r.removed")).select("plan_id", "seq", "r.is_wp", "r.code", "r.lat", "r.lon")
