"""Plan assembly: one ordered pass over each block of a plan's points.

A point falls out by comparison with the last *kept* point, so a block needs the state its
predecessors leave. Blocks of plans that are longer than one are therefore read twice. The
first pass knows no state. It follows the block from every row that can be the first kept
one, whatever came before; such rows are few, and walks that meet go on as one. What a walk
leaves (last kept point, kept rows, last waypoint) makes the block a small function of the
state before it. These functions, one row per block, are applied in order for each plan,
which gives every block its state. The second pass then walks each block from its state,
so even a run of near-equal points that spans many blocks is walked by many tasks, and no
task holds more than a block's walks. Plans of one block take part in the second pass only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from skyledger.operators import blocks

# Fixed value.
SAME_POINT_DEG = 1e-6

_KEYS = ["plan_id", "block"]
_POINT = "is_wp boolean, code string, lat double, lon double"


def _dropped(tol: float):
    """Does a state (is_wp, code, lat, lon), or None, drop a point? As a closure for workers."""

    def dropped(state, is_wp, code, lat, lon) -> bool:
        if state is None:
            return not is_wp
        if is_wp:
            return state[0] and code is not None and state[1] == code
        return abs(lat - state[2]) < tol and abs(lon - state[3]) < tol

    return dropped


def _text(value):
    return value if isinstance(value, str) else None


def _summary(tol: float):
    """First pass: (plan_id, block, what) with the function of each block as JSON."""
    dropped = _dropped(tol)

    class Walk:
        """A walk from one entry: its state, kept rows, last waypoint, points since, waypoints kept."""

        def __init__(self, point):
            self.state, self.kept, self.base, self.since, self.bases = None, 0, None, 0, 0
            self.into = None
            self.keep(point)

        def keep(self, point) -> None:
            self.state = point
            self.kept += 1
            self.since += 1
            if point[0]:
                self.base, self.since, self.bases = point[1], 0, self.bases + 1

        def meet(self, other) -> None:
            self.into = other, other.kept, other.since, other.bases

        def end(self):
            """(state, kept, base, since, whether the walk kept a waypoint)."""
            chain, walk = [], self
            while walk.into is not None:
                chain.append(walk)
                walk = walk.into[0]
            state, kept, base, since, bases = walk.state, walk.kept, walk.base, walk.since, walk.bases
            for w in reversed(chain):
                _, k, s, b = w.into
                base, since = (base, since) if bases > b else (w.base, w.since + since - s)
                kept, bases = w.kept + kept - k, w.bases + bases - b
            return state, kept, base, since, bases > 0

    class Block:
        def __init__(self):
            self.entries, self.active = [], []
            self.open, self.first_wp, self.box = True, None, None

        def may_enter(self, is_wp, code, lat, lon) -> bool:
            """Can this row be the first kept one for some state before the block?"""
            if is_wp and self.first_wp is None:
                self.first_wp = (code,)
                return True
            if not self.open:
                return False
            if is_wp:
                if code is not None and self.first_wp[0] == code:
                    return False
                self.open = False
                return True
            if lat != lat or lon != lon:
                self.open = False
                return True
            if self.box is None:
                self.box = [lat, lat, lon, lon]
                return True
            b = self.box
            if b[0] <= lat <= b[1] and b[2] <= lon <= b[3]:
                return False
            self.box = b = [min(b[0], lat), max(b[1], lat), min(b[2], lon), max(b[3], lon)]
            # in a wider box some row is far from any state
            self.open = b[1] - b[0] < 2.1 * tol and b[3] - b[2] < 2.1 * tol
            return True

        def add(self, is_wp, code, lat, lon) -> None:
            point = (is_wp, code, lat, lon)
            moved = [w for w in self.active if not dropped(w.state, *point)]
            if self.may_enter(*point):
                self.entries.append((point, Walk(point)))
                moved.append(self.entries[-1][1])
                self.active.append(moved[-1])
                fresh = moved[-1]
            else:
                fresh = None
            for w in moved:
                if w is not fresh:
                    w.keep(point)
            if len(moved) > 1:  # all of them stand at this row now
                for w in moved[1:]:
                    w.meet(moved[0])
                gone = set(map(id, moved[1:]))
                self.active = [w for w in self.active if id(w) not in gone]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        key, block = None, None
        for pdf in batches:
            out = []
            for plan, number, is_wp, code, lat, lon in zip(*[pdf[c].tolist() for c in ("plan_id", "block", "is_wp", "code", "lat", "lon")]):
                if (plan, number) != key:
                    if key:
                        out.append((*key, json.dumps([(p, w.end()) for p, w in block.entries])))
                    key, block = (plan, number), Block()
                block.add(bool(is_wp), _text(code), lat, lon)
            yield pd.DataFrame(out, columns=["plan_id", "block", "what"])
        if key:
            yield pd.DataFrame([(*key, json.dumps([(p, w.end()) for p, w in block.entries]))], columns=["plan_id", "block", "what"])

    return run


def _states(tol: float):
    """Applies the blocks' functions in order: (plan_id, block, carry), the state before a block and the first point kept after it."""
    dropped = _dropped(tol)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        plan, waiting = None, None
        state, kept, base, since = None, 0, None, 0

        def row(block, carry, after):
            return plan, block, json.dumps([*carry, after])

        for pdf in batches:
            out = []
            for p, block, what in zip(pdf["plan_id"].tolist(), pdf["block"].tolist(), pdf["what"]):
                if p != plan:
                    if waiting:
                        out.append(row(*waiting, None))
                    plan, waiting = p, None
                    state, kept, base, since = None, 0, None, 0
                carry = [state, kept, base, since]
                for point, end in json.loads(what):
                    if not dropped(state, *point):
                        label = point[1] if point[0] else f"{base}.{since + 1}"
                        if waiting:
                            out.append(row(*waiting, [*point, label]))
                        waiting = block, carry
                        last, more, new_base, new_since, has_base = end
                        state, kept = tuple(last), kept + more
                        base, since = (new_base, new_since) if has_base else (base, since + new_since)
                        break
                else:
                    out.append(row(block, carry, None))
            yield pd.DataFrame(out, columns=["plan_id", "block", "carry"])
        if waiting:
            yield pd.DataFrame([row(*waiting, None)], columns=["plan_id", "block", "carry"])

    return run


def _walk(tol: float):
    """Second pass: kept points with their place, label and the next kept point.

    The blocks of a batch are walked together, one row of each at a time; what the longest
    few still hold after that is walked row by row. A block's rows wait until it is complete.
    """
    dropped = _dropped(tol)
    FEW = 16  # blocks; below that, steps over arrays cost more than single rows

    def kept_rows(starts, sizes, first, wp, code, lat, lon):
        """Which rows stay; first: state (is_wp, code, lat, lon) before each block, or None."""
        import numpy as np

        stay = np.zeros(len(wp), bool)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, first = starts[order], sizes[order], [first[i] for i in order]
        has = np.array([f is not None for f in first], bool)
        state = [np.array([f[i] if f else fill for f in first], kind) for i, fill, kind in ((0, False, bool), (1, -1, "int64"), (2, 0.0, float), (3, 0.0, float))]
        step, active = 0, len(starts)
        while active > FEW:
            rows = starts[:active] + step
            now = [c[rows] for c in (wp, code, lat, lon)]
            s = [c[:active] for c in state]
            near = (np.abs(now[2] - s[2]) < tol) & (np.abs(now[3] - s[3]) < tol)
            drop = np.where(has[:active], np.where(now[0], s[0] & (now[1] >= 0) & (s[1] == now[1]), near), ~now[0])
            stay[rows] = ~drop
            for old, new in zip(s, now):
                np.copyto(old, new, where=~drop)
            has[:active] |= ~drop
            step += 1
            active = int(np.searchsorted(-sizes, -step))
        for i in range(active):
            at = slice(starts[i] + step, starts[i] + sizes[i])
            point = tuple(c[i].item() for c in state) if has[i] else None
            flags = []
            for row in zip(wp[at].tolist(), [c if c >= 0 else None for c in code[at].tolist()], lat[at].tolist(), lon[at].tolist()):
                flags.append(not dropped(point, *row))
                if flags[-1]:
                    point = row
            stay[at] = flags
        return stay

    def walk(pdf: pd.DataFrame, starts) -> pd.DataFrame:
        import json

        import numpy as np

        sizes = np.diff(np.append(starts, len(pdf)))
        carries = [json.loads(c) if isinstance(c, str) else (None, 0, None, 0, None) for c in pdf["carry"].to_numpy()[starts]]
        texts = {c: np.array([_text(t) for t in pdf[c]], object) for c in ("code", "name")}
        code, known = pd.factorize(texts["code"])
        number = {c: i for i, c in enumerate(known)}
        wp = np.array([bool(w) for w in pdf["is_wp"]], bool)
        lat, lon = (pdf[c].to_numpy(float) for c in ("lat", "lon"))
        # a code that no row has is like no other
        nan = lambda x: float("nan") if x is None else x
        first = [c[0] and (bool(c[0][0]), number.get(c[0][1], -1), nan(c[0][2]), nan(c[0][3])) for c in carries]
        at = np.flatnonzero(kept_rows(starts, sizes, first, wp, code, lat, lon))
        block = np.searchsorted(starts, at, side="right") - 1
        # places among the kept rows: of a row itself, of its block's first, of the last waypoint so far
        here = np.arange(len(at))
        head = np.searchsorted(block, block, side="left")
        base = np.maximum.accumulate(np.where(wp[at], here, -1)) if len(at) else here
        inside = base >= head
        codes = texts["code"][at]
        label = codes.copy()
        for i in np.flatnonzero(~wp[at]).tolist():
            if inside[i]:
                label[i] = f"{codes[base[i]]}.{i - base[i]}"
            else:
                label[i] = f"{carries[block[i]][2]}.{carries[block[i]][3] + i - head[i] + 1}"
        out = pdf[["plan_id", "n_points", "block"]].iloc[at].reset_index(drop=True)
        before = np.array([c[1] for c in carries], "int64")
        out = out.assign(seq=(before[block] + here - head).astype("int32"), is_wp=pdf["is_wp"].to_numpy()[at], code=codes, name=texts["name"][at], lat=lat[at], lon=lon[at], label=label)
        last = np.append(block[1:] != block[:-1], True)[: len(at)]
        follow = np.minimum(here + 1, max(len(at) - 1, 0))
        after = {i: carries[block[i]][4] for i in np.flatnonzero(last).tolist()}
        for c, place in (("is_wp", 0), ("lat", 1), ("lon", 2), ("label", 3)):
            values = out[c].to_numpy(object)[follow]
            for i, point in after.items():
                values[i] = (point[0], point[2], point[3], point[4])[place] if point else None
            out[f"next_{c}"] = values.astype(float) if place in (1, 2) else values
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            plan, number = pdf["plan_id"].to_numpy(), pdf["block"].to_numpy()
            if held:
                end = held[-1].iloc[-1]
                joined = plan[0] == end["plan_id"] and number[0] == end["block"]
            heads = np.flatnonzero(np.append(True, (plan[1:] != plan[:-1]) | (number[1:] != number[:-1])))
            if held and joined and len(heads) == 1:
                held.append(pdf)
                continue
            # all but the last block are complete
            done = pd.concat([*held, pdf.iloc[: heads[-1]]], ignore_index=True) if held else pdf.iloc[: heads[-1]].reset_index(drop=True)
            if len(done):
                waiting = sum(map(len, held))
                starts = heads[:-1] + waiting
                if held:
                    starts = np.append(0, starts[1:] if joined else starts)
                yield walk(done, starts)
            held = [pdf.iloc[heads[-1] :]]
        if held:
            yield walk(pd.concat(held, ignore_index=True), np.zeros(1, "int64"))

    return run


def walked(points: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Kept points with gapless ``seq``, ``label`` and the next kept point (``next_*``, NULL at a plan's end).

    A waypoint falls out when the last kept point is a waypoint of the same code. An
    intermediate falls out before the first waypoint and within 1e-6 degrees on both axes
    of the last kept point; one without a position is never near. ``points``: (plan_id,
    n_points, block, seq, is_wp, code, name, lat, lon), ``block`` rising with ``seq``.
    """
    plan = points.schema["plan_id"].dataType.simpleString()
    used = points.select("plan_id", "n_points", "block", "seq", "is_wp", "code", "name", "lat", "lon")
    slim = blocks.long_groups(used, block_rows).select(*_KEYS, "seq", "is_wp", "code", "lat", "lon")
    functions = slim.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "seq").mapInPandas(_summary(SAME_POINT_DEG), f"plan_id {plan}, block int, what string")
    carries = functions.repartition("plan_id").sortWithinPartitions(*_KEYS).mapInPandas(_states(SAME_POINT_DEG), f"plan_id {plan}, block int, carry string")
    ordered = used.repartition(*_KEYS).join(carries, _KEYS, "left").sortWithinPartitions(*_KEYS, "seq")
    return ordered.mapInPandas(
        _walk(SAME_POINT_DEG),
        f"plan_id {plan}, n_points int, block int, seq int, {_POINT.replace('lat', 'name string, lat')}, label string, next_is_wp boolean, next_lat double, next_lon double, next_label string",
    )
