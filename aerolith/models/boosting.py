"""Boosted regression trees on a binned table: all groups and all targets grow at once, from one aggregation a depth."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.sources.text import staged

#: Groups, and sums that one depth may bring to the driver.
MOST_GROUPS, MOST_SUMS = 256, 4_000_000
#: Training rows of a block, and those that a task holds before it makes blocks of them.
BLOCK, HELD = 1 << 14, 1 << 17


@dataclass(frozen=True)
class Plan:
    rounds: int = 20
    rate: float = 0.1
    depth: int = 3
    #: Cells of a feature, at most 250; edges are quantiles of the training rows.
    bins: int = 32
    #: Rows of a leaf at least.
    least: int = 20
    l2: float = 0.0
    #: Rounds between two writings of what the trees have predicted so far.
    rest: int = 10


@dataclass
class Boosted:
    """Trees by round, group and target. A node has feature -1 if it isn't split; its rows then all go left."""

    features: list[str]
    targets: list[str]
    by: str | None
    groups: list
    edges: list[np.ndarray]
    base: np.ndarray  # group, target
    feature: np.ndarray = field(default=None)  # round, group, target, inner node
    cut: np.ndarray = field(default=None)  # bins up to this one go left
    value: np.ndarray = field(default=None)  # round, group, target, leaf

    def bins(self, x: list[np.ndarray]) -> np.ndarray:
        """Feature, row: cell of each value of each feature, edges below it; a missing value comes after all of them."""
        out = np.empty((len(x), len(x[0]) if x else 0), np.uint8)
        for k, (e, v) in enumerate(zip(self.edges, x, strict=True)):
            out[k] = np.searchsorted(e, v, "left")
            out[k, np.isnan(v)] = len(e) + 1
        return out

    def leaves(self, bins: np.ndarray, group: int, target: int, first: int, last: int) -> np.ndarray:
        """For rows of one group (feature, row): sum of the leaves of rounds first to last, the latter left out."""
        out, inner = np.zeros(bins.shape[1]), self.feature.shape[-1]
        for r in range(first, last):
            out += self.value[r, group, target][descend(bins, self.feature[r, group, target], self.cut[r, group, target]) - inner]
        return out

    def transform(self, rows: DataFrame, prefix: str = "boosted_", budgets: tuple[int, ...] = ()) -> DataFrame:
        """rows with prefix + target, or prefix + target + _ + budget for each number of rounds in budgets, from one pass over the trees.

        Rows of a group that the model hasn't seen raise an error; null features are missing values.
        """
        marks = budgets or (len(self.feature),)
        names = [f"{prefix}{t}" + (f"_{b}" if budgets else "") for t in self.targets for b in marks]
        schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
        model, width = rows.sparkSession.sparkContext.broadcast(self), len(rows.columns)
        keys = [F.col(self.by)] if self.by else [F.lit(0)]
        given = rows.select("*", keys[0].alias("__group"), *(F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(self.features)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            place = {g: i for i, g in enumerate(m.groups)}
            for batch in batches:
                keys = batch.column(width).dictionary_encode(null_encoding="encode")
                strange = set(keys.dictionary.to_pylist()) - set(place)
                if strange:
                    raise ValueError(f"the model has no trees for {m.by} {sorted(map(str, strange))[:5]}")
                group = _places(keys, place)
                bins = m.bins(_columns(batch, range(width + 1, width + 1 + len(m.features))))
                found = {(t, b): np.empty(len(keys)) for t in range(len(m.targets)) for b in marks}
                for g in np.unique(group):
                    rows = np.flatnonzero(group == g)
                    own = bins if len(rows) == len(keys) else bins[:, rows]
                    for t in range(len(m.targets)):
                        total, at = np.full(len(rows), m.base[g, t]), 0
                        for b in sorted(marks):
                            total += m.leaves(own, g, t, at, b)
                            found[t, b][rows] = total
                            at = b
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(found[t, b]) for t in range(len(m.targets)) for b in marks)], schema.names)

        return given.mapInArrow(run, schema)


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Node of each row (bins: feature, row) in heap order, in a tree with these inner nodes. Bytes are compared node by node, which costs less than to look up each row's."""
    inner = len(feature)
    node = np.zeros(bins.shape[1], np.uint8 if inner < 128 else np.int64)
    for d in range(inner.bit_length() if depth is None else depth):
        right = np.zeros(bins.shape[1], bool)
        for k in range(2**d - 1, 2 ** (d + 1) - 1):
            if feature[k] >= 0:
                right |= (node == k) & (bins[feature[k]] > cut[k])
        node = 2 * node + 1 + right
    return node


def _places(keys: pa.DictionaryArray, place: dict) -> np.ndarray:
    return np.array([place[g] for g in keys.dictionary.to_pylist()], np.int64)[keys.indices.to_numpy()]


def _columns(batch: pa.RecordBatch, columns) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for k in columns]


#: Bits of a double, from the first, that each pass of edges() tells apart.
DIGITS = (16, 12, 12, 12, 12)


def edges(rows: DataFrame, features: list[str], bins: int, copies: int = 1) -> list[np.ndarray]:
    """Different quantiles of each feature, bins - 1 at most; a feature without values has none. copies: as if each row were there so many times."""
    return _edges(rows, features, bins, (copies,))[0]


def edges_of(rows: DataFrame, features: list[str], targets: list[str], bins: int, copies: tuple[int, ...]) -> list[list[np.ndarray]]:
    """The edges of a table of these rows for each number of copies, from the same passes."""
    return _edges(known(rows, features, targets), features, bins, copies)


def _edges(rows: DataFrame, features: list[str], bins: int, copies: tuple[int, ...]) -> list[list[np.ndarray]]:
    """edges() for each number of copies, from the same passes: exact, linear between the two nearest ranks.

    Values are told apart by the bits of the double, in an order that is theirs: a pass counts those that share the bits
    of a wanted rank so far by their next bits. So there are len(DIGITS) passes over the rows for all features, nothing is
    written, and the driver gets no more counts than features, ranks and digits make.
    """
    given = rows.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)))
    live: list[np.ndarray] = [np.zeros(1, np.uint64) for _ in features]  # the first bits of wanted ranks, sorted
    below = [np.zeros(1, np.int64) for _ in features]  # values before each
    wanted: list[dict] = []  # by feature: rank -> bits
    bits = 0
    for digit in DIGITS:
        shared = rows.sparkSession.sparkContext.broadcast(live)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, bits=bits, digit=digit) -> Iterator[pa.RecordBatch]:
            lists, held, size = shared.value, [], 0
            sums: list[list] = [[] for _ in lists]

            def count() -> None:
                for k, firsts in enumerate(lists):
                    if not len(firsts):
                        continue
                    v = np.concatenate([h[k] for h in held])
                    raw = (v[~np.isnan(v)] + 0.0).view(np.int64)  # -0.0 is 0.0
                    key = np.where(raw < 0, ~raw, raw | np.int64(-(2**63))).view(np.uint64)
                    which = np.zeros(len(key), np.int64)
                    if bits:
                        first = key >> np.uint64(64 - bits)
                        which = np.minimum(np.searchsorted(firsts, first), len(firsts) - 1)
                        there = firsts[which] == first
                        key, which = key[there], which[there]
                    place = (which << digit) + (key >> np.uint64(64 - bits - digit) & np.uint64((1 << digit) - 1)).astype(np.int64)
                    found = np.bincount(place, minlength=1)
                    some = np.flatnonzero(found)
                    sums[k].append((some, found[some]))
                    if len(sums[k]) > 16:
                        sums[k] = [_added(sums[k])]
                held.clear()

            for batch in batches:
                held.append(_columns(batch, range(len(lists))))
                size += batch.num_rows
                if size >= HELD:
                    count()
                    size = 0
            if held:
                count()
            for k, parts in enumerate(sums):
                if parts:
                    place, n = _added(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), k, np.int32)), pa.array(place), pa.array(n)], ["feature", "place", "n"])

        table = given.mapInArrow(run, "feature int, place long, n long").groupBy("feature", "place").agg(F.sum("n").alias("n")).toArrow()
        feature, place, n = (table.column(c).to_numpy() for c in ("feature", "place", "n"))
        for k in range(len(features)):
            own = np.flatnonzero(feature == k)
            own = own[np.argsort(place[own])]
            at, many = place[own], n[own]
            if not bits:
                total = int(many.sum())
                positions = [p * (total * c - 1) for c in copies for p in (i / bins for i in range(1, bins))] if total else []
                pairs = [(math.floor(x), math.ceil(x)) for x in positions]
                wanted.append({"ranks": {r // c for (lo, hi), c in zip(pairs, np.repeat(copies, bins - 1).tolist(), strict=False) for r in (lo, hi)}, "total": total})
            if not len(own):
                live[k], below[k] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                continue
            cell = at >> digit
            before = np.cumsum(many) - many
            before += (below[k] - before[np.searchsorted(cell, np.arange(len(live[k])))])[cell]
            ranks = np.array(sorted(wanted[k]["ranks"]))
            hit = np.searchsorted(before, ranks, "right") - 1
            full = (live[k][cell] << np.uint64(digit)) | (at & ((1 << digit) - 1)).astype(np.uint64)
            wanted[k]["bits"] = dict(zip(ranks.tolist(), full[hit].tolist(), strict=True))
            keep = np.unique(hit)
            live[k], below[k] = full[keep], before[keep]
        bits += digit

    def value(code: int) -> float:
        raw = np.uint64(code)
        return float((raw & np.uint64(2**63 - 1) if raw >> np.uint64(63) else ~raw).view(np.float64))

    out = []
    for c in copies:
        of = []
        for w in wanted:
            q = []
            for i in range(1, bins) if w["total"] else ():
                x = (i / bins) * (w["total"] * c - 1)
                lo, hi = (value(w["bits"][r // c]) for r in (math.floor(x), math.ceil(x)))
                q.append(lo + (hi - lo) * (x - math.floor(x)))
            of.append(np.unique(q).astype(np.float64))
        out.append(of)
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    place, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return place, np.bincount(which, np.concatenate([n for _, n in parts]), len(place)).astype(np.int64)


@dataclass(frozen=True)
class Table:
    """Training rows in bins, written in blocks of rows of one group; a model can be grown of it again and again."""

    features: list[str]
    targets: list[str]
    by: str | None
    groups: list
    edges: list[np.ndarray]
    #: Targets and residuals are whole numbers of this.
    unit: float
    counts: np.ndarray  # group
    sums: np.ndarray  # group, target; in units
    blocks: DataFrame  # g; rows; b: feature, row; n: row; y: target, row


def known(rows: DataFrame, features: list[str], targets: list[str], by: str | None = None) -> DataFrame:
    """What trees learn from: rows that have all targets."""
    return rows.select(*([by] if by else []), *features, *(F.col(t).cast("double").alias(f"__{t}") for t in targets)).where(" AND ".join(f"`__{t}` IS NOT NULL" for t in targets))


def table(rows: DataFrame, features: list[str], targets: list[str], by: str | None = None, bins: int = 32, copies: int = 1, edges: list[np.ndarray] | None = None) -> Table:
    """Rows with a null target are left out, null features are missing values; null is a group.

    Rows of a group that agree in all bins are one row, with their number and the sums of their targets, since trees
    can't tell them apart. copies: of how many groups of a model each row is; edges: the features' edges, if known.
    """
    spark = rows.sparkSession
    some = known(rows, features, targets, by)
    key = F.col(by) if by else F.lit(0)
    stats = some.groupBy(key.alias("g")).agg(F.count("*").alias("n"), *(F.max(F.abs(f"__{t}")).alias(f"m{k}") for k, t in enumerate(targets))).limit(MOST_GROUPS + 1).collect()
    if len(stats) > MOST_GROUPS:
        raise ValueError(f"{by} has over {MOST_GROUPS} groups")
    if not stats:
        raise ValueError("no rows to learn from")
    stats.sort(key=lambda r: (r.g is not None, r.g))
    largest = max(1e-9, *(r[f"m{k}"] for r in stats for k in range(len(targets))))
    unit = 2.0 ** min(30, math.floor(61 - math.log2(2 * largest * copies * sum(r.n for r in stats))))
    if edges is None:
        edges = _edges(some, features, bins, (copies,))[0]
    groups, m = [r.g for r in stats], len(targets)
    alike = _binned(some, key, Boosted(features, targets, by, groups, edges, np.zeros(0)), unit).groupBy("g", "b").agg(F.sum("n").alias("n"), *(F.sum(f"y{t}").alias(f"y{t}") for t in range(m)))
    blocks = staged(_blocks(alike, len(features), m), "binned")
    found = {r.g: r for r in blocks.groupBy("g").agg(F.sum("number").alias("n"), *(F.sum(F.col("sums")[t]).alias(f"s{t}") for t in range(m))).collect()}  # a row a group
    sums = np.array([[found[g][f"s{t}"] for t in range(m)] for g in range(len(groups))])
    return Table(features, targets, by, groups, edges, unit, np.array([found[g].n for g in range(len(groups))]), sums, blocks)


def fit(rows: DataFrame, features: list[str], targets: list[str], by: str | None = None, plan: Plan = Plan()) -> Boosted:
    """Squared-loss boosting for each group of by (null is a group) and each target; rows with a null target are left out, null features are missing."""
    return grown(table(rows, features, targets, by, plan.bins), plan)


def grown(of: Table, plan: Plan = Plan(), groups: list | None = None, uses: list[list[int]] | None = None) -> Boosted:
    """Boosted trees of a table. groups: those of the model, if they aren't the table's; uses: for each group of the table the places of those groups that its rows count in.

    Each depth of a round is one pass: tasks add up counts and sums of
    residuals by (group, target, node, feature, bin), Spark adds those of tasks up, and the driver, which gets a number of
    sums that depends on the plan alone, takes each node's best split. So the number of Spark jobs is rounds x depth,
    whatever the number of rows, groups or targets. Residuals are whole numbers of a small unit there, so sums don't depend
    on order and the trees are the same for any partitioning. Ties: first feature, then lowest cut.
    """
    groups = of.groups if groups is None else groups
    uses = [[i] for i in range(len(of.groups))] if uses is None else uses
    model = Boosted(of.features, of.targets, of.by, groups, of.edges, np.zeros((len(groups), len(of.targets))))
    for g in range(len(groups)):
        own = [i for i, u in enumerate(uses) if g in u]
        model.base[g] = [int(of.sums[own, t].sum()) / of.unit / int(of.counts[own].sum()) for t in range(len(of.targets))]
    shape = (0, len(groups), len(of.targets))
    model.feature = model.cut = np.zeros((*shape, 2**plan.depth - 1), np.int64)
    model.value = np.zeros((*shape, 2**plan.depth))
    state, done = of.blocks.select("g", "rows", "b", "n", "y", F.lit(None).cast("binary").alias("f")), 0
    for r in range(plan.rounds):
        tree = _grown(state, model, uses, done, of.unit, plan)
        model.feature, model.cut, model.value = (np.concatenate([a, b[None]]) for a, b in zip((model.feature, model.cut, model.value), tree, strict=True))
        if (r + 1) % plan.rest == 0 and r + 1 < plan.rounds:
            state, done = staged(_moved(state, model, uses, done), "binned"), r + 1
    return model


def _binned(some: DataFrame, key, model: Boosted, unit: float) -> DataFrame:
    """g, b (a byte a feature), n, y0 ..: the targets in units."""
    n, m = len(model.features), len(model.targets)
    given = some.select(key.alias("g"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(model.features)), *(F.col(f"__{t}").alias(f"y{k}") for k, t in enumerate(model.targets)))
    shared = some.sparkSession.sparkContext.broadcast(model)
    names = ["g", "b", "n", *(f"y{k}" for k in range(m))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {g: i for i, g in enumerate(model.groups)}
        for batch in batches:
            size = batch.num_rows
            bins = np.ascontiguousarray(model.bins(_columns(batch, range(1, n + 1))).T)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), size, [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            group = pa.array(_places(batch.column(0).dictionary_encode(null_encoding="encode"), place), pa.int32())
            ys = [np.copysign(np.floor(np.abs(y) * unit + 0.5), y).astype(np.int64) for y in _columns(batch, range(n + 1, n + 1 + m))]
            yield pa.RecordBatch.from_arrays([group, rows, pa.array(np.ones(size, np.int64)), *map(pa.array, ys)], names)

    return given.mapInArrow(run, "g int, b binary, n long, " + ", ".join(f"y{k} long" for k in range(m)))


def _blocks(alike: DataFrame, features: int, targets: int) -> DataFrame:
    """Rows of a group (g, b, n, y0 ..) as blocks of up to BLOCK of them: their number and sums, and their columns as bytes."""
    names = ["g", "rows", "number", "sums", "b", "n", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = rows.column(0).to_numpy()
            bins = np.frombuffer(b"".join(x.as_buffer() for x in rows.column(1)), np.uint8).reshape(-1, features)
            n, y = rows.column(2).to_numpy(), np.stack([rows.column(3 + t).to_numpy() for t in range(targets)])
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            for lo, hi in zip(starts, np.r_[starts[1:], len(order)], strict=True):
                for a in range(lo, hi, BLOCK):
                    at = order[a : min(a + BLOCK, hi)]
                    made = [int(group[at[0]])], [len(at)], [int(n[at].sum())], [y[:, at].sum(1).tolist()], [np.ascontiguousarray(bins[at].T).tobytes()], [n[at].tobytes()], [y[:, at].tobytes()]
                    kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= HELD:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return alike.select("g", "b", "n", *(f"y{t}" for t in range(targets))).mapInArrow(run, "g int, rows int, number long, sums array<long>, b binary, n binary, y binary")


def _read(batch: pa.RecordBatch, features: int, targets: int) -> Iterator[tuple]:
    """Group, bins (feature, row), n, y (target, row), f (use, target, row; None: nothing predicted yet) of each block."""
    for g, rows, b, n, y, f in zip(*(batch.column(k) for k in range(6)), strict=True):
        rows = rows.as_py()
        numbers = [np.frombuffer(c.as_buffer(), np.int64) for c in (n, y)]
        yield g.as_py(), np.frombuffer(b.as_buffer(), np.uint8).reshape(features, rows), numbers[0], numbers[1].reshape(targets, rows), np.frombuffer(f.as_buffer()).reshape(-1, targets, rows) if f.is_valid else None


def _moved(state: DataFrame, model: Boosted, uses: list[list[int]], done: int) -> DataFrame:
    """state with f, what has been predicted beyond the base, brought up to the last round."""
    shared, m, n = state.sparkSession.sparkContext.broadcast((model, uses)), len(model.targets), len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, uses = shared.value
        for batch in batches:
            new = []
            for g, bins, _, _, f in _read(batch, n, m):
                more = np.stack([[model.leaves(bins, u, t, done, len(model.feature)) for t in range(m)] for u in uses[g]]) if uses[g] else np.zeros(0)
                new.append((more if f is None else f + more).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary())], batch.schema.names)

    return state.mapInArrow(run, state.schema)


def _grown(state: DataFrame, model: Boosted, uses: list[list[int]], done: int, unit: float, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, cut, value of the next round's trees."""
    groups, targets = model.base.shape
    wide = max((len(e) for e in model.edges), default=0) + 2
    feature = np.full((groups, targets, 2**plan.depth - 1), -1)
    cut = np.zeros_like(feature)
    held = None  # rows and sum of residuals of the nodes at this depth: group, target, node
    for depth in range(plan.depth):
        nodes = 2**depth
        if groups * targets * nodes * len(model.features) * wide > MOST_SUMS:
            raise ValueError("the plan's histograms are too large: fewer groups, bins or levels")
        n, s = _histogram(state, model, uses, feature, cut, depth, done, unit, wide)  # group, target, node, feature, bin
        if held is None:
            held = n[..., 0, :].sum(-1), s[..., 0, :].sum(-1)
        at, (below, of) = slice(nodes - 1, 2 * nodes - 1), split(n, s, unit, plan)
        feature[:, :, at], cut[:, :, at] = below, of
        here = np.take_along_axis(n.cumsum(-1), np.maximum(of, 0)[..., None, None], -1)[..., 0], np.take_along_axis(s.cumsum(-1), np.maximum(of, 0)[..., None, None], -1)[..., 0]
        left = [np.where(below >= 0, np.take_along_axis(x, np.maximum(below, 0)[..., None], -1)[..., 0], whole) for x, whole in zip(here, held, strict=True)]
        held = tuple(np.stack([a, b - a], -1).reshape(groups, targets, 2 * nodes) for a, b in zip(left, held, strict=True))
    n, s = held
    value = np.where(n > 0, plan.rate * (s / unit) / np.maximum(n + plan.l2, 1e-12), 0.0)
    return feature, cut, value


def split(n: np.ndarray, s: np.ndarray, unit: float, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of the largest gain over the last two axes, feature and bin."""
    left_n, left_s = n.cumsum(-1)[..., :-1], s.cumsum(-1)[..., :-1] / unit
    total_n, total_s = n.sum(-1, keepdims=True), s.sum(-1, keepdims=True) / unit
    right_n, right_s = total_n - left_n, total_s - left_s
    score = lambda a, b: b * b / np.maximum(a + plan.l2, 1e-12)
    gain = score(left_n, left_s) + score(right_n, right_s) - score(total_n, total_s)
    gain = np.where((left_n >= plan.least) & (right_n >= plan.least), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:-2], -1)
    best = flat.argmax(-1)
    good = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-12
    return np.where(good, best // gain.shape[-1], -1), np.where(good, best % gain.shape[-1], 0)


#: Sums of whole numbers below this are exact as doubles; larger ones are added up in two parts.
EXACT, HALF = 2.0**53, 1 << 20


def _histogram(state: DataFrame, model: Boosted, uses: list[list[int]], feature: np.ndarray, cut: np.ndarray, depth: int, done: int, unit: float, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of residuals in units, by group, target, node of this depth, feature and bin."""
    groups, targets = model.base.shape
    n_features, nodes = len(model.features), 2**depth
    size = (groups, targets, n_features, nodes * wide)
    shared = state.sparkSession.sparkContext.broadcast((model, uses, feature, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, uses, f, c = shared.value
        count, total = (np.zeros(size, np.int64) for _ in range(2))
        for batch in batches:
            for g, bins, number, y, before in _read(batch, n_features, targets):
                many, cells = number.astype(np.float64), bins.astype(np.intp)
                if not depth:  # all targets and groups have the same rows there
                    each = [np.bincount(x, many, wide).astype(np.int64) for x in cells]
                for j, u in enumerate(uses[g]):
                    for t in range(targets):
                        guess = m.base[u, t] + (before[j, t] if before is not None else 0.0) + m.leaves(bins, u, t, done, len(m.feature))
                        rest = y[t] - number * np.rint(guess * unit).astype(np.int64)
                        weight = rest.astype(np.float64)
                        exact = np.abs(weight).sum() < EXACT
                        if not exact:
                            high = rest // HALF
                            parts = high.astype(np.float64), (rest - high * HALF).astype(np.float64)
                        if depth:
                            node = (descend(bins, f[u, t], c[u, t], depth).astype(np.intp) - (nodes - 1)) * wide
                        for k in range(n_features):
                            place = cells[k] + node if depth else cells[k]
                            count[u, t, k] += np.bincount(place, many, nodes * wide).astype(np.int64) if depth else each[k]
                            if exact:
                                total[u, t, k] += np.bincount(place, weight, nodes * wide).astype(np.int64)
                            else:
                                total[u, t, k] += np.bincount(place, parts[0], nodes * wide).astype(np.int64) * HALF + np.bincount(place, parts[1], nodes * wide).astype(np.int64)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count.ravel()[some]), pa.array(total.ravel()[some])], ["place", "n", "s"])

    found = state.mapInArrow(run, "place long, n long, s long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    at, out = found.column("place").to_numpy(), []
    for name in ("n", "s"):
        x = np.zeros(math.prod(size), np.int64)
        x[at] = found.column(name).to_numpy()
        out.append(x.reshape(groups, targets, n_features, nodes, wide).swapaxes(2, 3))
    return out[0], out[1]
