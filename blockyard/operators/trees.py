"""Multiclass boosted trees on Spark: exact bins, histograms, splits, predictions; one fit or many at once.

Several models (folds, a holdout fit, a final fit) grow side by side over the same rows: a row says which models it
trains, and each level of a round's trees is one scan for all of them. Partitions add up gradients and hessians by (model,
class, node, block of features); only these sums are shuffled, and their size depends on models, classes, nodes and bins,
not on rows. A feature has as many cells as it has bins, and its usual bin is left out and filled in from the node's
totals, so sparse one-hot and hashed slots cost what they hold. Every few rounds the rows take their scores along.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

HOLD = 8  # rounds after which the rows take their scores along
LANES = 64  # partial sums that meet in one group


@dataclass
class Options:
    rounds: int = 60
    depth: int = 4
    rate: float = 0.15
    smooth: float = 1.0
    gamma: float = 0.0
    min_leaf: int = 4
    bins: int = 32
    row_share: float = 0.85
    column_share: float = 0.5
    seed: int = 1


@dataclass
class Model:
    classes: list[str]
    thresholds: list[list[float]]
    base: list[float]
    rate: float
    trees: list[dict[int, dict[int, list]]] = field(default_factory=list)  # round -> class -> node -> [feature, bin] or [leaf value]
    names: list[str] = field(default_factory=list)  # of the features, where known
    options: dict = field(default_factory=dict)
    holdout: dict = field(default_factory=dict)  # n, trees and what else was scored on rows kept back

    def scores(self, bins: np.ndarray, held: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Raw scores of binned rows; ``held`` are those of the rounds before ``since``."""
        out = np.tile(self.base, (len(bins), 1)) if held is None else held.copy()
        for trees in self.trees[since:]:
            for k, nodes in trees.items():
                value = np.zeros(max(nodes) + 1)
                for node, x in nodes.items():
                    if len(x) == 1:
                        value[node] = x[0]
                out[:, k] += self.rate * value[_places(bins, nodes)]
        return out

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(t, x[:, i], "right") for i, t in enumerate(self.thresholds)], 1).astype(np.uint8)

    def to_json(self) -> dict:
        trees = [{str(k): {str(n): v for n, v in nodes.items()} for k, nodes in t.items()} for t in self.trees]
        told = {"features": self.names, "options": self.options, "holdout": self.holdout}
        return {"classes": self.classes, "thresholds": self.thresholds, "base": self.base, "rate": self.rate, "trees": trees} | told

    @staticmethod
    def from_json(j: dict) -> Model:
        trees = [{int(k): {int(n): v for n, v in nodes.items()} for k, nodes in t.items()} for t in j["trees"]]
        return Model(j["classes"], j["thresholds"], j["base"], j["rate"], trees, j.get("features", []), j.get("options", {}), j.get("holdout", {}))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of floats; the two zeros are one."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def unordered(key: int) -> float:
    return float(np.array([key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF], np.int64).view(float)[0])


def _matrix(column, dims: int) -> np.ndarray:
    """Arrow lists of numbers as rows of floats; a null is 0."""
    flat = column.flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def order_statistics(rows: DataFrame, dims: int, ranks: dict[int, list[int]], features: str = "features", member: str | None = None) -> dict[tuple[int, int], dict[int, float]]:
    """The values at the given ranks (from 0) of every feature over each model's rows: (model, feature) -> rank -> value.

    Exact, all at once: each step counts the values by 8 more bits of their place in the order, only within the cells that
    hold a wanted rank, and a cell whose smallest and largest value agree is settled. A step is one scan and one shuffle;
    what comes to the driver has a row per wanted rank. ``member`` is a column of bits, one for each model.
    """
    spark, shift = rows.sparkSession, 56
    wanted = {(m, f, 0): sorted({(r, r) for r in own}) for m, own in ranks.items() for f in range(dims) if own}
    found: dict[tuple[int, int], dict[int, float]] = {(m, f): {} for m in ranks for f in range(dims)}
    taken = rows.select(F.col(features).cast("array<double>").alias("x"), (F.lit(-1) if member is None else F.col(member)).cast("long").alias("m"))
    while wanted:
        parents: dict[tuple[int, int], list[int]] = {}
        for m, f, parent in wanted:
            parents.setdefault((m, f), []).append(parent)
        told = spark.sparkContext.broadcast({k: np.sort(np.array(v, np.int64)) for k, v in parents.items()})

        def count(batches, told=told, shift=shift):
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    keys, member = ordered(_matrix(batch.column("x"), dims)), batch.column("m").to_numpy(zero_copy_only=False)
                    inside = {m: (member >> m) & 1 == 1 for m, _ in told.value}
                    out: list[tuple] = []
                    for (m, f), own in told.value.items():
                        key = keys[inside[m], f]
                        if shift < 56:
                            up = key >> (shift + 8)
                            spot = np.minimum(np.searchsorted(own, up), len(own) - 1)
                            key = key[own[spot] == up]
                        if len(key):
                            key = np.sort(key)
                            prefix = key >> shift
                            first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
                            n = np.diff(np.append(first, len(key)))
                            out.append((np.full(len(first), m), np.full(len(first), f), prefix[first], n, key[first], key[first + n - 1]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["m", "f", "prefix", "n", "lo", "hi"])

        cells = taken.mapInArrow(count, "m long, f long, prefix long, n long, lo long, hi long").groupBy("m", "f", "prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        parent = F.lit(0).cast("long") if shift == 56 else F.shiftright("prefix", 8)
        placed = cells.withColumn("parent", parent).withColumn("upto", F.sum("n").over(Window.partitionBy("m", "f", "parent").orderBy("prefix")))
        asked = spark.createDataFrame([(*k, r, rank) for k, own in wanted.items() for r, rank in own], "m long, f long, parent long, r long, rank long")
        hits = placed.join(F.broadcast(asked), ["m", "f", "parent"]).filter((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))
        wanted = {}
        for r in hits.select("m", "f", "prefix", (F.col("r") - F.col("upto") + F.col("n")).alias("r"), "rank", "lo", "hi").collect():
            if r["lo"] == r["hi"]:
                found[r["m"], r["f"]][r["rank"]] = unordered(r["lo"])
            else:
                wanted.setdefault((r["m"], r["f"], r["prefix"]), []).append((r["r"], r["rank"]))
        shift -= 8
    return found


def bin_ranks(n: int, bins: int) -> list[int]:
    return [b * n // bins for b in range(1, bins)] if n else []


def fit_bins(rows: DataFrame, dims: int, bins: int = 32, features: str = "features") -> list[list[float]]:
    """At most bins - 1 ascending distinct thresholds per feature: the values at the ranks floor(b n / bins), exactly."""
    found = order_statistics(rows, dims, {0: bin_ranks(rows.count(), bins)}, features)
    return [sorted(set(found[0, f].values())) for f in range(dims)]


class Cells:
    """Where a model's sampled features lie in blocks of cells: one for each bin but the usual one, which is filled in."""

    def __init__(self, thresholds: list[list[float]], usual: np.ndarray, columns: np.ndarray, most: int = 4096):
        used = [int(c) for c in columns if thresholds[c]]
        self.blocks: list[list[int]] = [[]]
        for c in used:
            if self.blocks[-1] and sum(len(thresholds[d]) + 1 for d in self.blocks[-1]) + len(thresholds[c]) + 1 > most:
                self.blocks.append([])
            self.blocks[-1].append(c)
        self.widths = [[len(thresholds[c]) + 1 for c in block] for block in self.blocks]
        self.usual = [usual[block] if block else np.zeros(0, np.int64) for block in self.blocks]
        self.starts = [np.concatenate(([0], np.cumsum(w)))[:-1].astype(np.int64) for w in self.widths]

    def size(self, block: int) -> int:
        """Cells of a block, and one for the totals."""
        return sum(self.widths[block]) + 1

    def entries(self, x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell of every value outside its feature's usual bin."""
        columns = self.blocks[block]
        if not columns:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = x[:, columns].astype(np.int64)
        row, at = np.nonzero(own != self.usual[block])
        return row, self.starts[block][at] + own[row, at]

    def table(self, x: np.ndarray, block: int) -> np.ndarray | None:
        """The cells of all values, a row per feature, where most values lie outside their usual bins; None elsewhere."""
        columns = self.blocks[block]
        own = x[:, columns].T.astype(np.int64)
        if not columns or 2 * np.count_nonzero(own != self.usual[block][:, None]) < own.size:
            return None
        return own + self.starts[block][:, None]

    def best(self, hist: np.ndarray, block: int, o: Options) -> tuple[float, int, int]:
        """Gain, feature and bin of the best split in a block's sums (cell, (g, h, count)); -inf if none is allowed."""
        if not self.blocks[block]:
            return -np.inf, -1, -1
        total, widths = hist[-1], np.array(self.widths[block])
        g, h, n = total
        grain = 1e-10 * (1 + n)  # equal gains stay equal, in whatever order their parts were added up
        each, wide = np.arange(len(widths)), np.arange(widths.max())
        inside = wide < widths[:, None]
        own = np.where(inside[..., None], hist[np.where(inside, self.starts[block][:, None] + wide, 0)], 0.0)
        own[each, self.usual[block]] = total - own.sum(1)
        left = own.cumsum(1)
        right = total - left
        gain = left[..., 0] ** 2 / (left[..., 1] + o.smooth) + right[..., 0] ** 2 / (right[..., 1] + o.smooth) - g**2 / (h + o.smooth)
        gain = np.round(gain / grain) * grain
        gain[(np.rint(left[..., 2]) < o.min_leaf) | (np.rint(right[..., 2]) < o.min_leaf) | (wide >= widths[:, None] - 1)] = -np.inf
        c, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return float(gain[c, b]), self.blocks[block][c], int(b)


def _places(x: np.ndarray, nodes: dict[int, list]) -> np.ndarray:
    """The node of a tree that each row is in, a level of all rows at a time."""
    feature, cut = np.full(max(nodes) + 1, -1), np.zeros(max(nodes) + 1, np.int64)
    for node, v in nodes.items():
        if len(v) == 2:
            feature[node], cut[node] = v
    at, rows = np.ones(len(x), np.int64), np.arange(len(x))
    while (own := feature[at]).max(initial=-1) >= 0:
        at = np.where(own >= 0, 2 * at + (x[rows, own] > cut[at]), at)
    return at


def _unpack(batch, models: list[Model], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bins (model, row, feature), class code, hash, member bits, and each model's scores of a batch of stored rows."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, len(models), dims).swapaxes(0, 1)
    held = np.frombuffer(b"".join(batch.column("held").to_pylist()), np.float64).reshape(n, -1)
    cuts = np.cumsum([len(m.classes) for m in models])[:-1]
    y, key, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "key", "member"))
    return x, y, key, member, np.split(held, cuts, 1)


def train_models(rows: DataFrame, label: str, dims: int, members: dict[str, Column], options: Options | None = None, features: str = "features", names: list[str] | None = None, hist_bytes: int = 1 << 28) -> dict[str, Model]:
    """One model for each of ``members``, whose Column says which rows train it; the same as one fit after the other.

    A round grows one tree per class that occurs among a model's rows; its leaves are -G/(H + smooth). Row and column
    samples are fixed by hashes of the row's content, the round and the feature. A level is one scan and one job for all
    models; a task hands its sums on when they pass ``hist_bytes``. A null feature is 0, a null label trains nothing; a
    model without rows is left out; at most 62 models.
    """
    o, spark = options or Options(), rows.sparkSession
    bits = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(members.values())), F.lit(0)).cast("long")
    code = F.col(label).cast("string")
    ready = rows.filter(code.isNotNull()).select(F.col(features).cast("array<double>").alias("x"), code.alias("label"), bits.alias("member"), F.xxhash64(features, label).alias("key"))
    counts = ready.groupBy("label", "member").count().collect()
    every = sorted({r["label"] for r in counts})
    own = [{c: n for c in every if (n := sum(r["count"] for r in counts if r["label"] == c and (r["member"] >> i) & 1))} for i in range(len(members))]
    ranks = {i: bin_ranks(sum(c.values()), o.bins) for i, c in enumerate(own)}
    found = order_statistics(ready, dims, ranks, "x", "member")
    models, codes, usual = [], [], []
    for i, c in enumerate(own):
        n, thresholds = sum(c.values()), [sorted(set(found[i, f].values())) for f in range(dims)]
        models.append(Model(sorted(c), thresholds, [float(np.log((c[k] + 1) / (n + len(c)))) for k in sorted(c)], o.rate, [], names or [], asdict(o)))
        codes.append(np.array([sorted(c).index(k) if k in c else -1 for k in every] + [-1]))
        # The bin that most of the wanted ranks fall in.
        usual.append(np.array([np.bincount(np.searchsorted(t, list(found[i, f].values()), "right")).argmax() if t else 0 for f, t in enumerate(thresholds)]))
    shared = spark.sparkContext.broadcast(models)

    def to_bins(batches):
        held = np.concatenate([m.base for m in shared.value] or [[]]).astype(float).tobytes()
        at = {k: i for i, k in enumerate(every)}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = _matrix(batch.column("x"), dims)
                packed = np.stack([m.bin(x) for m in shared.value], 1)
                y = pa.array([at[k] for k in batch.column("label").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), y, batch.column("key"), batch.column("member"), pa.array([held] * len(x), pa.binary())], ["bins", "y", "key", "member", "held"])

    kind = "bins binary, y int, key long, member long, held binary"
    if not any(own):
        return {}
    stored = lambda df: materialise(df, "tree-rows").coalesce(parts_of_rows)
    # A few MB of rows a task; where that leaves cores idle, less.
    held = sum(r["count"] for r in counts) * (len(models) * dims + 8 * sum(len(m.classes) for m in models))
    parts_of_rows = max(1 + (held >> 22), min(spark.sparkContext.defaultParallelism, 1 + (held >> 18)))
    data, since = stored(ready.filter("member <> 0").repartition(parts_of_rows).mapInArrow(to_bins, kind)), 0
    lanes = -(-parts_of_rows // LANES)
    rng = np.random.default_rng(o.seed)
    for round_ in range(o.rounds):
        if round_ - since == HOLD:
            grown = spark.sparkContext.broadcast((models, since))

            def hold(batches, grown=grown):
                models, since = grown.value
                for batch in batches:
                    if batch.num_rows:
                        x, _, _, _, held = _unpack(batch, models, dims)
                        now = np.concatenate([m.scores(x[i], held[i], since) for i, m in enumerate(models)], 1)
                        yield batch.set_column(4, "held", pa.array([r.tobytes() for r in now], pa.binary()))

            data, since = stored(data.mapInArrow(hold, kind)), round_
        columns = np.sort(rng.choice(dims, max(1, int(dims * o.column_share)), False))
        salt, trees = int(rng.integers(1 << 62)), [{k: {1: []} for k in range(len(m.classes))} for m in models]
        cells = [Cells(m.thresholds, u, columns) for m, u in zip(models, usual)]
        for depth in range(o.depth + 1):
            open_nodes = [(i, k, node) for i, t in enumerate(trees) for k, nodes in t.items() for node, x in nodes.items() if x == []]
            if not open_nodes:
                break
            state, leaf = spark.sparkContext.broadcast((models, trees, cells, codes, salt, since)), depth == o.depth
            blocks = [1 if leaf else len(c.blocks) for c in cells]  # leaves need no cells but that of the totals

            def sums(batches, state=state, leaf=leaf):
                models, trees, cells, codes, salt, since = state.value
                lane = TaskContext.get().partitionId() % lanes
                total: dict[tuple, np.ndarray] = {}

                def told():
                    flat = [(*key, node, lane, h.tobytes()) for key, hist in total.items() for node, h in zip([n for n, v in trees[key[0]][key[1]].items() if v == []], hist) if h[-1, 2]]
                    arrays = [pa.array([r[c] for r in flat], pa.int32()) for c in range(5)]
                    total.clear()
                    return pa.RecordBatch.from_arrays([*arrays, pa.array([r[5] for r in flat], pa.binary())], ["m", "k", "block", "node", "lane", "sums"])

                for whole in batches:
                    for start in range(0, whole.num_rows, 4096):
                        x, y, key, member, held = _unpack(whole.slice(start, 4096), models, dims)
                        sampled = ((key ^ salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) / (1 << 24) < o.row_share
                        for i, m in enumerate(models):
                            used = sampled & ((member >> i) & 1 == 1)
                            if not used.any():
                                continue
                            own, target = x[i][used], codes[i][y[used]]
                            p = softmax(m.scores(own, held[i][used], since))
                            tables = [] if leaf else [cells[i].table(own, b) for b in range(len(cells[i].blocks))]
                            entries = [None if t is not None else cells[i].entries(own, b) for b, t in enumerate(tables)]
                            for k, nodes in trees[i].items():
                                open_ = [n for n, v in nodes.items() if v == []]
                                if not open_:
                                    continue
                                spot = np.full(2 * max(nodes) + 2, -1)
                                spot[open_] = np.arange(len(open_))
                                at = spot[_places(own, nodes)]
                                inside = at >= 0
                                g, h = p[:, k] - (target == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                                for b in range(1 if leaf else len(entries)):
                                    size = 1 if leaf else cells[i].size(b)
                                    if (hist := total.get((i, k, b))) is None:
                                        hist = total[i, k, b] = np.zeros((len(open_), size, 3))
                                    for w, v in enumerate((g, h, None)):
                                        hist[:, -1, w] += np.bincount(at[inside], None if v is None else v[inside], len(open_))
                                    if leaf:
                                        continue
                                    if (table := tables[b]) is not None:
                                        table = table if inside.all() else table[:, inside]
                                        place, of = (table + at[inside] * size).ravel(), lambda v, shape=table.shape: np.broadcast_to(v[inside], shape).ravel()
                                    else:
                                        row, cell = entries[b]
                                        hit = inside[row]
                                        row = row[hit]
                                        place, of = at[row] * size + cell[hit], lambda v, row=row: v[row]
                                    for w, v in enumerate((g, h, None)):
                                        added = np.bincount(place, None if v is None else of(v), len(open_) * size).reshape(len(open_), size)
                                        if table is not None:
                                            added[:, cells[i].starts[b] + cells[i].usual[b]] = 0
                                        hist[:, :, w] += added
                        if sum(h.nbytes for h in total.values()) > hist_bytes:
                            yield told()
                yield told()

            by = ["m", "k", "block", "node"]

            def added(batches):
                total: dict[tuple, np.ndarray] = {}
                for batch in batches:
                    keys = zip(*(batch.column(c).to_pylist() for c in by))
                    for key, told in zip(keys, batch.column("sums").to_pylist()):
                        if key in total:
                            total[key] += np.frombuffer(told)
                        else:
                            total[key] = np.frombuffer(told).copy()
                return total

            def add(batches):
                flat = [(*key, h.tobytes()) for key, h in added(batches).items()]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in flat], pa.int32()) for c in range(4)), pa.array([r[4] for r in flat], pa.binary())], [*by, "sums"])

            def choose(batches, state=state, leaf=leaf):
                own, flat = state.value[2], []
                for (i, k, block, node), hist in added(batches).items():
                    hist = hist.reshape(-1, 3)
                    gain, feature, b = (-np.inf, -1, -1) if leaf else own[i].best(hist, block, o)
                    flat.append((i, k, block, node, gain, feature, b, float(-hist[-1, 0] / (hist[-1, 1] + o.smooth))))
                kinds = [pa.int32()] * 4 + [pa.float64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate(kinds)], [*by, "gain", "feature", "bin", "value"])

            # Sums meet by key, a task's share of the keys within hist_bytes; beyond LANES tasks, in two steps.
            size = sum(24 * (1 if leaf else cells[i].size(b)) for i, _, _ in open_nodes for b in range(blocks[i]))
            tasks = max(1, -(-size * 4 // hist_bytes))
            parts = data.mapInArrow(sums, "m int, k int, block int, node int, lane int, sums binary")
            if lanes > 1:
                parts = parts.repartition(tasks * lanes, *by, "lane").drop("lane").mapInArrow(add, "m int, k int, block int, node int, sums binary")
            picked: dict[tuple, tuple] = {}
            found = parts.repartition(tasks, *by).mapInArrow(choose, "m int, k int, block int, node int, gain double, feature int, bin int, value double").collect()
            for r in sorted(found, key=lambda r: r["block"]):
                spot = (r["m"], r["k"], r["node"])
                if spot not in picked or r["gain"] > picked[spot][0]:
                    picked[spot] = (r["gain"], r["feature"], r["bin"], r["value"])
            for i, k, node in open_nodes:
                gain, feature, b, value = picked.get((i, k, node), (-np.inf, -1, -1, 0.0))  # a node that the row sample leaves empty adds nothing
                if gain > o.gamma + 1e-12:
                    trees[i][k][node], trees[i][k][2 * node], trees[i][k][2 * node + 1] = [feature, b], [], []
                else:
                    trees[i][k][node] = [value]
            state.unpersist()
        for m, t in zip(models, trees):
            m.trees.append(t)
    return {name: m for name, m in zip(members, models) if m.classes}


def train(rows: DataFrame, label: str, dims: int, options: Options | None = None, features: str = "features", names: list[str] | None = None) -> Model:
    """One model of all rows (features array, label string). Same options and rows give the same model, however they are dealt."""
    return train_models(rows, label, dims, {"all": F.lit(True)}, options, features, names)["all"]


def predict(rows: DataFrame, model: Model | dict[str, Model], features: str = "features", which: Column | None = None) -> DataFrame:
    """Adds tree_type and tree_conf: the class of highest probability, the first on a tie.

    With several models, ``which`` names the one to ask for each row; a name without a model gives nulls.
    """
    shared = rows.sparkSession.sparkContext.broadcast({"": model} if isinstance(model, Model) else model)

    @F.pandas_udf("struct<tree_type:string,tree_conf:double>")
    def call(x: pd.Series, name: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"tree_type": [None] * len(x), "tree_conf": [None] * len(x)}, dtype=object)
        for key in name.dropna().unique():
            m, here = shared.value.get(key), np.flatnonzero((name == key).to_numpy())
            if m is not None:
                p = softmax(m.scores(m.bin(np.nan_to_num(np.stack(x.iloc[here].to_numpy()).astype(float)))))
                out.iloc[here, 0], out.iloc[here, 1] = [m.classes[i] for i in p.argmax(1)], p.max(1)
        return out.astype({"tree_conf": float})

    out = rows.withColumn("_call", call(F.col(features).cast("array<double>"), F.lit("") if which is None else which))
    return out.withColumns({"tree_type": F.col("_call.tree_type"), "tree_conf": F.col("_call.tree_conf")}).drop("_call")


def cross_validate(rows: DataFrame, label: str, dims: int, folds: int, fold: Column, options: Options | None = None, features: str = "features") -> DataFrame:
    """Out-of-fold calls: each row by the model of the other folds; all models grow in one pass."""
    dealt = rows.withColumn("_fold", fold.cast("int"))
    models = train_models(dealt, label, dims, {str(k): F.col("_fold") != k for k in range(folds)}, options, features)
    return predict(dealt, models, features, F.col("_fold").cast("string")).drop("_fold")


def holdout_fit(rows: DataFrame, label: str, dims: int, held: Column, options: Options | None = None, features: str = "features", names: list[str] | None = None, rule: str | None = None, sure: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> tuple[Model, Model]:
    """A model of the rows that ``held`` does not keep back, and the final one of all rows, grown in one pass.

    Both carry the scores on the rows kept back: how many there are, how many calls of the trees are right, and, where
    ``rule`` names a column with the rules' type, how many of theirs, and of the trees' above each confidence in ``sure``
    and the rules' below. The final model's scores are of rows that it was trained on, so they are those of the first one.
    """
    kept = rows.withColumn("_held", F.coalesce(held, F.lit(False)))
    models = train_models(kept, label, dims, {"dev": ~F.col("_held"), "final": F.lit(True)}, options, features, names)
    if "dev" not in models:
        raise ValueError("no rows are left to train on")
    right = lambda c: F.sum((c == F.col(label)).cast("long"))
    told = {"n": F.count("*"), "trees": right(F.col("tree_type"))}
    if rule:
        told["rules"] = right(F.col(rule))
        told |= {f"blend_{t}": right(F.when(F.col("tree_conf") >= t, F.col("tree_type")).otherwise(F.col(rule))) for t in sure}
    scored = predict(kept.filter("_held"), models["dev"], features).agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in told.items())).first().asDict()
    for m in models.values():
        m.holdout = scored
    return models["dev"], models["final"]
