"""Gradient boosting on binned rows: second-order logistic loss, trees grown by level, by leaf or symmetric.

Rows become bin numbers once and stay in blocks, one per task. A job adds the gradients of all open nodes of all models
that are fitted together, per bin; the sums of a model meet in one task, which finds the splits, so that only
splits reach the driver. Gradients are whole multiples of 2^-24: their sums are exact, and trees do not depend on
the order or partitioning of rows.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskspark.session import cut_lineage

GRID = 2.0 ** 24
BINS = 255
CHUNK = 16_384
LOCAL_ROWS = 400_000
KEEP_LINEAGE = 20  # rounds between two checkpoints of the margins


@dataclass(frozen=True)
class Boosting:
    """What to fit: ``growth`` is ``level`` (to ``depth``), ``leaf`` (the best of all leaves, to ``leaves``) or
    ``symmetric`` (one split for all nodes of a level). ``least`` and ``least_rows`` bound a child's curvature and rows."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    columns: float = 1.0
    l2: float = 1.0
    least: float = 1.0
    least_rows: int = 1
    leaves: int = 31
    growth: str = "level"
    seed: int = 42

    def fit(self, df: DataFrame) -> "BoostedTrees":
        return fit_together([self], df)[0]


@dataclass
class BoostedTrees:
    """Trees as arrays of column, cut, children and value; a leaf has left -1."""

    base: float
    trees: list[dict[str, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            at = _walk(t["column"], t["cut"], t["left"], t["right"], x)
            out += t["value"][at]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            p = 1.0 / (1.0 + np.exp(-shared.value.margin(np.stack(x.to_numpy()).astype(np.float64)))) if len(x) else np.zeros(0)
            return pd.Series(list(np.stack([1.0 - p, p], axis=1)), dtype=object)
        return df.withColumn("probability", array_to_vector(score(vector_to_array("x"))))


def _walk(column, cut, left, right, x: np.ndarray) -> np.ndarray:
    """The node without children in which each row ends."""
    at = np.zeros(len(x), dtype=np.int64)
    live = np.arange(len(x))
    while True:
        live = live[left[at[live]] >= 0]
        if not len(live):
            return at
        n = at[live]
        at[live] = np.where(x[live, column[n]] <= cut[n], left[n], right[n])


def _drawn(key: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """A reproducible draw of rows by their hash."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z.astype(np.float64) < share * 2.0 ** 64


class Layout:
    """Bins of all columns one after the other; column c has ``starts[c]`` to ``ends[c]``."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        sizes = np.array([len(c) + 1 for c in cuts])
        self.ends = np.cumsum(sizes)
        self.starts, self.width = self.ends - sizes, int(self.ends[-1])
        self.column = np.repeat(np.arange(len(cuts)), sizes)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint16)
        for c, cuts in enumerate(self.cuts):
            out[:, c] = np.searchsorted(cuts, x[:, c], side="left") + self.starts[c]
        return out


def _cuts(df: DataFrame, width: int) -> list[np.ndarray]:
    """Values that split each column into at most ``BINS`` parts of about equal size."""
    at = [i / BINS for i in range(1, BINS)]
    ends = df.agg(F.array(*[F.percentile_approx(F.col("v")[i], at, 10_000) for i in range(width)]),
                  F.array(*[F.max(F.col("v")[i]) for i in range(width)])).first()
    return [np.unique([c for c in cuts if c < most]) for cuts, most in zip(*ends)]


def _sums(layout: Layout, block: dict, asked: dict) -> list[tuple[int, np.ndarray]]:
    """Per model: gradient, curvature and rows by open node and bin."""
    out = []
    for m, ask in asked.items():
        spec, columns = ask["spec"], ask["columns"]
        rows = np.flatnonzero(_drawn(block["key"], spec.seed, ask["turn"], spec.subsample)) if spec.subsample < 1 else np.arange(len(block["y"]))
        codes = block["codes"][rows]
        slot = ask["slot"][_walk(ask["column"], ask["cut"], ask["left"], ask["right"], codes)]
        rows, codes, slot = (a[slot >= 0] for a in (rows, codes, slot))
        p = 1.0 / (1.0 + np.exp(-block["margin"][m, rows]))
        w = block["w"][rows]
        parts = [np.rint(w * (p - block["y"][rows]) * GRID), np.rint(w * p * (1.0 - p) * GRID)]
        parts += [np.ones(len(rows))] if spec.least_rows > 1 else []
        size = ask["open"] * layout.width
        found = np.zeros((len(parts), size))
        for s in range(0, len(rows), CHUNK):
            here = slice(s, s + CHUNK)
            at = (slot[here, None] * layout.width + codes[here][:, columns]).ravel()
            for i, part in enumerate(parts):
                found[i] += np.bincount(at, np.repeat(part[here], len(columns)), size)
        out.append((m, found.reshape(len(parts), ask["open"], layout.width)))
    return out


def _splits(layout: Layout, spec: Boosting, columns: np.ndarray, sums: np.ndarray) -> list[tuple]:
    """(gain, bin, left gradient, left curvature, gradient, curvature) of each open node."""
    run = np.cumsum(sums, axis=2)
    before = np.concatenate([np.zeros((*sums.shape[:2], 1)), run], axis=2)
    left = run - before[:, :, layout.starts[layout.column]]
    c = columns[0]
    total = (before[:, :, layout.ends[c]] - before[:, :, layout.starts[c]])[:, :, None]
    right = total - left
    allowed = np.isin(layout.column, columns)
    allowed[layout.ends - 1] = False
    least = max(spec.least, 1e-9) * GRID
    if spec.growth == "symmetric":
        ok = np.broadcast_to(allowed, left.shape[1:])
    else:
        ok = allowed & (left[1] >= least) & (right[1] >= least)
        if spec.least_rows > 1:
            ok &= (left[2] >= spec.least_rows) & (right[2] >= spec.least_rows)

    def worth(s):
        return np.square(s[0] / GRID) / np.maximum(s[1] / GRID + spec.l2, 1e-12)
    gain = worth(left) + worth(right) - worth(total)
    if spec.growth == "symmetric":
        every = np.where(allowed, gain.sum(axis=0), -np.inf)
        at = np.full(len(gain), int(every.argmax()))
        best = np.full(len(gain), every.max())
    else:
        gain = np.where(ok, gain, -np.inf)
        at = gain.argmax(axis=1)
        best = gain[np.arange(len(gain)), at]
    n = np.arange(len(gain))
    return [tuple(map(float, r)) for r in zip(best, at, left[0, n, at] / GRID, left[1, n, at] / GRID, total[0, :, 0] / GRID, total[1, :, 0] / GRID)]


class Growing:
    """One tree on the driver: nodes with their sums, the best split where it is known, and children."""

    def __init__(self, spec: Boosting, layout: Layout, turn: int):
        self.spec, self.layout, self.turn = spec, layout, turn
        width = len(layout.cuts)
        rng = np.random.default_rng([spec.seed, turn])
        self.columns = np.sort(rng.choice(width, max(1, int(spec.columns * width + 1e-9)), replace=False))
        self.nodes: list[dict] = []
        self._add(0.0, 0.0, 0)
        self.open = [0]
        self.chosen: set[int] = set()

    def _add(self, g: float, h: float, depth: int) -> int:
        self.nodes.append({"g": g, "h": h, "depth": depth, "best": None, "left": -1, "right": -1})
        return len(self.nodes) - 1

    def ask(self) -> dict:
        bins = [int(n["best"][1]) if n["left"] >= 0 else 0 for n in self.nodes]
        slot = np.full(len(self.nodes), -1)
        slot[self.open] = np.arange(len(self.open))
        return {"spec": self.spec, "columns": self.columns, "turn": self.turn, "open": len(self.open), "slot": slot,
                "column": self.layout.column[bins], "cut": np.array(bins), **{c: np.array([n[c] for n in self.nodes]) for c in ("left", "right")}}

    def take(self, found: list[tuple]) -> None:
        for i, best in zip(self.open, found):
            self.nodes[i].update(best=best, g=best[4], h=best[5])
        if self.spec.growth == "leaf":
            self._best_first()
            return
        split = [i for i in self.open if self.nodes[i]["best"][0] > 1e-12]
        self.chosen.update(split)
        children = [c for i in split for c in self._split(i)]
        self.open = [c for c in children if self.nodes[c]["depth"] < self.spec.depth]

    def _split(self, i: int) -> list[int]:
        n = self.nodes[i]
        if n["left"] < 0:
            _, _, gl, hl, g, h = n["best"]
            n["left"], n["right"] = self._add(gl, hl, n["depth"] + 1), self._add(g - gl, h - hl, n["depth"] + 1)
        return [n["left"], n["right"]]

    def _best_first(self) -> None:
        """The leaves of largest gain split first; children whose gain is still unknown are asked for together."""
        self.chosen, ready, unknown = set(), [(-self.nodes[0]["best"][0], 0)], []
        while ready and len(self.chosen) < self.spec.leaves - 1:
            gain, i = heapq.heappop(ready)
            if -gain <= 1e-12:
                break
            self.chosen.add(i)
            if len(self.chosen) == self.spec.leaves - 1:
                self._split(i)
                break
            for c in self._split(i):
                if self.nodes[c]["best"] is None:
                    unknown.append(c)
                else:
                    heapq.heappush(ready, (-self.nodes[c]["best"][0], c))
        self.open = unknown

    def tree(self) -> dict[str, np.ndarray]:
        """Columns, cuts as bins, children and shrunk leaf values of the chosen splits."""
        kept, out = [0], []
        for i in kept:  # grows
            n = self.nodes[i]
            row = {"bin": 0, "left": -1, "right": -1, "value": -self.spec.rate * n["g"] / max(n["h"] + self.spec.l2, 1e-12)}
            if i in self.chosen:
                row.update(bin=int(n["best"][1]), left=len(kept), right=len(kept) + 1)
                kept += [n["left"], n["right"]]
            out.append(row)
        t = {c: np.array([r[c] for r in out]) for c in ("bin", "left", "right", "value")}
        return {**t, "column": self.layout.column[t["bin"]]}


def fit_together(specs: list[Boosting], df: DataFrame, local_rows: int = LOCAL_ROWS) -> list[BoostedTrees]:
    """Models on the columns ``x``, ``label`` and ``weight``, over the same binned rows. Up to ``local_rows`` rows each model is
    a task of its own; the trees are the same either way."""
    sc = df.sparkSession.sparkContext
    rows = df.select(vector_to_array("x").alias("v"), F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("w"))
    rows = rows.withColumn("key", F.xxhash64("v", "y"))
    rows = cut_lineage(rows.repartition(max(df.rdd.getNumPartitions(), sc.defaultParallelism)))  # a block per task
    w1, w0 = (float(x or 0.0) for x in rows.agg(F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * (1 - F.col("y")))).first())
    base = float(np.log(max(w1, 1e-9) / max(w0, 1e-9)))
    layout = Layout(_cuts(rows, len(rows.first().v)))
    shared = sc.broadcast(layout)

    def blocks(frames):
        parts = [(shared.value.codes(np.stack(f.v.to_numpy())), f.y.to_numpy(), f.w.to_numpy(), f.key.to_numpy(np.int64)) for f in frames if len(f)]
        if parts:
            codes, y, w, key = (np.concatenate(p) for p in zip(*parts))
            yield pd.DataFrame({"block": [_packed({"codes": codes, "y": y, "w": w, "key": key, "margin": np.full((len(specs), len(y)), base)})]})

    blocked = rows.mapInPandas(blocks, "block binary")
    if rows.count() <= local_rows:
        held = [_unpacked(r.block) for r in blocked.collect()]  # bounded by local_rows
        block = sc.broadcast({c: np.concatenate([h[c] for h in held]) for c in ("codes", "y", "w", "key")})
        fitted = sc.parallelize(specs, len(specs)).map(lambda spec: _fit_alone(spec, shared.value, block.value, base)).collect()
    else:
        fitted = _fit_spread(specs, layout, shared, blocked)
    return [BoostedTrees(base, [_with_cuts(layout, t) for t in trees]) for trees in fitted]


def _with_cuts(layout: Layout, t: dict) -> dict[str, np.ndarray]:
    cut = np.array([layout.cuts[c][b - layout.starts[c]] if l >= 0 else 0.0 for c, b, l in zip(t["column"], t["bin"], t["left"])])
    return {"cut": cut, **{c: t[c] for c in ("column", "left", "right", "value")}}


def _fit_alone(spec: Boosting, layout: Layout, block: dict, base: float) -> list[dict]:
    """One model in one task, over all rows: on few rows a job per level takes longer than the sums."""
    block, trees = {**block, "margin": np.full((1, len(block["y"])), base)}, []
    for turn in range(spec.rounds):
        t = Growing(spec, layout, turn)
        while t.open:
            (_, sums), = _sums(layout, block, {0: t.ask()})
            t.take(_splits(layout, spec, t.columns, sums))
        trees.append(t.tree())
        block = _advance({0: trees[-1]})(block)
    return trees


def _fit_spread(specs: list[Boosting], layout: Layout, shared, blocked: DataFrame) -> list[list[dict]]:
    """All models over blocks of rows, a job per level of all their trees."""
    state = blocked.rdd.map(lambda r: _unpacked(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
    trees, last = [[] for _ in specs], {}
    for turn in range(max(s.rounds for s in specs)):
        before = state
        if last:
            state = state.map(_advance(last)).persist(StorageLevel.MEMORY_AND_DISK)
            if turn % KEEP_LINEAGE == 0:
                state.checkpoint()
        growing = {m: Growing(s, layout, turn) for m, s in enumerate(specs) if turn < s.rounds}
        while asked := {m: t.ask() for m, t in growing.items() if t.open}:
            for m, found in _evaluate(state, shared, asked):
                growing[m].take(found)
            if before is not state:
                before.unpersist()
                before = state
        last = {m: t.tree() for m, t in growing.items()}
        for m, t in last.items():
            trees[m].append(t)
    state.unpersist()
    return trees


def _evaluate(state, shared, asked: dict) -> list[tuple[int, list[tuple]]]:
    found = state.flatMap(lambda b: _sums(shared.value, b, asked))
    found = found.reduceByKey(np.add, min(len(asked), state.getNumPartitions()))
    return found.map(lambda r: (r[0], _splits(shared.value, asked[r[0]]["spec"], asked[r[0]]["columns"], r[1]))).collect()


def _advance(trees: dict):
    def step(block: dict) -> dict:
        margin = block["margin"].copy()
        for m, t in trees.items():
            margin[m] += t["value"][_walk(t["column"], t["bin"], t["left"], t["right"], block["codes"])]
        return {**block, "margin": margin}
    return step


def _packed(block: dict) -> bytes:
    return pickle.dumps(block, protocol=5)


def _unpacked(blob: bytes) -> dict:
    return pickle.loads(bytes(blob))
