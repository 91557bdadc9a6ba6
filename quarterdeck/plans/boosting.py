"""Boosted regression trees with the history of every round.

A fit is one grid point: squared error, histogram splits, a share of rows and columns a tree, and
rounds that end when the validation error has not improved for a while; the model is cut at its
best round. Every fit reads all rows of its splits. Splits of up to ``max_rows`` rows are fitted by
one task for each specification, side by side in one Spark job. Larger ones are cut into blocks of
bin codes, and all specifications grow their trees together: a job per tree level adds up the
histograms of all blocks (``_fit_blocks``), so that a task holds a block at a time. Scoring reads
all rows.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions import order
from quarterdeck.session import cut_lineage, delete_path, release, shared_folder

# The tuning grid (depth, smallest leaf, share of rows) and settings shared by its points.
BOOSTED_GRID = tuple(itertools.product((2, 3, 4), (1, 5), (0.8, 1.0)))
LEARNING_RATE, COLUMN_SHARE, LEAF_PENALTY = 0.05, 0.8, 1.0
MAX_ROUNDS, PATIENCE = 1000, 30

_BINS = 256
#: Rows of a block, blocks of a written partition, and rounds after which the blocks' lineage is cut.
_BLOCK_ROWS, _BLOCKS_PER_PART, _ROUNDS_PER_CHECKPOINT = 1 << 16, 4, 20
#: Partitions whose histograms are added up by the driver; those of more are added up by tasks.
_GATHERED_PARTS = 16
_SCHEMA = (
    "candidate string, best_round int, history array<struct<boosting_round:int,training_mae:double,validation_mae:double>>, "
    "model binary"
)


@dataclass(frozen=True)
class Specification:
    """One fit. Without ``patience`` all rounds are kept and no validation rows are needed."""

    name: str
    features: tuple[str, ...]
    depth: int = 3
    child: int = 1
    subsample: float = 0.8
    rounds: int = MAX_ROUNDS
    patience: int | None = PATIENCE


def grid_specifications(
    features: Sequence[str], grid: Sequence[tuple[int, int, float]] = BOOSTED_GRID, rounds: int = MAX_ROUNDS,
    patience: int = PATIENCE,
) -> list[Specification]:
    return [
        Specification(f"trees_{i:02d}", tuple(features), depth, child, subsample, rounds, patience)
        for i, (depth, child, subsample) in enumerate(grid, start=1)
    ]


@dataclass
class Trees:
    """Full binary trees: split column (-1: all rows go left) and bound of inner nodes, values of leaves."""

    features: tuple[str, ...]
    base: float
    column: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def predict(self, values: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(values), self.base), np.arange(len(values))
        for column, bound, leaf in zip(self.column, self.bound, self.leaf, strict=True):
            node, width = np.zeros(len(values), np.int64), 1
            while width < len(leaf):
                at = width - 1 + node
                node = 2 * node + ((column[at] >= 0) & (values[rows, column[at]] > bound[at]))
                width *= 2
            out += leaf[node]
        return out


def _gains(sums: np.ndarray, counts: np.ndarray, child: int):
    """Of histograms by node and bin: sums and rows up to each bin, and the gain of a cut behind it."""
    left, n = sums.cumsum(1), counts.cumsum(1)
    total, rows = left[:, -1:], n[:, -1:]
    gain = left**2 / (n + LEAF_PENALTY) + (total - left) ** 2 / (rows - n + LEAF_PENALTY) - total**2 / (rows + LEAF_PENALTY)
    gain[(n < child) | (rows - n < child)] = 0.0
    return left, n, gain


def _grow(codes: np.ndarray, slope: np.ndarray, sampled: np.ndarray, columns: np.ndarray, depth: int, child: int):
    """One tree on bin codes: split columns and bins of inner nodes, leaf values, and every row's leaf."""
    column, cut = np.full(2**depth - 1, -1, np.int64), np.zeros(2**depth - 1, np.int64)
    node, part, slopes = np.zeros(len(codes), np.int64), codes[sampled], slope[sampled]
    for level in range(depth):
        width, own = 2**level, node[sampled]
        best = np.full(width, 1e-12)
        for j in columns:
            cells = own * _BINS + part[:, j]
            sums = np.bincount(cells, slopes, width * _BINS).reshape(width, _BINS)
            gain = _gains(sums, np.bincount(cells, minlength=width * _BINS).reshape(width, _BINS), child)[2]
            at = gain.argmax(1)
            found = gain[np.arange(width), at]
            better = found > best
            best[better] = found[better]
            column[width - 1 : 2 * width - 1][better] = j
            cut[width - 1 : 2 * width - 1][better] = at[better]
        at = width - 1 + node
        node = 2 * node + ((column[at] >= 0) & (codes[np.arange(len(codes)), column[at]] > cut[at]))
    own = node[sampled]
    total, rows = np.bincount(own, slopes, 2**depth), np.bincount(own, minlength=2**depth)
    return column, cut, -LEARNING_RATE * total / (rows + LEAF_PENALTY), node


def _boost(spec: Specification, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, seed: int):
    """(trees, best round, history) of one specification."""
    draw = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, _BINS + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    wide = max(1, int(COLUMN_SHARE * x.shape[1]))
    base = float(y.mean())
    fitted, ahead = np.full(len(y), base), np.full(len(vy), base)
    grown, history, best, best_round = [], [], np.inf, 0
    for number in range(1, spec.rounds + 1):
        sampled = np.flatnonzero(draw.random(len(y)) < spec.subsample) if spec.subsample < 1 else np.arange(len(y))
        columns = np.sort(draw.permutation(x.shape[1])[:wide])
        column, cut, leaf, node = _grow(codes, fitted - y, sampled, columns, spec.depth, spec.child)
        # Rows with a code up to the cut have a value up to the cut's edge.
        bound = np.array([edges[c][k] if c >= 0 and k < len(edges[c]) else np.inf for c, k in zip(column, cut, strict=True)])
        grown.append((column, bound, leaf))
        fitted += leaf[node]
        one = Trees(spec.features, 0.0, column[None], bound[None], leaf[None])
        ahead += one.predict(vx)
        validation = float(np.abs(vy - ahead).mean()) if len(vy) else None
        history.append((number, float(np.abs(y - fitted).mean()), validation))
        if validation is None:
            best_round = number
        elif validation < best:
            best, best_round = validation, number
        elif spec.patience is not None and number - best_round >= spec.patience:
            break
    kept = best_round if spec.patience is not None else len(grown)
    columns = [np.stack([g[i] for g in grown[:kept]]) for i in range(3)]
    return Trees(spec.features, base, *columns), kept, history


def bounded_sample(frame: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """All rows if there are at most ``max_rows``, else about that many, chosen by a hash of the keys.

    No fit uses it any more; it is kept for its test only.
    """
    n = frame.count()
    if n <= max_rows:
        return frame
    return frame.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 32)) < int((1 << 32) * max_rows / n))


def fit_boosted(
    train: DataFrame, validation: DataFrame | None, target: str, specifications: Sequence[Specification],
    keys: Sequence[str] = ("report_period", "permno"), max_rows: int = 200_000, seed: int = 13,
) -> DataFrame:
    """(candidate, best_round, history, model) of each specification, stored.

    Features must be filled (see ``apply_preprocessing``); rows without a target are left out. Rows
    are ordered by ``keys`` before a fit, so reruns agree. All rows are fitted on: ``max_rows`` is
    the size of a split up to which a task fits one specification alone, else all tasks fit together.
    """
    specs = {s.name: s for s in specifications}
    features = sorted({f for s in specifications for f in s.features})
    columns = [*[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)], *features, F.col(target).cast("double").alias("_y")]
    parts = [train.withColumn("_part", F.lit(0))] + ([validation.withColumn("_part", F.lit(1))] if validation is not None else [])
    rows, counts = None, [0, 0]
    for i, part in enumerate(parts):
        known = part.where(F.col(target).isNotNull()).select("_part", *columns)
        counts[i] = known.count()
        rows = known if rows is None else rows.unionByName(known)
    if max(counts) > max_rows:
        return _fit_blocks(rows, list(specs.values()), features, [f"_k{i}" for i in range(len(keys))], counts, seed)
    dealt = rows.withColumn("candidate", F.explode(F.array(*[F.lit(name) for name in specs])))
    order = [f"_k{i}" for i in range(len(keys))]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        spec = specs[group["candidate"].iloc[0]]
        group = group.sort_values(order)
        ahead = group["_part"].to_numpy() == 1
        x, y = group[list(spec.features)].to_numpy(np.float64), group["_y"].to_numpy(np.float64)
        if ahead.all():
            raise ValueError("No rows to fit on.")
        trees, best, history = _boost(spec, x[~ahead], y[~ahead], x[ahead], y[ahead], seed)
        listed = [{"boosting_round": r, "training_mae": t, "validation_mae": v} for r, t, v in history]
        return pd.DataFrame({"candidate": [spec.name], "best_round": [best], "history": [listed], "model": [pickle.dumps(trees)]})

    return cut_lineage(dealt.groupBy("candidate").applyInPandas(fit, _SCHEMA))


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Edges of each feature's bins from all rows: the quantiles ``_boost`` takes from an array, exactly."""
    long = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    ranks = order.ranked_values(long, ["feature"], "value").withColumn("last", F.greatest(F.col("total") - 1, F.lit(1)))
    # Edge k lies at rank k * last / _BINS, between the values of the ranks below and above it.
    listed = ranks.selectExpr(
        "feature", "value",
        f"greatest((before * {_BINS} + last - 1) div last, 1) AS low_from",
        f"least(((before + ties) * {_BINS} + last - 1) div last - 1, {_BINS - 1}) AS low_to",
        f"greatest(((before - 1) * {_BINS}) div last + 1, 1) AS high_from",
        f"least(((before + ties - 1) * {_BINS}) div last, {_BINS - 1}) AS high_to",
        "last",
    ).where("low_from <= low_to OR high_from <= high_to")
    found: dict[str, tuple[dict, dict]] = {f: ({}, {}) for f in features}
    last = {}
    for r in listed.collect():  # at most two values an edge
        last[r["feature"]] = r["last"]
        for side, start, end in ((0, r["low_from"], r["low_to"]), (1, r["high_from"], r["high_to"])):
            found[r["feature"]][side].update(dict.fromkeys(range(start, end + 1), r["value"]))
    out = []
    for f in features:
        low = np.array([found[f][0][k] for k in range(1, _BINS)])
        high = np.array([found[f][1].get(k, low[k - 1]) for k in range(1, _BINS)])
        share = np.arange(1, _BINS) * last[f] / _BINS % 1.0
        out.append(np.unique(np.where(share < 0.5, low + (high - low) * share, high - (high - low) * (1 - share))))
    return out


def _blocks(rows: DataFrame, features: Sequence[str], keys: Sequence[str], edges: Sequence[np.ndarray], n: int) -> DataFrame:
    """Stored blocks of rows in an order of their own: bin codes by feature, targets, hashes of keys; train rows first."""
    def packed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(parts)
        codes = np.stack([np.searchsorted(e, part[f].to_numpy(np.float64)) for f, e in zip(features, edges, strict=True)])
        return pd.DataFrame({
            "codes": [codes.astype(np.uint8).tobytes()], "y": [part["_y"].to_numpy(np.float64).tobytes()],
            "hashes": [part["_h"].to_numpy(np.int64).tobytes()], "train": [int((part["_part"] == 0).sum())],
        })

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= _BLOCK_ROWS:
                yield packed(waiting)
                waiting = []
        if sum(map(len, waiting)):
            yield packed(waiting)

    chosen = rows.select("_part", *features, "_y", F.xxhash64(*keys).alias("_h"))
    dealt = chosen.repartition(-(-n // (_BLOCK_ROWS * _BLOCKS_PER_PART)), "_h").sortWithinPartitions("_part", "_h", "_y", *features)
    return cut_lineage(dealt.mapInPandas(pack, "codes binary, y binary, hashes binary, train int"))


def _nodes(codes: np.ndarray, column: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Node of every row (a column of ``codes``) at a level of a tree."""
    node = np.zeros(codes.shape[1], np.uint16)
    for level in range(depth):
        right = np.zeros(len(node), bool)
        for at in range(2**level - 1, 2 ** (level + 1) - 1):
            if column[at] >= 0:
                right |= (node == at - 2**level + 1) & (codes[column[at]] > cut[at])
        node = 2 * node + right
    return node


def _drawn(hashes: np.ndarray, salt: int, share: float) -> np.ndarray | slice:
    """Which rows a tree is grown on, whatever block they are in."""
    if share >= 1:
        return slice(None)
    mixed = hashes.view(np.uint64) ^ np.uint64(salt)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))) < np.uint64(int(share * 2**64))


@dataclass(frozen=True)
class _Histogram:
    """Histograms of one level: of a tree as grown so far, on what the trees before it leave."""

    fitted: int
    share: float
    columns: tuple[int, ...]
    level: int
    column: bytes
    cut: bytes

    def add(self, total: np.ndarray | None, codes: np.ndarray, slope: np.ndarray) -> np.ndarray:
        width = 2**self.level
        out = np.zeros((2, len(self.columns), width * _BINS)) if total is None else total
        node = _nodes(codes, np.frombuffer(self.column, np.int64), np.frombuffer(self.cut, np.int64), self.level)
        cells = node.astype(np.intp) * _BINS
        for i, j in enumerate(self.columns):
            at = cells + codes[j]
            out[0, i] += np.bincount(at, slope, width * _BINS)
            out[1, i] += np.bincount(at, minlength=width * _BINS)
        return out


class _Candidate:
    """A specification while its trees grow; columns are numbered as the blocks' are."""

    def __init__(self, spec: Specification, features: Sequence[str], edges: Sequence[np.ndarray], seed: int) -> None:
        self.spec, self.edges = spec, edges
        self.own = [features.index(f) for f in spec.features]
        self.draw = np.random.default_rng(seed)
        self.fitted, self.grown, self.history, self.best, self.best_round = 0, [], [], np.inf, 0

    def start(self) -> None:
        depth, wide = self.spec.depth, max(1, int(COLUMN_SHARE * len(self.own)))
        self.columns = tuple(self.own[j] for j in np.sort(self.draw.permutation(len(self.own))[:wide]))
        self.column, self.cut = np.full(2**depth - 1, -1, np.int64), np.zeros(2**depth - 1, np.int64)
        self.leaf = np.zeros(2**depth)

    def wanted(self, level: int) -> _Histogram:
        above = 2**level - 1
        return _Histogram(
            self.fitted, self.spec.subsample, self.columns, level, self.column[:above].tobytes(), self.cut[:above].tobytes()
        )

    def split(self, level: int, histogram: np.ndarray) -> None:
        width = 2**level
        sums, counts = histogram.reshape(2, len(self.columns), width, _BINS)
        best, nodes = np.full(width, 1e-12), np.arange(width)
        column, cut = self.column[width - 1 : 2 * width - 1], self.cut[width - 1 : 2 * width - 1]
        total, rows = sums[0].sum(1), counts[0].sum(1)
        left, n = total.copy(), rows.copy()
        for i, j in enumerate(self.columns):
            below, rows_below, gain = _gains(sums[i], counts[i], self.spec.child)
            at = gain.argmax(1)
            found = gain[nodes, at]
            better = found > best
            best[better], column[better], cut[better] = found[better], j, at[better]
            left[better], n[better] = below[nodes, at][better], rows_below[nodes, at][better]
        if level == self.spec.depth - 1:
            halves = np.stack([left, np.where(column >= 0, total - left, 0.0)], 1), np.stack([n, rows - n], 1)
            self.leaf = (-LEARNING_RATE * halves[0] / (halves[1] + LEAF_PENALTY)).ravel()

    def finish(self) -> None:
        bound = [self.edges[c][k] if c >= 0 and k < len(self.edges[c]) else np.inf for c, k in zip(self.column, self.cut, strict=True)]
        own = [self.own.index(c) if c >= 0 else -1 for c in self.column]
        self.grown.append((np.array(own, np.int64), np.array(bound), self.leaf))

    def measured(self, training: float, validation: float | None) -> bool:
        """Note the errors of the last round; whether another one follows."""
        number, patience = len(self.grown), self.spec.patience
        self.history.append((number, training, validation))
        if validation is None:
            self.best_round = number
        elif validation < self.best:
            self.best, self.best_round = validation, number
        elif patience is not None and number - self.best_round >= patience:
            return False
        return number < self.spec.rounds

    def result(self, base: float) -> tuple:
        kept = self.best_round if self.spec.patience is not None else len(self.grown)
        trees = Trees(self.spec.features, base, *[np.stack([g[i] for g in self.grown[:kept]]) for i in range(3)])
        return self.spec.name, kept, self.history, bytearray(pickle.dumps(trees))


def _added(blocks: RDD, measure, keys: int) -> dict:
    """Sums of what ``measure`` finds in each partition, by key; partitions are added in order, so reruns agree."""
    found = blocks.mapPartitionsWithIndex(lambda i, part: [(key, (i, value)) for key, value in measure(part).items()])

    def in_order(parts) -> np.ndarray:
        parts = sorted(parts, key=lambda p: p[0])
        total = parts[0][1].copy()
        for _, value in parts[1:]:
            total += value
        return total

    if blocks.getNumPartitions() > _GATHERED_PARTS:
        return dict(found.groupByKey(min(keys, blocks.context.defaultParallelism)).mapValues(in_order).collect())
    listed: dict = {}
    for key, part in found.collect():
        listed.setdefault(key, []).append(part)
    return {key: in_order(parts) for key, parts in listed.items()}


def _fit_blocks(
    rows: DataFrame, specs: Sequence[Specification], features: Sequence[str], keys: Sequence[str], counts: Sequence[int], seed: int
) -> DataFrame:
    """``fit_boosted`` on blocks of all rows: trees of all specifications grow level by level, a job for each.

    Blocks carry what the trees so far predict. Specifications that have grown the same trees share
    it, and those that ask for the same histogram share that. Blocks are kept on disk, those of a
    round until the next one; their lineage is cut now and then, as it grows with the rounds.
    """
    if not counts[0]:
        raise ValueError("No rows to fit on.")
    rows = cut_lineage(rows)
    edges = bin_edges(rows.where("_part = 0"), features)
    table = _blocks(rows, features, keys, edges, sum(counts))
    release(rows)
    base = _added(
        table.select("y", "train").rdd, lambda part: {0: sum((np.frombuffer(b.y)[: b.train].sum(keepdims=True) for b in part), np.zeros(1))}, 1
    )[0][0] / counts[0]

    def unpack(part):
        for b in part:
            y = np.frombuffer(b.y)
            yield np.frombuffer(b.codes, np.uint8).reshape(len(features), -1), y, np.frombuffer(b.hashes, np.int64), b.train, {0: np.full(len(y), base)}

    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    blocks = table.rdd.mapPartitions(unpack).persist(StorageLevel.DISK_ONLY)
    candidates = [_Candidate(s, features, edges, seed) for s in specs]
    active, number, before, saved = list(candidates), 0, [], []
    while active:
        number += 1
        salt = int(np.random.default_rng((seed, number)).integers(2**63))
        growing = [c for c in active if len(c.grown) < c.spec.rounds]
        for c in growing:
            c.start()
        for level in range(max((c.spec.depth for c in growing), default=1)):
            wanted: dict[_Histogram, int] = {}
            for c in growing:
                if level < c.spec.depth:
                    wanted.setdefault(c.wanted(level), len(wanted))
            sums = _added(blocks, _measure(wanted, salt, sorted({c.fitted for c in active}) if not level else []), len(wanted) + 1)
            if not level:
                # The blocks of this round are written, so those of the last one can go.
                for old in before:
                    old.unpersist()
                before = []
                if blocks.getCheckpointFile():
                    saved.append(blocks.getCheckpointFile())
                while len(saved) > 1:
                    delete_path(rows.sparkSession, saved.pop(0))
            if not level and number > 1:
                errors = dict(zip(sorted({c.fitted for c in active}), sums[-1], strict=True))
                active = [
                    c for c in active
                    if c.measured(float(errors[c.fitted][0] / counts[0]), float(errors[c.fitted][1] / counts[1]) if counts[1] else None)
                ]
                growing = [c for c in growing if c in active]
            for c in growing:
                if level < c.spec.depth:
                    c.split(level, sums[wanted[c.wanted(level)]])
        trees: dict[tuple, int] = {}
        for c in growing:
            c.finish()
            key = (c.fitted, c.column.tobytes(), c.cut.tobytes(), c.leaf.tobytes())
            c.fitted = trees.setdefault(key, len(trees))
        if growing:
            before.append(blocks)
            blocks = blocks.mapPartitions(_advance(trees)).persist(StorageLevel.DISK_ONLY)
            if number % _ROUNDS_PER_CHECKPOINT == 0:
                blocks.checkpoint()
    blocks.unpersist()
    release(table)
    for path in saved:
        delete_path(rows.sparkSession, path)
    return cut_lineage(rows.sparkSession.createDataFrame([c.result(float(base)) for c in candidates], _SCHEMA))


def _measure(wanted: dict[_Histogram, int], salt: int, fits: Sequence[int]):
    """Histograms of a partition's blocks by number and, at -1, absolute errors on train and validation rows."""

    def measure(part) -> dict:
        out: dict = {}
        for codes, y, hashes, train, fitted in part:
            if fits:
                away = [np.abs(y - fitted[f]) for f in fits]
                out[-1] = out.get(-1, 0.0) + np.array([[a[:train].sum(), a[train:].sum()] for a in away])
            drawn: dict = {}
            for one, at in wanted.items():
                if one.share not in drawn:
                    kept = _drawn(hashes[:train], salt, one.share)
                    drawn[one.share] = kept, codes[:, :train][:, kept]
                kept, some = drawn[one.share]
                out[at] = one.add(out.get(at), some, (fitted[one.fitted][:train] - y[:train])[kept])
        return out

    return measure


def _advance(trees: dict[tuple, int]):
    """Blocks with the predictions that a round's trees make of those before it."""
    grown = [
        (at, fitted, np.frombuffer(column, np.int64), np.frombuffer(cut, np.int64), np.frombuffer(leaf))
        for (fitted, column, cut, leaf), at in trees.items()
    ]

    def advance(part):
        for codes, y, hashes, train, fitted in part:
            moved = {
                at: fitted[old] + leaf[_nodes(codes, column, cut, len(leaf).bit_length() - 1)] for at, old, column, cut, leaf in grown
            }
            yield codes, y, hashes, train, moved

    return advance


def boosting_history(fits: DataFrame) -> DataFrame:
    """(candidate, boosting_round, training_mae, validation_mae): a row per round that was grown."""
    return fits.select("candidate", F.inline("history"))


def score_boosted(
    frame: DataFrame, fits: DataFrame, output: str = "prediction", keep: Sequence[str] | None = None
) -> DataFrame:
    """Rows of ``frame`` once per fit, with ``candidate`` and the prediction bounded to 0..1.

    Models reach the tasks as one broadcast; their size is set by rounds and depth, not by data.
    Of the frame's columns those of ``keep`` (all, if not given) are returned.
    """
    models = {r["candidate"]: pickle.loads(r["model"]) for r in fits.select("candidate", "model").collect()}
    shared = frame.sparkSession.sparkContext.broadcast(models)
    kept = list(frame.columns if keep is None else keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (frame.schema[c] for c in kept))
    read = dict.fromkeys([*kept, *(f for trees in models.values() for f in trees.features)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, trees in sorted(shared.value.items()):
                values = trees.predict(batch[list(trees.features)].to_numpy(np.float64))
                yield batch[kept].assign(candidate=name, **{output: np.clip(values, 0.0, 1.0)})

    return frame.select(*read).mapInPandas(score, f"{schema}, candidate string, `{output}` double")
