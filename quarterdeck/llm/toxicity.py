"""Toxicity by a classifier chain on word features.

Categories are predicted one after the other. Each is a logistic model of the words and word
beginnings that a text holds, and of the log-odds predicted for the categories before it. For
training, those log-odds come from models fitted without the row's fold, so a later model learns
how far the earlier predictions can be trusted on unseen texts.

Fitting uses at most ``max_rows`` labelled rows, chosen by a hash of their id, and at most
``max_features`` features, the same number for each category by association over those rows. Both
bounds make the model's size a constant; scoring runs over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.textbytes import ALNUM, mix, pieces, prefix_sums, span_hash, word_spans
from quarterdeck.session import cut_lineage

_PREFIXES = (4, 5, 6)
_BITS = 20
FOLDS = 5
_CLIP = 6.0


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all whole words and beginnings of 4 to 6 bytes, with repeats."""
    start, stop, at = word_spans(data, offsets, ALNUM[0])
    sums = prefix_sums(data, ALNUM[1])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    hashes, owners = [span_hash(sums, start, stop)], [owner]
    for size in _PREFIXES:
        long = stop - start > size
        hashes.append(span_hash(sums, start[long], start[long] + size) + np.uint64(size))
        owners.append(owner[long])
    return np.concatenate(owners), np.concatenate(hashes).view(np.int64)


@dataclass(frozen=True)
class ChainModel:
    """Sorted feature hashes and, per category, feature weights, weights of earlier log-odds, bias, threshold."""

    categories: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray

    def threshold(self, category: str) -> float:
        return float(self.thresholds[self.categories.index(category)])

    def log_odds(self, owner: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
        """Log-odds (texts x categories) from distinct (text, feature place) pairs."""
        out = np.zeros((texts, len(self.categories)))
        for j in range(len(self.categories)):
            words = np.bincount(owner, weights=self.weights[j][feature], minlength=texts) if len(owner) else 0.0
            out[:, j] = self.bias[j] + words + np.clip(out[:, :j], -_CLIP, _CLIP) @ self.earlier[j][:j]
        return out

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Probabilities (texts x categories)."""
        bits = np.zeros(1 << _BITS, bool)
        bits[_place(self.features)] = True
        out = []
        for first, end, data, offsets in pieces(texts):
            owner, hashes = feature_hashes(data, offsets)
            hit = np.flatnonzero(bits[_place(hashes)])
            owner, hashes = owner[hit], hashes[hit]
            place = np.searchsorted(self.features, hashes)
            place[place == len(self.features)] = 0
            same = self.features[place] == hashes if len(self.features) else np.zeros(0, bool)
            pair = np.unique(owner[same] * len(self.features) + place[same])
            width = max(1, len(self.features))
            out.append(self.log_odds(pair // width, pair % width, end - first))
        odds = np.concatenate(out) if out else np.zeros((0, len(self.categories)))
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -50, 50)))


def _place(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes.view(np.uint64).copy()) >> np.uint64(64 - _BITS)).astype(np.int64)


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled text."""
    for batch in batches:
        lists = []
        for first, end, data, offsets in pieces(batch.column("text")):
            owner, hashes = feature_hashes(data, offsets)
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
            counts = np.bincount(owner[new], minlength=end - first)
            lists += np.split(hashes[new], np.cumsum(counts)[:-1])
        kept = batch.select([c for c in batch.schema.names if c != "text"])
        values = pa.array(lists, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, values], [*kept.schema.names, "features"])


def _counted(categories: int):
    """Texts per feature, in all and by category, summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            lengths = np.diff(lists.offsets.to_numpy())
            distinct, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            columns = [pa.array(distinct), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())]
            for j in range(categories):
                y = np.repeat(batch.column(f"y{j}").to_numpy(zero_copy_only=False).astype(float), lengths)
                columns.append(pa.array(np.bincount(codes, weights=y, minlength=len(distinct)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["feature", "n", *[f"p{j}" for j in range(categories)]])

    return run


def _placed(features: np.ndarray):
    """Places of each labelled text's features among the chosen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features").to_numpy(zero_copy_only=False)
            places = [np.flatnonzero(np.isin(features, own, assume_unique=True)).astype(np.int32) for own in lists]
            kept = batch.select([c for c in batch.schema.names if c != "features"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(places, pa.list_(pa.int32()))], [*kept.schema.names, "places"]
            )

    return run


class Incidence:
    """Which of ``width`` features each of ``height`` rows holds, laid out by row and by feature."""

    def __init__(self, row: np.ndarray, place: np.ndarray, height: int, width: int):
        self.shape = (height, width)
        by_row, by_place = np.argsort(row, kind="stable"), np.argsort(place, kind="stable")
        self.places, self.rows = place[by_row].astype(np.int32), row[by_place].astype(np.int32)
        self.row_ids, self.row_starts = np.unique(row[by_row], return_index=True)
        self.place_ids, self.place_starts = np.unique(place[by_place], return_index=True)

    def by_row(self, of_feature: np.ndarray) -> np.ndarray:
        """Sum over each row's features."""
        out = np.zeros(self.shape[0])
        if len(self.places):
            out[self.row_ids] = np.add.reduceat(of_feature[self.places], self.row_starts)
        return out

    def by_feature(self, of_row: np.ndarray) -> np.ndarray:
        """Sum over each feature's rows."""
        out = np.zeros(self.shape[1])
        if len(self.rows):
            out[self.place_ids] = np.add.reduceat(of_row[self.rows], self.place_starts)
        return out


def fit_logistic(
    held: Incidence, dense: np.ndarray, y: np.ndarray, keep: np.ndarray, penalty: float = 0.1, steps: int = 200
) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature weights, dense weights, bias) of an L2-penalised logistic model on rows ``keep``.

    Accelerated gradient steps, scaled by a bound of each coordinate's curvature: for row sizes
    s, the loss curves no more than the diagonal matrix of sums of |x| s / 4.
    """
    height, width = held.shape
    weight = keep.astype(float)
    rate = np.clip((weight * y).sum() / max(1.0, weight.sum()), 1e-4, 1 - 1e-4)
    size = held.by_row(np.ones(width)) + np.abs(dense).sum(axis=1) + 1.0
    scale = 0.25 * held.by_feature(weight * size) + penalty
    scale_dense = 0.25 * (np.abs(dense) * (weight * size)[:, None]).sum(axis=0) + penalty
    scale_bias = 0.25 * (weight * size).sum() + 1e-9
    w, v, b = np.zeros(width), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate)))
    pw, pv, pb = w.copy(), v.copy(), b
    for t in range(steps):
        m = t / (t + 3)
        ew, ev, eb = w + m * (w - pw), v + m * (v - pv), b + m * (b - pb)
        odds = held.by_row(ew) + dense @ ev + eb
        error = weight * (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y)
        pw, pv, pb = w, v, b
        w = ew - (held.by_feature(error) + penalty * ew) / scale
        v = ev - (dense.T @ error + penalty * ev) / scale_dense
        b = eb - error.sum() / scale_bias
    return w, v, b


def best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Probability above which the F1 score on out-of-fold log-odds is highest, midway to the next lower value."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    score = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(odds[order][:-1] != odds[order][1:], True)  # equal values go together
    at = int(np.argmax(np.where(last, score, -1.0)))
    lower = odds[order][at + 1] if at + 1 < len(y) else odds[order][at] - 2
    return float(1 / (1 + np.exp(-(odds[order][at] + lower) / 2)))


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], id_column: str = "doc_id",
    text_column: str = "text", label_id: str = "doc_id", max_rows: int = 12_000, max_features: int = 3_000,
) -> ChainModel:
    """Fit the chain on labelled rows of ``docs``; ``categories`` maps names to 0/1 columns of ``labels``, in order.

    Labelled rows with a null id or label, and labels without a document, take no part. Repeated
    labels of an id count by their maximum. Without usable rows every probability is near zero.
    """
    names = list(categories)
    chosen = labels.select(
        F.col(label_id).cast("long").alias("doc_id"), *[c.cast("int").alias(f"y{j}") for j, c in enumerate(categories.values())]
    ).dropna().groupBy("doc_id").agg(*[F.max(f"y{j}").alias(f"y{j}") for j in range(len(names))])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sample = source.join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of a few integers
    targets = ", ".join(f"y{j} int" for j in range(len(names)))
    rows = cut_lineage(
        sample.select("doc_id", *[f"y{j}" for j in range(len(names))], "text").mapInArrow(
            _feature_lists, f"doc_id long, {targets}, features array<long>"
        )
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"y{j}"), F.lit(0)).alias(f"p{j}") for j in range(len(names))]).first()
    counts = rows.drop("doc_id").mapInArrow(
        _counted(len(names)), "feature long, n long, " + ", ".join(f"p{j} long" for j in range(len(names)))
    ).groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"p{j}").alias(f"p{j}") for j in range(len(names))])
    n = float(max(1, total["n"]))
    scores = []
    for j in range(len(names)):
        share = total[f"p{j}"] / n
        spread = F.col("n") * (1 - F.col("n") / F.lit(n)) * F.lit(max(1e-12, share * (1 - share)))
        scores.append(F.when(spread > 0, (F.col(f"p{j}") - F.col("n") * F.lit(share)) ** 2 / spread).otherwise(0.0))
    # Each category chooses its own share of the features.
    counts = cut_lineage(counts.where("n >= 3").select("feature", *[c.alias(f"s{j}") for j, c in enumerate(scores)]))
    best = set()
    for j in range(len(names)):
        best.update(r[0] for r in counts.orderBy(F.desc(f"s{j}"), "feature").limit(max_features // len(names)).select("feature").collect())
    features = np.sort(np.array(sorted(best), np.int64))

    held = rows.mapInArrow(_placed(features), f"doc_id long, {targets}, places array<int>").toPandas()
    held = held.sort_values("doc_id", kind="stable").reset_index(drop=True)
    lists = held["places"].to_numpy()
    place = np.concatenate([np.asarray(p, np.int64) for p in lists]) if len(lists) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(held)), [len(p) for p in lists]) if len(lists) else np.zeros(0, np.int64)
    sparse = Incidence(row, place, len(held), len(features))
    fold = (mix(held["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    dense = np.zeros((len(held), 0))
    weights, earlier, bias, thresholds = [], np.zeros((len(names), len(names))), [], []
    for j in range(len(names)):
        y = held[f"y{j}"].to_numpy(float)
        if not 0 < y.sum() < len(y):  # nothing to tell apart
            weights.append(np.zeros(len(features)))
            bias.append(20.0 if len(y) and y.all() else -20.0)
            thresholds.append(0.5)
            dense = np.column_stack([dense, np.full(len(held), bias[-1])])
            continue
        scaled = np.clip(dense, -_CLIP, _CLIP)
        unseen = np.zeros(len(held))
        for k in range(FOLDS):
            w, v, b = fit_logistic(sparse, scaled, y, fold != k)
            odds = sparse.by_row(w) + scaled @ v + b
            unseen[fold == k] = odds[fold == k]
        w, v, b = fit_logistic(sparse, scaled, y, np.ones(len(held), bool))
        weights.append(w)
        earlier[j, :j] = v
        bias.append(b)
        thresholds.append(best_threshold(unseen, y))
        dense = np.column_stack([dense, unseen])
    return ChainModel(
        tuple(names), features, np.array(weights).reshape(len(names), len(features)), earlier, np.array(bias),
        np.array(thresholds),
    )


def score_chain(docs: DataFrame, model: ChainModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, one probability per category) of every row; null and wordless texts get the base rates."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(p[:, j]) for j in range(p.shape[1])]],
                ["doc_id", *[f"p_{c}" for c in shared.value.categories]],
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in model.categories))


def without_category(
    docs: DataFrame, model: ChainModel, category: str, text_column: str = "text"
) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose probability of ``category`` is below its threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, place = model.categories.index(category), docs.columns.index(text_column)
    threshold = model.threshold(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(batch.column(place))
            yield batch.filter(pa.array(p[:, at] < threshold))

    return docs.mapInArrow(run, docs.schema)


def label_categories() -> dict[str, Column]:
    """The categories that the labels table has, in chain order."""
    return {"low_quality": (F.col("quality") == 0).cast("int"), "toxic": (F.col("toxic") == 1).cast("int")}
