"""Leaf-wise gradient boosting for regression over binned features (squared error).

1. every feature gets at most ``max_bins`` bins by exact quantiles, and a bin of its
   own for null and NaN; bins, label, row hash and the prediction so far are written
   once to the shared folder, a byte per feature and ``_BLOCK`` rows in one stored row,
   so that a pass hands blocks to its tasks and not row after row;
2. a pass adds up, per open leaf, feature and bin, the rows and their residuals: a
   dense histogram in each task, then one hash aggregate.  Only the smaller child of
   a split is counted, the other one is the parent less it;
3. the leaf with the highest gain is split next, until ``num_leaves`` are reached.
   A leaf's best split depends on its own rows alone, so one pass counts the
   children of all leaves that may still be split: a tree takes about ``max_depth``
   passes, not one per split, and is the same tree;
4. every ``refresh`` trees the table is written anew with the new predictions, so a
   pass walks a bounded number of trees.

Residuals are added as fixed-point integers: a sum does not depend on the order or
the partitioning, so a rerun after a lost executor, or with other partitions, grows
the same trees.  The driver holds trees, bin edges and the histograms of one tree's
open leaves (leaves x features x bins); what it collects does not grow with the rows.

Rows whose label is null or NaN take no part.  Rows that share ``key`` are sampled
together; a null key is a key.  Without rows the model predicts 0.
"""

from __future__ import annotations

import heapq
import json
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.quantiles import exact_quantiles
from shelfspark.session import delete_path, shared_dir

# Functions of this module run in Python workers, which may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MISSING = 255  # the bin of null and NaN
WIDTH = MISSING + 1
_ROWS = 1 << 14  # rows a histogram step adds at once: their fixed-point sums are exact in a double
_BLOCK = 128  # rows of a stored row; a reader's batch of 4096 such rows stays below 20 MB


@dataclass(frozen=True)
class BoostParams:
    """``subsample`` of the rows and ``colsample`` of the features are drawn anew for each tree."""

    rounds: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = 6
    min_child: int = 20
    subsample: float = 0.8
    colsample: float = 0.8
    l1: float = 0.1
    l2: float = 0.1
    max_bins: int = 64
    patience: int = 10
    refresh: int = 8
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.max_bins <= MISSING:
            raise ValueError(f"max_bins must be between 2 and {MISSING}")
        if self.num_leaves < 2 or self.max_depth < 1 or self.min_child < 1 or self.refresh < 1:
            raise ValueError("num_leaves must be 2 or more, max_depth, min_child and refresh 1 or more")
        if not (0 < self.subsample <= 1 and 0 < self.colsample <= 1):
            raise ValueError("subsample and colsample must be in (0, 1]")


@dataclass
class Tree:
    """Nodes by number, 0 is the root; ``left`` is -1 at a leaf.  Bins up to ``bin`` go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float = 0.0, rows: int = 0) -> int:
        for column, x in ((self.feature, 0), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1),
                          (self.value, value), (self.gain, 0.0), (self.rows, rows)):
            column.append(x)
        return len(self.left) - 1

    @property
    def leaves(self) -> int:
        return sum(x < 0 for x in self.left)


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node in which each row of ``bins`` (rows x features) ends."""
    feature, cut, left, right = (np.asarray(x, np.int64) for x in (tree.feature, tree.bin, tree.left, tree.right))
    depth = np.zeros(len(left), np.int64)
    for node in np.flatnonzero(left >= 0).tolist():  # children come after their parents
        depth[[left[node], right[node]]] = depth[node] + 1
    goes_left = np.arange(WIDTH) <= cut[:, None]
    goes_left[:, MISSING] = tree.missing_left
    following = np.where(goes_left, left[:, None], right[:, None])  # the next node by node and bin
    stays = left < 0
    following[stays] = np.flatnonzero(stays)[:, None]
    flat, following = np.ascontiguousarray(bins).ravel(), following.ravel()
    first, at = np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
    for _ in range(depth.max()):
        at = following[at * WIDTH + flat[first + feature[at]]]
    return at


def bins_of(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers of raw values (rows x features): how many edges lie below, ``MISSING`` for NaN."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(np.asarray(e, float), x[:, f], side="left"))
    return out


def drawn_rows(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows tree number ``tree`` sees: by the row's hash, whatever the partitioning."""
    z = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 < share


def drawn_features(count: int, seed: int, tree: int, share: float) -> list[int]:
    """Which features tree number ``tree`` may split on."""
    order = np.random.default_rng([seed, tree]).permutation(count)
    return sorted(order[:max(1, math.ceil(share * count))].tolist())


@dataclass
class BoostedModel:
    features: list[str]
    edges: list[list[float]]
    base: float
    params: BoostParams
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)  # mean squared error of the validation rows after each tree

    def predict_bins(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        out = np.full(len(bins), self.base) if start is None else start.copy()
        for t in self.trees[first:]:
            out += np.asarray(t.value)[leaf_of(t, bins)]
        return out

    def importance(self) -> dict[str, tuple[int, float]]:
        """feature -> (number of splits, their summed gain)."""
        found = {f: [0, 0.0] for f in self.features}
        for t in self.trees:
            for f, left, gain in zip(t.feature, t.left, t.gain):
                if left >= 0:
                    found[self.features[f]][0] += 1
                    found[self.features[f]][1] += gain
        return {f: (n, g) for f, (n, g) in found.items()}

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "params": self.params.__dict__, "trees": [t.__dict__ for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> BoostedModel:
        d = json.loads(text)
        return cls(**{**d, "params": BoostParams(**d["params"]), "trees": [Tree(**t) for t in d["trees"]]})

    def save(self, spark: SparkSession, path: str) -> str:
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("errorifexists").text(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])


def boosted_prediction(model: BoostedModel) -> Column:
    """The model's prediction from its feature columns (a vectorised function; the model goes with the tasks)."""
    @F.pandas_udf("double")
    def predict(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict_bins(bins_of(x.to_numpy(dtype=float, na_value=np.nan), model.edges)))
    return predict(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))


# ---------------------------------------------------------------- fitting


def feature_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """At most ``max_bins - 1`` rising edges per feature; a value up to an edge lies in or below its bin."""
    clean = df.select(*[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features])
    levels = [i / max_bins for i in range(1, max_bins)]
    found = {r["column"]: r["quantiles"] for r in exact_quantiles(clean, features, levels).collect()}  # a row per feature
    return [sorted(set(found.get(f, []))) for f in features]


@dataclass(frozen=True)
class _Scale:
    """Fixed-point units of residuals and squared errors: sums of all rows fit a long, of a step a double."""

    bound: float
    unit: float
    error_unit: float

    @classmethod
    def of(cls, rows: int, spread: float) -> _Scale:
        bound = max(4 * spread, 1e-9)  # boosted predictions stay well within
        def unit(most: float) -> float:
            top = math.ceil(math.log2(most))
            return 2.0 ** min(38 - top, 62 - top - math.ceil(math.log2(max(rows, 2))))
        return cls(bound, unit(bound), unit(bound * bound))


def _flat(blocks: pa.Array, kind: type) -> np.ndarray:
    """The values of the rows of blocks that follow each other, without a copy."""
    if not len(blocks):
        return np.empty(0, kind)
    ends = np.frombuffer(blocks.buffers()[1], np.int64 if pa.types.is_large_binary(blocks.type) else np.int32)
    lo, hi = int(ends[blocks.offset]), int(ends[blocks.offset + len(blocks)])
    return np.frombuffer(blocks.buffers()[2], np.uint8, hi - lo, lo).view(kind)


def _blocks_of(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The rows of ``values`` between the ``cuts`` as binary values."""
    values = np.ascontiguousarray(values)
    ends = (cuts * (values.nbytes // len(values))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _start(batch: pa.RecordBatch, model: BoostedModel, rows: int) -> np.ndarray:
    """The stored predictions, the model's base where there are none yet."""
    return np.full(rows, model.base) if batch["prediction"].null_count else _flat(batch["prediction"], np.float64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS // _BLOCK):
            yield batch.slice(at, _ROWS // _BLOCK)


def _histograms(data: DataFrame, model: BoostedModel, done: int, tree: Tree, targets: list[int], scale: _Scale,
                number: int, with_error: bool, drawn: list[int]) -> tuple[dict[int, np.ndarray], int]:
    """Per target leaf (feature, bin, [rows, residual sum]), of the drawn features, and the validation rows' summed squared error.

    ``done`` trees are part of the stored prediction already.
    """
    width, p, k = len(model.features), model.params, len(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(tree.left), -1)
        slot[targets] = np.arange(len(targets))
        rows = np.zeros(len(targets) * k * WIDTH, np.int64)
        sums, error = np.zeros_like(rows), 0
        for batch in _pieces(batches):
            bins, y, held = _flat(batch["bins"], np.uint8).reshape(-1, width), _flat(batch["label"], np.float64), _flat(batch["held"], np.bool_)
            so_far = _start(batch, model, len(y))

            def residual(at: np.ndarray) -> np.ndarray:
                return y[at] - model.predict_bins(bins[at], so_far[at], done)

            if with_error and held.any():
                error += int(np.rint(np.minimum(residual(held) ** 2, scale.bound**2) * scale.error_unit).astype(np.int64).sum())
            seen = np.flatnonzero(~held & drawn_rows(_flat(batch["key"], np.int64), p.seed, number, p.subsample))
            at = slot[leaf_of(tree, bins[seen])]
            seen, at = seen[at >= 0], at[at >= 0]  # only rows of the leaves asked for walk the trees so far
            cell = ((at[:, None] * k + np.arange(k)) * WIDTH + bins[seen][:, drawn]).ravel()
            g = np.rint(np.clip(residual(seen), -scale.bound, scale.bound) * scale.unit)
            rows += np.bincount(cell, minlength=len(rows))
            sums += np.bincount(cell, np.repeat(g, k), minlength=len(rows)).astype(np.int64)
        cells = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(cells, -1), pa.int64()), pa.array(np.append(rows[cells], 0), pa.int64()),
             pa.array(np.append(sums[cells], error), pa.int64())], ["cell", "n", "g"])

    found = data.mapInArrow(count, "cell long, n long, g long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    got = found.toPandas()  # at most leaves x features x bins rows
    counted, out = np.zeros((len(targets) * k * WIDTH, 2), np.int64), np.zeros((len(targets), width, WIDTH, 2), np.int64)
    own = got["cell"] >= 0
    counted[got["cell"][own]] = got.loc[own, ["n", "g"]].to_numpy()
    out[:, drawn] = counted.reshape(len(targets), k, WIDTH, 2)
    return dict(zip(targets, out)), int(got.loc[~own, "g"].sum())


@dataclass(order=True)
class _Leaf:
    """A node that may be split; the queue takes the highest gain, then the leftmost shallowest path."""

    loss: float  # minus the gain
    path: tuple[int, ...]
    node: int = field(compare=False)
    cut: tuple = field(compare=False)  # feature, bin, missing_left, (rows, sum) left, (rows, sum) right
    histogram: np.ndarray = field(compare=False)


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(rows: int, total: int, unit: float, p: BoostParams) -> float:
    return float(p.learning_rate * _shrunk(total / unit, p.l1) / (rows + p.l2)) if rows else 0.0


def _best_cut(node: int, path: tuple[int, ...], h: np.ndarray, features: list[int], unit: float, p: BoostParams) -> _Leaf | None:
    """The cut of highest gain; ties go to the smaller feature, the smaller bin, missing values right."""
    own = h[features]
    below = np.cumsum(own[:, :MISSING], axis=1)
    left = np.stack([below, below + own[:, MISSING:]], axis=2)  # features x bins x missing right or left x [rows, sum]
    whole = own[0].sum(axis=0)
    right = whole - left

    def score(x: np.ndarray) -> np.ndarray:
        return _shrunk(x[..., 1] / unit, p.l1) ** 2 / np.maximum(x[..., 0] + p.l2, 1e-300)

    allowed = (left[..., 0] >= p.min_child) & (right[..., 0] >= p.min_child)
    gain = np.where(allowed, score(left) + score(right) - score(whole), -np.inf)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[at] > 1e-12:
        return None
    cut = (features[at[0]], int(at[1]), bool(at[2]), tuple(left[at].tolist()), tuple(right[at].tolist()))
    return _Leaf(-float(gain[at]), path, node, cut, h)


def _grow(count, root: np.ndarray, features: list[int], unit: float, p: BoostParams) -> Tree | None:
    """One tree; ``count(tree, leaves)`` gives the histograms of leaves.  None without a cut at the root."""
    grown = Tree()  # every node whose histogram may be asked for
    grown.add()
    first = _best_cut(0, (), root, features, unit, p)
    if first is None:
        return None
    kids: dict[int, list[_Leaf]] = {}  # of cut nodes: the children that can be cut again
    while True:
        queue, chosen = [first], []
        while queue and len(chosen) < p.num_leaves - 1:
            if queue[0].node not in kids and len(chosen) < p.num_leaves - 2:
                break
            leaf = heapq.heappop(queue)
            chosen.append(leaf)
            for kid in kids.get(leaf.node, ()):
                heapq.heappush(queue, kid)
        else:
            return _kept(chosen, unit, p)
        ask = []
        for leaf in heapq.nsmallest(p.num_leaves - 1 - len(chosen), queue):
            if leaf.node in kids:
                continue
            f, b, missing_left, (nl, _), (nr, _) = leaf.cut
            l, r = grown.add(), grown.add()
            for column, x in ((grown.feature, f), (grown.bin, b), (grown.missing_left, missing_left), (grown.left, l), (grown.right, r)):
                column[leaf.node] = x
            kids[leaf.node] = []
            if len(leaf.path) + 1 < p.max_depth:
                ask.append((leaf, l, r, nl <= nr))
        if ask:
            got = count(grown, [l if small else r for _, l, r, small in ask])
            for leaf, l, r, small in ask:
                one = got[l if small else r]
                other = leaf.histogram - one
                for side, (node, h) in enumerate(((l, one if small else other), (r, other if small else one))):
                    cut = _best_cut(node, (*leaf.path, side), h, features, unit, p)
                    if cut is not None:
                        kids[leaf.node].append(cut)


def _kept(chosen: list[_Leaf], unit: float, p: BoostParams) -> Tree:
    """The tree of the chosen cuts alone."""
    tree, at = Tree(), {}
    at[()] = tree.add(rows=sum(chosen[0].cut[i][0] for i in (3, 4)))
    for leaf in chosen:
        node = at[leaf.path]
        f, b, missing_left, left, right = leaf.cut
        tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = f, b, missing_left, -leaf.loss
        tree.value[node] = 0.0
        for side, (n, g), column in ((0, left, tree.left), (1, right, tree.right)):
            column[node] = at[(*leaf.path, side)] = tree.add(leaf_value(n, g, unit, p), n)
    return tree


def _binned(df: DataFrame, features: Sequence[str], edges: list[list[float]], label: str, key: str, held: Column) -> DataFrame:
    """A row's bins, label, hash and whether it is held back."""
    width = len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
                each = np.arange(batch.num_rows + 1)
                yield pa.RecordBatch.from_arrays([_blocks_of(bins_of(x, edges), each), *batch.columns[width:]],
                                                 ["bins", "label", "key", "held"])

    raw = df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("label"),
                    F.xxhash64(F.col(key).cast("string")).alias("key"), held.alias("held"))
    return raw.mapInArrow(pack, "bins binary, label double, key long, held boolean")


_TABLE = "bins binary, label binary, key binary, held binary, n long, m long, lo double, hi double, s decimal(38,12)"


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Binned rows, ``_BLOCK`` to a stored row, with the numbers of rows to fit and held back, the labels' range and sum."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.arange(0, batch.num_rows, _BLOCK)
            cuts = np.append(starts, batch.num_rows)
            y, held = batch["label"].to_numpy(zero_copy_only=False), batch["held"].to_numpy(zero_copy_only=False).astype(np.bool_)
            key = batch["key"].to_numpy(zero_copy_only=False)
            m = np.add.reduceat(held.astype(np.int64), starts)
            total = [Decimal(0)] * len(starts)
            with localcontext(prec=76):
                for x, times in zip(*(v.tolist() for v in np.unique(y[~held], return_counts=True))):
                    if abs(x) < 1e25:  # as decimal(38,12)
                        total[0] += Decimal(repr(x)).quantize(Decimal("1e-12"), ROUND_HALF_UP) * times
            yield pa.RecordBatch.from_arrays(
                [_blocks_of(_flat(batch["bins"], np.uint8).reshape(batch.num_rows, -1), cuts), _blocks_of(y, cuts), _blocks_of(key, cuts),
                 _blocks_of(held, cuts), pa.array(np.diff(cuts) - m), pa.array(m), pa.array(np.minimum.reduceat(y, starts)),
                 pa.array(np.maximum.reduceat(y, starts)), pa.array(total, pa.decimal128(38, 12))],
                ["bins", "label", "key", "held", "n", "m", "lo", "hi", "s"])

    return rows.mapInArrow(block, _TABLE)


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, key: str, validation: str | None = None,
                **params) -> BoostedModel:
    """Boosted trees on the rows that are not for ``validation`` (a boolean column; null is false).

    With validation rows, fitting stops once their error has not fallen for
    ``patience`` trees, and the trees up to the lowest error stay.
    """
    p = BoostParams(**params)
    spark, features = df.sparkSession, list(features)
    y = F.col(label).cast("double")
    df = df.where(y.isNotNull() & ~F.isnan(y))
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    edges = feature_edges(df.where(~held), features, p.max_bins)
    tables = [shared_dir(spark, "boosting", "rows", unique=True)]

    def written(rows: DataFrame, path: str) -> DataFrame:
        rows.write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)

    # dealt by key: every pass reads this table, so its tasks must not be as few as the files of the input
    data = written(_in_blocks(_binned(df, features, edges, label, key, held).repartition("key")), tables[0])
    stats = data.agg(*[F.sum(c).alias(c) for c in ("n", "m", "s")], F.min("lo").alias("lo"), F.max("hi").alias("hi")).first().asDict()
    stats = {c: x or 0 for c, x in stats.items()}
    model = BoostedModel(features, edges, float(stats["s"] / stats["n"]) if stats["n"] else 0.0, p)
    scale = _Scale.of(max(stats["n"], stats["m"], 1), float(stats["hi"] - stats["lo"]))
    rows, done, root = data.select("bins", "label", "key", "held", F.lit(None).cast("binary").alias("prediction")), 0, Tree()
    root.add()
    best = 0  # trees at the lowest error
    while stats["n"]:
        number = len(model.trees)
        if number - done >= p.refresh:
            tables.append(shared_dir(spark, "boosting", "rows", unique=True))
            rows, done = written(_with_predictions(rows, model, done), tables[-1]), number
            delete_path(spark, tables.pop(0))
        drawn = drawn_features(len(features), p.seed, number, p.colsample)
        found, error = _histograms(rows, model, done, root, [0], scale, number, bool(stats["m"]), drawn)
        if number and stats["m"]:
            model.errors.append(error / scale.error_unit / stats["m"])
            if model.errors[-1] < model.errors[best - 1] or best == 0:
                best = number
            if number - best >= p.patience:
                break
        if number == p.rounds:
            break
        tree = _grow(lambda t, leaves: _histograms(rows, model, done, t, leaves, scale, number, False, drawn)[0],
                     found[0], drawn, scale.unit, p)
        if tree is None:
            break
        model.trees.append(tree)
    if stats["m"]:
        model.trees = model.trees[:best]
    for path in tables:
        delete_path(spark, path)
    return model


def _with_predictions(rows: DataFrame, model: BoostedModel, done: int) -> DataFrame:
    """The stored rows with the prediction of all trees so far."""
    width = len(model.features)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            bins = _flat(batch["bins"], np.uint8).reshape(-1, width)
            new = model.predict_bins(bins, _start(batch, model, len(bins)), done)
            cuts = np.append(0, np.cumsum(pc.binary_length(batch["held"]).to_numpy()))
            yield batch.set_column(batch.schema.get_field_index("prediction"), "prediction", _blocks_of(new, cuts))

    return rows.mapInArrow(add, rows.schema)
