"""Spark's boosted trees, fitted over binned rows that are stored once.

A split looks at a feature only through its bins, so rows of equal bins, label
and weight differ in nothing and are one row with a count. Every level of every
tree is one pass over these rows that returns sums per bin; the rows stay where
they are and are brought up to date once a round. Parameters, loss, gains and
the fitted model are those of Spark's own estimator. As there, each row is
drawn by itself: of ``count`` equal ones a binomial number.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import classification
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.operators.ordering import in_order, running_sums
from nomenlink.session import materialise, shared_dir

# Values of all features by which bins are chosen. If there are more, of each
# feature those that this many equal shares of its weight end with.
_VALUES = 100_000
_POINTS = 10_000
# Binned rows of a fit, some megabytes, of which no sums cross parts, as all rounds
# run in one; more rows take a job per level over as many parts as there are
# cores, or as keep each below the second number.
ROWS_PER_PART = 100_000
_ROWS_DEALT = 500_000
# Rounds after which the rows are written and their lineage is cut.
_ROUNDS_PER_FILE = 10
# Sums of more parts than this are added up in two steps.
_PARTS_AT_ONCE = 64
# Gains below this share of a node's squared mean are rounding.
_ROUNDING = 1e-12

_WEIGHT, _RESIDUAL, _ROWS = range(3)


@dataclass(frozen=True)
class Settings:
    rounds: int
    depth: int
    bins: int
    step: float
    min_rows: int
    min_gain: float
    row_share: float
    features_per_node: int
    seed: int
    patience: int | None
    used: tuple[int, ...]
    """Bins of each feature."""


@dataclass(frozen=True)
class Block:
    """The binned rows of one part; ``codes`` has a row per feature."""

    part: int
    codes: np.ndarray
    sign: np.ndarray
    weight: np.ndarray
    count: np.ndarray
    validation: np.ndarray
    margin: np.ndarray | None = None
    residual: np.ndarray | None = None
    drawn: np.ndarray | None = None
    told: np.ndarray | None = None
    """Of the round before: sums of squares per leaf, loss and weight of the validation side."""


@dataclass
class Tree:
    """Nodes by number: 1 is the root, those below ``i`` are ``2 i`` and ``2 i + 1``; a leaf has the feature -1."""

    feature: np.ndarray
    at: np.ndarray
    gain: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    levels: int = 0

    @staticmethod
    def of(depth: int) -> Tree:
        n = 2 ** (depth + 1)
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros((n, 3)), np.zeros(n))

    def values(self) -> np.ndarray:
        """The weighted mean residual of each node."""
        weight = self.sums[:, _WEIGHT]
        return np.divide(self.sums[:, _RESIDUAL], weight, out=np.zeros(len(weight)), where=weight > 0)

    def with_squares(self, of_leaves: np.ndarray) -> Tree:
        squares = of_leaves.copy()
        for i in range(len(squares) - 1, 1, -1):
            squares[i // 2] += squares[i]
        return replace(self, squares=squares)


def best_round(curve: list[float], patience: int) -> tuple[int, bool]:
    """The best round of a curve of losses, from 1, and whether ``patience`` rounds after it brought no better one.

    Rounds are seen in their order: what comes after a stall of that length does not count.
    """
    best = 0
    for i, loss in enumerate(curve):
        if loss < curve[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


# ---------------------------------------------------------------------------
# Bins


def _cuts_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Values between bins: halfway between neighbours, at equal strides of weight if there are too many."""
    values, where = np.unique(values, return_inverse=True)
    weights = np.bincount(where, weights=weights)
    halves = (values[1:] + values[:-1]) / 2
    if len(values) <= bins:
        return halves
    upto, stride = np.cumsum(weights), weights.sum() / bins
    cuts, target = [], stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(halves[i - 1])
            target += stride
    return np.array(cuts[: bins - 1])


def _thinned(seen: DataFrame) -> DataFrame:
    """The values of each feature, those of one small share of its weight as the highest of them."""
    placed = materialise(in_order(seen, "_feature", "_value"), "placed")
    upto = running_sums(placed, {"_upto": "_weight"}, ["_feature"])
    totals = F.broadcast(seen.groupBy("_feature").agg(F.sum("_weight").alias("_total")))
    share = F.floor(F.col("_upto") / F.col("_total") * _POINTS).alias("_share")
    shares = upto.join(totals, "_feature").groupBy("_feature", share)
    return shares.agg(F.sum("_weight").alias("_weight"), F.max("_value").alias("_value"))


def _cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Values between the bins of each feature, from the weights of all its values."""
    each = rows.select("_weight", F.posexplode("_values").alias("_feature", "_value"))
    seen = materialise(each.groupBy("_feature", "_value").agg(F.sum("_weight").alias("_weight")), "values")
    points = _thinned(seen) if seen.count() > _VALUES else seen
    table = points.select("_feature", "_value", "_weight").toArrow()
    feature, value, weight = (c.to_numpy() for c in table.columns)
    if not len(feature):
        raise ValueError("no rows to fit")
    return [_cuts_of(value[feature == i], weight[feature == i], bins) for i in range(width)]


def _binned(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    width = len(cuts)
    for batch in batches:
        n = batch.num_rows
        values = batch.column("_values").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        codes = np.empty((n, width), np.uint8)
        for i, cut in enumerate(cuts):
            codes[:, i] = np.searchsorted(cut, values[:, i], side="left")
        ends = np.arange(0, (n + 1) * width, width, dtype=np.int32)
        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(codes)])
        yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], ["_codes", *batch.schema.names[1:]])


def _block(batches: Iterator[pa.RecordBatch], width: int) -> Block:
    """The rows of a part, in an order that does not depend on how they came."""
    columns = {name: [] for name in ("_codes", "_label", "_weight", "_count", "_validation")}
    for batch in batches:
        for name, parts in columns.items():
            if name == "_codes":
                parts.append(np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(-1, width))
            else:
                parts.append(batch.column(name).to_numpy(zero_copy_only=False))
    if not columns["_codes"]:
        columns = {"_codes": [np.empty((0, width), np.uint8)]} | {name: [np.empty(0)] for name in list(columns)[1:]}
    codes, label, weight, count, validation = (np.concatenate(parts) for parts in columns.values())
    order = np.lexsort((validation, weight, label, *codes.T))
    part = TaskContext.get().partitionId()
    return Block(
        part,
        np.ascontiguousarray(codes[order].T),
        2.0 * label[order].astype(float) - 1,
        weight[order].astype(float),
        count[order].astype(np.int64),
        validation[order].astype(bool),
    )


# ---------------------------------------------------------------------------
# Passes over the rows of a part


def _leaves(codes: np.ndarray, tree: Tree) -> np.ndarray:
    """The node each row has reached."""
    rows = np.arange(codes.shape[1])
    node = np.ones(codes.shape[1], np.int64)
    for _ in range(tree.levels):
        tested = tree.feature[node]
        node = np.where(tested >= 0, 2 * node + (codes[tested, rows] > tree.at[node]), node)
    return node


def _advance(block: Block, tree: Tree | None, factor: float, number: int, settings: Settings) -> Block:
    """The block after ``tree``, with the residuals and the drawn rows of round ``number``."""
    squares = np.zeros(2 ** (settings.depth + 1))
    if tree is None:
        margin, residual = np.zeros(len(block.sign)), block.sign
    else:
        leaf = _leaves(block.codes, tree)
        squares = np.bincount(leaf, block.drawn * block.weight * block.residual**2, minlength=len(squares))
        margin = block.margin + factor * tree.values()[leaf]
        residual = 4 * block.sign / (1 + np.exp(2 * block.sign * margin))
    drawn = np.where(block.validation, 0, block.count)
    if settings.row_share < 1:
        drawn = np.random.default_rng([settings.seed, number, block.part]).binomial(drawn, settings.row_share)
    held = np.where(block.validation, block.count * block.weight, 0)
    loss = 2 * np.logaddexp(0, -2 * block.sign * margin)
    told = np.concatenate([squares, [held @ loss, held.sum()]])
    return replace(block, margin=margin, residual=residual, drawn=drawn, told=told)


def _sums(block: Block, tree: Tree, nodes: np.ndarray, bins: int) -> np.ndarray:
    """Weight, weighted residual and number of the drawn rows, per node, feature and bin."""
    slots = np.full(len(tree.feature), -1)
    slots[nodes] = np.arange(len(nodes))
    slot = slots[_leaves(block.codes, tree)]
    here = np.flatnonzero((slot >= 0) & (block.drawn > 0))
    first = slot[here] * bins
    drawn = block.drawn[here].astype(float)
    weight = drawn * block.weight[here]
    summed = (weight, weight * block.residual[here], drawn)
    sums = np.empty((len(nodes), len(block.codes), bins, 3))
    for i, codes in enumerate(block.codes):
        at = first + codes[here]
        for k, values in enumerate(summed):
            sums[:, i, :, k] = np.bincount(at, values, minlength=len(nodes) * bins).reshape(len(nodes), bins)
    return sums


def _root(block: Block, settings: Settings) -> np.ndarray:
    """What the round before told, then the sums of all rows."""
    return np.concatenate([block.told, _sums(block, Tree.of(settings.depth), np.array([1]), settings.bins).ravel()])


class _Here:
    """All rows in one block."""

    def __init__(self, block: Block, settings: Settings):
        self.block, self.settings = block, settings

    def advance(self, tree: Tree | None, factor: float, number: int) -> np.ndarray:
        self.block = _advance(self.block, tree, factor, number, self.settings)
        return _root(self.block, self.settings)

    def sums(self, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        return _sums(self.block, tree, nodes, self.settings.bins)


class _Spread:
    """Blocks in many parts: a job for every pass, rows that are replaced once a round."""

    def __init__(self, blocks: RDD, settings: Settings):
        self.blocks, self.settings, self.written = blocks, settings, None
        if blocks.context.getCheckpointDir() is None:
            blocks.context.setCheckpointDir(shared_dir(SparkSession.active()))

    def _added(self, pass_) -> np.ndarray:
        parts = self.blocks.getNumPartitions()
        return self.blocks.map(pass_).treeReduce(np.add, depth=1 if parts <= _PARTS_AT_ONCE else 2)

    def advance(self, tree: Tree | None, factor: float, number: int) -> np.ndarray:
        former, settings = self.blocks, self.settings
        step = partial(_advance, tree=tree, factor=factor, number=number, settings=settings)
        self.blocks = former.map(step).persist(StorageLevel.MEMORY_AND_DISK)
        cut = number > 0 and number % _ROUNDS_PER_FILE == 0
        if cut:
            self.blocks.checkpoint()
        added = self._added(partial(_root, settings=settings))
        if number > 0:
            former.unpersist()
        if cut:
            self.forget(self.written)
            self.written = self.blocks.getCheckpointFile()
        return added

    def sums(self, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        return self._added(partial(_sums, tree=tree, nodes=nodes, bins=self.settings.bins))

    def forget(self, written: str | None) -> None:
        if written is not None:
            context = self.blocks.context
            path = context._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.blocks.unpersist()
        self.forget(self.written)


# ---------------------------------------------------------------------------
# Rounds


def _best_splits(sums: np.ndarray, allowed: np.ndarray, settings: Settings) -> Iterator[tuple]:
    """Per node: feature, bin, gain and the sums left and right of the best split; the feature is -1 without one."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    number = np.arange(settings.bins)
    possible = (
        allowed[:, :, None]
        & (number < np.array(settings.used)[:, None] - 1)
        & (np.minimum(left[..., _ROWS], right[..., _ROWS]) >= max(1, settings.min_rows))
    )
    with np.errstate(divide="ignore", invalid="ignore"):
        share, other, all_ = (s[..., _RESIDUAL] ** 2 / s[..., _WEIGHT] for s in (left, right, whole))
        gain = np.where(possible, (share + other - all_) / whole[..., _WEIGHT], -np.inf)
    for i, gains in enumerate(gain):
        f, b = divmod(int(gains.argmax()), settings.bins)
        mean = whole[i, f, 0, _RESIDUAL] / max(whole[i, f, 0, _WEIGHT], 1e-300)
        good = gains[f, b] > _ROUNDING * mean**2 and gains[f, b] >= settings.min_gain
        yield (f if good else -1), b, gains[f, b], left[i, f, b], right[i, f, b]


def _grow(passes: _Here | _Spread, root: np.ndarray, settings: Settings, chosen: np.random.Generator) -> Tree:
    """One tree, level by level; of two nodes below a split only the smaller one is summed up."""
    tree = Tree.of(settings.depth)
    tree.sums[1] = root[0, 0].sum(axis=0)
    width = root.shape[1]
    known = {1: root[0]}
    for level in range(settings.depth):
        nodes = sorted(known)
        allowed = np.zeros((len(nodes), width), bool)
        for mask in allowed:
            mask[chosen.permutation(width)[: settings.features_per_node]] = True
        found = _best_splits(np.stack([known[i] for i in nodes]), allowed, settings)
        split = []
        for i, (feature, at, gain, left, right) in zip(nodes, found):
            if feature >= 0:
                tree.feature[i], tree.at[i], tree.gain[i] = feature, at, gain
                tree.sums[2 * i], tree.sums[2 * i + 1] = left, right
                split.append(i)
        tree.levels = level + 1
        rows = tree.sums[:, _ROWS]
        # Nodes below which nothing can be split need no sums.
        split = [i for i in split if max(rows[2 * i], rows[2 * i + 1]) >= 2 * settings.min_rows]
        if not split or tree.levels == settings.depth:
            break
        smaller = np.array([2 * i + int(rows[2 * i + 1] < rows[2 * i]) for i in split])
        summed = passes.sums(tree, smaller)
        above, known = known, {}
        for i, small, sums in zip(split, smaller.tolist(), summed):
            rest = above[i] - sums
            rest[rest[..., _ROWS] < 0.5] = 0
            known |= {small: sums, small ^ 1: rest}
        known = {i: sums for i, sums in known.items() if rows[i] >= 2 * settings.min_rows}
    return tree


def _boost(passes: _Here | _Spread, width: int, settings: Settings) -> tuple[list[Tree], list[float]]:
    """The trees and the loss on the validation side after each.

    With a patience the curve is looked at once, after twice as many rounds; a
    curve that has stalled by then ends the fit, else all rounds are fitted.
    """
    trees: list[Tree] = []
    curve: list[float] = []
    nodes = 2 ** (settings.depth + 1)
    for number in range(settings.rounds + 1):
        factor = 1.0 if number == 1 else settings.step
        told = passes.advance(trees[-1] if trees else None, factor, number)
        squares, (loss, weight), root = told[:nodes], told[nodes : nodes + 2], told[nodes + 2 :]
        if trees:
            trees[-1] = trees[-1].with_squares(squares)
            if weight > 0:
                curve.append(float(loss / weight))
        if settings.patience is not None and number == 2 * settings.patience and best_round(curve, settings.patience)[1]:
            break
        if number < settings.rounds:
            chosen = np.random.default_rng([settings.seed, number])
            trees.append(_grow(passes, root.reshape(1, width, settings.bins, 3), settings, chosen))
    return trees, curve


def _boost_here(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    width = len(settings.used)
    fitted = _boost(_Here(_block(batches, width), settings), width, settings)
    yield pa.RecordBatch.from_pydict({"packed": [pickle.dumps(fitted)]})


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"packed": [pickle.dumps(_block(batches, width))]})


def _unpack(row) -> Block:
    return pickle.loads(row["packed"])


# ---------------------------------------------------------------------------
# The estimator


def _features_per_node(strategy: str, width: int) -> int:
    named = {
        "auto": width,
        "all": width,
        "sqrt": math.ceil(math.sqrt(width)),
        "log2": max(1, math.ceil(math.log2(width))),
        "onethird": math.ceil(width / 3),
    }
    if strategy in named:
        return named[strategy]
    return min(width, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * width)


@dataclass
class _Java:
    """Makes Spark's trees; the classes are looked up once."""

    jvm: object
    gateway: object
    cuts: list[np.ndarray]
    made: dict = field(default_factory=dict)

    def tree(self, tree: Tree, width: int):
        ml = self.jvm.org.apache.spark.ml
        if not self.made:
            self.made = {
                "sums": self.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator,
                "leaf": ml.tree.LeafNode,
                "inner": ml.tree.InternalNode,
                "split": ml.tree.ContinuousSplit,
                "tree": ml.regression.DecisionTreeRegressionModel,
                "slice": self.jvm.java.util.Arrays.copyOfRange,
            }
        table = np.column_stack([tree.sums[:, _WEIGHT], tree.sums[:, _RESIDUAL], tree.squares])
        flat = self.gateway.new_array(self.jvm.double, table.size)
        self.jvm.java.nio.ByteBuffer.wrap(table.astype(">f8").tobytes()).asDoubleBuffer().get(flat)
        value = tree.values()
        weight = np.maximum(table[:, 0], 1e-300)
        impurity = np.maximum(table[:, 2] / weight - value**2, 0)

        def node(i: int):
            sums = self.made["sums"](self.made["slice"](flat, 3 * i, 3 * i + 3), int(tree.sums[i, _ROWS]))
            if tree.feature[i] < 0:
                return self.made["leaf"](float(value[i]), float(impurity[i]), sums)
            f = int(tree.feature[i])
            split = self.made["split"](f, float(self.cuts[f][tree.at[i]]))
            below = node(2 * i), node(2 * i + 1)
            return self.made["inner"](float(value[i]), float(impurity[i]), float(tree.gain[i]), *below, split, sums)

        return self.made["tree"](f"dtr_{uuid.uuid4().hex[:12]}", node(1), width)


class GBTClassifier(classification.GBTClassifier):
    """Spark's estimator with the rounds of this module.

    Rows marked in ``validationIndicatorCol`` are not fitted; the model's
    ``curve`` has their loss after each round. ``patience`` ends a fit whose
    curve has stalled within twice as many rounds.
    """

    def __init__(self, patience: int | None = None, **params):
        super().__init__(**params)
        self.patience = patience

    def _settings(self, cuts: list[np.ndarray]) -> Settings:
        return Settings(
            rounds=self.getMaxIter(),
            depth=self.getMaxDepth(),
            bins=max(len(cut) for cut in cuts) + 1,
            step=self.getStepSize(),
            min_rows=self.getMinInstancesPerNode(),
            min_gain=self.getMinInfoGain(),
            row_share=self.getSubsamplingRate(),
            features_per_node=_features_per_node(self.getFeatureSubsetStrategy(), len(cuts)),
            seed=self.getSeed() % 2**63,
            patience=self.patience,
            used=tuple(len(cut) + 1 for cut in cuts),
        )

    def _rows(self, dataset: DataFrame) -> DataFrame:
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        held = F.col(self.getValidationIndicatorCol()) if self.isDefined(self.validationIndicatorCol) else F.lit(False)
        return dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("_values"),
            F.col(self.getLabelCol()).cast("double").alias("_label"),
            weight.alias("_weight"),
            held.alias("_validation"),
        )

    def _width(self, dataset: DataFrame) -> int:
        """The number of features, as the assembler notes it or else as the first row has it."""
        noted = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("num_attrs")
        return noted or len(dataset.select(vector_to_array(self.getFeaturesCol())).first()[0])

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        spark = dataset.sparkSession
        rows = self._rows(dataset)
        fitted = rows.where(~F.col("_validation"))
        width = self._width(dataset)
        cuts = _cuts(fitted, width, self.getMaxBins())
        settings = self._settings(cuts)
        keys = {"_codes": "binary", "_label": "double", "_weight": "double", "_validation": "boolean"}
        binned = rows.mapInArrow(partial(_binned, cuts=cuts), ", ".join(f"{k} {kind}" for k, kind in keys.items()))
        distinct = materialise(binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count")), "binned")
        n = distinct.count()
        if n <= ROWS_PER_PART:
            here = distinct.repartition(1).mapInArrow(partial(_boost_here, settings=settings), "packed binary")
            trees, curve = pickle.loads(here.first()["packed"])
        else:
            parts = max(spark.sparkContext.defaultParallelism, -(-n // _ROWS_DEALT))
            packed = distinct.repartition(parts, *keys).mapInArrow(partial(_pack, width=width), "packed binary")
            passes = _Spread(materialise(packed, "blocks").rdd.map(_unpack), settings)
            try:
                trees, curve = _boost(passes, width, settings)
            finally:
                passes.close()
        return self._model(spark, trees, curve, cuts, width)

    def _model(self, spark, trees, curve, cuts, width: int) -> GBTClassificationModel:
        # Spark's constructors of nodes and models; Python has no call for them.
        gateway = spark.sparkContext._gateway
        ml = gateway.jvm.org.apache.spark.ml
        java = _Java(gateway.jvm, gateway, cuts)
        kept = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
        weights = gateway.new_array(gateway.jvm.double, len(trees))
        for i, tree in enumerate(trees):
            kept[i], weights[i] = java.tree(tree, width), 1.0 if i == 0 else self.getStepSize()
        made = ml.classification.GBTClassificationModel(self.uid, kept, weights, width, 2)
        model = self._copyValues(GBTClassificationModel(made))
        model.curve = curve
        return model
