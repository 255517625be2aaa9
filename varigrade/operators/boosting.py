"""Boosted trees for several classes: every setting and every fold of a comparison is fitted by the same passes.

Features are binned once and kept as blocks of rows beside each row's scores. A tree level of a round is one pass over the
blocks: a task adds up, by (setting, fold, node, bin of a column), the gradient of every class and the curvature, and the
sums of all tasks meet in one table whose size depends on bins and nodes, never on rows. Only the lighter child of a split
is summed; its sibling is the parent minus it. The driver picks the splits from the sums.

A tree has a leaf value for each class (softmax over the classes). Tasks need no state: a block holds the scores of the last
kept round, and the trees since then are applied again in each pass, unless the worker remembers the block's later scores. Every ``KEEP`` rounds the scores are brought up to
date, every ``CHECKPOINT`` rounds they are written to the checkpoint folder, which cuts the lineage and lets a lost executor's
blocks be made again from there.

Per-partition state and some hundred dependent passes are why this module works on a cached RDD of blocks: a pass with a
shuffled DataFrame aggregate takes about five times as long before the first row is read.

A fit on few rows (up to ``ALONE``, all of them or a bounded sample) needs no passes: their blocks are broadcast, their size
being known, and every (setting, fold) grows in a task of its own, by the same code.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varigrade.session import ensure_checkpoint_dir, materialize

BLOCK = 4096
KEEP, CHECKPOINT = 10, 20
#: Bins of a number; levels of a category that get a bin of their own (the most frequent ones, the others share one).
BINS, LEVELS = 32, 1000
#: Up to this many tasks hand their sums to the driver directly; more are added up in between.
DIRECT = 32
#: Up to this many rows are fitted with one task per (setting, fold); a row takes two bytes a column.
ALONE = 50_000


@dataclass(frozen=True)
class Setting:
    """One way of boosting: ``rounds`` trees of ``depth`` levels, leaf values times ``step``."""

    name: str
    rounds: int = 100
    depth: int = 5
    step: float = 0.1
    l2: float = 1.0
    min_curvature: float = 0.1


#: The settings that are compared with each other.
SETTINGS = (Setting("boosted_stumps", depth=1, step=0.5), Setting("boosted_depth3", depth=3), Setting("boosted_depth5"),
            Setting("boosted_slow", step=0.05))


# --- bins --------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bins:
    """Where a column's values fall: bin 0 is missing; a number has bins by edges, a category one per level."""

    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    arrays: tuple[tuple[str, int], ...]
    edges: tuple[np.ndarray, ...] = ()
    levels: tuple[tuple[str, ...], ...] = ()
    #: first bin of each column in the joint numbering, and their total
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total: int = 0

    def select(self, df: DataFrame, *more) -> DataFrame:
        """The columns in bin order: numbers, array elements, categories; then ``more``."""
        elements = [F.get(F.col(c), F.lit(i)).cast("double").alias(f"{c}_{i}") for c, n in self.arrays for i in range(n)]
        return df.select(*[F.col(c).cast("double").alias(c) for c in self.numbers], *elements,
                         *[F.col(c).cast("string").alias(c) for c in self.categories], *more)

    @property
    def n_numbers(self) -> int:
        return len(self.numbers) + sum(n for _, n in self.arrays)

    @property
    def width(self) -> int:
        return self.n_numbers + len(self.categories)

    def encode(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """rows x columns of bins."""
        out = np.zeros((len(columns[0]) if columns else 0, self.width), np.uint16)
        for j, edges in enumerate(self.edges):
            values = columns[j].to_numpy(zero_copy_only=False).astype(np.float64)
            out[:, j] = np.where(np.isnan(values), 0, np.searchsorted(edges, values) + 1)
        for j, levels in enumerate(self.levels, self.n_numbers):
            known = pc.index_in(columns[j], value_set=pa.array(levels, pa.string()))
            place = known.fill_null(len(levels)).to_numpy(zero_copy_only=False) + 1
            out[:, j] = np.where(np.asarray(columns[j].is_null()), 0, place)
        return out


def fit_bins(df: DataFrame, drop: Iterable[str], bins: int = BINS, levels: int = LEVELS) -> Bins:
    """Bins of all columns of ``df`` but ``drop``: quantiles of numbers, most frequent levels of text columns.

    Quantiles come from Spark's sketch. A column has at most ``bins`` or ``levels`` + 2 bins, which bounds every table the
    driver sees.
    """
    fields = [f for f in df.schema.fields if f.name not in set(drop)]
    numbers = tuple(f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)))
    categories = tuple(f.name for f in fields if isinstance(f.dataType, T.StringType))
    lists = [f.name for f in fields if isinstance(f.dataType, T.ArrayType)]
    sizes = df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in lists]).first() if lists else {}
    shape = Bins(numbers, categories, tuple((c, max(0, sizes[c])) for c in lists))
    flat = shape.select(df)
    named = flat.columns[: shape.n_numbers]
    found = flat.approxQuantile(named, [k / bins for k in range(1, bins)], 0.1 / bins) if named else []
    edges = tuple(np.unique(np.array(q, np.float64)) for q in found)
    common = []
    for c in categories:
        counts = flat.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(levels)
        common.append(tuple(sorted(r[0] for r in counts.collect())))
    sizes_of = np.array([len(e) + 2 for e in edges] + [len(v) + 2 for v in common], np.int64)
    return Bins(numbers, categories, shape.arrays, edges, tuple(common), np.cumsum(sizes_of) - sizes_of, int(sizes_of.sum()))


# --- trees -------------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of i are 2i and 2i + 1.

    A row goes left if its bin in ``column`` is one of ``low`` to ``low + span``, and on to ``child`` or the node after it. A
    leaf is its own child and sends every row left.
    """

    column: np.ndarray
    low: np.ndarray
    span: np.ndarray
    child: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, classes: int) -> "Tree":
        n = 2 << depth
        return cls(np.zeros(n, np.int64), np.zeros(n, np.uint16), np.full(n, 65535, np.uint16), np.arange(n),
                   np.zeros((n, classes), np.float32))

    @property
    def depth(self) -> int:
        return len(self.column).bit_length() - 2

    def split(self, node: int, column: int, at: int, equal: bool) -> None:
        self.column[node], self.child[node] = column, 2 * node
        self.low[node], self.span[node] = (at, 0) if equal else (0, at)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` levels."""
        flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        node = np.ones(len(bins), np.int64)
        for _ in range(levels):
            value = flat.take(first + self.column.take(node))
            node = self.child.take(node) + ((value - self.low.take(node)) > self.span.take(node))  # wraps below low
        return node

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        return self.value.take(self.nodes(bins, self.depth), axis=0)


def softmax(scores: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return out / out.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Best:
    """Best split of each node of a level."""

    gain: np.ndarray
    place: np.ndarray
    left: np.ndarray
    right: np.ndarray


def best_splits(sums: np.ndarray, bins: Bins, setting: Setting) -> Best:
    """``sums``: nodes x bins x (gradient of each class, curvature). Equal gains: the first bin."""
    numeric = np.zeros(bins.total, bool)
    column = np.repeat(np.arange(bins.width), np.diff(np.append(bins.starts, bins.total)))
    numeric[column < bins.n_numbers] = True
    upto = np.cumsum(sums, axis=1)
    before = np.concatenate([np.zeros_like(upto[:, :1]), upto], axis=1)[:, bins.starts]
    left = np.where(numeric[None, :, None], upto - before[:, column], sums)
    whole = sums[:, : bins.starts[1] if bins.width > 1 else bins.total].sum(axis=1)
    right = whole[:, None] - left

    def score(part: np.ndarray) -> np.ndarray:
        return (part[..., :-1] ** 2).sum(axis=-1) / (np.maximum(part[..., -1], 0) + setting.l2)

    gain = score(left) + score(right) - score(whole)[:, None]
    gain[np.minimum(left[..., -1], right[..., -1]) < setting.min_curvature] = -np.inf
    place = gain.argmax(axis=1)
    row = np.arange(len(sums))
    return Best(gain[row, place], place, left[row, place], right[row, place])


# --- passes ------------------------------------------------------------------------------------------------------

#: Scores a worker has made, by block: (number of rounds applied, scores). A missing entry is made again from the block.
_made: OrderedDict[str, tuple[int, np.ndarray]] = OrderedDict()
_MADE_BYTES = 64 << 20


@dataclass
class Block:
    """Some rows: bins, class, weight, fold, and the scores of every fit after ``rounds`` rounds."""

    name: str
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    rounds: int
    scores: np.ndarray

    def advanced(self, since: list[list[Tree | None]]) -> np.ndarray:
        """The scores after some more rounds of trees, starting from what this worker remembers of the block."""
        rounds, scores = _made.pop(self.name, (self.rounds, self.scores))
        if not self.rounds <= rounds <= self.rounds + len(since):
            rounds, scores = self.rounds, self.scores
        if rounds < self.rounds + len(since):
            scores = scores.copy()
            for trees in since[rounds - self.rounds:]:
                for fit, tree in enumerate(trees):
                    if tree is not None:
                        scores[:, fit] += tree.leaves(self.bins)
        _made[self.name] = (self.rounds + len(since), scores)
        while len(_made) > 1 and sum(x.nbytes for _, x in _made.values()) > _MADE_BYTES:
            _made.popitem(last=False)
        return scores


def level_sums(blocks: Iterable[Block], bins: Bins, folds: int, rounds: list[list[Tree | None]], growing: list[Tree | None],
               slots: list[np.ndarray], level: int) -> np.ndarray:
    """The sums of one task: (all slots of all fits) x bins x (classes + 1).

    ``growing`` are the trees of this round so far, ``slots[fit][node]`` says where the sums of a node go (-1: nowhere).
    """
    firsts = np.cumsum([0] + [int(s.max(initial=-1)) + 1 for s in slots])
    out: np.ndarray | None = None
    for block in blocks:
        classes = block.scores.shape[2]
        if out is None:
            out = np.zeros((classes + 1, int(firsts[-1]) * bins.total))
        scores, joint = block.advanced(rounds), block.bins + bins.starts.astype(np.int64)
        hot = np.eye(classes)[block.label]
        for fold in range(folds):
            train = np.flatnonzero(block.fold != fold)
            for fit in range(fold, len(slots), folds):
                if growing[fit] is None or firsts[fit] == firsts[fit + 1] or not len(train):
                    continue
                slot = slots[fit][growing[fit].nodes(block.bins[train], level)]
                rows, slot = train[slot >= 0], slot[slot >= 0]
                if not len(rows):
                    continue
                p, weight = softmax(scores[rows, fit].astype(np.float64)), block.weight[rows]
                parts = [*(((p - hot[rows]) * weight[:, None]).T), weight * (1 - (p * p).sum(axis=1)) / classes]
                low, high = int(firsts[fit]) * bins.total, int(firsts[fit + 1]) * bins.total
                keys = (joint[rows] + (slot * bins.total)[:, None]).ravel()
                for k, part in enumerate(parts):
                    out[k, low:high] += np.bincount(keys, np.repeat(part, bins.width), high - low)
    return np.zeros((0, 0)) if out is None else out


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b if not a.size else a if not b.size else a + b


def total(parts: RDD) -> np.ndarray:
    """The sum of one table per task; beyond ``DIRECT`` tasks they are added up in steps on the executors."""
    return parts.reduce(_add) if parts.getNumPartitions() <= DIRECT else parts.treeReduce(_add, depth=2)


@dataclass
class Boosted:
    """The fitted trees: ``trees[round][fit]``, fit = setting * folds + fold."""

    settings: tuple[Setting, ...]
    folds: int
    classes: int
    bins: Bins
    trees: list[list[Tree | None]]

    def prediction_log(self, rows: DataFrame, label: str, group: str, fold: str = "fold") -> DataFrame:
        """(model, fold, mutation, actual, predicted): every row is predicted by each setting's fit that left out its fold."""
        held = rows.sparkSession.sparkContext.broadcast((self.trees, self.bins))
        settings, folds, classes, width = self.settings, self.folds, self.classes, self.bins.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, bins = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                encoded = bins.encode(batch.columns[:width])
                folds_here = batch.column(width).to_numpy(zero_copy_only=False)
                for number, setting in enumerate(settings):
                    predicted = np.zeros(len(encoded), np.int32)
                    for f in range(folds):
                        mine = np.flatnonzero(folds_here == f)
                        scores = np.zeros((len(mine), classes), np.float32)
                        for round_ in trees:
                            if round_[number * folds + f] is not None and len(mine):
                                scores += round_[number * folds + f].leaves(encoded[mine])
                        predicted[mine] = scores.argmax(axis=1) if len(mine) else 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([setting.name] * len(encoded), pa.string()), batch.column(width), batch.column(width + 1),
                         batch.column(width + 2), pa.array(predicted)],
                        ["model", "fold", "mutation", "actual", "predicted"])

        given = self.bins.select(rows, F.col(fold).cast("int").alias("_fold"), F.col(group).cast("string").alias("_group"),
                                 F.col(label).cast("int").alias("_label"))
        return given.mapInArrow(run, "model string, fold int, mutation string, actual int, predicted int")


def fit_boosters(rows: DataFrame, settings: Sequence[Setting], label: str, weight: str, drop: Iterable[str], fold: str = "fold",
                 folds: int = 5, classes: int = 4, sample_rows: int | None = None, key: str | None = None) -> Boosted:
    """Fit every setting on every fold's other rows, all together.

    ``label`` runs from 0 to ``classes`` - 1; rows with a null label, weight or fold take no part in a fit. Features are all
    columns but ``drop``; missing values have a bin of their own. ``sample_rows`` bounds the rows that are fitted on to those
    with the smallest hash of ``key`` (and of the whole row, where keys repeat); without it all rows are.
    """
    settings = tuple(settings)
    context = rows.sparkSession.sparkContext
    ensure_checkpoint_dir(rows.sparkSession)
    left_out = {label, weight, fold, *drop}
    usable = rows.filter(F.col(label).isNotNull() & F.col(weight).isNotNull() & F.col(fold).isNotNull())
    if sample_rows is not None:
        order = [F.xxhash64(F.col(key), F.lit(17))] if key else []
        usable = usable.orderBy(*order, F.xxhash64(*usable.columns)).limit(sample_rows)
        usable = materialize(usable, spread=True)
    bins = fit_bins(usable, left_out)
    fits, width = len(settings) * folds, bins.width

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                parts = [bins.encode(batch.columns[:width])] + [
                    batch.column(width + k).to_numpy(zero_copy_only=False).astype(kind)
                    for k, kind in enumerate((np.uint8, np.float32, np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts],
                                                 ["bins", "label", "weight", "fold"])

    given = bins.select(usable, F.col(label).cast("int").alias("_label"), F.col(weight).cast("double").alias("_weight"),
                        F.col(fold).cast("int").alias("_fold"))
    packed = materialize(given.mapInArrow(pack, "bins binary, label binary, weight binary, fold binary"), large_rows=True)

    run = uuid4().hex

    def block(row, number: int) -> Block:
        labels = np.frombuffer(row["label"], np.uint8)
        return Block(f"{run}-{number}", np.frombuffer(row["bins"], np.uint16).reshape(len(labels), width), labels,
                     np.frombuffer(row["weight"], np.float32).astype(np.float64), np.frombuffer(row["fold"], np.uint8), 0,
                     np.zeros((len(labels), fits, classes), np.float32))

    rows_here = packed.agg(F.coalesce(F.sum(F.octet_length("label")), F.lit(0))).first()[0]  # a byte a row
    if rows_here <= ALONE:
        return Boosted(settings, folds, classes, bins, _grow_apart(packed, block, settings, folds, classes, bins))
    kept = packed.rdd.zipWithIndex().map(lambda row: block(*row)).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[list[Tree | None]] = []
    since: list[list[Tree | None]] = []
    for number in range(max(s.rounds for s in settings)):
        active = [settings[fit // folds] if number < settings[fit // folds].rounds else None for fit in range(fits)]
        trees = _grow(lambda part: total(kept.mapPartitions(part)), bins, folds, classes, since, active)
        done.append(trees)
        since.append(trees)
        if len(since) == KEEP and number + 1 < max(s.rounds for s in settings):
            kept = _keep(kept, since, write=(number + 1) % CHECKPOINT == 0)
            since = []
    kept.unpersist()
    return Boosted(settings, folds, classes, bins, done)


def _grow_apart(packed: DataFrame, block: Callable, settings: tuple[Setting, ...], folds: int, classes: int, bins: Bins
                ) -> list[list[Tree | None]]:
    """All rounds of every fit on a sample of bounded size, a task for each (setting, fold)."""
    spark = packed.sparkSession
    sample = spark.sparkContext.broadcast([block(row, number) for number, row in enumerate(packed.collect())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fit in [f for batch in batches for f in batch.column(0).to_pylist()]:
            setting, fold = settings[fit // folds], fit % folds
            mine = []
            for b in sample.value:
                rows = b.fold != fold
                if rows.any():
                    mine.append(Block(f"{b.name}-{fit}", b.bins[rows], b.label[rows], b.weight[rows],
                                      np.full(rows.sum(), folds, np.uint8), 0, np.zeros((rows.sum(), 1, classes), np.float32)))
            trees: list[Tree] = []
            for _ in range(setting.rounds if mine else 0):
                tree = _grow(lambda part: part(mine)[0], bins, 1, classes, [], [setting])[0]
                trees.append(tree)
                for b in mine:
                    b.scores[:, 0] += tree.leaves(b.bins)
            for b in mine:
                _made.pop(b.name, None)
            yield pa.RecordBatch.from_arrays([pa.array([fit]), pa.array([pickle.dumps(trees)], pa.binary())], ["fit", "trees"])

    fits = len(settings) * folds
    grown = {row["fit"]: pickle.loads(row["trees"])
             for row in spark.range(0, fits, 1, fits).mapInArrow(run, "fit long, trees binary").collect()}
    return [[grown[fit][number] if number < len(grown[fit]) else None for fit in range(fits)]
            for number in range(max(s.rounds for s in settings))]


def _keep(kept: RDD, since: list[list[Tree | None]], write: bool) -> RDD:
    """The blocks with their scores brought up to date, in place of the old ones."""
    fresh = kept.map(lambda b: replace(b, rounds=b.rounds + len(since), scores=b.advanced(since))).persist(
        StorageLevel.MEMORY_AND_DISK)
    if write:
        fresh.checkpoint()
    fresh.count()
    kept.unpersist()
    return fresh


def _grow(summed_up: Callable, bins: Bins, folds: int, classes: int, since: list[list[Tree | None]],
          active: list[Setting | None]) -> list[Tree | None]:
    """One round: a tree for every active fit, a level of all of them per pass.

    ``summed_up`` gives the sum over all tasks of a function of a task's blocks.
    """
    trees = [s and Tree.empty(s.depth, classes) for s in active]
    parents: list[dict[int, np.ndarray]] = [{} for _ in active]  # sums of the nodes of the level above
    summed: list[dict[int, int | None]] = [{1: None} if s else {} for s in active]  # node -> sibling that is the rest
    for level in range(max(s.depth for s in active if s)):
        slots = []
        for fit, tree in enumerate(trees):
            table = np.full(len(tree.column) if tree else 1, -1, np.int64)
            table[list(summed[fit])] = np.arange(len(summed[fit]))
            slots.append(table)
        if not any(summed):
            break
        found = summed_up(lambda blocks: [level_sums(blocks, bins, folds, since, trees, slots, level)])
        if not found.size:
            break
        at = 0
        for fit, setting in enumerate(active):
            if not summed[fit]:
                continue
            here: dict[int, np.ndarray] = {}
            for node, sibling in summed[fit].items():
                here[node] = found[:, at: at + bins.total].T
                at += bins.total
                if sibling is not None:
                    here[sibling] = parents[fit][node // 2] - here[node]
            summed[fit], parents[fit] = _split(trees[fit], here, bins, setting, level), here
    return trees


def _split(tree: Tree, here: dict[int, np.ndarray], bins: Bins, setting: Setting, level: int) -> dict[int, int | None]:
    """Split the nodes of a level; returns the nodes to be summed next, each with its sibling."""
    nodes = sorted(here)
    best = best_splits(np.stack([here[n] for n in nodes]), bins, setting)

    def leaf(sums: np.ndarray) -> np.ndarray:
        return -setting.step * sums[:-1] / (max(sums[-1], 0.0) + setting.l2)

    if level == 0:
        tree.value[1] = leaf(here[1][: bins.starts[1] if bins.width > 1 else bins.total].sum(axis=0))
    following: dict[int, int | None] = {}
    for k, node in enumerate(nodes):
        if not best.gain[k] > 1e-9:
            continue
        column = int(np.searchsorted(bins.starts, best.place[k], side="right")) - 1
        tree.split(node, column, int(best.place[k] - bins.starts[column]), column >= bins.n_numbers)
        tree.value[2 * node], tree.value[2 * node + 1] = leaf(best.left[k]), leaf(best.right[k])
        if level + 1 < setting.depth:
            light = 2 * node + int(best.left[k][-1] > best.right[k][-1])
            following[light] = light ^ 1
    return following
