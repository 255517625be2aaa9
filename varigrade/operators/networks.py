"""Small neural networks on sparse features and category ids, fitted by data-parallel gradients with early stop.

Rows are kept as blocks (sparse features, ids, target, weight, and each row's part in every fit). A step is one pass: a task
adds up the gradients and losses of its blocks for all fits that are still running, and the driver gets one vector whatever
the number of rows. Folds share their passes. Weights multiply a row's loss, so a weight of three equals the row three times.

Features are standardised inside the first layer: tasks use W / s and b - (m / s) W on the raw sparse rows, with mean m and
deviation s of the fit's own training part.

A long embedding table (more than ``DRIVER_ENTRIES`` numbers) stays on the executors (``train_spread``): rows are dealt by its ids,
so each task holds the part of the table its rows use, with its moments, and steps it itself. The driver gets the gradient of the
other parameters as one vector a pass, whatever the number of ids or tasks.

The loss on the held-back rows is taken in the same pass. A fit ends when it has not improved for ``patience`` epochs and keeps
the parameters of its best epoch. The whole state (parameters, moments, best epoch, losses) can be kept in a ``StateStore``
after every epoch; a fit that finds one goes on from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrade.operators.boosting import BLOCK, softmax, total
from varigrade.session import ensure_checkpoint_dir, materialize
from varigrade.sources.sinks import StateStore

#: Parameters go to every task and the driver holds their moments, so their number is bounded.
MAX_PARAMETERS = 20_000_000
#: A table of more entries stays on the executors; ids of it that one task holds at most, and entries of it at most: every task
#: draws the whole start to find its own ids.
DRIVER_ENTRIES, PIECE_IDS, MAX_ENTRIES = 1 << 16, 4096, 1_000_000_000
#: Numbers of a table that are added up at a time.
SLICE = 1 << 14
#: Passes between two checkpoints of the parts of a long table.
CHECKPOINT = 10
NONE, TRAIN, HELD = 0, 1, 2

Parameters = dict[str, np.ndarray]


def _drawn(rng: np.random.Generator, shape: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of a normal table, drawn in slices; together they are what one draw of ``shape`` gives."""
    for at in range(0, shape[0], BLOCK):
        yield at, rng.normal(size=(min(BLOCK, shape[0] - at), shape[1]))


@dataclass(frozen=True)
class Network:
    """``inputs`` features and an embedding for each id column, then rectified ``hidden`` layers, then ``outputs``.

    ``tables`` are embeddings (number of ids, width); ``uses`` names the table of each id column, so columns can share one. With ``classes`` outputs are scores of classes under cross entropy, else one value under half the squared error.
    """

    inputs: int = 0
    tables: tuple[tuple[int, int], ...] = ()
    uses: tuple[int, ...] = ()
    hidden: tuple[int, ...] = (64, 32)
    outputs: int = 1
    classes: bool = False

    @property
    def sizes(self) -> list[int]:
        return [self.inputs + sum(self.tables[t][1] for t in self.uses), *self.hidden, self.outputs]

    def start(self, seed: int, spread: int | None = None) -> Parameters:
        """The first parameters; those of the table ``spread`` are drawn, but not kept."""
        rng, sizes = np.random.default_rng(seed), self.sizes
        count = sum(n * w for k, (n, w) in enumerate(self.tables) if k != spread) + sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))
        if count > MAX_PARAMETERS:
            raise ValueError(f"{count} parameters; the limit is {MAX_PARAMETERS}")
        made = {}
        for k, shape in enumerate(self.tables):
            if k == spread:
                for _ in _drawn(rng, shape):
                    pass
            else:
                made[f"E{k}"] = rng.normal(size=shape)
        for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
            reach = np.sqrt(6 / (a + b))
            made |= {f"W{k}": rng.uniform(-reach, reach, (a, b)), f"b{k}": rng.uniform(-reach, reach, b)}
        return made

    def start_of(self, seed: int, table: int, first: int, step: int) -> np.ndarray:
        """Every ``step``-th row of a table's first parameters, from ``first``."""
        rng = np.random.default_rng(seed)
        for shape in self.tables[:table]:
            for _ in _drawn(rng, shape):
                pass
        kept = [rows[(first - at) % step::step] for at, rows in _drawn(rng, self.tables[table])]
        return np.concatenate(kept) if kept else np.zeros((0, self.tables[table][1]))

    def long_table(self) -> int | None:
        """The largest table that is too long for the driver and used by one id column alone; rows can be dealt by its ids."""
        long = [(n * w, t) for t, (n, w) in enumerate(self.tables) if n * w > DRIVER_ENTRIES and self.uses.count(t) == 1]
        if not long:
            return None
        if max(long)[0] > MAX_ENTRIES:
            raise ValueError(f"a table of {max(long)[0]} entries; the limit is {MAX_ENTRIES}")
        return max(long)[1]

    def forward(self, given: Parameters, features: np.ndarray | SparseRows | None, ids: np.ndarray,
                first: np.ndarray | None = None) -> list:
        """The input of every layer, and the output. ``first`` is the product of features and first weights, if it was made before."""
        if first is None:
            if isinstance(features, SparseRows) and self.uses:
                features = features.dense()
            parts = ([features] if self.inputs else []) + [given[f"E{t}"][ids[:, k]] for k, t in enumerate(self.uses)]
            layers = [np.hstack(parts) if len(parts) > 1 else parts[0]]
        else:
            layers = [None]
        for k in range(len(self.hidden) + 1):
            out = (first if layers[-1] is None else layers[-1] @ given[f"W{k}"]) + given[f"b{k}"]
            layers.append(np.maximum(out, 0) if k < len(self.hidden) else out)
        return layers

    def loss(self, out: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss of each row, its derivative by the outputs)."""
        if not self.classes:
            gap = out - target[:, None]
            return 0.5 * gap[:, 0] ** 2, gap
        p, row = softmax(out), np.arange(len(out))
        label = target.astype(int)
        losses = -np.log(np.maximum(p[row, label], 1e-300))
        p[row, label] -= 1
        return losses, p

    def gradients(self, given: Parameters, layers: list[np.ndarray], slope: np.ndarray, ids: np.ndarray) -> Parameters:
        """Sums by parameter; where the first product was given to ``forward``, "W0" is its slope, row by row."""
        made: Parameters = {}
        for k in range(len(self.hidden), -1, -1):
            made |= {f"W{k}": slope if layers[k] is None else layers[k].T @ slope, f"b{k}": slope.sum(axis=0)}
            if layers[k] is None:
                return made
            slope = slope @ given[f"W{k}"].T
            if k:
                slope = slope * (layers[k] > 0)
        at = self.inputs
        made |= {f"E{t}": np.zeros(shape) for t, shape in enumerate(self.tables)}
        for k, t in enumerate(self.uses):
            width = self.tables[t][1]
            np.add.at(made[f"E{t}"], ids[:, k], slope[:, at: at + width])
            at += width
        return made

    def flat(self, parts: Parameters) -> np.ndarray:
        return np.concatenate([parts[name].ravel() for name in sorted(parts)])

    def shaped(self, flat: np.ndarray, like: Parameters) -> Parameters:
        out, at = {}, 0
        for name in sorted(like):
            out[name] = flat[at: at + like[name].size].reshape(like[name].shape)
            at += like[name].size
        return out

    def predict(self, out: np.ndarray) -> np.ndarray:
        return out.argmax(axis=1).astype(np.float64) if self.classes else out[:, 0]


@dataclass(frozen=True)
class Scale:
    """Mean and deviation of the features of one fit's training part; a constant feature is only centred."""

    mean: np.ndarray
    deviation: np.ndarray

    def inside(self, given: Parameters) -> Parameters:
        """Parameters for raw features."""
        first = given["W0"].copy()
        n = len(self.mean)
        first[:n] /= self.deviation[:, None]
        return given | {"W0": first, "b0": given["b0"] - self.mean @ first[:n]}

    def outside(self, made: Parameters) -> Parameters:
        """Gradients for standardised features from those for raw ones."""
        first = made["W0"].copy()
        n = len(self.mean)
        first[:n] = (first[:n] - np.outer(self.mean, made["b0"])) / self.deviation[:, None]
        return made | {"W0": first}


@dataclass(frozen=True)
class SparseRows:
    """Rows in two parts: a table of the slots that many of them fill, and (row, slot, value) of the others.

    Products take the time of the filled slots, whatever the width. ``rows @ weights`` and ``rows.T @ slopes`` are as with a
    dense table.
    """

    width: int
    common: np.ndarray
    table: np.ndarray
    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, starts: np.ndarray, slots: np.ndarray, values: np.ndarray, width: int) -> SparseRows:
        rows = len(starts) - 1
        often = np.bincount(slots, minlength=width) * 64 > rows
        common, row = np.flatnonzero(often), np.repeat(np.arange(rows), np.diff(starts))
        place = np.zeros(width, np.int64)
        place[common] = np.arange(len(common))
        inside = often[slots]
        table = np.zeros((rows, len(common)))
        table[row[inside], place[slots[inside]]] = values[inside]
        return cls(width, common, table, row[~inside], slots[~inside], values[~inside].astype(np.float64))

    def __len__(self) -> int:
        return len(self.table)

    def take(self, rows: np.ndarray) -> SparseRows:
        """The rows of these ascending numbers."""
        place = np.full(len(self), -1)
        place[rows] = np.arange(len(rows))
        kept = place[self.row] >= 0
        return SparseRows(self.width, self.common, self.table[rows], place[self.row[kept]], self.slot[kept], self.value[kept])

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.width))
        out[:, self.common] = self.table
        out[self.row, self.slot] = self.value
        return out

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        out = self.table @ weights[self.common]
        if len(self.row):
            first = np.flatnonzero(np.diff(self.row, prepend=-1))  # rows ascend
            out[self.row[first]] += np.add.reduceat(self.value[:, None] * weights[self.slot], first, axis=0)
        return out

    @property
    def T(self) -> _Turned:
        return _Turned(self)

    def add(self, out: np.ndarray, slopes: np.ndarray) -> None:
        """Add ``self.T @ slopes`` to ``out`` where slots are filled."""
        out[self.common] += self.table.T @ slopes
        if len(self.slot):
            order = np.argsort(self.slot, kind="stable")
            slot = self.slot[order]
            first = np.flatnonzero(np.diff(slot, prepend=-1))
            out[slot[first]] += np.add.reduceat(self.value[order, None] * slopes[self.row[order]], first, axis=0)

    def sums(self, power: int = 1) -> np.ndarray:
        """The sum of every slot's values, or of their powers."""
        out = np.bincount(self.slot, self.value ** power, self.width).astype(float)  # whole numbers if there are none
        out[self.common] += (self.table ** power).sum(axis=0)
        return out

    def squares(self, mean: np.ndarray) -> np.ndarray:
        """The sum of squared distances of every slot from ``mean``."""
        seen = np.bincount(self.slot, minlength=self.width)
        out = np.bincount(self.slot, (self.value - mean[self.slot]) ** 2, self.width) + (len(self) - seen) * mean ** 2
        out[self.common] = ((self.table - mean[self.common]) ** 2).sum(axis=0)
        return out


@dataclass(frozen=True)
class _Turned:
    rows: SparseRows

    def __matmul__(self, slopes: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows.width, slopes.shape[1]))
        self.rows.add(out, slopes)
        return out


@dataclass
class Block:
    """Rows with sparse features (CSR), ids, target, weight and their part in every fit."""

    starts: np.ndarray
    slots: np.ndarray
    values: np.ndarray
    ids: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    part: np.ndarray

    def dense(self, width: int) -> np.ndarray:
        """The features of this block alone, at most ``BLOCK`` rows."""
        out = np.zeros((len(self.target), width), np.float32)
        out[np.repeat(np.arange(len(self.target)), np.diff(self.starts)), self.slots] = self.values
        return out

    def sparse(self, width: int) -> SparseRows:
        return SparseRows.of(self.starts, self.slots, self.values, width)


@dataclass
class Training:
    """How long and how fast: one full pass an epoch. Steps grow to ``step`` over ``warm_up`` epochs; patience counts from then."""

    epochs: int = 500
    step: float = 0.01
    warm_up: int = 10
    decay: float = 1e-3
    patience: int = 10
    tolerance: float = 1e-4
    seed: int = 42


@dataclass
class Fit:
    """State of one fit; ``losses`` has (epoch, loss of the training rows, loss of the held-back rows)."""

    parameters: Parameters
    first: Parameters
    second: Parameters
    best: Parameters
    best_loss: float = float("inf")
    best_epoch: int = -1
    idle: int = 0
    running: bool = True
    losses: list[tuple[int, float, float]] = field(default_factory=list)


def _row_arrays(batch: pa.RecordBatch, sparse: bool, ids: int) -> tuple[np.ndarray, ...]:
    """(starts, slots, values, ids) of a batch whose first columns are slots and values, if ``sparse``, and ids."""
    if sparse:
        slots, values = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        first = (starts, slots.flatten().to_numpy().astype(np.int32), values.flatten().to_numpy().astype(np.float32))
    else:
        first = (np.zeros(batch.num_rows + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    names = [batch.column(2 * sparse + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(ids)]
    return (*first, np.stack(names, axis=1) if ids else np.zeros((batch.num_rows, 0), np.int64))


def blocks_of(rows: DataFrame, features: str | None, ids: Sequence[str], target: Column, weight: Column, fold: Column,
              held: Column, fits: int) -> RDD:
    """Blocks of all rows with a target and a weight. In fit f a row of fold f has no part, a ``held`` one is for validation."""
    packed = materialize(_packed(rows, features, ids, target, weight, fold, held, fits), large_rows=True)
    return packed.rdd.map(lambda row: pickle.loads(row["block"])).persist(StorageLevel.MEMORY_AND_DISK)


def _packed(rows: DataFrame, features: str | None, ids: Sequence[str], target: Column, weight: Column, fold: Column,
            held: Column, fits: int) -> DataFrame:
    """The blocks as bytes; partitions stay."""
    given = rows.select(*(sparse_columns(features) if features else []), *[F.col(c).cast("long").alias(c) for c in ids],
                        target.cast("double").alias("_target"), weight.cast("double").alias("_weight"),
                        F.coalesce(fold, F.lit(-1)).cast("int").alias("_fold"), F.coalesce(held, F.lit(False)).alias("_held"))
    given = given.filter("_target is not null and _weight is not null")
    sparse, n = features is not None, len(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                target, weight, fold, held = (batch.column(batch.num_columns - 4 + k).to_numpy(zero_copy_only=False)
                                              for k in range(4))
                part = np.where(fold[:, None] == np.arange(fits), NONE, np.where(held[:, None], HELD, TRAIN)).astype(np.uint8)
                block = Block(*_row_arrays(batch, sparse, n), target.astype(float), weight.astype(float), part)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return given.mapInArrow(pack, "block binary")


def sparse_width(features: str) -> Column:
    """The number of slots of a vector column."""
    vector = F.unwrap_udt(features)
    return F.when(vector["type"] == 0, vector["size"]).otherwise(F.size(vector["values"]))


def sparse_block(batch: pa.RecordBatch) -> Block:
    """The features of a batch that begins with ``sparse_columns``; no row has a part in a fit."""
    n = batch.num_rows
    return Block(*_row_arrays(batch, True, 0), np.zeros(n), np.zeros(n), np.zeros((n, 0), np.uint8))


def sparse_columns(features: str) -> list[Column]:
    """The filled slots of a vector column and their values, as plain arrays: as long as the vector is stored, not as it is wide."""
    vector = F.unwrap_udt(features)
    every = F.transform(vector["values"], lambda _, i: i)  # a dense vector stores all its slots
    return [F.when(vector["type"] == 0, vector["indices"]).otherwise(every).alias("_slots"), vector["values"].alias("_values")]


def feature_scales(blocks: RDD, width: int, fits: int) -> list[Scale]:
    """Scales of all fits from one pass: sums and squared sums of each row's feature, by fit."""

    def sums(given: Iterable[Block]) -> list[np.ndarray]:
        out = np.zeros((fits, 2 * width + 1))
        for block in given:
            x = block.sparse(width)
            for fit in range(fits):
                mine = x.take(np.flatnonzero(block.part[:, fit] != NONE))
                out[fit] += np.concatenate([mine.sums(), mine.sums(2), [len(mine)]])
        return [out]

    made = []
    for row in total(blocks.mapPartitions(sums)):
        n = max(row[-1], 1)
        mean = row[:width] / n
        spread = np.sqrt(np.maximum(row[width:-1] / n - mean ** 2, 0))
        made.append(Scale(mean, np.where(spread > 1e-9 * np.maximum(1, np.abs(mean)), spread, 1.0)))
    return made


def centred_squares(blocks: RDD, scale: Scale) -> np.ndarray:
    """The sum of squared distances from the mean of every feature, over all rows."""
    width = len(scale.mean)

    def squares(given: Iterable[Block]) -> list[np.ndarray]:
        return [sum((b.sparse(width).squares(scale.mean) for b in given), np.zeros(width))]

    return total(blocks.mapPartitions(squares))


def pass_sums(blocks: Iterable[Block], network: Network, given: list[Parameters | None]) -> list[np.ndarray]:
    """One task's sums for every running fit: gradients, then loss and weight of the training and of the held-back rows.

    Without id columns the products with the features, there and back, are made once a block for all fits side by side, and those
    back are added up in one table.
    """
    out: list[np.ndarray | None] = [None] * len(given)
    running = [k for k, parameters in enumerate(given) if parameters is not None]
    joint, width = bool(running) and network.inputs > 0 and not network.uses, network.sizes[1]
    weights = np.hstack([given[k]["W0"] for k in running]) if joint else None
    back = np.zeros_like(weights) if joint else None
    for block in blocks:
        x = block.sparse(network.inputs) if network.inputs else None
        first = x @ weights if joint else None
        slopes, made, tails = np.zeros_like(first) if joint else None, {}, {}
        for place, fit in enumerate(running):
            rows, own = np.flatnonzero(block.part[:, fit] != NONE), slice(place * width, (place + 1) * width)
            if not len(rows):
                continue
            parameters, ids, weight = given[fit], block.ids[rows], block.weight[rows]
            train = block.part[rows, fit] == TRAIN
            layers = network.forward(parameters, x.take(rows) if network.inputs and not joint else None, ids,
                                     first[rows, own] if joint else None)
            losses, slope = network.loss(layers[-1], block.target[rows])
            made[fit] = network.gradients(parameters, layers, slope * (weight * train)[:, None], ids)
            tails[fit] = [(losses * weight)[train].sum(), weight[train].sum(), (losses * weight)[~train].sum(), weight[~train].sum()]
            if joint:
                slopes[rows, own] = made[fit].pop("W0")
        if joint:
            x.add(back, slopes)
        for fit in made:
            found = np.append(network.flat(made[fit]), tails[fit])
            out[fit] = found if out[fit] is None else out[fit] + found
    del weights
    first_size = network.inputs * width if joint else 0  # W0 comes first in order
    size = max((len(o) for o in out if o is not None), default=0)
    if not size:
        return [np.zeros((0, 0))]
    whole = np.zeros((len(given), first_size + size))
    for fit, found in enumerate(out):
        if found is not None:
            whole[fit, first_size:] = found
            if joint:
                place = running.index(fit)
                whole[fit, :first_size] = back[:, place * width: (place + 1) * width].ravel()
    return [whole]


def train(blocks: RDD, network: Network, fits: int, training: Training, scales: list[Scale] | None = None,
          store: StateStore | None = None, stop_after: int | None = None) -> list[Fit]:
    """Fit all ``fits``; ``store`` keeps the state of every epoch and is read first.

    ``stop_after`` ends the run after that many epochs in all, as a lost driver would.
    """
    saved = store.load() if store else None
    if saved is None:
        start = network.start(training.seed)
        zero = {name: np.zeros_like(v) for name, v in start.items()}
        done, state = 0, [Fit(start, zero, zero, start) for _ in range(fits)]
    else:
        done, state = saved[0], pickle.loads(saved[1])
    for epoch in range(done, training.epochs):
        if not any(f.running for f in state) or (stop_after is not None and epoch >= stop_after):
            break
        sent = blocks.context.broadcast([(scales[k].inside(f.parameters) if scales else f.parameters) if f.running else None
                                         for k, f in enumerate(state)])
        found = _summed(blocks.mapPartitions(lambda part, sent=sent: pass_sums(part, network, sent.value)))
        sent.destroy()
        for k, fit in enumerate(state):
            if fit.running and found.size:
                made = network.shaped(found[k, :-4], fit.parameters)
                _advance(fit, scales[k].outside(made) if scales else made, found[k, -4:], epoch, training)
            elif not found.size:
                fit.running = False
        if store:
            store.save(epoch + 1, pickle.dumps(state))
    return state


def _advance(fit: Fit, made: Parameters, tail: np.ndarray, epoch: int, training: Training) -> None:
    """Judge the epoch's parameters by the held-back rows (training rows where none are held back), then take one Adam step."""
    loss, n, held_loss, held_n = tail
    if not n:
        fit.running = False
        return
    judged = held_loss / held_n if held_n else loss / n
    fit.losses.append((epoch, loss / n, judged))
    improved = judged < fit.best_loss - training.tolerance
    fit.idle = 0 if improved or epoch < training.warm_up else fit.idle + 1
    if judged < fit.best_loss:
        fit.best_loss, fit.best_epoch, fit.best = judged, epoch, fit.parameters
    if fit.idle >= training.patience:
        fit.running = False
        return
    t = epoch + 1
    parameters, first, second = {}, {}, {}
    for name, value in fit.parameters.items():
        slope = made[name] / n + (training.decay / n * value if name[0] == "W" else 0)
        parameters[name], first[name], second[name] = _stepped(value, fit.first[name], fit.second[name], slope, t, training)
    fit.parameters, fit.first, fit.second = parameters, first, second


def _stepped(value: np.ndarray, first: np.ndarray, second: np.ndarray, slope: np.ndarray, t: int, training: Training
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters and moments after Adam's step ``t`` (from 1)."""
    step = training.step * min(1.0, t / max(1, training.warm_up))
    first = 0.9 * first + 0.1 * slope
    second = 0.999 * second + 0.001 * slope * slope
    moved = step * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return value - moved, first, second


@dataclass
class Piece:
    """The ids ``part``, ``part`` + parts, ... of a long table: parameters and moments, those judged by the last pass, those of the
    best epoch, and what the last pass sends to the driver.
    """

    parameters: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    judged: np.ndarray
    sums: np.ndarray

    def chosen(self, newest: bool) -> np.ndarray:
        """Parameters of the best epoch, if the last pass was the best one or not."""
        return self.judged if newest else self.best


def parts_of(rows: DataFrame, network: Network, table: int) -> int:
    """How many parts a long table is dealt to; the same for all runs on one session and vocabulary."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-network.tables[table][0] // PIECE_IDS))


def _dealt(rows: DataFrame, id_column: str, parts: int) -> DataFrame:
    """Rows by the part that holds their id of the long table: partition k has part k."""
    return rows.repartitionById(parts, F.pmod(F.col(id_column), F.lit(parts)).cast("int"))


def _newest(fit: Fit) -> bool:
    """Whether the last epoch was the best one."""
    return bool(fit.losses) and fit.best_epoch == fit.losses[-1][0]


def _summed(parts: RDD) -> np.ndarray:
    """The sum of one table per partition in their order, made on the executors by slices: the driver gets one table.

    A task that adds holds the slices of some places from every partition, never whole tables.
    """
    def sliced(part: int, own: Iterable[np.ndarray]) -> Iterator[tuple[int, tuple]]:
        for made in own:
            flat = made.ravel()
            for at in range(0, len(flat), SLICE):
                yield at // SLICE, (part, made.shape, flat[at: at + SLICE])

    def added(group: Iterable[tuple]) -> tuple:
        ordered = sorted(group, key=lambda one: one[0])
        return ordered[0][1], reduce(np.add, (v for _, _, v in ordered))

    n = min(parts.getNumPartitions(), parts.context.defaultParallelism)
    found = sorted(parts.mapPartitionsWithIndex(sliced).groupByKey(n).mapValues(added).collect(), key=lambda one: one[0])
    return np.concatenate([v for _, (_, v) in found]).reshape(found[0][1][0]) if found else np.zeros((0, 0))


def train_spread(rows: DataFrame, ids: Sequence[str], target: Column, weight: Column, held: Column, network: Network, table: int,
                 training: Training, store: StateStore | None = None, stop_after: int | None = None) -> tuple[Fit, DataFrame]:
    """As ``train`` with one fit, for a network whose table ``table`` stays on the executors.

    Returns the fit, without that table, and (part, best): its parameters of the best epoch, a row for each part. The steps are those of
    ``train``; sums are added in another order. All rows of an id are in one part, so equal rows should be one weighted row.
    """
    spark, use = rows.sparkSession, network.uses.index(table)
    ensure_checkpoint_dir(spark)
    parts, name, width = parts_of(rows, network, table), f"E{table}", network.tables[table][1]
    given = _dealt(rows, ids[use], parts)
    blocks = _packed(given, None, ids, target, weight, F.lit(-1), held, 1).rdd.mapPartitions(
        lambda found: [[pickle.loads(row["block"]) for row in found]]).persist(StorageLevel.MEMORY_AND_DISK)

    n = max(float(_summed(blocks.map(lambda own: np.array([sum(b.weight[b.part[:, 0] == TRAIN].sum() for b in own)])))[0]), 1e-300)

    def begin(part: int, _: Iterator) -> list[Piece]:
        start = network.start_of(training.seed, table, part, parts)
        zero = np.zeros_like(start)
        return [Piece(start, zero, zero, start, start, np.zeros(0))]

    saved = store.load() if store else None
    if saved is None:
        start = network.start(training.seed, table)
        zero = {key: np.zeros_like(v) for key, v in start.items()}
        done, fit = 0, Fit(start, zero, zero, start)
        pieces = blocks.mapPartitionsWithIndex(begin)
    else:
        done, fit = saved[0], pickle.loads(saved[1])[0]
        stored = store.load_pieces(done)
        if stored.count() != parts:
            raise ValueError("the stored state has another number of parts; resume with the same spark.sql.shuffle.partitions")
        pieces = stored.rdd.map(lambda row: (row["part"], bytes(row["piece"]))).partitionBy(parts, int).mapPartitions(
            lambda found: [pickle.loads(piece) for _, piece in found])
    pieces = pieces.persist(StorageLevel.MEMORY_AND_DISK)
    for epoch in range(done, training.epochs):
        if not fit.running or (stop_after is not None and epoch >= stop_after):
            break
        sent, newest = spark.sparkContext.broadcast(fit.parameters), _newest(fit)

        def advance(pair: tuple[list[Block], Piece], sent=sent, newest=newest, t=epoch + 1) -> Piece:
            own, piece = pair
            tables = tuple((len(piece.parameters), width) if k == table else shape for k, shape in enumerate(network.tables))
            local = replace(network, tables=tables)
            parameters = sent.value | {name: piece.parameters}
            local_blocks = (replace(b, ids=_local(b.ids, use, parts)) for b in own)
            found = pass_sums(local_blocks, local, [parameters])[0]
            made = local.shaped(found[0, :-4] if found.size else np.zeros(sum(v.size for v in parameters.values())), parameters)
            tail = found[0, -4:] if found.size else np.zeros(4)
            moved = _stepped(piece.parameters, piece.first, piece.second, made.pop(name) / n, t, training)
            return Piece(*moved, piece.chosen(newest), piece.parameters, np.append(network.flat(made), tail))

        before, pieces = pieces, blocks.zip(pieces).map(advance).persist(StorageLevel.MEMORY_AND_DISK)
        if (epoch + 1 - done) % CHECKPOINT == 0:
            pieces.checkpoint()
        found = _summed(pieces.map(lambda piece: piece.sums))
        before.unpersist()
        _advance(fit, network.shaped(found[:-4], fit.parameters), found[-4:], epoch, training)
        if store:
            store.save_pieces(epoch + 1, pieces.mapPartitionsWithIndex(
                lambda part, own: [(part, bytearray(pickle.dumps(piece))) for piece in own]))
            store.save(epoch + 1, pickle.dumps([fit]))
    newest = _newest(fit)
    best = materialize(spark.createDataFrame(pieces.mapPartitionsWithIndex(
        lambda part, own: [(part, bytearray(pickle.dumps(piece.chosen(newest)))) for piece in own]), "part int, best binary"))
    pieces.unpersist()
    blocks.unpersist()
    return fit, best


def _local(ids: np.ndarray, use: int, parts: int) -> np.ndarray:
    """Ids with those of the long table as places in its part."""
    ids = ids.copy()
    ids[:, use] //= parts
    return ids


def predictions_spread(rows: DataFrame, network: Network, table: int, fit: Fit, best: DataFrame, ids: Sequence[str],
                       keep: dict[str, Column], kinds: str) -> DataFrame:
    """As ``predictions``, for a fit of ``train_spread``: rows meet the part of the table that holds their id."""
    spark, use = rows.sparkSession, network.uses.index(table)
    parts, sent, n, others = parts_of(rows, network, table), spark.sparkContext.broadcast(fit.best), len(ids), len(keep)
    names = [*keep, "predicted"]
    part = F.pmod(F.col(ids[use]), F.lit(parts)).cast("int")
    given = rows.select(part.alias("_piece"), *[F.col(c).cast("long").alias(c) for c in ids], *[c.alias(k) for k, c in keep.items()])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parameters = sent.value | {f"E{table}": pickle.loads(right.column("best")[0].as_py())}
        out = np.zeros(left.num_rows)
        for at in range(0, left.num_rows, BLOCK):
            held = left.slice(at, BLOCK)
            found = np.stack([held.column(1 + k).to_numpy().astype(np.int64) for k in range(n)], axis=1)
            made = network.forward(parameters, np.zeros((len(found), 0)), _local(found, use, parts))
            out[at: at + BLOCK] = network.predict(made[-1])
        columns = [left.column(1 + n + k) for k in range(others)]
        return pa.table([*columns, pa.array(out)], names=names)

    return given.groupBy("_piece").cogroup(best.groupBy("part")).applyInArrow(run, f"{kinds}, predicted double")


def losses_table(like: DataFrame, state: list[Fit]) -> DataFrame:
    """(fit, epoch, train_loss, held_loss, best): a row an epoch."""
    rows = [(k, e, float(a), float(b), e == f.best_epoch) for k, f in enumerate(state) for e, a, b in f.losses]
    return like.sparkSession.createDataFrame(rows, "fit int, epoch int, train_loss double, held_loss double, best boolean")


def predictions(rows: DataFrame, network: Network, state: list[Fit], scales: list[Scale] | None, features: str | None,
                ids: Sequence[str], fold: Column, keep: dict[str, Column], kinds: str) -> DataFrame:
    """``keep`` columns (their types in ``kinds``) and ``predicted`` of every row, by the fit of its fold."""
    sent = rows.sparkSession.sparkContext.broadcast(
        [scales[k].inside(f.best) if scales else f.best for k, f in enumerate(state)])
    sparse, n, names, others = features is not None, len(ids), [*keep, "predicted"], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                block = Block(*_row_arrays(batch, sparse, n), np.zeros(batch.num_rows), np.zeros(0), np.zeros(0))
                fold = batch.column(2 * sparse + n).to_numpy(zero_copy_only=False)
                x, out = block.sparse(network.inputs) if sparse else None, np.zeros(batch.num_rows)
                for k, parameters in enumerate(sent.value):
                    mine = np.flatnonzero(fold == k)
                    if len(mine):
                        made = network.forward(parameters, x.take(mine) if sparse else None, block.ids[mine])
                        out[mine] = network.predict(made[-1])
                yield pa.RecordBatch.from_arrays([*[batch.column(2 * sparse + n + 1 + k) for k in range(others)], pa.array(out)], names)

    given = rows.select(*(sparse_columns(features) if sparse else []), *[F.col(c).cast("long").alias(c) for c in ids],
                        fold.cast("int").alias("_fold"), *[c.alias(name) for name, c in keep.items()])
    return given.mapInArrow(run, f"{kinds}, predicted double")
