"""Random forest whose trees are grown and kept outside the driver.

Features are cut into bins once, by thresholds that come from all training rows, and stored
as bytes. The trees are dealt to the tasks: a task reads all rows once and grows its trees level by
level, with the rows of a node side by side, so a level costs the rows that are still in open
nodes and not the number of nodes. What grows with the rows lies in temporary files
behind a size, not in memory. The trees are rows of a table in the shared folder; neither fit nor
scoring brings them to the driver, and a scoring task reads one after the other.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import _ProbabilisticClassifierParams, _RandomForestClassifierParams
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.tables import scratch_folder, stored

# Rows and open nodes that are counted at a time, weighted values of a feature that are
# kept per task to find its thresholds, bytes of an array above which it is a file.
_ROWS, _NODES, _POINTS, _IN_MEMORY = 1 << 16, 1 << 10, 1 << 12, 64 << 20
# Rows that are scored together, and bytes of trees that a worker keeps.
_SCORED, _KEPT = 1 << 19, 64 << 20
# A gain below this is rounding.
_LEAST_GAIN = 1e-12
# Shares of classes are kept in these parts of the whole, so that the sum over the trees has no order.
_WHOLE = 1 << 31


def _room(shape, kind) -> np.ndarray:
    """An array; a large one lies in a temporary file, which goes with it."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if size <= _IN_MEMORY:
        return np.empty(shape, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=shape)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(0)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


# --- bins --------------------------------------------------------------------


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values with their counts; beyond a bound neighbours join the upper one at equal shares of the rows."""
    found, which = np.unique(values, return_inverse=True)
    total = np.bincount(which, counts)
    if len(found) <= _POINTS:
        return found, total
    share = (np.cumsum(total) * (_POINTS / total.sum())).astype(np.int64)
    last = np.append(np.flatnonzero(np.diff(share)), len(found) - 1)
    return found[last], np.diff(np.cumsum(total)[last], prepend=0)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature the weighted values of a partition, and its largest label as feature -1."""
    kept: list = []
    top = -1.0
    for batch in batches:
        rows = _matrix(batch)
        top = max(top, batch.column(1).to_numpy(zero_copy_only=False).max(initial=-1))
        for i in range(rows.shape[1]):
            values = rows[:, i]
            values = values[~np.isnan(values)]
            old = kept[i] if i < len(kept) else (np.empty(0), np.empty(0))
            made = _merged(np.append(old[0], values), np.append(old[1], np.ones(len(values))))
            kept[i : i + 1] = [made]
    if top >= 0:
        names = ["feature", "points", "counts"]
        points, counts = [k[0] for k in kept], [k[1] for k in kept]
        columns = [pa.array([-1, *range(len(kept))], pa.int32())]
        columns += [pa.array([first, *lists], pa.list_(pa.float64())) for first, lists in (([top], points), ([1.0], counts))]
        yield pa.RecordBatch.from_arrays(columns, names)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` middles between values: all of them, or those nearest to equal shares of the rows."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= bins - 1:
        return middles
    below = np.cumsum(counts)
    stride = below[-1] / bins
    found, wanted = [], stride
    for i in range(1, len(values)):
        if len(found) == bins - 1:
            break
        if abs(below[i - 1] - wanted) < abs(below[i] - wanted):
            found.append(middles[i - 1])
            wanted += stride
    return np.array(found)


def _binned(rows: np.ndarray, splits: list[list[float] | None]) -> np.ndarray:
    """Bins as bytes; a category, which has no thresholds, is its own bin."""
    made = np.empty(rows.shape, np.uint8)
    for i, cuts in enumerate(splits):
        if cuts is None:
            made[:, i] = np.clip(np.nan_to_num(rows[:, i], nan=255), 0, 255)
        else:
            made[:, i] = np.searchsorted(np.asarray(cuts), rows[:, i], "left")
    return made


_BLOCK = "part bigint, place bigint, rows bigint, bins binary, labels binary"
_BLOCK_NAMES = [c.split(" ")[0] for c in _BLOCK.split(", ")]


def _blocks(splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(batches):
            if batch.num_rows:
                labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                values = [part, place, batch.num_rows, _binned(_matrix(batch), splits).tobytes(), labels.tobytes()]
                kinds = [*[pa.int64()] * 3, *[pa.binary()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _BLOCK_NAMES)

    return run


# --- growing -----------------------------------------------------------------


class _Settings:
    def __init__(self, classes, bins, categories, subset, depth, least, least_gain, seed, share, drawn):
        self.classes, self.bins, self.categories, self.subset = classes, bins, np.asarray(categories), subset
        self.depth, self.least, self.least_gain, self.seed = depth, least, least_gain, seed
        self.share, self.drawn = share, drawn


def _best(counts: np.ndarray, chosen: np.ndarray, s: _Settings):
    """The best split of each node from its counts (node, feature, bin, class): whether there is
    one, feature, what goes left by bin, gain, and the classes on the left.
    """
    nodes, width, bins, _ = counts.shape
    order = None
    is_category = s.categories[chosen]
    if is_category.any():
        # Categories are ordered by their share of the last class; those without rows come last.
        order = np.broadcast_to(np.arange(bins), (nodes, width, bins)).copy()
        some = counts[is_category]
        weight = some.sum(-1)
        share = np.where(weight > 0, some[..., -1] / np.maximum(weight, 1e-300), np.inf)
        order[is_category] = np.argsort(share, axis=-1, kind="stable")
        counts = np.take_along_axis(counts, order[..., None], axis=2)
    left = np.cumsum(counts, axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    on_left, on_right = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (left * left).sum(-1) / on_left + (right * right).sum(-1) / on_right
    value[(on_left < s.least) | (on_right < s.least)] = -np.inf
    flat = value.reshape(nodes, -1)
    place = flat.argmax(1)
    row = np.arange(nodes)
    weight = total[:, 0, 0].sum(-1)
    gain = (flat[row, place] - (total[:, 0, 0] ** 2).sum(-1) / weight) / weight
    column, cut = np.divmod(place, bins)
    goes_left = np.arange(bins) <= cut[:, None]
    if order is not None:
        ordered = np.zeros((nodes, bins), bool)
        np.put_along_axis(ordered, order[row, column], goes_left, axis=1)
        goes_left = np.where(is_category[row, column][:, None], ordered, goes_left)
    good = (gain > _LEAST_GAIN) & (gain >= s.least_gain)
    return good, chosen[row, column], cut, goes_left, gain, left[row, column, cut]


def _dealt(parts, slot, side, lengths, put, following) -> None:
    """Rows of several nodes to their children: those of a child side by side, children in order from ``put``."""
    starts = put + np.cumsum(lengths.ravel()) - lengths.ravel()
    for half in (0, 1):
        each = lengths[:, half]
        shift = starts[half::2] - (np.cumsum(each) - each)
        following[np.arange(int(each.sum())) + np.repeat(shift, each)] = parts[side == half]


def _in_bag(blocks: list[tuple[int, int, int, int]], total: int, tree: int, s: _Settings) -> np.ndarray:
    """How often each row is in the tree's sample. It is drawn block by block, so it does not
    depend on the order in which blocks arrive.
    """
    weights = _room(total, np.uint8)
    for part, place, at, size in blocks:
        draw = np.random.default_rng([s.seed & (2**63 - 1), tree, part, place])
        weights[at : at + size] = np.minimum(draw.poisson(s.share, size), 255) if s.drawn else draw.random(size) < s.share
    return weights


def _grow(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, tree: int, s: _Settings):
    """One tree: per node feature (-1 in a leaf), cut, left child (the right one follows) and shares
    of the classes; and the importance of the features.
    """
    (total, features), values = bins.shape, bins.reshape(-1)
    draw = np.random.default_rng([s.seed & (2**63 - 1), tree])
    step = 1 << 20
    inside = sum(int(np.count_nonzero(weights[at : at + step])) for at in range(0, total, step))
    kind = np.int32 if total < 1 << 31 else np.int64
    order, following = _room(inside, kind), _room(inside, kind)
    done, first = 0, np.zeros(s.classes)
    for at in range(0, total, step):
        rows = np.flatnonzero(weights[at : at + step]) + at
        order[done : done + len(rows)] = rows
        done += len(rows)
        first += np.bincount(labels[rows], weights[rows], s.classes)

    def is_open(counts: np.ndarray) -> np.ndarray:
        return (counts.sum(1) >= 2 * s.least) & ((counts > 0).sum(1) > 1)

    # Nodes that are split, and the classes of all nodes in the order of their numbers.
    split, classes, known = [], [first[None]], 1
    # Open nodes of a level: number, rows, classes. Their rows lie in ``order``, node after node.
    number, sizes, held = np.zeros(1, np.int64), np.array([inside], np.int64), first[None]
    if not is_open(held)[0]:
        number = number[:0]
    for level in range(s.depth):
        if not len(number):
            break
        ends, made, at, put = np.cumsum(sizes), [], 0, 0
        while at < len(number):
            begin = int(ends[at] - sizes[at])
            upto = max(at + 1, min(at + _NODES, int(np.searchsorted(ends, begin + _ROWS, "right"))))
            nodes, stop = upto - at, int(ends[upto - 1])
            chosen = np.broadcast_to(np.arange(features), (nodes, features))
            if s.subset < features:
                chosen = np.argpartition(draw.random((nodes, features)), s.subset - 1, axis=1)[:, : s.subset]
            width = chosen.shape[1]
            lanes = np.arange(nodes * width).reshape(nodes, width).T * (s.bins * s.classes)
            places = np.ascontiguousarray(chosen.T)
            counts = np.zeros(nodes * width * s.bins * s.classes)
            # A node of more rows than are counted at a time is alone.
            pieces = [order[low : min(low + _ROWS, stop)] for low in range(begin, stop, _ROWS)]
            slot = np.repeat(np.arange(nodes), sizes[at:upto] if nodes > 1 else min(_ROWS, stop - begin))
            for rows in pieces:
                slot = slot[: len(rows)]
                key = values.take(places.take(slot, 1) + rows.astype(np.int64) * features).astype(np.int64)
                key *= s.classes
                key += lanes.take(slot, 1)
                key += labels[rows]
                counts += np.bincount(key.ravel(), np.tile(weights[rows], width), len(counts))
            good, by, edge, goes_left, gain, left = _best(counts.reshape(nodes, width, s.bins, s.classes), chosen, s)
            worth = gain * held[at:upto].sum(1)
            pair = np.stack([left, held[at:upto] - left], axis=1)[good].reshape(-1, s.classes)
            names = known + np.arange(len(pair))
            known += len(pair)
            classes.append(pair)
            mask = (goes_left[:, :32] << np.arange(min(32, s.bins), dtype=np.uint32)).sum(1, dtype=np.uint32)
            edge = np.where(s.categories[by], mask, edge)
            split.append([number[at:upto][good], by[good], edge[good], names[::2], worth[good]])
            # Only the rows of children that may be split again are kept.
            stays = is_open(pair) if level + 1 < s.depth else np.zeros(len(pair), bool)
            keeps = np.zeros((nodes, 2), bool)
            keeps[good] = stays.reshape(-1, 2)
            lengths = np.zeros((nodes, 2), np.int64)
            if nodes > 1:
                rows = pieces[0]
                side = (~goes_left[slot, values.take(rows.astype(np.int64) * features + by[slot])]).astype(np.int64)
                kept = keeps[slot, side]
                rows, slot, side = rows[kept], slot[kept], side[kept]
                lengths += np.bincount(slot * 2 + side, minlength=2 * nodes).reshape(nodes, 2)
                _dealt(rows, slot, side, lengths, put, following)
            elif stays.any():
                # Rows on the left from the front, on the right from the end if there are both.
                front, back, both = put, put + stop - begin, stays.all()
                for rows in pieces:
                    left_rows = goes_left[0, bins[rows, by[0]]]
                    for half in np.flatnonzero(keeps[0]).tolist():
                        mine = rows[~left_rows if half else left_rows]
                        lengths[0, half] += len(mine)
                        if half and both:
                            following[back - len(mine) : back] = mine
                            back -= len(mine)
                        else:
                            following[front : front + len(mine)] = mine
                            front += len(mine)
            put += int(lengths.sum())
            made.append((names[stays], lengths[good].ravel()[stays], pair[stays]))
            at = upto
        number, sizes, held = (np.concatenate([m[i] for m in made]) for i in range(3))
        order, following = following, order

    feature, cut, child = np.full(known, -1, np.int16), np.zeros(known, np.uint32), np.zeros(known, np.int32)
    value = np.zeros(known)
    for names, by, edge, first_child, worth in split:
        feature[names], cut[names], child[names], value[names] = by, edge, first_child, worth
    counts = np.concatenate(classes)
    kept = _pruned(feature, child, counts.argmax(1))
    inner = feature >= 0
    importance = np.bincount(feature[inner], value[inner], features)
    child = np.where(inner, np.cumsum(kept)[child] - 1, 0).astype(np.int32)
    share = np.rint(counts / np.maximum(counts.sum(1, keepdims=True), 1) * _WHOLE).astype(np.uint32)
    return feature[kept], cut[kept], child[kept], share[kept], importance / max(importance.sum(), 1e-300)


def _pruned(feature: np.ndarray, child: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Two leaves of the same class become one, as in Spark's trees, until there are none; which nodes are left."""
    inner = np.flatnonzero(feature >= 0)
    while len(inner):
        left = child[inner]
        alike = (feature[left] < 0) & (feature[left + 1] < 0) & (best[left] == best[left + 1])
        if not alike.any():
            break
        feature[inner[alike]] = -1
        inner = inner[~alike]
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    kept[child[inner]] = kept[child[inner] + 1] = True
    return kept


_TREE = "tree int, feature binary, cut binary, child binary, share binary, importance array<double>"
_TREE_NAMES = [c.split(" ")[0] for c in _TREE.split(", ")]


def _trees(total: int, features: int, groups: int, trees: int, s: _Settings):
    """Grow the trees of a group from all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, labels, at, group, blocks = _room((total, features), np.uint8), _room(total, np.uint8), 0, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                size = batch.column("rows")[row].as_py()
                blocks.append((batch.column("part")[row].as_py(), batch.column("place")[row].as_py(), at, size))
                bins[at : at + size] = np.frombuffer(batch.column("bins")[row].as_buffer(), np.uint8).reshape(size, features)
                labels[at : at + size] = np.frombuffer(batch.column("labels")[row].as_buffer(), np.uint8)
                at, group = at + size, batch.column("group")[row].as_py()
        if group is None:
            return
        if at != total:
            raise ValueError(f"{at} of {total} training rows")
        for tree in range(group, trees, groups):
            feature, cut, child, share, importance = _grow(bins, labels, _in_bag(blocks, total, tree, s), tree, s)
            values = [tree, *(x.tobytes() for x in (feature, cut, child, share)), importance]
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _TREE_NAMES)

    return run


# --- scoring -----------------------------------------------------------------


_HELD: dict[tuple[str, ...], list] = {}


def _read_trees(files: list[str], classes: int) -> Iterator[tuple]:
    """The trees of the files one after the other; a small forest stays in the worker."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    key = tuple(files)
    if key in _HELD:
        yield from _HELD[key]
        return
    kept, size = [], 0
    for file in files:
        system, inner = fs.FileSystem.from_uri(file)
        with system.open_input_file(inner) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=_TREE_NAMES[1:5]):
                made = []
                for name, kind in (("feature", np.int16), ("cut", np.uint32), ("child", np.int32), ("share", np.uint32)):
                    made.append(np.frombuffer(batch.column(name)[0].as_buffer(), kind))
                made[3] = made[3].reshape(-1, classes)
                size += sum(m.nbytes for m in made)
                if size <= _KEPT:
                    kept.append(tuple(made))
                yield tuple(made)
    if size <= _KEPT:
        _HELD.clear()
        _HELD[key] = kept


def _leaves(bins: np.ndarray, feature, cut, child, categories: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins)) if feature[0] >= 0 else np.empty(0, np.int64)
    any_category = categories.any()
    values, width = bins.reshape(-1), bins.shape[1]
    while len(rows):
        here = node[rows]
        by, edge = feature[here], cut[here]
        value = values.take(rows * width + by)
        right = value > edge
        if any_category:
            in_mask = (edge >> np.minimum(value, 31).astype(np.uint32)) & 1
            right = np.where(categories[by], (value > 31) | (in_mask == 0), right)
        here = child[here] + right
        node[rows] = here
        rows = rows[feature[here] >= 0]
    return node


def _scores(files: list[str], splits: list, classes: int, trees: int):
    """Classes' shares per row, averaged over the trees."""
    categories = np.array([cuts is None for cuts in splits])

    def many(waiting: list[np.ndarray]) -> Iterator[pa.Array]:
        rows = np.concatenate(waiting)
        total = np.zeros((len(rows), classes))
        for feature, cut, child, share in _read_trees(files, classes):
            for at in range(0, len(rows), _ROWS):
                part = slice(at, at + _ROWS)
                total[part] += share[_leaves(rows[part], feature, cut, child, categories)]
        total /= trees * _WHOLE
        # The first share is the rest, so with two classes one is above a half exactly if it is the larger one.
        total[:, 0] = 1.0 - total[:, 1:].sum(1)
        at = 0
        for part in waiting:
            values = total[at : at + len(part)]
            at += len(part)
            offsets = pa.array(np.arange(0, values.size + 1, classes), pa.int32())
            shares = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
            best = pa.array(values.argmax(1).astype(np.float64))
            yield pa.StructArray.from_arrays([shares, best], ["shares", "best"])

    @F.arrow_udf("shares array<double>, best double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        waiting, rows = [], 0
        for batch in batches:
            values = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(splits))
            waiting.append(_binned(values, splits))
            rows += len(batch)
            if rows >= _SCORED:
                yield from many(waiting)
                waiting, rows = [], 0
        if waiting:
            yield from many(waiting)

    return run


# --- estimator and model -----------------------------------------------------


def _categories(schema, column: str, features: int) -> dict[int, int]:
    """Number of categories of the nominal features of an assembled column."""
    groups = schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    found = {}
    for attribute in groups.get("nominal", []):
        found[attribute["idx"]] = attribute.get("num_vals") or len(attribute.get("vals", []))
    return {i: n for i, n in found.items() if n and i < features}


def _subset(strategy: str, features: int, trees: int) -> int:
    """Features that are looked at in a node."""
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    named = {
        "all": features,
        "sqrt": math.ceil(math.sqrt(features)),
        "log2": max(1, math.ceil(math.log2(features))),
        "onethird": math.ceil(features / 3),
    }
    if strategy in named:
        return named[strategy]
    if "." in strategy or "e" in strategy.lower():
        return max(1, min(features, math.ceil(float(strategy) * features)))
    return max(1, min(features, int(strategy)))


class _ForestParams(_ProbabilisticClassifierParams, _RandomForestClassifierParams):
    pass


class Forest(Estimator, _ForestParams):
    """Random forest classifier with the settings of Spark ML's; the impurity is Gini's.

    Bootstrap samples are Poisson counts per row, nodes look at a random subset of the features,
    categories are ordered by their share of the last class. Categorical features may have up to
    32 categories.
    """

    def __init__(self, **settings):
        super().__init__()
        self._set(**settings)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        get = self.getOrDefault
        unsupported = get("impurity") != "gini" or get("minWeightFractionPerNode") > 0 or self.isSet("weightCol") or get("leafCol")
        if unsupported:
            raise ValueError("the forest has Gini impurity only, no row weights and no leaf column")
        rows = dataset.select(
            vector_to_array(F.col(get("featuresCol"))).alias("features"), F.col(get("labelCol")).cast("double").alias("label")
        )
        found = rows.mapInArrow(_points, "feature int, points array<double>, counts array<double>").collect()
        if not found:
            raise ValueError("no training rows")
        features = max(r.feature for r in found) + 1
        classes = max(2, int(max(r.points[0] for r in found if r.feature < 0)) + 1)
        most, categories = get("maxBins"), _categories(dataset.schema, get("featuresCol"), features)
        if most > 256 or max(categories.values(), default=0) > min(most, 32) or classes > 256:
            raise ValueError("at most 256 bins and classes, and 32 categories or maxBins")
        splits: list = []
        for i in range(features):
            if i in categories:
                splits.append(None)
                continue
            mine = [r for r in found if r.feature == i]
            merged = np.concatenate([r.points for r in mine]), np.concatenate([r.counts for r in mine])
            values, which = np.unique(merged[0], return_inverse=True)
            splits.append(thresholds(values, np.bincount(which, merged[1]), most).tolist())
        spark = dataset.sparkSession
        blocks = stored(rows.mapInArrow(_blocks(splits), _BLOCK), "bins")
        total = blocks.agg(F.sum("rows")).first()[0]
        trees = get("numTrees")
        settings = _Settings(
            classes=classes,
            bins=max(categories[i] if cuts is None else len(cuts) + 1 for i, cuts in enumerate(splits)),
            categories=[cuts is None for cuts in splits],
            subset=_subset(get("featureSubsetStrategy"), features, trees),
            depth=get("maxDepth"),
            least=get("minInstancesPerNode"),
            least_gain=get("minInfoGain"),
            seed=get("seed"),
            share=get("subsamplingRate"),
            drawn=get("bootstrap") and trees > 1,
        )
        groups = min(trees, spark.sparkContext.defaultParallelism)
        dealt = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        grown = dealt.repartitionById(groups, F.col("group")).mapInArrow(_trees(total, features, groups, trees, settings), _TREE)
        path = scratch_folder(spark, "forest")
        grown.write.option("compression", "none").parquet(path)
        model = ForestModel()
        model._resetUid(self.uid)
        self._copyValues(model)
        model._attach(path, splits, classes, spark)
        return model


class ForestModel(Model, _ForestParams, MLWritable, MLReadable):
    """A grown forest: thresholds here, trees as rows of the table at ``path``."""

    def _attach(self, path: str, splits: list, classes: int, spark) -> None:
        table = spark.read.schema(_TREE).parquet(path)
        self.path, self.splits, self.classes = path, splits, classes
        importance = np.array([r.importance for r in table.select("importance").collect()])
        self._trees, self._files = len(importance), sorted(table.inputFiles())
        total = importance.sum()
        self._importance = importance.sum(axis=0) / total if total else importance.sum(axis=0)

    @property
    def getNumTrees(self) -> int:
        return self._trees

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self._importance)

    @property
    def numFeatures(self) -> int:
        return len(self.splits)

    @property
    def numClasses(self) -> int:
        return self.classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scores = _scores(self._files, self.splits, self.classes, self._trees)
        found = dataset.withColumn("_forest", scores(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        made = {
            "rawPredictionCol": array_to_vector(F.transform("_forest.shares", lambda share: share * F.lit(float(self._trees)))),
            "probabilityCol": array_to_vector(F.col("_forest.shares")),
            "predictionCol": F.col("_forest.best"),
        }
        columns = {self.getOrDefault(name): value for name, value in made.items() if self.getOrDefault(name)}
        return found.withColumns(columns).drop("_forest")

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader()


class ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        more = {"splits": self.model.splits, "classes": self.model.classes}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=more)
        trees = self.sparkSession.read.schema(_TREE).parquet(self.model.path)
        trees.write.option("compression", "none").parquet(f"{path}/trees")


class ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._attach(f"{path}/trees", metadata["splits"], metadata["classes"], self.sparkSession)
        return model
