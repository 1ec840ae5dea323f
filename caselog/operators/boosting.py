"""Boosted regression trees over binned rows, several targets in one pass over the rows.

The trees are those of Spark's GBTClassifier and GBTRegressor: the first one fits the target, the
others the negative gradient of the loss; a split is the one of most variance gained, a
leaf the weighted mean. What differs is the work. Spark's trainers pass over the rows for each
level of each model's tree, with an object per row and a number per one-hot flag. Here a row
is a few 16-bit codes (several features share a code), rows lie in blocks, and a pass sums the
histograms of all models' trees; a category's flag is read off the histogram of its feature.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caselog import session
from caselog.sources.paths import delete

#: Rows of a block, and codes of the features that share one.
BLOCK_ROWS, MOST_CODES = 1 << 15, 1 << 10
#: Tasks whose histograms the driver adds up itself; more are first added up in groups.
DIRECT_TASKS = 64
#: Share of a node's sum of squares below which a gain is rounding.
ROUNDING = 1e-12
CHECKPOINT_ROUNDS = 10
#: Levels of trees that passes go through again before rows are stored with what they add.
KEPT_LEVELS = 8


class Layout(NamedTuple):
    """How features lie in codes: of each its number of values, its code, and what one step of
    its value adds to the code; ``flags`` says which are categories, each value with a flag of its
    own but for the last, which training rows don't have."""

    sizes: tuple[int, ...]
    flags: tuple[bool, ...]
    code: tuple[int, ...]
    stride: tuple[int, ...]
    widths: tuple[int, ...]

    @property
    def kind(self) -> type:
        return np.uint16 if max(self.widths) <= 1 << 16 else np.uint32

    @property
    def starts(self) -> list[int]:
        """Where the values of each feature begin in a histogram, and where all end."""
        return [0, *np.cumsum(self.sizes).tolist()]

    @property
    def columns(self) -> list[int]:
        """The column of the assembled vector where each feature begins, and their number."""
        return [0, *np.cumsum([s - 1 if f else 1 for s, f in zip(self.sizes, self.flags)]).tolist()]

    def values(self, feature: int) -> np.ndarray:
        """The value of a feature in each of the codes it shares."""
        return np.arange(self.widths[self.code[feature]]) // self.stride[feature] % self.sizes[feature]


def layout(sizes: Iterable[int], flags: Iterable[bool]) -> Layout:
    """Features put together, large ones first, while a code has at most ``MOST_CODES`` values."""
    sizes = tuple(sizes)
    code, stride, widths = [0] * len(sizes), [1] * len(sizes), []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        at = next((i for i, w in enumerate(widths) if w * sizes[f] <= MOST_CODES), len(widths))
        if at == len(widths):
            widths.append(1)
        code[f], stride[f] = at, widths[at]
        widths[at] *= sizes[f]
    return Layout(sizes, tuple(flags), tuple(code), tuple(stride), tuple(widths))


class Block(NamedTuple):
    """Rows: their codes, weights (None: all 1), classes (-1 or 1), and per model what the next
    tree starts from: the class model's sum of trees, the other's residual."""

    codes: np.ndarray
    weight: np.ndarray | None
    sign: np.ndarray
    raw: np.ndarray
    residual: np.ndarray


class Tree(NamedTuple):
    """Nodes in the order of levels. A row goes on from a node to ``after``, by its value of the
    node's ``code``, ``depth`` times at most; from a leaf it goes to that leaf."""

    code: np.ndarray
    after: np.ndarray
    value: np.ndarray
    depth: int

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        n, width = codes.shape[1], self.after.shape[1]
        flat, after, begin, row = codes.reshape(-1), self.after.reshape(-1), self.code * n, np.arange(n)
        node, index = np.zeros(n, np.int64), np.empty(n, np.int64)
        for _ in range(self.depth):
            np.take(begin, node, out=index, mode="clip")
            index += row
            node *= width
            node += flat[index]
            node[:] = after[node]
        return node


class Node(NamedTuple):
    """``sums`` are weight, sum and sum of squares (None: of a leaf at the last level, unknown);
    ``feature`` None is a leaf; ``at`` is the last value that goes left, or the flag's."""

    sums: tuple[float, float, float | None]
    feature: int | None = None
    at: int = 0
    gain: float = -1.0
    left: int = -1


def coded(
    df: DataFrame, cuts: dict[str, list[float]], labels: dict[str, list[str]], plan: Layout, others: list[str]
) -> DataFrame:
    """The codes of each row (``code_columns``) and ``others``. The features of the layout are the
    numbers of ``cuts``, whose bins are Bucketizer's, the last one of missing numbers, and the
    texts of ``labels`` by their place, the last one for texts that are none of them."""
    kind = df.select(*others).schema
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((len(plan.widths), batch.num_rows), np.int32)
            for f, name in enumerate([*cuts, *labels]):
                if name in cuts:
                    x = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                    value = np.where(np.isnan(x), len(cuts[name]) + 1, np.searchsorted(cuts[name], x, side="right"))
                else:
                    text = batch.column(name)
                    value = pc.fill_null(pc.index_in(text, pa.array(labels[name], text.type)), len(labels[name])).to_numpy()
                found[plan.code[f]] += (value * plan.stride[f]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, found), *(batch.column(c) for c in others)], [*code_columns(plan), *others])

    session.in_workers(df.sparkSession)
    schema = StructType([*(StructField(c, IntegerType()) for c in code_columns(plan)), *kind])
    return df.select(*cuts, *labels, *others).mapInArrow(codes, schema)


def code_columns(plan: Layout) -> list[str]:
    return [f"_code_{i}" for i in range(len(plan.widths))]


def pack(df: DataFrame, plan: Layout) -> DataFrame:
    """Blocks of the rows of ``code_columns``, _y_class, _y_log and _n, with their number of rows
    and their weight."""
    def block(held: list[pa.RecordBatch], rows: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        column = lambda name: table.column(name).to_numpy()
        codes = np.stack([column(c).astype(plan.kind) for c in code_columns(plan)])
        sign, target, weight = (column(c).astype(np.float64) for c in ("_y_class", "_y_log", "_n"))
        if not np.isin(sign, (0, 1)).all():
            raise ValueError("a class must be 0 or 1")
        parts = [codes, (sign * 2 - 1).astype(np.int8), target, weight if (weight != 1).any() else weight[:0]]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([rows]), pa.array([weight.sum()])],
            ["codes", "sign", "target", "weight", "rows", "total"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - rows)
                batch = batch.slice(part.num_rows)
                held, rows = [*held, part], rows + part.num_rows
                if rows == BLOCK_ROWS:
                    yield block(held, rows)
                    held, rows = [], 0
        if rows:
            yield block(held, rows)

    session.in_workers(df.sparkSession)
    return df.select(*code_columns(plan), "_y_class", "_y_log", "_n").mapInArrow(
        blocks, "codes binary, sign binary, target binary, weight binary, rows bigint, total double")


def _opened(row, plan: Layout) -> Block:
    sign, target = np.frombuffer(row.sign, np.int8), np.frombuffer(row.target, np.float64)
    return Block(
        np.frombuffer(row.codes, plan.kind).reshape(-1, len(sign)), np.frombuffer(row.weight, np.float64) if row.weight else None, sign,
        np.zeros(len(sign)), target)


def _targets(block: Block, first: bool) -> list[np.ndarray]:
    """What the next tree of each model fits: the negative gradient of the logistic loss and
    of the squares, at first the targets."""
    if first:
        return [block.sign.astype(np.float64), block.residual]
    with np.errstate(over="ignore"):  # far beyond the right side nothing is left
        return [4.0 * block.sign / (1.0 + np.exp(2.0 * block.sign * block.raw)), block.residual]


def _after(block: Block, trees: list[Tree], rate: float, first: bool) -> Block:
    added = [t.value[t.leaf(block.codes)] for t in trees]
    left = 2.0 * (block.residual - added[1]) if first else block.residual - 2.0 * rate * added[1]
    return block._replace(raw=block.raw + (1.0 if first else rate) * added[0], residual=left)


def _histograms(
    blocks: Iterable[Block], plan: Layout, trees: list[Tree], opened: list[np.ndarray], first: bool, parts: tuple = (0, 1)
) -> list[np.ndarray]:
    """Per model, the ``parts`` (0 weight, 1 sum, 2 sum of squares, others stay 0) of each value of
    each feature in its open nodes, and after them the sum of squares of each node."""
    depth = max(parts) + 1
    total = [[np.zeros((depth, len(nodes), w)) for w in plan.widths] for nodes in opened]
    squares = [np.zeros(len(nodes)) for nodes in opened]
    for block in blocks:
        index = np.empty(len(block.sign), np.int64)
        for m, (tree, nodes, target) in enumerate(zip(trees, opened, _targets(block, first))):
            k = len(nodes)
            if not k:
                continue
            place = np.full(len(tree.value), k)  # rows in closed nodes go to a place after the open ones
            place[nodes] = np.arange(k)
            at = place[tree.leaf(block.codes)]
            sums = target if block.weight is None else target * block.weight
            weights = (block.weight, sums, sums * target)
            squares[m] += np.bincount(at, weights[2], k + 1)[:k]
            for c, width in enumerate(plan.widths):
                np.multiply(at, width, out=index)
                index += block.codes[c]
                for i in parts:
                    total[m][c][i] += np.bincount(index, weights[i], (k + 1) * width)[:k * width].reshape(k, width)
    out = []
    for summed, square, nodes in zip(total, squares, opened):
        found = np.zeros((depth, len(nodes), plan.starts[-1] + 1))
        for f, start in enumerate(plan.starts[:-1]):
            size, stride = plan.sizes[f], plan.stride[f]
            part = summed[plan.code[f]].reshape(depth, len(nodes), plan.widths[plan.code[f]] // (size * stride), size, stride)
            found[:, :, start:start + size] = part.sum(axis=(2, 4))
        found[1, :, -1] = square
        out.append(found)
    return out


def _added(rows: RDD, measure: Callable) -> list[np.ndarray]:
    """The sum of ``measure`` over partitions, always in their order."""
    add = lambda parts: [sum(p[1:], p[0]) for p in zip(*[v for _, v in sorted(parts, key=lambda x: x[0])])]
    tasks = rows.getNumPartitions()
    found = rows.mapPartitionsWithIndex(lambda i, blocks: [(i, measure(blocks))])
    if tasks > DIRECT_TASKS:
        groups = int(tasks ** 0.5)
        found = found.map(lambda x: (x[0] % groups, x)).groupByKey(groups).mapValues(lambda v: add(list(v)))
    return add(found.collect())


def _best(found: np.ndarray, plan: Layout, least: float) -> tuple[Node, tuple | None]:
    """A node from its histogram, and the ``sums`` left and right of its split if it has one."""
    weights, sums, square = found[0, :-1], found[1, :-1], found[1, -1]
    first = slice(0, plan.sizes[0])
    weight, total = weights[first].sum(), sums[first].sum()
    base, best = total * total / weight, (ROUNDING * square, None, 0, None)
    for f, start in enumerate(plan.starts[:-1]):
        w, s = weights[start:start + plan.sizes[f] - 1], sums[start:start + plan.sizes[f] - 1]
        # right of a flag are its rows, left of a number those up to it
        lw, ls = (weight - w, total - s) if plan.flags[f] else (np.cumsum(w), np.cumsum(s))
        rw, rs = weight - lw, total - ls
        fits = (lw >= least) & (rw >= least)
        if fits.any():
            gains = np.where(fits, ls * ls / np.where(fits, lw, 1) + rs * rs / np.where(fits, rw, 1) - base, -1.0)
            i = int(gains.argmax())
            if gains[i] > best[0]:
                best = (gains[i], f, i, ((lw[i], ls[i], None), (rw[i], rs[i], None)))
    gain, feature, at, sides = best
    if sides and len(found) > 2:
        squares = found[2, plan.starts[feature]:plan.starts[feature + 1]]
        value = np.arange(len(squares))
        right = value == at if plan.flags[feature] else value > at
        sides = tuple((*side[:2], squares[there].sum()) for side, there in zip(sides, (~right, right)))
    return Node((weight, total, square), feature, at, gain / weight if sides else -1.0), sides


def _compiled(nodes: list[Node], plan: Layout) -> Tree:
    after = np.repeat(np.arange(len(nodes))[:, None], max(plan.widths), axis=1)
    code, deep = np.zeros(len(nodes), np.int64), [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n.feature is not None:
            values = plan.values(n.feature)
            right = values == n.at if plan.flags[n.feature] else values > n.at
            code[i], after[i, :len(values)] = plan.code[n.feature], n.left + right
            deep[n.left] = deep[n.left + 1] = deep[i] + 1
    value = np.array([n.sums[1] / n.sums[0] if n.sums[0] else 0.0 for n in nodes])
    return Tree(code, after.astype(np.min_scalar_type(len(nodes))), value, max(deep))


def _ends(sums: tuple[float, float, float | None], least: float) -> bool:
    """Whether no split of a node can be found: too few rows, or they don't differ."""
    weight, total, square = sums
    return weight < 2 * least or square is not None and square - total * total / weight <= ROUNDING * square


def _grown(
    rows: RDD, plan: Layout, models: int, depth: int, least: float, first: bool, root: list[np.ndarray]
) -> Iterator[list[list[Node]]]:
    """The models' next trees after each pass over the rows, a level a pass. ``root`` holds the
    weights of all rows, the same for every tree, once a pass has found them. Nodes that
    end by their parent's histogram are in no later pass."""
    grown = [[Node((0.0, 0.0, None))] for _ in range(models)]
    opened = [np.array([0]) for _ in grown]
    for level in range(max(depth, 1)):
        trees = [_compiled(nodes, plan) for nodes in grown]
        # the last level's children end anyway
        parts = (*(() if root and not level else (0,)), 1, *((2,) if level + 1 < depth else ()))
        found = _added(rows, lambda blocks, o=opened: _histograms(blocks, plan, trees, o, first, parts))
        if not level:
            root[:] = root or [found[0][0].copy()]
            for part in found:
                part[0] = root[0]
        for m, nodes in enumerate(grown):
            children = []
            for k, at in enumerate(opened[m].tolist()):
                node, sides = _best(found[m][:, k], plan, least)
                if sides is None or not depth:
                    nodes[at] = node._replace(feature=None, gain=-1.0)
                    continue
                nodes[at] = node._replace(left=len(nodes))
                children += [len(nodes) + i for i, sums in enumerate(sides) if not _ends(sums, least)]
                nodes += map(Node, sides)
            opened[m] = np.array(children, np.int64)
        yield grown
        if not any(map(len, opened)):
            return


def boost(
    blocks: DataFrame, plan: Layout, rounds: int, rate: float, depth: int, least: float, tasks: int
) -> list[list[list[Node]]]:
    """The trees of both models: of the class and of _y_log. Leaves hold at least ``least`` weight.

    Rows are kept with what the models have learned, as Spark's trainers do, whenever the trees
    that are not in them yet have more than ``KEPT_LEVELS`` levels, and checkpointed every few
    rounds; until then each pass goes through those trees. The first pass after that also makes the
    rows; those before go when it is over."""
    spark, kept = blocks.sparkSession, StorageLevel.MEMORY_AND_DISK
    rows = blocks.rdd.map(lambda row: _opened(row, plan)).coalesce(tasks).persist(kept)
    models: list[list[list[Node]]] = [[], []]
    before, files, root = None, [], []
    pending: list[tuple[list[Tree], bool]] = []
    for i in range(rounds):
        learned = rows if not pending else _learned(rows, pending, rate)
        for grown in _grown(learned, plan, len(models), depth, least, i == 0, root):
            if before is not None:
                before.unpersist()
                before = None
                if rows.is_checkpointed:
                    for path in files:
                        delete(spark, path)
                    files = [rows.getCheckpointFile()]
        for trees, nodes in zip(models, grown):
            trees.append(nodes)
        pending = [*pending, ([_compiled(nodes, plan) for nodes in grown], i == 0)]
        checkpoint = (i + 1) % CHECKPOINT_ROUNDS == 0
        if checkpoint or sum(t.depth for trees, _ in pending for t in trees) > KEPT_LEVELS:
            before, rows, pending = rows, _learned(rows, pending, rate).persist(kept), []
            if checkpoint:
                rows.checkpoint()
    for kept_rows in (before, rows):
        if kept_rows is not None:
            kept_rows.unpersist()
    for path in files:
        delete(spark, path)
    return models


def _learned(rows: RDD, pending: list[tuple[list[Tree], bool]], rate: float) -> RDD:
    def after(block: Block) -> Block:
        for trees, first in pending:
            block = _after(block, trees, rate, first)
        return block

    return rows.map(after)


def as_model(estimator, spark: SparkSession, trees: list[list[Node]], plan: Layout, rate: float):
    """A model of Spark's with these trees, which stores, loads and scores as any: the estimator
    is fitted to a single row, and the stored form of its model is given the trees."""
    rounds, depth = estimator.getMaxIter(), estimator.getMaxDepth()
    row = spark.createDataFrame(
        [(Vectors.sparse(plan.columns[-1], []), 0.0, 0.0, 1.0)], [estimator.getFeaturesCol(), "_y_class", "_y_log", "_n"])
    stub = estimator.copy({estimator.maxIter: 1, estimator.maxDepth: 0}).fit(row)
    path = session.scratch_path(spark, "trees")
    stub.write().save(f"{path}/stub")
    about = json.loads(spark.read.text(f"{path}/stub/metadata").first()[0])
    about["numTrees"] = rounds
    about["paramMap"] |= {"maxIter": rounds, "maxDepth": depth}
    nodes, names = (spark.read.parquet(f"{path}/stub/{part}") for part in ("data", "treesMetadata"))

    def stored(tree: int, at: int, n: Node) -> tuple:
        weight, total, square = (float("nan") if x is None else float(x) for x in n.sums)
        impurity = max(square / weight - (total / weight) ** 2, 0.0) if square == square else square
        split = (-1, [], -1)
        if n.feature is not None:
            flag = plan.flags[n.feature]
            split = (plan.columns[n.feature] + (n.at if flag else 0), [0.5 if flag else n.at + 0.5], -1)
        right = n.left + 1 if n.left >= 0 else -1
        return (tree, (at, total / weight, impurity, [weight, total, square], int(weight), float(n.gain), n.left, right, split))

    listed = [stored(i, at, n) for i, tree in enumerate(trees) for at, n in enumerate(tree)]
    spark.createDataFrame(listed, nodes.schema).coalesce(1).write.parquet(f"{path}/model/data")
    name = names.first()[1]
    spark.createDataFrame([(i, name, rate if i else 1.0) for i in range(rounds)], names.schema).coalesce(1).write.parquet(
        f"{path}/model/treesMetadata")
    spark.range(1).select(F.lit(json.dumps(about)).alias("value")).write.text(f"{path}/model/metadata")
    model = type(stub).load(f"{path}/model")
    delete(spark, path)
    return model
