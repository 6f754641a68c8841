"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to unit length, so cosine >= c means a squared distance of at most 2 - 2c.  They are rotated, and the
rotated dimensions are dealt into blocks.  If every block's squared distance exceeded its proportional part of the
budget the whole would exceed the budget, so each linked pair is within budget in at least one block.  This holds
for any rotation; the one taken has the principal axes of a sample of at most `FIT_ROWS` vectors, dealt in turn, so
each block has its part of the wide axes and begins with them.

Each block is range-joined.  Its first coordinates are cut into slabs as wide as the block's radius, and cells of such
slabs are the keys that vectors are dealt by: a vector is a member of its own cell and visits those neighbours
(half of them, as the others visit it) that its radius reaches.  How many coordinates make up cells is chosen by the sample
so that the fewest rows are sent.  Within a cell the first four coordinates are a finer grid, and only rows whose grid
cells the radius reaches are compared.  What travels is a class id and the rotated vector in half precision; members of pairs
that may be linked as far as it tells, its rounding allowed for, are fetched whole and compared in double precision.
Of the blocks that find a pair the first one counts it.

Vectors that are equal component by component form one class, and only classes are joined, so copies are not
paired.  A cell that holds very many is dealt into parts, each with two of its chunks: every pair meets in one
part and no task holds more than two chunks.  Parts return the number of links of each class and one link
per member to the first of its component, not pairs.

The work is that of the pairs that meet in some block's grid.  On vectors without structure that is about as many
as there are pairs at all, so it grows with their square there.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; repeated rows link as copies; rows without an id count as linked
vectors but name no component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import BROADCAST_KEYS, connected_components, for_python, lean
from ledgerlens.scratch import scope, written

#: Dimensions of a block, how many of its coordinates make up cells at most and grids, and rows of a cell in one chunk.
BLOCK_DIMS, COORDINATES, CHUNK = 8, 4, 16384
#: Cells of a grid to a block's radius: finer grids compare fewer pairs, but in smaller pieces and so more slowly.
FINE = 1
#: Bound of the sample that the rotation and the cells are chosen by, in vectors.
FIT_ROWS = 4096
#: Slack of a block's squared-distance budget for rounding; what passes is verified.
SLACK = 1e-6
#: Rows of a grid cell compared at once, and pairs verified at once.
TILE, STRETCH = 256, 1 << 16
_PLACE = "dims int, block int, cell long, visit int, class long"


class Layout:
    """Rotation, blocks and cells for vectors of one length."""

    def __init__(self, dims: int, cosine: float, sample: np.ndarray | None = None, rows: float = 0):
        self.dims, self.cosine, self.coords = dims, cosine, 1
        if sample is None or len(sample) < 2:
            basis = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]
        else:
            basis = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dims, dims))[1][:, ::-1]
        count = -(-dims // BLOCK_DIMS)
        turns = [range(k, dims, count) for k in range(count)]
        self.rotation = np.ascontiguousarray(basis[:, [c for t in turns for c in t]])
        ends = np.cumsum([len(t) for t in turns]).tolist()
        self.blocks = [slice(e - len(t), e) for e, t in zip(ends, turns)]
        if sample is not None and len(sample):
            self.coords = self._fewest(sample @ self.rotation, rows / len(sample))

    def budget(self, block: slice) -> float:
        """Squared distance that one block may have, with slack for rounding."""
        return (2 - 2 * self.cosine) * (block.stop - block.start) / self.dims + SLACK

    def cells(self, turned: np.ndarray, block: slice, coords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the row, cell, and whether it visits: each row in its own cell and in those that it visits."""
        coords = min(coords, block.stop - block.start)
        at = turned[:, block.start : block.start + coords] / np.sqrt(self.budget(block))
        own = np.floor(at).astype(np.int64)
        low = at - own
        # slabs are at least 0.001 wide and coordinates at most 1, so twelve bits hold each one's number
        number = lambda slabs: sum((slabs[:, c] + 2048) << (12 * c) for c in range(coords))
        rows, cells, visits = [np.arange(len(at))], [number(own)], [np.zeros(len(at), np.int32)]
        for step in product((-1, 0, 1), repeat=coords):
            if step > (0,) * coords:
                gap = sum((1 - low[:, c] if s > 0 else low[:, c]) ** 2 for c, s in enumerate(step) if s)
                near = np.flatnonzero(gap <= 1)
                rows.append(near)
                cells.append(number(own[near] + np.array(step)))
                visits.append(np.ones(len(near), np.int32))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(visits)

    def _fewest(self, turned: np.ndarray, times: float) -> int:
        """The number of coordinates under which the fewest rows are sent, chunks of large cells included."""
        sent = {}
        for coords in range(1, COORDINATES + 1):
            counts = [np.unique(self.cells(turned, b, coords)[1], return_counts=True)[1] * times for b in self.blocks]
            sent[coords] = sum((n * np.maximum(1, n / CHUNK)).sum() for n in counts)
        return min(sent, key=sent.get)


def layouts(classes: DataFrame, cosine: float) -> dict[int, Layout]:
    """Layouts by length, for the lengths that stand in a sample of at most `FIT_ROWS` vectors."""
    count = classes.count()
    sample = [r[0] for r in classes.orderBy(F.xxhash64("vector"), "vector").select("vector").limit(FIT_ROWS).collect()]
    found = {}
    for dims in {len(v) // 8 for v in sample}:
        held = _unit(np.frombuffer(b"".join(v for v in sample if len(v) == 8 * dims), np.float64).reshape(-1, dims))
        found[dims] = Layout(dims, cosine, held, count * len(held) / len(sample))
    return found


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _placed(layout_of, with_body: bool):
    """Rows (dims, block, cell, visit, class) of classes (class, vector), with the rotated vector in half precision if asked for."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
            for dims in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dims)
                layout = layout_of(dims)
                turned = _unit(np.frombuffer(b"".join(blobs[i] for i in rows), np.float64).reshape(-1, dims)) @ layout.rotation
                name = batch.column(0).take(pa.array(rows))
                halves = turned.astype(np.float16)
                body = pa.array([x.tobytes() for x in halves], pa.binary())
                for k, block in enumerate(layout.blocks):
                    row, cell, visit = layout.cells(turned, block, layout.coords)
                    fixed = [pa.array(np.full(len(row), v, np.int32)) for v in (dims, k)]
                    columns = [*fixed, pa.array(cell), pa.array(visit), name.take(pa.array(row))]
                    yield pa.RecordBatch.from_arrays(columns + [body.take(pa.array(row))] * with_body, names=["dims", "block", "cell", "visit", "class", "body"][: 5 + with_body])

    return run


def _first_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links a-b, the least node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _steps(width: int) -> list[tuple[tuple, int]]:
    """For grid cells `FINE` to a radius: the steps by all but the last coordinate that the radius reaches, each with how far it then reaches by the last."""
    out = []
    for step in product(range(-FINE, FINE + 1), repeat=width - 1):
        left = FINE**2 - sum(max(0, abs(s) - 1) ** 2 for s in step)
        if left >= 0:
            out.append((step, int(np.sqrt(left)) + 1 if left < FINE**2 else FINE))
    return out


def _neighbours(here: np.ndarray, left: np.ndarray, right: np.ndarray, radius: float):
    """Of two lists of rows, stretches of the first and the rows of the second that may be within `radius` of them by the block's first coordinates."""
    grid = np.floor(here[:, :COORDINATES] * (FINE / radius)).astype(np.int64) + (1 << 13)
    width = grid.shape[1]
    place = lambda step: sum(int(s) << (15 * (width - 1 - c)) for c, s in enumerate(step))
    number = sum(grid[:, c] << (15 * (width - 1 - c)) for c in range(width))
    left, right = left[np.argsort(number[left], kind="stable")], right[np.argsort(number[right], kind="stable")]
    ordered = number[right]
    starts = np.flatnonzero(np.diff(number[left], prepend=-1))
    around = _steps(width)
    lowest = np.array([place((*step, -far)) for step, far in around])
    highest = np.array([place((*step, far)) for step, far in around])
    for a, b in zip(starts, [*starts[1:], len(left)]):
        centre = number[left[a]]
        lows, highs = np.searchsorted(ordered, centre + lowest, "left"), np.searchsorted(ordered, centre + highest, "right")
        held = np.flatnonzero(highs > lows)
        if len(held):
            met = np.concatenate([right[lows[h] : highs[h]] for h in held])
            for i in range(a, b, TILE):
                yield left[i : min(b, i + TILE)], met


def _near(here: np.ndarray, visit: np.ndarray, mine: np.ndarray, pair: int, budget: float):
    """Index pairs of one cell's part whose block distance is within budget, each once; visitors are not paired with each other."""
    own, other = pair >> 32, pair & 0xFFFFFFFF
    members = visit == 0
    rows = np.flatnonzero
    if own == other:
        sides = [(rows(members), rows(members), True), (rows(members), rows(~members), False)]
    else:
        sides = [(rows(members & (mine == own)), rows(mine == other), False), (rows(~members & (mine == own)), rows(members & (mine == other)), False)]
    square = np.einsum("ij,ij->i", here, here)
    ones = np.ones_like(square)
    a_side, b_side = np.column_stack([-2 * here, square, ones]), np.column_stack([here, ones, square])
    for left, right, same in sides:
        if len(left) and len(right):
            for some, met in _neighbours(here, left, right, np.sqrt(budget)):
                a, b = np.divmod(np.flatnonzero(a_side[some] @ b_side[met].T <= budget), len(met))
                a, b = some[a], met[b]
                if same:
                    once = a < b
                    a, b = a[once], b[once]
                for i in range(0, len(a), STRETCH):
                    yield a[i : i + STRETCH], b[i : i + STRETCH]


def _rounded(budget: float) -> float:
    """A squared-distance budget with what half precision may add to it, for vectors of at most unit length."""
    apart = 2.0**-10
    return (np.sqrt(budget) + apart) ** 2 + SLACK


def _parts(batches, columns: list[str]):
    """The rows of each (dims, block, cell, pair), which come sorted by these: the key, and arrays and lists of `columns`."""
    key, held = None, []

    def whole():
        return [sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in range(4)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            now = tuple(int(k[a]) for k in keys) if b > a else key
            if now != key and held:
                yield key, whole()
                held = []
            if b > a:
                part = batch.slice(a, b - a)
                key = now
                held.append([part.column(c).to_pylist() if c in ("body", "vector") else part.column(c).to_numpy() for c in columns])
    if held:
        yield key, whole()


def _candidates(layout_of):
    """Of each part, the rows (dims, block, cell, pair, visit, mine, class) that may be linked with another one."""

    def run(batches):
        for (dims, k, cell, pair), (visit, mine, name, body) in _parts(batches, ["visit", "mine", "class", "body"]):
            if len(name) < 2:
                continue
            layout = layout_of(dims)
            turned = np.frombuffer(b"".join(body), np.float16).reshape(-1, dims).astype(np.float32)
            block = layout.blocks[k]
            found, most = np.zeros(len(name), bool), _rounded(2 - 2 * layout.cosine)
            for a, b in _near(np.ascontiguousarray(turned[:, block]), visit, mine, pair, _rounded(layout.budget(block))):
                near = ((turned[a] - turned[b]) ** 2).sum(axis=1) <= most
                found[a[near]] = found[b[near]] = True
            if found.any():
                n = int(found.sum())
                fixed = [pa.array(np.full(n, v, t)) for v, t in ((dims, np.int32), (k, np.int32), (cell, np.int64), (pair, np.int64))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(visit[found]), pa.array(mine[found]), pa.array(name[found])], names=["dims", "block", "cell", "pair", "visit", "mine", "class"])

    return run


def _links(layout_of):
    """Of each part, the number of links of its rows that its block counts, and a link from each to the first of its component."""

    def run(batches):
        for (dims, k, _, pair), (visit, mine, name, weight, vector) in _parts(batches, ["visit", "mine", "class", "weight", "vector"]):
            layout = layout_of(dims)
            unit = _unit(np.frombuffer(b"".join(vector), np.float64).reshape(-1, dims))
            turned = unit @ layout.rotation
            block = layout.blocks[k]
            links, first = np.zeros(len(name), np.int64), np.arange(len(name))
            for a, b in _near(np.ascontiguousarray(turned[:, block]), visit, mine, pair, layout.budget(block)):
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= layout.cosine
                a, b = a[near], b[near]
                for n, part in enumerate(layout.blocks[: k + 1]):
                    # tighter than the join by half the slack: what a block has by this rule its join has found
                    has = ((turned[a, part] - turned[b, part]) ** 2).sum(axis=1) <= layout.budget(part) - SLACK / 2
                    a, b = (a[has], b[has]) if n == k else (a[~has], b[~has])
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                apart = first[a] != first[b]
                if apart.any():
                    first = _first_of(len(name), first[a[apart]], first[b[apart]])[first]
            met = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(name[met]), pa.array(name[first[met]]), pa.array(links[met])], names=["src", "dst", "links"])

    return run


def linked(classes: DataFrame, cosine: float) -> DataFrame:
    """Rows (src, dst, links) of classes (class, vector, weight): what each part of a cell has found."""
    found = classes.sparkSession.sparkContext.broadcast(layouts(classes, cosine))

    def layout_of(dims: int) -> Layout:
        if dims not in found.value:
            found.value[dims] = Layout(dims, cosine)
        return found.value[dims]

    vectors = classes.select("class", "vector")
    key = ["dims", "block", "cell"]
    counts = vectors.mapInArrow(_placed(layout_of, False), _PLACE).groupBy(*key).agg(F.count("*").alias("held")).where(F.col("held") > CHUNK)
    large = written(counts.select(*key, F.ceil(F.col("held") / CHUNK).cast("int").alias("chunks")))
    few = large.count() <= BROADCAST_KEYS
    placed = vectors.mapInArrow(_placed(layout_of, True), f"{_PLACE}, body binary")
    parts = placed.join(F.broadcast(large) if few else large.hint("merge"), key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    parts = parts.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = parts.withColumn("pair", F.shiftleft(F.least("mine", "other").cast("long"), 32).bitwiseOR(F.greatest("mine", "other").cast("long")))
    key = [*key, "pair"]
    columns = [*key, "visit", "mine", "class"]
    parts = parts.select(*columns, "body").repartition(*key).sortWithinPartitions(*key)
    some = written(parts.mapInArrow(lean(_candidates(layout_of)), "dims int, block int, cell long, pair long, visit int, mine int, class long"))
    whole = some.join(classes, "class").select(*columns, "weight", "vector").repartition(*key).sortWithinPartitions(*key)
    return written(whole.mapInArrow(lean(_links(layout_of)), "src long, dst long, links long"))


def components(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Rows (vec_id, n_links, component_id), one per row of `vectors`; `cosine` is above 0."""
    for_python(vectors.sparkSession)
    values = F.col(vector).cast("array<double>")
    sound = F.coalesce((F.size(values) > 0) & F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(values, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(sound, F.transform(values, lambda x: x + 0.0)).alias("values"))
    with scope(vectors.sparkSession) as lasting:
        rows = written(rows.mapInArrow(_packed, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, vector binary"))
        classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
        classes = written(classes.withColumn("class", F.monotonically_increasing_id()))
        found = linked(classes, cosine)
        links = found.groupBy("src").agg(F.sum("links").alias("links"))
        of = connected_components(found.where("src <> dst"))
        named = classes.join(links.withColumnRenamed("src", "class"), "class", "left").join(of.select(F.col("node").alias("class"), "component"), "class", "left")
        named = written(named.select("vector", "first_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("root")))
        least = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
        named = named.join(least, "root").select("vector", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
        joined = rows.where("vector is not null").join(written(named), "vector").select("vec_id", "n_links", "component_id")
        alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return lasting(joined.unionByName(alone))


def _packed(batches):
    """Vectors as bytes of doubles, for joins and for numpy."""
    for batch in batches:
        lists = batch.column(1)
        blobs = [None if v is None else np.asarray(v, np.float64).tobytes() for v in lists.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["vec_id", "vector"])
