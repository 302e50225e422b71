"""Near-duplicate vectors by lattice hashing (operator 2).

Each of several tables projects unit vectors onto random orthonormal directions, eight for each E8 block,
scales them and decodes each block to its nearest E8 lattice point; the points name a cell.  A vector
lives in one cell of each table and also visits the neighbouring cells that are nearest to it (the
minimal vectors of E8 best aligned with what decoding left over).  Where it lives or visits it is
compared by cosine, in double precision, with those that live there.  Found links are exact; a link may
be missed if no table brings the two together (measured recall: README).

Equal vectors are one class with a count, so a large group of copies is one vector here.  A link may be
found in several tables: it counts in the first table, and there in one cell, which both sides' cell names
tell, so links are counted where they are found and pairs never leave a task; a task sends degrees and
a spanning forest.  A crowded cell is split into blocks, each pair of blocks a task of its own.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id,
link with nothing; vectors of different lengths never link; repeated rows each count as a vector; the
input's other columns, labels included, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import U64, groups, mix
from palimpsest.llm.shared import components, saved

#: Members of a cell that one task compares with as many others.
BLOCK = 1024
#: Rows of crowded cells up to which their table is broadcast.
BROADCAST_ROWS = 50_000


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1, or all of 1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.vstack([*out, signs[(signs < 0).sum(1) % 2 == 0] / 2])


MINIMAL = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    off = x[odd] - r[odd]
    k = np.abs(off).argmax(1)
    r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is the even integer points and those moved by 1/2 in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Cells:
    """Cell names of unit vectors of one length."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int):
        r = np.random.default_rng([seed, dim])
        self.tables, self.blocks, self.probes, self.scale = tables, blocks, probes, scale * (dim / 64) ** 0.5
        width = 8 * blocks
        self.turn = []
        for _ in range(tables):
            q = np.linalg.qr(r.standard_normal((max(dim, width), width)))[0][:dim]
            self.turn.append((q, r.uniform(0, 1, width)))
        self.name = r.integers(1, 1 << 63, width, dtype=np.uint64) | U64(1)
        self.salt = r.integers(0, 1 << 63, tables, dtype=np.uint64)

    def _named(self, points: np.ndarray, table: int) -> np.ndarray:
        """points: twice the lattice coordinates, n x width."""
        with np.errstate(over="ignore"):
            return mix((points.astype(np.int64).view(U64) * self.name).sum(-1, dtype=U64) + self.salt[table])

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(homes n x tables, visits n x tables x probes)."""
        n = len(unit)
        homes = np.empty((n, self.tables), U64)
        visits = np.empty((n, self.tables, self.probes), U64)
        for t, (q, shift) in enumerate(self.turn):
            x = unit @ q * self.scale + shift
            parts = [nearest_e8(x[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)]
            point = np.rint(2 * np.hstack(parts)).astype(np.int64)
            homes[:, t] = self._named(point, t)
            gain = np.hstack([(x[:, 8 * b : 8 * b + 8] - p) @ MINIMAL.T for b, p in enumerate(parts)])
            best = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
            for k in range(self.probes):
                moved = point.copy()
                for b in range(self.blocks):
                    rows = np.flatnonzero(best[:, k] // 240 == b)
                    moved[rows, 8 * b : 8 * b + 8] += np.rint(2 * MINIMAL[best[rows, k] % 240]).astype(np.int64)
                visits[:, t, k] = self._named(moved, t)
        return homes, visits


_cells: dict[tuple, Cells] = {}


def cells_of(*key) -> Cells:
    if key not in _cells:
        _cells[key] = Cells(*key)
    return _cells[key]


def near_vectors(vectors: DataFrame, at_least: float = 0.95, tables: int = 5, blocks: int = 2, probes: int = 4, scale: float = 3.0, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns id_col, n_links, component_id and kept for each row; blocks: E8 blocks in a cell's name."""
    setting = (tables, blocks, probes, scale, seed)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    usual = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("cls", F.when(F.coalesce(usual & F.col("id").isNotNull(), F.lit(False)), F.xxhash64("v")))
    classes = saved(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v")).select("rep", "m", "v"))

    def named(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one length at a time: their numbers, vectors, homes and visits."""
        column = batch.column(2)
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.values.to_numpy(zero_copy_only=False)
        starts = column.offsets.to_numpy()[:-1]
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = flat[starts[at][:, None] + np.arange(dim)]
            big = np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
            unit = x / big
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            yield at, x / big, *cells_of(int(dim), *setting).of(unit)

    def key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, homes, visits in named(batch):
                keys, counts = np.unique(np.concatenate([homes.ravel(), visits.ravel()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, ms = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, x, homes, visits in named(batch):
                sign = np.concatenate([homes[:, :, None], visits], axis=2)  # n x tables x (1 + probes)
                n, per = len(at), tables * (1 + probes)
                body = [r.tobytes() for r in x]
                names = [r.tobytes() for r in sign]
                step = max(1, (8 << 20) // (8 * x.shape[1] + 8 * per) // per)
                for i in range(0, n, step):
                    j = min(n, i + step)
                    rep = lambda c: [c[k] for k in range(i, j) for _ in range(per)]  # noqa: B023
                    yield pa.RecordBatch.from_arrays([
                        pa.array(sign[i:j].reshape(-1).view(np.int64)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), j - i)), pa.array(np.tile(np.arange(1 + probes) == 0, tables * (j - i))),
                        pa.array(np.repeat(reps[at[i:j]], per)), pa.array(np.repeat(ms[at[i:j]], per)), pa.array(rep(body), pa.binary()), pa.array(rep(names), pa.binary()),
                    ], names=["key", "t", "home", "rep", "m", "v", "names"])

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        """Links between the rows of each cell's pair of blocks, counted in their first cell only."""
        cell, side = table["cell"].to_numpy(), table["side"].to_numpy()
        order = np.lexsort((side, cell))
        table = table.take(pa.array(order))
        cell, side, home = cell[order], side[order], table["home"].to_numpy()
        rep, m, t = table["rep"].to_numpy(), table["m"].to_numpy(), table["t"].to_numpy()
        here = table["key"].to_numpy().view(np.uint64)
        body, names = table["v"].combine_chunks(), table["names"].combine_chunks()
        degree: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.setdefault(x, x)) != x:
                root[x] = x = root[p]
            return x

        for _, at in groups(cell):
            s = side[at]
            left, right = np.arange(at.start, at.stop)[s == 0], np.arange(at.start, at.stop)[s == 1]
            right = right[home[right]]
            if not len(left) or not len(right):
                continue
            width = np.array([len(body[i].as_buffer()) for i in (*left, *right)])
            if (width != width[0]).any():  # names of cells of different lengths fell together
                continue
            x, y = (np.frombuffer(b"".join(body[int(i)].as_py() for i in w)).reshape(len(w), -1) for w in (left, right))
            cos = x @ y.T / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None])
            a, b = np.nonzero(cos >= at_least)
            a, b = left[a], right[b]
            # two that both live here are seen from either side
            a, b = (z[(rep[a] < rep[b]) | ~home[a] & (rep[a] != rep[b])] for z in (a, b))
            if not len(a):
                continue
            used, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
            sign = np.frombuffer(b"".join(names[int(i)].as_py() for i in used), np.uint64).reshape(len(used), tables, 1 + probes)
            for k in range(0, len(a), 65536):
                p, q = inverse[k : k + 65536], inverse[len(a) + k : len(a) + k + 65536][: len(a) - k]
                p = p[: len(q)]
                hp, hq = sign[p, :, 0], sign[q, :, 0]
                both = hp == hq
                to_q, to_p = (sign[p, :, 1:] == hq[:, :, None]).any(2), (sign[q, :, 1:] == hp[:, :, None]).any(2)
                first = (both | to_q | to_p).argmax(1)
                row = np.arange(len(p))
                both, to_q, to_p = both[row, first], to_q[row, first], to_p[row, first]
                i, j = a[k : k + len(p)], b[k : k + len(p)]
                lives = home[i]
                mine = np.where(both, lives, ~lives & (~to_p | (rep[i] < rep[j]))) & (t[i] == first) & (here[i] == hq[row, first])
                for u, w, mu, mw in zip(rep[i][mine].tolist(), rep[j][mine].tolist(), m[i][mine].tolist(), m[j][mine].tolist(), strict=True):
                    degree[u] = degree.get(u, 0) + mw
                    degree[w] = degree.get(w, 0) + mu
                    ru, rw = find(u), find(w)
                    if ru != rw:
                        root[max(ru, rw)] = min(ru, rw)
        trees = [(x, find(x)) for x in root]
        return pa.table({"a": pa.array([*degree, *(x for x, _ in trees)], pa.int64()), "b": pa.array([*([None] * len(degree)), *(r for _, r in trees)], pa.int64()), "n": pa.array([*degree.values(), *([0] * len(trees))], pa.int64())})

    crowded = classes.mapInArrow(key_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    crowded = saved(crowded.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    if crowded.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    kind = "key long, t int, home boolean, rep long, m long, v binary, names binary"
    entries = classes.mapInArrow(entered, kind).join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), "parts").cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    task = lambda x, i, j: F.struct(F.lit(x).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    sides = F.flatten(F.array(F.transform(every, lambda k: task(0, own, k)), F.when(F.col("home"), F.transform(every, lambda k: task(1, k, own))).otherwise(F.array().cast("array<struct<side:int,i:int,j:int>>"))))
    dealt = entries.withColumn("x", F.explode(sides)).select("key", "t", "home", "rep", "m", "v", "names", F.col("x.side").alias("side"), F.xxhash64("key", "x.i", "x.j").alias("cell"))
    n_tasks = max(1, classes.count() * tables * (1 + probes) // 20_000)
    found = saved(dealt.groupBy(F.pmod("cell", F.lit(n_tasks)).alias("task")).applyInArrow(compared, "a long, b long, n long"))
    degree = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("degree"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    state = saved(classes.select("rep", "m").join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left"))
    ids = rows.select("id", "cls")
    of_class = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep")).join(state, "rep")
    out = ids.join(of_class, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("rep").isNull(), 0).otherwise(F.col("m") - 1 + F.coalesce("degree", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep", "id").alias("component_id"), (F.coalesce("component", "rep", "id") == F.col("id")).alias("kept"))
