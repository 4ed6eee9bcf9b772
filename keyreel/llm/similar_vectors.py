"""The most similar vectors of every vector by collision counting with virtual rehashing.

Every random direction is a single-projection sorted array. A vector is kept in the ``tails`` arrays in which it lies
furthest out: there a window around it holds the fewest vectors and a near one is likeliest to lie in it. Two vectors are
laid against each other where they meet in the windows of two arrays. Then their collisions are counted: the projections on
a random orthonormal basis, stored in a byte each, that lie in a window around the query's. Windows start narrow and are
widened level by level (virtual rehashing: radius after radius, with a window and a collision threshold computed for each);
a vector for which a level has brought k vectors within its radius opens no wider window. Those that collide often enough
are ranked by the stored projections while the arrays are read, and only the best of every vector leave a task; these are
verified by exact cosine.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.session import BROADCAST_ROWS, cut_table

#: Random directions; each is two arrays, one for either tail. Up to DENSE vectors the least number serves.
LEAST_DIRECTIONS = 2048
#: Arrays in which a vector is kept, with the least number of directions and the radius RADIUS; the recall computed for these is kept at every size.
TAILS, RADIUS = 8, 0.90
#: Cosines of the levels of virtual rehashing before the last one, the radius asked for.
LEVELS = (0.98, 0.95)
#: Half-width of a counting window in standard deviations of what a pair at the level's radius differs by in a projection, and the deviations by which such a pair may miss its expected collisions.
WIDTH, SPARE = 1.0, 3.5
#: Candidates that leave a task for every neighbour asked for: their ranks come from projections in bytes, exact cosines decide.
RANKED = 3
#: Rows of one array from which on it is split by the second array, and of one such cell from which on it is split in groups laid against each other.
HOT_ROWS = 100_000
SEED = 20_240_229
#: Steps of a stored projection value in units of the standard deviation.
_STEPS = 32
#: Steps of a byte on the orthonormal basis, in units of the standard deviation: bytes reach to four deviations on either side.
_BYTE = 127 / 4


def _directions(dim: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((dim, n)).astype(np.float32)
    return a / np.linalg.norm(a, axis=0)


def _basis(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + 3).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def levels_of(dim: int, at_least: float) -> list[tuple[float, int, int, int]]:
    """(cosine, window in an array, window of a byte, collisions needed) of each level, narrowest first; the last is at the radius."""
    out = []
    inside = math.erf(WIDTH / math.sqrt(2))
    for cos in [c for c in LEVELS if c > at_least] + [at_least]:
        apart = math.sqrt(2 - 2 * cos)
        need = math.floor(dim * inside - SPARE * math.sqrt(dim * inside * (1 - inside)))
        out.append((cos, math.ceil(_STEPS * 3.2 * apart), math.ceil(_BYTE * WIDTH * apart), max(1, need)))
    return out


def directions_for(rows: int) -> int:
    """Grows with the square root of the rows, so that the pairs meeting twice stay in proportion to the rows."""
    return max(LEAST_DIRECTIONS, 1 << math.ceil(math.log2(max(1.0, 3.0 * math.sqrt(rows)))))


@functools.cache
def windows_needed(directions: int, dim: int, at_least: float, pairs: int = 8000, seed: int = SEED + 2) -> np.ndarray:
    """Of simulated pairs with this cosine, in ascending order, the number of windows a vector with which each pair meets in two arrays."""
    a, rng, out = _directions(dim, directions), np.random.default_rng(seed), []
    most = min(directions, 512)
    for _ in range(0, pairs, 200):
        x = _unit(rng.standard_normal((200, dim)))
        y = rng.standard_normal((200, dim))
        y = _unit(y - (y * x).sum(1, keepdims=True) * x)
        ranks = []
        for h in (x @ a, (at_least * x + math.sqrt(1 - at_least**2) * y) @ a):
            top = np.argpartition(-np.abs(h), most - 1, axis=1)[:, :most]
            top = np.take_along_axis(top, np.argsort(-np.abs(np.take_along_axis(h, top, 1)), axis=1), 1)
            ranks.append(top * 2 + (np.take_along_axis(h, top, 1) < 0))
        for p, q in zip(*ranks):
            _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
            met = np.sort(np.maximum(i, j) + 1)
            out.append(met[1] if len(met) > 1 else most + 1)
    return np.sort(out)


def tails_for(directions: int, dim: int, at_least: float) -> int:
    """The fewest windows, TAILS at least, with which the computed recall at the radius is what TAILS give at RADIUS with the least number of directions."""
    if directions <= LEAST_DIRECTIONS and at_least >= RADIUS:
        return TAILS
    wanted = np.searchsorted(windows_needed(LEAST_DIRECTIONS, dim, RADIUS), TAILS, side="right")
    tails = max(TAILS, int(windows_needed(directions, dim, at_least)[wanted - 1]))
    if tails >= min(directions, 512):
        raise ValueError(f"too few arrays for a cosine of {at_least}")
    return tails


def _unit(values: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(values.astype(np.float64), axis=1, keepdims=True)
    return (values / norm).astype(np.float32)


def usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite values and isn't all zero."""
    square = F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.where((F.size(vec) == dim) & (square > 0) & (square < F.lit(float("inf"))))


def signatures(vectors: DataFrame, dim: int, directions: int, tails: int) -> DataFrame:
    """(space, row, ckey, sig, code): the vector's arrays in ascending order; the same with its place in them and its projections on the basis, as bytes.

    ``ckey`` is equal for vectors of one direction, whatever their length (up to rounding). Unusable vectors are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, basis = _directions(dim, directions), _basis(dim)
        step = max(16, min(1024, (1 << 21) // directions))  # rows whose projections are held at once
        mix = np.random.default_rng(SEED + 1).integers(1, 1 << 62, size=dim, dtype=np.int64) | 1
        scale = math.sqrt(dim) * _STEPS
        for batch in batches:
            vec = batch.column(2)
            lens = pa.compute.list_value_length(vec).fill_null(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(lens == dim)
            if not len(keep):
                continue
            part = batch.take(pa.array(keep)) if len(keep) < batch.num_rows else batch
            vals = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            size = np.square(vals.astype(np.float64)).sum(1)
            fine = np.flatnonzero(np.isfinite(size) & (size > 0))
            if len(fine) < part.num_rows:
                part, vals = part.take(pa.array(fine)), vals[fine]
            for lo in range(0, part.num_rows, step):
                unit = _unit(vals[lo : lo + step])
                h = unit @ a
                far = np.abs(h)
                top = np.argpartition(far, directions - tails, axis=1)[:, directions - tails :]
                value = np.take_along_axis(h, top, 1)
                sig = top * 2 + (value < 0)
                order = np.argsort(sig, axis=1)
                sig = np.take_along_axis(sig, order, 1).astype(np.int32)
                place = np.clip(np.take_along_axis(np.abs(value), order, 1) * scale, 0, 255).astype(np.uint8)
                counted = np.clip(np.round(unit @ basis * (math.sqrt(dim) * _BYTE)) + 128, 0, 255).astype(np.uint8)
                ckey = (np.round(unit.astype(np.float64) * 20_000).astype(np.int64) * mix).sum(1)
                n = len(unit)
                code = np.ascontiguousarray(np.concatenate((sig.astype(_sig_type(directions)).view(np.uint8).reshape(n, -1), place, counted), axis=1))
                ends = lambda width: np.arange(0, (n + 1) * width, width, dtype=np.int32)
                codes = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends(code.shape[1])), pa.py_buffer(code)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(lo, n), part.column(1).slice(lo, n), pa.array(ckey), pa.ListArray.from_arrays(pa.array(ends(tails)), pa.array(sig.ravel())), codes],
                    ["space", "row", "ckey", "sig", "code"],
                )

    return vectors.mapInArrow(run, "space string, row long, ckey long, sig array<int>, code binary")


def _sig_type(directions: int) -> type:
    return np.uint16 if 2 * directions <= 1 << 16 else np.uint32


#: Rows that are laid out at once at least, and pairs whose collisions are counted at once.
CHUNK_ROWS, CHUNK_PAIRS = 100_000, 1 << 15
#: Rows of two arrays from which on they are laid against each other in blocks of so many.
DENSE = 512


def _meeting(batches: Iterator[pa.RecordBatch], directions: int, tails: int, dim: int, k: int, at_least: float) -> Iterator[pa.RecordBatch]:
    """The best candidates of a partition that is sorted by cell: whole cells are laid out as soon as they are there."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table, last: bool) -> int:
        """Rows up to the start of the last cell, which may go on."""
        if last:
            return table.num_rows
        same = np.ones(table.num_rows, bool)
        for name in ("space", "array", "second", "pair"):
            c = table.column(name)
            same &= pa.compute.equal(c, c[table.num_rows - 1]).to_numpy(zero_copy_only=False)
        return int(table.num_rows - np.argmin(same[::-1])) if not same.all() else 0

    def lay(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        table = pa.Table.from_batches(held)
        to = cut(table, last)
        if to:
            yield from _pairs(table.slice(0, to), directions, tails, dim, k, at_least)
        rest = table.slice(to)
        held, n = (rest.combine_chunks().to_batches() if rest.num_rows else []), 0

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield from lay(False)
    if held:
        yield from lay(True)


class _Best:
    """The most similar candidates of every row so far; what is held is bounded by ``most`` a row and a buffer."""

    def __init__(self, most: int, rows: int) -> None:
        self.most, self.new, self.n = most, [], 0
        self.least = np.full(rows, -2.0, np.float32)  # what a row's next candidate must exceed
        self.who, self.other, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def add(self, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> None:
        self.new += [(a, b, sim), (b, a, sim)]
        self.n += 2 * len(a)
        if self.n > max(1 << 20, 2 * len(self.who)):
            self.settle()

    def settle(self) -> None:
        if not self.n:
            return
        who, other, sim = (np.concatenate((x, *(t[i] for t in self.new))) for i, x in enumerate((self.who, self.other, self.sim)))
        order = np.lexsort((other, -sim, who))
        who, other, sim = who[order], other[order], sim[order]
        new = np.concatenate(([True], (who[1:] != who[:-1]) | (other[1:] != other[:-1])))  # a wider window holds what a narrower one held
        who, other, sim = who[new], other[new], sim[new]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        full = rank == self.most - 1
        self.least[who[full]] = sim[full]
        top = rank < self.most
        self.who, self.other, self.sim, self.new, self.n = who[top], other[top], sim[top], [], 0

    def with_at_least(self, k: int, sim: float, size: int) -> np.ndarray:
        """Which rows have ``k`` candidates of this similarity."""
        self.settle()
        return np.bincount(self.who[self.sim >= sim], minlength=size) >= k


def _pairs(table: pa.Table, directions: int, tails: int, dim: int, k: int, at_least: float) -> Iterator[pa.RecordBatch]:
    """(space, row, other, sim): of every row the best of those it meets in two windows and collides with often enough; a pair is told in one array only."""
    table = table.combine_chunks()
    spaces = pa.compute.dictionary_encode(table.column("space")).combine_chunks()
    spaces = spaces.chunk(0) if isinstance(spaces, pa.ChunkedArray) else spaces
    space = spaces.indices.to_numpy().astype(np.int64)
    own, second, pair, group, row = (table.column(c).to_numpy().astype(np.int64) for c in ("array", "second", "pair", "group", "row"))
    packed = table.column("code").combine_chunks()
    packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
    width = tails * np.dtype(_sig_type(directions)).itemsize
    size = width + tails + dim
    raw = np.frombuffer(packed.buffers()[2], np.uint8)[np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] :][: len(own) * size].reshape(-1, size)
    sig = np.ascontiguousarray(raw[:, :width]).view(_sig_type(directions)).astype(np.int32)
    far = raw[:, width : width + tails].astype(np.int16)
    basis = np.ascontiguousarray(raw[:, width + tails :])
    unit = basis.astype(np.float32) - 128
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    del table, packed
    at_own = (sig == own[:, None]).argmax(1)
    here = far[np.arange(len(own)), at_own]
    cells, who, place = [], [], []
    # Cells: rows of one space, array, second array and pair of groups.
    order = np.lexsort((pair, own, space))
    change = np.concatenate(([True], (np.diff(space[order]) != 0) | (np.diff(own[order]) != 0) | (np.diff(pair[order]) != 0)))
    cell = np.empty(len(own), np.int64)
    cell[order] = np.cumsum(change)
    for i in range(1, tails):
        m = np.flatnonzero((i > at_own) & ((second < 0) | (sig[:, i] == second)))
        cells.append((cell[m] << 25) | sig[m, i].astype(np.int64))
        who.append(m)
        place.append(here[m])
    key, who, place = np.concatenate(cells), np.concatenate(who), np.concatenate(place)
    order = np.lexsort((place, key))
    key, who, place = key[order], who[order], place[order]
    within = (pair >> 20) == (pair & 0xFFFFF)  # else only rows of different groups are laid against each other
    # A row is here once for each of its cells; what one cell has brought bounds what others need look for.
    order = np.lexsort((row, space))
    one = np.empty(len(row), np.int64)
    one[order] = np.cumsum(np.concatenate(([False], (np.diff(row[order]) != 0) | (np.diff(space[order]) != 0))))
    shown = np.empty(one[order[-1]] + 1, np.int64)
    shown[one] = np.arange(len(row))
    best, closed = _Best(RANKED * k, len(shown)), np.zeros(len(shown), bool)
    levels = levels_of(dim, at_least)
    widest = levels[-1][1]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    sparse = np.flatnonzero(np.repeat(sizes < DENSE, sizes))

    def tell(a: np.ndarray, b: np.ndarray, keys: np.ndarray, byte: int, need: int) -> None:
        """Pairs that could be among the best of either row: those that collide often enough, where they meet first."""
        for lo in range(0, len(a), CHUNK_PAIRS):
            r, s, t = a[lo : lo + CHUNK_PAIRS], b[lo : lo + CHUNK_PAIRS], keys[lo : lo + CHUNK_PAIRS]
            x, y = basis[r], basis[s]
            near = np.flatnonzero(np.count_nonzero(np.maximum(x, y) - np.minimum(x, y) <= byte, axis=1) >= need)
            r, s, t = r[near], s[near], t[near]
            sim = np.einsum("ij,ij->i", unit[r], unit[s])
            fine = np.flatnonzero((sim >= at_least - 0.02) & (sim > np.minimum(best.least[one[r]], best.least[one[s]])))
            r, s, t, sim = r[fine], s[fine], t[fine], sim[fine]
            # The pair is told only in the two lowest arrays in which each lies in the other's widest window.
            same = (sig[r][:, :, None] == sig[s][:, None, :]) & (np.abs(far[r][:, :, None] - far[s][:, None, :]) <= widest)
            low = np.where(same.any(2), sig[r], 1 << 30)
            low.sort(axis=1)
            first = (own[r] == low[:, 0]) & ((t & ((1 << 25) - 1)) == low[:, 1])
            best.add(one[r[first]], one[s[first]], sim[first])

    for cos, window, byte, need in levels:
        p, d = sparse, 0
        while True:
            d += 1
            p = p[p + d < len(key)]
            p = p[key[p] == key[p + d]]
            p = p[place[p + d] - place[p] <= window]
            if not len(p):
                break
            a, b = who[p], who[p + d]
            due = np.flatnonzero(~(closed[one[a]] & closed[one[b]]) & ((group[a] != group[b]) | within[a]) & (row[a] != row[b]))
            tell(a[due], b[due], key[p[due]], byte, need)
        closed |= best.with_at_least(k, cos, len(shown))
    # Where two arrays hold many rows, these are laid against each other in blocks by their stored projections, at the widest
    # window; only what can be among the best of a row goes on to be counted: for the others there are better ones.
    for start, size in zip(starts[sizes >= DENSE], sizes[sizes >= DENSE]):
        w, at = who[start : start + size], place[start : start + size]
        twice, apart = len(np.unique(row[w])) < size, not within[w].all()
        for lo in range(0, size, DENSE):
            hi = min(lo + DENSE, size)
            end = int(np.searchsorted(at, at[hi - 1] + widest, side="right"))
            mine, theirs = w[lo:hi], w[lo:end]
            sim = unit[mine] @ unit[theirs].T
            sim[:, : hi - lo][np.tril(np.ones((hi - lo, hi - lo), bool))] = -2
            if at[end - 1] - at[lo] > widest:
                sim[at[None, lo:end] - at[lo:hi, None] > widest] = -2
            if twice:
                sim[row[mine][:, None] == row[theirs][None, :]] = -2
            if apart:
                sim[(group[mine][:, None] == group[theirs][None, :]) & ~within[mine][:, None]] = -2
            hit = np.zeros(sim.shape, bool)
            for axis, least in ((1, best.least[one[mine]][:, None]), (0, best.least[one[theirs]][None, :])):
                able = sim > np.maximum(least, at_least - 0.02)
                if np.count_nonzero(able) > 4 * best.most * (hi - lo) and sim.shape[axis] > best.most:
                    able &= sim >= np.partition(sim, sim.shape[axis] - best.most, axis=axis).take([sim.shape[axis] - best.most], axis=axis)
                hit |= able
            i, j = np.nonzero(hit)
            tell(mine[i], theirs[j], np.full(len(i), key[start]), levels[-1][2], levels[-1][3])
        best.settle()
    best.settle()
    if len(best.who):
        who, other = shown[best.who], shown[best.other]
        yield pa.RecordBatch.from_arrays([spaces.dictionary.take(pa.array(space[who])).cast(pa.string()), pa.array(row[who]), pa.array(row[other]), pa.array(best.sim.astype(np.float64))], ["space", "row", "other", "sim"])


def _bounded(rows: DataFrame, other: DataFrame, on: list[str], how: str, count: int) -> DataFrame:
    return rows.join(F.broadcast(other) if count <= BROADCAST_ROWS else other, on, how)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays in double precision."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def similar_pairs(vectors: DataFrame, *, space: str, row: str, vec: str, dim: int, k: int, at_least: float, directions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (space, a, b, sim) of class representatives with cosine of at least ``at_least`` in which either is among the likely ``k`` nearest of the other, and copies (space, rep, row).

    At most RANKED x k pairs are written for a vector, however many lie within the radius.

    Vectors of one direction form a class whose representative is the lowest row; ``copies`` has the members of classes of
    two or more, the representative included. Null vectors, other lengths, NaN, infinite and all-zero ones take no part.
    """
    base = vectors.where(F.col(space).isNotNull() & F.col(row).isNotNull() & F.col(vec).isNotNull()).select(F.col(space).cast("string").alias("space"), F.col(row).cast("long").alias("row"), F.col(vec).cast("array<float>").alias("vec"))
    directions = directions or directions_for(base.count())
    tails = tails_for(directions, dim, at_least)
    sigs = cut_table(signatures(base, dim, directions, tails))
    classes = sigs.groupBy("space", "ckey").agg(F.min("row").alias("rep"), F.max("row").alias("last")).where("rep < last").drop("last")
    classes = cut_table(classes)
    n_classes = classes.count()
    copies, reps = classes.select("space", "rep", F.col("rep").alias("row")).limit(0), sigs
    if n_classes:
        joined = _bounded(sigs, classes, ["space", "ckey"], "left", n_classes)
        reps = joined.where("rep IS NULL OR rep = row").drop("rep")
        copies = _bounded(sigs.select("space", "row", "ckey"), classes, ["space", "ckey"], "inner", n_classes).select("space", "rep", "row").distinct()
    # At most two arrays for each direction and space, whatever the rows: the counts are bounded.
    entry = reps.select("space", "row", "sig", "code", F.explode(F.slice("sig", 1, tails - 1)).alias("array"))
    def hot_of(rows: DataFrame, cols: list[str]) -> DataFrame:
        # Few: there are at most as many as rows by HOT_ROWS.
        return cut_table(rows.groupBy(*cols).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS))

    hot = hot_of(entry, ["space", "array"])
    if hot.count():
        entry = entry.join(F.broadcast(hot), ["space", "array"], "left")
        later = F.filter("sig", lambda s: s > F.col("array"))
        entry = entry.withColumn("second", F.explode(F.when(F.col("n").isNotNull(), later).otherwise(F.array(F.lit(-1))))).drop("n")
        cells = hot_of(entry.where("second >= 0"), ["space", "array", "second"])
    else:
        entry, cells = entry.withColumn("second", F.lit(-1)), None
    if cells is not None and cells.count():
        # A cell that is still hot is cut in groups of rows; every two groups meet in a task of their own.
        entry = entry.join(F.broadcast(cells), ["space", "array", "second"], "left").withColumn("groups", F.least(F.lit((1 << 20) - 1), F.ceil(F.coalesce("n", F.lit(1)) / HOT_ROWS)).cast("int"))
        entry = entry.withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        entry = entry.withColumn("pair", F.least("group", "x") * (1 << 20) + F.greatest("group", "x")).drop("n", "groups", "x")
    else:
        entry = entry.withColumn("group", F.lit(0)).withColumn("pair", F.lit(0))
    cell = ["space", "array", "second", "pair"]
    entry = entry.select(*cell, "group", "row", "code").repartition(*cell).sortWithinPartitions(*cell)
    meet = entry.mapInArrow(lambda it: _meeting(it, directions, tails, dim, k, at_least), "space string, row long, other long, sim double")
    # A vector has at most RANKED x k candidates in each of its few cells.
    best = meet.withColumn("n", F.row_number().over(W.partitionBy("space", "row").orderBy(F.desc("sim"), "other"))).where(F.col("n") <= RANKED * k)
    pairs = cut_table(best.select("space", F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct())
    ends = cut_table(pairs.select("space", F.explode(F.array("a", "b")).alias("row")).distinct())
    of = cut_table(_bounded(base, ends, ["space", "row"], "left_semi", ends.count()).dropDuplicates(["space", "row"]))
    verified = pairs.join(of.select("space", F.col("row").alias("a"), F.col("vec").alias("va")), ["space", "a"]).join(of.select("space", F.col("row").alias("b"), F.col("vec").alias("vb")), ["space", "b"])
    return cut_table(verified.select("space", "a", "b", cosine(F.col("va"), F.col("vb")).alias("sim")).where(F.col("sim") >= at_least)), copies


def similar_neighbours(vectors: DataFrame, *, space: str, row: str, vec: str, dim: int, k: int, at_least: float) -> DataFrame:
    """(space, row, neighbour, sim, place): for every vector its at most ``k`` most similar ones with cosine of at least ``at_least``.

    Ties go to the lower row. Members of a class of copies have each other as neighbours first (the ``k`` lowest rows
    serve); a class, however large, is never expanded into its pairs.
    """
    pairs, copies = similar_pairs(vectors, space=space, row=row, vec=vec, dim=dim, k=k, at_least=at_least)
    both = pairs.select("space", F.col("a").alias("row"), F.col("b").alias("neighbour"), "sim").unionByName(pairs.select("space", F.col("b").alias("row"), F.col("a").alias("neighbour"), "sim"))
    lowest = W.partitionBy("space", "rep").orderBy("row")
    heads = copies.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k + 1).select("space", "rep", F.col("row").alias("head"))
    # Every class is shown by its lowest rows; a vector without copies is its own class.
    shown = both.join(heads.select("space", F.col("rep").alias("neighbour"), "head"), ["space", "neighbour"], "left").select("space", "row", F.coalesce("head", "neighbour").alias("neighbour"), "sim")
    shown = shown.join(copies.select("space", F.col("rep").alias("row"), F.col("row").alias("member")), ["space", "row"], "left").select("space", F.coalesce("member", "row").alias("row"), "neighbour", "sim")
    inside = copies.join(heads, ["space", "rep"]).where("row <> head").select("space", "row", F.col("head").alias("neighbour"), F.lit(1.0).alias("sim"))
    ranked = shown.unionByName(inside).withColumn("place", F.row_number().over(W.partitionBy("space", "row").orderBy(F.desc("sim"), "neighbour")))
    return ranked.where(F.col("place") <= k)


#: Vectors and queries in a block of the exhaustive last level, and the parts over which the vectors of one query block are spread.
BLOCK, ASKED_BLOCK, PARTS = 4096, 16_384, 12


def _pack(dim: int, size: int):
    """Rows (space, block, rows, vecs) of up to ``size`` vectors of one space as they are stored, from rows (space, row, vec)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[pa.RecordBatch]] = {}

        def give(s: str, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal n
            whole = pa.Table.from_batches(held.pop(s))
            at = 0
            while whole.num_rows - at >= least and at < whole.num_rows:
                piece = whole.slice(at, size)
                at += piece.num_rows
                flat = piece.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([part + n], pa.int64()), pa.array([piece.column(1).to_numpy().tobytes()]), pa.array([flat.tobytes()])], ["space", "block", "rows", "vecs"])
                n += 1
            if at < whole.num_rows:
                held[s] = whole.slice(at).to_batches()

        for batch in batches:
            for s in pa.compute.unique(batch.column(0)).to_pylist():
                held.setdefault(s, []).append(batch.filter(pa.compute.equal(batch.column(0), s)))
                yield from give(s, size)
        for s in list(held):
            yield from give(s, 1)

    return pack


def _best(dim: int, k: int):
    """Per query block the k best of the vector blocks that follow it in a sorted partition, kept while they stream by."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, qr, q, sim, near = None, None, None, None, None

        def told() -> Iterator[pa.RecordBatch]:
            if own is None:
                return
            got = sim > -2
            yield pa.RecordBatch.from_arrays([pa.array([own[0]] * int(got.sum()), pa.string()), pa.array(np.repeat(qr, got.sum(1))), pa.array(near[got]), pa.array(sim[got])], ["space", "row", "neighbour", "sim"])

        for batch in batches:
            for r in batch.to_pylist():
                rows, vecs = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["vecs"], np.float32).reshape(-1, dim).astype(np.float64)
                vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
                key = (r["space"], r["asked_block"], r["part"])
                if not r["is_vector"]:
                    yield from told()
                    own, qr, q = key, rows, vecs
                    sim, near = np.full((len(q), k), -2.0), np.zeros((len(q), k), np.int64)
                    continue
                if key != own:
                    continue
                for lo in range(0, len(q), 1024):
                    s = q[lo : lo + 1024] @ vecs.T
                    s[qr[lo : lo + 1024, None] == rows[None, :]] = -2
                    # Only queries for which some vector of the block beats or equals their k-th so far are looked at.
                    ahead = np.flatnonzero(s.max(1) >= sim[lo : lo + 1024].min(1) - 1e-12)
                    if not len(ahead):
                        continue
                    both = np.concatenate((sim[lo + ahead], np.round(s[ahead], 12)), axis=1)
                    names = np.concatenate((near[lo + ahead], np.broadcast_to(rows, (len(ahead), len(rows)))), axis=1)
                    top = np.argpartition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                    least = np.take_along_axis(both, top, 1).min(1)
                    for i in np.flatnonzero(((both >= least[:, None]).sum(1) > k) & (least > -2)):  # more equal ones than places: the lowest rows
                        level = np.flatnonzero(both[i] >= least[i])
                        top[i] = level[np.lexsort((names[i, level], -both[i, level]))][:k]
                    sim[lo + ahead], near[lo + ahead] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        yield from told()

    return best


def nearest_of_queries(vectors: DataFrame, *, space: str, row: str, vec: str, dim: int, k: int, query: Column) -> DataFrame:
    """(space, row, neighbour, sim, place): the ``k`` most similar vectors of each row for which ``query`` holds, without a radius.

    This is exhaustive search and does not use the arrays: the query set is laid against all rows in blocks, by matrix product. A block of queries meets the vectors in ``PARTS``
    tasks, each of which keeps k rows per query while its vectors stream by; only these are merged. Exact; ties (to twelve places) go to the lower row. A row given twice counts once.
    """
    base = usable(vectors.where(F.col(space).isNotNull() & F.col(row).isNotNull()), vec, dim).select(F.col(space).cast("string").alias("space"), F.col(row).cast("long").alias("row"), F.col(vec).cast("array<float>").alias("vec"), query.alias("asked"))
    base = cut_table(base.dropDuplicates(["space", "row"]))
    schema = "space string, block long, rows binary, vecs binary"
    blocks = base.select("space", "row", "vec").mapInArrow(_pack(dim, BLOCK), schema)
    # Queries are brought together per space, in as many tasks as make blocks of full size.
    n_asked = base.where("asked").count()
    few = base.where("asked").select("space", "row", "vec").repartition(max(1, min(200, n_asked // ASKED_BLOCK + 1)), "space", F.pmod(F.xxhash64("row"), F.lit(max(1, n_asked // (4 * ASKED_BLOCK)))))
    asked = cut_table(few.mapInArrow(_pack(dim, ASKED_BLOCK), schema))
    ids = asked.select("space", F.col("block").alias("asked_block"))
    cols = ["space", "asked_block", "part", "is_vector", "rows", "vecs"]
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    theirs = asked.select("space", F.col("block").alias("asked_block"), F.lit(False).alias("is_vector"), "rows", "vecs", parts).select(*cols)
    ours = blocks.join(_small(ids), "space").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int")).withColumn("is_vector", F.lit(True)).select(*cols)
    work = theirs.unionByName(ours).repartition("space", "asked_block", "part").sortWithinPartitions("space", "asked_block", "part", "is_vector")
    found = work.mapInArrow(_best(dim, k), "space string, row long, neighbour long, sim double")
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("space", "row").orderBy(F.desc("sim"), "neighbour")))
    return ranked.where(F.col("place") <= k)


def _small(df: DataFrame) -> DataFrame:
    """A table that is broadcast where its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
