"""For every vector the k most similar vectors of a collection; what the index misses is found too.

Method: *permutation index*, whose answer is then proved or mended. A vector is represented by its nearest pivots in order. It is posted
in the inverted files of the first few of them; a query reads the files of its nearest pivots,
ranks what it finds there by the footrule distance of the two orders of pivots, and reranks the
best by exact cosine.

The index has two levels. Centres, one near to every vector, are found in bounded samples of what
isn't covered yet; the first of them are outer pivots and make regions. A vector goes to the
regions of the outer pivots nearest to its centre, so a cluster stays together. Each region is
indexed by the task that gets it: it has pivots of its own, as many as its vectors need, and
inverted files by those. So the number of pivots grows with the number of vectors, while no task
sees more than its region. A region of too many vectors is divided on the executors, by pivots
chosen among its own vectors, as often as it takes. Vectors of about one direction in great number
are represented in it by as many as can be among the nearest of any of them.

What the index finds is a bound: the k nearest of a query are no further away than the k-th found.
Every vector belongs to one cell, that of its nearest centre, of known radius; a query reads its
own cell and all others that the triangle inequality of angles doesn't rule out, in full. So
whatever the index missed is found, at a cost that grows with what the bounds leave open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.session import attach_hot_aware, cut_lineage


@dataclass
class IndexSettings:
    """Parameters of the index; the defaults are those of production."""

    k: int = 10
    sample: int = 65_536  # vectors to find centres in at most, each round
    max_pivots: int = 16_384  # outer pivots
    separation: float = 0.8  # outer pivots are less similar to each other than this
    vectors_a_pivot: int = 16  # there are no more outer pivots than that many vectors give
    posts: int = 3  # regions that hold a vector, at most; besides the first only such as its cell reaches into
    region: int = 65_536  # a region of more vectors than this is divided
    prefix: int = 12  # length of the order of pivots; 22 at most, so that footrule fits a byte
    file: int = 384  # vectors that an inverted file should hold
    probes: int = 8  # inverted files that a query reads
    least_pivots: int = 48  # pivots of a small region
    most_pivots: int = 4_096  # pivots of a large one
    rerank: int = 384  # candidates of a file that footrule leaves for exact similarity, at most
    rerank_share: float = 0.9  # of the file, at most; but four times k at least
    crowd: int = 1_000  # vectors of about one direction that are too many to index each
    centres: int = 1_048_576  # cells at most; fewer than the vectors have clusters make the search slower, not less exact
    block: int = 131_072  # vectors of a cell that a task compares with as many queries at once


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 as float32; scaled by the largest element first, so nothing overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _doubles(vectors: np.ndarray) -> np.ndarray:
    """In double precision. Squares of what were doubles could overflow, so these are scaled, by powers of two: nothing is rounded."""
    if vectors.dtype != np.float64:
        return vectors.astype(np.float64)
    power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]
    return vectors * np.ldexp(1.0, np.clip(-power, -1000, 1000))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows as SQL takes them: in double precision, rounded to 6 decimals, halves away from zero.

    What is next to a half is summed up again in the order of elements, as the last bit decides there.
    """
    x, y = _doubles(x), _doubles(y)
    millionths = 1e6 * (np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)))
    half = np.flatnonzero(np.abs(np.abs(millionths - np.trunc(millionths)) - 0.5) < 1e-6)
    if len(half):
        dot, xx, yy = (np.add.accumulate(a[half] * b[half], axis=1)[:, -1] for a, b in ((x, y), (x, x), (y, y)))
        millionths[half] = 1e6 * (dot / np.sqrt(xx * yy))
    whole = np.trunc(millionths)
    return np.clip((whole + np.copysign(np.abs(millionths - whole) >= 0.5, millionths)) / 1e6 + 0.0, -1, 1)


def id_order(ids: pa.Array) -> np.ndarray:
    """A number for each id, in their order; equal for equal ones. (Strings of numpy lose a NUL at their end.)"""
    return pc.rank(ids, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def thin(units: np.ndarray, separation: float, most: int) -> np.ndarray:
    """The rows in order, without those that are too similar to one kept before; ``most`` at most."""
    kept = np.zeros((0, units.shape[1]), dtype=np.float32)
    for s in range(0, len(units), 512):
        block = units[s : s + 512]
        if len(kept):
            block = block[(block @ kept.T).max(axis=1) < separation]
        near = block @ block.T >= separation
        free = np.ones(len(block), dtype=bool)
        for i in range(len(block)):
            if free[i]:
                free[i + 1 :] &= ~near[i, i + 1 :]
        kept = np.vstack([kept, block[free]])
        if len(kept) >= most:
            break
    return kept[:most]


def nearest_pivots(units: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the ``length`` most similar pivots of each row, in order."""
    length = min(length, len(pivots))
    out = np.empty((len(units), length), dtype=np.int32)
    for s in range(0, len(units), 512):
        near = units[s : s + 512] @ pivots.T
        if length < len(pivots):
            some = np.argpartition(near, len(pivots) - length, axis=1)[:, -length:]
        else:
            some = np.broadcast_to(np.arange(length), near.shape)
        order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out[s : s + 512] = np.take_along_axis(some, order, axis=1)
    return out


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors) of the usable rows of a list column: ``size`` finite numbers, not all zero."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    right = np.flatnonzero(lengths == size)
    if not len(right):
        return right, np.zeros((0, size))
    flat = column.take(pa.array(right)).flatten()
    vectors = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    return right[good], vectors[good]


POSTED = "file long, is_query boolean, id string, vector binary"


def _rows(ids: pa.Array, values: np.ndarray, pick: np.ndarray, files: np.ndarray, query: np.ndarray) -> pa.RecordBatch:
    raw = np.ascontiguousarray(values[pick])
    vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1] * raw.itemsize), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(files.astype(np.int64)), pa.array(query), ids.take(pa.array(pick)), vectors], names=["file", "is_query", "id", "vector"])


def post_batches(batches: Iterator[pa.RecordBatch], centres: Centres, regions: np.ndarray, wanted: np.ndarray, size: int, settings: IndexSettings) -> Iterator[pa.RecordBatch]:
    """Each usable vector once for every wanted region that holds it, as a query in the first of them; ``regions``: those of each centre, in order.

    Vectors go where their centre goes, so a cluster that is no outer pivot's stays together. A region of -1 is none.
    """
    for batch in batches:
        where, vectors = _vectors(batch.column("vector"), size)
        if not len(where):
            continue
        ids = batch.column("id").take(pa.array(where))
        order = regions[centres.near(unit_rows(vectors), settings.separation)[0]]
        for rank in range(order.shape[1]):
            there = np.flatnonzero((order[:, rank] >= 0) & wanted[order[:, rank]])
            yield _rows(ids, vectors, there, order[there, rank], np.full(len(there), rank == 0))


def _binary(table: pa.Table, name: str, size: int) -> np.ndarray:
    """A column of vectors of ``size`` numbers in bytes; a float each or a double each."""
    column = table.column(name).combine_chunks()
    width = len(column[0].as_py())
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64 if width == 8 * size else np.float32)
    return raw.reshape(-1, size)


def inner_file(file: int, pivot: np.ndarray) -> np.ndarray:
    """The number of the part of a region that belongs to a pivot of it: mixed, so that parts of all levels differ."""
    x = np.full(len(pivot), file, dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pivot.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).astype(np.int64)


def divide_long(posted: DataFrame, size: int, settings: IndexSettings) -> DataFrame:
    """Regions of more than ``region`` vectors divided until none is longer.

    Each round samples the vectors of a long region by hash for pivots, four for what a part
    should hold, and posts its members to the nearest ones, queries as queries in each: a dense
    cluster has no good places to be cut at. Members are salted over tasks, pivots are copied to every salt; the driver learns only whether a long region is left. A round that
    finds no shorter parts (more copies of a direction than a region holds, which crowds exclude)
    would not end, so a region is left as it is after eight; eight rounds divide by 4,096 each.
    """
    done = cut_lineage(posted)
    for level in range(8):
        sizes = cut_lineage(done.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") > settings.region))
        if not sizes.limit(1).count():
            break
        wanted = F.least(F.ceil(F.col("n") * (4 * settings.posts) / settings.region) + 2, F.lit(settings.most_pivots))
        plan = sizes.select("file", "n", (wanted / F.col("n")).alias("rate"), F.ceil(F.col("n") / 20_000).cast("int").alias("salts"))
        members = attach_hot_aware(done, plan, "file", "n")
        lot = F.shiftrightunsigned(F.xxhash64(F.lit(level), "id"), 1) / F.lit(float(1 << 63))
        chosen = members.filter(lot < F.col("rate")).groupBy("file", "salts").agg(F.collect_list("vector").alias("pivots"))  # at most about 4,096 a region
        pivots = chosen.select(F.col("file").alias("of"), "pivots", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"))
        salted = members.select("file", "is_query", "id", "vector", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"))

        def post(rows: pa.Table, own: pa.Table) -> pa.Table:
            if not rows.num_rows or not own.num_rows:  # no pivot was drawn: the region stays for the next round
                return rows.select(["file", "is_query", "id", "vector"])
            vectors = _binary(rows, "vector", size)
            chosen = own.column("pivots")[0].as_py()
            among = unit_rows(np.frombuffer(b"".join(chosen), dtype=vectors.dtype).reshape(-1, size))
            order = nearest_pivots(unit_rows(vectors), among, settings.posts)
            query = rows.column("is_query").to_numpy()
            ids = rows.column("id").combine_chunks()
            file, every = rows.column("file")[0].as_py(), np.arange(len(vectors))
            return pa.Table.from_batches([_rows(ids, vectors, every, inner_file(file, order[:, r]), query) for r in range(order.shape[1])])

        parts = salted.groupBy("file", "salt").cogroup(pivots.groupBy("of", "part")).applyInArrow(post, POSTED)
        kept = done.join(F.broadcast(sizes.select("file")), "file", "left_anti") if level == 0 else done.join(sizes.select("file"), "file", "left_anti")
        done = cut_lineage(kept.select("file", "is_query", "id", "vector").unionByName(parts))
    return done


def footrule_similarity(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """What the footrule distance of two orders is short of its greatest value, halved.

    With a pivot that is missing from an order counted as standing just behind it, the distance
    is the greatest value less twice the sum of (length - larger position) over shared pivots.
    """
    length, n = queries.shape[1], len(members)
    pivots, local = np.unique(members, return_inverse=True)
    place = np.full((len(pivots) + 1, n), length, dtype=np.uint8)  # where each pivot stands in each member's order
    place[local.reshape(n, length).T, np.arange(n)] = np.arange(length, dtype=np.uint8)[:, None]
    at = np.minimum(np.searchsorted(pivots, queries), len(pivots) - 1)
    row = np.where(pivots[at] == queries, at, len(pivots))
    out = np.zeros((len(queries), n), dtype=np.uint8)
    for a in range(length):
        out += np.uint8(length) - np.maximum(place[row[:, a]], np.uint8(a))
    return out


def _best_of_file(units: np.ndarray, order: np.ndarray, place: np.ndarray, members: np.ndarray, queries: np.ndarray, settings: IndexSettings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, neighbour, float similarity): the best of one inverted file for the queries that read it.

    Footrule says which candidates are kept; similarities of all are taken in one product, which
    costs less than gathering the kept ones for each query.
    """
    n = len(members)
    keep = min(n, max(4 * settings.k, min(settings.rerank, int(settings.rerank_share * n))))
    take = min(n, settings.k + 8)
    step = max(1, 4_000_000 // n)
    for s in range(0, len(queries), step):
        q = queries[s : s + step]
        near = units[q] @ units[members].T
        if keep < n:
            foot = footrule_similarity(order[q], order[members])
            worst = np.partition(foot, n - keep, axis=1)[:, n - keep]
            near[foot < worst[:, None]] = -np.inf  # candidates level with the last one stay
        near[q[:, None] == members[None, :]] = -np.inf
        some = np.argpartition(near, n - take, axis=1)[:, -take:] if take < n else np.broadcast_to(np.arange(n), near.shape)
        value = np.take_along_axis(near, some, axis=1)
        found = members[some]
        # More ties at the edge than were taken: the smaller ids of them.
        level = np.sort(value, axis=1)[:, -min(take, settings.k)] - 2e-6
        for e in np.flatnonzero((value.min(axis=1) >= level) & (level > -np.inf) & (take < n)):
            every = np.flatnonzero(near[e] >= level[e])
            exact = np.round(units[members[every]].astype(np.float64) @ units[q[e]].astype(np.float64), 6)
            best = every[np.lexsort((place[members[every]], -exact))[:take]]
            found[e], value[e] = members[best], near[e, best]
        real = value > -np.inf
        yield np.repeat(q, real.sum(axis=1)), found[real], value[real]


def search_region(ids: np.ndarray, vectors: np.ndarray, is_query: np.ndarray, settings: IndexSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, similarity, rank) by position, for the queries of one region.

    Similarity is the cosine in double precision, rounded to 6 decimals; ties go to the smaller id.
    """
    n, k = len(ids), settings.k
    queries = np.flatnonzero(is_query)
    if n < 2 or not len(queries):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0), empty
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(n)
    units = unit_rows(vectors)
    # Pivots are spread evenly over the region's vectors in their given order, that of ids.
    m = min(n, max(settings.least_pivots, min(settings.most_pivots, n * settings.prefix // settings.file)))
    order = nearest_pivots(units, units[np.arange(m) * n // m], settings.prefix)
    if n <= settings.file:
        files = [(np.arange(n), queries)]
    else:
        posted, asked = order.ravel(), order[queries, : settings.probes].ravel()
        by_file, by_ask = np.argsort(posted, kind="stable"), np.argsort(asked, kind="stable")
        member, reader = by_file // order.shape[1], queries[by_ask // min(settings.probes, order.shape[1])]
        a, b = np.searchsorted(posted[by_file], np.arange(m + 1)), np.searchsorted(asked[by_ask], np.arange(m + 1))
        files = [(member[a[f] : a[f + 1]], reader[b[f] : b[f + 1]]) for f in range(m)]
    found = [x for members, readers in files if len(readers) and len(members) > 1 for x in _best_of_file(units, order, place, members, readers, settings)]
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0), empty
    q, c, value = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(q.astype(np.int64) * n + c, return_index=True)[1]
    q, c, value = q[pairs], c[pairs], value[pairs]
    by_value = np.lexsort((-value, q))
    q, c, value = q[by_value], c[by_value], value[by_value]
    start = np.searchsorted(q, q)
    ends = np.searchsorted(q, q, side="right") - 1
    last = value[np.minimum(start + k - 1, ends)]  # of the k-th, in float; what may be level with it in double stays
    stay = value >= last - 2e-6
    q, c = q[stay], c[stay]
    similarity = np.concatenate([cosines(vectors[q[s : s + 65_536]], vectors[c[s : s + 65_536]]) for s in range(0, len(q), 65_536)])
    final = np.lexsort((place[c], -similarity, q))
    q, c, similarity = q[final], c[final], similarity[final]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    best = rank <= k
    return q[best], c[best], similarity[best], rank[best]


USABLE = "forall(vector, x -> x is not null and not isnan(x) and abs(x) <> double('infinity')) and exists(vector, x -> x <> 0)"
FOUND = "id string, neighbour string, similarity double, rank int"


def bound_table(table: pa.Table, size: int, settings: IndexSettings) -> pa.Table:
    """The queries of one region with the similarity of the k-th that the index finds there, -1 if there are fewer;
    rows that repeat an id are taken once."""
    ids = table.column("id").combine_chunks()
    keys = id_order(ids)
    asks = table.column("is_query").to_numpy()
    _, first = np.unique(keys[np.argsort(~asks, kind="stable")], return_index=True)
    first = np.argsort(~asks, kind="stable")[first]  # in order of ids, whatever the order of arrival; a copy that is a query goes first
    q, _, similarity, rank = search_region(keys[first], _binary(table, "vector", size)[first], asks[first], settings)
    low = np.full(len(first), -1.0)
    low[q[rank == settings.k]] = similarity[rank == settings.k]
    own = pa.array(first[asks[first]])
    return pa.table({"id": ids.take(own), "vector": table.column("vector").combine_chunks().take(own), "low": pa.array(low[asks[first]])})


# Cells: where neighbours can be that the index has not found.

SLACK = 1e-5  # more than products of float32 unit vectors are wrong by


@dataclass
class Centres:
    """Centres of cells. The first ``coarse`` of them lead to the others: those posted to one of them are ``member[start[g] : start[g + 1]]``."""

    units: np.ndarray
    coarse: int
    start: np.ndarray
    member: np.ndarray

    @classmethod
    def of(cls, units: np.ndarray) -> Centres:
        if len(units) <= 2048:
            return cls(units, 0, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32))
        coarse = 4 * int(len(units) ** 0.5)
        posts = nearest_pivots(units, units[:coarse], 8)
        order = np.argsort(posts.ravel(), kind="stable")
        return cls(units, coarse, np.searchsorted(posts.ravel()[order], np.arange(coarse + 1)), (order // posts.shape[1]).astype(np.int32))

    def nearest(self, units: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number, similarity) of the nearest of all centres; with ``least``, of those that are at least so similar."""
        where, value = np.empty(len(units), dtype=np.int64), np.empty(len(units), dtype=np.float32)
        step = max(1, 8_000_000 // len(self.units))
        for s in range(0, len(units), step):
            near = units[s : s + step] @ self.units.T
            if least is not None:
                near[near < least] = -2
            where[s : s + step] = near.argmax(axis=1)
            value[s : s + step] = near.max(axis=1)
        return where, value

    def near(self, units: np.ndarray, separation: float) -> tuple[np.ndarray, np.ndarray]:
        """(number, similarity) of a centre that is near, if there is one, else of the nearest of all."""
        if not self.coarse or not len(units):
            return self.nearest(units)
        where, value = np.zeros(len(units), dtype=np.int64), np.full(len(units), -2, dtype=np.float32)
        probes = nearest_pivots(units, self.units[: self.coarse], 4)
        order = np.argsort(probes.ravel(), kind="stable")
        at = np.searchsorted(probes.ravel()[order], np.arange(self.coarse + 1))
        for g in np.flatnonzero(np.diff(at)):
            rows, listed = order[at[g] : at[g + 1]] // probes.shape[1], self.member[self.start[g] : self.start[g + 1]]
            if len(listed):
                near = units[rows] @ self.units[listed].T
                best = near.argmax(axis=1)
                most = near[np.arange(len(rows)), best]
                better = most > value[rows]
                where[rows[better]], value[rows[better]] = listed[best[better]], most[better]
        far = np.flatnonzero(value < separation)
        if len(far):
            where[far], value[far] = self.nearest(units[far])
        return where, value


def uncovered_batches(batches: Iterator[pa.RecordBatch], centres: Centres, size: int, settings: IndexSettings) -> Iterator[pa.RecordBatch]:
    """The usable vectors that no centre is near to."""
    for batch in batches:
        where, vectors = _vectors(batch.column("vector"), size)
        if len(where):
            far = pa.array(where[centres.near(unit_rows(vectors), settings.separation)[1] < settings.separation])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(far) for c in ("id", "vector")], names=["id", "vector"])


def cover(rows: DataFrame, total: int, size: int, settings: IndexSettings) -> Centres:
    """Centres with one near to every vector, if ``centres`` of them suffice.

    Each round brings a bounded sample of what isn't covered yet to the driver, looked for among
    more and more rows, at last among all.
    """
    rows = rows.filter(USABLE).select("id", "vector")
    lot = F.shiftrightunsigned(F.xxhash64("id"), 33)
    units, share = np.zeros((0, size), dtype=np.float32), min(1.0, 1.2 * settings.sample / max(total, 1))
    while len(units) < settings.centres:
        left = rows.filter(lot < F.lit(int(share * (1 << 31))))
        if len(units):
            left = left.mapInArrow(lambda batches, c=Centres.of(units): uncovered_batches(batches, c, size, settings), rows.schema)
        picked = left.orderBy(lot, "id").limit(settings.sample).select("vector").toArrow().column("vector").combine_chunks()
        sample = _vectors(picked, size)[1]
        if len(sample):
            units = np.vstack([units, thin(unit_rows(sample), settings.separation, settings.centres - len(units))])
        if len(sample) < settings.sample:
            if share >= 1:
                break
            share = min(1.0, 4 * share)
    return Centres.of(units)


def reach_batches(batches: Iterator[pa.RecordBatch], centres: Centres, size: int, settings: IndexSettings) -> Iterator[pa.RecordBatch]:
    """(cell, smallest similarity to its centre, vectors, hashes of k + 1 ids of it at most), once a task and cell."""
    low, n = np.full(len(centres.units), 2.0), np.zeros(len(centres.units), dtype=np.int64)
    seen = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for batch in batches:
        usable, vectors = _vectors(batch.column("vector"), size)
        where, value = centres.near(unit_rows(vectors), settings.separation)
        np.minimum.at(low, where, value)
        n += np.bincount(where, minlength=len(n))
        seen.append((where, batch.column("h").to_numpy()[usable]))
    cell, h = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    new = np.append(True, (cell[1:] != cell[:-1]) | (h[1:] != h[:-1]))[: len(cell)]
    cell, h = cell[new], h[new]
    few = np.arange(len(cell)) - np.searchsorted(cell, cell) <= settings.k
    cell, h = cell[few], h[few]
    some = np.flatnonzero(n)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(cell, np.append(some, len(n))).astype(np.int32)), pa.array(h))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(low[some]), pa.array(n[some]), lists], names=["cell", "low", "n", "some"])


ALL, FIRST, SECOND, VISITOR = range(4)  # in a group, a vector meets: all, the second side, the first side, all as a query only
VISITS = "file long, side int, low double, id string, vector binary"


def visit_batches(batches: Iterator[pa.RecordBatch], measured: Cells, blocks: np.ndarray, size: int, settings: IndexSettings) -> Iterator[pa.RecordBatch]:
    """Each vector in its cell, and as a query in every other cell that may hold what is as near as its bound.

    x can be within the angle t of q only if q is within t + r of the centre of x's cell, r being its radius, and
    that centre within a + t + r of q's own, a being q's distance from it. If the index found too little, the whole
    of q's own cell, within a + r, is the bound. A cell of several blocks is compared by pairs of blocks.
    """
    centres, radius = measured.centres, measured.radius()
    against = np.hstack([centres.units, np.cos(radius)[:, None], np.sin(radius)[:, None]]).astype(np.float32)
    against[radius >= np.pi / 2] = 0  # all go there
    inside = (measured.least - SLACK).astype(np.float32)

    def asked(units: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """Rows whose product with a row of ``against`` is cos(distance) - cos(angle + radius)."""
        out = np.hstack([units, -np.cos(angle)[:, None], np.sin(angle)[:, None]]).astype(np.float32)
        out[angle >= np.pi / 2] = 0
        return out

    step = max(1, 8_000_000 // len(against))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, raw, low = batch.column("id"), batch.column("vector"), batch.column("low").to_numpy()
        units = unit_rows(_binary(pa.Table.from_batches([batch]), "vector", size))
        home, value = centres.near(units, settings.separation)
        astray = np.flatnonzero(value < inside[home])  # a tie that went otherwise when cells were measured
        if len(astray):
            home[astray], value[astray] = centres.nearest(units[astray], inside)
        t = np.arccos(np.clip(low - SLACK, -1, 1))
        a = np.arccos(np.clip(value.astype(np.float64) - SLACK, -1, 1))
        whole = np.flatnonzero(measured.full[home] & (a + radius[home] < t))
        t[whole] = a[whole] + radius[home[whole]]
        low = low.copy()
        low[whole] = np.cos(t[whole])
        order = np.argsort(home, kind="stable")
        homes, start = np.unique(home[order], return_index=True)
        ends = np.append(start[1:], len(order))
        widest = asked(centres.units[homes], np.maximum.reduceat((a + t)[order], start))
        query = asked(units, t)
        rows, cells = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for s in range(0, len(homes), step):
            h, c = np.divmod(np.flatnonzero(widest[s : s + step] @ against.T >= -SLACK), len(against))
            other = c != homes[h + s]
            h, c = h[other] + s, c[other]
            at = np.searchsorted(h, np.arange(s, min(s + step, len(homes)) + 1))
            for i in np.flatnonzero(np.diff(at)):
                mine, there = order[start[i + s] : ends[i + s]], c[at[i] : at[i + 1]]
                for j in range(0, len(there), 65_536):
                    x, y = np.nonzero(query[mine] @ against[there[j : j + 65_536]].T >= -SLACK)
                    rows.append(mine[x])
                    cells.append(there[j + y])
        q, cell = np.concatenate(rows), np.concatenate(cells)
        for pick, file, side in [*_in_blocks(np.arange(len(units)), home, ids, blocks), *((q[n], (cell[n] << 24) + b * 4097, VISITOR) for b in range(int(blocks[cell].max()) if len(cell) else 0) for n in [blocks[cell] > b])]:
            if len(pick):
                at = pa.array(pick)
                yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(np.full(len(pick), side, dtype=np.int32)), pa.array(low[pick]), ids.take(at), raw.take(at)], names=["file", "side", "low", "id", "vector"])


def _in_blocks(rows: np.ndarray, cell: np.ndarray, ids: pa.Array, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, groups, side): vectors with those of their own block and, of a cell of several, with each other block."""
    n = blocks[cell]
    own = np.zeros(len(rows), dtype=np.int64)
    for i in np.flatnonzero(n > 1):
        own[i] = zlib.crc32(ids[i].as_py().encode()) % n[i]
    yield rows, (cell << 24) + own * 4097, ALL
    for other in range(int(n.max()) if len(n) else 0):
        for side, there in ((FIRST, (other > own) & (other < n)), (SECOND, other < own)):
            yield rows[there], (cell[there] << 24) + np.minimum(own[there], other) * 4096 + np.maximum(own[there], other), side


def search_cell(table: pa.Table, size: int, settings: IndexSettings) -> pa.Table:
    """The k most similar of a group for each query of it, by comparing all, as far as its bound lets them be of use."""
    ids = table.column("id").combine_chunks()
    _, first = np.unique(id_order(ids), return_index=True)  # in order of ids
    ids = ids.take(pa.array(first))
    side, low = table.column("side").to_numpy()[first], table.column("low").to_numpy()[first]
    vectors = _binary(table, "vector", size)[first]
    units = np.concatenate([unit_rows(vectors[s : s + 16_384]) for s in range(0, len(vectors), 16_384)])
    meets = ((FIRST, SECOND), (SECOND, FIRST)) if (side == FIRST).any() or (side == SECOND).any() else ((ALL, ALL), (VISITOR, ALL))
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for asks, answers in meets:
        queries, members = np.flatnonzero(side == asks), np.flatnonzero(side == answers)
        step = max(64, 4_000_000 // max(len(members), 1))
        doubles: dict[int, np.ndarray] = {}
        for s in range(0, len(queries) if len(members) else 0, step):
            found.append(_best_by_bound(units, vectors, queries[s : s + step], members, low, settings.k, doubles))
    q, c, similarity = (np.concatenate(x) for x in zip(*found, strict=True))
    order, queries = np.argsort(q, kind="stable"), np.unique(q)
    start = np.searchsorted(q[order], np.append(queries, len(side)))
    near = pa.StructArray.from_arrays([pa.array(-similarity[order]), ids.take(pa.array(c[order]))], names=["away", "neighbour"])
    return pa.table({"id": ids.take(pa.array(queries)), "near": pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), near)})


def _double_units(vectors: np.ndarray) -> np.ndarray:
    v = _doubles(vectors)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _of_use(own: np.ndarray, units: np.ndarray, queries: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members, in order of ids, can be among the k best of each query, and how many surely have cosine 1.

    Of no use is what k members are better than, or level with and smaller by id; what is next to a half counts as either.
    """
    millionths = 1e6 * (own @ units.T)
    millionths[queries[:, None] == members[None, :]] = -2e6
    low, high = np.floor(millionths + (0.5 - 1e-6)), np.floor(millionths + (0.5 + 1e-6))
    kth = np.partition(low, len(members) - k, axis=1)[:, len(members) - k][:, None]
    sure = low >= kth
    return (high > kth) | ((high == kth) & (np.cumsum(sure, axis=1, dtype=np.int32) - sure < k)), (low >= 1e6).sum(axis=1)


def _best_by_bound(units: np.ndarray, vectors: np.ndarray, queries: np.ndarray, members: np.ndarray, low: np.ndarray, k: int, doubles: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, similarity): the best of the members, which are in order of ids, for the queries.

    Where many members of a tile are within the bound, as in a crowd, products in double precision leave few of them;
    ``doubles`` keeps the tiles for them. A query that has found k members of cosine 1 is done: those that follow can only be level with them.
    """
    own, least, pairs = units[queries], (low[queries] - SLACK).astype(np.float32), []
    ones, open_ = np.zeros(len(queries), dtype=np.int64), np.arange(len(queries))
    for s in range(0, len(members), 2048):  # products that stay in the processor's cache
        tile = members[s : s + 2048]
        near = (own if len(open_) == len(own) else own[open_]) @ units[tile].T
        a, b = np.divmod(np.flatnonzero(near >= least[open_][:, None]), len(tile))
        many = np.flatnonzero(np.bincount(a, minlength=len(open_)) > 8 * k)
        if len(many):
            if s not in doubles:
                doubles[s] = _double_units(vectors[tile])
            asked = queries[open_[many]]
            use, alike = _of_use(_double_units(vectors[asked]), doubles[s], asked, tile, k)
            at = np.full(len(open_), -1)
            at[many] = np.arange(len(many))
            stay = (at[a] < 0) | use[at[a], b]
            a, b = a[stay], b[stay]
            ones[open_[many]] += alike
        pairs.append((open_[a], b + s, near[a, b]))
        open_ = open_[ones[open_] < k]
        if not len(open_):
            break
    a, b, value = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(a, kind="stable")
    start = np.searchsorted(a[order], np.arange(len(queries) + 1))
    for i in np.flatnonzero(np.diff(start) > 8 * k):  # what is as near as the k-th here; the query itself may be one
        least[i] = -np.partition(-value[order[start[i] : start[i + 1]]], k)[k] - 2 * SLACK
    stay = value >= least[a]
    q, c = queries[a[stay]], members[b[stay]]
    q, c = q[q != c], c[q != c]
    similarity = np.empty(len(q))
    for s in range(0, len(q), 65_536):
        similarity[s : s + 65_536] = cosines(vectors[q[s : s + 65_536]], vectors[c[s : s + 65_536]])
    order = np.lexsort((c, -similarity, q))
    q, c, similarity = q[order], c[order], similarity[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], c[best], similarity[best]


@dataclass
class Cells:
    """Centres, the smallest similarity of each one's vectors to it, their number, and whether they have more than k ids."""

    centres: Centres
    least: np.ndarray
    count: np.ndarray
    full: np.ndarray

    def radius(self) -> np.ndarray:
        """The angle from its centre that no vector of a cell is beyond."""
        return np.arccos(np.clip(self.least - 2 * SLACK, -1, 1))


def measure_cells(rows: DataFrame, total: int, size: int, settings: IndexSettings) -> Cells | None:
    """The cells of the usable vectors; none without one."""
    centres = cover(rows, total, size, settings)
    if not len(centres.units):
        return None
    hashed = rows.select("vector", F.xxhash64("id").alias("h"))
    reach = hashed.mapInArrow(lambda batches: reach_batches(batches, centres, size, settings), "cell long, low double, n long, some array<long>")
    several = F.size(F.array_distinct(F.flatten(F.collect_list("some")))) > settings.k
    found = reach.groupBy("cell").agg(F.min("low").alias("low"), F.sum("n").alias("n"), several.alias("full")).toArrow()
    n = len(centres.units)
    cells = Cells(centres, np.full(n, 2.0), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool))
    at = found.column("cell").to_numpy()
    cells.least[at], cells.count[at], cells.full[at] = (found.column(c).to_numpy() for c in ("low", "n", "full"))
    return cells


def search_cells(bounds: DataFrame, cells: Cells, size: int, settings: IndexSettings) -> DataFrame:
    """id, neighbour, similarity, rank: exact, however loose the bounds (id, vector, low) are."""
    blocks = np.clip(-(-cells.count // settings.block), 1, 4096)
    visits = bounds.mapInArrow(lambda batches: visit_batches(batches, cells, blocks, size, settings), VISITS)
    near = visits.groupBy("file").applyInArrow(lambda t: search_cell(t, size, settings), "id string, near array<struct<away: double, neighbour: string>>")
    every = near.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))  # nearly always of one group
    best = every.select("id", F.posexplode(F.slice(F.sort_array("near"), 1, settings.k)).alias("place", "x"))
    return best.select("id", "x.neighbour", (-F.col("x.away")).alias("similarity"), (F.col("place") + 1).alias("rank"))


def direction_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """id and two hashes of the direction of each usable vector, about (h1, h2) and exactly (e1, e2).

    Directions are taken on a grid of 1e-4, so vectors that share h1 and h2 differ in cosine by
    less than 4e-7 in 64 dimensions, and their cosine rounds to 1 at 6 decimals. Those that share e1
    and e2 are the same but for a power of two, so they have the same cosines with all others, to the last bit.
    """
    mix = np.random.default_rng(5).integers(1, 1 << 63, size=(2, size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        where, vectors = _vectors(batch.column("vector"), size)
        if not len(where):
            continue
        v = vectors.astype(np.float64)
        power = np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]
        bits = (np.ldexp(v, -power) + 0.0).view(np.uint64)
        bits = (bits ^ (bits >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)  # the lower halves of what were floats are empty
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        grid = np.round(v * 10_000).astype(np.int64).astype(np.uint64)
        h = [(x * m).sum(axis=1) for x in (grid, bits ^ (bits >> np.uint64(29))) for m in mix]
        h = [((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64) for x in h]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(where)), *map(pa.array, h)], names=["id", "h1", "h2", "e1", "e2"])


def sure_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors that are known to have k others of cosine 1, with that as their bound."""
    for batch in batches:
        where, vectors = _vectors(batch.column("vector"), size)
        if len(where):
            rows = _rows(batch.column("id").take(pa.array(where)), vectors, np.arange(len(where)), np.zeros(len(where)), np.ones(len(where), dtype=bool))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("vector"), pa.array(np.ones(len(where)))], names=["id", "vector", "low"])


def region_rows(rows: DataFrame, total: int, size: int, settings: IndexSettings, cells: Cells | None = None) -> tuple[DataFrame | None, bool]:
    """Vectors by the regions that hold them (file, is_query, id, vector), and whether some were divided,
    so that a query may be in several; none without a usable vector."""
    cells = cells or measure_cells(rows, total, size, settings)
    if cells is None:
        return None, False
    centres = cells.centres
    pivots = centres.units[: max(1, min(settings.max_pivots, total // settings.vectors_a_pivot))]
    regions = nearest_pivots(centres.units, pivots, settings.posts)
    radius = cells.radius()
    for rank in range(1, regions.shape[1]):
        apart = np.arccos(np.clip(np.einsum("ij,ij->i", centres.units, pivots[regions[:, rank]]), -1, 1))
        regions[apart > radius + radius[regions[:, rank]], rank] = -1  # the two cells don't meet
    long = np.bincount(regions.ravel() + 1, np.repeat(cells.count, regions.shape[1]), minlength=len(pivots) + 1)[1:] > settings.region

    def posted(wanted: np.ndarray) -> DataFrame:
        return rows.select("id", "vector").mapInArrow(lambda batches: post_batches(batches, centres, regions, wanted, size, settings), POSTED)

    if not long.any():
        return posted(~long), False
    return posted(~long).unionByName(divide_long(posted(long), size, settings)), True


def most_similar(vectors: DataFrame, size: int = 64, settings: IndexSettings | None = None) -> DataFrame:
    """The k most similar other vectors of every usable vector: id, neighbour, similarity, rank.

    ``vectors``: id string, vector array<float or double>. Usable are vectors of ``size`` finite
    numbers that are not all zero, with an id; others take no part. Each id is taken once: where
    it has several different vectors, the one whose hash is smallest counts. Similarity is the
    cosine, rounded to 6 decimals, ties by the smaller neighbour. Where there are fewer than k
    others, a vector gets those. An empty input gives an empty result.

    Of vectors of about one direction (whose cosines round to 1) in greater number than ``crowd`` the
    k + 1 smallest ids are indexed; the others have k of cosine 1, a bound that needs no index. Of vectors
    that are the same but for a power of two in greater number than ``crowd`` only the k + 1 smallest ids are searched;
    the others get what the smallest of them found, itself included, as their cosines are the same.

    Nothing is missed: the index gives bounds, ``search_cells`` all that they leave open.
    """
    settings = settings or IndexSettings()
    spark = vectors.sparkSession
    rows = vectors.select("id", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2")).filter(F.col("id").isNotNull() & (F.size("vector") == size) & F.exists("vector", lambda x: x != 0))
    # Ids with several vectors: as a rule none. One narrow pass counts the rows as well.
    by_id = rows.groupBy("id").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n"))
    several = by_id.filter("low <> high")
    seen = by_id.agg(F.sum("n").alias("total"), F.count_if(F.col("low") != F.col("high")).alias("several")).first()
    if seen["several"]:
        clash = rows.join(several.select("id"), "id", "left_semi").filter(USABLE)
        kept = clash.groupBy("id").agg(F.min(F.struct("h1", "h2", "vector")).alias("x")).select("id", "x.vector", "x.h1", "x.h2")
        rows = rows.join(several.select("id"), "id", "left_anti").unionByName(kept)
    rows = rows.select("id", "vector")
    total = seen["total"] or 0
    aimed = rows.mapInArrow(lambda batches: direction_batches(batches, size), "id string, h1 long, h2 long, e1 long, e2 long").select("id", F.struct("h1", "h2").alias("h"), F.struct("e1", "e2").alias("e"))
    crowds = cut_lineage(aimed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > settings.crowd))
    indexed, sure, followers = rows, None, None
    if crowds.limit(1).count():

        def after_the_first(members: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
            """The k + 1 smallest ids of each crowd, and the other members."""
            first = members.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("id"))).filter(F.col("r") <= settings.k + 1)
            return first, members.join(first.select("id"), "id", "left_anti")

        members = cut_lineage(attach_hot_aware(aimed, crowds, "h", "n").select("id", "h", "e").distinct())
        same = cut_lineage(members.groupBy("e").agg(F.count("*").alias("n")).filter(F.col("n") > settings.crowd))
        if same.limit(1).count():
            leaders, followers = after_the_first(attach_hot_aware(members.select("id", "e"), same, "e", "n").select("id", "e"), "e")
            leaders, followers = cut_lineage(leaders), cut_lineage(followers)
            rows, members = (x.join(followers.select("id"), "id", "left_anti") for x in (rows, members))
        others = cut_lineage(after_the_first(members, "h")[1].select("id"))
        indexed = rows.join(others, "id", "left_anti")
        sure = rows.join(others, "id", "left_semi").dropDuplicates(["id"])
    cells = measure_cells(rows, total, size, settings) if total else None
    if cells is None:
        return spark.createDataFrame([], FOUND)
    regions, divided = region_rows(indexed, total, size, settings, cells)
    bounds = regions.groupBy("file").applyInArrow(lambda t: bound_table(t, size, settings), "id string, vector binary, low double")
    if divided:
        bounds = bounds.groupBy("id").agg(F.max_by("vector", "low").alias("vector"), F.max("low").alias("low"))
    if sure is not None:
        bounds = bounds.unionByName(sure.mapInArrow(lambda batches: sure_batches(batches, size), "id string, vector binary, low double"))
    out = search_cells(bounds, cells, size, settings)
    if followers is None:
        return out
    out = cut_lineage(out)
    first = leaders.filter("r = 1").select("id", "e")
    listed = out.join(first, "id").select("e", "neighbour", "similarity").unionByName(first.select("e", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity")))
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("e").orderBy(F.desc("similarity"), "neighbour"))).filter(F.col("rank") <= settings.k)
    near = ranked.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("near")).join(same, "e")
    extra = attach_hot_aware(followers, near, "e", "n").select("id", F.explode("near").alias("x")).select("id", "x.neighbour", "x.similarity", F.col("x.rank").cast("int").alias("rank"))
    return out.unionByName(extra)


def similar_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs of which one is among the most similar of the other: id_a < id_b."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
