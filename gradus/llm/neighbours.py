"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every different vector is indexed once; of those who share it only the ids that can be among the nearest are kept.
Centres, fitted on a bounded sample, part the vectors into cells, and cells into blocks of bounded size. A vector, less
its cell's centre and scaled to length 1, is rotated by one random frame and kept as its packed signs and two scalars: its
length, and its inner product with its own signs. Vectors of fewer than ``BITS`` components are turned into that many
dimensions, which narrows the error. A query, less the sample's mean, is turned alike and kept in planes of ``PLANES``
bits, so the signs' product with it is counted in bits; divided by the scalar it estimates the true product without bias,
within an error that the scalar bounds. What the mean adds to a vector's product is a third scalar, so that vectors which
have much in common, as in a narrow cone, don't drown what tells them apart.

Queries go in groups against the cells whose centre and radius let them reach a score that the sample already grants. A
group meets its blocks best first and carries the scores to beat from block to block. Vectors whose upper bound reaches
those scores are reranked at once by their original components, which the blocks hold beside the codes. So the scores to
beat are true ones and never estimates, the largest of which are too large by chance: where codes tell little, more is
reranked, and nothing more is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradus.llm._store import settle
from gradus.llm._text import lean

BITS = 512  # of a code, at least; a multiple of 64
PLANES = 4  # bits of a query's components
EPSILON = 3.0  # standard errors that the bounds allow for
SAMPLE = 16_384  # vectors that centres and first scores to beat are taken from, about: a bound on what the driver holds
CELLS = 256  # at most; a cell has CELL_ROWS vectors or more on average
CELL_ROWS = 4096
BLOCK = 2048  # vectors of a block, about, and fewer if that is more than BLOCK_BYTES
BLOCK_BYTES = 1 << 20
QUERIES = 512  # of a group
LANES = 4  # parts of a group's blocks that are searched side by side
AT_ONCE = 32  # queries whose estimates are in memory together
PRODUCTS = 1 << 20  # components multiplied at a time

HELD = ["keys", "firsts", "codes", "length", "own", "tilt", "vectors"]
ASKED = ["keys", "planes", "scale", "least", "slack", "vectors"]
BLOCKS = f"size int, cell int, part int, {', '.join(f'{c} binary' for c in HELD)}"
GROUPS = f"grp bigint, size int, {', '.join(f'{c} binary' for c in ASKED)}, cells array<struct<cell:int,bound:double,centred:binary>>"
PAIRS = "ask bigint, key bigint, first bigint, score double"


class Sample(NamedTuple):
    """Of vectors of one number of components."""

    rows: np.ndarray
    centres: np.ndarray
    middle: np.ndarray


def frame(size: int, seed: int) -> np.ndarray:
    """(size, bits): an orthonormal frame in random position, the same on every executor."""
    bits = max(BITS, -(-size // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, size)))
    return (q * np.sign(np.diag(r))).T


def fit_centres(rows: np.ndarray, cells: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centres by Lloyd's iteration; one that loses all rows stays where it is."""
    centres = rows[np.sort(np.random.default_rng(seed).permutation(len(rows))[:cells])].copy()
    for _ in range(rounds):
        own = cell_of(rows, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def cell_of(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def encode(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (rows, words), lengths, and products with the own signs, of vectors less their centre."""
    length = np.sqrt((rest**2).sum(axis=1))
    unit = (rest / np.where(length > 0, length, 1)[:, None]) @ turn
    own = np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(unit >= 0, axis=1).view(np.uint64), length, np.where(length > 0, own, 1)


def planes_of(queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turned queries as bit planes (rows, planes, words), and (rows, 4): least value, step, sum of values, length."""
    turned = queries @ turn
    low = turned.min(axis=1, keepdims=True)
    step = (turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1)
    step = np.where(step > 0, step, 1.0)
    level = np.rint((turned - low) / step).astype(np.uint8)
    bits = np.stack([np.packbits((level >> j) & 1, axis=1).view(np.uint64) for j in range(PLANES)], axis=1)
    total = low[:, 0] * turn.shape[1] + step[:, 0] * level.sum(axis=1)
    return bits, np.stack([low[:, 0], step[:, 0], total, np.sqrt((queries**2).sum(axis=1))], axis=1)


def bounds(planes: np.ndarray, scale: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries, vectors) from packed bits, and how far the true ones may be."""
    shape, size = (len(planes), len(codes)), codes.shape[1] * 64
    both, ones = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    dot, columns = np.zeros(shape, np.int32), np.ascontiguousarray(codes.T)
    for j in range(PLANES):
        plane = np.zeros(shape, np.int32)
        for word, column in enumerate(columns):
            np.bitwise_and(planes[:, j, word, None], column, out=both)
            plane += np.bitwise_count(both, out=ones)
        dot += plane << j
    low, step, total, norm = (scale[:, i, None] for i in range(4))
    held = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    product = (2 * (low * held + step * dot) - total) / math.sqrt(size)
    spread = (1 - own**2) / own**2 / max(1, size - 1)
    error = EPSILON * length * np.sqrt(norm**2 * np.maximum(spread, 0) + step**2 / 12 / own**2)
    return product * (length / own) + centred[:, None], error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    return np.add.accumulate(a.astype(float) * b, axis=1)[:, -1] + 0.0  # no -0.0


class Search:
    """One group of queries on its way through blocks: of each query the ``most`` best vectors so far, by score and smallest id."""

    def __init__(self, row: dict, most: int):
        self.most, self.keys = most, np.frombuffer(row["keys"], np.int64)
        self.planes = np.frombuffer(row["planes"], np.uint64).reshape(len(self.keys), PLANES, -1)
        self.scale = np.frombuffer(row["scale"]).reshape(-1, 4)
        self.least, self.slack = np.frombuffer(row["least"]).copy(), np.frombuffer(row["slack"])
        self.vectors = np.frombuffer(row["vectors"]).reshape(len(self.keys), -1)
        self.scored = 0
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, key, smallest id, score

    def visit(self, row: dict) -> None:
        ids, firsts = (np.frombuffer(row[c], np.int64) for c in ("keys", "firsts"))
        code = np.frombuffer(row["codes"], np.uint64).reshape(len(ids), -1)
        length, own, tilt, centred = (np.frombuffer(row[c]) for c in ("length", "own", "tilt", "centred"))
        size = self.vectors.shape[1]
        vectors = np.frombuffer(row["vectors"], f"f{len(row['vectors']) // (len(ids) * size)}").reshape(-1, size)
        reach = np.flatnonzero(centred + self.scale[:, 3] * length.max() + tilt.max() >= self.least - self.slack)  # no other query can find anything here
        found, lacking = [self.best], np.bincount(self.best[0], minlength=len(self.keys)) < self.most
        for lo in range(0, len(reach), AT_ONCE):
            some = reach[lo : lo + AT_ONCE]
            estimate, error = bounds(self.planes[some], self.scale[some], code, length, own, centred[some])
            estimate += tilt
            near = estimate + error >= (self.least - self.slack)[some, None]
            if (few := lacking[some]).any():  # so that errors of the estimates leave no query without its number of vectors
                top = np.argpartition(-estimate[few], min(self.most, len(ids)) - 1, axis=1)[:, : self.most]
                near[np.flatnonzero(few)[:, None], top] = True
            i, j = np.nonzero(near)
            self.scored += len(i)
            step = max(1, PRODUCTS // size)
            for at in range(0, len(i), step):
                a, b = some[i[at : at + step]], j[at : at + step]
                score = products(self.vectors[a], vectors[b])
                good = lacking[a] | (score >= self.least[a])
                found.append([a[good], ids[b[good]], firsts[b[good]], score[good]])
        if len(found) > 1:
            self._rank([np.concatenate(x) for x in zip(*found, strict=True)])

    def _rank(self, found: list[np.ndarray]) -> None:
        query, key, first, score = found
        order = np.lexsort((key, first, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        self.best = [x[order][place < self.most] for x in found]
        last = order[place == self.most - 1]
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])

    def pairs(self) -> pa.RecordBatch:
        query, *rest = self.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.keys[query], *rest)], ["ask", "key", "first", "score"])


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v of the vectors with an id that aren't null, empty, zero or of components null or not finite; each once."""
    x = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v"))
    if x.schema["v"].dataType.elementType.typeName() not in ("float", "double"):
        x = x.select("id", F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine & F.exists("v", lambda c: c != 0))
    return x.select("id", F.transform("v", lambda c: c + F.lit(0).cast(x.schema["v"].dataType.elementType)).alias("v"))  # no -0.0: equal vectors are of one group


def different(x: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(key, first, size, v) of the different vectors, first the smallest id, and (key, id) of who has them; of each only the ``most`` smallest ids."""
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    kept = x if most is None else x.withColumn("_at", place).where(F.col("_at") <= most).drop("_at")
    named = settle(kept.groupBy("v").agg(F.min("id").alias("first")).withColumn("key", F.monotonically_increasing_id()), "vectors")
    return named.select("key", "first", F.size("v").alias("size"), "v"), kept.join(named, "v").select("key", "id")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch of (key, size, v): number of components, rows of that number, their vectors."""
    sizes = batch.column(1).to_numpy()
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, _matrix(batch.column(2).take(pa.array(at)), size)


def take_samples(x: DataFrame, seed: int) -> dict[int, Sample]:
    """About ``SAMPLE`` vectors by hash, and centres fitted on them, by number of components. Every row is indexed."""
    n = x.count()
    place = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 20))
    got = x.where(place < math.ceil((1 << 20) * min(1.0, SAMPLE / max(1, n)))).select("key", "size", "v").toArrow()
    out, sizes = {}, got.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        rows = _matrix(got.column("v").combine_chunks().filter(pa.array(sizes == size)), size)
        cells = max(1, min(CELLS, n * len(rows) // len(sizes) // CELL_ROWS, len(rows) // 8))
        out[size] = Sample(rows, fit_centres(rows, cells, seed), rows.mean(axis=0))
    return out


def _centres(samples: dict[int, Sample], size: int) -> np.ndarray:
    return samples[size].centres if size in samples else np.zeros((1, size))


def _middle(samples: dict[int, Sample], size: int) -> np.ndarray:
    return samples[size].middle if size in samples else np.zeros(size)


def build(x: DataFrame, samples: dict[int, Sample], seed: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The index, a row for each block, and the radius of every cell."""
    sent = x.sparkSession.sparkContext.broadcast({size: s._replace(rows=s.rows[:0]) for size, s in samples.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, v in _by_size(batch):
                centres = _centres(sent.value, size)
                cell = cell_of(v, centres)
                far = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(cell.astype(np.int32)), pa.array(far)], ["key", "size", "v", "first", "cell", "far"])

    kind = x.schema["v"].dataType.simpleString()
    placed = settle(x.select("key", "size", "v", "first").mapInArrow(lean(assign), f"key bigint, size int, v {kind}, first bigint, cell int, far double"), "placed")
    cells = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # CELLS rows for each number of components
    radius = {size: np.zeros(len(_centres(samples, size))) for size in {r["size"] for r in cells}}
    for r in cells:
        radius[r["size"]][r["cell"]] = r["radius"]
    parts = x.sparkSession.createDataFrame([(r["size"], r["cell"], -(-r["n"] // block_rows(r["size"]))) for r in cells], "size int, cell int, parts bigint")
    dealt = placed.join(parts, ["size", "cell"]).select("size", "cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "first", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size, cell, part), table in grouped(batches, 3):
            v = _matrix(column := table.column("v").combine_chunks(), size)
            rest = v - _centres(sent.value, size)[cell]
            codes, length, own = encode(rest, frame(size, seed))
            original = v.astype(column.type.value_type.to_pandas_dtype())
            row = [table.column("key").to_numpy(), table.column("first").to_numpy(), codes, length, own, rest @ _middle(sent.value, size), original]
            ids = [pa.array([x], pa.int32()) for x in (size, cell, part)]
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in row]], ["size", "cell", "part", *HELD])

    order = ["size", "cell", "part"]
    packed = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(pack), BLOCKS)
    return settle(packed, "index"), radius


def block_rows(size: int) -> int:
    """Vectors of a block: their components of eight bytes at most, codes of a bit for each, and scalars."""
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * size + max(BITS, size) // 8 + 40)))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of rows that agree in the first columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    at: tuple[int, ...] | None = None
    for batch in batches:
        named = np.stack([c.to_numpy() for c in batch.columns[:keys]], axis=1)
        edges = [0, *(np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(named[a].tolist())
            if held and own != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = own
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def ask(asked: DataFrame, samples: dict[int, Sample], radius: dict[int, np.ndarray], most: int, seed: int) -> DataFrame:
    """Groups of about ``QUERIES`` queries near the same centre, each with the cells that its queries' bounds allow."""
    sent = asked.sparkSession.sparkContext.broadcast((samples, radius))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, radius = sent.value
        for batch in batches:
            for size, at, v in _by_size(batch):
                if size not in radius:
                    continue  # no vector has as many components
                least = np.full(len(v), -np.inf)
                if size in samples and len(samples[size].rows) >= most:
                    rows = samples[size].rows
                    for lo in range(0, len(v), AT_ONCE):
                        score = v[lo : lo + AT_ONCE] @ rows.T
                        least[lo : lo + AT_ONCE] = np.partition(score, len(rows) - most, axis=1)[:, len(rows) - most]
                home = (v @ _centres(samples, size).T).argmax(axis=1).astype(np.int32)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(home), pa.array(least)], ["key", "size", "v", "home", "least"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        samples, radius = sent.value
        number = TaskContext.get().partitionId() << 32
        for (size,), table in grouped((b.select(["size", "key", "v", "least"]) for b in batches), 1):
            turn, centres = frame(size, seed), _centres(samples, size)
            for lo in range(0, table.num_rows, QUERIES):
                part = table.slice(lo, QUERIES).combine_chunks()
                v, least = _matrix(part.column("v").combine_chunks(), size), part.column("least").to_numpy()
                planes, scale = planes_of(v - _middle(samples, size), turn)
                centred, norm = v @ centres.T, np.sqrt((v**2).sum(axis=1))
                bound = centred + norm[:, None] * radius[size]
                slack = 1e-11 * norm * (radius[size].max() + np.sqrt((centres**2).sum(axis=1).max()) + np.sqrt((_middle(samples, size) ** 2).sum()))  # of sums in other orders
                reach = np.flatnonzero((bound >= (least - 2 * slack)[:, None]).any(axis=0))
                cells = [{"cell": c, "bound": float(bound[:, c].max()), "centred": np.ascontiguousarray(centred[:, c]).tobytes()} for c in reach.tolist()]
                row = [part.column("key").to_numpy(), planes, scale, least - slack, slack, v]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([size], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in row], pa.array([cells], pa.list_(pa.struct([("cell", pa.int32()), ("bound", pa.float64()), ("centred", pa.binary())])))],
                    ["grp", "size", *ASKED, "cells"],
                )
                number += 1

    kind = asked.schema["v"].dataType.simpleString()
    placed = settle(asked.select("key", "size", "v").mapInArrow(lean(place), f"key bigint, size int, v {kind}, home int, least double"), "asked")
    groups = max(1, placed.count() // QUERIES)
    order = ["size", "home", "key"]
    return settle(placed.repartitionByRange(groups, *order).sortWithinPartitions(*order).mapInArrow(lean(pack), GROUPS), "groups")


def search(groups: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """ask, key, first, score of the ``most`` best vectors that each lane of a query's group has found.

    A group is sent once to each of its lanes, and each block once to each group that its cell is allowed for; so the
    work is that of the pairs of groups and blocks that no bound rules out.
    """
    nothing = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    heads = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("bound"), *ASKED, *nothing(*[c for c in HELD if c not in ASKED], "centred"))
    wanted = groups.select("grp", "size", F.explode("cells").alias("c")).select("grp", "size", "c.*")
    blocks = wanted.join(index, ["size", "cell"])
    lane = F.pmod(F.xxhash64("cell", "part"), F.lit(LANES)).cast("int").alias("lane")
    blocks = blocks.select("grp", lane, F.lit(1).alias("kind"), "bound", *HELD, *nothing(*[c for c in ASKED if c not in HELD]), "centred")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["kind"] == 0:
                    if at:
                        yield at.pairs()
                    at = Search(row, most)
                else:
                    at.visit(row)
        if at:
            yield at.pairs()

    order = ["grp", "lane", "kind", F.desc("bound")]
    return heads.unionByName(blocks).repartition("grp", "lane").sortWithinPartitions(*order).mapInArrow(lean(work), PAIRS)


def chosen(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each query over all lanes, which send so many each at most."""
    place = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "first", "key"))
    return pairs.withColumn("at", place).where(F.col("at") <= most).select("ask", "key", "score")


def candidates(x: DataFrame, asked: DataFrame, *, most: int, seed: int = 5) -> DataFrame:
    """ask, key, score: the ``most`` best different vectors found for each query, equal scores by their smallest ids."""
    samples = take_samples(x, seed)
    index, radius = build(x, samples, seed)
    return chosen(search(ask(asked, samples, radius, most, seed), index, most), most)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, seed: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each query its ``k`` nearest vectors found, none of its own id: query_id, rank (from 1), vec_id, score.

    Scores are inner products of the original vectors in double precision; equal scores go to the smaller vec_id. Null,
    empty, zero and not finite vectors take no part, on either side; rows that repeat count once; other columns are
    ignored. Only vectors of as many components meet. Several vectors of one query id are answered as one query: the
    ``k`` best of their pairs. Fewer than ``k`` vectors give all of them, an empty table gives none.
    """
    rows = settle(usable(vectors, vec_id, embedding).distinct(), "rows")
    most = k + (rows.groupBy("id").count().agg(F.max("count")).first()[0] or 0)  # k, and the query's own, 1 but for ids that repeat
    x, holders = different(rows, most)
    asked, askers = different(usable(queries, vec_id, embedding).distinct(), None)
    pairs = candidates(x, asked, most=most, seed=seed)
    # Of equal vectors and scores the smallest ids count: so many of each hold k of other ids.
    best = pairs.join(holders, "key").select("ask", F.col("id").alias("vec_id"), "score")
    best = best.withColumn("at", F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= most)
    every = best.join(askers.select(F.col("key").alias("ask"), F.col("id").alias("query_id")), "ask").where("vec_id <> query_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
