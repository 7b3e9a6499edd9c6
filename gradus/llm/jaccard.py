"""Exact n-gram Jaccard join of documents as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct shingle sets, columns are hashes of shingles.

*Counts.* A task packs the entries of its documents into chunks and sends each block of columns one entry for each chunk
and column; the block sums them and answers each chunk with the counts of its columns that have several rows. So a column
that a third of all rows have is no block's burden.

*Bound.* A set of n shingles shares at least ceil(t n) of them with any similar one. If all columns are ordered from the
rarest on, two similar rows share one of their first n - ceil(t n) + 1. A column of one row is shared with none, so a row
with as many of those has no partner and is done; others keep what is left of these columns.

*Products.* Rows that keep a column in common are the only entries of the product that can reach the bound. In each column
every row first meets the least row, and their overlap is counted exactly: linear in the column, however large a group of
copies is. Rows that these links leave apart are held against each other in tiles of bounded size by parities of about six
bits a shingle, which bound the difference from below; the pairs that these allow are counted exactly too. Where a row has
more of them than ``PARTNERS``, another round follows, without the pairs that failed. A component that is large after the
first links meets the other rows of its columns as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._store import settle
from gradus.llm._text import SPACED_LOWER, U, chunks, lean, mix, split_words, windows
from gradus.llm.components import components

SEEN = 200_000  # sets that a task remembers, so as not to send copies
ROW_BITS = 16  # an entry is a column's hash, cut to the other 48 bits, and the number of its row in the chunk
CHUNK_ENTRIES = 1 << 21
BLOCK_ENTRIES = 1 << 20  # of a block of columns, about
PANEL = 512  # rows of a panel, about; a tile is two panels
PARTNERS = 32  # of a row that a tile names in one round; others wait for the next
GROUP = 64  # rows from which on a component is held against other rows as a whole, not column by column

PACKED = "block int, chunk bigint, kind int, data binary, extra binary, ids binary, known binary, sizes binary, sigs binary, fresh binary"
FOUND = "kind int, doc_id bigint, n bigint, sig bigint, col bigint"


def sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, sorted distinct shingle hashes of all its texts, and their offsets.

    Words are runs without ASCII white space, with A-Z lowered. Fewer words than ``width`` make one shingle.
    """
    for lo, hi, raw, offsets in chunks(texts):
        words = split_words(raw, offsets, SPACED_LOWER)
        all_runs = windows(words.hash, width, 7).view(np.int64)
        own = []
        for a, b in zip(words.doc[:-1].tolist(), words.doc[1:].tolist(), strict=True):
            if b - a >= width:
                u = np.sort(all_runs[a : b - width + 1].view(np.uint64))
                own.append(u[np.concatenate(([True], u[1:] != u[:-1]))])
            elif b > a:
                own.append(windows(words.hash[a:b], b - a, 100 + b - a))
            else:
                own.append(np.zeros(0, np.uint64))
        yield lo, np.concatenate(own), np.cumsum([0, *map(len, own)])


def _each(values: np.ndarray, offsets: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """Reduce each run; an empty run gives 0."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set."""
    return mix(_each(mix(values), offsets, np.add) + (offsets[1:] - offsets[:-1]).astype(np.uint64)).view(np.int64)


def wide_parities(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set a bit string: bit j is the parity of the shingles that hash to j. Bits that differ bound a difference below.

    Four to eight bits for each shingle, a power of two of them, so that they tell long sets apart too.
    """
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        width = max(512, 1 << (4 * (b - a)).bit_length())
        bits = np.bincount((values[a:b] & U(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(bits.astype(np.uint8)).tobytes())
    return out


def folded(packed: np.ndarray, bytes_: int) -> np.ndarray:
    """Parities (rows, bytes) of the shingles that hash to fewer bits."""
    while packed.shape[1] > bytes_:
        half = packed.shape[1] // 2
        packed = packed[:, :half] ^ packed[:, half:]
    return packed


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as their differences, byte by byte in planes, without the planes that are all 0."""
    if not len(values):
        return b""
    step = np.diff(values)
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8).T[: (int(step.max()).bit_length() + 7) // 8 if len(step) else 0]
    return len(values).to_bytes(8, "little") + int(values[0]).to_bytes(8, "little") + planes.tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(data[:8], "little")
    step = np.zeros((n, 8), np.uint8)
    if n > 1:
        planes = np.frombuffer(data, np.uint8, offset=16).reshape(-1, n - 1)
        step[1:, : len(planes)] = planes.T
    out = step.view("<u8")[:, 0].astype(np.uint64)
    out[0] = int.from_bytes(data[8:16], "little")
    return np.cumsum(out, dtype=np.uint64)


def prefix(n: np.ndarray, similarity: Fraction) -> np.ndarray:
    """How many of a row's columns, in one order of all columns, must hold one that a similar row has among its own."""
    p, q = similarity.numerator, similarity.denominator
    return n + (-n * p) // q + 1


class _Chunk:
    """Entries of up to 2 ** ROW_BITS documents on their way to the blocks of columns."""

    def __init__(self, name: int, blocks: int):
        self.name, self.blocks = name, blocks
        self.entries: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.size = 0

    def add(self, ids: pa.Array, n: np.ndarray, sig: np.ndarray, fresh: np.ndarray, values: np.ndarray) -> None:
        """Documents, and the shingles of the fresh ones."""
        row = np.repeat(np.flatnonzero(fresh) + self.rows, n[fresh]).astype(np.uint64)
        self.entries.append((values >> U(ROW_BITS) << U(ROW_BITS)) | row)
        self.ids.append(ids)
        self.parts.append((n, sig, fresh))
        self.rows += len(n)
        self.size += len(values)

    def packed(self) -> pa.RecordBatch:
        """A row for each block of columns, and one (kind 1) of the documents and of what other rows of a column there are."""
        entries = np.sort(np.concatenate(self.entries))
        first = np.ones(len(entries), bool)
        first[1:] = (entries[1:] ^ entries[:-1]) >> U(ROW_BITS) != 0
        at = np.flatnonzero(first)
        one, extra = entries[at], (np.diff(np.append(at, len(entries))) - 1).astype("<u4")
        edges = np.append(np.searchsorted(one, np.arange(self.blocks, dtype=np.uint64) << U(64 - (self.blocks - 1).bit_length())), len(one))
        some = np.flatnonzero(np.diff(edges))
        data = [squeeze(one[edges[b] : edges[b + 1]]) for b in some.tolist()]
        more = [extra[edges[b] : edges[b + 1]].view(np.uint8).reshape(-1, 4).T.tobytes() for b in some.tolist()]
        ids = pa.chunked_array(self.ids, pa.int64())
        known = np.ones(len(ids), bool) if not ids.null_count else ids.is_valid().to_numpy()
        n, sig, fresh = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        own = [ids.fill_null(0).to_numpy(), known, n.astype(np.int64), sig, fresh]
        count, nothing = len(some) + 1, [None] * len(some)
        columns = [
            pa.array([*some.tolist(), -1 - int(self.name % 64)], pa.int32()), pa.array([self.name] * count, pa.int64()), pa.array([0] * len(some) + [1], pa.int32()),
            pa.array([*data, squeeze(entries[~first])], pa.binary()), pa.array([*more, None], pa.binary()), *[pa.array([*nothing, x.tobytes()], pa.binary()) for x in own],
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])


def _entries(docs: DataFrame, width: int, blocks: int) -> DataFrame:
    """The chunks of all documents; a set that a task has sent already counts as not fresh."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, seen = TaskContext.get().partitionId() << 32, set()
        chunk = _Chunk(name, blocks)
        for batch in batches:
            for lo, values, offsets in sets(batch.column(1), width):
                n, sig = np.diff(offsets), signatures(values, offsets)
                fresh = np.zeros(len(sig), bool)
                for i, s in enumerate(sig.tolist()):
                    if n[i] and s not in seen:
                        fresh[i] = True
                        seen.add(s)
                if len(seen) > SEEN:
                    seen.clear()
                for a in range(0, len(n), 1 << ROW_BITS):
                    some = slice(a, a + (1 << ROW_BITS))
                    if chunk.size >= CHUNK_ENTRIES or chunk.rows + len(n[some]) > 1 << ROW_BITS:
                        yield chunk.packed()
                        name += 1
                        chunk = _Chunk(name, blocks)
                    own = values[offsets[a] : offsets[a + len(n[some])]][np.repeat(fresh[some], n[some])]
                    chunk.add(batch.column(0).slice(lo + a, len(n[some])), n[some], sig[some], fresh[some], own)
        if chunk.rows:
            yield chunk.packed()

    return docs.mapInArrow(lean(work), PACKED)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    at: tuple[int, ...] | None = None
    for batch in batches:
        named = np.stack([c.to_numpy() for c in batch.columns[:keys]], axis=1)
        edges = [0, *(np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(named[a].tolist())
            if held and own != at:
                yield pa.Table.from_batches(held)
                held = []
            at = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _counted(packed: DataFrame) -> DataFrame:
    """Each block's entries of columns that have several rows, with the columns' counts, chunk by chunk; documents pass through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _grouped(batches, 1):
            if block.column("block")[0].as_py() < 0:
                yield from block.to_batches()
                continue
            data = [unsqueeze(x.as_py()) for x in block.column("data")]
            more = [np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T).view("<u4")[:, 0] for x in block.column("extra")]
            col = np.concatenate(data) >> U(ROW_BITS)
            order = np.argsort(col, kind="stable")
            head = np.flatnonzero(np.concatenate(([True], col[order[1:]] != col[order[:-1]])))
            sums = np.add.reduceat(np.concatenate(more)[order].astype(np.int64) + 1, head)
            count = np.empty(len(col), np.int64)
            count[order] = np.repeat(sums, np.diff(np.append(head, len(col))))
            edges = np.cumsum([0, *map(len, data)])
            out = []
            for chunk, own, a, b in zip(block.column("chunk").to_pylist(), data, edges[:-1], edges[1:], strict=True):
                live = count[a:b] > 1
                if live.any():
                    out.append((chunk, squeeze(own[live]), np.minimum(count[a:b][live], 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
            if out:
                nothing = pa.nulls(len(out), pa.binary())
                columns = [pa.array([0] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary()), *[nothing] * 5]
                yield pa.RecordBatch.from_arrays(columns, block.column_names)

    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(lean(work), PACKED)


def _postings(counted: DataFrame, similarity: Fraction) -> DataFrame:
    """kind 0: every document's doc_id, n and sig (null if it has no shingle); kind 1: the columns that rows keep, with n and sig."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _grouped((b.select(["chunk", *[c for c in b.schema.names if c != "chunk"]]) for b in batches), 1):
            kind = chunk.column("kind").to_numpy()
            at = int(np.flatnonzero(kind == 1)[0])
            row = {c: chunk.column(c)[at].as_py() for c in ("data", "ids", "known", "sizes", "sigs", "fresh")}
            n, sig = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["sigs"], np.int64)
            ids, known, fresh = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["fresh"], bool)
            yield _found(0, pa.array(ids, mask=~known), n, pa.array(sig, mask=n == 0), None)
            rest = unsqueeze(row["data"])
            live = np.flatnonzero(kind == 0).tolist()
            one = np.concatenate([np.zeros(0, np.uint64), *[unsqueeze(chunk.column("data")[i].as_py()) for i in live]])
            count = np.concatenate([np.zeros(0, np.uint32), *[np.ascontiguousarray(np.frombuffer(chunk.column("extra")[i].as_py(), np.uint8).reshape(4, -1).T).view("<u4")[:, 0] for i in live]])
            order = np.argsort(one)
            one, count = one[order], count[order]
            also = count[np.searchsorted(one >> U(ROW_BITS), rest >> U(ROW_BITS))] if len(rest) else count[:0]
            entry, count = np.concatenate([one, rest]), np.concatenate([count, also])
            own = (entry & U((1 << ROW_BITS) - 1)).astype(np.int64)
            keep = prefix(n, similarity) - (n - np.bincount(own, minlength=len(n)))  # of the columns with several rows
            col = entry >> U(ROW_BITS)
            order = np.lexsort((col, count, own))
            own, col = own[order], col[order]
            place = np.arange(len(own)) - np.searchsorted(own, np.arange(len(n)))[own]
            held = place < keep[own]
            own, col = own[held], col[held]
            if len(own):
                yield _found(1, None, n[own], pa.array(sig[own]), col.astype(np.int64))

    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(work), FOUND)


def _found(kind: int, ids: pa.Array | None, n: np.ndarray, sig: pa.Array, col: np.ndarray | None) -> pa.RecordBatch:
    nothing = pa.nulls(len(n), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), nothing if ids is None else ids, pa.array(n), sig, nothing if col is None else pa.array(col)], ["kind", "doc_id", "n", "sig", "col"])


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """Signature, size, whole set and wide parities of each document that has shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, offsets in sets(batch.column(1), width):
                keep = pa.array(np.diff(offsets) > 0)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                made = [pa.array(signatures(values, offsets)), pa.array(np.diff(offsets)), lists, pa.array(wide_parities(values, offsets), pa.binary())]
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in made], ["sig", "n", "set", "wide"])

    return docs.mapInArrow(lean(work), "sig bigint, n bigint, set array<bigint>, wide binary")


def _verified(pairs: DataFrame, own: DataFrame, similarity: Fraction) -> DataFrame:
    """``pairs`` (a, b) with linked: whether their overlap, counted exactly, reaches the similarity. Sizes alone may rule it out."""
    p, q = similarity.numerator, similarity.denominator
    x, y = (own.select(F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("set").alias(f"set_{s}")) for s in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b")
    overlap = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    near = F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p
    return both.select("a", "b", F.when(near, overlap * q >= (F.col("n_a") + F.col("n_b") - overlap) * p).otherwise(False).alias("linked"))


def _tiles(placed: DataFrame) -> DataFrame:
    """at, x, y, apart, panel, sig, comp: rows (col, sig, comp, large) of columns with several components, once for each of their tiles.

    Rows of small components meet column by column; columns with the same such rows are one. A large component meets the
    other rows of its columns once, whatever number of columns they share; so a large group of copies beside a few rows
    costs no more than its rows. ``apart`` says that only rows of different panels need to be compared.
    """
    several = placed.groupBy("col").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("col")
    mixed = settle(placed.join(several, "col"), "mixed")
    panels = lambda rows: F.greatest(F.lit(1), F.ceil(rows / PANEL)).cast("int")
    some = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    few = mixed.where(~F.col("large"))
    known = few.groupBy("col").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("sig")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("b"))
    alone = known.where("lo < hi").groupBy("lo", "hi", "rows", "a", "b").agg(F.min("col").alias("col")).select("col", panels(F.col("rows")).alias("n"))
    dealt = few.join(alone, "col").withColumn("panel", F.pmod(F.xxhash64("comp"), F.col("n")).cast("int")).withColumn("other", some(F.col("n")))
    by_column = dealt.select(F.col("col").alias("at"), F.least("panel", "other").alias("x"), F.greatest("panel", "other").alias("y"), (F.col("panel") != F.col("other")).alias("apart"), "panel", "sig", "comp")

    own = mixed.where("large").select("col", F.col("comp").alias("group"), "sig")
    beside = mixed.join(own.select("col", "group").distinct(), "col").where("comp > group OR comp < group AND NOT large").select("group", F.lit(1).alias("side"), "sig", "comp")
    sides = settle(own.select("group", F.lit(0).alias("side"), "sig", F.col("group").alias("comp")).unionByName(beside).distinct(), "sides")
    count = sides.groupBy("group").agg(*[panels(F.count_if(F.col("side") == i)).alias(f"n{i}") for i in (0, 1)], F.max("side").alias("met")).where("met = 1")
    here, there = (F.when(F.col("side") == i, F.col("n0")).otherwise(F.col("n1")) for i in (0, 1))
    both = sides.join(count, "group").withColumn("place", F.pmod(F.xxhash64("sig"), here).cast("int")).withColumn("other", some(there))
    x, y = (F.when(F.col("side") == i, F.col("place")).otherwise(F.col("other")) for i in (0, 1))
    # y counts on from PANEL squared, so that no tile of a group is taken for one of a column of the same number.
    by_group = both.select(F.col("group").alias("at"), x.alias("x"), (y + PANEL * PANEL).alias("y"), F.lit(True).alias("apart"), F.col("side").alias("panel"), "sig", "comp")
    return by_column.unionByName(by_group)


def _allowed(tiled: DataFrame, similarity: Fraction) -> DataFrame:
    """a, b: of each tile the pairs of different components that sizes and parities (n, wide) allow, but for those that failed.

    Of a row at most ``PARTNERS`` of larger signature are named at a time, so that what failed with it stays a short list; a
    row of nulls says that there are more.
    """
    p, q = similarity.numerator, similarity.denominator

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _grouped(batches, 3):
            sig, comp, panel, n = (tile.column(c).to_numpy() for c in ("sig", "comp", "panel", "n"))
            apart = tile.column("apart")[0].as_py()
            packed, failed = tile.column("wide").to_pylist(), tile.column("failed").to_pylist()
            width = np.array([len(x) for x in packed])
            of = {w: np.zeros((len(sig), w), np.uint8) for w in np.unique(width).tolist()}  # also of longer ones, folded
            for w, own in of.items():
                for i in np.flatnonzero(width >= w).tolist():
                    own[i] = folded(np.frombuffer(packed[i], np.uint8)[None], w)[0]
            a, b, more = [], [], False
            for i in range(len(sig) - 1):
                near = (comp != comp[i]) & (np.minimum(n, n[i]) * q >= np.maximum(n, n[i]) * p)
                near[: i + 1] = False
                if apart:
                    near &= panel != panel[i]
                if failed[i]:
                    near &= ~np.isin(sig, failed[i])
                other = np.flatnonzero(near)
                for w in np.unique(np.minimum(width[other], width[i])).tolist():
                    some = other[np.minimum(width[other], width[i]) == w]
                    differ = np.bitwise_count((of[w][some] ^ of[w][i]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    some = some[differ * (p + q) <= (n[some] + n[i]) * (q - p)]
                    more |= len(some) > PARTNERS
                    b.append(sig[some[:PARTNERS]])
                    a.append(np.full(len(b[-1]), sig[i]))
            none = pa.array([None] * more, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])), none]) for x in (a, b)], ["a", "b"])

    order = ["at", "x", "y"]
    return tiled.repartition(*order).sortWithinPartitions(*order, "sig").mapInArrow(lean(work), "a bigint, b bigint").distinct()


def _links(live: DataFrame, own: DataFrame, similarity: Fraction) -> DataFrame:
    """node, component of all rows linked by pairs that keep a column (live: col, sig, head) in common; ``own`` has their sets."""
    stars = live.where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b")).distinct()
    links, failed = settle(_verified(stars, own, similarity).where("linked").select("a", "b"), "links"), None
    while True:
        found = components(links)
        large = found.groupBy("component").agg((F.count("*") >= GROUP).alias("large"))
        named = found.join(large, "component").unionByName(large.select("component", F.col("component").alias("node"), "large"))
        placed = live.join(named, live.sig == named.node, "left").select("col", "sig", F.coalesce("component", "sig").alias("comp"), F.coalesce("large", F.lit(False)).alias("large"))
        tiled = _tiles(placed).join(own.select("sig", "n", "wide"), "sig")  # sets and parities join only what is left
        if failed is None:
            tiled = tiled.withColumn("failed", F.lit(None).cast("array<bigint>"))
        else:
            tiled = tiled.join(failed.groupBy(F.col("a").alias("sig")).agg(F.collect_set("b").alias("failed")), "sig", "left")
        pairs = settle(_allowed(tiled.select("at", "x", "y", "sig", "apart", "panel", "comp", "n", "wide", "failed"), similarity), "allowed")
        if pairs.isEmpty():
            return found
        checked = settle(_verified(pairs.where("a IS NOT NULL"), own, similarity), "checked")
        links = settle(links.unionByName(checked.where("linked").select("a", "b")), "links")
        if pairs.where("a IS NULL").isEmpty():
            return components(links)
        bad = checked.where("NOT linked").select("a", "b")
        failed = bad if failed is None else settle(failed.unionByName(bad), "failed")


def _blocks(docs: DataFrame) -> int:
    """Blocks of columns, a power of two, from the plan's estimate of the table's size; it decides nothing but sizes."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(16, max(6, (size // 2 // BLOCK_ENTRIES).bit_length()))


def jaccard_components(docs: DataFrame, *, width: int = 5, similarity: str = "0.8", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Documents link when intersection / union of their sets is ``similarity`` or more, counted exactly on 64-bit hashes
    of the shingles. A null or empty text, or one of white space, has no shingles and no links. Copies link with each
    other; rows that repeat give rows that repeat. A null doc_id links others but is never a component's name, unless
    it is alone. Other columns are ignored; an empty table gives an empty one.
    """
    t = Fraction(similarity)
    if not 0 < t <= 1:
        raise ValueError("the similarity must be over 0, 1 at most")
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = settle(_postings(_counted(_entries(docs, width, _blocks(docs))), t), "incidence")
    table, kept = found.where("kind = 0").select("doc_id", "n", "sig"), found.where("kind = 1").select("col", "sig").distinct()
    span = kept.groupBy("col").agg(F.min("sig").alias("head"), F.max("sig").alias("last")).where("head < last").select("col", "head")
    live = settle(kept.join(span, "col"), "live")
    wanted = live.select("sig").distinct()
    holders = settle(wanted.join(table, "sig").groupBy("sig").agg(F.min("doc_id").alias("_id")), "holders")
    texts = docs.join(holders.select("_id").distinct(), docs.doc_id.eqNullSafe(F.col("_id")), "left_semi")
    own = settle(_set_rows(texts, width).join(wanted, "sig").dropDuplicates(["sig"]), "sets")
    linked = _links(live, own, t)
    named = table.join(linked, table.sig == linked.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "sig").alias("c"))
    # Written, so that the last join is one that the optimizer may broadcast, or split where a component is large.
    names = settle(named.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("name")), "names")
    return named.join(names, "c", "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, *, width: int = 5, similarity: str = "0.8") -> DataFrame:
    """The documents but those whose component has a smaller doc_id; of rows that repeat id and text one stays.

    Rows of one id but several texts go or stay together; a row with a null id stays unless it repeats another such row.
    """
    often = settle(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_often")), "often")
    if not often.isEmpty():
        same = docs.doc_id.eqNullSafe(often["_often"])
        docs = docs.join(often, same, "left_anti").unionByName(docs.join(often, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    found = jaccard_components(docs, width=width, similarity=similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs.doc_id == found["_gone"], "left_anti")
