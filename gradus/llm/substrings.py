"""Exact removal of repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

A passage counts from ``width`` words on. Every window of that many words has an anchor: the least hash among its runs
of ``anchor`` words, the leftmost of equals. Equal windows have equal anchors, so a reference block holds the excerpts
(consecutive windows of one anchor, with all their words) of one anchor from all documents, and a document needs
parsing only against the blocks of its own anchors: no other block can hold a window of it. Equal excerpts are one
reference with a count, summed before and after the shuffle, so a passage in a third of all texts is no task's burden;
blocks of one occurrence are left out before any words move.

Within a block each excerpt is factored greedily: from a word on, the longest run that a reference of the block holds
somewhere else; an excerpt that occurs several times is a reference for itself. A factor of ``width`` words or more is a
repeated span; after each the parse steps back to the first window that the factor doesn't cover, so that windows across
factor boundaries are looked up too. A block of more than ``BLOCK`` references is parted by longer anchors, of its own
windows: those of the next length, and at last the windows themselves, whose blocks have one reference each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm._store import settle
from gradus.llm._text import SPACED, U, _power, chunks, lean, mix, split_words, windows

BROADCAST_BYTES = 16 << 20  # of keys of texts, at 16 bytes each
BLOCK = 512  # references of a block that is parsed as one
TASK_EXCERPTS = 20_000  # excerpts that a task parses, about
SEEN = 200_000
SLICE = 512  # texts that a task holds as Python objects
_Q = 0xD6E8FEB86659FD93
_Q_INVERSE = pow(_Q, -1, 1 << 64)


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end of each run, its length included."""
    n = len(hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power("q", _Q, n)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _power("q inverse", _Q_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def excerpts_of(hashes: np.ndarray, doc: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of the words of a chunk: document, anchor, first window and number of windows of each excerpt."""
    m = len(hashes) - width + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none.astype(np.uint64), none, none
    grams = windows(hashes, anchor, 11)
    best, at = grams[:m].copy(), np.zeros(m, np.int64)
    for s in range(1, width - anchor + 1):
        other = grams[s : s + m]
        less = other < best
        np.copyto(best, other, where=less)
        at[less] = s
    owner = np.repeat(np.arange(len(doc) - 1), np.diff(doc))[:m]
    valid = np.arange(m) + width <= doc[1:][owner]
    place = np.where(valid, np.arange(m) + at, -1)
    edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(edge, m))
    edge, count = edge[valid[edge]], count[valid[edge]]
    return owner[edge], best[edge], edge, count


def _anchored(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """Excerpts of every text, once for each task: anchor, hash of the words, key of the text, first window, windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            fresh = np.zeros(len(keys), bool)
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    fresh[i] = True
                    seen.add(k)
            if len(seen) > SEEN:
                seen.clear()
            keys, texts = keys[fresh], batch.column(1).filter(pa.array(fresh))
            for lo, _, raw, offsets in chunks(texts):
                words = split_words(raw, offsets, SPACED)
                owner, best, first, count = excerpts_of(words.hash, words.doc, width, anchor)
                whole = run_hashes(words.hash, first, first + count + width - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(best.view(np.int64)), pa.array(whole), pa.array(keys[lo + owner]), pa.array((first - words.doc[owner]).astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "whole", "key", "first", "n"])

    return docs.select("key", "text").mapInArrow(lean(work), "anchor bigint, whole bigint, key bigint, first int, n int")


def _words_of(texts: DataFrame, width: int) -> DataFrame:
    """The word hashes of the wanted excerpts of each text, with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            for lo, hi, raw, offsets in chunks(batch.column(0)):
                words = split_words(raw, offsets, SPACED)
                out: list[tuple[int, int, int, bytes]] = []
                for d in range(hi - lo):
                    base = words.doc[d]
                    for w in wanted[lo + d].as_py():
                        a = base + w["first"]
                        out.append((w["anchor"], w["whole"], w["c"], words.hash[a : a + w["n"] + width - 1].tobytes()))
                yield _batch(out, EXCERPT_COLUMNS)

    return texts.select("text", "wanted").mapInArrow(lean(work), EXCERPTS)


EXCERPTS, EXCERPT_COLUMNS = "anchor bigint, whole bigint, c bigint, words binary", [("anchor", pa.int64()), ("whole", pa.int64()), ("c", pa.int64()), ("words", pa.binary())]
SPANS, SPAN_COLUMNS = "anchor bigint, whole bigint, off int, m int", [("anchor", pa.int64()), ("whole", pa.int64()), ("off", pa.int32()), ("m", pa.int32())]


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, columns, strict=True)], [name for name, _ in columns])


def factor(block: list[np.ndarray], count: list[int], width: int) -> list[list[tuple[int, int]]]:
    """For each excerpt of a block: the runs (first window, windows) that the block's references hold somewhere else.

    An excerpt whose count is over 1 is somewhere else as well.
    """
    index: dict[int, tuple[int, int, int, int]] = {}  # window to two places; one place twice if its excerpt occurs twice
    hashes = [windows(x, width, 13).tolist() for x in block]
    for v, own in enumerate(hashes):
        for o, h in enumerate(own):
            got = index.get(h)
            if got is None:
                index[h] = (v, o, v, o) if count[v] > 1 else (v, o, -1, -1)
            elif got[2] < 0:
                index[h] = (got[0], got[1], v, o)
    out = []
    for v, own in enumerate(hashes):
        spans, i = [], 0
        while i < len(own):
            a, o, b, p = index[own[i]]
            if (a, o) == (v, i):
                a, o = b, p
            if a < 0:
                i += 1  # no factor of that length from here
                continue
            mine, other = block[v][i + width :], block[a][o + width :]
            n = min(len(mine), len(other))
            unlike = np.flatnonzero(mine[:n] != other[:n])
            length = width + (int(unlike[0]) if len(unlike) else n)
            spans.append((i, length - width + 1))
            i += length - width + 1
        out.append(spans)
    return out


def _parsed(excerpts: DataFrame, tasks: int, width: int) -> DataFrame:
    """Repeated windows of each excerpt, from the parse of its block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(anchor: int, block: dict[int, tuple[int, bytes]]) -> list[tuple[int, int, int, int]]:
            found = factor([np.frombuffer(w, np.uint64) for _, w in block.values()], [c for c, _ in block.values()], width)
            return [(anchor, name, first, n) for name, spans in zip(block, found, strict=True) for first, n in spans]

        anchor, block = None, {}
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for a, name, c, words in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if a != anchor:
                    out += emit(anchor, block)
                    anchor, block = a, {}
                block[name] = (c, words)
            yield _batch(out, SPAN_COLUMNS)
        yield _batch(emit(anchor, block), SPAN_COLUMNS)

    return excerpts.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(work), SPANS)


def _parted(excerpts: DataFrame, width: int, anchor: int) -> DataFrame:
    """Excerpts of the excerpts by anchors of ``anchor`` words: those, their words, and their place in their parent."""
    columns = [*EXCERPT_COLUMNS, ("of_anchor", pa.int64()), ("of_whole", pa.int64()), ("at", pa.int32())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, name, c, words in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                own = np.frombuffer(words, np.uint64)
                _, best, first, n = excerpts_of(own, np.array([0, len(own)]), width, anchor)
                wholes = run_hashes(own, first, first + n + width - 1).view(np.int64).tolist()
                for h, w, f, k in zip(best.view(np.int64).tolist(), wholes, first.tolist(), n.tolist(), strict=True):
                    out.append((h, w, c, own[f : f + k + width - 1].tobytes(), a, name, f))
            yield _batch(out, columns)

    return excerpts.mapInArrow(lean(work), f"{EXCERPTS}, of_anchor bigint, of_whole bigint, at int")


def _repeats(excerpts: DataFrame, width: int, anchors: list[int]) -> DataFrame:
    """anchor, whole, off, m: the repeated windows of ``excerpts`` (anchor, whole, c, words), block by block."""
    sizes = settle(excerpts.groupBy("anchor").agg(F.count("*").alias("v")).where(F.col("v") > BLOCK).select("anchor"), "sizes")
    tasks = 1 + excerpts.count() // TASK_EXCERPTS
    if not anchors or sizes.isEmpty():
        return _parsed(excerpts, tasks, width)
    parted = settle(_parted(excerpts.join(sizes, "anchor", "left_semi"), width, anchors[0]), "parted")
    inner = settle(parted.groupBy("anchor", "whole").agg(F.sum("c").alias("c"), F.first("words").alias("words")), "excerpts")
    places = parted.select("anchor", "whole", "of_anchor", "of_whole", "at")
    found = places.join(_repeats(inner, width, anchors[1:]), ["anchor", "whole"])
    found = found.select(F.col("of_anchor").alias("anchor"), F.col("of_whole").alias("whole"), (F.col("at") + F.col("off")).alias("off"), "m")
    return _parsed(excerpts.join(sizes, "anchor", "left_anti"), tasks, width).unionByName(found)


def repeated_windows(texts: DataFrame, *, width: int, anchor: int) -> DataFrame:
    """``texts`` (key, text) to (key, spans): runs of windows of the text that start elsewhere too, as (first, n).

    A text that occurs in several rows is counted once here; its caller knows that all its windows repeat.
    """
    rows = settle(_anchored(texts, width, anchor), "anchored")
    kinds = rows.groupBy("anchor", "whole").agg(F.count("*").alias("c"), F.min(F.struct("key", "first", "n")).alias("at"))
    several = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    parse = settle(kinds.join(several, "anchor").select("anchor", "whole", "c", F.col("at.key").alias("key"), F.col("at.first").alias("first"), F.col("at.n").alias("n")), "wanted")
    wanted = parse.groupBy("key").agg(F.collect_list(F.struct("anchor", "whole", "c", "first", "n")).alias("wanted"))
    keys = settle(parse.select("key").distinct(), "keys")
    few = keys.count() * 16 <= BROADCAST_BYTES  # beyond that, all texts are shuffled here
    own = texts.join(F.broadcast(keys), "key", "left_semi") if few else texts
    excerpts = settle(_words_of(own.join(wanted, "key"), width).dropDuplicates(["anchor", "whole"]), "words")
    spans = _repeats(excerpts, width, [(anchor + width) // 2, width])
    found = rows.join(spans, ["anchor", "whole"]).select("key", (F.col("first") + F.col("off")).alias("first"), F.col("m").alias("n")).distinct()
    return found.groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_repeats(docs: DataFrame, *, width: int = 50, anchor: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, kept (its words outside repeated passages, joined by one space), n_words, n_removed.

    A word goes if a window of ``width`` words over it also starts anywhere else, in the same document or another, as
    judged on the input. Words are runs without ASCII white space, unchanged. A null text has no words; texts of fewer
    than ``width`` words keep all; every word of a longer text in several rows goes. Rows that repeat give rows that
    repeat, null ids included; other columns are ignored; an empty table gives an empty one. Texts are told apart by 64-bit
    hashes, as are words and windows: over 10^9 different texts two are expected to agree 0.03 times.
    """
    if not 1 <= anchor <= width:
        raise ValueError("an anchor must fit the window")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _key(F.col(text)).alias("key"))
    spans = settle(repeated_windows(own, width=width, anchor=anchor), "spans")
    copies = settle(own.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied")), "copies")
    marks = settle(spans.join(copies, "key", "full_outer"), "marks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            kept, n_words, n_removed = [], [], []
            for said, runs, copied in zip(*[batch.column(i) for i in (1, 2, 3)], strict=True):
                words = (said.as_py() or "").encode().split()
                n = len(words)
                gone = np.zeros(n + 1, np.int64)
                if copied.as_py() and n >= width:
                    gone[0] = 1
                for s in runs.as_py() or ():
                    gone[s["first"]] += 1
                    gone[s["first"] + s["n"] + width - 1] -= 1
                out = np.cumsum(gone)[:n] > 0
                removed = int(out.sum())
                kept.append(b" ".join(words if not removed else [words[i] for i in np.flatnonzero(~out)]).decode())
                n_words.append(n)
                n_removed.append(removed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    joined = own.join(marks, "key", "left").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "spans", "copied")
    return joined.mapInArrow(lean(work), "doc_id bigint, kept string, n_words bigint, n_removed bigint")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
