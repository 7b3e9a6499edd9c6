"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole texts of about ``SHARD`` bytes inside a task, so an index never outlives its task and nothing
but the phrases is sent around. Its symbols are the words of the benchmark; a word that the benchmark lacks ends a
segment, and a segment shorter than the shortest phrase can hold none, so neither enters the index. Test phrases are
searched backwards, all at once, by ranks in a wavelet matrix over the transform; rows found are located by walking to
a sampled suffix position; covered words are merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._store import settle
from gradus.llm._text import ALNUM_LOWER, chunks, lean, split_words

SHARD = 4 << 20
SAMPLE = 8
PHRASE_BYTES = 16 << 20  # of the texts of one block of benchmark items; more items make more blocks


class Phrases(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes; symbol s is vocabulary[s - 1]
    words: np.ndarray  # (phrases, width) symbols, right-aligned, 0 before short ones
    length: np.ndarray
    item_from: np.ndarray  # phrase p belongs to items[item_from[p]:item_from[p + 1]]
    items: np.ndarray  # numbers of items
    names: list[str]


def phrases(items: list[tuple[str, str | None]], width: int) -> Phrases:
    """All windows of ``width`` words of the items; an item of fewer words, but not none, is one window."""
    own: dict[tuple[int, ...], set[int]] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    for name, text in items:
        raw = (text or "").encode()
        words = split_words(raw, np.array([0, len(raw)]), ALNUM_LOWER).hash.tolist()
        for at in range(max(1, len(words) - width + 1) if words else 0):
            own.setdefault(tuple(words[at : at + width]), set()).add(number[name])
    vocabulary = np.unique(np.array([w for p in own for w in p], np.uint64))
    table = np.zeros((len(own), width), np.int64)
    for i, p in enumerate(own):
        table[i, width - len(p) :] = np.searchsorted(vocabulary, np.array(p, np.uint64)) + 1
    counts = np.cumsum([0, *map(len, own.values())])
    return Phrases(vocabulary, table, np.array([len(p) for p in own], np.int64), counts, np.array([i for s in own.values() for i in sorted(s)], np.int64), names)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; every 0 ends a suffix, and equal suffixes go by position."""
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols + int(zero.sum())).astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:]
        if step == 1 or len(tied) > n // 2:
            part = order = np.lexsort((after, rank))
            same = np.concatenate(([False], (rank[part[1:]] == rank[part[:-1]]) & (after[part[1:]] == after[part[:-1]])))
            fresh = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            rank = np.empty(n, np.int64)
            rank[part] = fresh
        else:  # only suffixes that are tied still move, each within its own group
            part = tied[np.lexsort((after[tied], rank[tied]))]
            place = rank[part]
            group = np.concatenate(([True], place[1:] != place[:-1]))
            first = np.maximum.accumulate(np.where(group, np.arange(len(part)), 0))
            order[place + np.arange(len(part)) - first] = part
            same = np.concatenate(([False], ~group[1:] & (after[part[1:]] == after[part[:-1]])))
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(part))))
            rank = rank.copy()
            rank[part] = place + start - first
        head = np.flatnonzero(np.bincount(rank, minlength=n) > 1)
        if not len(head) or step >= n:
            return order
        often = np.zeros(n, bool)
        often[head] = True
        tied = np.flatnonzero(often[rank])
        step *= 2


class Index:
    """FM-index: a wavelet matrix over the transform, symbol starts, and every ``SAMPLE``-th suffix position."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        n = len(symbols)
        order = suffix_array(symbols)
        before = np.roll(symbols, 1)  # position 0 follows the last symbol, which is a 0
        row = before[order]
        self.n = n
        self.start = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size + 1))))
        self.ones, self.zeros = [], []
        self.bits = max(1, int(size).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        # Segment starts are sampled as well, so a walk never passes a 0.
        kept = (np.arange(n) % sample == 0) | (before == 0)
        self.sampled = kept[order]
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            low, at = (np.where(bit == 1, zeros + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def back(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer."""
        symbol, low, row = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[row + 1] - ones[row]
            symbol = symbol * 2 + bit
            low, row = (np.where(bit == 1, zeros + ones[x], x - ones[x]) for x in (low, row))
        return self.start[symbol] + row - low

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo..hi of the suffixes that begin with each phrase."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        alive = np.arange(len(words))
        for step in range(words.shape[1]):
            alive = alive[(lo[alive] < hi[alive]) & (length[alive] > step)]
            if not len(alive):
                break
            symbol = words[alive, words.shape[1] - 1 - step]
            lo[alive] = self.start[symbol] + self.rank(symbol, lo[alive])
            hi[alive] = self.start[symbol] + self.rank(symbol, hi[alive])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        at = rows.copy()
        while len(left):
            done = self.sampled[at[left]]
            hit = left[done]
            out[hit] = self.positions[self.place[at[hit]]] + walked[hit]
            left = left[~done]
            at[left] = self.back(at[left])
            walked[left] += 1
        return out


def occurrences(hashes: np.ndarray, doc: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and first word of every occurrence in a shard; ``doc`` has the first word of each document."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(wanted.words):
        return none, none
    at = np.minimum(np.searchsorted(wanted.vocabulary, hashes), len(wanted.vocabulary) - 1)
    symbols = np.where(wanted.vocabulary[at] == hashes, at + 1, 0)
    # Segments: runs of known words in one document.
    known = symbols > 0
    cut = np.zeros(len(symbols) + 1, bool)
    cut[doc] = True
    begins = known & (cut[:-1] | np.concatenate(([True], ~known[:-1])))
    segment = np.cumsum(begins) - 1
    size = np.bincount(segment[known], minlength=int(begins.sum()))
    keep = np.zeros(len(symbols), bool)
    keep[known] = size[segment[known]] >= wanted.length.min()
    place = np.flatnonzero(keep)
    if not len(place):
        return none, none
    own = segment[place]
    first = np.concatenate(([True], own[1:] != own[:-1]))
    to = np.arange(len(place)) + np.cumsum(first)  # a 0 before each segment
    text = np.zeros(to[-1] + 2, np.int64)
    text[to] = symbols[place]
    index = Index(text, len(wanted.vocabulary))
    lo, hi = index.search(wanted.words, wanted.length)
    phrase = np.repeat(np.arange(len(lo)), hi - lo)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    back = np.zeros(len(text), np.int64)
    back[to] = place
    return phrase, back[index.locate(rows)]


SPANS = "array<struct<start:bigint,end:bigint>>"
HITS = pa.struct([("words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _found(texts: pa.Array, old: pa.Array, wanted: Phrases) -> list[dict]:
    """Per text: its words, and spans and items that occur, joined with those found before."""
    made: list[dict] = []
    for lo, hi, raw, offsets in chunks(texts, SHARD):
        words = split_words(raw, offsets, ALNUM_LOWER)
        phrase, at = occurrences(words.hash, words.doc[:-1], wanted)
        count = np.diff(words.doc)
        cover = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + wanted.length[phrase], -1)
        covered = np.cumsum(cover)[:-1] > 0
        owner = np.searchsorted(words.doc, at, "right") - 1
        items: dict[int, set[int]] = {}
        for d, p in np.unique(np.stack([owner, phrase]), axis=1).T.tolist():
            items.setdefault(d, set()).update(wanted.items[wanted.item_from[p] : wanted.item_from[p + 1]].tolist())
        for d in range(hi - lo):
            before = old[lo + d].as_py()
            spans, names = [], [wanted.names[i] for i in items.get(d, ())] + (before["items"] if before else [])
            if names:
                own = covered[words.doc[d] : words.doc[d + 1]].copy()
                for s in before["spans"] if before else ():
                    own[s["start"] : s["end"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
            made.append({"words": int(count[d]), "spans": spans, "items": sorted(names)})
    return made


def _without(texts: pa.Array, hits: list[dict]) -> pa.Array:
    """The texts without the bytes from the first to the last word of each span."""
    if not any(h["spans"] for h in hits):
        return texts
    out = []
    for said, h in zip(texts, hits, strict=True):
        if h["spans"]:
            raw = said.as_py().encode()
            words = split_words(raw, np.array([0, len(raw)]), ALNUM_LOWER)
            edges = [0, *[e for s in h["spans"] for e in (int(words.start[s["start"]]), int(words.end[s["end"] - 1]))], len(raw)]
            out.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)).decode())
        else:
            out.append(said.as_py())
    return pa.array(out, texts.type)


def _search(docs: DataFrame, benchmark: DataFrame, width: int, text: str, item_id: str, item_text: str, cut: bool) -> DataFrame:
    """``docs`` with _hits; with ``cut`` the last pass leaves the spans out of the texts, so that one worker does both."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("said")).where("name IS NOT NULL")
    total = tests.agg(F.sum(F.octet_length("said"))).first()[0] or 0
    n_blocks = 1 + total * 2 // PHRASE_BYTES
    out = docs.drop("_hits").withColumn("_hits", F.lit(None).cast(f"struct<words:bigint,spans:{SPANS},items:array<string>>"))
    for k in range(n_blocks):
        block = tests.where(F.pmod(F.xxhash64("name"), F.lit(n_blocks)) == k)
        sent = spark.sparkContext.broadcast(phrases([(r[0], r[1]) for r in block.collect()], width))

        def work(batches: Iterator[pa.RecordBatch], sent=sent, cut=cut and k == n_blocks - 1) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            for batch in batches:
                at, columns = batch.schema.get_field_index(text), list(batch.columns)
                made = _found(columns[at], columns[-1], wanted)
                if cut:
                    columns[at] = _without(columns[at], made)
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(made, HITS)], batch.schema.names)

        out = out.mapInArrow(lean(work), out.schema)
        if k < n_blocks - 1:
            out = settle(out, "hits")  # a pass for each block, so that no task holds more than one
    return out


def mark(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with _hits: words (bigint), word spans and item ids that occur, all sorted; a column of that name is replaced.

    Items are gathered in blocks of at most about ``PHRASE_BYTES`` of text, each broadcast and searched in every shard
    in a pass of its own, so any number of items is searched whole, without a shuffle, and a task holds one block. Words
    are runs of letters, digits and characters beyond ASCII, A-Z lowered. A null text has no words; null items have none;
    an item of fewer than ``width`` words is searched whole; item ids are compared as strings. Rows that repeat are
    searched alike; an empty table stays empty.
    """
    return _search(docs, benchmark, width, text, item_id, item_text, cut=False)


def digests(marked: DataFrame) -> DataFrame:
    """Per marked document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("_hits.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return marked.select("doc_id", F.col("_hits.words").alias("n_words"), hit.alias("n_hit"), F.size("_hits.items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "_hits.items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _kept(cut: DataFrame, text: str, chars: str | None) -> DataFrame:
    """The cut documents that have words left, with ``chars`` brought up to date and without _hits."""
    whole = F.aggregate("_hits.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    hit = F.size("_hits.spans") > 0
    left = cut.where(~hit | (whole < F.col("_hits.words")))
    if chars and chars in cut.columns:
        left = left.withColumn(chars, F.when(hit, F.length(text).cast(cut.schema[chars].dataType)).otherwise(F.col(chars)))
    return left.drop("_hits")


def remove(marked: DataFrame, *, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The marked documents without the bytes from the first to the last word of each span; ``chars`` is brought up to date.

    A document without spans keeps its text as it is, null or empty as well; one of which no word is left goes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = batch.schema.get_field_index(text), list(batch.columns)
            columns[at] = _without(columns[at], columns[-1].to_pylist())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    marked = marked.select(*[c for c in marked.columns if c != "_hits"], "_hits")
    return _kept(marked.mapInArrow(lean(work), marked.schema), text, chars)


def cut(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``remove(mark(docs, benchmark))`` in one pass over the texts."""
    return _kept(_search(docs, benchmark, width, text, "item_id", "text", cut=True), text, chars)
