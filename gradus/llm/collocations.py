"""Collocations: phrases that are far more common than their parts suggest, counted by suffix arrays over word ids.

The texts of a language are cut into shards of about ``SHARD`` bytes at the ends of pieces, which phrases don't cross. A
suffix array over a shard's word ids, made by prefix doubling, puts equal phrases side by side; runs of suffixes that share
k words, the intervals of the array of longest common prefixes, are the counts of its phrases of k words. Counts of all
shards are merged by key. A phrase can only be common if every phrase in it is, so two passes suffice: words in full, with
pairs and triples by a 64-bit hash; then longer phrases of common triples in full, while the first shard of each common pair
and triple says what it is. Two of those that have one hash would be counted as one: with 10^11 different ones, a given
common phrase is such a case 5 times in 10^9.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradus.llm._store import settle
from gradus.llm._text import U, _hashes, lean, mix

SHARD = 8 << 20
#: For ``bytes.translate``: A-Z in lower case, a tab as a space, and a line feed for whatever ends a piece.
FOLD = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 16, dtype=np.uint64) | U(1)
ROWS = 1 << 16
SPREAD = 3
FLUSH = 200_000  # rows of counts that a task holds
SHARDS = "shard BIGINT, lang STRING, words ARRAY<STRING>, counts ARRAY<BIGINT>, ids BINARY"
KEYS = "key BIGINT, shard BIGINT, k INT, n INT"
COUNTS = "lang STRING, phrase STRING, n BIGINT"


def encode(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words of folded text, in order of appearance, and the ids of all, with -1 between two pieces."""
    b = np.frombuffer(raw, np.uint8)
    word = (b != 10) & (b != 32)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    held = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(b[word])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(b == 10), start).astype(np.int32)
    breaks = np.cumsum(np.concatenate(([False], piece[1:] != piece[:-1])), dtype=np.int32)
    ids = np.full(len(start) + int(breaks[-1]), -1, np.int32)
    ids[np.arange(len(start), dtype=np.int32) + breaks] = held.indices.to_numpy()
    return held.dictionary.cast(pa.binary()).cast(pa.string()), ids


def _next(where: np.ndarray) -> np.ndarray:
    """For each position the first one, from it on, at which ``where`` is true; the number of positions, if there is none."""
    stops = np.append(np.flatnonzero(where), len(where)).astype(np.int32)
    return np.repeat(stops, np.diff(stops, prepend=-1))[: len(where)]


def room_of(ids: np.ndarray) -> np.ndarray:
    """Words from each position to the end of its piece, itself included; 0 between pieces."""
    return _next(ids < 0) - np.arange(len(ids), dtype=np.int32)


def common_room(good: np.ndarray, width: int) -> np.ndarray:
    """Words from each position on that common phrases of ``width`` words, which start where ``good``, cover without a gap between starts."""
    at = np.arange(len(good), dtype=np.int32)
    last = np.maximum.accumulate(np.where(good, at, -width)) if len(good) else at
    return np.where(good, _next(~good) - 1 + width - at, np.maximum(last + width - at, 0))


def intervals(ids: np.ndarray, room: np.ndarray, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length, a position of every different phrase of so many words and how often it occurs.

    ``room`` says how many words from a position on belong together. Suffixes are sorted by their first words, as many as the
    longest phrase has, by doubling: a rank of 2w words is a pair of ranks of w. What ends sooner comes first. All that is kept
    are numbers of 32 bits; a shard has fewer words than they count.
    """
    depth, n = lengths[-1], len(ids)
    sa = np.flatnonzero(room > 0).astype(np.int32)
    if not len(sa):
        return
    rank = np.zeros(n + depth, np.int32)
    rank[sa] = ids[sa] + 1
    width = 1
    while width < depth:
        key = rank[sa].astype(np.int64)
        key *= int(key.max()) + 1
        key += np.where(room[sa] > width, rank[np.minimum(sa + width, n)], 0)
        order = np.argsort(key)
        sa, key = sa[order], key[order]
        del order
        rank = np.zeros(n + depth, np.int32)
        rank[sa] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])), dtype=np.int32)
        del key
        width *= 2
    after, words = room[sa], np.append(ids, np.full(depth, -1, ids.dtype))
    del rank
    same, lcp = np.ones(len(sa) - 1, bool), np.zeros(len(sa) - 1, np.int8)
    for j in range(depth):
        same &= (after[1:] > j) & (after[:-1] > j) & (words[sa[1:] + j] == words[sa[:-1] + j])
        lcp += same
    for k in lengths:
        heads = np.flatnonzero(np.concatenate(([True], lcp < k))).astype(np.int32)
        size = np.diff(heads, append=np.int32(len(sa)))
        long = after[heads] >= k
        yield k, sa[heads[long]], size[long]


def _keys(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, length: int, lang: int) -> np.ndarray:
    """A hash of the phrase of ``length`` words at each position, alike in all shards of a language."""
    total = np.full(len(at), U(lang) + U(length), np.uint64)
    for j in range(length):
        total += hashes[ids[at + j]] * FACTORS[j]
    return mix(total).view(np.int64)


def _hash_words(words: pa.Array) -> np.ndarray:
    data = words.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    b = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _hashes(b, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _lang(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:7])


def _phrases(ids: np.ndarray, at: np.ndarray, words: pa.Array, length: int) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(ids[at + j])) for j in range(length)], " ")


def shards(docs: DataFrame) -> DataFrame:
    """``docs`` (lang, text) as ``SHARDS``: the words of each shard with their counts, and the ids of its pieces.

    A piece is never divided; a text that is longer than a shard is, between pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = 0

        def shard(lang: str, raw: bytes) -> pa.RecordBatch:
            nonlocal number
            words, ids = encode(raw)
            number += 1
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            own = pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId() << 32 | number], "lang": [lang]})
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), v) for v in (words, pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([*own.columns, *lists, pa.array([zlib.compress(ids.tobytes(), 1)])], ["shard", "lang", "words", "counts", "ids"])

        def cut(lang: str, most: int) -> Iterator[pa.RecordBatch]:
            raw = b"\n".join(held.pop(lang))
            size.pop(lang)
            lo = 0
            while len(raw) - lo > most:
                hi = raw.rfind(b"\n", lo, lo + SHARD)
                hi = raw.find(b"\n", lo + SHARD) if hi < lo else hi
                if hi < 0:
                    break
                yield shard(lang, raw[lo:hi])
                lo = hi + 1
            if most == 0:
                yield shard(lang, raw[lo:])
            else:
                held[lang], size[lang] = [raw[lo:]], len(raw) - lo

        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                texts = batch["text"].filter(pc.equal(batch["lang"], lang)).cast(pa.large_binary())
                raw = b"\n".join(t.as_py() for t in texts).translate(FOLD)
                held.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw) + 1
                if size[lang] > SHARD:
                    yield from cut(lang, SHARD)
            while sum(size.values()) > 4 * SHARD:  # very many languages
                yield from cut(max(size, key=size.get), 0)
        for lang in [*held]:
            yield from cut(lang, 0)

    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(lean(work), SHARDS)


def _hashed(given: DataFrame, longest: int) -> DataFrame:
    """``given`` (``SHARDS``) to ``KEYS``: how often each pair and triple of words occurs in a shard, by its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(zlib.decompress(batch["ids"][i].as_py()), np.int32)
                hashes, seed, shard = _hash_words(batch["words"][i].values), _lang(batch["lang"][i].as_py()), batch["shard"][i].as_py()
                for k, at, n in intervals(ids, room_of(ids), range(2, min(longest, 3) + 1)):
                    for lo in range(0, len(n), ROWS):
                        some = at[lo : lo + ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array(_keys(ids, some, hashes, k, seed)), pa.array(np.full(len(some), shard)), pa.array(np.full(len(some), k, np.int32)), pa.array(n[lo : lo + ROWS].astype(np.int32))], ["key", "shard", "k", "n"])

    return given.select("shard", "lang", "words", "ids").mapInArrow(lean(work), KEYS)


def _common(keys: DataFrame, least: int) -> DataFrame:
    """shard, the triples in it that ``least`` occurrences have in all shards, and those that it is the first to have, with their counts.

    A shard gets no more of them than it has itself. There are about as many keys as words, several times what other steps
    move, so they are dealt to ``SPREAD`` times as many tasks as is usual, which then sort less at a time.
    """
    by = W.partitionBy("key")
    tasks = SPREAD * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.repartition(tasks, "key").select("key", "shard", "k", F.sum("n").over(by).alias("total"), F.min("shard").over(by).alias("first")).where(F.col("total") >= least)
    own = F.when(F.col("shard") == F.col("first"), F.struct("key", "k", "total"))
    return rows.where((F.col("k") == 3) | own.isNotNull()).groupBy("shard").agg(F.collect_list(F.when(F.col("k") == 3, F.col("key"))).alias("triples"), F.collect_list(own).alias("named"))


def _where(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each key its place in the sorted ``wanted``, or -1."""
    if not len(wanted):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return np.where(wanted[at] == keys, at, -1)


def _counted(given: DataFrame, longest: int) -> DataFrame:
    """``given`` (``SHARDS``, triples, named) to ``COUNTS``: the named pairs and triples with all their occurrences, and
    those of each task of the longer phrases that consist of common triples."""

    def rows(lang: str, ids: np.ndarray, words: pa.Array, k: int, at: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"lang": pa.array([lang] * len(n), pa.string()), "phrase": _phrases(ids, at, words, k), "n": pa.array(n.astype(np.int64))})

    def met(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch["lang"][i].as_py(), batch["words"][i].values
                ids = np.frombuffer(zlib.decompress(batch["ids"][i].as_py()), np.int32)
                room, hashes, seed = room_of(ids), _hash_words(words), _lang(lang)
                named = batch["named"][i].values
                key, total = (named.field(c).to_numpy(zero_copy_only=False) for c in ("key", "total"))
                order = np.argsort(key)
                good = np.zeros(len(ids), bool)
                for k in range(2, min(longest, 3) + 1):
                    at = np.flatnonzero(room >= k)
                    keys = _keys(ids, at, hashes, k, seed)
                    place = _where(keys, key[order])
                    own, first = np.unique(place, return_index=True)
                    if (some := own >= 0).any():
                        held.append(rows(lang, ids, words, k, at[first[some]], total[order][own[some]]))
                    if k == 3:
                        good[at] = _where(keys, np.sort(batch["triples"][i].values.to_numpy(zero_copy_only=False))) >= 0
                if longest > 3 and good.any():
                    held += [rows(lang, ids, words, k, at, n) for k, at, n in intervals(ids, common_room(good, 3), range(4, longest + 1)) if len(n)]
                if sum(t.num_rows for t in held) > FLUSH:
                    held = [met(held)]
                    if held[0].num_rows > FLUSH // 2:
                        yield from held.pop().combine_chunks().to_batches(ROWS)
        if held:
            yield from met(held).combine_chunks().to_batches(ROWS)

    return given.select("shard", "lang", "words", "ids", "triples", "named").mapInArrow(lean(work), COUNTS)


def phrase_counts(docs: DataFrame, *, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """``docs`` (lang, text) to (lang, phrase, k, n: every phrase of up to ``longest`` words that occurs ``least`` times) and (lang, total: words).

    Counts cover all texts, and are exact but for hashes that agree (above). A null lang is ``und``, a null text is empty. Other columns are ignored.
    """
    if longest < 2 or longest > len(FACTORS):
        raise ValueError(f"longest must be from 2 to {len(FACTORS)}")
    given = settle(shards(docs), "shards")
    word = given.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("n"))
    words = settle(word, "words")
    longer = _counted(given.join(_common(_hashed(given, longest), least), "shard"), longest).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    every = words.select("lang", "phrase", "n").unionByName(longer)
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    return settle(every.where(F.col("n") >= least).select("lang", "phrase", size.alias("k"), "n"), "phrases"), words.groupBy("lang").agg(F.sum("n").alias("total"))


def _part(first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` of the array w as a phrase."""
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def collocations(docs: DataFrame, *, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score, all numbers long.

    ``docs`` (lang, text; other columns are ignored): A-Z count as a-z; a text is cut at ``.,;:!?`` and line ends into pieces,
    those at spaces and tabs into words. a, the phrase's occurrences, is ``least`` at least; n are the language's words. Cut
    after its first words a phrase has score floor(1000 a n / (l r)), with l and r the occurrences of its parts; the lowest
    cut counts, of equal ones the shortest first part. A phrase inside a longer candidate with ``share`` hundredths of its
    occurrences is dropped. The ``top`` by score, then a, then phrase in the order of UTF-8, are kept. Scores are exact as
    long as 1000 a n has no more than 38 digits; beyond that the query raises.

    No text, no word, or no common phrase gives no row. A null lang is ``und``; a null or empty text has no words.
    """
    known, totals = phrase_counts(docs, longest=longest, least=least)
    some = known.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    first, last = F.col("cut"), F.col("k")
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select("lang", "phrase", "a", "cut", _part(F.lit(1), first).alias("head"), _part(first + 1, last).alias("tail"))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    rows = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals.withColumnRenamed("total", "n"), "lang")
    wide = "CAST({} AS DECIMAL(38, 0))".format
    rows = rows.withColumn("score", F.expr(f"1000BD * {wide('a')} * {wide('n')} DIV ({wide('l')} * {wide('r')})"))
    scored = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # every shorter phrase inside a candidate, with the most that a longer one has
    begun = some.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i"))
    inner = begun.select("lang", "a", "w", "k", "i", F.explode(F.sequence(F.col("i") + 1, F.col("k"))).alias("j")).where("j - i + 1 < k")
    longer = inner.groupBy("lang", _part(F.col("i"), F.col("j")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
