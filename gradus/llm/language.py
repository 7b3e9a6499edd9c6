"""Language identification by unigram pieces, summed over all segmentations of each word.

The pieces are those of a public vocabulary, which is only read. For each language, expectation maximisation over the
words of labelled texts gives each piece a probability; the forward sum over all ways to cut a word into pieces gives
the probability of the word, however long it is. A text's score is the posterior of its best language at its mean word
under equal priors, so that it doesn't run to 1 with the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm._text import U, chunks, lean, release

UNDETERMINED = "und"
TRAIN_TEXTS = 300  # labelled texts of each language that the model is fitted on, at most about
UNKNOWN = 1e-9  # probability of a letter that is no piece
SPREAD = 4.0  # of a letter's log probability above that of even pieces: a mean over n letters is uncertain by SPREAD / sqrt(n)
STEP = 16  # letters after which the sums of a word are scaled again, while scoring: UNKNOWN to that power is no 0
LETTERS = 200_000  # of the words whose pieces are looked up at a time
CACHE = 200_000  # words that a task remembers
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SIEVE = 20  # bits of a hash that tell most strings from pieces before they are looked up
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Model(NamedTuple):
    languages: list[str]
    keys: np.ndarray  # sorted hashes of the pieces
    length: int  # of the longest piece
    probability: np.ndarray  # (pieces + 1, languages); the last row is for no piece


class Hits(NamedTuple):
    """Occurrences of pieces in words; a letter that is no piece has the number after the last piece."""

    end: np.ndarray
    owner: np.ndarray  # number of the word
    span: np.ndarray  # letters
    piece: np.ndarray


def pieces(path: str) -> list[str]:
    """Lower-cased pieces of letters, with a leading mark where they begin a word."""
    from sentencepiece import SentencePieceProcessor

    reader = SentencePieceProcessor(model_file=path)
    found = {reader.id_to_piece(i).lower() for i in range(reader.get_piece_size())}
    return sorted(x for x in found if x.removeprefix("▁").isalpha() or x == "▁")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(longest, words) code points behind a mark, 0 beyond the end; lengths with the mark."""
    size = np.array([len(w) + 1 for w in words])
    flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), int(size.max())), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return np.ascontiguousarray(out.T), size


def _piece_hashes(texts: list[str]) -> np.ndarray:
    return np.array([sum((ord(c) + 1) * pow(_BASE, j, 1 << 64) for j, c in enumerate(t)) & ((1 << 64) - 1) for t in texts], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words, given by length, that make a table of about ``LETTERS`` letters."""
    lo = 0
    while lo < len(sizes):
        some = sizes[lo : lo + LETTERS]
        hi = lo + max(1, int((np.arange(1, len(some) + 1) * some <= LETTERS).sum()))
        yield lo, hi
        lo = hi


def _hits(codes: np.ndarray, size: np.ndarray, first: int, last: int, keys: np.ndarray, length: int) -> Hits:
    """The pieces that end after letters ``first`` + 1 to ``last`` of the words, by end, then word."""
    base = max(0, first + 1 - length)
    power, inverse = _powers(_BASE, last - base), _powers(_BASE_INVERSE, last - base + 1)
    total = np.zeros((last - base + 1, codes.shape[1]), np.uint64)
    np.cumsum((codes[base:last].astype(np.uint64) + U(1)) * power[:, None], axis=0, out=total[1:])
    sieve = np.zeros(1 << _SIEVE, bool)
    sieve[keys >> U(64 - _SIEVE)] = True
    found = []
    for k in range(1, min(length, last) + 1):
        ends = np.arange(max(first + 1, k), last + 1)
        h = (total[ends - base] - total[ends - base - k]) * inverse[ends - base - k][:, None]
        inside = ends[:, None] <= size
        i, own = np.nonzero(inside if k == 1 else inside & sieve[h >> U(64 - _SIEVE)])
        own_hash = h[i, own]
        at = np.minimum(np.searchsorted(keys, own_hash), len(keys) - 1)
        hit = keys[at] == own_hash
        if k == 1:
            at = np.where(hit, at, len(keys))
        else:
            i, own, at = i[hit], own[hit], at[hit]
        found.append((ends[i], own, np.full(len(i), k), at))
    end, owner, span, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end * codes.shape[1] + owner, kind="stable")
    return Hits(end[order], owner[order], span[order], piece[order])


def _summed(part: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Put the sums of the rows of each owner, which are in order, into the rows of ``out``."""
    if len(owner):
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[head]] = np.add.reduceat(part, head)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations.

    Only the sums at the last ``model.length`` letters are kept; they are scaled every ``STEP`` letters.
    """
    codes, size = _codes(words)
    around, width = model.length + 1, max(1, LETTERS // len(words))
    ring = np.zeros((around, len(words), len(model.languages)))
    ring[0] = 1
    logs = np.zeros(ring.shape[1:])
    out = np.zeros_like(logs)
    for first in range(0, len(codes), width):
        last = min(first + width, len(codes))
        hits = _hits(codes, size, first, last, model.keys, model.length)
        edge = np.searchsorted(hits.end, np.arange(first + 1, last + 2))
        for e in range(first + 1, last + 1):
            some = slice(edge[e - first - 1], edge[e - first])
            own, here = hits.owner[some], ring[e % around]
            part = ring[(e - hits.span[some]) % around, own] * model.probability[hits.piece[some]]
            here[:] = 0
            _summed(part, own, here)
            done = np.flatnonzero(size == e)
            if len(done):
                out[done] = np.log(here[done]) + logs[done]
            if e % STEP == 0:
                scale = np.where(here > 0, here, 1.0)
                ring /= scale
                logs += np.log(scale)
    return out


def fit(counts: dict[str, dict[str, int]], vocabulary: str, rounds: int = 3) -> Model:
    """Piece probabilities of each language from its word counts, whole words of any length."""
    languages = sorted(counts)
    names = pieces(vocabulary)
    hashes = _piece_hashes(names)
    order = np.argsort(hashes)
    keys, longest = hashes[order], max(map(len, names))
    words = sorted({w for c in counts.values() for w in c}, key=lambda w: (len(w), w))
    weight = np.array([[counts[x].get(w, 0) for x in languages] for w in words], float).reshape(len(words), len(languages))
    probability = np.full((len(keys) + 1, len(languages)), 1 / len(keys))
    probability[-1] = UNKNOWN
    parts = list(_runs(np.array([len(w) + 1 for w in words], np.int64)))
    for _ in range(rounds):
        total = np.zeros_like(probability)
        for lo, hi in parts:
            _expect(words[lo:hi], weight[lo:hi], keys, longest, probability, total)
        total[-1] = 0
        probability = (total + 0.01) / (total.sum(axis=0) + 0.01 * len(keys))
        probability[-1] = UNKNOWN
    return Model(languages, keys, longest, probability)


def _expect(words: list[str], weight: np.ndarray, keys: np.ndarray, longest: int, probability: np.ndarray, total: np.ndarray) -> None:
    """Add how often each piece is expected in the segmentations of the words, by forward and backward sums.

    Sums are kept as logs, each taken next to its neighbour's: a piece's letters apart they differ by no more than so many
    unknown letters, so words may be of any length.
    """
    codes, size = _codes(words)
    hits = _hits(codes, size, 0, len(codes), keys, longest)
    start = hits.end - hits.span
    before = np.full((len(codes) + 1, *weight.shape), -np.inf)
    before[0] = 0
    edge = np.searchsorted(hits.end, np.arange(1, len(codes) + 2))
    for e in range(1, len(codes) + 1):
        some = slice(edge[e - 1], edge[e])
        own, near = hits.owner[some], before[e - 1]
        here = np.ones_like(near)
        _summed(np.exp(before[start[some], own] - near[own]) * probability[hits.piece[some]], own, here)
        live = size >= e
        before[e, live] = near[live] + np.log(here[live])
    whole = before[size, np.arange(len(words))]
    after = np.full_like(before, -np.inf)
    after[size, np.arange(len(words))] = 0
    back = np.argsort(start * len(words) + hits.owner, kind="stable")
    edge = np.searchsorted(start[back], np.arange(len(codes) + 1))
    for s in range(len(codes) - 1, -1, -1):
        some = back[edge[s] : edge[s + 1]]
        own, near = hits.owner[some], after[s + 1]
        here = np.ones_like(near)
        _summed(np.exp(after[hits.end[some], own] - near[own]) * probability[hits.piece[some]], own, here)
        live = size > s
        after[s, live] = near[live] + np.log(here[live])
    share = np.exp(before[start, hits.owner] + after[hits.end, hits.owner] - whole[hits.owner]) * probability[hits.piece] * weight[hits.owner]
    for x in range(weight.shape[1]):
        total[:, x] += np.bincount(hits.piece, share[:, x], len(total))


def split(raw: bytes) -> list[bytes]:
    """Runs of letters and characters beyond ASCII, A-Z lowered."""
    return raw.translate(_LETTERS).split()


def letters(word: bytes) -> list[str]:
    """The runs of letters in a run of ``split``, lowered."""
    return [word.decode()] if word.isascii() else _RUN.findall(word.decode().lower())


def with_uniform(model: Model) -> Model:
    """``model`` with one more language in which all pieces, and letters that are none, are equally likely."""
    flat = np.full((len(model.probability), 1), 1 / len(model.keys))
    return model._replace(languages=[*model.languages, UNDETERMINED], probability=np.hstack([model.probability, flat]))


class Scorer:
    """Scores of texts; remembers up to ``CACHE`` words."""

    def __init__(self, model: Model):
        self.model, self.rows, self.number = model, np.zeros((0, len(model.languages) + 2)), {}

    def _learn(self, fresh: list[bytes]) -> None:
        parts = [letters(w) for w in fresh]
        flat = sorted({p for x in parts for p in x}, key=len)
        place = {p: i for i, p in enumerate(flat)}
        known = np.zeros((len(flat), len(self.model.languages)))
        for lo, hi in _runs(np.array([len(p) + 1 for p in flat], np.int64)):
            known[lo:hi] = word_scores(flat[lo:hi], self.model)
        size = np.array([len(x) for x in parts])
        rows = np.zeros((len(fresh), len(self.model.languages) + 2))
        rows[:, -1] = size > 0
        rows[:, -2] = [sum(map(len, x)) for x in parts]
        owner = np.repeat(np.arange(len(fresh)), size)
        np.add.at(rows[:, :-2], owner, known[[place[p] for x in parts for p in x]])
        base = len(self.number)
        self.number.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        self.rows = np.concatenate([self.rows, rows])

    def totals(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Per text: log probability in each language, the number of its letters, and that of its words with letters."""
        each = [split(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        words = [w for x in each for w in x]
        at = list(map(self.number.get, words))
        fresh = list({w for w, i in zip(words, at, strict=True) if i is None})
        if fresh:
            if len(self.number) + len(fresh) > CACHE:
                self.number, self.rows = {}, self.rows[:0]
                fresh = list(set(words))
            self._learn(fresh)
            at = list(map(self.number.get, words))
        out = np.zeros((len(each), len(self.model.languages) + 2))
        first = np.cumsum([0, *map(len, each)])
        some = first[1:] > first[:-1]
        if some.any():
            out[some] = np.add.reduceat(self.rows[at], first[:-1][some])
        return out


def train(labelled: DataFrame, vocabulary: str, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", texts: int = TRAIN_TEXTS) -> Model | None:
    """A model from about ``texts`` labelled texts of each language, chosen by hash; None if none is labelled.

    The sample is bounded: its word counts, at most those of ``texts`` texts a language, come to the driver.
    """
    own = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in own.groupBy(lang).count().collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, texts / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 20)) / F.lit(1 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for name, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in split(said.encode()):
                    for part in letters(word):
                        found[name, part] = found.get((name, part), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    words = own.where(place < share).select(lang, text).mapInArrow(lean(work), "lang string, word string, n bigint")
    counts: dict[str, dict[str, int]] = {}
    for name, word, n in words.groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        counts.setdefault(name, {})[word] = n
    model = fit(counts, vocabulary) if counts else None
    del counts
    release()
    return model


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", pred: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, and on demand ``fit``, from the text alone; columns of those names are replaced.

    A text that is null, or without any letter, is ``und`` with score 0, as is every text if there is no model. Equal
    scores go to the language first in order. The score is the best language's posterior at the text's mean word: 1 over
    the number of languages where they are equally likely, however long the text. ``fit`` names a column for the log probability a letter of the best language
    above that of pieces drawn evenly, plus its uncertainty over so few letters: it doesn't grow with length and is below
    0 for what no learned language explains; null where the text is ``und``. Rows that repeat are judged alike; an empty table stays empty.
    """
    extra = [fit] if fit else []
    docs = docs.drop(pred, score, *extra)
    sent = docs.sparkSession.sparkContext.broadcast(with_uniform(model) if fit and model else model)
    kinds = [pa.string(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = model and Scorer(model)  # of this task alone: what it remembers goes with it
        for batch in batches:
            names, scores, fits = [], [], []
            for lo, hi, raw, offsets in chunks(batch.column(batch.schema.get_field_index(text))):
                if not model:
                    names += [UNDETERMINED] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    fits += [None] * (hi - lo)
                    continue
                total = scorer.totals(raw, offsets)
                logs = total[:, : len(model.languages) - len(extra)]
                best = logs.argmax(axis=1)
                posterior = 1 / np.exp((logs - logs.max(axis=1, keepdims=True)) / np.maximum(total[:, -1:], 1)).sum(axis=1)
                some = total[:, -1] > 0
                names += [model.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores += np.where(some, posterior, 0.0).tolist()
                if fit:
                    size = np.maximum(total[:, -2], 1)
                    above = (logs.max(axis=1) - total[:, -3]) / size + SPREAD / np.sqrt(size)
                    fits += [x if s else None for x, s in zip(above.tolist(), some.tolist(), strict=True)]
            made = [pa.array(x, t) for x, t in zip((names, scores, fits)[: 2 + len(extra)], kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, pred, score, *extra])

    fields = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in extra]]
    return docs.mapInArrow(lean(work), T.StructType([*docs.schema.fields, *fields]))


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of training: those whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
