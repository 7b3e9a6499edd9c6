"""Chat formatting: render whole conversations, encode once, find the tokens of the assistant by their offsets.

The public vocabulary is one of bytes, so the tokens of a text tile its bytes, and sums of their lengths are their offsets.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._text import lean

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, MIDDLE, END)
# Fixed value: the pattern that parts a text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
AT_ONCE = 64  # conversations that a worker holds as Python objects
SCHEMA = """conv_id bigint, formatted string, input_ids array<int>, loss_mask array<boolean>,
    loss_spans array<struct<start:bigint,end:bigint>>"""


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` undoes it. Only texts with ``\\`` or ``<|`` change."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted character spans of the texts of role ``learn``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        parts += [head, body, END]
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition(MIDDLE)
        turns.append((unescape(role), unescape(rest.removesuffix(END))))
    return turns


class Vocabulary(NamedTuple):
    encode: Callable[[str], np.ndarray]
    size: np.ndarray  # bytes of each token
    decode: Callable[[np.ndarray], bytes]


@functools.lru_cache(1)
def vocabulary_at(path: str) -> Vocabulary:
    """The public byte vocabulary (lines of base64 and rank) at ``path``, with the three control strings as further tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    first = max(ranks.values()) + 2  # the number between is another control string's in this family of vocabularies
    control = {c: first + i for i, c in enumerate(CONTROL)}
    size = np.zeros(first + len(CONTROL), np.int64)
    for word, i in [*ranks.items(), *((c.encode(), i) for c, i in control.items())]:
        size[i] = len(word)
    own = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=control)
    return Vocabulary(lambda text: own.encode_to_numpy(text, allowed_special="all").astype(np.int32), size, lambda ids: own.decode_bytes(ids.tolist()))


def token_mask(ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens touch a span, and what of each span those tokens cover; tokens by the bytes at which they end.

    Spans (n, 2) are sorted and apart, and tokens tile the text: binary search finds the first and last token of each span.
    """
    starts = ends - np.diff(ends, prepend=0)
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    step = np.zeros(len(ends) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    covered = np.stack([np.maximum(starts[first], spans[:, 0]), np.minimum(ends[last - 1], spans[:, 1])], axis=1) if len(spans) else spans
    return np.cumsum(step)[:-1] > 0, covered


def encode(text: str, spans: list[tuple[int, int]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, the mask of those that touch a span, and the characters that the masked tokens cover of each span."""
    ids = vocabulary.encode(text)
    edges = np.array(spans, np.int64).reshape(-1, 2)
    if text.isascii():
        mask, covered = token_mask(np.cumsum(vocabulary.size[ids]), edges)
        return ids, mask, covered
    starts = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # first byte of each character
    ends = np.cumsum(vocabulary.size[ids])
    mask, covered = token_mask(ends, np.append(starts, ends[-1] if len(ends) else 0)[edges])
    return ids, mask, np.searchsorted(starts, covered)


def read_back(ids: np.ndarray, mask: np.ndarray, vocabulary: Vocabulary) -> tuple[int, str, int, str, int]:
    """From tokens and their mask alone: turns and their digest, characters under the mask and their digest, characters."""
    text = vocabulary.decode(ids).decode()
    turns = parse(text)
    learnt = unescape(vocabulary.decode(ids[mask]).decode(errors="replace"))
    whole = "".join(f"{role}\n{said}\n" for role, said in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    edges = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts) if parts else [], kind))


def _spans(parts: list[np.ndarray]) -> pa.Array:
    edges = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    both = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(both[:, i]), pa.int64()) for i in (0, 1)], ["start", "end"]))


Coded = tuple[str, tuple[np.ndarray, np.ndarray, np.ndarray], Vocabulary]


def _chats(conversations: DataFrame, vocabulary: str, learn: str, finish: Callable[[list[Coded]], list[pa.Array]], names: list[str], schema: str) -> DataFrame:
    """conv_id and what ``finish`` makes of formatted and encoded conversations, in one pass."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_at(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                made = [render(list(zip(r, t, strict=True)), learn) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *finish([(text, encode(text, spans, known), known) for text, spans in made])], ["conv_id", *names])

    return grouped.mapInArrow(lean(work), schema)


def format_chats(conversations: DataFrame, vocabulary: str, *, learn: str = "assistant") -> DataFrame:
    """Per conversation: the formatted text, its token ids, the mask of tokens to learn from, and their characters.

    Turns are ordered by turn, then role, then text; a null turn comes first. A null role or text is empty. Rows that
    repeat are turns that repeat. A null conv_id is a conversation of its own. An empty table gives an empty table;
    other columns are ignored. One conversation is formatted in one piece, so it must fit a task; a hot set of
    conversations is spread by id.
    """

    def finish(made: list[Coded]) -> list[pa.Array]:
        ids, masks, spans = (list(x) for x in zip(*[c for _, c, _ in made], strict=True))
        return [pa.array([text for text, _, _ in made], pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.bool_()), _spans(spans)]

    conversations = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    return _chats(conversations, vocabulary, learn, finish, ["formatted", "input_ids", "loss_mask", "loss_spans"], SCHEMA)


DIGESTS = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def chat_digests(conversations: DataFrame, vocabulary: str, *, learn: str = "assistant") -> DataFrame:
    """What the token ids and the mask of ``format_chats`` decode to, without sending them anywhere: turns, and the text under the mask."""

    def finish(made: list[Coded]) -> list[pa.Array]:
        rows = [read_back(ids, mask, known) for _, (ids, mask, _), known in made]
        return [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), DIGESTS.values(), strict=True)]

    conversations = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    kinds = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'bigint'}" for n in DIGESTS)
    return _chats(conversations, vocabulary, learn, finish, list(DIGESTS), f"conv_id bigint, {kinds}")
