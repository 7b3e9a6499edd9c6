from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import chat
from gradus.llm.queries import CHAT_VOCABULARY

TEXT = st.lists(st.sampled_from(["a", "é", "\\", "<", "|", ">", "\n", " ", "im_end", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "\U0001f600"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|im_sep|>"]), TEXT), max_size=5))
def test_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant" and t]
    known = chat.vocabulary_at(CHAT_VOCABULARY)
    ids, mask, covered = chat.encode(text, spans, known)
    assert chat.unescape("".join(text[a:b] for a, b in covered.tolist())) == "".join(t for role, t in turns if role == "assistant")
    ends = known.size[ids].cumsum()
    raw = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
    assert [bool(m) for m in mask] == [any(e - n < y and e > x for x, y in raw) for e, n in zip(ends.tolist(), known.size[ids].tolist(), strict=True)]
    assert (ends[-1] if len(ends) else 0) == len(text.encode()) and int((ids >= len(known.size) - 3).sum()) == 3 * len(turns)


def test_digests_follow_the_mask():
    """Any bit of the mask changes what is read back (but for a token that only escapes); the text itself is read from the tokens."""
    known = chat.vocabulary_at(CHAT_VOCABULARY)
    text, spans = chat.render([("user", "one é"), ("assistant", "two, three \U0001f600"), ("assistant", "four")])
    ids, mask, _ = chat.encode(text, spans, known)
    right = chat.read_back(ids, mask, known)
    assert right[0] == 3 and right[2] == len("two, three \U0001f600four") and right[4] == len(text)
    for i in range(len(mask)):
        wrong = mask.copy()
        wrong[i] = not wrong[i]
        assert chat.read_back(ids, wrong, known)[3] != right[3]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_same_tokens_and_offsets_as_the_other_library(text):
    """The same public vocabulary, read by a library that reports offsets itself."""
    from tokenizers import Tokenizer

    said = chat.render([("user", text), ("assistant", text + " ")])[0]
    other = Tokenizer.from_file(CHAT_VOCABULARY.replace(".tiktoken", ".json"))
    other.add_special_tokens(list(chat.CONTROL))
    code, known = other.encode(said, add_special_tokens=False), chat.vocabulary_at(CHAT_VOCABULARY)
    ids = known.encode(said)
    assert code.ids == ids.tolist()
    if said.isascii():
        assert [b for _, b in code.offsets] == known.size[ids].cumsum().tolist()


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, 1), (1, 1, None, "x", 1), (None, 0, "assistant", "lost", 1), (2, 1, "assistant", "b", 1), (2, None, "user", "a", 1), (2, 1, "assistant", "b", 1), (3, 0, "assistant", "é" * 50_000, 1)]
    given_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.format_chats(given_, CHAT_VOCABULARY).collect()}
    assert chat.parse(got[1].formatted) == [("user", ""), ("", "x")] and got[1].loss_spans == []
    assert chat.parse(got[2].formatted) == [("user", "a"), ("assistant", "b"), ("assistant", "b")] and len(got[2].loss_spans) == 2
    assert chat.parse(got[None].formatted) == [("assistant", "lost")] and any(got[None].loss_mask) and len(got[3].formatted) > 50_000
    digests = {r.conv_id: r for r in chat.chat_digests(given_, CHAT_VOCABULARY).collect()}
    assert digests[3].loss_chars == 50_000 and digests[1].loss_chars == 0 and digests[2].n_turns == 3
    assert chat.chat_digests(given_.limit(0), CHAT_VOCABULARY).count() == 0 == chat.format_chats(given_.limit(0), CHAT_VOCABULARY).count()
