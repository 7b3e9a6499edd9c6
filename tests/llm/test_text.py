"""Word hashing against Python's own splitting."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import _text as t

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x0b\x1c-_09 ß", max_size=30)), max_size=8)


def plain(text, pattern, lower):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(pattern, text)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words(texts, size):
    for fold, pattern, lower in ((t.SPACED, "[^\x20\x09-\x0D]+", False), (t.SPACED_LOWER, "[^\x20\x09-\x0D]+", True), (t.ALNUM_LOWER, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        seen: dict[str, int] = {}
        covered = 0
        for lo, hi, raw, offsets in t.chunks(pa.array(texts, pa.string()), size):
            words = t.split_words(raw, offsets, fold)
            for d in range(hi - lo):
                want = plain(texts[lo + d], pattern, lower)
                own = words.hash[words.doc[d] : words.doc[d + 1]].tolist()
                assert len(own) == len(want)
                assert all(seen.setdefault(w, h) == h for w, h in zip(want, own, strict=True))
            covered += hi - lo
        assert covered == len(texts) and len(set(seen.values())) == len(seen)


def test_very_long_text():
    text = " ".join(f"w{i % 1000}" for i in range(800_000))
    (_, _, raw, offsets), = t.chunks(pa.array([text]))
    words = t.split_words(raw, offsets, t.SPACED)
    assert len(words.hash) == 800_000 and (words.hash[:1000] == words.hash[-1000:]).all() and len(np.unique(words.hash)) == 1000
