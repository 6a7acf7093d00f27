import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardhall.llm.words import ALNUM, SPACED, Words, batches, grams, shingle_sets, utf8

TEXT = st.text(alphabet="aB \n\t\x0b\x00!é日z9", max_size=60)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_the_patterns(texts):
    raw = [utf8(t) for t in texts]
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(raw, table, lower=True)
        got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
        want = [re.findall(pattern, lowered(t)) for t in texts]
        assert got == [x for y in want for x in y]
        assert w.count.tolist() == [len(x) for x in want]
        h = w.hashes().tolist()
        assert len(set(h)) == len(set(got)) and len({(g, x) for g, x in zip(got, h, strict=True)}) == len(set(got))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_shingles(texts, k):
    sets = shingle_sets([utf8(t) for t in texts], k)
    for t, s in zip(texts, sets, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        assert len(s) == len({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
        assert (np.diff(s.astype(object)) > 0).all()


def test_long_words_and_batches():
    long = b"q" * 300_000
    a, b = Words([b"x", long + b" y"], SPACED, True).hashes(), Words([long], SPACED, True).hashes()
    assert a[1] == b[0] and a[0] != a[2]
    assert [(i, len(s)) for i, s in batches([b"a" * 10] * 7, 30)] == [(0, 3), (3, 3), (6, 1)] or sum(len(s) for _, s in batches([b"a" * 10] * 7, 30)) == 7
    assert utf8(None) == b"" and len(grams(np.empty(0, np.uint64), 3)) == 0
