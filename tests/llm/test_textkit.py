import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import textkit as T

FOLD = {c: c + 32 for c in range(65, 91)}
TEXTS = [None, "", " ", "A", "é É ñ", "tab\tand\x0bmore\x0c", "Zwölf Boxkämpfer, 3x\n\n", "🎉 x🎉y", "a" * 5000]


@pytest.mark.parametrize(("keep", "pattern"), [(T.NOT_BLANK, r"[^\x20\x09-\x0D]+"), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(keep, pattern):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aB é\n-🎉1") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    w = T.Words(pa.array(texts).slice(1), keep)
    got = [[w.raw[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts) - 1)]
    assert got == [re.findall(pattern, (t or "").translate(FOLD)) for t in texts[1:]]


def test_hashes_tell_words_apart():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 40))) for _ in range(20000)} | {"a" * n for n in range(1, 200)})
    whole = T.Words(pa.array([" ".join(words)]), T.NOT_BLANK).hashes()
    assert len(set(whole.tolist())) == len(words)
    parts = T.Words(pa.array(words), T.NOT_BLANK).hashes()
    assert (parts == whole).all() and int(whole[7]) == T.word_hash(words[7].encode())


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters, on which polynomial hashes modulo a power of two collide."""
    own = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in own), "".join("ba"[x] for x in own)


def test_hashes_of_complementary_words():
    words = [w for k in range(15) for w in thue_morse(1 << k)]
    for seed in (0, 1):
        assert len({T.word_hash(w.encode(), seed) for w in words}) == len(words)
    assert T.word_hash(b"abc") != T.word_hash(b"abc", 1)


def test_shingles_and_slices():
    texts = pa.array(["a b c d e f a b c d e", "a b", "", None, "b a", "x y z w v", "a b c d e"])
    rows, values = T.shingles(T.Words(texts, T.NOT_BLANK), 5)
    assert np.bincount(rows, minlength=7).tolist() == [6, 1, 0, 0, 1, 1, 1]
    assert values[-1] in values[rows == 0] and len(set(values.tolist())) == 9
    assert list(T.slices(texts, 6)) == [(0, 1), (1, 5), (5, 6), (6, 7)]
