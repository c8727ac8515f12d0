import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import pieces as P


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(*P.read_pieces())


def as_unigram(path=P.MODEL):
    """The same vocabulary with our scores, loaded by the library with its unigram algorithm (both changed in the bytes)."""
    import sentencepiece

    data = bytearray(open(path, "rb").read())
    scores = {i: s for i, _, s in P.read_pieces(path)[0]}
    at = number = 0

    def varint(i):
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if not data[i - 1] & 128:
                return x, i

    while at < len(data):
        tag, at = varint(at)
        size, at = varint(at)
        if tag == (1 << 3 | 2):
            i, end = at, at + size
            while i < end:
                inner, i = varint(i)
                if inner == (2 << 3 | 5):
                    if number in scores:
                        data[i : i + 4] = struct.pack("<f", scores[number])
                    i += 4
                elif inner & 7 == 2:
                    n, i = varint(i)
                    i += n
                else:
                    _, i = varint(i)
            number += 1
        if tag == (2 << 3 | 2):
            i, end = at, at + size
            while i < end:
                inner, i = varint(i)
                if inner == (3 << 3):
                    assert data[i] == 2
                    data[i] = 1
                    break
                if inner & 7 == 2:
                    n, i = varint(i)
                    i += n
                elif inner & 7 == 5:
                    i += 4
                else:
                    _, i = varint(i)
        at += size
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


TEXTS = ["", " ", "a", "Hello  world\n\ttest é ☃ 12", "  lead and trail  ", "▁ own ▁▁ mark", "\ufdd0▁", "▁", "<0x41> <s> </s>", "日本語 mixed ñandú 🎉🎉", "x" * 300, "\x00\x7f\r\n"]


def random_texts(n=300):
    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC   \n\té漢☃🎉0123456789.,-"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def encoded(encoder, texts):
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    ids = ids.to_pylist()
    return [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def decoded(encoder, lists):
    flat = pa.array([x for own in lists for x in own], pa.int32())
    return encoder.decode(flat, [0, *__import__("itertools").accumulate(map(len, lists))]).to_pylist()


def test_round_trip_and_both_paths_agree(encoder):
    texts = TEXTS + random_texts()
    lists = encoded(encoder, texts)
    assert decoded(encoder, lists) == texts
    for t, own in zip(texts, lists, strict=True):
        if t and P.MARK not in t:
            assert own == np.frombuffer(encoder.segment(" " + t), dtype=np.int32).tolist()


def test_same_as_the_library(encoder):
    library = as_unigram()
    texts = [t for t in random_texts() if t] + ["Hello world", "ñandú 漢字", "two  spaces   three", "x" * 300, "🎉🎉"]
    for t, own in zip(texts, encoded(encoder, texts), strict=True):
        assert own == library.encode(t, out_type=int) or _score(library, own) == pytest.approx(_score(library, library.encode(t)), abs=1e-3)
        assert library.decode(own) == t or t != t.strip()


def _score(library, ids):
    return sum(library.get_score(i) for i in ids if not library.is_byte(i))


def test_ranks_become_log_probabilities():
    pieces, by_byte = P.read_pieces()
    assert sum(2.718281828459045**s for _, _, s in pieces) == pytest.approx(1.0) and len(by_byte) == 256


def test_invalid_bytes_and_unknown_ids(encoder):
    assert decoded(encoder, [[encoder.by_byte[0xFF]], []]) == ["\ufffd", ""]
    with pytest.raises((ValueError, IndexError, pa.ArrowException)):
        decoded(encoder, [[10**6]])


def test_best_of_all_segmentations():
    rng = random.Random(2)
    chars = "ab" + P.MARK
    made = {"".join(rng.choice(chars) for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"a"}
    pieces = [(k, p, -float(rng.randint(1, 12))) for k, p in enumerate(sorted(made))]
    by_byte = {b: 1000 + b for b in range(256)}
    e = P.Encoder(pieces, by_byte)
    score = {p: s for _, p, s in pieces}

    def best(t):
        if not t:
            return 0.0
        options = [score[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in score]
        if t[0] not in score:
            options.append(e.unknown + best(t[1:]))
        return max(options)

    for _ in range(200):
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 9)))
        (ids,) = encoded(e, [t])
        value, at = 0.0, list(ids)
        while at:
            if at[0] < 1000:
                value += pieces[at.pop(0)][2]
            else:
                n = {0: 1, 1: 1, 14: 3}.get(0 if at[0] - 1000 < 128 else 14)
                value += e.unknown
                at = at[n:]
        assert value == pytest.approx(best(P.MARK + t.replace(" ", P.MARK)))
        assert decoded(e, [ids]) == [t]


def test_frames(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None, "a", "a"])], "doc_id long, text string, ids string")
    rows = P.decode(P.encode(docs)).collect()
    assert all(r.decoded == r.text for r in rows) and all((r.ids is None) == (r.text is None) for r in rows)
    assert all(r.n_tokens == len(r.ids or ()) for r in rows)
    assert P.decode(P.encode(docs.filter("false"))).count() == 0
    both = P.round_trip(docs, to="text").select("doc_id", "text", "ids", "n_tokens").collect()
    assert both == [r for r in P.decode(P.encode(docs)).select("doc_id", "decoded", "ids", "n_tokens").collect()]
    assert P.round_trip(docs.filter("false")).count() == 0
