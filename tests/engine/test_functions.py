import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import hashing, ids, text, tokens

# Hashes of buf[:n], buf[n] = (131 n) ^ (n >> 3), by default seeds and by seeds 1, 2, 3, 4.
GOLDEN = [
    (0, 0xC920CA43256FDCB9, 0x32FC822C817A98B5),
    (1, 0x78D3DB1F028AC5FD, 0xE1FEA7FFD84020A8),
    (7, 0xD93CF02DE3FBA3EE, 0x39B0F8CF3ED37935),
    (8, 0x84E203C653882579, 0xF6E59D766335EB43),
    (9, 0x9764EF16D81728AE, 0xAE0274600C64742C),
    (31, 0xC708FF549F8CAED5, 0x8578A1A7C1D536F0),
    (32, 0xB757A0DD9A477736, 0x3D0F75066589C539),
    (33, 0x0D572075F487EF76, 0x654A9F4A9DA5AA00),
    (100, 0xBC6EA375CD7D0933, 0xFC56B5832B412AD6),
    (299, 0x3167ACC8452A4D82, 0xB5B26880E648FB59),
]


def test_seahash_golden():
    buf = bytes((n * 131 ^ n >> 3) & 255 for n in range(300))
    values = [buf[:n] for n, _, _ in GOLDEN]
    assert hashing.seahash_all(values).tolist() == [h for _, h, _ in GOLDEN]
    assert hashing.seahash_all(values, (1, 2, 3, 4)).tolist() == [h for _, _, h in GOLDEN]
    assert hashing.seahash_all([b"to be or not to be"]).tolist() == [1988685042348123509]


def test_seahash_of_mixed_lengths_is_that_of_each():
    rng = random.Random(3)
    values = [rng.randbytes(n) for n in [0, 1, 7, 8, 9, 16, 17, 100_000, 5, 64, 65, 0, 3000] + [rng.randrange(40) for _ in range(500)]]
    assert hashing.seahash_all(values).tolist() == [int(hashing.seahash_all([v])[0]) for v in values]
    assert hashing.seahash_all([]).tolist() == []


def test_placement_golden(spark):
    owners = spark.range(1).select(
        hashing.collection_owner(F.lit(1787000000000000123), F.lit(0), F.lit(0x1234)).alias("a"),
        hashing.unique_owner(F.lit(7), F.lit(0x1122334455667788)).alias("b"),
    )
    row = owners.select(hashing.shard(F.col("a")), hashing.shard(F.col("b")), hashing.seahash(F.col("a")), hashing.seahash(F.col("b")), hashing.shard(F.col("a"), 1)).first()
    assert (row[0], row[1], row[4]) == (39, 49, 0)
    assert (row[2] % (1 << 64), row[3] % (1 << 64)) == (0xF0069E7320F5E727, 0x9DEFD22809409671)


def test_natural_keys(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("a", "bc")], "x string, y string")
    keys = [r[0] for r in rows.select(hashing.natural_key(F.col("x"), F.col("y"))).collect()]
    assert keys[0] == keys[3] != keys[1] and keys[2] is None
    assert keys[0] % (1 << 64) == int(hashing.seahash_all([b"\1\0\0\0a\2\0\0\0bc"])[0])


@pytest.mark.parametrize(
    ("raw", "latin"),
    [("José", "jose"), ("  Ada   Lovelace ", "ada lovelace"), ("ÀÉÎÕÜ", "aeiou"), ("Łódź", "lodz"), ("Straße", "strasse"), ("Æon", "aeon"), ("Œuvre", "oeuvre"), ("東京", "東京"), ("", ""), ("a  b", "a b")],
)
def test_normalize(spark, raw, latin):
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize(F.col("t"))).first()[0] == latin


def test_gram_counts(spark):
    want = {"ada": 5, "lovelace": 10, "aaaa": 5, "": 1, "ab": 4}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", F.size(text.grams(F.col("t"))).alias("n")).collect()
    assert {r.t: r.n for r in rows} == want


def test_thresholds_and_gap(spark):
    one = spark.range(1)
    at = lambda mode, x: one.select(text.gram_threshold(mode, x, F.lit(10))).first()[0]
    assert [at("distance", k) for k in (0, 1, 3, 9)] == [10, 7, 1, 0]
    assert [at("similarity", t) for t in (0.0, 0.35, 1.0, 2.0, -1.0)] == [1, 4, 10, 10, 1]
    assert one.select(text.length_gap(F.lit("x" * 300), F.lit("x" * 256))).first()[0] == 0


def grams(t, n=3):
    p = text.PAD * (n - 1) + t + text.PAD * (n - 1)
    return {p[i : i + n] for i in range(len(t) + n - 1)}


def test_shares_match_sets(spark):
    rng = random.Random(1)
    words = ["", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(20))]
    pairs = list(itertools.product(words, words))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.jaccard(text.grams(F.col("a")), text.grams(F.col("b"))).alias("j"), text.containment(text.grams(F.col("a")), text.grams(F.col("b"))).alias("c")).collect()
    for r in rows:
        a, b = grams(r.a), grams(r.b)
        assert math.isclose(r.j, len(a & b) / len(a | b)) and math.isclose(r.c, len(a & b) / len(a))


def test_ids_sort_and_pack(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 62), rng.randrange(1 << 31), rng.randrange(2), rng.randrange(1 << 15)) for _ in range(50)]
    frame = spark.createDataFrame(rows, "k long, t long, f int, s int")
    made = frame.select(ids.record_id(*[F.col(c) for c in "ktfs"]).alias("i"), ids.low_half(F.col("t"), F.col("f"), F.col("s")).alias("low")).orderBy("i").collect()
    number = lambda k, t, f, s: k << 64 | t << 16 | f << 15 | s
    assert [number(*r.i) for r in made] == sorted(number(*r) for r in rows)
    assert all(r.low == number(0, *r.i[1:]) for r in made)
    assert frame.select(F.max(ids.tenant_of(ids.low_half(F.col("t"), F.col("f"), F.col("s"))) - F.col("t"))).first()[0] == 0
    a = frame.select(ids.archive_id(F.col("k"), F.col("t"), F.col("f"), F.lit(0x12345).cast("long")).alias("a"), "f").collect()
    assert all(r.a.flag == 1 - r.f and r.a.salt == 0x2345 for r in a)


def test_type_identity():
    a = hashing.struct_hash("Thing", "many", [("kind", "u32"), ("tag", "String")])
    assert a == int(hashing.seahash_all([b"Thing|many|kind:u32|tag:String"])[0])
    assert a != hashing.struct_hash("Thing", "many", [("kind", "u32"), ("tag", "str")])


def test_native_order_is_the_order_of_encoded_keys(spark):
    """Signed numbers, booleans and strings sort as their order-preserving bytes would."""
    rng = random.Random(3)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.random() < 0.5, "".join(rng.choice("aé漢Z") for _ in range(rng.randint(0, 4)))) for _ in range(80)]
    encode = lambda r: (r[0] + (1 << 63)).to_bytes(8, "big") + bytes([r[1]]) + r[2].encode() + b"\0"
    got = [tuple(r) for r in spark.createDataFrame(rows, "a long, b boolean, c string").orderBy("a", "b", "c").collect()]
    assert got == sorted(rows, key=encode)


def test_successor_is_the_least_key_above_a_prefix(spark):
    cases = [(b"", None), (b"\xff\xff", None), (b"a", b"b"), (b"a\xff", b"b"), (b"a\xfe\xff\xff", b"a\xff"), (b"\x0f\xf0", b"\x0f\xf1"), (b"\x00", b"\x01"), (None, None)]
    rows = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, (p, _) in enumerate(cases)], "i int, p binary")
    found = {r.i: r.s for r in rows.select("i", ids.successor(F.col("p")).alias("s")).collect()}
    assert [None if found[i] is None else bytes(found[i]) for i in range(len(cases))] == [s for _, s in cases]


def test_keys_of_one_millisecond_differ(spark):
    rows = spark.range(1000).select(ids.key_nanos(F.lit(1_700_000_000_123_456_789), F.col("id")).alias("k")).collect()
    assert len({r.k for r in rows}) == 1000 and {r.k // 1_000_000 for r in rows} == {1_700_000_000_123}


def test_tokens_are_hmac(spark):
    import hashlib
    import hmac

    messages = [b"", b"claims", bytes(range(256)) * 5]
    for secret in (b"", b"s" * 32, b"s" * 64, b"s" * 65):
        rows = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(messages)], "i int, m binary")
        found = {r.i: bytes(r.t) for r in rows.select("i", tokens.sign(F.col("m"), secret).alias("t")).collect()}
        assert found == {i: m + hmac.new(secret, m, hashlib.sha256).digest() for i, m in enumerate(messages)}


def test_token_faults_by_the_first_check_that_fails(spark):
    good = tokens.sign(F.lit(bytearray(b"c")), b"k")
    at = lambda token, expires=9, purpose="api": tokens.fault(token, b"k", F.lit(expires), F.lit(purpose), F.lit(5), "api")
    cut = F.substring(good, F.lit(1), F.lit(31))
    turned = F.concat(F.lit(bytearray(b"d")), F.substring(good, F.lit(2), F.lit(32)))
    none = F.lit(None)
    checks = [at(good), at(cut), at(none.cast("binary")), at(turned, 1, "x"), at(good, 5, "x"), at(good, 6, "x"), tokens.fault(good, b"k", none.cast("long"), F.lit("api"), F.lit(5), "api")]
    assert list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).first()) == [None, "malformed", "malformed", "signature", "expired", "purpose", "malformed"]


def test_identities_fold_tags_in_order():
    words = [hashing.FUNCTION_DOMAIN, 7, 10, 20]
    assert hashing.compose(7, [10, 20]) == int(hashing.seahash_all([b"".join(w.to_bytes(8, "little") for w in words)])[0])
    assert hashing.compose(7, [10, 20]) != hashing.compose(7, [20, 10])
    assert hashing.container(7, 10) != hashing.compose(7, [10])
