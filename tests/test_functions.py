import binascii
import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from veilink.functions import bits, hashing
from veilink.functions import similarity as S
from veilink.functions.qgrams import attribute_qgrams, qgram_list, qgram_set
from veilink.functions.scalars import half_rating, integer_text, month_year, soundex_variant
from veilink.operators.blocking import MINHASH_PRIME, minhash_coefficients, minhash_signature

WORDS = ["jo", "oh", "hn", "é§", "a much longer string than thirty-two bytes, for the other path", ""]


def test_seeded_xxh64_and_digest_moduli(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    cols = [hashing.xxh64_positions(F.col("w"), 100, 3), hashing.digest_mod(F.col("w"), "sha1", 1000), hashing.digest_mod(F.col("w"), "md5", 997), hashing.digest_mod(F.col("w"), "sha224", 128)]
    for w, x, s, m, t in df.select("w", *cols).collect():
        raw = w.encode()
        assert list(x) == [xxhash.xxh64_intdigest(raw, seed=i) % 100 for i in range(3)]
        assert (s, m, t) == (int(hashlib.sha1(raw).hexdigest(), 16) % 1000, int(hashlib.md5(raw).hexdigest(), 16) % 997, int(hashlib.sha224(raw).hexdigest(), 16) % 128)


def test_hash_goldens(spark):
    q = F.lit("jo")
    row = spark.range(1).select(hashing.hash_positions(q, 1000, 3), hashing.hash_positions(q, 1000, 3, "enhanced"), F.crc32(q.cast("binary"))).first()
    assert [list(row[0]), list(row[1]), row[2]] == [[207, 341, 475], [207, 342, 479], 63368475]
    assert sorted(hashing.random_positions("jo", 200, 3)) == [48, 76, 191]


def test_qgrams(spark):
    row = spark.range(1).select(
        qgram_set(F.lit("john")), qgram_set(F.lit("")), qgram_set(F.lit("j")), qgram_list(F.lit("aaa")), qgram_list(F.lit("ab"), 2, "$"), attribute_qgrams([F.lit(" ab "), F.lit(None).cast("string")])
    ).first()
    assert [list(x) for x in row] == [["jo", "oh", "hn"], [], [], ["aa", "aa"], ["$a", "ab", "b$"], ["ab"]]


def test_bits_against_sets(spark):
    source, m = random.Random(3), 64
    rows = [(i, sorted(source.sample(range(m), source.randint(0, 30))), sorted(source.sample(range(m), source.randint(0, 30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a array<int>, b array<int>")
    a, b = bits.words(F.col("a"), m), bits.words(F.col("b"), m)
    out = df.select("a", "b", bits.both(a, b), bits.either(a, b), bits.different(a, b), bits.fold(F.col("a"), m), bits.rule90(F.col("a"), m), bits.balanced(F.col("a"), m), bits.flipped(F.col("a"), m, 0.2, F.col("id")))
    for x, y, both, either, differ, fold, rule, balanced, flipped in out.collect():
        x, y = set(x), set(y)
        assert (both, either, differ) == (len(x & y), len(x | y), len(x ^ y))
        assert set(fold) == {p for p in range(32) if (p in x) != (p + 32 in x)}
        assert set(rule) == {p for p in range(m) if ((p - 1) % m in x) != ((p + 1) % m in x)}
        assert len(balanced) == m and set(balanced) == x | {p + m for p in range(m) if p not in x}
        assert all(0 <= p < m for p in flipped)


def test_similarity_edges(spark):
    one = lambda *v: [F.lit(x) for x in v]
    row = spark.range(1).select(
        S.dice(*one(0, 0, 0)), S.jaccard(*one(0, 0, 0)), S.overlap(*one(0, 0, 3)), S.hamming_coefficient(*one(2, 2, 5), 10), S.entropy_coefficient(*one(0, 3)),
        F.round(S.dice(*one(26, 38, 35)), 6), F.round(S.jaccard(*one(26, 38, 35)), 6), F.round(S.overlap(*one(26, 38, 35)), 6), S.hamming_coefficient(*one(26, 38, 35), 100), F.round(S.entropy_coefficient(*one(38, 35)), 6),
    ).first()
    assert list(row) == [0, 0, 0, 1.0, 0, 0.712329, 0.553191, 0.742857, 0.91, 0.917762]


def soundex(v):
    if not v:
        return "z000"
    code, digits = v[0], dict(zip("bfpvcgjkqsxzdtlmnr", "111122222222334556"))
    for c in v[1:]:
        if c in digits and digits[c] != code[-1]:
            code += digits[c]
    return (code + "000")[:4]


def test_scalars(spark):
    source = random.Random(5)
    words = ["", "a", "pfister", "tymczak", "22b1b"] + ["".join(source.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(source.randint(1, 9))) for _ in range(200)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", soundex_variant(F.col("w"))).collect()
    assert all(code == soundex(w) for w, code in got)
    row = spark.range(1).select(half_rating(F.lit(1.0)), month_year(F.lit("2020-03-09")), month_year(F.lit("no date")), integer_text(F.lit("3.0")), integer_text(F.lit("x"))).first()
    assert list(row) == [1.0, "3/2020", "", "3", None]


def test_minhash_signature(spark):
    a, b = minhash_coefficients(6, 42)
    grams = ["jo", "oh", "hn"]
    got = spark.range(1).select(minhash_signature(F.array(*map(F.lit, grams)), 6)).first()[0]
    assert list(got) == [min((a[i] * binascii.crc32(g.encode()) + b[i]) % MINHASH_PRIME for g in grams) for i in range(6)]
