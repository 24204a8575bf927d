import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.functions import scalars
from tensorloom.functions.blake3 import Blake3, blake3
from tensorloom.functions.ranking import with_rank

#: Published test vectors: the input is bytes 0 .. 250, repeated.
VECTORS = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 102400: "bc3e3d41a1146b069abffad3c0d44860"}


@pytest.mark.parametrize("size", VECTORS)
def test_blake3_vectors(size):
    data = bytes(i % 251 for i in range(size))
    assert blake3(data).hexdigest()[:32] == VECTORS[size]


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=9000), st.lists(st.integers(1, 3000), max_size=5))
def test_blake3_takes_any_pieces(data, cuts):
    h, at = Blake3(), 0
    for n in cuts:
        h.update(data[at : at + n])
        at += n
    assert h.update(data[at:]).hexdigest() == blake3(data).hexdigest()


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_sizes(spark):
    size = lambda text: one(spark, scalars.parse_size(F.col("s")), s=text)
    assert [size(s) for s in ("4GiB", "3KB", "12", " 5 B ", "1.5GB", "2gib", "", "99999999999GiB")] == [4 << 30, 3000, 12, 5, None, None, None, None]


def test_shapes(spark):
    shape = lambda *dims: F.array(*[F.lit(d).cast("long") for d in dims]).cast("array<bigint>")
    assert one(spark, scalars.element_count(shape())) == 1
    assert one(spark, scalars.element_count(shape(3, 0, 5))) == 0
    assert one(spark, scalars.byte_length(shape(3, 5), F.lit("BF16"))) == 30
    assert one(spark, scalars.dtype_width(F.lit("F8_E4M3"))) is None
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        one(spark, scalars.element_count(shape(1 << 40, 1 << 40)))


def test_little_endian_both_ways(spark):
    for value in (0, 127, 128, 255, 256, 416, (1 << 31) - 1):
        data = one(spark, scalars.little_endian_bytes(F.lit(value), 4))
        assert bytes(data) == value.to_bytes(4, "little")
        assert int(one(spark, scalars.little_endian(F.lit(bytearray(data)), 4))) == value
    assert int(one(spark, scalars.little_endian(F.lit(bytearray(b"\xff" * 8)), 8))) == (1 << 64) - 1


def test_fields_that_are_no_natural_numbers_are_missing(spark):
    text = '{"a": 3, "b": -1, "c": 1.5, "d": "x"}'
    assert [one(spark, scalars.natural_field(F.col("j"), k), j=text) for k in "abcde"] == [3, None, None, None, None]


def test_rank_is_total(spark):
    words = spark.createDataFrame([(w,) for w in ("b", "", "ab", "é", "a", "abc", "Z")], "w string")
    ranks = {r["w"]: r["r"] for r in with_rank(words, "r", F.substring("w", 1, 2), F.col("w")).collect()}
    assert [w for w, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(ranks, key=str.encode)
