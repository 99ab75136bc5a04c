import datetime

from pyspark.sql import functions as F

from confab.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


def test_trim(spark):
    c = T.trim(F.col("s"))
    for raw in (" a b ", "\t\n a b\r ", "  a b 　", "﻿a b﻿"):
        assert one(spark, c, s=("string", raw)) == "a b"
    assert one(spark, c, s=("string", "a")) == "a"
    assert one(spark, c, s=("string", " a \x85")) == "a \x85" and one(spark, c, s=("string", "a\x85 ")) == "a\x85"
    assert one(spark, c, s=("string", None)) is None
    assert one(spark, c, s=("string", "   ")) == ""


def test_length_in_utf16(spark):
    c = T.length_utf16(F.col("s"))
    assert one(spark, c, s=("string", "a😀é")) == 4
    assert one(spark, c, s=("string", "")) == 0


def test_lists(spark):
    assert one(spark, T.split_list(F.col("s")), s=("string", " a, ,b ,,")) == ["a", "b"]
    assert one(spark, T.join_keeping(F.col("a"), "-"), a=("array<string>", ["x", None, "y"])) == "x--y"


def test_role_label(spark):
    assert one(spark, T.role_label(F.col("s")), s=("string", "uSER")) == "USER"
    assert one(spark, T.role_label(F.col("s")), s=("string", "")) == ""


def test_encoding(spark):
    assert one(spark, T.encode_component(F.col("s")), s=("string", "a b&(c)!*'~é")) == "a%20b%26(c)!*'~%C3%A9"


def test_rounding(spark):
    for x, want in ((-2.5, -2), (2.5, 3), (-0.4, 0)):
        assert one(spark, T.round_half_up(F.col("d")), d=("double", x)) == want


def test_to_fixed_is_exact(spark):
    c = T.to_fixed(6)(F.col("d"))
    assert one(spark, c, d=("double", 5e-7)) == "0.000000"
    assert one(spark, c, d=("double", 2**-7)) == "0.007813"
    assert one(spark, c, d=("double", 0.00492)) == "0.004920"
    assert one(spark, c, d=("double", None)) is None
    assert one(spark, T.to_fixed(9)(F.col("d")), d=("double", 0.0)) == "0.000000000"


def test_times(spark):
    t = datetime.datetime(2024, 3, 5, 14, 7, 9, 123000)
    assert one(spark, T.display_time(F.col("t")), t=("timestamp_ntz", t)) == "03/05/2024, 02:07 PM"
    assert one(spark, T.file_stamp(F.col("t")), t=("timestamp_ntz", t)) == "2024-03-05T14-07-09-123Z"
