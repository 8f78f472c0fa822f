"""Scalar column functions (F1-F14) and regex text functions."""

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import text as T


def one(spark, expr, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


def test_strip_and_blank(spark):
    assert one(spark, C.strip_ws("s"), " \t a b \n") == "a b"
    assert one(spark, C.blank_to_null("s"), "") is None
    assert one(spark, C.strip_or_empty("s"), None) == ""


def test_digits_or_zero(spark):
    assert one(spark, C.digits_or_zero("s"), "07") == 7
    assert one(spark, C.digits_or_zero("s"), "x7") == 0
    assert one(spark, C.digits_or_zero("s"), " 12 ") == 12


def test_split_list_and_keep_blanks(spark):
    assert one(spark, C.split_list("s"), " A, ,B ,,C") == ["A", "B", "C"]
    assert one(spark, C.split_keep_blanks("s"), "A, ,B") == ["A", "", "B"]


def test_truncate_and_pad(spark):
    long = "x" * 81
    assert one(spark, C.truncate_text("s"), long) == "x" * 77 + "..."
    assert one(spark, C.truncate_text("s"), "x" * 80) == "x" * 80
    assert one(spark, C.zero_pad("s", 2), "7") == "07"
    assert one(spark, C.zero_pad("s", 2), "123") == "123"  # never truncates


def test_array_text(spark):
    assert one(spark, C.array_text("s"), "[SFT0001, SFT0102]") == ["SFT0001", "SFT0102"]
    assert one(spark, C.array_text("s"), '["A", "", "B"]') == ["A", "", "B"]  # JSON keeps blanks
    assert one(spark, C.array_text("s"), "['A',,'B']") == ["A", "B"]  # text path drops blanks
    assert one(spark, C.array_text("s"), "5") == ["5"]  # a scalar is not a JSON list (D13)


def test_misc(spark):
    assert one(spark, C.first_k_with_ellipsis(F.split("s", ","), 2), "a,b,c") == "a;b..."
    assert one(spark, C.first_k_with_ellipsis(F.split("s", ","), 5), "a,b") == "a;b"
    assert one(spark, C.base_name("s"), "/x/y/z.csv") == "z.csv"
    assert one(spark, C.upper_collapse("s"), "a \t b") == "A B"
    assert one(spark, C.is_hex64("s"), "a" * 64) is True
    assert one(spark, C.is_hex64("s"), "g" * 64) is False
    assert one(spark, C.json_is_valid("s"), "{bad") is False
    assert one(spark, C.json_is_valid("s"), None) is None


def test_extract_specs(spark):
    f = lambda s: one(spark, T.extract_specs("s"), s)
    assert f("Prime per MIL-PRF-23377 then P57004 and AMS 2700") == ["P57004", "MIL-PRF-23377", "AMS2700"]
    # a prefix glued to its number has no word boundary after it
    assert f("see AMS2700 only") == []
    # barrier words stop a hit; only upper-case barriers count
    assert f("MIL-DTL-5541 OR MIL-C-5541") == ["MIL-DTL-5541", "MIL-C-5541"]
    # hits ending in '-' are dropped; duplicates keep first position
    assert f("LMA-, P12345 p12345") == ["P12345"]
    assert f("LMA- text") == ["LMA-TEXT"]  # the pattern spans the gap to the next token
    assert f("") == []


def test_clean_rtf(spark):
    raw = r"{\rtf1\ansi{\b BP27} Brass\'e9 \par SFT0001}"
    assert one(spark, T.clean_rtf("s"), raw) == "BP27 BRASS SFT0001"


def test_segments_and_parts(spark):
    text = "HEADER BP27 BRASS PASSIVATE SFT0102 SFT0001 SFT0102 0000 NONE A05 ANODIZE"
    segs = one(spark, T.segments("s"), text)
    assert [s.split(" ")[0] for s in segs] == ["BP27", "0000", "A05"]
    df = spark.createDataFrame([("0000",), ("BP27",), ("A05",)], "c string")
    parts = [tuple(r["p"]) for r in df.select(T.code_parts("c").alias("p")).collect()]
    assert parts == [("0", "0", "00"), ("B", "P", "27"), ("A", "0", "05")]


def test_strip_is_unicode_and_step_tokens_stand_alone(spark):
    assert one(spark, C.strip_ws("s"), "\u00a0 a b\u2003\x1c") == "a b"
    assert one(spark, C.split_list("s"), "\u00a0x , ,y\u3000") == ["x", "y"]
    found = F.regexp_extract_all("s", F.lit(T.STEP_TOKEN), 0)
    assert one(spark, found, "SFT01023 XSFT0102 sft0007 SFT0102.") == ["sft0007", "SFT0102"]
