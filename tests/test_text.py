import pytest

from quirefold.functions import text as T
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, norm",
    [
        ("Julie's", "julies"),
        ("well-being", "well being"),
        ("e.g.", "e_g"),
        ("+1-800-555-1234", "1_800_555_1234"),
        ("9:00 a.m.", "9 00 a_m"),
        ("hello_world", "hello world"),
        ("Café São", "cafe sao"),
        ("Straße", "strasse"),
        ("Mail Bob.Smith@Example.COM now", "mail bob.smith@example.com now"),
        ("see https://A.b/C-d ok", "see https://A.b/C-d ok"),
        ("a\\u0041b", "aab"),
        ("", ""),
        (" - ", ""),
    ],
)
def test_normalize(spark, given, norm):
    assert one(spark, given, T.normalize_text) == norm


def test_tokens_and_scripts(spark):
    assert one(spark, " a\tb\nc ", T.tokenize_words) == ["a", "b", "c"]
    assert one(spark, "中 文", T.tokenize_characters) == ["中", "文"]
    assert [one(spark, t, T.language_handler) for t in ("", "plain words", "中文字", "abc 中文字符号")] == ["english", "english", "cjk", "mixed"]
    assert one(spark, "שלום", T.rtl_majority) and not one(spark, "abc", T.rtl_majority)


def test_sentence_ends(spark):
    got = [one(spark, t, T.ends_sentence) for t in ("Done.", "Dr.", "U.S.", "What?", 'end."', "no", "etc.")]
    assert got == [True, False, False, True, True, False, False]
