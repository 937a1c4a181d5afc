from caregrid.functions import scalars as sc
from pyspark.sql import functions as F


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_severity(spark):
    cases = {
        "ALPHA WITH MCC": ("ALPHA", "MCC"), "ALPHA WITH CC": ("ALPHA", "CC"), "ALPHA WITHOUT CC/MCC": ("ALPHA", "NONE"), "ALPHA WITHOUT MCC": ("ALPHA", "NOT_MCC"),
        "BETA WITH MCC OR GAMMA": ("BETA", "MCC"), "ALPHA WITH CC/MCC": ("ALPHA", "CC_OR_MCC"), "DELTA": ("DELTA", None),
    }
    for title, want in cases.items():
        assert tuple(one(spark, sc.severity, title)) == want


def test_casts(spark):
    for text, want in {"": None, "Not Available": None, "abc": None, "12.7": 12}.items():
        assert one(spark, sc.safe_int, text) == want
    for text, want in {"Yes": True, "y": True, "1": True, "No": False, "0": False, "maybe": None}.items():
        assert one(spark, sc.safe_bool, text) == want


def test_thinking(spark):
    cases = {
        "plain": (None, "plain"), "<think>a</think>b": ("a", "b"), "a</think>b": ("a", "b"), "<think>a</think>x<think>c</think>y": ("a\n\nc", "xy"),
        "<think></think>b": (None, "b"), "<think>a\nb</think>\n c ": ("a\nb", "c"),
    }
    for text, want in cases.items():
        assert tuple(one(spark, sc.split_thinking, text)) == want


def test_key_points_and_wrapper(spark):
    assert one(spark, sc.key_points, "Intro\nKey Points:\n- one\n* two\nrest") == ["one", "two"]
    assert one(spark, sc.strip_wrapper, '<think>x</think>```json\n{"a": 1}\n```') == '{"a": 1}'


def test_negated(spark):
    f = lambda c: sc.negated(c, F.lit("chest pain"), r"\b(no|denies)\b")
    assert one(spark, f, "Patient denies chest pain.") is True
    assert one(spark, f, "Chest pain today.") is False
