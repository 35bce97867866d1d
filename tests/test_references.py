"""List text: values, edge cases and malformed input."""

import pytest
from pyspark.sql import functions as F

from citeframe.functions.references import (
    WORK_PREFIX,
    format_reference_list,
    is_reference_list,
    parse_reference_list,
)

W = WORK_PREFIX


def parse(spark, texts, mode="permissive"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", parse_reference_list(F.col("t"), mode).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_values(spark):
    texts = [f"['{W}12', '{W}3']", f'["{W}7"]', "[]", " [ ] ", None, f"['{W}1','{W}1',]", "['42']", f"[ '{W}5' ,\n'{W}6' ]"]
    assert parse(spark, texts) == [[12, 3], [7], [], [], [], [1, 1], [42], [5, 6]]


@pytest.mark.parametrize(
    "text",
    ["", "nan", f"'{W}1'", f"['{W}1'", f"['{W}1' '{W}2']", "[,]", f"[,'{W}1']", "['abc']", f"['{W}']", "[1 2]", "[\u0001]", f"['{W}1\"]"],
)
def test_malformed(spark, text):
    assert parse(spark, [text]) == [None]
    with pytest.raises(Exception, match="malformed reference list"):
        parse(spark, [text], "strict")


def test_long_list_is_checked_whole(spark):
    numbers = list(range(50_000))
    text = "[" + ", ".join(f"'{W}{n}'" for n in numbers) + "]"
    assert parse(spark, [text], "strict") == [numbers]
    assert parse(spark, [text[:-1] + ", oops]"]) == [None]


def test_reject_count(spark):
    df = spark.createDataFrame([("[]",), ("bad",), (None,)], "t string")
    assert df.where(~is_reference_list(F.col("t"))).count() == 1


def test_format_is_the_inverse(spark):
    df = spark.createDataFrame([([1, 2, 2],), ([],), (None,)], "r array<bigint>")
    rows = df.select(parse_reference_list(format_reference_list(F.col("r"))).alias("b")).collect()
    assert [r["b"] for r in rows] == [[1, 2, 2], [], []]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        parse_reference_list(F.col("t"), "loose")
