"""Analyzers: the column half and the Python half give the same tokens, and the expected ones.

The texts and expected tokens are fixed values that results must equal.
"""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.analyzers import analyzer, best_path, max_match, word_delimiter

TEXT = "Hello, this is a test case. 你好，这是一个测试的实例。created2018by sls sun-li-shun SunLiShun"
SIGNS = "你 好 这 是 一 个 测 试 的 实 例"


def both(spark, a, text):
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(a.kept(F.col("t"))).collect()]
    assert got[0] == a.query(text) and got[1] == [] and got[2] == []
    return " ".join(got[0])


@pytest.mark.parametrize(("options", "text", "want"), [
    ({}, TEXT, f"hello test case {SIGNS} created 2018 sls sun li shun sun li shun"),
    ({"lower_case": False}, TEXT, f"Hello test case {SIGNS} created 2018 sls sun li shun Sun Li Shun"),
    ({"set_stopwords": False}, TEXT, f"hello this is a test case {SIGNS} created 2018 by sls sun li shun sun li shun"),
    ({"split_on_case_change": False}, "SunLiShun HTTPServer", "sunlishun httpserver"),
    ({}, "HTTPServer PowerShot O'Neil's x_1.5", "httpserver power shot o neil x 1 5"),
    ({"split_on_numerics": False}, "created2018by 5x", "created2018by 5x"),
    ({"catenate_words": True}, "SunLi2Shun", "sun li 2 shun sunli"),
    ({"catenate_numbers": True, "generate_word_parts": False}, "500.42 ab", "500 42 50042"),
    ({"catenate_all": True}, "Wi4Fi x", "wi 4 fi wi4fi x"),
    ({"preserve_original": True, "generate_number_parts": False}, "PowerShot500 7", "powershot500 power shot 7"),
    ({"stem_english_possessive": False}, "Neil's", "neil s"),
])
def test_word_delimiter(spark, options, text, want):
    assert both(spark, word_delimiter(**options), text) == want


def test_standard_and_whitespace(spark):
    assert both(spark, analyzer("standard"), "The Quick-brown O'Neil 3.5 你好 and_x") == "quick brown o'neil 3.5 你 好 and_x"
    assert both(spark, analyzer("whitespace"), " A  b\tC ") == "A b C"


def test_dictionary_segmenters(spark):
    words = {"北京": 50, "大学": 60, "北京大学": 30, "大学生": 20, "生活": 40, "京大": 1}
    assert both(spark, best_path(words), "北京大学生活 abc12") == "北京大学 生活 abc12"
    assert both(spark, best_path(words, index=True), "北京大学生活") == "北京 京大 大学 北京大学 生活"
    assert both(spark, max_match(set(words)), "北京大学生活") == "北京大学 生活"
