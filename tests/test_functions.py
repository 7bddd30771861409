import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogkit.functions import empty, text


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}").coalesce(1)
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v")).alias("o")).collect()]


IDS = [("ipz380", "IPZ-380"), ("IPZ-380", "IPZ-380"), ("ipz00380", "IPZ-380"), ("XVSR060", "XVSR-060"), ("xvsr060", "XVSR-060"), ("fc2123456", "FC2-123456"), ("FC2-123456", "FC2-123456"), ("GETCHU-123", "GETCHU-123"), ("gyutto-456", "GYUTTO-456"), ("", ""), (None, "")]
KINDS = [("FC2-123456", "fc2"), ("fc2123456", "fc2"), ("GETCHU-123", "getchu"), ("GYUTTO-456", "gyutto"), ("abc00123def", "cid"), ("IPZ-380", "normal"), ("300NTK-784", "normal")]


def test_identifiers(spark):
    assert values(spark, text.normalize_id, [a for a, _ in IDS]) == [b for _, b in IDS]
    assert values(spark, text.guess_id_type, [a for a, _ in KINDS]) == [b for _, b in KINDS]
    once = values(spark, text.normalize_id, [a for a, _ in IDS])
    assert values(spark, text.normalize_id, once) == once


def test_code_variants(spark):
    assert values(spark, text.canon_code, [" abc_012 ", "abc012", "a.b-1", "1stars00145"]) == ["ABC-012", "ABC-012", "A-B-1", "1STARS00145"]
    assert values(spark, lambda c: text.canon_code(c, split=False), ["ab  _1", "abc012"]) == ["AB-1", "ABC012"]
    assert values(spark, text.extract_code, ["see abc_0123 here", "nothing"]) == ["ABC-0123", None]
    assert values(spark, lambda c: text.parse_code(c)["number"], ["ABC-227V", "ABC2-007", "bad"]) == [227, 7, None]


def test_three_kinds_of_empty(spark):
    rows, s = [None, "", "  ", "n/a", " NULL ", "不明", "x"], T.StringType()
    assert values(spark, lambda c: empty.has_value(c, s), rows) == [False, False, True, True, True, True, True]
    assert values(spark, lambda c: empty.is_blank(c, s), rows) == [True, True, True, True, True, True, False]
    assert values(spark, lambda c: empty.is_unset(c, s), rows) == [True, True, False, False, False, False, False]
    n = T.IntegerType()
    assert values(spark, lambda c: empty.has_value(c, n), [None, 0, 3], "int") == [False, False, True]
    assert values(spark, lambda c: empty.is_blank(c, n), [None, 0, 3], "int") == [True, False, False]
    a = T.ArrayType(s)
    assert values(spark, lambda c: empty.has_value(c, a), [None, [], ["x"]], "array<string>") == [False, False, True]
    assert values(spark, lambda c: empty.is_unset(c, a), [None, [], [""]], "array<string>") == [True, True, False]


def test_names_and_scripts(spark):
    assert values(spark, lambda c: text.normalize_name(c, {"Bo": "Beau"}), ["　Ann （x）", "Bo(y) z", None, "Cy"]) == ["Ann", "Beau", "", "Cy"]
    assert values(spark, text.is_chinese, ["漢字", "漢かな", "abc", None]) == [True, False, False, False]
    assert values(spark, lambda c: text.has_kana(c, ignore_marks=True), ["漢・字", "カナ", "漢"]) == [False, True, False]
    assert values(spark, text.name_candidates, ["佐々木"]) == [["佐々木", "佐佐木"]]
    assert values(spark, text.normalize, ["abc12", "漢 (x)"]) == ["ABC-12", "漢"]


@pytest.mark.parametrize(
    ("column", "given", "wanted"),
    [
        (text.clean_ws, "  a \n　 b ", "a b"), (text.duration_minutes, "150分", 150), (text.duration_minutes, "none", None), (text.escape_html, "<a&\"'>", "&lt;a&amp;&quot;&#39;&gt;"),
        (lambda c: text.safe_name(c, 5), "a/b: cdef", "a_b_"), (lambda c: text.fill_template("{d} {c} {t}", d=F.lit(None), c=c, t=F.lit("T")), "X-1", "X-1 T"), (lambda c: text.zero_pad(c, F.lit(3)), "12345", "12345"),
        (lambda c: text.zero_pad(c, F.lit(3)), "7", "007"), (lambda c: text.rewrite_prefix(c, {"ABC": "1ABC"}), "abc-12", "1ABC-12"), (text.media_kind, ".MKV", "video"), (text.date_precision, "2020-03", "month"),
        (lambda c: text.status_from_text(c, [("back", "active"), ("retired", "retired")]), "retired, now back", "active"), (lambda c: text.active_span(c)["end"], "2001 - 2004", 2004),
        (lambda c: text.is_recent(c, F.lit("2020-06-01").cast("date"), 30), "2020-05-20", False), (lambda c: text.is_recent(c, F.lit("2020-06-01").cast("date"), 31), "2020-05-20", True),
        (lambda c: text.is_code_prefix(F.lit("abc"), c), "ABC-1", True), (lambda c: text.rewrite_url(c, [("host/low/", "host/"), (r"(\w+)ps\.jpg\z", "$1pl.jpg")]), "https://host/low/xps.jpg", "https://host/xpl.jpg"),
        (lambda c: text.number_or(c, 0), "x", 0.0), (lambda c: text.display_value(c, F.lit("orig")), "", "orig"), (lambda c: text.former_marker(c, F.lit("retired"), ["former", "retired"]), "a former x", "lead"),
    ],
)
def test_small_functions(spark, column, given, wanted):
    assert values(spark, column, [given]) == [wanted]
