import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T


def values(spark, function, inputs, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (T.to_pence, {
            "8 10 0": 2040, "£ 8 10 0": 2040, "£8 10 0": 2040, "1,200 0 0": 288000, "5 0": 0, "5 0 0 2": 1200, "-": 0, "—": 0,
            "": 0, None: 0, "nan": 0, "None": 0, "— 3 4": 40, "x 1 1": 13, " 1 2  3 ": 267, "4½ 0 1": 1,
        }),
        (lambda c: T.to_pence(c, strip_currency=False), {"£ 8 0 0": 96, "£8 0 0": 0, "8 0 0": 1920}),
        (T.normalise_name, {
            " Waller's  Lot. ": "wallers lot", "Bally-More": "ballymore", "GRANGE, WEST": "grange west", None: "", " ": "",
            "St. John`s; (A)": "st johns (a)", "O’Neill": "o’neill", "nan": "nan",
        }),
        (T.normalise_parish, {
            "PARISH OF CONFEY": "confey", "Parish Confey": "confey", "Clones (part of)": "clones", "Clones part of": "clones",
            "Clones—continued": "clones", "Clones continued.": "clones", "A part of (part of)": "a", "A continued (part of)": "a",
            "A (part of) continued": "a (part of)", "parish of": "of", "": "", None: "", "part of": "part of",
        }),
        (T.squash, {"Kil-Cummer L.R.": "KILCUMMERLR"}),
        (T.clean_key, {" x ": "x", "NaN": "", " nan ": "", "": "", None: "", "nanny": "nanny", "a nan": "a nan"}),
        (T.basename, {" a/b/c.jpg ": "c.jpg", "c.jpg": "c.jpg", "a/": ""}),
        (T.volume_of, {"IMG_LOG_4_65.jpg": "004", "x/IMG_LOG_1234_1.jpg": "1234", "a.jpg": "000", "A_B_C": "00C"}),
        (lambda c: T.with_prefix(c, " /p/ "), {"k": "p/k"}),
        (lambda c: T.with_prefix(c, "/"), {"k": "k"}),
        (T.result_name, {"a.jpg": "a.jpg.json", "a": "a.jpg.json"}),
        (T.is_page_name, {"IRE_LOG_1_22.JPEG": True, "IRE_LOG_1.jpg": False, "xIRE_LOG_1_2.jpg.json": False}),
        (T.is_content_line, {"": False, "  # x": False, " a # b": True}),
        (lambda c: T.to_int(c, 1), {"3": 3, " -2 ": -2, "": 1, None: 1, "x": 1, "1.5": 1}),
        (lambda c: T.to_number(c), {"1.5": 1.5, "x": 0.0, None: 0.0}),
        (T.is_filled, {"a": True, "NAN": False, None: False}),
    ],
)
def test_scalar(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_pence_text_and_back(spark):
    pence = [0, 1, 11, 12, 239, 240, 4567, -5, -240]
    assert values(spark, T.from_pence, pence, "v bigint") == [
        f"{p // 240} {p % 240 // 12} {p % 12}" for p in pence
    ]
    assert values(spark, lambda c: T.to_pence(T.from_pence(c)), pence, "v bigint") == pence


def test_factor_and_percentage(spark):
    row = spark.range(1).select(
        T.within_factor(F.lit(0), F.lit(0)).alias("a"), T.within_factor(F.lit(0), F.lit(1)).alias("b"),
        T.within_factor(F.lit(4), F.lit(2)).alias("c"), T.within_factor(F.lit(5), F.lit(2)).alias("d"),
        T.percentage(F.lit(2), F.lit(3)).alias("e"), T.percentage(F.lit(0), F.lit(0)).alias("f"),
        T.prefer(F.lit("nan"), F.lit(" x ")).alias("g"), T.image_path(F.lit("q/A_B_7_1.jpg"), "root/s").alias("h"),
    ).first()
    assert tuple(row) == (True, False, True, False, 66.67, 0.0, "x", "root/s/007/A_B_7_1.jpg")
    assert T.fraction(77) == 0.77 and T.fraction(0.5) == 0.5 and T.fraction(1) == 1.0
