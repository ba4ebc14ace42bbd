from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionlens.functions import codes, mapping, numbers, text



def test_ratio_needs_a_positive_denominator(spark):
    rows = [(1, 2), (1, 0), (1, None), (None, 2), (1, -1)]
    frame = spark.createDataFrame(rows, "n int, d int").coalesce(1)
    got = [r[0] for r in frame.select(numbers.ratio(F.col("n"), F.col("d"), 100)).collect()]
    assert got == [50.0, None, None, None, None]


def test_ratio_or_zero_keeps_unknown(spark):
    frame = spark.createDataFrame([(1, 2), (1, 0), (1, None)], "n int, d int").coalesce(1)
    got = [r[0] for r in frame.select(numbers.ratio_or_zero(F.col("n"), F.col("d"))).collect()]
    assert got == [0.5, 0.0, None]


def test_sums_of_nothing_are_zero_and_means_null(spark):
    frame = spark.createDataFrame([(None, 1), (None, 0)], "x int, f int")
    row = frame.agg(numbers.sum_or_zero(F.col("x")).alias("s"), numbers.flagged_sum(F.col("x"), F.col("f")).alias("f"), F.avg("x").alias("m")).first()
    assert (row.s, row.f, row.m) == (0, 0, None)


def test_flagged_sum_ignores_unknown_flags(spark):
    frame = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1)], "x int, f int")
    assert frame.agg(numbers.flagged_sum(F.col("x"), F.col("f"))).first()[0] == 1


def test_weighted_mean_equals_mean_over_rows(spark):
    frame = spark.createDataFrame([(10.0, 3), (None, 5), (20.0, 1)], "x double, w long")
    assert frame.agg(numbers.weighted_mean(F.col("x"), F.col("w"))).first()[0] == (10.0 * 3 + 20.0) / 4
    nothing = spark.createDataFrame([(None, 5)], "x double, w long")
    assert nothing.agg(numbers.weighted_mean(F.col("x"), F.col("w"))).first()[0] is None


@pytest.mark.parametrize("rows,expected", [(["a", None, "a"], 2), (["a", "b"], 2), ([None], 1), ([], 0)])
def test_count_values_counts_unknown_once(spark, rows, expected):
    frame = spark.createDataFrame([(v,) for v in rows], "x string")
    assert frame.agg(numbers.count_values(F.col("x"))).first()[0] == expected


def test_first_known_skips_null(spark):
    frame = spark.createDataFrame([(3, 30), (1, None), (2, 20)], "k int, x int")
    row = frame.agg(numbers.first_by(F.col("x"), F.col("k")).alias("a"), numbers.first_known_by(F.col("x"), F.col("k")).alias("b")).first()
    assert (row.a, row.b) == (None, 20)


def test_to_int(values):
    assert values(["01001", "02013", "x", None, "12.0", "12.9"], "string", numbers.to_int(F.col("x"))) == [1001, 2013, None, None, 12, 12]


def test_half_even(values):
    assert values([0.5, 1.5, 2.5], "double", numbers.half_even(F.col("x"))) == [0.0, 2.0, 2.0]
    assert values([12.125], "double", numbers.half_even(F.col("x"), 2)) == [12.12]


def test_is_whole(spark):
    frame = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (None, None)], "a double, b double")
    row = frame.agg(numbers.is_whole(F.col("a")).alias("a"), numbers.is_whole(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_strip_space(values):
    assert values(["\t x \n", "y", None], "string", text.strip_space(F.col("x"))) == ["x", "y", None]


def test_suffix_and_prefix(values):
    assert values(["Lee County", "County Lee", None], "string", text.drop_suffix(F.col("x"), " County")) == ["Lee", "County Lee", None]
    assert values(["12 Erie, PA CZ", "Erie"], "string", text.pretty_zone(F.col("x"))) == ["Erie, PA", "Erie"]
    assert values(["County: a", "Counties: a, b", "a"], "string", text.strip_county_prefix(F.col("x"))) == ["a", "a, b", "a"]


def test_number_text(values):
    assert values([1234567.5, 2.5, None], "double", text.comma(F.col("x"))) == ["1,234,568", "2", None]
    assert values([1234.56, 0.04], "double", text.comma_tenths(F.col("x"))) == ["1,234.6", "0.0"]
    assert values([12.0, 12.5, 12345678.0, 100.0, None], "double", text.plain_number(F.col("x"), 2)) == ["12", "12.5", "12345678", "100", None]
    assert values([0.125, 0.5, 1.0, 0.0, None], "double", text.percent_text(F.col("x"))) == ["12.5%", "50%", "100%", "0%", None]


def test_fixed_percent_ties_go_to_even(values):
    assert values([0.4625, 0.1225, 0.5, 20.0, None], "double", text.percent_fixed(F.col("x"))) == ["46.2%", "12.2%", "50.0%", "2000.0%", None]


def test_text_of_null_is_null(spark):
    frame = spark.createDataFrame([("a", None)], "a string, b string")
    row = frame.select(
        text.lines(("A", F.col("a")), ("B", F.col("b"))).alias("l"),
        text.html_popup(F.col("a"), ("B", F.col("b"))).alias("h"),
        text.caption(F.col("a"), F.col("b")).alias("c"),
        text.lines(("A", F.col("a")), ("C", F.col("a"))).alias("full"),
    ).first()
    assert (row.l, row.h, row.c, row.full) == (None, None, None, "A: a\nC: a")


def test_yes_no(values):
    assert values([1, 0, None, 2], "int", text.yes_no(F.col("x"))) == ["Yes", "No", "No", "Yes"]


def test_step_bins(values):
    breaks = mapping.STEP_BREAKS["focus"]
    assert values([999, 1000, 5000, 20000, 50000, 60000, None], "int", mapping.step_bin(F.col("x"), breaks)) == [0, 1, 2, 3, 4, 4, None]
    assert mapping.step_labels(breaks) == ["< 1,000", "1,000 – 5,000", "5,000 – 20,000", "20,000 – 50,000", "≥ 50,000"]
    assert mapping.step_labels([14, 17], percent=True) == ["< 14%", "14% – 17%", "≥ 17%"]


def test_radius_is_clamped(values):
    assert values([-0.1, 0.0, 0.5, 1.0, 1.2, None], "double", mapping.radius(F.col("x"))) == [2.0, 2.0, 6.0, 10.0, 10.0, None]


def test_share_class(values):
    got = values([0.0, 0.25, 0.5, 0.75, None], "double", mapping.share_class(F.col("x")))
    assert got == [*mapping.SHARE_CLASSES, None]


def test_code_tables_are_complete():
    assert len(codes.PROGRAM_FAMILIES) == 47
    assert len(codes.OCCUPATION_GROUPS) == 22
    assert len(codes.AWARD_LEVELS) == 7
    assert len(codes.STATES) == 56
    for table in (codes.PROGRAM_FAMILIES, codes.OCCUPATION_GROUPS, codes.AWARD_LEVELS, codes.STATES):
        assert len({row[0] for row in table}) == len(table)


def test_program_family(spark):
    rows = [(0, "01.0101"), (1, "1"), (2, ""), (3, None), (4, "99.9"), (5, "14"), (6, "1.0101"), (7, "xx")]
    frame = codes.classify_program(spark.createDataFrame(rows, "i int, code string"), "code").orderBy("i")
    got = [(r.family, r.family_full) for r in frame.collect()]
    agriculture = ("Agriculture", "Agriculture, Agriculture Operations, and Related Sciences")
    other = ("Other", "Other")
    communication = ("Comm Tech", "Communications Technologies/Technicians and Support Services")
    assert got == [agriculture, agriculture, other, other, other, ("Engr", "Engineering"), communication, other]


def test_occupation_group(spark):
    rows = [(0, "11-1011"), (1, "99-0000"), (2, None)]
    frame = codes.classify_occupation(spark.createDataFrame(rows, "i int, soc string"), "soc").orderBy("i")
    assert [(r.group, r.group_full) for r in frame.collect()] == [
        ("Management", "Management Occupations"), ("Other", "Other"), ("Other", "Other")
    ]


def test_award_level(spark):
    rows = [(0, "3"), (1, "20"), (2, "9"), (3, "x"), (4, None), (5, "5.0"), (6, "3.7")]
    frame = codes.classify_award(spark.createDataFrame(rows, "i int, code string"), "code").orderBy("i")
    assert [(r.award, r.award_rank) for r in frame.collect()] == [
        ("Associate", 5), ("<12 Week Cert", 1), ("Other", 8), ("Other", 8), ("Other", 8), ("Bachelor's", 7), ("Associate", 5)
    ]


def test_label_codes_marks_missing(spark):
    rows = [(0, "a"), (1, "z"), (2, None)]
    frame = spark.createDataFrame(rows, "i int, code string")
    labels = [("a", "first"), ("b", "second")]
    got = [(r.label, r.label_rank) for r in codes.label_codes(frame, "code", labels).orderBy("i").collect()]
    assert got == [("first", 1), ("z", 3), ("Missing", 4)]
    turned = [r.label_rank for r in codes.label_codes(frame, "code", labels, reverse=True).orderBy("i").collect()]
    assert turned == [2, 3, 4]


def test_ties_as_in_sql(values):
    shares = [n / 2000 for n in (17, 33, 137, 143, 277, 283, 667)]
    assert values(shares, "double", text.percent_text(F.col("x"))) == ["0.8%", "1.6%", "6.8%", "7.2%", "13.8%", "14.2%", "33.4%"]
    assert values([0.0165 * 100, 7.1499999999999995, -0.04, None], "double", numbers.half_even(F.col("x"), 1)) == [1.6, 7.2, 0.0, None]
    assert values([-0.04], "double", text.plain_number(F.col("x"), 1)) == ["0"]
