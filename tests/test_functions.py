from decimal import Decimal, InvalidOperation

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.constants import FEATURES, MISSING_TOKENS
from riskweave.functions import decisions, ids, numbers, text

IDS = {
    "8.41E+17": "841000000000000000", " 12 ": "12", "\t12 \n": "12", "007": "7",
    "-0": "0", "+5": "5", "1.0": "1", "1.5": None, "1E-1": None, "NaN": None,
    "Infinity": None, "": None, "1E+18": "1000000000000000000", "1E+19": None,
    "9999999999999999999": "9999999999999999999", "12345678901234567890": None,
    "1_000": None, "-5": None, "bad-id": None, "5.": "5", ".5E1": "5", ".": None,
    "5.0000000000000000000001": None, "0.00000000000000000000000001": None,
    "0E-5": "0", "0E99": "0", "1E999999999999": None, "9.999999999999999999E18":
    "9999999999999999999", "1d": None, None: None,
}


def test_account_ids(values):
    assert values(ids.normalise_account_id, list(IDS)) == list(IDS.values())


_id_text = st.builds(
    "{}{}{}{}{}".format,
    st.sampled_from(["", "", "+", "-"]),
    st.text("0019", max_size=22),
    st.sampled_from(["", "."]),
    st.text("0005", max_size=22),
    st.sampled_from(["", "", "E3", "e+17", "E-2", "e-20", "E19"]),
)


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_id_text, min_size=200, max_size=400))
def test_account_ids_equal_decimal_arithmetic(values, texts):
    def expected(value):
        try:
            d = Decimal(value.strip())
        except InvalidOperation:
            return None
        if not d.is_finite() or d < 0 or d != d.to_integral_value():
            return None
        return str(int(d)) if len(str(int(d))) <= 19 else None

    assert values(ids.normalise_account_id, texts) == [expected(t) for t in texts]


def test_valid_ids(values):
    assert values(ids.is_account_id, ["1", "9" * 19, "9" * 20, "a", "", " 1", None, "１"]) == [
        True, True, False, False, False, False, False, False
    ]


def test_numbers(values):
    inputs = ["1d", "0x1p3", "1e3", "inf", "-1", " 7 ", "0", "-0", "", "NaN", "1e999", ".5",
              "5.", "1_000", None]
    assert values(numbers.number, inputs) == [
        None, None, 1000.0, None, None, 7.0, 0.0, 0.0, None, None, None, 0.5, 5.0, None, None
    ]
    assert values(lambda c: numbers.number(c, positive=True), ["0", "1e-9"]) == [None, 1e-9]
    typed = values(lambda c: numbers.number(c, T.DoubleType()),
                   [1.5, -1.0, float("nan"), float("inf"), None], "double")
    assert typed == [1.5, None, None, None, None]


def test_flags(values):
    inputs = ["T", " yes ", "N", "1", "1.0", "0.0", "2", "maybe", "TRUE", "f", "No", "", None]
    assert values(numbers.flag, inputs) == [
        1.0, 1.0, 0.0, 1.0, 1.0, 0.0, None, None, 1.0, 0.0, 0.0, None, None
    ]
    assert values(lambda c: numbers.flag(c, T.DoubleType()), [1.0, 0.0, 2.0, None],
                  "double") == [1.0, 0.0, None, None]
    assert values(lambda c: numbers.flag(c, T.BooleanType()), [True, False, None],
                  "boolean") == [1.0, 0.0, None]


def test_completeness_rank(values):
    assert values(lambda c: numbers.completeness_rank(c, T.StringType()),
                  ["0.5", "x", None, "-2", "inf", "NaN"]) == [
        0.5, -1.0, -1.0, -2.0, float("inf"), -1.0
    ]


def test_text(values):
    padded = ["\t café  \n", "　", "\x1cx\x1f", "a b", None]
    assert values(text.strip, padded) == ["café", "", "x", "a b", None]
    assert values(text.stripped_length, padded) == [4.0, 0.0, 1.0, 3.0, None]
    assert values(text.optional_text, padded) == ["café", None, "x", "a b", None]
    assert values(text.present, ["x", "  ", None, "N/A"]) == [1.0, 0.0, 0.0, 1.0]
    unknown = ["N/A", "Unknown ", "none", "NA", "Rome", None]
    assert values(lambda c: text.present(c, unknown_is_missing=True), unknown) == [
        0.0, 0.0, 0.0, 0.0, 1.0, 0.0
    ]


@pytest.mark.parametrize("c", ["\t", "\x0b", "\x85", " ", " ", " "])
def test_strip_equals_python(values, c):
    assert values(text.strip, [f"{c}a{c}"]) == [f"{c}a{c}".strip()]


def test_missing_tokens(values):
    assert values(text.missing_to_null, list(MISSING_TOKENS)) == [None] * len(MISSING_TOKENS)
    assert values(text.missing_to_null, ["none", "0", " ", None]) == ["none", "0", " ", None]


def test_bands(values):
    assert values(lambda c: decisions.risk_band(c, 0.3, 0.7),
                  [0.29, 0.3, 0.69, 0.7, None], "double") == [
        "low", "medium", "medium", "high", None
    ]


def test_confidence_edges(spark):
    # cut-offs and margin that binary fractions represent exactly
    cases = [
        (8, 0.95, "low", "limited_feature_coverage"),
        (9, 0.95, "high", "clear_of_decision_thresholds"),
        (12, 0.5, "high", "clear_of_decision_thresholds"),
        (12, 0.375, "high", "clear_of_decision_thresholds"),    # exactly at the margin
        (12, 0.625, "high", "clear_of_decision_thresholds"),
        (9, 0.25, "low", "close_to_decision_thresholds"),
        (8, 0.25, "low", "limited_feature_coverage"),           # coverage comes first
    ]
    df = spark.createDataFrame(cases, "usable int, p double, level string, basis string")
    got = df.withColumn("c", decisions.confidence(
        F.col("p"), F.col("usable"), 0.25, 0.75, 0.125)).collect()
    assert all((r.c.level, r.c.basis) == (r.level, r.basis) for r in got)


def test_distance_just_inside_margin_is_low(spark):
    df = spark.createDataFrame([(0.376,), (0.374,)], "p double")
    got = df.select(decisions.confidence(F.col("p"), F.lit(12), 0.25, 0.75, 0.125)
                    .alias("c")).collect()
    assert [r.c.level for r in got] == ["high", "low"]


def test_recommendations(spark):
    rows = [
        (False, "high", "high", "monitor"), (True, "low", "high", "monitor"),
        (True, "high", "low", "no_concern"), (True, "high", "medium", "monitor"),
        (True, "high", "high", "prioritise"),
    ]
    df = spark.createDataFrame(rows, "e boolean, l string, b string, want string")
    got = df.select("want", decisions.recommendation(
        F.col("e"), F.col("l"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_top_factors_order_ties_and_wording(spark):
    df = spark.createDataFrame([([0.1, -0.5, 0.0, 0.5, 0.2],)], "v array<double>")
    names = ["verified", "followers_count", "tweet_count", "posting_frequency", "new_signal"]
    got = df.select(decisions.top_factors(F.col("v"), names).alias("f")).first().f
    assert [(x.feature, x.direction) for x in got] == [
        ("posting_frequency", "increases_risk"),      # tie in size: later feature first
        ("followers_count", "decreases_risk"),
        ("new_signal", "increases_risk"),
    ]
    assert [x.evidence for x in got] == [
        "Posting frequency increased the estimated risk.",
        "Follower count reduced the estimated risk.",
        "New Signal increased the estimated risk.",
    ]
    zero = spark.createDataFrame([([0.0] * 12,)], "v array<double>")
    got = zero.select(decisions.top_factors(F.col("v"), list(FEATURES)).alias("f")).first().f
    assert [x.feature for x in got] == list(FEATURES[::-1][:3])
    assert {x.direction for x in got} == {"increases_risk"}


def test_assessment_ids(values):
    def make(width):
        return lambda c: ids.assessment_id(c, F.lit("m"), width)

    short, again, other = (values(make(8), [k])[0] for k in ("a", "a", "b"))
    assert short == again != other and short.startswith("asmt_") and len(short) == 13
    assert values(lambda c: ids.is_assessment_id(c, 8),
                  [short, short + "0", "x" * 13, None]) == [True, False, False, False]


def test_override_fields(values):
    assert values(ids.is_override_label, ["legitimate", "Legitimate", None]) == [
        True, False, False
    ]
    assert values(ids.is_reason_code, ["a_1", "", "A", "a" * 64, "a" * 65, "a b", None]) == [
        True, False, False, True, False, False, False
    ]


def test_packed_ids(values):
    texts = ["asmt_" + "0123456789abcdef" * 2, "asmt_" + "A" * 32, "asmt_abc", "asmt_", "asmt_00",
             "", "x", None, "asmt_é0", "asmt_zz", "asm", "asmt_ffff ", "asmt_0a\n", "ASMT_00",
             "\x00", "\x01", "\x00\x01", "asmt_00\x01"]
    packed = values(ids.packed_id, texts)
    assert len(packed[0]) == 17 and len(set(map(bytes, filter(None, packed)))) == len(texts) - 1
    assert values(lambda c: ids.unpacked_id(ids.packed_id(c)), texts) == texts
