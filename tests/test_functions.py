import pytest
from pyspark.sql import functions as F

from lumen.functions import columns as C
from lumen.functions import special as S
from lumen.operators import summaries


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_tails():
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert S.chi2_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert S.f_upper(4.0, 1, 10) == pytest.approx(S.t_two_sided(2.0, 10), abs=1e-12)
    assert S.beta_inc(2, 3, 0) == 0 and S.beta_inc(2, 3, 1) == 1
    assert S.correlation_p(1.0, 10) == 0 and S.correlation_p(0.5, 2) is None


def test_mann_whitney_exact_and_normal():
    assert S.mann_whitney_p(9, 3, 3, 0) == pytest.approx(0.1)  # complete separation: 2 / C(6, 3)
    assert S._u_counts(3, 4) == [1, 1, 2, 3, 4, 4, 5, 4, 4, 3, 2, 1, 1]
    assert S.mann_whitney_p(50, 10, 10, 0) == pytest.approx(1.0)


def test_shapiro():
    w, p = S.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01
    assert S.shapiro_wilk([1, 1, 1]) is None and S.shapiro_wilk([1, 2]) is None


def test_numeric_parity(spark):
    r = summaries.numeric_summary(spark.range(1, 9).select(F.col("id").cast("double").alias("v"))).first()
    assert (r["mean"], r["median"], r["std"], r["variance"], r["q1"], r["q3"], r["iqr"], r["skewness"], r["kurtosis"], r["sem"]) == (4.5, 4.5, 2.44949, 6.0, 2.75, 6.25, 3.5, 0.0, -1.2, 0.866025)
    r = summaries.numeric_summary(spark.range(1, 101).select(F.col("id").cast("double").alias("v"))).first()
    assert (r["p5"], r["q1"], r["median"], r["q3"], r["p95"]) == (5.95, 25.75, 50.5, 75.25, 95.05)
    r = summaries.numeric_summary(spark.createDataFrame([(5.0,)] * 4, "v double")).first()
    assert r["constant"] and r["iqr"] == 0


def test_five_numbers(spark):
    f = one(spark, C.five_numbers(F.array(*[F.lit(float(i)) for i in range(1, 9)])))
    assert (f["lower"], f["upper"]) == (-2.5, 11.5)
    assert one(spark, C.five_numbers(F.array().cast("array<double>")))["q1"] is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("12.5", "numeric"), ("$1,234", "numeric"), ("yes", "boolean"), ("2024-01-02", "date"), ("hello", "text"), ("12/31/2020", "date"), (None, None)],
)
def test_classify(spark, text, want):
    assert one(spark, C.classify_scalar(F.lit(text).cast("string"))) == want


def test_text_functions(spark):
    assert one(spark, C.trim_all(F.lit("\t a b\n"))) == "a b"
    assert one(spark, C.separator_key(F.lit(" New_York-City "))) == "newyorkcity"
    assert one(spark, C.accounting_number(F.lit("($1,234.50)"))) == -1234.5
    assert one(spark, C.pattern_signature(F.lit("AB-123é"))) == "a2s1d3a1"
    assert one(spark, C.url_domain(F.lit("https://www.Example.org:80/x?y"))) == "example.org:80"
    assert one(spark, C.html_unescape(F.lit("a &amp; b &eacute;"))) == "a & b é"
    assert one(spark, C.title_group(C.name_title(F.lit("Braund, Mr. Owen")))) == "Mr"
    assert one(spark, C.missing_like(F.lit(" N/A "))) and not one(spark, C.missing_like(F.lit("x")))
    assert C.named("unitPrice", ["price"]) and not C.named("priced", ["price"])
