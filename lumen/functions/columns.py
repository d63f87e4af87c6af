"""Scalar functions as Column expressions: text, dates, numbers, arrays."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen import vocab

# Text.


def trim_all(c: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def fold_case(c: Column) -> Column:
    return F.lower(trim_all(c))


def separator_key(c: Column) -> Column:
    """Equal for spellings that differ in case, spaces, hyphens or underscores only."""
    return F.lower(F.regexp_replace(trim_all(c), r"[\s_-]+", ""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def missing_like(c: Column, keep: list[str] | None = None) -> Column:
    """Null, blank, or a token that means missing; tokens in keep are values."""
    tokens = [t for t in vocab.MISSING_TOKENS if t not in {k.lower() for k in keep or []}]
    return c.isNull() | (trim_all(c) == "") | F.lower(trim_all(c)).isin(tokens)


def pattern_signature(c: Column) -> Column:
    """Runs of letters, digits and other characters as a, d and s, each with its length."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{L}", "\u0001"), r"\p{Nd}", "\u0002"), r"[^\u0001\u0002]", "\u0003")
    runs = F.regexp_extract_all(kinds, F.lit("(\u0001+|\u0002+|\u0003+)"), F.lit(1))
    name = lambda r: F.when(r.startswith("\u0001"), "a").when(r.startswith("\u0002"), "d").otherwise("s")
    return F.array_join(F.transform(runs, lambda r: F.concat(name(r), F.length(r).cast("string"))), "")


DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy"]


def parse_datetime(c: Column) -> Column:
    """The first of DATE_FORMATS that reads the value; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(trim_all(c), F.lit(f)) for f in DATE_FORMATS])


def to_number(c: Column) -> Column:
    """A double, or null where the text is not one; never NaN."""
    n = trim_all(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(n), n)


def accounting_number(c: Column) -> Column:
    """Currency signs, separators and percent signs off, (x) as -x, then a number."""
    s = F.regexp_replace(trim_all(c), r"[$€£¥,%\s]", "")
    return to_number(F.regexp_replace(s, r"^\((.*)\)$", "-$1"))


def classify_scalar(c: Column) -> Column:
    """numeric, boolean, date or text; null stays null."""
    s = trim_all(c)
    digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
    numeric = (digits * 2 > F.length(s)) & s.rlike(r"^[\s$€£¥(]*[-+]?[0-9][0-9,]*(\.[0-9]+)?[\s%)]*$")
    date = s.rlike(r"[-/:]") & parse_datetime(c).isNotNull()
    return F.when(s.isNull(), None).when(numeric, "numeric").when(F.lower(s).isin(vocab.BOOLEAN_WORDS), "boolean").when(date, "date").otherwise("text")


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All named and numbered entities; no built-in function covers them."""
    return s.map(html.unescape, na_action="ignore")


ENTITY, TAG = r"&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", r"</?[a-zA-Z][^>]*>"
MOJIBAKE = "Ã[\u0080-¿]|â€|Â[\u0080-¿]|�"


def url_domain(c: Column) -> Column:
    """Host of a URL without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), r"^www\.", "")


def split_values(c: Column, delimiter: str) -> Column:
    return F.filter(F.transform(F.split(c, re.escape(delimiter)), trim_all), lambda x: x != "")


def name_title(c: Column) -> Column:
    return F.regexp_extract(c, r",\s*([^.,]+)\.", 1)


def title_group(title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.TITLES.items() for x in kv])
    return F.when(title == "", None).otherwise(F.coalesce(F.try_element_at(table, title), F.lit("Rare")))


def ticket_prefix(c: Column) -> Column:
    s = F.upper(trim_all(c))
    return F.when(s == "LINE", "LINE").otherwise(F.regexp_replace(F.regexp_extract(s, r"^(.*?)\s*[0-9]*$", 1), r"[./\s]", ""))


def ticket_number(c: Column) -> Column:
    return F.regexp_extract(trim_all(c), r"([0-9]+)$", 1).try_cast("long")


def deck(c: Column) -> Column:
    first = F.upper(F.regexp_extract(trim_all(c), r"^([A-Za-z])", 1))
    return F.when(first.isNull() | (first == ""), vocab.UNKNOWN).otherwise(first)


def segments(name: str) -> list[str]:
    """Parts of a column name: cut at separators, at case changes and between letters and digits."""
    return [s.lower() for s in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def named(name: str, words: list[str]) -> bool:
    """Whether some word's parts are all among the name's parts."""
    own = set(segments(name))
    return any(set(segments(w)) <= own for w in words)


# Dates.


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def iso_weekday(c: Column) -> Column:
    return F.weekday(c) + 1


def span_days(low: Column, high: Column) -> Column:
    """Whole days of 24 hours from low to high, and one."""
    return F.timestamp_diff("DAY", low, high) + 1


def year_start(c: Column) -> Column:
    """1 January of an integer year from 1900 to 2100, else null."""
    return F.when(c.between(1900, 2100), F.make_date(c.cast("int"), F.lit(1), F.lit(1)))


# Numbers.


def finite(c: Column) -> Column:
    """Null where NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(finite(c.cast("double")), digits)


def integer_like(c: Column) -> Column:
    return F.abs(c % 1) <= 1e-8


def strength(c: Column) -> Column:
    return F.when(F.abs(c) >= 0.7, "strong").when(F.abs(c) >= 0.3, "moderate").otherwise("weak")


def strength5(c: Column) -> Column:
    a = F.abs(c)
    return F.when(a >= 0.8, "very strong").when(a >= 0.6, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("very weak")


def skew_adjusted(c: Column) -> Column:
    """Bias-adjusted skewness; null below three values or without spread."""
    n = F.count(c)
    return F.when(n > 2, finite(F.skewness(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_adjusted(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * finite(F.kurtosis(c)) + 6))


def entropy_of(count: Column, total: Column, epsilon: float = 0.0) -> Column:
    """Aggregates counts to bits; epsilon as in smoothed variants."""
    p = count / total
    return -F.sum(p * F.log2(p + epsilon))


def derived(op: str, **p) -> Column:
    """A declared formula: string_length, day_of_week, product, or sum_offset."""
    if op == "string_length":
        return F.char_length(F.col(p["source"]))
    if op == "day_of_week":
        return iso_weekday(F.col(p["source"])) if p.get("numbers") else day_name(F.col(p["source"]))
    if op == "product":
        return reduce(lambda a, b: a * b, [F.col(c) for c in p["sources"]])
    if op == "sum_offset":
        return reduce(lambda a, b: a + b, [F.col(c) for c in p["sources"]]) + F.lit(p.get("offset", 0))
    raise ValueError(f"no such formula: {op}")


def five_numbers(a: Column, k: float = 1.5) -> Column:
    """q1, median, q3, iqr and fences of an array's finite values, by linear interpolation; nulls if there are none."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))

    def q(p: float) -> Column:
        h = (F.size(s) - 1) * F.lit(p)
        lo = F.floor(h).cast("int")
        low, high = F.get(s, lo), F.get(s, F.ceil(h).cast("int"))
        return low + (high - low) * (h - lo)

    q1, q2, q3 = q(0.25), q(0.5), q(0.75)
    return F.struct(q1.alias("q1"), q2.alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"), (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper"))
