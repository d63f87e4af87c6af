"""Column profiles from one fused aggregation, and the decisions on kinds that rest on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen import vocab
from lumen.functions.columns import finite, integer_like, named, parse_datetime, segments, to_number
from lumen.operators.quantiles import value_counts

#: Patterns of protected text; a column is of the first that 90 % of its values match.
SUBTYPES = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ip_address": r"^(\d{1,3}\.){3}\d{1,3}$",
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "url": r"^https?://\S+$",
    "phone": r"^(?!\d{4}-\d{2}-\d{2}$)\+?[0-9][0-9()\s.-]{6,18}[0-9]$",
    "zip_code": r"^[0-9]{5}(-[0-9]{4})?$",
    "currency_amount": r"^[$€£¥]\s*[0-9][0-9,]*(\.[0-9]+)?$",
}


@dataclass
class Profile:
    """What is known of a column."""

    name: str
    type: str
    rows: int = 0
    count: int = 0
    unique: int = 0
    numeric: bool = False
    integral: bool = False
    low: float | None = None
    high: float | None = None
    sd: float | None = None
    length: float = 0.0
    numbers: float = 0.0
    dates: float = 0.0
    subtypes: dict[str, float] = field(default_factory=dict)
    dominant: float = 0.0

    @property
    def nulls(self) -> int:
        return self.rows - self.count

    @property
    def missing(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    @property
    def ratio(self) -> float:
        return self.unique / self.count if self.count else 0.0

    @property
    def constant(self) -> bool:
        return self.count > 0 and self.unique == 1

    @property
    def sequential(self) -> bool:
        """Sorted values are a run of integers without gap or repeat."""
        return self.integral and self.count > 3 and self.unique == self.count and self.high - self.low + 1 == self.count

    @property
    def identifier(self) -> bool:
        n = self.name.lower()
        compact = "".join(segments(self.name))
        if n in vocab.ID_EXACT or any(n.endswith(s) for s in vocab.ID_SUFFIXES) or (len(compact) >= 6 and any(compact.endswith(s) for s in vocab.ID_COMPACT)):
            return True
        return self.integral and (self.sequential or self.count >= vocab.ID_ROWS and self.ratio > vocab.ID_RATIO)

    @property
    def ordinal(self) -> bool:
        """Numbers that stand for a few classes."""
        if not self.numeric or not self.count:
            return False
        scale = named(self.name, ["class", "rating", "grade", "level", "tier", "rank"])
        return self.unique <= 2 or scale and self.unique <= 10 or self.integral and self.unique <= 5 and self.high - self.low <= 15

    @property
    def kind(self) -> str:
        """The kind for analysis."""
        if self.type == "boolean":
            return "boolean"
        if self.type.startswith(("timestamp", "date")):
            return "datetime"
        if self.numeric:
            return "identifier" if self.identifier else "numeric"
        if self.identifier:
            return "identifier"
        if self.unique > 20 and self.ratio > 0.5 or self.unique >= 5 and self.ratio > 0.25 and self.length >= 40:
            return "text"
        return "categorical"

    @property
    def semantic(self) -> str:
        """The kind for cleaning; protected patterns are identifiers."""
        by_name = self.name.lower() in vocab.ID_EXACT or any(self.name.lower().endswith(s) for s in vocab.ID_SUFFIXES) or "identifier" in self.name.lower()
        if self.type == "boolean":
            return "boolean"
        if self.type.startswith(("timestamp", "date")):
            return "datetime"
        if self.numeric:
            return "identifier" if by_name else "numeric"
        if by_name or self.subtype in ("uuid", "ip_address", "email", "url", "phone", "zip_code"):
            return "identifier"
        if named(self.name, vocab.DATE_WORDS) and self.dates >= 0.85:
            return "datetime"
        if self.count >= 5 and self.numbers >= 0.98:
            return "numeric"
        return "text" if self.ratio >= 0.5 and self.unique > 20 and self.length >= 20 else "categorical"

    @property
    def subtype(self) -> str | None:
        return next((k for k in SUBTYPES if self.subtypes.get(k, 0) >= 0.90), None)

    @property
    def content(self) -> str:
        """What a value is, for planning."""
        if not self.count:
            return "empty"
        if self.kind == "identifier":
            return {"email": "email", "url": "url", "phone": "phone"}.get(self.subtype or "", "id")
        if self.kind == "datetime" or self.semantic == "datetime":
            return "date"
        if self.numeric:
            return "percentage" if named(self.name, vocab.PERCENTAGE_NAMES) else "currency" if named(self.name, vocab.PRICE_NAMES) else "numeric"
        if self.kind == "text":
            return "long_text" if self.length > 100 else "title" if named(self.name, ["title", "headline", "subject"]) else "name" if named(self.name, ["name"]) else "short_text"
        return "categorical"


def profile(df: DataFrame, columns: list[str] | None = None) -> dict[str, Profile]:
    """Profiles of all columns from one pass over the data and one count of the values of all; a row a column reaches the driver."""
    columns = list(df.columns if columns is None else columns)
    exprs, schema = [F.count("*").alias("rows")], df.schema
    for i, c in enumerate(columns):
        col, t = F.col(f"`{c}`"), schema[c].dataType
        exprs.append(F.count(col).alias(f"count{i}"))
        if isinstance(t, T.NumericType):
            v = finite(col.cast("double"))
            exprs += [F.bool_and(integer_like(v)).alias(f"integral{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    r = df.agg(*exprs).first().asDict()

    def text(c: str):
        t = schema[c].dataType
        return F.hex(F.col(f"`{c}`")) if isinstance(t, T.BinaryType) else ((F.col(f"`{c}`") + F.lit(0.0)) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`")).cast("string")  # -0.0 equals 0.0

    # What a text looks like is told of each distinct value, which may fill many rows.
    v, n, own = F.col("v"), F.col("n"), F.col("i").isin([i for i, c in enumerate(columns) if isinstance(schema[c].dataType, T.StringType)])
    looks = {"numbers": to_number(v).isNotNull(), "dates": parse_datetime(v).isNotNull()} | {k: v.rlike(p) for k, p in SUBTYPES.items()}
    facts = [(F.sum(F.when(own, n * F.char_length(v))) / F.sum(n)).alias("length")] + [(F.sum(F.when(own, F.when(cond, n).otherwise(0))) / F.sum(n)).alias(k) for k, cond in looks.items()]
    seen = {x["i"]: x for x in value_counts(df, {c: text(c) for c in columns}).groupBy("i").agg(F.count("*").alias("unique"), *facts).collect()} if columns else {}
    out = {}
    for i, c in enumerate(columns):
        t = schema[c].dataType
        p = Profile(c, t.simpleString(), r["rows"], r[f"count{i}"], seen[i]["unique"] if i in seen else 0)
        if isinstance(t, T.NumericType):
            p.numeric, p.integral, p.low, p.high, p.sd = True, bool(r[f"integral{i}"]), r[f"low{i}"], r[f"high{i}"], r[f"sd{i}"]
        elif isinstance(t, T.StringType) and i in seen:
            p.length, p.numbers, p.dates = seen[i]["length"], seen[i]["numbers"], seen[i]["dates"]
            p.subtypes = {k: seen[i][k] for k in SUBTYPES}
        out[c] = p
    return out
