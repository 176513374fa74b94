"""Preprocessing fitted on training rows only, applied as plain expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.config import Config

MISSING = "__MISSING__"
INFREQUENT = "__INFREQUENT__"
#: Up to so many rows quantiles come from one exact aggregate; beyond, brackets are narrowed first.
EXACT_ROWS = 5_000_000


def quantiles(df: DataFrame, columns: Iterable[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation; NaN and null don't count.

    The exact aggregate keeps every distinct value of a column in one task.  On many rows each
    wanted pair of neighbours is therefore bracketed by approximate quantiles, with exact counts
    below, until few rows are left between.
    """
    columns = list(columns)
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    n = df.count()
    if n <= EXACT_ROWS:
        row = df.agg(*(F.percentile(value[c], F.array(*map(F.lit, shares))).alias(c) for c in columns)).first()
        return {c: row[c] if row[c] is not None else [None] * len(shares) for c in columns}
    return {c: [_bracketed(df.select(value[c].alias("x")).filter("x is not null"), q) for q in shares] for c in columns}


def _bracketed(x: DataFrame, share: float) -> float | None:
    n = x.count()
    if not n:
        return None
    below, rows, part = 0, n, x
    wanted = share * (n - 1)
    while rows > EXACT_ROWS:
        at = (wanted - below) / max(1, rows - 1)
        lo, hi = part.agg(F.percentile_approx("x", [max(0.0, at - 0.002), min(1.0, at + 0.002)], 10_000)).first()[0]
        r = part.agg(F.count_if(F.col("x") < lo).alias("less"), F.count_if(F.col("x").between(lo, hi)).alias("inside")).first()
        if lo == hi:
            return lo
        if not (below + r.less <= wanted and wanted + 1 <= below + r.less + r.inside - 1) or r.inside == rows:
            break
        below, rows, part = below + r.less, r.inside, part.filter(F.col("x").between(lo, hi))
    place = wanted - below
    low = int(place)
    counts = part.groupBy("x").agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("x")))
    a, b = upto.agg(F.min(F.when(F.col("upto") > low, F.col("x"))), F.min(F.when(F.col("upto") > low + 1, F.col("x")))).first()
    return a if b is None else a + (b - a) * (place - low)


def value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value, n) of several columns as text in one pass; nulls don't count."""
    columns = list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def modes(counts: DataFrame) -> dict[str, str]:
    """The most frequent value of each column, the smallest on ties."""
    return {r.column: r.value for r in counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("m")).select("column", "m.value").collect()}


def vocabularies(counts: DataFrame, min_count: int = 1) -> tuple[dict[str, list[str]], set[str]]:
    """Sorted values seen often enough, and the columns that have rarer ones too."""
    kept: dict[str, list[str]] = {}
    for r in counts.filter(F.col("n") >= min_count).select("column", "value").collect():
        kept.setdefault(r.column, []).append(r.value)
    rare = {r.column for r in counts.filter(F.col("n") < min_count).select("column").distinct().collect()}
    return {c: sorted(v) for c, v in kept.items()}, rare


def top_codes(counts: DataFrame, most: int = 64, min_count: int = 1) -> dict[str, dict[str, int]]:
    """Codes 1, 2, ... by falling count and then value, for at most so many values a column."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    out: dict[str, dict[str, int]] = {}
    for r in counts.filter(F.col("n") >= min_count).withColumn("code", rank).filter(F.col("code") <= most).collect():
        out.setdefault(r.column, {})[r.value] = r.code
    return out


@dataclass
class Scaler:
    """Medians, means and deviations of numeric columns."""

    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]

    def apply(self, c: str) -> Column:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(self.median[c]))
        return (x - self.mean[c]) / self.scale[c]


def fit_scaler(train: DataFrame, columns: list[str], ddof: int = 0) -> Scaler:
    """Mean and deviation after the median took the missing values' place.

    A column without values is constant 0; a deviation of 0 or of a single row counts as 1.
    """
    if not columns:
        return Scaler({}, {}, {})
    median = {c: v[0] if v[0] is not None else 0.0 for c, v in quantiles(train, columns, [0.5]).items()}
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(median[c])) for c in columns}
    dev = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = train.agg(*(F.avg(x).alias(f"m:{c}") for c, x in filled.items()), *(dev(x).alias(f"s:{c}") for c, x in filled.items())).first()
    ok = lambda s: s if s and s == s else 1.0
    return Scaler(median, {c: row[f"m:{c}"] or 0.0 for c in columns}, {c: ok(row[f"s:{c}"]) for c in columns})


@dataclass
class OneHot:
    """Indicator columns: unknown values give zeros, missing ones the mode, rare ones may share a bucket."""

    vocabulary: dict[str, list[str]]
    mode: dict[str, str]
    bucket: set[str] = field(default_factory=set)

    def names(self, c: str) -> list[str]:
        return [f'{c}="{v}"' for v in self.vocabulary.get(c, [])] + ([f"{c}={INFREQUENT}"] if c in self.bucket else [])

    def apply(self, c: str) -> Column:
        """array<double>."""
        x = F.coalesce(F.col(c).cast("string"), F.lit(self.mode.get(c)))
        known = F.array(*(F.lit(v) for v in self.vocabulary.get(c, []))).cast("array<string>")
        out = F.transform(known, lambda v: F.coalesce((v == x).cast("double"), F.lit(0.0)))
        if c in self.bucket:
            rare = F.coalesce((~F.array_contains(known, x)).cast("double"), F.lit(0.0))
            out = F.concat(out, F.array(rare))
        return out


def fit_one_hot(train: DataFrame, columns: list[str], min_count: int = 1) -> OneHot:
    counts = value_counts(train, columns)
    kept, rare = vocabularies(counts, min_count)
    return OneHot(kept, modes(counts), rare if min_count > 1 else set())


@dataclass
class Ordinal:
    """Frequency-ranked codes, 0 for unknown values, scaled."""

    codes: dict[str, dict[str, int]]
    mode: dict[str, str]
    scaler: Scaler

    def code(self, c: str) -> Column:
        x = F.coalesce(F.col(c).cast("string"), F.lit(self.mode.get(c, MISSING)))
        pairs = [F.lit(v) for item in self.codes.get(c, {}).items() for v in item]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), x), F.lit(0)).cast("double") if pairs else F.lit(0.0)

    def apply(self, c: str) -> Column:
        return (self.code(c) - self.scaler.mean[c]) / self.scaler.scale[c]


def fit_ordinal(train: DataFrame, columns: list[str], most: int = 64, min_count: int = 1) -> Ordinal:
    counts = value_counts(train, columns)
    out = Ordinal(top_codes(counts, most, min_count), modes(counts), Scaler({}, {}, {}))
    out.scaler = fit_scaler(train.select(*(out.code(c).alias(c) for c in columns)), columns, ddof=1)
    return out


@dataclass
class Prep:
    """Everything fitted on training rows, and the feature vector it makes."""

    numeric: list[str]
    nominal: list[str]
    scaler: Scaler
    encoder: OneHot | Ordinal

    def feature_names(self) -> list[str]:
        if isinstance(self.encoder, OneHot):
            return self.numeric + [n for c in self.nominal for n in self.encoder.names(c)]
        return self.numeric + self.nominal

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        parts = [F.array(*(self.scaler.apply(c) for c in self.numeric)).cast("array<double>")]
        if isinstance(self.encoder, OneHot):
            parts += [self.encoder.apply(c) for c in self.nominal]
        else:
            parts.append(F.array(*(self.encoder.apply(c) for c in self.nominal)).cast("array<double>"))
        return df.withColumn(name, F.concat(*parts))

    def to_dict(self) -> dict:
        """Everything that transform() needs, as JSON types."""
        encoder = {"kind": "one_hot", "vocabulary": self.encoder.vocabulary, "mode": self.encoder.mode, "bucket": sorted(self.encoder.bucket)} if isinstance(self.encoder, OneHot) else {"kind": "ordinal", "codes": self.encoder.codes, "mode": self.encoder.mode, "scaler": asdict(self.encoder.scaler)}
        return {"numeric": self.numeric, "nominal": self.nominal, "scaler": asdict(self.scaler), "encoder": encoder}

    @classmethod
    def from_dict(cls, found: dict) -> Prep:
        """A frozen preprocessing, to be applied without any fit; ValueError if parts are missing."""
        e, scaler = found["encoder"], Scaler(**found["scaler"])
        encoder = OneHot(e["vocabulary"], e["mode"], set(e["bucket"])) if e["kind"] == "one_hot" else Ordinal(e["codes"], e["mode"], Scaler(**e["scaler"]))
        out = cls(list(found["numeric"]), list(found["nominal"]), scaler, encoder)
        out.validate()
        return out

    def validate(self) -> None:
        """Every column has its parameters, all finite, and no scale is 0."""
        own = [(self.scaler, self.numeric)] + ([(self.encoder.scaler, self.nominal)] if isinstance(self.encoder, Ordinal) else [])
        for scaler, columns in own:
            for c in columns:
                values = [part.get(c) for part in (scaler.median, scaler.mean, scaler.scale)]
                if any(v is None or v != v or abs(v) == float("inf") for v in values) or values[2] == 0:
                    raise ValueError(f"no usable statistics for {c}")
        if len(set(self.feature_names())) < len(self.feature_names()):
            raise ValueError("features repeat")

    def describe(self) -> dict:
        return {"numeric": self.numeric, "nominal": self.nominal, "output_features": self.feature_names(), "scaler": asdict(self.scaler), "encoder": type(self.encoder).__name__}


def fit(train: DataFrame, numeric: list[str], nominal: list[str], cfg: Config = Config()) -> Prep:
    """cpu semantics: one-hot and population deviations; gpu semantics: ordinal codes and sample deviations.

    The connection state of the strict policy is always one-hot, without rare buckets.
    """
    cpu = cfg.semantics == "cpu"
    scaler = fit_scaler(train, numeric, 0 if cpu else 1)
    if cpu or nominal == ["conn_state"]:
        return Prep(numeric, nominal, scaler, fit_one_hot(train, nominal, 1 if nominal == ["conn_state"] else cfg.onehot_min_frequency))
    return Prep(numeric, nominal, scaler, fit_ordinal(train, nominal, cfg.max_categories_per_col, cfg.onehot_min_frequency))
