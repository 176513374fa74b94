"""Classification metrics from confusion tables and score histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) as text."""
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(table: DataFrame) -> DataFrame:
    """Rows true_x, columns pred_x, over the sorted union of labels."""
    labels = sorted({r[0] for r in table.select("truth").union(table.select("predicted")).distinct().collect()})
    grid = table.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    wide = grid.join(table, "truth", "left").groupBy("truth").agg(*(F.coalesce(F.sum(F.when(F.col("predicted") == x, F.col("n"))), F.lit(0)).cast("bigint").alias(f"pred_{x}") for x in labels))
    return wide.orderBy("truth").withColumn("truth", F.concat(F.lit("true_"), "truth"))


def by_class(table: DataFrame) -> DataFrame:
    """(class, support, predicted, tp, precision, recall, f1); 0 where a denominator is 0."""
    sides = table.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("x.*")
    sums = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp")))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    t = sums.withColumn("precision", part("tp", "predicted")).withColumn("recall", part("tp", "support"))
    both = F.col("precision") + F.col("recall")
    return t.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def summary(table: DataFrame) -> DataFrame:
    """accuracy, macro and support-weighted precision, recall and F1, in a row.

    Macro means go over classes that are true or predicted somewhere.
    """
    t = by_class(table)
    out = [(F.sum("tp") / F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        out += [F.avg(m).alias(f"macro_{m}"), (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}")]
    return t.agg(*out)


def support_report(table: DataFrame, classes: list[str], small: int = 30) -> dict:
    """Supports with zeros, and absent and scarce classes."""
    seen = {r["class"]: r.support for r in by_class(table).collect()}
    support = {c: seen.get(c, 0) for c in classes}
    return {"support": support, "absent": [c for c, n in support.items() if not n], "small_support": {c: n for c, n in support.items() if 0 < n < small}}


def report_text(table: DataFrame) -> str:
    rows = by_class(table).orderBy("class").collect()
    s = summary(table).first()
    wide = max([len("weighted avg"), *(len(r["class"]) for r in rows)])
    line = lambda name, p, r, f, n: f"{name:>{wide}} {p:9.4f} {r:9.4f} {f:9.4f} {n:9d}"
    total = sum(r.support for r in rows)
    out = [f"{'':>{wide}} precision    recall        f1   support", *(line(r["class"], r.precision, r.recall, r.f1, r.support) for r in rows), f"{'accuracy':>{wide}} {'':9} {'':9} {s.accuracy:9.4f} {total:9d}"]
    return "\n".join([*out, line("macro avg", s.macro_precision, s.macro_recall, s.macro_f1, total), line("weighted avg", s.weighted_precision, s.weighted_recall, s.weighted_f1, total)]) + "\n"


# Binary scores --------------------------------------------------------------------------------


#: Distinct scores that a task sorts, on average, and the most ranges of scores.
RANGE_SCORES, MOST_RANGES = 500_000, 1024


def score_table(df: DataFrame, score: str, positive: str, ranges: int | None = None) -> DataFrame:
    """(score, pos, all, tp, fp, p, n, range) cumulated from the highest score down.

    Rows are summed by distinct score first.  Scores are cut into ranges at their quantiles, as many
    as there are scores for; the running sums of a range start from a table with a row for each
    range, so no task sorts all scores.
    """
    hist = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(positive).cast("bigint")).alias("pos"), F.count("*").alias("all"))
    if ranges is None:
        ranges = min(MOST_RANGES, 1 + hist.count() // RANGE_SCORES)
    borders = hist.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or [] if ranges > 1 else []
    held = F.array(*(F.lit(float(x)) for x in sorted(set(borders)))).cast("array<double>")
    hist = hist.withColumn("range", F.size(F.filter(held, lambda b: b <= F.col("score"))))
    own = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    sums = hist.groupBy("range").agg(F.sum("pos").alias("_p"), F.sum("all").alias("_a"))
    sums = sums.select(F.col("range").alias("_r"), F.coalesce(F.sum("_p").over(own), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_a").over(own), F.lit(0)).alias("_a0"), F.sum("_p").over(everything).alias("p"), (F.sum("_a").over(everything) - F.sum("_p").over(everything)).alias("n"))
    inside = Window.partitionBy("range").orderBy(F.col("score").desc())
    t = hist.join(F.broadcast(sums), F.col("range") == F.col("_r"))  # at most MOST_RANGES rows
    tp = F.col("_p0") + F.sum("pos").over(inside)
    return t.select("score", "pos", "all", tp.alias("tp"), (F.col("_a0") + F.sum("all").over(inside) - tp).alias("fp"), "p", "n", "range")


def roc_auc(table: DataFrame) -> DataFrame:
    """From average ranks: ties count half.  Null unless both classes occur."""
    negatives = F.col("all") - F.col("pos")
    wins = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + negatives / 2))
    return table.agg((wins / F.nullif(F.max("p") * F.max("n"), F.lit(0))).alias("roc_auc"))


def average_precision(table: DataFrame) -> DataFrame:
    """The sum over thresholds of the step in recall times the precision."""
    step = F.col("pos") / F.nullif(F.col("p"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return table.agg(F.sum(step).alias("average_precision"))


def roc_points(table: DataFrame) -> DataFrame:
    """(threshold, tp, fp, p, n) of the corners of the curve; points on a straight line drop out.

    A point's neighbours are looked up within its range of scores; those beyond the range's ends come
    from a table with a row for each range.
    """
    point = F.struct("tp", "fp").alias("x")
    ends = table.groupBy("range").agg(F.max_by(point, "score").alias("top"), F.min_by(point, "score").alias("bottom"))
    down = Window.orderBy(F.col("range").desc())
    ends = ends.select(F.col("range").alias("_r"), F.lag("bottom").over(down).alias("above"), F.lead("top").over(down).alias("below"))
    order = Window.partitionBy("range").orderBy(F.col("score").desc())
    t = table.join(F.broadcast(ends), F.col("range") == F.col("_r"))
    t = t.withColumn("_before", F.coalesce(F.lag(F.struct("tp", "fp")).over(order), "above")).withColumn("_after", F.coalesce(F.lead(F.struct("tp", "fp")).over(order), "below"))
    bend = lambda c: F.col(f"_before.{c}") + F.col(f"_after.{c}") != 2 * F.col(c)
    keep = F.col("_before").isNull() | F.col("_after").isNull() | bend("tp") | bend("fp")
    return t.filter(keep).select(F.col("score").alias("threshold"), "tp", "fp", "p", "n")


def fpr_at_tpr(table: DataFrame, least: float = 0.95) -> DataFrame:
    """Of the curve's corners with enough recall, the first with the least false positive rate."""
    rows = roc_points(table).filter(F.col("tp") / F.col("p") >= least)
    best = rows.agg(F.min(F.struct((F.col("fp") / F.col("n")).alias("fpr"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.col("b.fpr").alias("fpr_at_tpr"), (-F.col("b.t")).alias("threshold"))


def positive_label(classes: list[str]) -> str:
    """1, or a telling name, or the last one."""
    low = {c.lower(): c for c in classes}
    return next((low[x] for x in ("1", "attack", "malicious", "anomaly", "true") if x in low), classes[-1])


def binary(df: DataFrame, truth: str, score: str, classes: list[str]) -> dict:
    """roc_auc, average_precision, fpr_at_tpr95 and its threshold; nulls unless there are exactly two classes."""
    names = {"roc_auc": None, "average_precision": None, "fpr_at_tpr95": None, "threshold": None}
    seen = [r[0] for r in df.select(F.col(truth).cast("string")).distinct().limit(3).collect()]
    if len(classes) != 2 or len(seen) != 2:
        return names
    t = score_table(df.withColumn("_pos", F.col(truth).cast("string") == positive_label(sorted(classes))), score, "_pos")
    at = fpr_at_tpr(t).first()
    return {"roc_auc": roc_auc(t).first()[0], "average_precision": average_precision(t).first()[0], "fpr_at_tpr95": at.fpr_at_tpr, "threshold": at.threshold}
