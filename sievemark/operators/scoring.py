"""Field-by-field scores of predictions, cost, latency and failures, as aggregates by variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import vocab
from ..functions.columns import amounts_within, rounded, set_keys, title_key
from ..sources.records import one_of_each_key
from .percentiles import exact_percentiles


def matched(preds: DataFrame, gold: DataFrame, id_col: str = "offer_id", fields: Sequence[str] | None = None) -> DataFrame:
    """``preds (variant, id, valid, parsed, ...)`` with their gold; of repeated gold the last by ``pos`` counts (without a
    ``pos`` it is an error), repeated predictions each do. A missing ``valid`` is false.

    With ``fields``, both sides carry only these through the join, the set fields as sets of hashes (``set_keys``).
    """  # noqa: D205
    if fields is not None:
        only = lambda x: F.struct(*((set_keys(F.col(x)[f]) if f in vocab.SET_FIELDS else F.col(x)[f]).alias(f) for f in fields))
        preds, gold = preds.withColumn("parsed", only("parsed")), gold.withColumn("gold", only("gold"))
    rows = preds.join(one_of_each_key(gold, id_col).select(id_col, "gold"), id_col)
    return rows.withColumn("valid", F.coalesce("valid", F.lit(False)))


def set_contributions(rows: DataFrame, fields: Sequence[str] = vocab.SET_FIELDS) -> DataFrame:
    """Counts of each row and field; an invalid prediction is an empty one.

    Both sides are made sets of hashes once, unless they came as such (``matched``); all counts follow from their sizes and
    that of what they share, and only these are dealt out to the fields.
    """

    def keys(side: str, field: str) -> Column:
        x = F.col(side)[field]
        made = isinstance(rows.schema[side].dataType[field].dataType.elementType, LongType)
        return x if made else set_keys(x)

    made = rows.withColumns({f"__{side}_{f}": keys(side, f) for side in ("parsed", "gold") for f in fields})

    def sizes(field: str) -> Column:
        p, g = F.col(f"__parsed_{field}"), F.col(f"__gold_{field}")
        own = lambda n: F.when(F.col("valid"), n).otherwise(0)
        return F.struct(F.lit(field).alias("field"), own(F.size(F.array_intersect(p, g))).alias("tp"), own(F.size(p)).alias("p"), F.size(g).alias("g"))

    made = made.withColumn("__s", F.array(*map(sizes, fields))).drop(*(f"__{side}_{f}" for side in ("parsed", "gold") for f in fields))
    made = made.withColumn("__s", F.explode("__s"))
    tp, n_p, n_g = F.col("__s.tp"), F.col("__s.p"), F.col("__s.g")
    counts = F.struct(
        F.col("__s.field").alias("field"), tp.alias("tp"), (n_p - tp).alias("fp"), (n_g - tp).alias("fn"),
        ((n_g > 0) & (tp == n_p) & (tp == n_g)).cast("int").alias("exact_supported"), (n_g > 0).cast("int").alias("support"), (n_p > 0).cast("int").alias("n_pred_nonempty"),
    )
    return made.withColumn("c", counts).drop("__s")


COUNTS = ("tp", "fp", "fn", "exact_supported", "support", "n_pred_nonempty")


def ratios(sums: DataFrame) -> DataFrame:
    """Precision, recall, F1 and exact match from sums of counts; null where nothing can be measured."""
    measurable = (F.col("support") > 0) | (F.col("n_pred_nonempty") > 0)
    share = lambda n, d: F.when(measurable, F.coalesce(F.try_divide(F.col(n).cast("double"), d), F.lit(0.0)))
    out = sums.withColumn("p", share("tp", F.col("tp") + F.col("fp"))).withColumn("r", share("tp", F.col("tp") + F.col("fn")))
    f1 = F.when(F.col("p").isNotNull() & F.col("r").isNotNull(), F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    exact = F.try_divide(F.col("exact_supported").cast("double"), F.col("support"))
    return out.withColumns({"precision": rounded(F.col("p")), "recall": rounded(F.col("r")), "f1": rounded(f1), "exact": rounded(exact)}).drop("p", "r")


def set_scores(rows: DataFrame, fields: Sequence[str] = vocab.SET_FIELDS) -> DataFrame:
    """One row per variant and field."""
    counts = set_contributions(rows, fields)
    return ratios(counts.groupBy("variant", F.col("c.field").alias("field")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"c.{c}").alias(c) for c in COUNTS)))


def headline(scores: DataFrame, fields: Sequence[str] = vocab.HEADLINE_FIELDS) -> DataFrame:
    """Mean of the rounded F1 of the headline fields that can be measured."""
    return scores.groupBy("variant").agg(rounded(F.avg(F.when(F.col("field").isin(*fields), F.col("f1")))).alias("headline_f1"))


def salary_scores(rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Detection over all rows; currency, kind and amounts over those with a gold salary, an invalid row being a miss."""
    p, g = F.col("parsed.salary"), F.col("gold.salary")
    there, both = g.isNotNull(), F.col("valid") & p.isNotNull() & g.isNotNull()
    support = F.count_if(there)
    share = lambda hit: rounded(F.try_divide(F.count_if(both & hit).cast("double"), support))
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), support.alias("salary_support"),
        rounded(F.avg((F.col("valid") & (p.isNotNull() == there)).cast("double"))).alias("detection"),
        share(p["currency"].eqNullSafe(g["currency"])).alias("currency"), share(p["kind"].eqNullSafe(g["kind"])).alias("kind"),
        share(amounts_within(p, g, tolerance)).alias("amounts"),
    )


def totals(rows: DataFrame, n_gold: int, id_col: str = "offer_id") -> DataFrame:
    """Rows, coverage of the gold rows, repeated rows, validity and exact titles (over gold titles that are not blank)."""
    title, own = title_key(F.col("gold.title")), title_key(F.col("parsed.title"))
    ids = F.count_distinct(id_col)
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.lit(n_gold).cast("long").alias("n_gold"),
        rounded(F.coalesce(F.try_divide(ids.cast("double"), F.lit(n_gold)), F.lit(0.0))).alias("coverage"),
        (F.count(F.lit(1)) - ids).alias("n_duplicate_rows"), rounded(F.avg(F.col("valid").cast("double"))).alias("json_validity"),
        F.count_if(title != "").alias("title_support"),
        rounded(F.try_divide(F.count_if((title != "") & F.col("valid") & (own == title)).cast("double"), F.count_if(title != ""))).alias("title_exact"),
    ).withColumn("trustworthy", (F.col("coverage") >= 1) & (F.col("n_duplicate_rows") == 0))


def cost_and_latency(preds: DataFrame, price_in: float | None, price_out: float | None) -> DataFrame:
    """Cost of a thousand calls (over rows that have input tokens; null without prices) and latency, over all rows.

    The percentiles are exact for variants of any size (``percentiles``).
    """
    calls = (F.col("input_tokens") * F.lit(price_in) + F.coalesce("output_tokens", F.lit(0)) * F.lit(price_out)) / 1e6
    costs = preds.groupBy("variant").agg(
        rounded(F.avg(F.when(F.col("input_tokens").isNotNull(), calls)) * 1000).alias("cost_per_1k"),
        rounded(F.avg(F.when(F.col("output_tokens") > 0, F.col("output_tokens"))), 1).alias("mean_output_tokens"),
    )
    at = exact_percentiles(preds, "latency_s", {"p50": 0.5, "p95": 0.95}, ("variant",)).withColumnRenamed("variant", "__v")
    out = costs.join(at, F.col("variant").eqNullSafe(F.col("__v")), "left")
    return out.select("variant", "cost_per_1k", rounded(F.col("p50"), 3).alias("latency_p50"), rounded(F.col("p95"), 3).alias("latency_p95"), "mean_output_tokens")


def failures(rows: DataFrame, default_cap: int | None = None) -> DataFrame:
    """Invalid rows by class, every class with its row; ``at_token_cap`` counts decode errors that used all their tokens."""
    known = F.when(F.col("failure").isin(*vocab.FAILURES), F.col("failure")).otherwise(F.lit(vocab.FAILURES[-1]))
    bad = rows.where(~F.col("valid")).withColumn("failure", known)
    cap = F.coalesce(F.when(F.col("max_tokens") > 0, F.col("max_tokens")), F.lit(default_cap).cast("long"))
    counted = bad.groupBy("variant", "failure").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("failure") == "json_decode_error") & (F.col("output_tokens") >= cap)).alias("at_token_cap")
    )
    classes = rows.sparkSession.createDataFrame([(c, i) for i, c in enumerate(vocab.FAILURES)], "failure string, ord int")
    grid = rows.select("variant").distinct().crossJoin(F.broadcast(classes))  # variants times five
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return grid.join(counted, ["variant", "failure"], "left").select("variant", "failure", "ord", zero("n"), zero("at_token_cap"))


def best_recall(scores: DataFrame) -> DataFrame:
    return scores.groupBy("field").agg(F.max("recall").alias("best_recall"))


def pick_winner(report: DataFrame) -> DataFrame:
    """The variant with the largest sum of headline F1 and validity; ties go to the lower median latency, then by ``pos``."""
    total = F.coalesce("headline_f1", F.lit(0.0)) + F.col("json_validity")
    return report.orderBy(F.desc(total), F.coalesce("latency_p50", F.lit(0.0)), "pos").limit(1)


def report(preds: DataFrame, gold: DataFrame, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """One row per variant: totals, headline, salary, cost and latency. Cost and latency are over all rows of ``preds``.

    A variant that answers no gold record has its row, with no rows, no coverage and no validity.
    """
    rows, n_gold = matched(preds, gold), gold.count()
    out = preds.select("variant").distinct().join(totals(rows, n_gold), "variant", "left").join(headline(set_scores(rows)), "variant", "left")
    zeros = {"n": 0, "n_gold": n_gold, "coverage": 0.0, "n_duplicate_rows": 0, "json_validity": 0.0, "title_support": 0, "trustworthy": False}
    out = out.fillna(zeros).join(salary_scores(rows).drop("n"), "variant", "left").fillna({"salary_support": 0})
    return out.join(cost_and_latency(preds, price_in, price_out), "variant", "left")


def report_metadata(report: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: gold records, those with a salary, and the variants that are incomplete or have repeated rows, in order."""
    names = lambda bad: F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("variant")))), ",")
    variants = report.agg(names(F.col("coverage") < 1).alias("incomplete"), names(F.col("n_duplicate_rows") > 0).alias("duplicated"))
    totals_ = gold.agg(F.count(F.lit(1)).alias("n_gold"), F.count("gold.salary").alias("salary_support"))
    return totals_.crossJoin(variants)  # one row each
