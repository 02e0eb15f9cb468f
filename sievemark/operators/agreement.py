"""Agreement of label sources: raw agreement, Cohen's kappa, three-way triangulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contract, vocab
from ..functions.columns import rounded, same_salary, same_set, text_set, title_key
from ..sources.records import one_of_each_key
from . import curate, scoring

BUCKETS = ("all_agree", "platform_gap_caught", "llm_error", "all_differ")


def field_equal(a: str, b: str, field: str, tolerance: float = 0.05) -> Column:
    x, y = F.col(f"{a}.{field}"), F.col(f"{b}.{field}")
    if field == "salary":
        return same_salary(x, y, tolerance)
    return title_key(x) == title_key(y) if field == "title" else same_set(x, y)


def pairs(a: DataFrame, b: DataFrame, id_col: str = "offer_id") -> DataFrame:
    """Both sources' labels ``(id, a, b)`` where both have the id; ``label`` holds the fields. Of repeated ids the last by
    ``pos`` counts; without a ``pos`` they are an error."""  # noqa: D205
    one, other = one_of_each_key(a, id_col), one_of_each_key(b, id_col)
    return one.select(id_col, F.col("label").alias("a")).join(other.select(id_col, F.col("label").alias("b")), id_col)


def disagreements(matched: DataFrame, fields: Sequence[str] = vocab.LABEL_FIELDS, tolerance: float = 0.05) -> DataFrame:
    """A flag per field, and ``any``."""
    out = matched.withColumns({f"differs_{f}": ~field_equal("a", "b", f, tolerance) for f in fields})
    some = F.lit(False)
    for f in fields:
        some = some | F.col(f"differs_{f}")
    return out.withColumn("any", some)


def raw_agreement(matched: DataFrame, fields: Sequence[str] = vocab.LABEL_FIELDS, tolerance: float = 0.05) -> DataFrame:
    """Share of equal labels by field; 1.0 where nothing matches."""
    spread = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), field_equal("a", "b", f, tolerance).alias("equal")) for f in fields)))
    names = matched.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    shares = matched.select(spread.alias("x")).groupBy("x.field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x.equal").cast("double")).alias("agreement"))
    return names.join(shares, "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.coalesce("agreement", F.lit(1.0))).alias("agreement"))


def category(x: Column) -> Column:
    """A set as one category."""
    return F.array_join(F.array_sort(text_set(x)), ",")


def cohen_kappa(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(n, po, pe, kappa)`` of two columns of categories. The marginal counts meet by category; no row pairs are made."""
    both = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    counts = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("leg"), F.col(a).alias("c")), F.struct(F.lit(1).alias("leg"), F.col(b).alias("c")))).alias("x"))
    by = counts.groupBy("x.c").agg(F.count_if(F.col("x.leg") == 0).alias("na"), F.count_if(F.col("x.leg") == 1).alias("nb"))
    expected = by.agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"))
    out = both.crossJoin(expected).withColumn("pe", F.try_divide("cross", F.col("n").cast("double") * F.col("n")))  # one row each
    kappa = (
        F.when(F.col("n") == 0, 1.0).when(F.col("pe") >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0))
        .otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    )
    return out.select("n", "po", "pe", kappa.alias("kappa"))


def triangulate(human: DataFrame, llm: DataFrame, platform: DataFrame, fields: Sequence[str] = vocab.LABEL_FIELDS, tolerance: float = 0.05, id_col: str = "offer_id") -> DataFrame:
    """Counts by field and bucket over the human labels, and their totals; every cell has its row."""
    human, llm, platform = (one_of_each_key(x, id_col) for x in (human, llm, platform))
    rows = human.select(id_col, F.col("label").alias("h"))
    rows = rows.join(llm.select(id_col, F.col("label").alias("l")), id_col, "left").join(platform.select(id_col, F.col("label").alias("p")), id_col, "left")

    def bucket(f: str) -> Column:
        le, pe = (F.coalesce(field_equal(x, "h", f, tolerance), F.lit(False)) for x in ("l", "p"))
        return F.when(le & pe, BUCKETS[0]).when(le, BUCKETS[1]).when(pe, BUCKETS[2]).otherwise(BUCKETS[3])

    spread = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), bucket(f).alias("bucket")) for f in fields)))
    counted = rows.select(spread.alias("x")).groupBy("x.field", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    grid = human.sparkSession.createDataFrame([(f, b) for f in fields for b in BUCKETS], "field string, bucket string")
    cells = grid.join(counted, ["field", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return cells.unionByName(cells.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("field", F.lit("total")))


def platform_leg(records: DataFrame, id_col: str = "offer_id") -> DataFrame:
    """Labels of the records themselves."""
    return records.select(id_col, F.col("gold").alias("label"))


def llm_leg(proposals: DataFrame, id_col: str = "offer_id") -> DataFrame:
    """Labels of a model's proposals; without a ``valid`` they are not, and an unparsed one has no fields."""
    return proposals.select(id_col, F.coalesce("valid", F.lit(False)).alias("valid"), F.col("parsed").alias("label"))


def human_leg(rows: DataFrame, aliases: DataFrame, id_col: str = "offer_id") -> DataFrame:
    """Labels by hand, in ``human_gold`` or in columns of their own where that is null; only technologies are made canonical.

    Blank technologies go, repeated ones stay; closed vocabularies are taken as written.
    """
    fields = ("title", *vocab.SET_FIELDS, "contract_types", "salary")
    flat = rows.select(id_col, *(F.coalesce(F.col(f"human_gold.{f}"), F.col(f)).alias(f) for f in fields))
    flat = curate.normalise_lists(flat, ("tech_expected", "tech_optional"), aliases, id_col, distinct=False)
    return flat.select(id_col, F.struct(*fields).alias("label"))


def checked_human_gold(rows: DataFrame, id_col: str = "offer_id") -> DataFrame:
    """``rows``, whose labels must keep to the contract, in ``human_gold`` or, where that is null or absent, in columns of their
    own; a row that does not fails the job with its name and fields. Rows that are not labelled yet are left alone."""  # noqa: D205
    nested = F.col("human_gold") if "human_gold" in rows.columns else F.lit(None).cast(vocab.GOLD)
    lacking = lambda f: F.lit(None).cast(contract.spark_type(contract.GOLD.fields[f])).alias(f)
    flat = F.struct(*(F.col(f) if f in rows.columns else lacking(f) for f in contract.GOLD_FIELDS))
    names = [f.name for f in rows.schema["human_gold"].dataType.fields] if "human_gold" in rows.columns else []
    broken = F.when(nested.isNotNull(), contract.violations(nested, contract.GOLD, fields=names)).otherwise(contract.violations(flat, contract.GOLD))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    message = F.concat(F.lit("human_gold row "), name, F.lit(" does not fit the schema: "), F.array_join(broken, ", "))
    return rows.where(F.when(F.size(broken) == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def pairwise(a: DataFrame, b: DataFrame, tolerance: float = 0.05, id_col: str = "offer_id") -> DataFrame:
    """Agreement of a proposed source ``a`` with ``b`` as rows ``(field, metric, value)``.

    Over the ids of both: their number, validity of ``a`` (true where it has none), titles, agreement, F1 and exact match of
    each set field, kappa of the two closed ones, and salaries.
    """
    side = a if "valid" in a.columns else a.withColumn("valid", F.lit(True))
    side = one_of_each_key(side.withColumn("valid", F.coalesce("valid", F.lit(True))), id_col)
    both = pairs(a, b, id_col).join(side.select(id_col, "valid"), id_col)
    rows = both.select(F.lit("").alias("variant"), id_col, "valid", F.col("a").alias("parsed"), F.col("b").alias("gold"))
    n = rows.count()

    def long(frame: DataFrame, field: Column, *metrics: tuple[str, str]) -> DataFrame:
        spread = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics)))
        return frame.select(field.alias("field"), spread.alias("x")).select("field", "x.metric", "x.value")

    totals = scoring.totals(rows, n)
    out = long(totals, F.lit("all"), ("n", "n"), ("json_validity", "json_validity")).unionByName(long(totals, F.lit("title"), ("exact", "title_exact")))
    out = out.unionByName(long(raw_agreement(both, ("title", *vocab.SET_FIELDS), tolerance), F.col("field"), ("agreement", "agreement")))
    out = out.unionByName(long(scoring.set_scores(rows), F.col("field"), ("f1", "f1"), ("exact", "exact")))
    for f in ("seniority", "work_mode"):
        kappa = cohen_kappa(both.select(category(F.col(f"a.{f}")).alias("a"), category(F.col(f"b.{f}")).alias("b")))
        out = out.unionByName(long(kappa.select(rounded(F.col("kappa")).alias("kappa")), F.lit(f), ("kappa", "kappa")))
    salary = scoring.salary_scores(rows, tolerance)
    return out.unionByName(long(salary, F.lit("salary"), *((m, m) for m in ("salary_support", "detection", "currency", "kind", "amounts"))))


def full_report(llm: DataFrame, platform: DataFrame, human: DataFrame | None = None, tolerance: float = 0.05, id_col: str = "offer_id") -> DataFrame:
    """``(pair, field, metric, value)`` of all pairs of label sources; those with labels by hand, and how the three differ
    (``pair`` "triangulation", with buckets as metrics), only where there are such labels."""  # noqa: D205
    named = lambda pair, rows: rows.select(F.lit(pair).alias("pair"), "field", "metric", "value")
    out = named("llm_platform", pairwise(llm, platform, tolerance, id_col))
    if human is None:
        return out
    out = out.unionByName(named("llm_human", pairwise(llm, human, tolerance, id_col))).unionByName(named("platform_human", pairwise(platform, human, tolerance, id_col)))
    cells = triangulate(human, llm, platform, tolerance=tolerance, id_col=id_col)
    return out.unionByName(named("triangulation", cells.select("field", F.col("bucket").alias("metric"), F.col("n").cast("double").alias("value"))))
