"""Secret scan with corpus-wide ownership frequency.

Patterns give base spans, which always stay. Every candidate value, of these and of a wider pattern of opaque strings, is
hashed, and the hashes are counted over the corpus by distinct repository and distinct owner. A value with one owner, in few
repositories, is owner-specific and looks live; a value that several owners or many repositories carry is a copied example. Opaque strings become spans only
where they are owner-specific and look random. Texts are scanned once and not shuffled: only spans and hashes move, and the
distinct counts are summed in two steps on the map side first, so a value that sits everywhere does not gather in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, row_key, text_or_empty
from ._spans import located

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
_SPAN = "array<struct<begin:int,rank:int,end:int,digest:binary>>"


@dataclass(frozen=True)
class Ownership:
    """A value is owner-specific with at most ``live_owners`` owners and ``live_repos`` of their repositories: what its owner
    has put into more looks like a setting or an example. Opaque strings need ``min_distinct`` characters."""  # noqa: D205

    live_owners: int = 1
    live_repos: int = 3
    min_distinct: int = 10


def _spans(found: Column, rank: int, value) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["begin"].alias("begin"), F.lit(rank).alias("rank"), (x["begin"] + F.length(x["value"])).alias("end"),
            F.unhex(F.sha2(value(x["value"]).cast("binary"), 256)).alias("digest"),
        ),
    ).cast(_SPAN)


def _base(text: Column) -> list[Column]:
    """Spans of each base kind. A failed assignment still takes up its text, so its length is tested after matching."""
    secret = lambda v: F.regexp_extract(v, ASSIGN, 2)
    assigned = F.filter(located(text, ASSIGN), lambda x: F.length(secret(x["value"])) >= 6)
    return [_spans(assigned, 0, secret), _spans(located(text, ACCESS), 1, lambda v: v), _spans(located(text, HEX), 2, lambda v: v)]


def _listed(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", kind(x), x["begin"], x["end"])), ",")


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"),
    owner_cols: tuple[str, ...] = ("source",), rules: Ownership = Ownership(),
) -> DataFrame:
    """One row per row of ``docs``: ``id``, counts of the base kinds, ``base_spans``, ``spans`` (with those added), and how
    many spans hold owner-specific (``n_live``) and copied (``n_copied``) values.

    A null text is empty and has no spans. Null repositories or owners count as one repository or owner of their own.
    Repeated rows and equal ids each get their own row; a value that repeats within a repository counts once there. Other
    columns, whatever their names, are ignored. An empty table gives an empty result; texts of any length are scanned whole.
    """  # noqa: D205
    text = F.col("text")
    source = docs.select(
        F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
        row_key(*repo_cols).alias("repo"), row_key(*owner_cols).alias("owner"), row_key(id_col, text_col, *repo_cols, *owner_cols).alias("row"),
    )
    assign, access, hexes = _base(text)
    distinct = lambda v: F.size(F.array_distinct(F.split(v, "")))
    opaque = _spans(F.filter(located(text, OPAQUE), lambda x: distinct(x["value"]) >= rules.min_distinct), 3, lambda v: v)
    found = source.select("id", "row", "repo", "owner", assign.alias("a"), access.alias("b"), hexes.alias("c"), opaque.alias("d"))
    base = F.concat("a", "b", "c")
    apart = F.filter("d", lambda x: ~F.exists("base", lambda y: (x["begin"] < y["end"]) & (y["begin"] < x["end"])))
    found = found.select(
        "id", "row", "repo", "owner", *(F.size(c).cast("long").alias(f"n_{k}") for c, k in zip("abc", KINDS)), base.alias("base"), "d"
    ).withColumn("extra", apart).drop("d")
    found = materialise(found, "secret-spans")

    held = found.where((F.size("base") > 0) | (F.size("extra") > 0)).dropDuplicates(["row"])
    spans = held.select("row", "repo", "owner", F.explode(F.concat("base", "extra")).alias("span"))
    owners = spans.select(F.col("span.digest").alias("digest"), "owner", "repo").distinct()
    owners = owners.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"))
    owners = owners.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    rated = spans.withColumn("digest", F.col("span.digest")).join(owners, "digest")
    live = (F.col("n_owners") <= rules.live_owners) & (F.col("n_repos") <= rules.live_repos)
    added = F.collect_list(F.when(live & (F.col("span.rank") == 3), F.col("span")))
    rated = rated.groupBy("row").agg(
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"), F.max("n_repos").alias("most_repos"), added.alias("added")
    )
    return found.join(rated, "row", "left").select(
        "id", "n_assign", "n_access", "n_hex", _listed(F.col("base")).alias("base_spans"),
        _listed(F.concat("base", F.coalesce("added", F.array().cast(_SPAN)))).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "most_repos")),
    )
