"""From pages to a frozen data set: extraction, cleaning, two-key deduplication, splits by time, samples."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import canonical_list, currency, fold_lines, prose_key, seniority, strip, texts, work_mode
from ..tables import materialise
from .similar import most_similar

_OFFER = """
    id STRING,
    attributes STRUCT<title: STRUCT<value: STRING>, employment: STRUCT<
        positionLevelIds: ARRAY<STRING>, detailedWorkModes: ARRAY<STRUCT<code: STRING>>,
        typesOfContracts: ARRAY<STRUCT<name: STRING, salary: STRUCT<
            `from`: DOUBLE, `to`: DOUBLE, currencyCode: STRING, kindCode: STRING, timeUnit: STRUCT<longForm: STRING>>>>>>,
    technologies STRUCT<expected: ARRAY<STRUCT<name: STRING>>, optional: ARRAY<STRUCT<name: STRING>>>,
    publicationDetails STRUCT<dateOfInitialPublicationUtc: STRING>,
    jsonSections ARRAY<STRUCT<title: STRING, model: STRUCT<paragraphs: ARRAY<STRING>, bullets: ARRAY<STRING>>>>
"""


def embedded_json(html: Column) -> Column:
    """The JSON text of the page's data script; empty where there is none."""
    return F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


def build_prose(sections: Column) -> Column:
    """Sections as ``## title`` and lines, without those that give the technologies away; a section of no lines is left out."""

    def lines(model: Column) -> Column:
        bullets = F.transform(F.filter(texts(model["bullets"]), lambda b: strip(b) != ""), lambda b: F.concat(F.lit("- "), b))
        return F.concat(F.filter(texts(model["paragraphs"]), lambda p: strip(p) != ""), bullets)

    title = lambda s: F.coalesce(s["title"], F.lit(""))
    fair = F.filter(sections, lambda s: ~F.lower(strip(title(s))).isin(*vocab.LEAKY_TITLES) & (F.size(lines(s["model"])) > 0))
    made = F.transform(fair, lambda s: F.concat(F.lit("## "), title(s), F.lit("\n"), F.array_join(lines(s["model"]), "\n")))
    return strip(F.coalesce(F.array_join(made, "\n\n"), F.lit("")))


def build_salary(contracts: Column) -> Column:
    """From the first contract with a salary that has a lower bound."""
    first = F.try_element_at(F.filter(contracts, lambda c: c["salary"]["from"].isNotNull()), F.lit(1))["salary"]
    kinds = F.create_map(*(F.lit(v) for pair in vocab.CONTRACT_KIND.items() for v in pair))
    period = F.when(F.startswith(F.lower(F.coalesce(first["timeUnit"]["longForm"], F.lit(""))), F.lit("godzin")), "hour").otherwise("month")
    made = F.struct(
        F.try_element_at(kinds, first["kindCode"]).alias("kind"), currency(first["currencyCode"]).alias("currency"),
        first["from"].alias("amount_from"), first["to"].alias("amount_to"), period.alias("period"),
    )
    return F.when(first.isNotNull(), made.cast(vocab.SALARY))


#: What can become of a page, in the order of a report.
PAGE_REASONS = ("fetch_failed", "unusable_page", "usable")


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(offer_id, url, pub_date, prose, gold)`` of the pages that hold an offer with prose; technologies are as written,
    lower-cased (``normalise_lists`` makes them canonical)."""  # noqa: D205
    return judged_pages(pages, html).where("reason = 'usable'").drop("reason")


def judged_pages(pages: DataFrame, html: str = "html", seen: Observation | None = None) -> DataFrame:
    """``parse_pages`` of every page, with the ``reason`` of ``PAGE_REASONS`` that says what became of it.

    ``seen`` counts the reasons while the rows are read for whatever they are read for, in the same pass.
    """
    wrapped = f"STRUCT<props: STRUCT<pageProps: STRUCT<offer: STRUCT<{_OFFER}>>>>"
    offer = F.from_json(embedded_json(F.col(html)), wrapped)["props"]["pageProps"]["offer"]
    rows = pages.withColumn("__offer", offer)
    o, job = F.col("__offer"), F.col("__offer.attributes.employment")
    names = lambda x: F.array_distinct(F.filter(F.transform(texts(x["name"]), lambda v: F.lower(strip(v))), lambda v: v != ""))
    gold = F.struct(
        o["attributes"]["title"]["value"].alias("title"),
        canonical_list(job["positionLevelIds"], seniority, vocab.SENIORITY_LEVELS).alias("seniority"),
        canonical_list(job["detailedWorkModes"]["code"], work_mode, vocab.WORK_MODES).alias("work_mode"),
        names(o["technologies"]["expected"]).alias("tech_expected"), names(o["technologies"]["optional"]).alias("tech_optional"),
        F.filter(F.transform(texts(job["typesOfContracts"]["name"]), lambda v: F.lower(strip(v))), lambda v: v != "").alias("contract_types"),
        build_salary(job["typesOfContracts"]).alias("salary"),
    )
    out = rows.select(
        o["id"].alias("offer_id"), (F.col("url") if "url" in pages.columns else F.lit("")).alias("url"),
        o["publicationDetails"]["dateOfInitialPublicationUtc"].alias("pub_date"), build_prose(o["jsonSections"]).alias("prose"), gold.alias("gold"),
        F.col(html).isNull().alias("__missing"),
    )
    good = (F.coalesce("offer_id", F.lit("")) != "") & (F.col("prose") != "")
    out = out.withColumn("reason", F.when(F.col("__missing"), PAGE_REASONS[0]).when(good, PAGE_REASONS[2]).otherwise(PAGE_REASONS[1])).drop("__missing")
    return out if seen is None else out.observe(seen, *_reason_counts())


def _reason_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("requested"), *(F.count_if(F.col("reason") == r).alias(r) for r in PAGE_REASONS)]


def has_signal(gold: Column) -> Column:
    lists = [F.size(texts(gold[f])) > 0 for f in vocab.SET_FIELDS]
    some = F.coalesce(gold["title"], F.lit("")) != ""
    for x in (*lists, gold["salary"].isNotNull()):
        some = some | x
    return some


def usable(examples: DataFrame, min_prose_chars: int) -> DataFrame:
    """Adds ``passed``: long enough after folding line separators, dated, and with some label."""
    rows = examples.withColumn("prose", fold_lines(F.coalesce("prose", F.lit(""))))
    return rows.withColumn("passed", (F.length("prose") >= min_prose_chars) & (F.coalesce("pub_date", F.lit("")) != "") & F.coalesce(has_signal(F.col("gold")), F.lit(False)))


def dedupe(rows: DataFrame, keys: tuple[str, str], pos: str = "pos") -> DataFrame:
    """First come, first kept on two keys: a row goes if a kept row before it has its first or its second key."""
    return rows.join(first_kept(rows, keys, pos), pos, "left_semi")


def first_kept(rows: DataFrame, keys: tuple[str, str], pos: str = "pos") -> DataFrame:
    """``pos`` of the rows that ``dedupe`` keeps. The keys are worked out once and written; only they are compared.

    Dropped rows do not mark their keys. Rows whose keys no other row has are settled at once. Of the others, in each round
    those that come first under both their keys are kept, and all that share a key with them go; what is left is decided in
    the next. Least positions are combined on the map side, so a key of very many rows costs no more than any. The number of
    rounds is the length of the longest chain of rows that alternate keys. Null keys are equal.
    """

    def compared(frame: DataFrame) -> DataFrame:
        for k in keys:
            least = frame.groupBy(F.col(k).alias("__k")).agg(F.min(pos).alias(f"__first_{k}"), F.count(F.lit(1)).alias(f"__n_{k}"))
            frame = frame.join(least, F.col(k).eqNullSafe(F.col("__k"))).drop("__k")
        return materialise(frame, "dedupe")

    a, b = keys
    marked = compared(materialise(rows.select(pos, *keys), "dedupe-keys"))
    kept = marked.where((F.col(f"__n_{a}") == 1) & (F.col(f"__n_{b}") == 1)).select(pos)
    marked = marked.where((F.col(f"__n_{a}") > 1) | (F.col(f"__n_{b}") > 1))
    first = (F.col(f"__first_{a}") == F.col(pos)) & (F.col(f"__first_{b}") == F.col(pos))
    while not marked.isEmpty():
        now = marked.where(first).select(pos, *keys)
        kept, left = kept.unionByName(now.select(pos)), marked.select(pos, *keys)
        for k in keys:
            left = left.join(now.select(F.col(k).alias("__k")).distinct(), F.col(k).eqNullSafe(F.col("__k")), "left_anti")
        marked = compared(left)
    return kept


def build_dataset(examples: DataFrame, min_prose_chars: int) -> tuple[DataFrame, DataFrame]:
    """Records, and one row of counts: collected, passed, dropped by the filter, dropped as duplicates, records."""
    marked = usable(examples, min_prose_chars)
    passed = marked.where("passed")
    kept = first_kept(passed.withColumn("prose_key", prose_key(F.col("prose"))), ("offer_id", "prose_key"))
    records = passed.join(kept, "pos", "left_semi")
    stats = marked.agg(F.count(F.lit(1)).alias("collected"), F.count_if("passed").alias("passed")).crossJoin(kept.agg(F.count(F.lit(1)).alias("records")))
    stats = stats.select("collected", "passed", (F.col("collected") - F.col("passed")).alias("dropped"), (F.col("passed") - F.col("records")).alias("duplicates"), "records")
    return records.drop("passed"), stats


def collection_stats(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row of counts by what became of a page, and a line that says so, in one pass over the pages."""
    counts = judged_pages(pages.withColumn("url", F.lit("")), html).agg(*_reason_counts())
    line = F.format_string("requested %d: fetch_failed %d, unusable_page %d, usable %d", "requested", *PAGE_REASONS)
    return counts.select("requested", *PAGE_REASONS, line.alias("line"))


def fetched_pages(urls: DataFrame, fetcher: Callable[[], Callable[[str], str]], delay: float = 0.0, url: str = "url", html: str = "html") -> DataFrame:
    """``urls`` with ``html`` and ``error``. ``fetcher()`` is called once in each task and gives a function of an address.

    What it raises for one address is that row's ``error`` and no html; the others go on. A task asks one address at a time
    and waits ``delay`` seconds between two, so the number of partitions says how many are asked at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, first = fetcher(), True
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                if delay and not first:
                    time.sleep(delay)
                first, page, error = False, None, None
                try:
                    page = fetch(one.column(b.schema.get_field_index(url))[0].as_py())
                except Exception as e:  # noqa: BLE001  whatever a page does must not end the others
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([page], pa.string()), pa.array([error], pa.string())], names=[*b.schema.names, html, "error"])

    kept = urls.select(*(F.col(f"`{c}`") for c in urls.columns if c not in (html, "error")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, `{html}` string, error string")


def newest(rows: DataFrame, order: Column, wanted: Callable[[int], int]) -> Column:
    """Whether a row is among the ``wanted(number of rows)`` largest by ``order``, a struct that no two rows share.

    Only ``order`` is put in order, in ranges over all tasks; counts of the ranges tell how many rows there are, so that they
    are not worked out once more to be counted, and where the n-th lies, and it alone comes to the driver.
    """
    keys = rows.select(order.alias("o")).repartitionByRange(F.desc("o")).sortWithinPartitions(F.desc("o"))
    keys = materialise(keys.withColumn("at", F.monotonically_increasing_id()), "order")
    sizes = sorted(map(tuple, keys.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1))).collect()))
    n, before = wanted(sum(size for _, size in sizes)), 0
    if n <= 0:
        return F.lit(False)
    for part, size in sizes:
        if before + size >= n:
            break
        before += size
    last = keys.where(F.col("at") == (part << 33) + n - before - 1).select("o.*").first()
    kinds = keys.schema["o"].dataType
    return order >= F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, kinds)))


def _share(fraction: float) -> Callable[[int], int]:
    """Half-even rounded, at least one and not all; none of fewer than two rows."""
    return lambda n: min(max(1, round(n * fraction)), n - 1) if n >= 2 else 0


def temporal_split(records: DataFrame, test_fraction: float, date: str = "pub_date", id_col: str = "offer_id") -> DataFrame:
    """Adds ``split``: the newest rows are ``test``, half-even rounded, at least one and not all; fewer than two rows are all train."""
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    late = newest(records, F.struct(F.col(date).alias("date"), F.col(id_col).alias("id")), _share(test_fraction))
    return records.withColumn("split", F.when(late, "test").otherwise("train"))


def dev_split(records: DataFrame, dev_fraction: float, date: str = "pub_date", pos: str = "pos") -> DataFrame:
    """Adds ``split``: the newest rows are ``dev``; missing dates are oldest, ties keep their order; one row stays in train."""
    late = newest(records, F.struct(F.col(date).alias("date"), F.col(pos).alias("pos")), _share(dev_fraction))
    return records.withColumn("split", F.when(late, "dev").otherwise("train"))


def shots_split(rows: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Adds ``is_shot``: the first ``n`` rows are examples and are not evaluated."""
    head = rows.select(pos).orderBy(pos).limit(n).withColumn("is_shot", F.lit(True))
    return rows.join(head, pos, "left").withColumn("is_shot", F.coalesce("is_shot", F.lit(False)))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """``(order, rank)``: places from 0 in this order, worked out over ranges in all tasks; ties are in no certain order."""
    keys = materialise(rows.select(order).repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("__at", 33)
    sizes = keys.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each task
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", (F.coalesce(before, F.lit(0)) - F.shiftleft(F.col("__part"), 33)).alias("__shift"))
    return keys.join(F.broadcast(sizes), part == F.col("__part")).select(order, (F.col("__at") + F.col("__shift")).alias("rank"))


def spread_sample(rows: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Every step-th row in the order of ``pos``, whatever its values, at most ``n``; all rows if there are no more."""
    total = rows.count()
    if n >= total:
        return rows
    step = max(1, total // max(1, n))
    taken = ranked(rows, pos).where((F.pmod(F.col("rank"), F.lit(step)) == 0) & (F.col("rank") < step * n))
    return rows.join(taken.select(pos), pos, "left_semi")


def select_sample(ids: DataFrame, disagreeing: DataFrame, n: int, seed: str, strategy: str = "stratified", id_col: str = "offer_id") -> DataFrame:
    """``n`` distinct ids by keyed order; ``stratified`` takes half from those that disagree, then fills up from the others
    and, where these run out, from those that disagree again."""  # noqa: D205
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    pool = ids.select(id_col).distinct().withColumn("draw", draw)
    if strategy == "random":
        return pool.orderBy("draw").limit(n).select(id_col)
    if strategy != "stratified":
        raise ValueError(strategy)
    marked = pool.join(disagreeing.select(id_col).distinct().withColumn("d", F.lit(True)), id_col, "left").withColumn("d", F.coalesce("d", F.lit(False)))
    sizes = {r["d"]: r["n"] for r in marked.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    dis, agree = sizes.get(True, 0), sizes.get(False, 0)
    first = min(dis, round(n / 2))
    second = min(agree, n - first)
    first = min(dis, n - second)
    top = lambda flag, k: marked.where(F.col("d") == flag).orderBy("draw").limit(k).select(id_col)
    return top(True, first).union(top(False, second))


def review_queue(sample: DataFrame, records: DataFrame, proposals: DataFrame, flags: DataFrame, id_col: str = "offer_id") -> DataFrame:
    """Sampled records with their proposal (null where there is none), their disagreement flags and an empty label to fill.

    With a ``pos`` in ``sample`` the rows carry it as ``queue_pos`` and are sorted by it. An empty label has empty lists and
    null texts.
    """
    lists = {"title": "string", "salary": vocab.SALARY}
    fields = ("title", *vocab.SET_FIELDS, "contract_types", "salary")
    empty = F.struct(*((F.lit(None).cast(lists[f]) if f in lists else F.array().cast("array<string>")).alias(f) for f in fields))
    order = [F.col("pos").alias("queue_pos")] if "pos" in sample.columns else []
    queue = records.join(sample.select(id_col, *order), id_col).join(proposals.select(id_col, "parsed"), id_col, "left").join(flags, id_col, "left")
    queue = queue.withColumn("human_gold", empty)
    return queue.orderBy("queue_pos") if order else queue


def normalise_terms(terms: DataFrame, aliases: DataFrame, threshold: float = vocab.FUZZY_THRESHOLD, term: str = "term") -> DataFrame:
    """``(term, canonical)`` of the distinct terms: exact alias, else the most similar alias of ``threshold`` or more, else
    the term itself, lower-cased.

    Only terms without an exact alias are compared, with the aliases that share enough bigrams (``similar``). Of equally
    similar aliases the first counts. The distinct terms are written, as the comparison and the result both read them: else
    Spark finds them twice, and the second time strips every term that is not distinct yet.
    """  # noqa: D205
    distinct = materialise(terms.select(F.col(term).alias("term")).distinct(), "terms")
    keyed = distinct.withColumn("key", F.lower(strip(F.coalesce("term", F.lit("")))))
    exact = keyed.join(F.broadcast(aliases), F.col("key") == F.col("alias"), "left")
    near = most_similar(exact.where("alias is null"), aliases, threshold).withColumnRenamed("canonical", "fuzzy")
    return exact.join(near, "key", "left").select("term", F.coalesce("canonical", "fuzzy", "key").alias("canonical"))


#: Renamed terms up to this number are sent to all tasks; beyond it the same join is dealt by term.
BROADCAST_TERMS = 100_000


def normalise_lists(rows: DataFrame, fields: Sequence[str], aliases: DataFrame, id_col: str = "offer_id", distinct: bool = True) -> DataFrame:
    """``rows`` with the terms of their list columns made canonical, in order, blank ones left out.

    The different terms of all lists are named once; each row then finds its own in a map of the terms that it has and that
    get another name; the others stay as they are. Rows that share an id, or have none, keep their own lists. Spark guesses
    the terms of all rows from the size of a compressed file and would broadcast them; only the names may be sent to all
    tasks, and only while they are few.
    """
    numbered = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "term-lists")
    whole = F.concat(*(texts(F.col(f)) for f in fields))
    named = materialise(normalise_terms(numbered.select(F.explode(whole).alias("term")), aliases).where("canonical <> term"), "term-names")
    few = named.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    places = numbered.select("__row", F.explode(F.array_distinct(whole)).alias("term")).join(F.broadcast(named) if few else named.hint("merge"), "term")
    maps = places.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("term", "canonical"))).alias("__names"))
    out = numbered.join(maps.hint("merge"), "__row", "left")
    for f in fields:
        made = F.filter(F.transform(texts(F.col(f)), lambda t: F.coalesce(F.try_element_at(F.col("__names"), t), t)), lambda v: v != "")
        out = out.withColumn(f, F.array_distinct(made) if distinct else made)
    return out.drop("__row", "__names")
