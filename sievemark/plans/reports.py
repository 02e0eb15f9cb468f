"""Queries of reports, label sources, guards and training examples over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import agreement, bootstrap, ceiling, curate, parsing, runs, scoring, training
from ..operators.percentiles import exact_percentiles
from ..operators.similar import similar
from ..sources import records
from ..sources.versions import freeze, read_frozen
from ..streaming.resume import answer_stream, resume_run
from ..tables import materialise, scratch_folder
from .queries import _IS_TEST, _RANKED, _SQL_EXAMPLES, TERMS, _examples, _gold, _legs, _table


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    offer = F.format_string(
        '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"offer":{"id":"%d","jsonSections":[{"title":"T","model":{"paragraphs":["p"]}}]}}}}</script>', "page_id"
    )
    html = F.when(F.pmod("page_id", F.lit(5)) != 0, F.concat(F.coalesce("html", F.lit("")), F.when(F.pmod("page_id", F.lit(2)) == 0, offer).otherwise("")))
    return curate.collection_stats(_table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three variants: a answers all, b repeats a fifth and misses a third, c answers only records without gold."""
    docs = _table(spark, sf_dir, "documents")
    salary = F.struct(F.lit("b2b").alias("kind"), F.lit("PLN").alias("currency"), F.lit(1.0).alias("amount_from"), F.lit(2.0).alias("amount_to"), F.lit("month").alias("period"))
    gold = _gold(seniority=F.array("lang"), title=F.col("source"), salary=F.when(F.pmod("doc_id", F.lit(3)) == 1, salary))
    own = _gold(seniority=F.array(F.when(F.pmod("doc_id", F.lit(4)) == 0, "x").otherwise(F.col("lang"))), title=F.when(F.pmod("doc_id", F.lit(2)) == 0, F.upper("source")))
    preds = docs.select("doc_id", own.alias("parsed"), (F.pmod("doc_id", F.lit(7)) != 0).alias("valid"))
    named = lambda rows, v, shift=0: rows.select(F.lit(v).alias("variant"), (F.col("doc_id") + shift).alias("offer_id"), "valid", "parsed", F.lit(100).alias("input_tokens"), F.lit(20).alias("output_tokens"), F.lit(0.5).alias("latency_s"))
    b = preds.where("doc_id % 3 <> 0")
    runs = named(preds, "a").unionByName(named(b, "b")).unionByName(named(b.where("doc_id % 5 = 0"), "b")).unionByName(named(b, "c", 10**12))
    return runs, docs.select(F.col("doc_id").alias("offer_id"), gold.alias("gold"))


def variant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.report(*_runs(spark, sf_dir), 1.0, 5.0)
    return out.select("variant", "n", "n_gold", "coverage", "n_duplicate_rows", "json_validity", "title_support", "title_exact", "headline_f1", "salary_support", "cost_per_1k", "trustworthy")


def report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, gold = _runs(spark, sf_dir)
    return scoring.report_metadata(scoring.report(runs, gold), gold)


def pairwise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label sources that differ in every field."""
    rows, k = _legs(spark, sf_dir), F.col("offer_id")
    mode = lambda c: F.array(F.when(F.col(c) == "senior", "remote").otherwise("office"))
    pay = lambda there, code, low: F.when(there, F.struct(F.lit("b2b").alias("kind"), code.alias("currency"), F.lit(low).alias("amount_from"), F.lit(200.0).alias("amount_to"), F.lit("month").alias("period")))

    def label(c: str, other: str, optional: Column, salary: Column) -> Column:
        title = F.when(F.pmod(k, F.lit(5)) != 0, F.col(c))
        return _gold(seniority=F.array(c), title=title, work_mode=mode(other), tech_expected=F.array(F.col(c), F.concat(F.lit("p "), "p")), tech_optional=optional, salary=salary)

    none = F.array().cast("array<string>")
    own = label("l", "p", F.array("l"), pay(F.pmod(k, F.lit(3)) != 0, F.lit("PLN"), 100.0))
    other = label("h", "h", none, pay(F.pmod(k, F.lit(2)) == 0, F.when(F.pmod(k, F.lit(5)) == 0, "EUR").otherwise("PLN"), 103.0))
    a = rows.select("offer_id", (F.pmod(k, F.lit(7)) != 0).alias("valid"), own.alias("label"))
    return agreement.pairwise(a, rows.select("offer_id", other.alias("label"))).withColumn("value", F.round("value", 4))


def pick_winner_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose sums are equal: the lower latency wins, then the place."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", F.lit("/"), (F.col("l_linenumber") % 3).cast("string")).alias("variant"))
    report = lines.agg(F.round(F.avg("l_discount"), 1).alias("headline_f1"), F.lit(1.0).alias("json_validity"), F.round(F.avg("l_quantity"), -1).alias("latency_p50"))
    return scoring.pick_winner(report.withColumn("pos", F.reverse("variant"))).select("variant", "headline_f1", "latency_p50")


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested and flat rows; technologies written in several ways."""
    docs = _table(spark, sf_dir, "documents")
    terms = F.array(F.lit("Teh"), F.lit(" the "), F.lit(""), F.lit("zzzz"), F.col("lang"))
    nested = F.when(F.pmod("doc_id", F.lit(2)) == 0, _gold(tech_expected=terms, seniority=F.array(F.lit("mid")), title=F.col("source")))
    flat = {"tech_expected": F.reverse(terms), "seniority": F.array(F.lit("lead")), "title": F.col("lang"), "tech_optional": terms, "work_mode": F.array(F.lit("remote")), "contract_types": F.array().cast("array<string>"), "salary": F.lit(None).cast(vocab.SALARY)}
    rows = docs.select(F.col("doc_id").alias("offer_id"), nested.alias("human_gold"), *(c.alias(n) for n, c in flat.items()))
    out = agreement.human_leg(agreement.checked_human_gold(rows), records.aliases(spark, TERMS))
    return out.select(F.col("offer_id").alias("doc_id"), "label.title", *(F.array_join(f"label.{f}", ",").alias(f) for f in vocab.SET_FIELDS))


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.when(F.pmod("doc_id", F.lit(4)) != 0, F.pmod("doc_id", F.lit(4)) != 1)
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("offer_id"), valid.alias("valid"), F.when(valid, _gold(title=F.col("source"), seniority=F.array("lang"))).alias("parsed"))
    return agreement.llm_leg(rows).select(F.col("offer_id").alias("doc_id"), "valid", "label.title", F.array_join("label.seniority", ",").alias("seniority"))


def bootstrap_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    f1, v = F.round(F.avg("l_quantity") / 50, 4), F.round(F.avg("l_discount") * 10, 4)
    metrics = lines.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_suppkey").alias("b")).agg(f1.alias("headline_f1"), v.alias("validity"))
    points = lines.groupBy(F.col("l_returnflag").alias("variant")).agg(f1.alias("headline_f1"), v.alias("validity"))
    points = points.withColumn("pos", F.col("variant")).withColumn("coverage", F.when(F.col("variant") == "N", 0.9).otherwise(1.0))
    return bootstrap.separation(metrics, points)


def frozen_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _examples(spark, sf_dir)
    both = records.frozen_records(rows.where("pos % 5 <> 0"), rows.where("pos % 5 = 0"))
    flat = records.flat_gold(both, ("title", "seniority"))
    return both.select("part", "pos", "offer_id").join(flat, "offer_id").select("part", "pos", "title", F.size("seniority").cast("long").alias("n_seniority"))


def term_ceiling_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every benchmark item is a spelling; a document's labels are the words of the item whose turn it is."""
    items = _table(spark, sf_dir, "benchmark")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))
    place = F.row_number().over(Window.orderBy("item_id")) - 1  # the short table of items
    items = items.select(words.alias("words"), place.alias("place"))
    n = items.count()
    names = items.select(F.explode("words").alias("canonical")).distinct().select(F.col("canonical").alias("alias"), "canonical")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("offer_id"), F.col("text").alias("prose"))
    docs = docs.join(F.broadcast(items), F.pmod("offer_id", F.lit(n)) == F.col("place"))
    odd = F.filter("words", lambda w: F.length(w) % 2 == 1)
    return ceiling.ceilings(docs.select("offer_id", "prose", _gold(tech_expected=F.col("words"), tech_optional=odd).alias("gold")), names)


def similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all conversations that are similar to long words of the benchmark: the best one, and how many there are."""
    words = lambda name: _table(spark, sf_dir, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    names = words("benchmark").where(F.length("w") >= 7).select(F.col("w").alias("alias"), F.row_number().over(Window.orderBy("w")).alias("ord"))  # the short table of items
    keys = words("conversations").select(F.col("w").alias("key")).join(names, F.col("key") == F.col("alias"), "left_anti")
    pairs = similar(keys, names).join(names, "alias")
    return pairs.groupBy("key").agg(F.max_by("alias", F.struct(F.col("ratio"), -F.col("ord"))).alias("alias"), F.round(F.max("ratio"), 4).alias("ratio"), F.count(F.lit(1)).alias("n"))


SKILLS = {"kubernetes": ["k8s"], "postgresql": ["postgres"], "typescript": None, "javascript": ["js"]}


def parse_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with misspelt technologies, repeated keys and NaN."""
    event, k = F.col("event_type"), F.pmod("event_id", F.lit(4))
    answer = (
        F.when(k == 0, F.concat(F.lit('{"tech_expected": ["Kubernets", "k8s", "kubernetess"], "tech_optional": ["cobol", " ", "'), event, F.lit('"]}')))
        .when(k == 1, F.concat(F.lit('{"title": "a", "title": "'), event, F.lit('", "tech_expected": ["typescripts", "javscript"]}')))
        .when(k == 2, F.lit('{"salary": {"amount_from": NaN}, "tech_optional": ["POSTGRESQL ", "postgre"]}'))
        .otherwise(F.lit('{"tech_optional": ["k9s", 7, null]} and more'))
    )
    rows = _table(spark, sf_dir, "events").select("event_id", answer.alias("raw"))
    out = parsing.parse_results(rows, aliases=records.aliases(spark, SKILLS))
    lists = (F.array_join(f"parsed.{f}", ",").alias(f) for f in ("tech_expected", "tech_optional"))
    return out.select("event_id", "valid", "parsed.title", *lists, F.isnan("parsed.salary.amount_from").alias("is_nan"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the rows are one group; no group is held by one task."""
    group = F.when(F.pmod("l_orderkey", F.lit(10)) != 0, "hot").otherwise(F.col("l_returnflag"))
    rows = _table(spark, sf_dir, "lineitem").select(group.alias("variant"), ((F.col("l_discount") - 0.05) * F.col("l_extendedprice")).alias("latency_s"))
    out = exact_percentiles(rows, "latency_s", {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999}, ("variant",), small=0)
    return out.select("variant", "n", *(F.round(c, 6).alias(c) for c in ("p01", "p50", "p95", "p999")))


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in order, which is what a trial run is for, under a cap that they keep to."""
    rows = records.head_limit(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey")
    return records.hard_cap(rows, 25)


def sft_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by a template of an id for each word."""

    def template() -> training.Template:
        return lambda asked, _: [len(w) for m in asked for w in m["content"].split(" ") if w]

    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("offer_id"), F.coalesce("text", F.lit("")).alias("prose"), _gold(title=F.col("source")).alias("gold"))
    made = training.sft_examples(rows, "s", "i", "ok").withColumn("completion", F.lit("one two three"))
    return training.length_profile(training.encoded(made, template, 10**9).select(F.size("input_ids").alias("length")))


def sft_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples under a limit, by a template of an id for each character and a mark before each turn."""

    def template() -> training.Template:
        return lambda asked, answer: [x for m in asked for x in (0, *map(ord, m["content"]))] + [0] * answer

    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("offer_id"), F.coalesce("text", F.lit("")).alias("prose"), _gold(title=F.col("source"), seniority=F.array(F.lit("mid"))).alias("gold"))
    made = training.sft_examples(rows, "system", "instruction", "ok").withColumn("completion", F.concat(F.lit("{"), F.col("offer_id").cast("string"), F.lit("}")))
    out = training.encoded(made, template, 3000)
    learnt = F.concat_ws(",", F.filter("labels", lambda x: x != training.MASKED).cast("array<string>"))
    return out.select(F.col("offer_id").alias("doc_id"), F.size("input_ids").cast("long").alias("n_ids"), "prompt_length", "cut_chars", learnt.alias("learnt"), F.size("attention_mask").cast("long").alias("n_mask"))


def sft_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("offer_id"), F.col("text").alias("prose"), _gold(title=F.col("source"), seniority=F.array(F.lit("mid"))).alias("gold"))
    made = training.sft_examples(rows, "s", "i", "ok")
    return made.select(F.col("offer_id").alias("doc_id"), F.size("prompt_messages").cast("long").alias("n_messages"), F.md5(F.element_at("prompt_messages", -1)["content"].cast("binary")).alias("asked_md5"), F.get_json_object("completion", "$.seniority[0]").alias("seniority"))


def longest_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    most = training.longest_prompt(turns, F.size(F.split("text", " ")), 10**6, 1000, 10)
    return spark.range(1).select(F.lit(most).cast("long").alias("longest"))


def probe_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = spark.createDataFrame([("zero",), ("few",)], "mode string")
    return training.probe_grid(_table(spark, sf_dir, "nation").select("n_name"), modes)


def model_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns are the prompts of a model that gives them back as a title, or does not answer with an object."""

    def answerer() -> runs.Answer:
        return lambda text: (json.dumps({"title": text}) if len(text) % 2 else "none", len(text), 3)

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    out = runs.run(turns, answerer, 64)
    return out.select("conv_id", "turn", "input_tokens", "output_tokens", "max_tokens", "valid", "failure", F.md5(F.col("parsed.title").cast("binary")).alias("title_md5"))


def resume_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders come as a stream; a third of them is in the sink from an earlier run and is not answered again."""
    folder = scratch_folder(spark, "resume")
    orders, schema = _table(spark, sf_dir, "orders"), "id long, answer string"
    records.write_jsonl(orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("answer")), f"{folder}/sink")
    # a pattern, because a stream takes a plain path for a folder, and the table may be one file
    wanted = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("answer"))
    answer_stream(wanted, lambda rows: rows, f"{folder}/sink", "id", schema, f"{folder}/state").awaitTermination()
    return records.read_strict(spark, f"{folder}/sink", schema)


def resume_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three starts: a part under one cap, all under another, which supersedes it, and again, with nothing left to answer."""
    root, orders, schema = scratch_folder(spark, "restarts"), _table(spark, sf_dir, "orders"), "id long, answer string"
    source = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]")
    wanted = source.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("answer"))
    for cap, rows in ((512, wanted.where("id % 3 = 0")), (1024, wanted), (1024, wanted)):
        run = resume_run(spark, root, "id", schema, cap)
        run.stream(rows, lambda new: new).awaitTermination()
    done = run.finish(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos")))
    superseded = F.lit(run.info["superseded"]["suffix"]).alias("superseded")
    return records.read_strict(spark, done, f"{schema}, max_tokens long").select("id", "answer", "max_tokens", superseded)


def frozen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split data set, frozen as one version and read back, held against what was committed."""
    # the records are written before the split, which reads only their dates and ids to find its place
    kept = materialise(curate.build_dataset(_examples(spark, sf_dir), 400)[0], "kept")
    split = curate.temporal_split(kept, 0.2)
    root = scratch_folder(spark, "frozen")
    freeze({name: split.where(F.col("split") == name).drop("split") for name in ("train", "test")}, root, {"test_fraction": 0.2})
    parts = [read_frozen(spark, root, name).select("offer_id", F.lit(name).alias("split"), F.md5(F.col("prose").cast("binary")).alias("prose_md5")) for name in ("train", "test")]
    return parts[0].unionByName(parts[1]).withColumnRenamed("offer_id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        collection_stats, variant_report, report_metadata, pairwise_report, human_labels, model_labels, bootstrap_separation, frozen_gold, trial_rows,
        sft_profile, sft_encoding, sft_completions, longest_prompt, probe_grid, model_run, resume_stream, latency_percentiles, term_ceiling_words, similar_terms, parse_technologies, resume_restarts, frozen_split, pick_winner_tied,
    )
}

_REPORT = """
    runs AS (
        SELECT 'a' AS variant, doc_id FROM documents UNION ALL SELECT 'b', doc_id FROM documents WHERE doc_id % 3 <> 0
        UNION ALL SELECT 'b', doc_id FROM documents WHERE doc_id % 15 IN (5, 10)
    ), r AS (
        SELECT variant, doc_id, doc_id % 7 <> 0 AS valid, source, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE lang END AS p, lang AS g FROM runs JOIN documents USING (doc_id)
    ), s AS (
        SELECT variant, count(*) AS n, count(DISTINCT doc_id) AS ids, avg(valid::INT) AS v, count(*) FILTER (source <> '') AS ts,
               count(*) FILTER (source <> '' AND valid AND doc_id % 2 = 0) AS te, sum((valid AND p = g)::INT) AS tp, sum((valid AND p <> g)::INT) AS fp,
               sum((NOT (valid AND p = g))::INT) AS fn, count(*) FILTER (doc_id % 3 = 1) AS ss FROM r GROUP BY variant
    ), total AS (SELECT count(*) AS n_gold, count(*) FILTER (doc_id % 3 = 1) AS salaries FROM documents)
"""

ORACLES = {
    "collection_stats": """
        SELECT count(*) AS requested, count(*) FILTER (page_id % 5 = 0) AS fetch_failed, count(*) FILTER (page_id % 5 <> 0 AND page_id % 2 <> 0) AS unusable_page,
               count(*) FILTER (page_id % 5 <> 0 AND page_id % 2 = 0) AS usable,
               concat('requested ', count(*), ': fetch_failed ', count(*) FILTER (page_id % 5 = 0), ', unusable_page ',
                      count(*) FILTER (page_id % 5 <> 0 AND page_id % 2 <> 0), ', usable ', count(*) FILTER (page_id % 5 <> 0 AND page_id % 2 = 0)) AS line
        FROM pages
    """,
    "variant_report": f"""
        WITH {_REPORT}
        SELECT variant, n, n_gold, round(ids / n_gold, 4) AS coverage, n - ids AS n_duplicate_rows, round(v, 4) AS json_validity, ts AS title_support,
               round(te / ts, 4) AS title_exact, round(round(2 * tp / (2 * tp + fp + fn), 4), 4) AS headline_f1, ss AS salary_support, 0.2::DOUBLE AS cost_per_1k,
               ids = n_gold AND n = ids AS trustworthy FROM s, total
        UNION ALL SELECT 'c', 0, n_gold, 0, 0, 0, 0, NULL, NULL, 0, 0.2, false FROM total
    """,
    "report_metadata": "SELECT count(*) AS n_gold, count(*) FILTER (doc_id % 3 = 1) AS salary_support, 'b,c' AS incomplete, 'b' AS duplicated FROM documents",
    "pairwise_report": """
        WITH legs AS (
            SELECT doc_id AS k, doc_id % 7 <> 0 AS valid, CASE WHEN quality = 1 THEN 'senior' ELSE 'junior' END AS h, CASE WHEN n_chars >= 800 THEN 'senior' ELSE 'junior' END AS l,
                   CASE WHEN doc_id % 3 = 0 THEN 'senior' ELSE 'junior' END AS p, doc_id % 3 <> 0 AS sa, doc_id % 2 = 0 AS sb, doc_id % 5 <> 0 AS named
            FROM labels JOIN documents USING (doc_id)
        ), s AS (
            SELECT count(*) AS n, avg(valid::INT) AS v, avg((h = l)::INT) AS po, sum((valid AND h = l)::INT) AS tp, sum((valid AND h <> l)::INT) AS fp,
                   sum((NOT (valid AND h = l))::INT) AS fn, avg((h = 'senior')::INT) AS hs, avg((l = 'senior')::INT) AS ls, avg((p = 'senior')::INT) AS ps,
                   avg((h = p)::INT) AS wo, sum((valid AND h = p)::INT) AS wtp, sum((valid AND h <> p)::INT) AS wfp,
                   sum(valid::INT * (1 + (h = l)::INT)) AS etp, sum((valid AND h <> l)::INT) AS efp, avg((NOT named OR h = l)::INT) AS same_title,
                   count(*) FILTER (named) AS titles, count(*) FILTER (named AND valid AND h = l) AS right_titles,
                   count(*) FILTER (sb) AS support, avg((valid AND sa = sb)::INT) AS detection, count(*) FILTER (valid AND sa AND sb) AS both_paid, count(*) FILTER (valid AND sa AND sb AND named) AS same_code
            FROM legs
        ), k AS (SELECT *, hs * ls + (1 - hs) * (1 - ls) AS pe, hs * ps + (1 - hs) * (1 - ps) AS wpe FROM s)
        SELECT f.field, f.metric, round(f.value::DOUBLE, 4) AS value FROM k, LATERAL (VALUES
            ('all', 'n', n), ('all', 'json_validity', v), ('title', 'exact', right_titles / titles), ('title', 'agreement', same_title),
            ('seniority', 'agreement', po), ('seniority', 'f1', 2 * tp / (2 * tp + fp + fn)), ('seniority', 'exact', tp / n), ('seniority', 'kappa', (po - pe) / (1 - pe)),
            ('work_mode', 'agreement', wo), ('work_mode', 'f1', 2 * wtp / (wtp + wfp + n)), ('work_mode', 'exact', wtp / n), ('work_mode', 'kappa', (wo - wpe) / (1 - wpe)),
            ('tech_expected', 'agreement', po), ('tech_expected', 'f1', 2 * etp / (etp + efp + 2 * n)), ('tech_expected', 'exact', tp / n),
            ('tech_optional', 'agreement', 0), ('tech_optional', 'f1', 0), ('tech_optional', 'exact', NULL),
            ('salary', 'salary_support', support), ('salary', 'detection', detection), ('salary', 'currency', same_code / support), ('salary', 'kind', both_paid / support),
            ('salary', 'amounts', both_paid / support)
        ) f(field, metric, value)
    """,
    "pick_winner_tied": """
        SELECT l_returnflag || '/' || (l_linenumber % 3) AS variant, round(avg(l_discount), 1) AS headline_f1, round(avg(l_quantity), -1) AS latency_p50
        FROM lineitem GROUP BY 1 ORDER BY headline_f1 DESC, latency_p50, reverse(l_returnflag || '/' || (l_linenumber % 3)) LIMIT 1
    """,
    "human_labels": """
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS title, CASE WHEN doc_id % 2 = 0 THEN 'mid' ELSE 'lead' END AS seniority,
               CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'remote' END AS work_mode, CASE WHEN doc_id % 2 = 0 THEN concat('the,the,zzzz,', l) ELSE concat(l, ',zzzz,the,the') END AS tech_expected,
               CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('the,the,zzzz,', l) END AS tech_optional
        FROM (SELECT *, CASE lang WHEN 'en' THEN 'in' WHEN 'de' THEN 'of' ELSE lang END AS l FROM documents)
    """,
    "model_labels": """
        SELECT doc_id, doc_id % 4 > 1 AS valid, CASE WHEN doc_id % 4 > 1 THEN source END AS title, CASE WHEN doc_id % 4 > 1 THEN lang END AS seniority FROM documents
    """,
    "bootstrap_separation": """
        WITH m AS (
            SELECT l_returnflag AS variant, l_suppkey AS b, round(avg(l_quantity) / 50, 4) AS f1, round(avg(l_discount) * 10, 4) AS v FROM lineitem GROUP BY ALL
        ), p AS (
            SELECT l_returnflag AS variant, round(avg(l_quantity) / 50, 4) AS f1, round(avg(l_discount) * 10, 4) AS v FROM lineitem GROUP BY ALL
        ), best AS (SELECT * FROM p ORDER BY f1 DESC, variant LIMIT 1), d AS (
            SELECT m.variant, k.metric, CASE WHEN k.metric = 'validity' THEN m.v - r.v ELSE m.f1 - r.f1 END AS d
            FROM m JOIN m r USING (b), best, (VALUES ('headline_f1'), ('validity')) k(metric) WHERE r.variant = best.variant AND m.variant <> best.variant
        ), o AS (
            SELECT p.variant, k.metric, round(CASE WHEN k.metric = 'validity' THEN p.v - best.v ELSE p.f1 - best.f1 END, 12) AS o, best.variant AS reference
            FROM p, best, (VALUES ('headline_f1'), ('validity')) k(metric)
        ), q AS (
            SELECT variant, metric, round(quantile_cont(d, 0.025), 4) AS low, round(quantile_cont(d, 0.975), 4) AS high, avg((d > 0)::INT) AS above, avg((d < 0)::INT) AS below, avg((d = 0)::INT) AS same
            FROM d GROUP BY ALL
        )
        SELECT reference, variant, metric, round(o, 4) AS observed, low, high, round(CASE WHEN o > 0 THEN above WHEN o < 0 THEN below ELSE same END, 4) AS sign_agreement,
               variant <> 'N' AND reference <> 'N' AS comparable, variant <> 'N' AND reference <> 'N' AND (low > 0 OR high < 0) AS separated FROM q JOIN o USING (variant, metric)
    """,
    "frozen_gold": "SELECT CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS part, doc_id AS pos, CASE WHEN doc_id % 9 <> 0 THEN source END AS title, 0::BIGINT AS n_seniority FROM documents",
    "trial_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25",
    "sft_profile": """
        WITH l AS (SELECT len(list_filter(string_split(concat('Posting:', chr(10), coalesce(text, '')), ' '), lambda w : w <> '')) + 6 AS n FROM documents)
        SELECT count(*) AS n, round(quantile_cont(n, 0.5), 3) AS p50, round(quantile_cont(n, 0.9), 3) AS p90, round(quantile_cont(n, 0.99), 3) AS p99, max(n)::BIGINT AS longest FROM l
    """,
    "sft_encoding": """
        WITH RECURSIVE cut AS (
            SELECT doc_id, length(coalesce(text, '')) + 9 AS l, length(coalesce(text, '')) + 9 AS whole, 24 + length(doc_id::VARCHAR) + 2 AS beside FROM documents
            UNION ALL SELECT doc_id, l - greatest(1, l // 10), whole, beside FROM cut WHERE l + beside > 3000 AND l > 0
        ), last AS (SELECT doc_id, min(l) AS l, whole, beside FROM cut GROUP BY doc_id, whole, beside)
        SELECT doc_id, (l + beside)::BIGINT AS n_ids, (l + 24)::BIGINT AS prompt_length, (whole - l)::BIGINT AS cut_chars,
               concat('123,', array_to_string(list_transform(string_split(doc_id::VARCHAR, ''), lambda c : ascii(c)), ','), ',125') AS learnt, (l + beside)::BIGINT AS n_mask FROM last
    """,
    "sft_completions": "SELECT doc_id, 4::BIGINT AS n_messages, md5(concat('Posting:', chr(10), text)) AS asked_md5, 'mid' AS seniority FROM documents",
    "term_ceiling_words": r"""
        WITH items AS (
            SELECT list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w : w <> '')) AS words, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark
        ), held AS (
            SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+') AS own, words FROM documents JOIN items ON doc_id % (SELECT count(*) FROM items) = place
        ), per AS (
            SELECT f.field, CASE WHEN f.field = 'tech_expected' THEN words ELSE list_filter(words, lambda w : length(w) % 2 = 1) END AS terms, own
            FROM held, (VALUES ('tech_expected'), ('tech_optional')) f(field)
        ), s AS (
            SELECT field, sum(len(terms))::BIGINT AS terms, sum(len(list_intersect(terms, own)))::BIGINT AS present, count(*) AS records,
                   count(*) FILTER (len(list_intersect(terms, own)) = 0) AS unanswerable FROM per WHERE len(terms) > 0 GROUP BY field
        )
        SELECT *, round_even(present / terms, 4) AS share, round_even(unanswerable / records, 4) AS unanswerable_share FROM s
    """,
    # the common subsequence bit by bit: a letter of the key at a time, a bit for each letter of the alias
    "similar_terms": """
        WITH RECURSIVE names AS (
            SELECT w AS alias, row_number() OVER (ORDER BY w) AS ord
            FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 7
        ), keys AS (
            SELECT w AS key FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE w <> '' AND w NOT IN (SELECT alias FROM names)
        ), letters AS (
            SELECT alias, substr(alias, i, 1) AS c, sum(1::HUGEINT << (i - 1)::INT)::HUGEINT AS places
            FROM (SELECT alias, unnest(range(1, length(alias) + 1))::INT AS i FROM names) GROUP BY ALL
        ), walk AS (
            SELECT key, alias, ord, 1 AS i, (1::HUGEINT << length(alias)::INT) - 1 AS v FROM keys, names
            WHERE least(length(key), length(alias)) * 200.0 / (length(key) + length(alias)) >= 88
            UNION ALL
            SELECT key, walk.alias, ord, i + 1, ((v + (v & coalesce(places, 0::HUGEINT))) | (v - (v & coalesce(places, 0::HUGEINT)))) & ((1::HUGEINT << length(walk.alias)::INT) - 1)
            FROM walk LEFT JOIN letters ON letters.alias = walk.alias AND letters.c = substr(key, i, 1) WHERE i <= length(key)
        ), rated AS (
            SELECT key, alias, ord, 200.0::DOUBLE * (length(alias) - bit_count(v)) / (length(key) + length(alias)) AS ratio FROM walk WHERE i = length(key) + 1
        )
        SELECT key, arg_max(alias, ratio * 1e6 - ord) AS alias, round(max(ratio), 4) AS ratio, count(*) AS n FROM rated WHERE ratio >= 88 GROUP BY key
    """,
    "parse_technologies": """
        SELECT event_id, true AS valid, CASE WHEN event_id % 4 = 1 THEN event_type END AS title,
               ['kubernetes,kubernetes,kubernetes', 'typescript,javascript', '', ''][event_id % 4 + 1] AS tech_expected,
               [concat('cobol,', event_type), '', 'postgresql,postgresql', 'k9s'][event_id % 4 + 1] AS tech_optional, event_id % 4 = 2 AS is_nan FROM events
    """,
    "latency_percentiles": """
        WITH v AS (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN 'hot' ELSE l_returnflag END AS variant, (l_discount - 0.05::DOUBLE) * l_extendedprice AS v FROM lineitem)
        SELECT variant, count(*) AS n, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95,
               round(quantile_cont(v, 0.999), 6) AS p999 FROM v GROUP BY variant
    """,
    "longest_prompt": "SELECT max(len(string_split(text, ' ')))::BIGINT AS longest FROM conversations",
    "probe_grid": "SELECT n_name, mode FROM nation, (VALUES ('zero'), ('few')) m(mode)",
    "model_run": """
        SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS input_tokens, 3::BIGINT AS output_tokens, 64::BIGINT AS max_tokens, length(coalesce(text, '')) % 2 = 1 AS valid,
               CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 'no_json_object' END AS failure, CASE WHEN length(text) % 2 = 1 THEN md5(text) END AS title_md5 FROM conversations
    """,
    "resume_restarts": "SELECT o_orderkey AS id, o_orderstatus AS answer, 1024::BIGINT AS max_tokens, '.cap512' AS superseded FROM orders",
    "frozen_split": f"""
        WITH {_SQL_EXAMPLES} SELECT doc_id, CASE WHEN {_IS_TEST} THEN 'test' ELSE 'train' END AS split, md5(text) AS prose_md5 FROM {_RANKED} JOIN kept USING (doc_id)
    """,
    "resume_stream": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE o_orderstatus END AS answer FROM orders",
}
