"""Queries of the curation and measurement operators over the test tables, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import currency, prose_key, seniority, work_mode
from ..operators import agreement, bootstrap, ceiling, curate, parsing, scoring
from ..sources import records

TERMS = {"the": ["teh", "th"], "and": ["und", "et"], "of": ["de", "von"], "in": ["dans", "en"], "que": ["qui"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gold(**fields: Column) -> Column:
    names = ("title", *vocab.SET_FIELDS, "contract_types", "salary")
    lists = F.array().cast("array<string>")
    empty = {"title": F.lit(None).cast("string"), "salary": F.lit(None).cast(vocab.SALARY)}
    return F.struct(*(fields.get(n, empty.get(n, lists)).alias(n) for n in names))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")), "yyyy-MM-dd")
    gold = _gold(title=F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("source")))
    return docs.select(
        F.col("doc_id").alias("pos"), F.col("doc_id").alias("offer_id"), F.when(F.pmod("doc_id", F.lit(11)) != 0, date).alias("pub_date"),
        F.col("text").alias("prose"), gold.alias("gold"),
    )


_SQL_EXAMPLES = """
    examples AS (
        SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS pub_date,
               text, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS k
        FROM documents
    ), passed AS (
        SELECT * FROM examples WHERE length(text) >= 400 AND pub_date IS NOT NULL AND doc_id % 9 <> 0
    ), kept AS (
        SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1
    )
"""


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.build_dataset(_examples(spark, sf_dir), 400)[1]


def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = curate.build_dataset(_examples(spark, sf_dir), 400)[0]
    return kept.select(F.col("offer_id").alias("doc_id"), "pub_date", prose_key(F.col("prose")).alias("prose_key"))


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = curate.build_dataset(_examples(spark, sf_dir), 400)[0]
    return curate.temporal_split(kept, 0.2).select(F.col("offer_id").alias("doc_id"), "split")


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = curate.build_dataset(_examples(spark, sf_dir), 400)[0]
    return records.manifest(curate.temporal_split(kept, 0.2), 400, 0.2)


def dedupe_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.floor(F.col("doc_id") / 3).alias("a"), prose_key(F.col("text")).alias("b"))
    return curate.dedupe(rows, ("a", "b")).select("pos")


def dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.dev_split(_examples(spark, sf_dir), 0.1).select("pos", "split")


def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.spread_sample(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos")), 37)


def shots_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.shots_split(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos")), 5)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "offer_id")
    return curate.select_sample(labels, labels.where("quality = 0"), 60, "seed").select(F.col("offer_id").alias("doc_id"))


def normalise_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("event_id", F.lit(len(values))) + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(
        "event_id", seniority(pick([" Regular", "stażysta", "LEAD ", "guru", ""])).alias("seniority"),
        work_mode(pick(["home-office", "Full-Office", "orbit"])).alias("work_mode"), currency(pick(["zł", "Eur", "chf", ""])).alias("currency"),
    )


def normalise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
    return curate.normalise_terms(words, records.aliases(spark, TERMS))


def _variants(docs: DataFrame) -> DataFrame:
    return docs.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b")))).where("variant = 'a' OR doc_id % 5 <> 0")


def _scored(preds: DataFrame, gold: DataFrame, got: Column, fields: Sequence[str]) -> DataFrame:
    parsed = _gold(tech_expected=F.col("got"), tech_optional=F.col("got"), title=F.when(F.pmod("doc_id", F.lit(3)) == 0, F.upper("source")).otherwise("lang"))
    preds = preds.withColumn("got", got).select("variant", F.col("doc_id").alias("offer_id"), (F.pmod("doc_id", F.lit(7)) != 0).alias("valid"), parsed.alias("parsed"))
    return scoring.matched(preds, gold, fields=fields)


def _predictions(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Sets of all words of the whole text: gold as they are, and without those of three letters; predictions with the words
    of seven letters misspelt (a), or without those of four (b)."""  # noqa: D205
    docs = _table(spark, sf_dir, "documents").withColumn("words", F.filter(F.split("text", " "), lambda w: w != "")).drop("text")
    words = F.col("words")
    some = F.filter(words, lambda w: F.length(w) != 3)
    gold = docs.select(F.col("doc_id").alias("offer_id"), _gold(tech_expected=words, tech_optional=some, title=F.col("source")).alias("gold"))
    misspelt = F.transform(words, lambda w: F.when(F.length(w) == 7, F.concat(w, F.lit("~"))).otherwise(w))
    got = F.when(F.col("variant") == "a", misspelt).otherwise(F.filter(words, lambda w: F.length(w) != 4))
    return _scored(_variants(docs), gold, got, fields)


_SQL_WHOLE = """
    words AS (
        SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda w : w <> '') AS w FROM documents
    ), preds AS (
        SELECT v.variant, doc_id, w,
               CASE WHEN doc_id % 7 = 0 THEN [] WHEN v.variant = 'a' THEN list_transform(w, lambda x : CASE WHEN length(x) = 7 THEN concat(x, '~') ELSE x END)
                    ELSE list_filter(w, lambda x : length(x) <> 4) END AS p
        FROM words, (VALUES ('a'), ('b')) v(variant) WHERE v.variant = 'a' OR doc_id % 5 <> 0
    ), pairs AS (
        SELECT variant, f.field, list_distinct(CASE WHEN f.field = 'tech_expected' THEN w ELSE list_filter(w, lambda x : length(x) <> 3) END) AS g, list_distinct(p) AS p
        FROM preds, (VALUES ('tech_expected'), ('tech_optional')) f(field)
    ), c AS (
        SELECT *, len(list_intersect(p, g)) AS tp, len(p) - len(list_intersect(p, g)) AS fp, len(g) - len(list_intersect(p, g)) AS fn FROM pairs
    ), sums AS (
        SELECT variant, field, count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (len(g) > 0) AS support,
               count(*) FILTER (len(g) > 0 AND fp = 0 AND fn = 0) AS exact_supported FROM c GROUP BY ALL
    ), scored AS (
        SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM sums
    )
"""


def _set_scores(rows: DataFrame) -> DataFrame:
    out = scoring.set_scores(rows, ("tech_expected", "tech_optional"))
    return out.select("variant", "field", "n", "tp", "fp", "fn", "support", "exact_supported", "precision", "recall", "f1", "exact")


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_scores(_predictions(spark, sf_dir, "tech_expected", "tech_optional"))


def headline_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.headline(scoring.set_scores(_predictions(spark, sf_dir, *vocab.HEADLINE_FIELDS), vocab.HEADLINE_FIELDS))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir, "title")
    n = _table(spark, sf_dir, "documents").count()
    return scoring.totals(rows.unionByName(rows.where("offer_id % 50 = 0")), n)


def salary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("o_orderkey", F.lit(7))
    price = F.col("o_totalprice")
    make = lambda kind, code, low, high: F.struct(kind.alias("kind"), code.alias("currency"), low.alias("amount_from"), high.alias("amount_to"), F.lit("month").alias("period"))
    gold = F.when(F.pmod("o_orderkey", F.lit(4)) != 0, make(F.col("o_orderstatus"), F.col("o_orderpriority"), price, price * 2))
    pred = F.when(k != 6, make(F.col("o_orderstatus"), F.when(k == 1, "x").otherwise(F.col("o_orderpriority")), F.when(k == 2, price * 1.2).otherwise(price * 1.04), price * 2))
    rows = _table(spark, sf_dir, "orders").select(
        F.lit("v").alias("variant"), (k != 5).alias("valid"), _gold(salary=pred.cast(vocab.SALARY)).alias("parsed"), _gold(salary=gold.cast(vocab.SALARY)).alias("gold")
    )
    return scoring.salary_scores(rows)


def cost_and_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("variant"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 10).alias("input_tokens"),
        F.col("l_quantity").alias("output_tokens"), (F.col("l_quantity") / 8).alias("latency_s"),
    )
    return scoring.cost_and_latency(rows, 1.0, 5.0)


def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("json_decode_error"), F.lit("schema_invalid"), F.lit("odd"), F.lit(None).cast("string"))
    rows = _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("variant"), (F.pmod("event_id", F.lit(3)) == 0).alias("valid"), F.element_at(kinds, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("failure"),
        F.pmod("user_id", F.lit(100)).alias("output_tokens"), F.when(F.pmod("event_id", F.lit(2)) == 0, 50).cast("long").alias("max_tokens"),
    )
    return scoring.failures(rows, 80)


def _winner(rows: DataFrame, n: int) -> DataFrame:
    report = scoring.totals(rows, n).join(scoring.headline(scoring.set_scores(rows, vocab.HEADLINE_FIELDS)), "variant").withColumns({"latency_p50": F.lit(1.0), "pos": F.col("variant")})
    return scoring.pick_winner(report).select("variant")


def pick_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winner(_predictions(spark, sf_dir, "title", *vocab.HEADLINE_FIELDS), _table(spark, sf_dir, "documents").count())


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    level = lambda x: F.when(x, "senior").otherwise("junior")
    return rows.select(F.col("doc_id").alias("offer_id"), level(F.col("quality") == 1).alias("h"), level(F.col("n_chars") >= 800).alias("l"), level(F.pmod("doc_id", F.lit(3)) == 0).alias("p"))


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.cohen_kappa(_legs(spark, sf_dir), "h", "l")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")))


def _leg(rows: DataFrame, c: str) -> DataFrame:
    return rows.select("offer_id", _gold(seniority=F.array(F.col(c))).alias("label"))


def raw_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _legs(spark, sf_dir)
    return agreement.raw_agreement(agreement.pairs(_leg(rows, "h"), _leg(rows, "l")), ("seniority", "work_mode"))


def triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _legs(spark, sf_dir)
    return agreement.triangulate(_leg(rows, "h"), _leg(rows, "l"), _leg(rows, "p"), ("seniority",))


def disagreeing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _legs(spark, sf_dir)
    return agreement.disagreements(agreement.pairs(_leg(rows, "h"), _leg(rows, "l"))).where("any").select(F.col("offer_id").alias("doc_id"))


def term_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, TERMS))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("offer_id"), F.col("text").alias("prose"), _gold(tech_expected=names, tech_optional=F.slice(names, 1, 2)).alias("gold"))
    return ceiling.ceilings(docs, records.aliases(spark, TERMS))


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir, *vocab.HEADLINE_FIELDS)
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("offer_id"))
    return bootstrap.intervals(bootstrap.resampled(rows, ids, 2000, "seed"))


def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(6))
    good = F.concat(F.lit('Answer: {"title": "'), F.col("event_type"), F.lit('", "seniority": ["Regular", "x"], "salary": {"kind": "b2b", "amount_from": "5"}} done'))
    raw = (
        F.when(k == 0, "  ").when(k == 1, "no answer").when(k == 2, F.substr(good, F.lit(1), F.lit(20))).when(k == 3, '{"colour": 1}')
        .when(k == 4, '{"salary": {"kind": "B2B"}}').otherwise(good)
    )
    rows = parsing.parse_results(_table(spark, sf_dir, "events").select("event_id", raw.alias("raw")))
    return rows.select("event_id", "valid", "failure", F.array_join("parsed.seniority", ",").alias("seniority"), "parsed.salary.amount_from")


def load_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("event_id")).alias("n")))
    torn = F.when(F.pmod("event_id", F.lit(10)) == 0, F.substr(line, F.lit(1), F.lit(9))).otherwise(line)
    done = records.load_completed(events.select(F.col("event_id").alias("pos"), torn.alias("line")), "id", "id string, kind string, n long", ("n",))
    return done.select("pos", "id", "kind", "n")


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.struct(F.struct(F.struct(
        F.col("page_id").cast("string").alias("id"),
        F.struct(F.struct(F.col("url").alias("value")).alias("title"), F.struct(F.array(F.lit("regular"), F.lit("x")).alias("positionLevelIds")).alias("employment")).alias("attributes"),
        F.array(F.struct(F.lit("Tasks").alias("title"), F.struct(F.array(F.lit("Do it")).alias("paragraphs"), F.array(F.lit("one"), F.lit(" ")).alias("bullets")).alias("model"))).alias("jsonSections"),
    ).alias("offer")).alias("pageProps")).alias("props")))
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="x">'), body, F.lit("</script>"))
    # every page is searched whole, after its own html; those that get no script hold no offer, and parse_pages drops them
    html = F.concat(F.coalesce("html", F.lit("")), F.when(F.pmod("page_id", F.lit(2)) == 0, script).otherwise(""))
    pages = _table(spark, sf_dir, "pages").select("url", html.alias("html"))
    return curate.parse_pages(pages).select("offer_id", "url", "prose", F.col("gold.title").alias("title"), F.array_join("gold.seniority", ",").alias("seniority"))


def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<struct<prose:string,answer:string>>")
    made = parsing.messages(F.lit("s"), F.lit("i"), F.lit("ok"), none, F.col("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(made).alias("place", "m"))
    return rows.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "m.role", F.md5(F.col("m.content").cast("binary")).alias("content_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        build_stats, build_records, temporal_split, split_manifest, dedupe_two_key, dev_split, spread_sample, shots_split, stratified_sample,
        normalise_vocabulary, normalise_terms, set_scores, headline_f1, run_totals, salary_scores, cost_and_latency, failure_taxonomy, pick_winner,
        cohen_kappa, raw_agreement, triangulate, disagreeing_ids, term_ceiling, bootstrap_intervals, parse_failures, load_completed, extract_pages, build_messages,
    )
}

_LEGS = """
    legs AS (
        SELECT doc_id, CASE WHEN quality = 1 THEN 'senior' ELSE 'junior' END AS h, CASE WHEN n_chars >= 800 THEN 'senior' ELSE 'junior' END AS l,
               CASE WHEN doc_id % 3 = 0 THEN 'senior' ELSE 'junior' END AS p
        FROM labels JOIN documents USING (doc_id)
    )
"""
_RANKED = "(SELECT doc_id, row_number() OVER (ORDER BY pub_date DESC, doc_id DESC) AS r, count(*) OVER () AS n FROM kept)"
_SPELLINGS = ", ".join(f"({i}, '{name}', '{'|'.join((name, *more))}')" for i, (name, more) in enumerate(TERMS.items(), 1))
_BESIDE = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
_PRESENT = ", ".join(f"regexp_matches(text, '(?i)(?:^|{_BESIDE})(?:{'|'.join((name, *more))})(?:$|{_BESIDE})')::INT" for name, more in TERMS.items())
_IS_TEST = "r <= least(greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)), n - 1)"

ORACLES = {
    "build_stats": f"""
        WITH {_SQL_EXAMPLES}, s AS (SELECT (SELECT count(*) FROM examples) AS c, (SELECT count(*) FROM passed) AS p, (SELECT count(*) FROM kept) AS k)
        SELECT c AS collected, p AS passed, c - p AS dropped, p - k AS duplicates, k AS records FROM s
    """,
    "build_records": f"WITH {_SQL_EXAMPLES} SELECT doc_id, pub_date, k AS prose_key FROM kept",
    "temporal_split": f"WITH {_SQL_EXAMPLES} SELECT doc_id, CASE WHEN {_IS_TEST} THEN 'test' ELSE 'train' END AS split FROM {_RANKED}",
    "split_manifest": f"""
        WITH {_SQL_EXAMPLES}, s AS (SELECT doc_id, CASE WHEN {_IS_TEST} THEN 'test' ELSE 'train' END AS split FROM {_RANKED})
        SELECT split, count(*) AS n, min(pub_date) AS first_date, max(pub_date) AS last_date, 400 AS min_prose_chars, CAST(0.2 AS DOUBLE) AS test_fraction
        FROM s JOIN kept USING (doc_id) GROUP BY split
    """,
    "dev_split": f"""
        WITH {_SQL_EXAMPLES}, r AS (SELECT doc_id, row_number() OVER (ORDER BY pub_date DESC NULLS LAST, doc_id DESC) AS r, count(*) OVER () AS n FROM examples)
        SELECT doc_id AS pos, CASE WHEN r <= least(greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)), n - 1) THEN 'dev' ELSE 'train' END AS split FROM r
    """,
    "spread_sample": "SELECT doc_id AS pos FROM documents, (SELECT count(*) // 37 AS step FROM documents) WHERE doc_id % step = 0 AND doc_id < step * 37",
    "shots_split": "SELECT doc_id AS pos, row_number() OVER (ORDER BY doc_id) <= 5 AS is_shot FROM documents",
    "stratified_sample": """
        WITH r AS (SELECT doc_id, quality = 0 AS d, row_number() OVER (PARTITION BY quality = 0 ORDER BY md5('seed:' || doc_id)) AS r, count(*) FILTER (quality = 0) OVER () AS dis,
                          count(*) FILTER (quality <> 0) OVER () AS agree FROM labels),
             q AS (SELECT *, least(agree, 60 - least(dis, 30)) AS b FROM r)
        SELECT doc_id FROM q WHERE r <= CASE WHEN d THEN least(dis, 60 - b) ELSE b END
    """,
    "normalise_vocabulary": """
        SELECT event_id, ['mid', 'intern', 'lead', 'guru', NULL][event_id % 5 + 1] AS seniority, ['remote', 'office', 'orbit'][event_id % 3 + 1] AS work_mode,
               ['PLN', 'EUR', 'CHF', NULL][event_id % 4 + 1] AS currency FROM events
    """,
    "set_scores": f"""
        WITH {_SQL_WHOLE}
        SELECT variant, field, n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, support, exact_supported, round(p, 4) AS precision,
               round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1, round(exact_supported / support, 4) AS exact FROM scored
    """,
    "headline_f1": f"WITH {_SQL_WHOLE} SELECT variant, round(2 * p * r / (p + r), 4) AS headline_f1 FROM scored WHERE field = 'tech_expected'",
    "pick_winner": f"WITH {_SQL_WHOLE} SELECT variant FROM scored WHERE field = 'tech_expected' ORDER BY round(2 * p * r / (p + r), 4) DESC LIMIT 1",
    "run_totals": """
        WITH gold AS (
            SELECT doc_id, doc_id % 7 <> 0 AS valid, lower(trim(coalesce(source, ''))) AS title,
                   lower(trim(coalesce(CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE lang END, ''))) AS own, (SELECT count(*) FROM documents) AS n_gold FROM documents
        ), once AS (
            SELECT 'a' AS variant, * FROM gold UNION ALL SELECT 'b', * FROM gold WHERE doc_id % 5 <> 0
        ), runs AS (
            SELECT * FROM once UNION ALL SELECT * FROM once WHERE doc_id % 50 = 0
        ), r AS (
            SELECT variant, n_gold, count(*) AS n, count(DISTINCT doc_id) AS ids, avg(valid::INT) AS validity, count(*) FILTER (title <> '') AS support,
                   count(*) FILTER (title <> '' AND valid AND own = title) AS exact FROM runs GROUP BY ALL
        )
        SELECT variant, n, n_gold, round_even(ids / n_gold, 4) AS coverage, n - ids AS n_duplicate_rows, round_even(validity, 4) AS json_validity, support AS title_support,
               CASE WHEN support > 0 THEN round_even(exact / support, 4) END AS title_exact, round_even(ids / n_gold, 4) >= 1 AND n = ids AS trustworthy FROM r
    """,
    "salary_scores": """
        WITH r AS (
            SELECT o_orderkey % 7 AS k, o_orderkey % 7 NOT IN (5, 6) AS answered, o_orderkey % 4 <> 0 AS there FROM orders
        ), s AS (
            SELECT count(*) AS n, count(*) FILTER (there) AS support, avg((k <> 5 AND (k <> 6) = there)::INT) AS detected, count(*) FILTER (answered AND there) AS both_there,
                   count(*) FILTER (answered AND there AND k <> 1) AS same_currency, count(*) FILTER (answered AND there AND k <> 2) AS near FROM r
        )
        SELECT 'v' AS variant, n, support AS salary_support, round_even(detected, 4) AS detection, round_even(same_currency / support, 4) AS currency,
               round_even(both_there / support, 4) AS kind, round_even(near / support, 4) AS amounts FROM s
    """,
    "term_ceiling": f"""
        WITH found AS (
            SELECT doc_id, [{_PRESENT}] AS hits FROM documents
        ), per AS (
            SELECT doc_id, field, n AS terms, list_sum(hits[1:n]) AS present FROM found, (VALUES ('tech_expected', 5), ('tech_optional', 2)) f(field, n)
        ), s AS (
            SELECT field, CAST(sum(terms) AS BIGINT) AS terms, CAST(sum(present) AS BIGINT) AS present, count(*) AS records, count(*) FILTER (present = 0) AS unanswerable FROM per GROUP BY field
        )
        SELECT *, round_even(present / terms, 4) AS share, round_even(unanswerable / records, 4) AS unanswerable_share FROM s
    """,
    # no alias has more than four letters, and a word that is not equal to it is then never similar enough
    "normalise_terms": f"""
        WITH a AS (SELECT name, unnest(string_split(spellings, '|')) AS alias FROM (VALUES {_SPELLINGS}) t(place, name, spellings)),
        w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark)
        SELECT term, coalesce(name, term) AS canonical FROM w LEFT JOIN a ON alias = term
    """,
    "dedupe_two_key": r"""
        WITH RECURSIVE source_rows AS MATERIALIZED (
            SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i,
                   [doc_id // 3, -dense_rank() OVER (ORDER BY sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))))] AS keys FROM documents
        ), walk AS (
            SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS pos
            UNION ALL
            SELECT s.i, CASE WHEN list_has_any(seen, keys) THEN seen ELSE list_concat(seen, keys) END, CASE WHEN list_has_any(seen, keys) THEN NULL ELSE doc_id END
            FROM walk JOIN source_rows s ON s.i = walk.i + 1
        )
        SELECT pos FROM walk WHERE pos IS NOT NULL
    """,
    "cost_and_latency": """
        SELECT l_returnflag AS variant, round(avg((l_quantity * 10 + l_quantity * 5) / 1e6) FILTER (l_linenumber <> 3) * 1000, 4) AS cost_per_1k,
               round(quantile_cont(l_quantity / 8, 0.5), 3) AS latency_p50, round(quantile_cont(l_quantity / 8, 0.95), 3) AS latency_p95,
               round(avg(l_quantity) FILTER (l_quantity > 0), 1) AS mean_output_tokens FROM lineitem GROUP BY 1
    """,
    "failure_taxonomy": """
        WITH e AS (SELECT event_type AS variant, ['json_decode_error', 'schema_invalid', 'unrecorded', 'unrecorded'][event_id % 4 + 1] AS failure,
                          event_id % 3 = 0 AS valid, user_id % 100 >= CASE WHEN event_id % 2 = 0 THEN 50 ELSE 80 END AS full_cap FROM events),
             k AS (SELECT * FROM (VALUES ('empty_output', 0), ('no_json_object', 1), ('json_decode_error', 2), ('schema_invalid', 3), ('unrecorded', 4)) t(failure, ord))
        SELECT variant, k.failure, ord, count(*) FILTER (NOT valid AND e.failure = k.failure) AS n,
               count(*) FILTER (NOT valid AND e.failure = k.failure AND e.failure = 'json_decode_error' AND full_cap) AS at_token_cap FROM e, k GROUP BY ALL
    """,
    "cohen_kappa": f"""
        WITH {_LEGS}, s AS (SELECT count(*) AS n, avg((h = l)::INT) AS po, avg((h = 'senior')::INT) AS a, avg((l = 'senior')::INT) AS b FROM legs),
             e AS (SELECT *, a * b + (1 - a) * (1 - b) AS pe FROM s)
        SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM e
    """,
    "raw_agreement": f"WITH {_LEGS} SELECT f AS field, count(*) AS n, round(avg(CASE WHEN f = 'seniority' THEN (h = l)::INT ELSE 1 END), 4) AS agreement FROM legs, (VALUES ('seniority'), ('work_mode')) t(f) GROUP BY f",
    "triangulate": f"""
        WITH {_LEGS}, c AS (SELECT CASE WHEN l = h AND p = h THEN 'all_agree' WHEN l = h THEN 'platform_gap_caught' WHEN p = h THEN 'llm_error' ELSE 'all_differ' END AS bucket FROM legs),
             k AS (SELECT * FROM (VALUES ('all_agree'), ('platform_gap_caught'), ('llm_error'), ('all_differ')) t(bucket))
        SELECT field, k.bucket, count(c.bucket) AS n FROM (VALUES ('seniority'), ('total')) f(field) CROSS JOIN k LEFT JOIN c ON c.bucket = k.bucket GROUP BY ALL
    """,
    "disagreeing_ids": f"WITH {_LEGS} SELECT doc_id FROM legs WHERE h <> l",
    "parse_failures": """
        SELECT event_id, event_id % 6 = 5 AS valid,
               ['empty_output', 'no_json_object', 'json_decode_error', 'schema_invalid', 'schema_invalid', NULL][event_id % 6 + 1] AS failure,
               CASE WHEN event_id % 6 = 5 THEN 'mid' END AS seniority, CASE WHEN event_id % 6 = 5 THEN CAST(5 AS DOUBLE) END AS amount_from FROM events
    """,
    "load_completed": """
        SELECT min(event_id) AS pos, CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS kind, max(event_id) AS n
        FROM events WHERE event_id % 3 <> 0 AND event_id % 10 <> 0 GROUP BY user_id
    """,
    "extract_pages": """
        SELECT CAST(page_id AS VARCHAR) AS offer_id, url, '## Tasks' || chr(10) || 'Do it' || chr(10) || '- one' AS prose, url AS title, 'mid' AS seniority
        FROM pages WHERE page_id % 2 = 0
    """,
    "build_messages": """
        SELECT conv_id, turn, CAST(place AS BIGINT) AS place, ['system', 'user', 'assistant', 'user'][place + 1] AS role, md5(['s', 'i', 'ok', 'Posting:' || chr(10) || text][place + 1]) AS content_md5
        FROM conversations, range(4) t(place)
    """,
}
