"""Runs of a model over records: shots by mode, timed answers with their tokens and cap, labels of an arbiter, stored runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocab
from ..sources import records
from . import scoring
from .parsing import parse_results

#: A prompt to an answer (null where there is none), and the tokens of both.
Answer = Callable[[str], tuple[str | None, int | None, int | None]]


def shots_for(mode: Column, shots: Column, n: int) -> Column:
    """The first n shots in mode "few", none in any other."""
    return F.slice(shots, F.lit(1), F.when(mode == "few", n).otherwise(0))


def run(rows: DataFrame, answerer: Callable[[], Answer], max_tokens: int | None, terms: dict[str, str] | None = None, prompt: str = "prompt") -> DataFrame:
    """Adds ``raw, input_tokens, output_tokens, latency_s, max_tokens`` and the parsed answer.

    ``answerer()`` is called once in each task, which is where a client is made. A null prompt is an empty one.
    """

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = answerer()
        for f in frames:
            got = []
            for text in f[prompt]:
                began = time.perf_counter()
                got.append((*answer(text or ""), time.perf_counter() - began))
            raw, n_in, n_out, took = zip(*got) if got else ((),) * 4
            yield f.assign(raw=raw, input_tokens=pd.array(n_in, "Int64"), output_tokens=pd.array(n_out, "Int64"), latency_s=took)

    kind = StructType([*rows.schema.fields]).add("raw", "string").add("input_tokens", "long").add("output_tokens", "long").add("latency_s", "double")
    out = rows.mapInPandas(answers, kind).withColumn("max_tokens", F.lit(max_tokens).cast("long"))
    return parse_results(out, terms)


def arbiter_labels(rows: DataFrame, answerer: Callable[[], Answer], terms: dict[str, str] | None = None, prompt: str = "prompt", id_col: str = "offer_id") -> DataFrame:
    """``(id, arbiter_gold, arbiter_valid)``: the gold fields of the arbiter's answer; without a valid one, null and false."""
    out = run(rows.select(id_col, prompt), answerer, None, terms, prompt)
    fields = F.struct(*(F.col("parsed")[f].alias(f) for f in ("title", *vocab.SET_FIELDS, "contract_types", "salary")))
    return out.select(id_col, F.when(F.col("valid"), fields).alias("arbiter_gold"), F.col("valid").alias("arbiter_valid"))


def rescored(spark: SparkSession, folder: str, gold: DataFrame, schema: str, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """The report of stored predictions, one file of JSON lines per variant, without asking a model again."""
    if not records.exists(spark, folder):
        raise FileNotFoundError(f"no stored predictions in {folder}")
    preds = records.read_variants(spark, folder, schema)
    if preds.isEmpty():
        raise FileNotFoundError(f"no stored predictions in {folder}")
    return scoring.report(preds, gold, price_in, price_out)
