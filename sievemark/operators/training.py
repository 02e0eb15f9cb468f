"""Examples for supervised fine-tuning: prompt and completion, token ids under a limit, and their lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contract
from ..functions.batches import pieces
from ..functions.columns import rounded
from .parsing import messages
from .percentiles import exact_percentiles

#: Chat messages, and whether an answer is to follow, to token ids.
Template = Callable[[list[dict], bool], list[int]]
#: Fixed value: the label of a place that is not learnt.
MASKED = -100
#: Ids after which a task hands its rows on.
MOST_IDS = 1 << 17
ENCODED = ("input_ids", "labels", "attention_mask", "prompt_length", "cut_chars")


def sft_examples(records: DataFrame, system: str, instruction: str, acknowledgement: str, id_col: str = "offer_id") -> DataFrame:
    """``(id, prompt_messages, prose, completion)``: a prompt without shots and the gold label as JSON.

    A gold label that breaks the contract anywhere fails the job by name, so that nothing malformed is taught.
    """
    none = F.array().cast("array<struct<prose:string,answer:string>>")
    prompt = messages(F.lit(system), F.lit(instruction), F.lit(acknowledgement), none, F.col("prose"))
    gold = contract.conforming(F.col("gold"), contract.GOLD, F.concat(F.lit("gold of "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return records.select(id_col, prompt.alias("prompt_messages"), "prose", F.to_json(gold, {"ignoreNullFields": "false"}).alias("completion"))


def encode_one(messages: list[dict], completion: str, template: Template, max_len: int) -> tuple[list[int], list[int], int]:
    """Ids, labels and the characters cut from the end of the last message.

    The prompt must be a prefix of the whole, id by id, or labels would mask the wrong places. Only the last message, the
    posting, is cut, by a tenth at a time; the completion stays whole, and what is too long even without a posting is
    returned as it is. A template need not give fewer ids for less text, so each cut is tried, by the whole alone: the prompt
    is asked for once, of the text that is returned.
    """
    answer = {"role": "assistant", "content": completion}
    *before, last = messages
    posting = kept = last["content"]
    whole = list(template([*messages, answer], False))
    while len(whole) > max_len and kept:
        kept = kept[: len(kept) - max(1, len(kept) // 10)]
        messages = [*before, {**last, "content": kept}]
        whole = list(template([*messages, answer], False))
    prompt = list(template(messages, True))
    if whole[: len(prompt)] != prompt:
        raise ValueError("the chat template does not begin the whole with the prompt")
    return whole, [MASKED] * len(prompt) + whole[len(prompt) :], len(posting) - len(kept)


def encoded(examples: DataFrame, template: Callable[[], Template], max_len: int, id_col: str = "offer_id") -> DataFrame:
    """``(id, input_ids, labels, attention_mask, prompt_length, cut_chars)`` of ``examples (id, prompt_messages, completion)``.

    ``template()`` is called in the tasks and gives a function of messages and whether an answer is to follow. Labels are
    the ids of the completion, behind a mask for the prompt. An example without messages or completion has null columns. A
    task holds the ids of few rows at a time.
    """

    def batch(made: list[tuple], own: pa.DataType) -> pa.RecordBatch:
        kinds = (own, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
        columns = [pa.array([r[i] for r in made], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, *ENCODED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = template()
        for b in pieces(batches):
            made, n = [], 0
            for row, asked, completion in zip(*b.columns):
                asked, completion = asked.as_py(), completion.as_py()
                if not asked or completion is None:
                    made.append((row, *(None,) * 5))
                    continue
                whole, labels, cut = encode_one(asked, completion, ids, max_len)
                made.append((row, whole, labels, [1] * len(whole), sum(x == MASKED for x in labels), cut))
                n += len(whole)
                if n >= MOST_IDS:
                    yield batch(made, b.schema.types[0])
                    made, n = [], 0
            yield batch(made, b.schema.types[0])

    kind = f"`{id_col}` {examples.schema[id_col].dataType.simpleString()}, input_ids array<long>, labels array<long>, attention_mask array<long>, prompt_length long, cut_chars long"
    return examples.select(id_col, "prompt_messages", "completion").mapInArrow(run, kind)


def length_profile(lengths: DataFrame, length: str = "length") -> DataFrame:
    """One row: number, median, 90th and 99th percentile and largest of the lengths; nulls without any."""
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.max(length).cast("long").alias("longest"))
    at = exact_percentiles(lengths, length, {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("n")  # one row at most
    return whole.join(F.broadcast(at), how="left").select("n", *(rounded(F.col(p), 3).alias(p) for p in ("p50", "p90", "p99")), "longest")


def longest_prompt(prompts: DataFrame, tokens: Column, context: int, max_tokens: int, margin: int = 0) -> int:
    """The largest number of tokens of a prompt, 0 without prompts; an error if the answer would not fit beside it."""
    most = prompts.agg(F.max(tokens)).first()[0] or 0
    if most > context - max_tokens - margin:
        raise ValueError(f"a prompt of {most} tokens leaves no room for {max_tokens} in a context of {context}")
    return most


def probe_grid(candidates: DataFrame, modes: DataFrame) -> DataFrame:
    """Every candidate under every mode; both are short lists."""
    return candidates.crossJoin(F.broadcast(modes))
