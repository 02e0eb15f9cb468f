"""Settings of a run, refused by name before any job starts where a value cannot be right."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Within:
    """Numbers from ``low`` to ``high``; an end belongs to them if its flag says so."""

    low: float
    high: float = float("inf")
    with_low: bool = True
    with_high: bool = True

    def allows(self, x: Any) -> bool:
        if isinstance(x, bool) or not isinstance(x, int | float):
            return False
        return (self.low < x or self.with_low and x == self.low) and (x < self.high or self.with_high and x == self.high)

    def __str__(self) -> str:
        return f"{'[' if self.with_low else '('}{self.low}, {self.high}{']' if self.with_high else ')'}"


@dataclass(frozen=True)
class OneOf:
    names: tuple[str, ...]

    def allows(self, x: Any) -> bool:
        return x in self.names

    def __str__(self) -> str:
        return " or ".join(self.names)


@dataclass(frozen=True)
class Each:
    """Every element of a list."""

    rule: Within | OneOf

    def allows(self, x: Any) -> bool:
        return isinstance(x, list | tuple) and all(map(self.rule.allows, x))

    def __str__(self) -> str:
        return f"a list, each {self.rule}"


POSITIVE, NOT_NEGATIVE = Within(0, with_low=False), Within(0)
FRACTION, BELOW_ONE = Within(0, 1, False, False), Within(0, 1, True, False)

#: What each setting has to be.
RULES: dict[str, Within | OneOf | Each] = {
    "data.sitemap_offers_sample": POSITIVE,
    "data.test_fraction": FRACTION,
    "data.min_prose_chars": POSITIVE,
    "probe.dev_slice_size": POSITIVE,
    "probe.temperature": NOT_NEGATIVE,
    "probe.max_tokens": POSITIVE,
    "probe.few_shot_examples": NOT_NEGATIVE,
    "probe.context_tokens": POSITIVE,
    "probe.context_margin_tokens": NOT_NEGATIVE,
    "probe.shot_modes": Each(OneOf(("zero", "few"))),
    "eval.shot_modes": Each(OneOf(("zero", "few"))),
    "eval.few_shot_examples": NOT_NEGATIVE,
    "eval.input_usd_per_mtok": POSITIVE,
    "eval.output_usd_per_mtok": POSITIVE,
    "eval.request_max_snippets": POSITIVE,
    "eval.latency_percentiles": Each(Within(0, 100)),
    "labeling_qa.proposer_backend": OneOf(("gguf",)),
    "labeling_qa.proposer_mode": OneOf(("zero", "few")),
    "labeling_qa.sampling": OneOf(("random", "stratified")),
    "labeling_qa.human_sample_size": POSITIVE,
    "labeling_qa.arbiter_max_snippets": POSITIVE,
    "train.lora_r": POSITIVE,
    "train.lora_alpha": POSITIVE,
    "train.lora_dropout": BELOW_ONE,
    "train.compute_dtype": OneOf(("fp16", "bf16")),
    "train.warmup_ratio": BELOW_ONE,
    "train.epochs": POSITIVE,
    "train.learning_rate": POSITIVE,
    "train.per_device_batch_size": POSITIVE,
    "train.grad_accum_steps": POSITIVE,
    "train.max_seq_len": POSITIVE,
    "train.dev_fraction": FRACTION,
}
#: Settings that name one of the candidate models.
MODELS = ("train.base", "labeling_qa.proposer")


def problems(settings: Mapping[str, Any]) -> list[str]:
    """All that is wrong, one line each; sections that are not there are not looked at, as a run may need some only."""
    found = []
    for name, rule in RULES.items():
        section, key = name.split(".")
        if section in settings:
            value = (settings[section] or {}).get(key)
            if not rule.allows(value):
                found.append(f"{name} must be {rule}, not {value!r}")
    probe = settings.get("probe") or {}
    margin, context = probe.get("context_margin_tokens"), probe.get("context_tokens")
    if POSITIVE.allows(context) and NOT_NEGATIVE.allows(margin) and margin >= context:
        found.append("probe.context_margin_tokens leaves no room in probe.context_tokens")
    if "models" in settings:
        keys = [c.get("key") for c in (settings["models"] or {}).get("candidates") or ()]
        if len(keys) < 2:
            found.append("models.candidates must have two or more")
        for name in MODELS:
            section, key = name.split(".")
            if section in settings and (value := (settings[section] or {}).get(key)) not in keys:
                found.append(f"{name} must be the key of a candidate, not {value!r}")
    return found


def checked(settings: Mapping[str, Any]) -> Mapping[str, Any]:
    """``settings``, or a ValueError that names all that is wrong with them."""
    if wrong := problems(settings):
        raise ValueError("; ".join(wrong))
    return settings


def read_settings(spark: SparkSession, path: str) -> Mapping[str, Any]:
    """The checked settings of one small YAML file, wherever Spark can read it."""
    import yaml

    return checked(yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or {})
