"""Settings are refused by name."""

import copy

import pytest

from sievemark.sources import settings

GOOD = {
    "models": {"candidates": [{"key": "m1"}, {"key": "m2"}]},
    "data": {"sitemap_offers_sample": 5, "test_fraction": 0.2, "min_prose_chars": 400},
    "probe": {
        "dev_slice_size": 3, "temperature": 0.0, "max_tokens": 10, "few_shot_examples": 0, "context_tokens": 100, "context_margin_tokens": 99, "shot_modes": ["zero"],
    },
    "eval": {
        "shot_modes": ["zero", "few"], "few_shot_examples": 2, "input_usd_per_mtok": 1.0, "output_usd_per_mtok": 5, "request_max_snippets": 1, "latency_percentiles": [0, 50, 100],
    },
    "labeling_qa": {
        "proposer_backend": "gguf", "proposer": "m2", "proposer_mode": "few", "sampling": "random", "human_sample_size": 1, "arbiter_max_snippets": 1,
    },
    "train": {
        "base": "m1", "lora_r": 8, "lora_alpha": 16, "lora_dropout": 0, "compute_dtype": "bf16", "warmup_ratio": 0.0, "epochs": 1, "learning_rate": 1e-4,
        "per_device_batch_size": 1, "grad_accum_steps": 1, "max_seq_len": 128, "dev_fraction": 0.1,
    },
}


def test_good_settings_pass():
    assert settings.checked(GOOD) is GOOD
    assert settings.problems({"data": GOOD["data"]}) == []


@pytest.mark.parametrize(
    ("name", "value"),
    [
        ("data.test_fraction", 0.0), ("data.test_fraction", 1), ("data.sitemap_offers_sample", 0), ("data.min_prose_chars", None), ("probe.dev_slice_size", 0),
        ("probe.temperature", -0.1), ("probe.context_margin_tokens", 100), ("probe.context_margin_tokens", -1), ("probe.shot_modes", ["one"]), ("probe.few_shot_examples", -1),
        ("eval.latency_percentiles", [50, 101]), ("eval.input_usd_per_mtok", 0), ("eval.shot_modes", "zero"), ("labeling_qa.proposer", "m3"), ("labeling_qa.sampling", "all"),
        ("labeling_qa.proposer_backend", "other"), ("train.base", "m9"), ("train.lora_dropout", 1.0), ("train.compute_dtype", "fp32"), ("train.epochs", 0), ("train.lora_r", True),
        ("train.dev_fraction", 0), ("models.candidates", [{"key": "m1"}]),
    ],
)
def test_a_wrong_value_is_named(name, value):
    bad = copy.deepcopy(GOOD)
    section, key = name.split(".")
    bad[section][key] = value
    with pytest.raises(ValueError, match=name.replace(".", r"\.")):
        settings.checked(bad)


def test_all_that_is_wrong_is_said_at_once():
    bad = copy.deepcopy(GOOD)
    bad["train"]["epochs"], bad["data"]["test_fraction"] = -1, 2
    assert len(settings.problems(bad)) == 2


def test_settings_come_from_a_file(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(GOOD))
    assert settings.read_settings(spark, str(tmp_path / "s.yaml")) == GOOD
