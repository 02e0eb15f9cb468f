"""Texts made so that sums modulo a power of two collide are told apart."""

import numpy as np

from sievemark.llm.ngram_join import jaccard_components
from sievemark.llm.quality import quality_rules
from sievemark.llm.textvec import span_hashes

ONE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_spans():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    starts = rng.integers(0, 5000, 3000)
    ends = np.minimum(5000, starts + rng.integers(0, 90, 3000))
    ends[0], starts[0] = 5000, 0
    names: dict = {}
    for a, b, h in zip(starts, ends, span_hashes(data, starts, ends)):
        names.setdefault(bytes(data[a:b]), set()).add(int(h))
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)


def test_words_and_lines(spark):
    docs = spark.createDataFrame([(1, ONE, "en"), (2, OTHER, "en"), (3, f"{ONE}\n{OTHER}\n{ONE}", "en")], "doc_id long, text string, lang string")
    assert {r.id: r.component_id for r in jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules(docs).collect()} == {1: 0, 2: 0, 3: 1}


def test_near_copies_in_many_components(spark):
    """A base, near copies on both sides of the threshold, and a passage that all documents share, against brute force."""
    from .test_results import components

    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(30))
    docs = []
    for i in range(240):
        words = list(base) if i % 3 else [f"d{i}x{j}" for j in range(60)]
        for at in rng.choice(len(words), int(rng.integers(0, 7)), replace=False):
            words[at] = f"m{rng.integers(0, 40)}"
        docs.append((i, " ".join(words) + (" " + passage if i % 2 else "")))
    docs += [(1000 + i, docs[i][1]) for i in range(0, 60, 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for k, percent in ((4, 85), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, k, percent).collect()}
        assert got == components(docs, k, percent)
