"""op2: only windows that recur are transformed, crowded minimizers are dealt in parts, and results stay those of brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sievemark.llm import suffix_dedup as S

from .test_results import repeats, sha

PASSAGE = "in this place stands a passage of ninety bytes that many texts hold in other surroundings"


def noise(rng, n):
    return "".join(rng.choices("abcdefghij klmnop", k=n))


def around(passage, n, seed=3):
    rng = random.Random(seed)
    return [noise(rng, 150) + passage + noise(rng, 150) for _ in range(n)]


def checked(spark, texts):
    docs = list(enumerate(texts))
    got = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length=100).collect()
    assert {r.id: (r.n_bytes, r.n_removed, len(r.spans), sha(bytes(r.kept))) for r in got} == repeats(docs)


def transformed(monkeypatch):
    sizes, order = [], S.suffix_order
    monkeypatch.setattr(S, "suffix_order", lambda data, depth: sizes.append(len(data)) or order(data, depth))
    return sizes


def test_windows_that_no_other_equals_are_not_transformed(monkeypatch):
    sizes = transformed(monkeypatch)
    texts = around(PASSAGE, 300)
    texts[200] = texts[200][:170] + texts[100][170:]  # one pair shares windows
    rows = [(7, i, 0, 0, len(t) - 99, t.encode()) for i, t in enumerate(texts)]
    batches = [S._batch(S.CUT, *map(list, zip(*rows[i : i + 50]))) for i in range(0, 300, 50)]
    found = [r for b in S._repeats(100)(iter(batches)) for r in b.to_pylist()]
    marks = {i: set() for i in range(300)}
    for r in found:
        marks[r["id"]] |= set(range(r["start"], r["start"] + r["n"]))
    assert {i: len(m) for i, m in marks.items()} == {i: v[1] for i, v in repeats(list(enumerate(texts))).items()}
    assert sum(marks[200]) and sum(sizes) < 2 * 400


@pytest.mark.parametrize("passage", [PASSAGE, PASSAGE[:40], PASSAGE * 2])
@pytest.mark.parametrize("many", [3, 40])
def test_crowded_minimizers(spark, monkeypatch, passage, many):
    monkeypatch.setattr(S, "MANY", many)
    texts = around(passage, 60) + around(passage, 30) + [passage * 3, "", "ä" * 300, "x" * 500]
    for i in range(0, 60, 7):
        texts.append(texts[i][100:150] + passage + texts[i][150 + len(passage) : 190 + len(passage)] + "end")
    checked(spark, texts)


def test_parts_are_few_bytes_and_meet():
    rng = random.Random(5)
    texts = around(PASSAGE, 40)
    data = [t.encode() for t in texts]
    block = S.Block(pa.array(texts))
    mini, _, text, start, n = S.segments(block, 100)
    name = np.bincount(np.unique(mini, return_inverse=True)[1]).argmax()
    hot = np.flatnonzero(mini == np.unique(mini)[name])
    assert len(hot) > 30
    wanted = [[] for _ in texts]
    for i in hot:
        wanted[text[i]].append({"start": int(start[i]), "n": int(n[i]), "mini": int(mini[i].view(np.int64)), "parts": 4})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("mini", pa.int64()), ("parts", pa.int32())]))
    order = list(range(40))
    rng.shuffle(order)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(order), pa.array([0] * 40), pa.array([texts[i] for i in order]), pa.array([wanted[i] for i in order], kind)], names=["id", "tie", "text", "wanted"]
    )
    rows = [r for b in S._cut(100)(iter([batch])) for r in b.to_pylist()]
    windows = {}
    for r in rows:
        assert r["bytes"] == data[r["id"]][r["start"] : r["start"] + r["n"] + 99] if r["n"] > 0 else (r["bytes"], r["n"] < -99) == (b"", True)
        for s in range(r["start"], r["start"] + (r["n"] if r["n"] > 0 else -r["n"] - 99)):
            windows.setdefault(data[r["id"]][s : s + 100], []).append(r["route"])
    assert sum(map(len, windows.values())) == n[hot].sum()
    assert all(len(set(routes)) == 1 for routes in windows.values())
    assert sum(len(r["bytes"]) for r in rows) < 4 * 125 * len(hot)
