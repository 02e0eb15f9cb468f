"""Benchmark items in pieces that lie far from each other in long documents."""

import random

from sievemark.llm.decontaminate import contained_items


def test_scattered_items_are_found(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randrange(3, 9)))
    items, docs = [], []
    for i in range(60):
        words = [word() for _ in range(60)]
        items.append((i, " ".join(words)))
        size, noise = r.choice([20, 30]), r.choice([100, 1000])
        text = [word() for _ in range(noise)]
        for at in range(0, 60, size):
            text += words[at : at + size] + [word() for _ in range(noise)]
        docs.append((i, " ".join(text)))
    docs += [(1000 + i, " ".join(word() for _ in range(1500))) for i in range(40)]
    found = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.id, x.item_id) for x in found.collect()}
    assert got == {(i, i) for i in range(60)}
