"""The dealt queries on a small table against brute-force versions."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from sievemark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows(spark, sf, name):
    return Q.QUERIES[name](spark, sf).collect()


def test_line_dedup(spark, sf, docs):
    key = lambda line: lower(line.strip(SPACES))
    common = Counter(k for _, t, _ in docs for k in {key(x) for x in t.split("\n")} if k)
    want = {}
    for i, t, _ in docs:
        lines = t.split("\n")
        kept = [x for x in lines if not key(x) or common[key(x)] < 10]
        want[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows(spark, sf, "op1_line_dedup")} == want


def repeats(docs, length=100):
    seen, want = set(), {}
    for i, t in sorted((d[:2] for d in docs), key=lambda d: d[0]):
        data = t.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        want[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(b for b, g in zip(data, gone) if not g)))
    return want


def test_suffix_dedup(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, sf, "op2_suffix_dedup")}
    assert got == repeats(docs)


def test_mixing(spark, sf, docs):
    got = rows(spark, sf, "op3_mixing")
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in docs)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    by = defaultdict(set)
    for r in got:
        by[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in by.values())


def spans_of(text):
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_scan(spark, sf, docs):
    want = {}
    for i, t, _ in docs:
        found = spans_of(t)
        n = Counter(k for _, k, _ in found)
        want[i] = (n[0], n[1], n[2], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)))
    got = rows(spark, sf, "op4_secret_scan")
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == want
    for r in got:
        base = {f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans_of(next(t for i, t, _ in docs if i == r.doc_id))}
        assert base <= set(r.spans.split(","))


def shingles(text, k, word=WORD):
    w = word.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        for g in s:
            at[g].append(n)
    for a, b in {(x, y) for v in at.values() if len(v) < 400 for x in v for y in v if x < y}:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_ngram_join(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, sf, "op5_ngram_jaccard_join")}
    assert got == components(docs, 4, 85)


ALNUM = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def contained(docs, items, k=5, threshold=0.8):
    out = set()
    cut = lambda t: {tuple(w[i : i + k]) for w in [ALNUM.findall(lower(t))] for i in range(len(w) - k + 1)}
    wanted = [(i, cut(t or "")) for i, t in items]
    for d, t, *_ in docs:
        have = cut(t)
        out |= {(d, i, len(s), len(s & have)) for i, s in wanted if s and len(s & have) >= threshold * len(s)}
    return out


def test_decontamination(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {tuple(r) for r in rows(spark, sf, "op6_decontamination")} == contained(docs, items)


def test_token_shards(spark, sf, docs):
    import tiktoken

    from sievemark.llm.token_shards import END, PATTERN, TOKENIZER, Feistel, read_ranks, write_shards

    shards = write_shards(spark.read.parquet(f"{sf}/documents.parquet"), length=512, per_shard=100)
    index = {r.slot: r for r in shards.index.collect()}
    got = {r.slot: r for r in shards.records(spark).collect()}
    n = len(index)
    assert set(index) == set(got) == set(range(n))
    assert all(got[s]["at"] == s % 100 * shards.stride and got[s].shard == s // 100 for s in got)
    permutation = Feistel(n, "training-order")
    order = sorted(range(n), key=lambda s: int(permutation.number([s])[0]))
    ids = []
    for s in order:
        raw = bytes(got[s].ids)
        ids += [int.from_bytes(raw[i : i + 2], "little") for i in range(0, 2 * index[s].n_tokens, 2)]
    encode = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=read_ranks(TOKENIZER), special_tokens={})
    texts, own = [], []
    for x in ids:
        if x == END:
            texts.append(encode.decode(own))
            own = []
        else:
            own.append(x)
    assert sorted(texts) == sorted(t for _, t, _ in docs)
    assert len(rows(spark, sf, "op7_token_shards")) > 0


def test_warc(spark, sf):
    pages = [(r.page_id, (r.html or "").encode(), r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    first = {}
    for i, h, _ in pages:
        first[h] = min(i, first.get(h, i))
    want = {
        i: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h])
        for i, h, _ in pages
    }
    got = rows(spark, sf, "op9_warc")
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert [r.url_key for r in got] == sorted(r.url_key for r in got)


def test_quality(spark, sf, docs):
    want = {}
    for i, t, _ in docs:
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
        repeat = len({j for a in range(len(w) - 4) if windows[tuple(w[a : a + 5])] > 1 for j in range(a, a + 5)})
        failed = len(w) < 10 or 100 * repeat > 20 * len(w)
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, failed)
    got = rows(spark, sf, "op10_quality_rules")
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert not any(r.kept and r.base_failed for r in got)
    assert math.isclose(sum(r.kept for r in got) / sum(not r.base_failed for r in got), 1, abs_tol=0.2)


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P
    from sievemark.llm.quality import quality_rules

    rows_ = spark.read.parquet(f"{sf}/documents.parquet")
    one = P.quality(spark, rows_, sf).select("doc_id", "text").collect()
    kept = {r.doc_id for r in quality_rules(rows_).where("kept").collect()}
    assert {r.doc_id for r in one} == kept
    left = spark.createDataFrame(rows_.where(rows_.doc_id.isin(list(kept))).collect(), rows_.schema)
    two = P.near_duplicates(spark, left, sf).collect()
    roots = components([d for d in docs if d[0] in kept], 5, 80)
    assert {r.doc_id for r in two} == {i for _, i in roots.values()}
    two = spark.createDataFrame(two, rows_.schema)
    three = P.decontamination(spark, two, sf).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    mine = [d for d in docs if d[0] in {r.doc_id for r in two.select("doc_id").collect()}]
    assert {r.doc_id for r in three} == {d[0] for d in mine} - {x[0] for x in contained(mine, items)}
    four = P.mixing(spark, spark.createDataFrame(three, rows_.schema), sf)
    assert four.columns == rows_.columns
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three}
    assert P.run(spark, sf).count() > 0
