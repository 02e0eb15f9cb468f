"""The filter audit, the piece codec and the alignment against brute force and the libraries, whole texts and odd ones."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import align, filter_audit, pieces, queries
from sievemark.llm.queries import BYTES, PIECES

CLASHES = ("id", "row", "part", "mask", "n", "pair", "pairs", "digest", "ids", "total", "first", "good")
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
ODD = [
    None, "", " ", "  two  spaces ", "\n\t", "▁mark", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "日本語の文字 テスト", "é é ß ﬁ Ａ　b", "😀😀 x", "\x00\x01",
    "x" * 3000, "ab" * 20000 + " " * 500 + "日本" * 300, "word " * 50_000, "WORDS IN CAPITALS and #marks", "#$%&*|",
]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(ODD)] + [(None, "no id", None), (1, "again", "s1"), (1, "again", "s1"), (99, "again", None)]
    return spark.createDataFrame([(*r, *("x",) * len(CLASHES)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_model(PIECES))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# filter audit


def test_plain_changes_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        for k in [None, *filter_audit.swaps(n)]:
            if k is not None:
                order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len([None, *filter_audit.swaps(n)]) == len(list(itertools.permutations(range(n))))


def brute_audit(rows, labels):
    fails, smallest = {}, {}
    for k, (doc, text, _) in enumerate(rows):
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    for k, (doc, text, _) in enumerate(rows):
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails[k] = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc is not None and smallest[text] < doc,
        }
    out = {}
    for part in {r[2] or "" for r in rows}:
        own, shapley = [k for k, r in enumerate(rows) if (r[2] or "") == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                here = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                shapley[f] += len(here)
                lost = lambda c: sum(1 for k in here if any(lab[0] is not None and lab[0] == rows[k][0] and lab[c] == 1 for lab in labels))  # noqa: B023,E731
                lone = sum(1 for k in own if fails[k][f] and sum(fails[k].values()) == 1)
                out[part, "".join(order), step] = [len(left), len(here), sum(fails[k][f] for k in gone), lone, lost(1), lost(2), f]
                gone += here
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_audit_against_brute_force(spark, odd):
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (15, 1, 0), (15, 0, 1), (16, None, 1), (None, 1, 1), (99, 1, 1)]
    got = filter_audit.audit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in got.collect()}
    assert got == brute_audit(rows, labels) and len(got) == 4 * 600


def test_audit_counts_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "ccc", "\n", "ddd\x0b"], k=5000)).encode()
    whole = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    assert filter_audit.word_counts(text) == whole == (len(text.split()), len(set(text.split())))


def test_audit_of_nothing(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(odd.limit(0), none).count() == 0
    assert {r.good_lost for r in filter_audit.audit(odd, none).collect()} == {0}


# pieces


def test_codec_equals_the_library(codec, sp):
    for text in ODD:
        ids = codec.encode(text or "")
        assert ids.tolist() == sp.encode(text or "") and codec.decode(ids) == sp.decode(ids.tolist())
    r = random.Random(3)
    alphabet = [" ", "▁", "a", "t", "e", "\n", "\t", "é", "ß", "日", "本", "\x00", "é", "😀", "  ", "    ", "0", "-", "==", "the", " of", "\U00010330", "ing", "▁▁"]
    for _ in range(5000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        assert codec.encode(text).tolist() == sp.encode(text)
    for _ in range(5000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(32000), r.randrange(3), 28705]) for _ in range(r.randrange(9))]
        assert codec.decode(np.array(ids, int)) == sp.decode(ids)


def test_codec_forgets_and_stays_right(codec, sp, monkeypatch):
    small = pieces.Codec(codec.vocabulary)
    monkeypatch.setattr(pieces.Codec, "WORDS", 5)
    monkeypatch.setattr(pieces.Codec, "PAIRS", 7)
    for text in ("some words that are not many but more than five of them are here", "and others, again others"):
        assert small.encode(text).tolist() == sp.encode(text)
    assert len(small.words) <= 5 and len(small.older) <= 5 and small.pairs <= 7 and sum(map(len, small.fits)) <= 7


def test_last_token_of_every_prefix(codec, sp):
    word = "▁unbelievableness"
    for n in range(2, len(word) + 1):
        assert np.frombuffer(codec.word(word[:n]), np.int32)[-1] == sp.encode(word[1:n])[-1]


def test_sentencepiece_query(spark, sf, sp):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_sentencepiece(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = sp.encode(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_pieces_of_odd_rows(spark, odd, sp):
    got = pieces.decode_pieces(pieces.encode_pieces(odd, PIECES), PIECES).collect()
    want = Counter((r.doc_id, *sp.encode(r.text or ""), sp.decode(sp.encode(r.text or ""))) for r in odd.collect())
    assert Counter((r.id, *r.ids, r.text) for r in got) == want
    assert pieces.decode_pieces(pieces.encode_pieces(odd.limit(0), PIECES), PIECES).count() == 0
    null = spark.createDataFrame([(1, None)], "id long, ids array<int>")
    assert pieces.decode_pieces(null, PIECES).first().text == ""


# alignment


def brute_alignment(rows, hf, sp):
    """By bytes: which A and B token holds each byte of each text."""
    from sievemark.llm.align import byte_letters

    letters, out, links = byte_letters(), [], Counter()
    for doc, text in rows:
        a = b = []
        if text:
            target = f" {text}".encode()
            a, b = hf.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(letters[c] for c in hf.id_to_token(i)) for i in a]
            bytes_b = [bytes([i - 3]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) != target or b"".join(bytes_b) != target:
                a = b = []
        if not a:
            out.append((doc, 0, 0, [], []))
            continue
        at_a = [k for k, x in enumerate(bytes_a) for _ in x]
        at_b = [k for k, x in enumerate(bytes_b) for _ in x]
        overlaps = sorted(set(zip(at_a, at_b)))
        cuts = [k for k in range(1, len(at_a)) if at_a[k] != at_a[k - 1] and at_b[k] != at_b[k - 1]] + [len(at_a)]
        groups, before = [], 0
        for cut in cuts:
            groups.append(([a[k] for k in sorted(set(at_a[before:cut]))], [b[k] for k in sorted(set(at_b[before:cut]))]))
            before = cut
        pairs = [(a[i], b[j]) for i, j in overlaps]
        links.update(pairs)
        out.append((doc, len(a), len(b), groups, pairs))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(n, best.get(b, 0))
    spell = lambda ids: ",".join(map(str, ids))
    return Counter(
        (
            doc, n_a, n_b, len(groups), len(pairs), sum(len(x) * len(y) for x, y in groups), sha(";".join(f"{spell(x)}|{spell(y)}" for x, y in groups)) if n_a else "",
            sum(links[p] for p in pairs), sum(links[p] == best[p[1]] for p in pairs),
        )
        for doc, n_a, n_b, groups, pairs in out
    )


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_products", "groups_sha256", "count_sum", "n_best")


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_alignment_of_odd_rows(odd, hf, sp, frequent):
    got = align.align_tokenizers(odd, BYTES, PIECES, frequent=frequent).select("id", *ALIGNED)
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment([(r.doc_id, r.text) for r in odd.collect()], hf, sp)


def test_alignment_query(spark, sf, hf, sp):
    got = queries.op13_tokenizer_alignment(spark, sf).select("doc_id", *ALIGNED)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(rows, hf, sp)


def test_alignment_of_nothing(odd):
    assert align.align_tokenizers(odd.limit(0), BYTES, PIECES).count() == 0
    assert {r.n_a for r in align.align_tokenizers(odd.withColumn("text", F.lit(None)), BYTES, PIECES).collect()} == {0}
