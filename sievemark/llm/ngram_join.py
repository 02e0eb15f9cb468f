"""Self-join of documents on the Jaccard similarity of their word n-grams, by vertical partitioning.

All n-grams have one global order, and fragments of that order cut every document's set into parts. Partial overlaps are
counted fragment by fragment and summed for each pair, so that no task holds a group of long documents.

* Documents with equal sets form one class, and classes are joined, not documents; copies cost one row each.
* A first fragment, by hash, is counted for all classes: an n-gram that no other class has cannot be shared, and a class with
  more such n-grams than the threshold leaves room for can have no link. Most documents end here. Within a task n-grams that
  several classes have are settled at once, so that a passage in every document sends one entry for each task.
* For the classes that are left all n-grams are counted, and the global order is by how many classes have them, then by hash.
  A linked pair shares an n-gram among the first of both sets (the prefix, whose length follows from the threshold). Where
  the first shared n-gram stands in both sets bounds the overlap from above, and that is tested before a pair is made.
* Within the classes that share a prefix n-gram not all pairs are made. Each class is first compared with the centre, the
  class with the smallest share of n-grams of its own, which by the same bound is the likeliest partner of all others. Linked
  classes become components; only pairs of different components that pass the bound are compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, materialise, restricted, row_key, small_batches
from .components import connected_components
from .textvec import LOWER, Block, blocks, mix, shingle_hashes, span_hashes

FRAGMENTS = 16
#: The first fragment in order of hash: so many sixteenths of all n-grams.
FIRST = 5
_LIMIT = np.uint64(FIRST << 60)
#: N-grams of the first fragment that a task holds before it sends them on.
TOGETHER = 3 << 18


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their texts, by text and hash; fewer than ``k`` words are one shingle of their own kind."""
    starts, ends, text = block.words()
    words = span_hashes(LOWER[block.data], starts, ends)
    h, at = shingle_hashes(words, text, k)
    of = text[at]
    n_words = np.bincount(text, minlength=block.n)
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(few):
        first = np.cumsum(n_words)[few] - n_words[few]
        whole = mix(np.uint64(1) + n_words[few].astype(np.uint64))
        for i in range(k - 1):
            has = i < n_words[few]
            whole = np.where(has, mix(whole + words[np.minimum(first + i, len(words) - 1)]), whole)
        h, of = np.concatenate((h, whole)), np.concatenate((of, few))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[fresh], of[fresh]


def _keys(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit name of each text's set, and its size."""
    size = np.bincount(of, minlength=n)
    edge = np.concatenate(([0], np.cumsum(size)))
    run = np.concatenate(([np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return mix(run[edge[1:]] - run[edge[:-1]] + size.astype(np.uint64)), size


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values.view(np.int64)))


def _packed(ascending: np.ndarray) -> bytes:
    """Differences of ascending numbers, all first bytes, then all second bytes and so on: the high ones compress to nothing."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


FIRST_PASS = "id {id}, row long, n long, key long, chunk long, part int, grams binary, keys binary, marked binary"


def _first_pass(k: int, percent: int, parts: int):
    """Rows of three kinds: one for each text; the first fragment's n-grams, cut into ``parts`` ranges; one for each chunk.

    A chunk is what a task holds together, and of a class it has the first text. N-grams of the fragment that only one class
    of the chunk has travel with that class (``grams``, ``keys``), the others once each (``marked``). The chunk's own row,
    part -1, has for each class the number of the former beyond what the threshold leaves room for, and the text.
    """
    edges = np.array([(FIRST << 60) * i // parts for i in range(1, parts)], np.uint64)

    def settled(held: list, chunk: int) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([x[0] for x in held])
        rows, size, keys = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        base = np.cumsum([0] + [len(x[1]) for x in held[:-1]])
        gram, of = np.concatenate([x[4] for x in held]), np.concatenate([x[5] + b for x, b in zip(held, base)])
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        first &= size > 0
        gram, of = gram[first[of]], of[first[of]]
        order = np.argsort(gram, kind="stable")
        gram, of = gram[order], of[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        lone = new.copy()
        lone[:-1] &= new[1:]
        over = np.bincount(of[lone], minlength=len(keys)) - (size - (percent * size + 99) // 100)
        nothing, number = pa.nulls(len(keys)), pa.nulls(1, pa.int64())
        names = [f.split()[0] for f in FIRST_PASS.split(", ")]
        sent = [nothing.cast(pa.int64()), nothing.cast(pa.int32()), *[nothing.cast(pa.binary())] * 3]
        yield pa.RecordBatch.from_arrays([ids, pa.array(rows), pa.array(size.astype(np.int64)), pa.array(keys.view(np.int64), mask=size == 0), *sent], names=names)
        own = [pa.array([x[first].tobytes()]) for x in (over, keys, rows)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), *[number] * 3, pa.array([chunk]), pa.array([-1], pa.int32()), *own], names=names)
        marked, keys, gram = gram[new & ~lone], keys[of[lone]], gram[lone]
        cut, cut_marked = (np.concatenate(([0], np.searchsorted(x, edges), [len(x)])) for x in (gram, marked))
        used = [p for p in range(parts) if cut[p] < cut[p + 1] or cut_marked[p] < cut_marked[p + 1]]
        if used:
            n = len(used)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, ids.type), none, none, none, pa.array(np.full(n, chunk)), pa.array(used, pa.int32()),
                    pa.array([_packed(gram[cut[p] : cut[p + 1]]) for p in used]), pa.array([keys[cut[p] : cut[p + 1]].tobytes() for p in used]),
                    pa.array([_packed(marked[cut_marked[p] : cut_marked[p + 1]]) for p in used]),
                ],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0
        for part, block in blocks(batches, "text"):
            h, of = shingle_sets(block, k)
            keys, size = _keys(h, of, block.n)
            in_first = h < _LIMIT
            held.append((part.column(0), part.column(1).to_numpy(), size, keys, h[in_first], of[in_first]))
            n += int(in_first.sum())
            if n >= TOGETHER:
                yield from settled(held, chunk)
                chunk, held, n = chunk + 1, [], 0
        if held:
            yield from settled(held, chunk)

    return run


ANSWERS = "chunk long, part int, grams binary, keys binary, marked binary"


def _shared_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk that sent n-grams of a range: classes (``keys``), and how many of these (``grams``) others have as well."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    chunks, parts, grams, keys, marked = ([x for b in got for x in b.column(i).to_pylist()] for i in range(5))
    grams = [_unpacked(x) for x in grams]
    chunk = np.repeat(np.array(chunks, np.int64), [len(x) for x in grams])
    gram, key = np.concatenate(grams), np.concatenate([np.frombuffer(x, np.uint64) for x in keys])
    known = np.unique(np.concatenate([_unpacked(x) for x in marked]))
    if not len(gram):
        return
    order = np.argsort(gram, kind="stable")
    gram, key, chunk = gram[order], key[order], chunk[order]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    shared = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
    if len(known):
        shared |= known[np.minimum(np.searchsorted(known, gram[first]), len(known) - 1)] == gram[first]
    each = np.repeat(shared, np.diff(np.concatenate((first, [len(gram)]))))
    key, chunk = key[each], chunk[each]
    if not len(key):
        return
    order = np.lexsort((key, chunk))
    key, chunk = key[order], chunk[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]))))
    n = np.diff(np.concatenate((first, [len(key)])))
    key, chunk = key[first], chunk[first]
    cut = np.concatenate(([0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]))
    runs = list(zip(cut[:-1], cut[1:]))
    none = pa.nulls(len(runs)).cast(pa.binary())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(chunk[cut[:-1]]), pa.array([parts[0]] * len(runs), pa.int32()), pa.array([n[a:b].astype(np.int64).tobytes() for a, b in runs]),
            pa.array([key[a:b].tobytes() for a, b in runs]), none,
        ],
        names=[f.split()[0] for f in ANSWERS.split(", ")],
    )


def _able(chunk: pa.Table) -> pa.Table:
    """``(key, row)`` of the classes of a chunk that may have links, from its own row and the answers of all ranges."""
    parts = chunk.column("part").to_pylist()
    numbers = lambda name, i, kind: np.frombuffer(chunk.column(name)[i].as_py(), kind)
    own = parts.index(-1)
    keys, rows, over = numbers("keys", own, np.uint64), numbers("marked", own, np.int64), numbers("grams", own, np.int64).copy()
    order = np.argsort(keys)
    for i in (i for i, p in enumerate(parts) if p >= 0):
        at = order[np.searchsorted(keys, numbers("keys", i, np.uint64), sorter=order)]
        over[at] -= numbers("grams", i, np.int64)
    may = over <= 0
    return pa.table({"key": keys[may].view(np.int64), "row": rows[may]})


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches, "text"):
            h, of = shingle_sets(block, k)
            keys, size = _keys(h, of, block.n)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(size.astype(np.int64)), _lists(h, size)], names=["key", "n", "grams"])

    return run


def _least(n: Column, percent: int) -> Column:
    """The smallest overlap that a set of ``n`` can have with one it is linked with."""
    return F.ceil(n * percent / 100)


class _Join:
    """The classes that may have links: their n-grams in the global order, prefixes and links."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.percent = percent
        posts = sets.select("key", "n", F.explode("grams").alias("gram"))
        # counted with a map-side combine first; the join can split an n-gram that very many classes have
        counts = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        shared = materialise(posts.join(counts, "gram"), "shared")
        able = shared.groupBy("key", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= _least(F.col("n"), percent))
        able = materialise(able.select("key", "m"), "able")
        live = restricted(shared, able.select("key"), "key").join(able, "key")
        cell = (F.floor(4 * F.log2("df")) * FRAGMENTS + F.shiftrightunsigned("gram", 60)).cast("int")
        self.live = materialise(live.select("key", "n", "m", "gram", "df", cell.alias("cell")), "live")
        discard(shared, able)
        self.fragment = self._fragments()
        rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "gram"))
        placed = self.live.withColumn("own", F.col("n") - F.col("m")).withColumn("pos", F.col("own") + rank - 1)
        prefix = placed.where(F.col("pos") <= F.col("n") - _least(F.col("n"), percent))
        self.prefix = materialise(prefix.select("gram", "key", "n", "own", "pos"), "prefix")

    def _fragments(self) -> DataFrame:
        """``(cell, fragment)``: the order of n-grams cut where its parts hold about equally many.

        A cell is a range of that order, by the logarithm of the count and four bits of hash: some 2,500 at any size.
        """
        found = self.live.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).orderBy("cell").toArrow().to_pydict()
        count = np.array(found["c"], np.int64)
        fragment = (np.cumsum(count) - count) * FRAGMENTS // max(1, int(count.sum()))
        table = pa.table({"cell": pa.array(found["cell"], pa.int32()), "fragment": pa.array(fragment.astype(np.int32))})
        return F.broadcast(self.live.sparkSession.createDataFrame(table))

    def fits(self, n1: Column, pos1: Column, n2: Column, pos2: Column) -> Column:
        """Whether two sets can be linked whose first shared n-gram stands at these places."""
        most = F.least(n1 - pos1, n2 - pos2)
        return 100 * most >= self.percent * (n1 + n2 - most)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those pairs ``(a, na, b, nb)`` whose overlap is large enough, as ``(a, b)``; ``pairs`` is used up."""
        members = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        grams = restricted(self.live.select("key", "gram", "cell"), members, "key").join(self.fragment, "cell")
        parts = materialise(grams.groupBy("key", "fragment").agg(F.collect_list("gram").alias("part")), "parts")
        a = parts.select(F.col("key").alias("a"), "fragment", F.col("part").alias("pa"))
        b = parts.select(F.col("key").alias("b"), "fragment", F.col("part").alias("pb"))
        partial = pairs.join(b, "b").join(a, ["a", "fragment"]).select("a", "na", "b", "nb", F.size(F.array_intersect("pa", "pb")).alias("shared"))
        summed = partial.groupBy("a", "na", "b", "nb").agg(F.sum("shared").alias("shared"))
        linked = summed.where(100 * F.col("shared") >= self.percent * (F.col("na") + F.col("nb") - F.col("shared")))
        links = materialise(linked.select("a", "b"), "links")
        discard(pairs, parts)
        return links

    def labels(self) -> DataFrame:
        """``(node, label)`` of all linked classes."""
        own = F.struct((F.col("own") / F.col("n")).alias("share"), "key", "n", "pos")
        centre = self.prefix.groupBy("gram").agg(F.min(own).alias("c"))
        met = self.prefix.join(centre, "gram").where("key <> c.key").where(self.fits(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
        pairs = met.select(F.col("c.key").alias("a"), F.col("c.n").alias("na"), F.col("key").alias("b"), F.col("n").alias("nb")).distinct()
        links = self.links(materialise(pairs, "pairs"))

        met = connected_components(links)
        marked = self.prefix.join(met.withColumnRenamed("node", "key"), "key", "left")
        marked = materialise(marked.select("gram", "key", "n", "pos", F.coalesce("label", "key").alias("label")), "marked")
        discard(met)
        # a row can only have a partner in the component that comes first around its n-gram, or the next if that is its own
        soonest = marked.groupBy("gram", "label").agg(F.min("pos").alias("p"))
        one = soonest.groupBy("gram").agg(F.min(F.struct("p", "label")).alias("one"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        two = soonest.join(one, "gram").where("label <> one.label").groupBy("gram").agg(F.min("p").alias("two"), F.first("one").alias("one"))
        partner = F.when(F.col("label") == F.col("one.label"), F.col("two")).otherwise(F.col("one.p"))
        open_ = marked.join(two, "gram").where(100 * (F.col("n") - F.col("pos")) >= self.percent * (F.col("n") + partner))
        open_ = materialise(open_.select("gram", "key", "n", "pos", "label"), "open")
        discard(marked)
        x, y = (open_.select("gram", *(F.col(c).alias(f"{c}{i}") for c in ("key", "n", "pos", "label"))) for i in (1, 2))
        apart = (F.col("label1") != F.col("label2")) & (F.col("key1") < F.col("key2")) & self.fits(*(F.col(c) for c in ("n1", "pos1", "n2", "pos2")))
        rest = x.join(y, "gram").where(apart).select(F.col("key1").alias("a"), F.col("n1").alias("na"), F.col("key2").alias("b"), F.col("n2").alias("nb"))
        more = self.links(materialise(rest.distinct(), "pairs"))
        discard(open_, self.prefix, self.live)
        labels = connected_components(links.unionByName(more))
        discard(links, more)
        return labels


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` of each row: the smallest id that similar documents connect it with.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of ``k``-word shingles (A-Z
    lower-cased). A text of fewer words is one shingle; null, empty and blank texts have no shingles and no links. Null ids
    name a component only where it has no other. Repeated rows and repeated ids are rows like others; rows without shingles
    are their own component. Other columns are ignored, whatever their names, and an empty table gives an empty result.
    Texts of any length are taken whole. Shingles and classes are known by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = materialise(texts.mapInArrow(_first_pass(k, percent, parts), FIRST_PASS.format(id=kind)), "first")
    sent = first.where("part is not null").select(*(f.split()[0] for f in ANSWERS.split(", ")))
    answers = sent.where("part >= 0").repartitionById(parts, "part").mapInArrow(_shared_in_part, ANSWERS)
    able = sent.where("part < 0").unionByName(answers).groupBy("chunk").applyInArrow(_able, "key long, row long")
    able = materialise(able.groupBy("key").agg(F.min("row").alias("row")).select("row"), "candidates")
    rows = first.where("part is null")
    known = materialise(rows.select("id", "n", "key"), "classes")
    discard(first)

    sets = restricted(texts, able, "row").select("text").mapInArrow(_sets(k), "key long, n long, grams array<long>")
    sets = materialise(sets.dropDuplicates(["key"]), "sets")  # a row that is repeated brings its class again
    join = _Join(sets, percent)
    discard(sets, able)
    labels = join.labels()

    classes = known.where("key is not null").groupBy("key").agg(F.min("id").alias("least"))
    classes = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    roots = classes.groupBy("label").agg(F.min("least").alias("component"))
    out = known.join(classes.join(roots, "label").select("key", "component"), "key", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that have the smallest id of their component; of repeated rows one stays.

    Rows with equal ids are told apart by their text. Other rules as in ``jaccard_components``.
    """
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    narrow = keyed.select(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("id"), F.col(text_col).alias("text"))
    joined = jaccard_components(narrow, k, percent, "id", "text")
    state = joined.groupBy("id").agg(F.max(F.col("id") != F.col("component_id")).alias("gone"), F.count(F.lit(1)).alias("n"))
    state = materialise(state.select(F.col("id.row").alias("__row"), "gone", "n").where("gone or n > 1"), "joined")
    single = restricted(keyed, state.select("__row"), "__row", "left_anti")
    repeated = restricted(keyed, state.where("not gone").select("__row"), "__row").dropDuplicates(["__row"])
    return single.unionByName(repeated).drop("__row")
