"""N-gram Jaccard join by prefix trees.

Every text is a set of word n-grams, held as 64-bit hashes in one global order: by hash,
the heavy ones (found in many texts) last. Two sets that reach the similarity share an
n-gram among the first quarter of each, so:

1. passes count how many sets each n-gram leads, until no more that lead are heavy; the
   list of the heavy is bounded, and serves the order alone;
2. a pass sends the leading n-grams to buckets, packed into one blob for each batch and
   bucket; a bucket counts the pairs that meet at an n-gram, or chains the sets where many
   meet, and pairs that share too few leading n-grams to be similar are left;
3. connected sets are a family; families are found by distributed components;
4. each family's whole sets go into a trie in the global order. A set is probed against
   the smaller ones before it: the descent shares the overlap of common beginnings,
   leaves subtrees whose remaining lengths cannot reach the needed overlap, and those
   already linked to the probe. Families over TILE sets are compared in tiles of blocks.

Sets that are equal are one node throughout, so exact copies are never compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: Similarity at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Leading more sets than this, an n-gram is heavy; so many are known at most, the commonest
#: first. The order they are put in changes the cost, never the result.
HEAVY, MAX_HEAVY = 16, 2_000_000
#: The heavy are looked for so many times at most; a set leads with a quarter, so all of it has led after four.
ROUNDS = 6
#: Sets that meet at an n-gram are paired up to so many, and chained beyond.
CROWD = 24
SURE = 1 << 40
TILE = 3000

_STEP = np.random.default_rng(77).integers(1, 2**63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash), each pair once and sorted, of the n-grams of the texts at[0]..at[-1].

    A text of fewer words than an n-gram has them all as its one n-gram; one without
    words has none.
    """
    data = common.LOWER[data]
    begin, end, of = common.words_of(data, at)
    w = common.string_hashes(common.prefix_sums(data), begin, end)
    count = np.bincount(of, minlength=len(at) - 1)
    first = np.cumsum(count) - count
    hashes, owners = [], []
    if len(w) >= WORDS:
        n = len(w) - WORDS + 1
        h = w[:n] * _STEP[0]
        for k in range(1, WORDS):
            h += w[k : k + n] * _STEP[k]
        whole = of[:n] == of[WORDS - 1 :]
        hashes.append(common.mix(h[whole]))
        owners.append(of[:n][whole])
    for c in range(1, WORDS):
        short = np.flatnonzero(count == c)
        h = np.full(len(short), np.uint64(c) * _STEP[WORDS])
        for k in range(c):
            h += w[first[short] + k] * _STEP[k]
        hashes.append(common.mix(h))
        owners.append(short)
    h, of = np.concatenate(hashes), np.concatenate(owners)
    order = by_text(h, of)
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def by_text(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The order of hashes by text number and then value: one sort of packed keys, and a second only where their top bits tie."""
    if not len(of) or int(of.max()) >= 1 << 20:
        return np.lexsort((h, of))
    packed = of.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)
    order = np.argsort(packed)
    packed, sorted_ = packed[order], h[order]
    return np.lexsort((h, of)) if ((packed[1:] == packed[:-1]) & (sorted_[1:] != sorted_[:-1])).any() else order


def sizes_and_prints(of: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit fingerprint of each text's set."""
    size = np.bincount(of, minlength=n_texts)
    ends = np.cumsum(size)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(common.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    fp = common.mix((sums[ends] - sums[ends - size]) ^ size.astype(np.uint64))
    return size, fp.view(np.int64)


def _among(heavy: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of h are among the sorted hashes."""
    if not len(heavy):
        return np.zeros(len(h), bool)
    return heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h


def _ordered(of: np.ndarray, h: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same pairs with the heavy n-grams of each text last; heavy: sorted hashes."""
    if not len(heavy) or not len(h):
        return of, h, np.zeros(len(h), bool)
    late = _among(heavy, h)
    order = np.argsort(of << 1 | late, kind="stable")
    return of[order], h[order], late[order]


def _chunked(batch: pa.RecordBatch, column: int):
    whole, at = common.texts_of(batch.column(column))
    for i, j in common.chunks(at):
        of, h = shingles(whole[at[i] : at[j]], at[i : j + 1] - at[i])
        yield i, j, of, h, *sizes_and_prints(of, h, j - i)


def _leads(size: np.ndarray) -> np.ndarray:
    """How many n-grams lead a set of this size: two similar sets share one among these."""
    return size - (size * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1


def sets_of(docs: DataFrame, key: str, text: str, heavy: np.ndarray) -> DataFrame:
    """(id, n, fp, light, last) of every row: its set's size and fingerprint, how many of the
    leading n-grams are not heavy, and the last of these (its order, as a signed number).
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def work(batch: pa.RecordBatch):
        for i, j, of, h, size, fp in _chunked(batch, 1):
            of, h, late = _ordered(of, h, shared.value)
            first = np.cumsum(size) - size
            lead = (np.arange(len(h)) - first[of] < _leads(size)[of]) & ~late
            light = np.bincount(of, lead, j - i).astype(np.int32)
            last = np.zeros(j - i, np.int64)
            some = light > 0
            last[some] = (h[first[some] + light[some] - 1] ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(fp), pa.array(light), pa.array(last)], names=["id", "n", "fp", "light", "last"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(common.batched(work), "id long, n long, fp long, light int, last long")


def _leading(of: np.ndarray, h: np.ndarray, size: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which pairs are not heavy and lead their text once the heavy ones are last."""
    light = ~_among(heavy, h)
    before = np.cumsum(light) - light
    first = np.r_[before, 0][np.minimum(np.cumsum(size) - size, len(h))]
    return light & (before - first[of] < _leads(size)[of])


def _crowded(docs: DataFrame, text: str, before: np.ndarray | None, heavy: np.ndarray, room: int) -> np.ndarray:
    """Hashes of the n-grams, at most room, that lead over HEAVY sets with heavy last, counted where they didn't lead with before last."""
    n_buckets = common.shuffle_partitions(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((before, heavy))

    def send(batch: pa.RecordBatch):
        before, heavy = shared.value
        parts = []
        for _, _, of, h, size, fp in _chunked(batch, 0):
            _, one = np.unique(fp, return_index=True)
            new = np.zeros(len(fp), bool)
            new[one] = True
            keep = _leading(of, h, size, heavy) & new[of]
            if before is not None:
                keep &= ~_leading(of, h, size, before)
            parts.append(h[keep])
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        bucket = (h % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, n, bucket = h[order], n[order].astype(np.int32), bucket[order]
        used, first = np.unique(bucket, return_index=True)
        ends = [*first[1:].tolist(), len(h)][: len(first)]
        blobs = [[x[b:e].tobytes() for b, e in zip(first.tolist(), ends, strict=True)] for x in (h, n)]
        return pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "h", "n"])

    def count(table: pa.Table) -> pa.Table:
        h, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("n", np.int32)))
        u, inverse = np.unique(h, return_inverse=True)
        n = np.bincount(inverse, n, len(u)).astype(np.int64)
        return pa.table({"h": u[n > HEAVY].view(np.int64), "n": n[n > HEAVY]})

    found = docs.select(text).mapInArrow(common.batched(send), "bucket int, h binary, n binary").groupBy("bucket").applyInArrow(count, "h long, n long")
    found = common.written(found, "heavy")
    top = found if found.count() <= room else found.orderBy(F.desc("n"), "h").limit(room)
    hashes = top.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    common.discard(found)
    return hashes


def heavy_ngrams(docs: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of the n-grams, at most MAX_HEAVY, that lead over HEAVY sets.

    Once the heavy ones are last, others lead in their place, and of a line that many
    texts have these are as heavy; so they are looked for again in the new order.
    """
    before, heavy = None, np.zeros(0, np.uint64)
    for _ in range(ROUNDS):
        new = _crowded(docs, text, before, heavy, MAX_HEAVY - len(heavy))
        if not len(new):
            break
        before, heavy = heavy, np.union1d(heavy, new)
    return heavy


def candidate_links(docs: DataFrame, text: str, heavy: np.ndarray, nodes: DataFrame) -> DataFrame:
    """(a, b) fingerprints that connect every pair of similar sets; nodes: fp, n, light, last.

    Where few sets meet at an n-gram they are counted pair by pair, and a pair stays if what
    its leading n-grams share and what may follow them can make it similar. Where many
    meet, or at a heavy n-gram, they are chained by size.
    """
    spark = docs.sparkSession
    n_buckets = common.shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(heavy)

    def send(batch: pa.RecordBatch):
        parts = []
        for _, _, of, h, size, fp in _chunked(batch, 0):
            of, h, _ = _ordered(of, h, shared.value)
            first = np.cumsum(size) - size
            keep = np.arange(len(h)) - first[of] < _leads(size)[of]
            parts.append((h[keep], fp[of[keep]], size[of[keep]].astype(np.int32)))
        h, fp, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = (h % np.uint64(n_buckets)).astype(np.int32)
        order = np.lexsort((fp, h, bucket))
        same = np.zeros(len(h), bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (fp[order][1:] == fp[order][:-1])
        order = order[~same]
        h, fp, n, bucket = h[order], fp[order], n[order], bucket[order]
        used, first = np.unique(bucket, return_index=True)
        ends = [*first[1:].tolist(), len(h)][: len(first)]
        blobs = [[x[b:e].tobytes() for b, e in zip(first.tolist(), ends, strict=True)] for x in (h, fp, n)]
        return pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "h", "fp", "n"])

    def meet(table: pa.Table) -> pa.Table:
        heavy = shared.value
        h, fp, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("fp", np.int64), ("n", np.int32)))
        order = np.lexsort((fp, n, h))
        h, fp, n = h[order], fp[order], n[order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        h, fp, n = h[new], fp[new], n[new]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.diff(np.r_[begin, len(h)])
        crowd = many > CROWD
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, h[begin]), len(heavy) - 1)
            crowd |= heavy[at] == h[begin]
        crowded = np.repeat(crowd, many)
        near = n[:-1] * DENOMINATOR >= n[1:] * NUMERATOR
        chained = np.flatnonzero((h[1:] == h[:-1]) & near & crowded[1:])
        a, b, c = [fp[chained]], [fp[chained + 1]], [np.full(len(chained), SURE)]
        left = np.flatnonzero(~crowded & np.repeat(many > 1, many))
        for gap in range(1, CROWD):
            left = left[left + gap < len(h)]
            left = left[h[left + gap] == h[left]]
            x = left[n[left] * DENOMINATOR >= n[left + gap] * NUMERATOR]
            a.append(fp[x])
            b.append(fp[x + gap])
            c.append(np.ones(len(x), np.int64))
        a, b, c = (np.concatenate(x) for x in (a, b, c))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": a[first], "b": b[first], "c": np.add.reduceat(c, first) if len(first) else c})

    sent = docs.select(text).mapInArrow(common.batched(send), "bucket int, h binary, fp binary, n binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    x, y = (nodes.select(*(F.col(c).alias(c + k) for c in ("fp", "n", "light", "last"))) for k in "xy")
    pairs = met.join(x, met.a == x.fpx).join(y, met.b == y.fpy)
    rest_x, rest_y = F.col("nx") - F.col("lightx"), F.col("ny") - F.col("lighty")
    rest = F.when(F.col("lastx") < F.col("lasty"), rest_x).when(F.col("lastx") > F.col("lasty"), rest_y).otherwise(F.least(rest_x, rest_y))
    enough = (NUMERATOR + DENOMINATOR) * (F.col("c") + rest) >= NUMERATOR * (F.col("nx") + F.col("ny"))
    return pairs.where((F.col("c") >= SURE) | enough).select("a", "b")


class Trie:
    """Prefix tree of sorted token arrays, for probes by overlap."""

    class Node:
        __slots__ = ("label", "children", "longest", "least", "sets", "members")

        def __init__(self, label: np.ndarray):
            self.label, self.children, self.longest, self.least, self.sets, self.members = label, {}, 0, 1 << 60, [], None

    def __init__(self, n_tokens: int, n_sets: int):
        self.root = self.Node(np.zeros(0, np.int64))
        self.held = np.zeros(n_tokens, bool)
        self.parent = list(range(n_sets))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)

    def add(self, number: int, tokens: np.ndarray) -> None:
        n, node, rest = len(tokens), self.root, tokens
        while True:
            node.least = min(node.least, n)
            node.longest = max(node.longest, len(rest))
            node.members = number if node.members is None else node.members if node.members >= 0 and self.find(node.members) == self.find(number) else -1
            if not len(rest):
                node.sets.append((number, n))
                return
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = self.Node(rest)
                rest = rest[:0]
            else:
                m = min(len(child.label), len(rest))
                differ = np.flatnonzero(child.label[:m] != rest[:m])
                m = int(differ[0]) if len(differ) else m
                if m < len(child.label):
                    upper = self.Node(child.label[:m])
                    upper.longest, upper.least, upper.members = child.longest + len(child.label) - m, child.least, child.members
                    child.label = child.label[m:]
                    upper.children[child.label[0]] = child
                    node.children[rest[0]] = child = upper
                rest = rest[m:]
            node = child

    def probe(self, number: int, tokens: np.ndarray, linked) -> None:
        """Link `number` to the sets of the tree that are similar; linked(y): is y worth it."""
        n, held = len(tokens), self.held
        held[tokens] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            own = self.find(number)
            if node.members is not None and node.members >= 0 and self.find(node.members) == own:
                continue
            for y, size in node.sets:
                if self.find(y) != own and linked(y) and (NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (n + size):
                    self.link(number, y)
            for child in node.children.values():
                label = child.label
                both = overlap + int(np.count_nonzero(held[label]))
                left = min(n - both, child.longest)
                if child.longest and left > 0:
                    left = min(left, n - int(np.searchsorted(tokens, label[-1], "right")))
                if (NUMERATOR + DENOMINATOR) * (both + left) >= NUMERATOR * (n + child.least):
                    stack.append((child, both))
        held[tokens] = False


def link_family(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id linked) of the sets of a family or tile; sides 0 and 1 are compared
    with each other, and within themselves only if all are of one side.
    """
    flat = np.concatenate(sets)
    distinct, rank = np.unique(flat, return_inverse=True)
    order = np.lexsort((distinct, distinct & np.uint64(1)))
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    ranks = place[rank]
    ends = np.cumsum([len(s) for s in sets])
    parts = [np.sort(ranks[e - len(s) : e]) for s, e in zip(sets, ends.tolist(), strict=True)]
    by_size = sorted(range(len(sets)), key=lambda k: (len(parts[k]), ids[k]))
    trie = Trie(len(distinct), len(sets))
    two = len(set(sides.tolist())) > 1
    for k in by_size:
        side = sides[k]
        trie.probe(k, parts[k], lambda y, side=side: not two or sides[y] != side)
        trie.add(k, parts[k])
    least: dict[int, int] = {}
    roots = [trie.find(k) for k in range(len(sets))]
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, ids[k]), ids[k])
    return ids, np.array([least[r] for r in roots], np.int64)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_shingles long, component_id long.

    component_id is the least key reachable over links (Jaccard at least 3/4); null and
    empty texts, and those of white space alone, have no n-gram and link with nothing.
    Keys are whole numbers, cast to long. Rows of one key are one node; rows with a null key are left out. An empty table gives
    an empty table; other columns are not read.
    """
    docs = docs.where(F.col(key).isNotNull()).select(key, text)
    spark = docs.sparkSession
    heavy = heavy_ngrams(docs, text)
    rows = common.written(sets_of(docs, key, text, heavy), "sets")
    nodes = rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "light", "last")))
    families = common.components(candidate_links(docs, text, heavy, nodes), "a", "b", "families")
    nodes = nodes.select("fp", "rep")
    families = common.written(families.select(F.col("node").alias("fp"), F.col("component_id").alias("family")).join(nodes, "fp"), "families")
    large = families.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > TILE)
    large = large.select("family", F.ceil(F.col("size") / (TILE / 2)).cast("int").alias("blocks"))
    wanted = common.written(families.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "members")
    shared = spark.sparkContext.broadcast(heavy)

    def whole_sets(batch: pa.RecordBatch):
        names = batch.schema.names
        fps = batch.column(names.index("fp")).to_numpy(zero_copy_only=False)
        for i, j, of, h, size, fp in _chunked(batch, names.index(text)):
            of, h, late = _ordered(of, h, shared.value)
            h = (h & ~np.uint64(1)) | late.astype(np.uint64)
            ends = np.cumsum(size) * 8
            raw = h.tobytes()
            keep = np.flatnonzero(fp == fps[i:j])
            blobs = pa.array([raw[ends[k] - 8 * size[k] : ends[k]] for k in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)).take(pa.array(keep + i)) for c in ("rep", "fp", "family", "blocks")), blobs], names=["rep", "fp", "family", "blocks", "tokens"])

    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text)).join(common.small(wanted), "rep").select("rep", "fp", "family", "blocks", text)
    members = texts.mapInArrow(common.batched(whole_sets), "rep long, fp long, family long, blocks int, tokens binary")
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    n_parts = 2 * common.shuffle_partitions(spark)
    members = members.withColumn("part", F.pmod(F.xxhash64("family", "i", "j"), F.lit(n_parts)))

    def link(table: pa.Table) -> pa.Table:
        rep, family, i, j, own = (table.column(c).to_numpy() for c in ("rep", "family", "i", "j", "own"))
        tokens = table.column("tokens")
        order = np.lexsort((rep, j, i, family))
        changes = np.flatnonzero(np.r_[True, (family[order][1:] != family[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])])
        out = [np.zeros((2, 0), np.int64)]
        for b, e in zip(changes.tolist(), [*changes[1:].tolist(), len(order)], strict=True):
            if e - b > 1:
                at = order[b:e]
                out.append(np.stack(link_family(rep[at], own[at], [np.frombuffer(tokens[int(k)].as_py(), np.uint64) for k in at])))
        a, b = np.concatenate(out, 1)
        return pa.table({"a": a[a != b], "b": b[a != b]})

    links = members.groupBy("part").applyInArrow(link, "a long, b long")
    linked = common.components(links, "a", "b", "linked").select(F.col("node").alias("rep"), "component_id")
    labels = nodes.join(linked, "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("class_id"))
    found = rows.select("id", "n", "fp").join(labels, "fp", "left")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, by word 5-grams."""
    return join(common.read(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents where doc_id is not null),
s as (
  select distinct doc_id, hash(list_slice(w, i, i + least(len(w), 5) - 1)) h
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n, min(h) least_h, sum(h) sum_h from s group by doc_id),
c as (select n, least_h, sum_h, min(doc_id) rep from n group by n, least_h, sum_h),
r as (select s.doc_id, s.h, c.n from s join c on s.doc_id = c.rep),
p as (
  select a.doc_id x, b.doc_id y from r a join r b on a.h = b.h and a.doc_id < b.doc_id and 100 * a.n >= 75 * b.n and 100 * b.n >= 75 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e as (select x, y from p union all select y, x from p),
t as (select x, y from e union select t.x, e.y from t join e on t.y = e.x),
m as (select x, min(y) y from t group by x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles,
  case when n.n is null then d.doc_id else least(c.rep, coalesce(m.y, c.rep)) end component_id
from d left join n on d.doc_id = n.doc_id left join c on n.n = c.n and n.least_h = c.least_h and n.sum_h = c.sum_h left join m on c.rep = m.x
"""
