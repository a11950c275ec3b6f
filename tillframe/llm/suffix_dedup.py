"""Suffix-array dedup: remove every byte inside a string of LENGTH bytes that starts elsewhere too.

Every string of LENGTH bytes is filed under its anchor, the GRAM-byte string in it with
the least hash (leftmost at ties), so equal strings are filed alike. The strings of one
anchor position form a run; a run is compared with the runs of equal anchors:

- runs whose anchor occurs once hold nothing repeated, and those equal as a whole with
  another run are repeated as a whole; both are settled by counting;
- the rest are sorted, in groups of one anchor: the suffixes from the anchor on, and the
  reversed texts before it, by deep-shallow sorting (multikey quicksort to a shallow
  depth, then a blind trie for each group that shares more). The two orders with their
  common-prefix lengths give, for each run, exactly the strings it shares;
- a group over GROUP different runs is first divided: each run into narrower ones, filed
  under all the bytes their strings have in common. At one string this is the string
  itself, so every group ends up small or settled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 400, 128
SPAN = LENGTH - GRAM + 1
GROUP = 1500
#: A group over GROUP is divided into ranges so wide, then narrower; at 1 it is settled.
WIDTHS = (64, 8, 1)
SHALLOW = 24


# ---------------------------------------------------------------- anchors


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first string, last string, gram hash, whole hash) of each run of data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = common.prefix_sums(data)
    _, down = common.powers(len(sums))
    grams = common.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    least = sliding_minimum(grams, SPAN)
    size = np.diff(at)
    valid = np.zeros(len(least), bool)
    marks = np.zeros(len(data) + 1, np.int32)
    big = size >= LENGTH
    marks[at[:-1][big]] += 1
    marks[at[1:][big] - LENGTH + 1] -= 1
    valid = np.cumsum(marks)[: len(least)] > 0
    start = valid.copy()
    start[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(start)
    if not len(first):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    ends = valid.copy()
    ends[:-1] &= start[1:] | ~valid[1:]
    last = np.flatnonzero(ends)
    found, window = [], np.arange(SPAN)
    while len(first):
        low = least[first]
        place = first + SPAN - 1
        search = np.flatnonzero((first == 0) | ~valid[first - 1] | (least[first - 1] <= low))
        for k in range(0, len(search), 4096):
            some = search[k : k + 4096]
            place[some] = first[some] + (grams[first[some, None] + window] == low[some, None]).argmax(1)
        stop = np.minimum(last, place)
        found.append((place, first, stop))
        more = stop < last
        first, last = stop[more] + 1, last[more]
    place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    of = np.searchsorted(at, first, "right") - 1
    return of, place, first, last, grams[place], common.string_hashes(sums, first, last + LENGTH)


def runs_of(docs: DataFrame) -> DataFrame:
    """docs: (k, text). One row per run: k, a, lo, hi, gram, body; a is the anchor's byte, lo..hi how far before it strings start."""

    def work(batch: pa.RecordBatch):
        whole, at = common.texts_of(batch.column(1))
        k = batch.column(0).to_numpy()
        for i, j in common.chunks(at):
            marks = at[i : j + 1] - at[i]
            of, a, first, last, gram, body = anchor_runs(whole[at[i] : at[j]], marks)
            begin = marks[of]
            yield pa.RecordBatch.from_arrays([pa.array(k[i + of]), pa.array((a - begin).astype(np.int64)), pa.array((a - last).astype(np.int32)), pa.array((a - first).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(body.view(np.int64))], names=["k", "a", "lo", "hi", "gram", "body"])

    return docs.mapInArrow(common.batched(work), "k long, a long, lo int, hi int, gram long, body long")


# ---------------------------------------------------------------- deep-shallow sorting


class BlindTrie:
    """Patricia tree over distinct strings: nodes know the byte where they branch, not what they skip."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, first

    def insert(self, number: int) -> None:
        s, node = self.strings[number], self.root
        while isinstance(node, list):
            depth, children = node
            c = s[depth] if depth < len(s) else -1
            node = children.get(c)
            if node is None:
                node = next(iter(children.values()))
        t = self.strings[node]
        same = common_prefix(s, t)
        mine, theirs = (s[same] if same < len(s) else -1), (t[same] if same < len(t) else -1)
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < same:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == same:
            node[1][mine] = number
            return
        new = [same, {mine: number, theirs: node}]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node)
        return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def deep_shallow_order(strings: list[bytes], known: int = 0) -> list[int]:
    """The order of strings, of which the first `known` bytes are the same; equal ones stay in sequence.

    Multikey quicksort goes SHALLOW bytes deep; what still agrees goes to a blind trie.
    """
    out: list[int] = []
    stack = [(list(range(len(strings))), known)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth < known + SHALLOW:
            keys = [strings[k][depth] if depth < len(strings[k]) else -1 for k in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [k for k, c in zip(group, keys, strict=True) if c < pivot]
            same = [k for k, c in zip(group, keys, strict=True) if c == pivot]
            more = [k for k, c in zip(group, keys, strict=True) if c > pivot]
            if more:
                stack.append((more, depth))
            if pivot < 0:
                if less:
                    stack.append((less, depth))
                out += same
            else:
                stack.append((same, depth + 1))
                if less:
                    stack.append((less, depth))
        else:
            equal: dict[bytes, list[int]] = {}
            for k in group:
                equal.setdefault(strings[k], []).append(k)
            distinct = [x[0] for x in equal.values()]
            trie = BlindTrie(strings, distinct[0])
            for k in distinct[1:]:
                trie.insert(k)
            for k in trie.order():
                out += equal[strings[k]]
    return out


def shared_strings(bodies: list[bytes], lo: list[int], hi: list[int]) -> list[list[tuple[int, int]]]:
    """For each run of a group, the ranges of starts (how far before the anchor, from..to) of strings that another run has.

    bodies[k] holds the bytes of run k from hi[k] before its anchor on.
    """
    n = len(bodies)
    right = [b[h:] for b, h in zip(bodies, hi, strict=True)]
    left = [b[:h][::-1] for b, h in zip(bodies, hi, strict=True)]
    if n == 2:
        agree = [(np.array([common_prefix(left[0], left[1])]), np.array([common_prefix(right[0], right[1])]))] * 2
    else:
        matched = []
        for strings, known in ((left, 0), (right, GRAM)):
            order = deep_shallow_order(strings, known)
            steps = np.array([common_prefix(strings[x], strings[y]) for x, y in zip(order, order[1:], strict=False)])
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            matched.append((np.array(order), steps, place))
        agree = []
        for k in range(n):
            both = []
            for order, steps, place in matched:
                own = np.empty(n, np.int64)
                p = place[k]
                own[order[p + 1 :]] = np.minimum.accumulate(steps[p:])
                own[order[:p][::-1]] = np.minimum.accumulate(steps[:p][::-1])
                own[k] = -1
                both.append(own)
            agree.append(tuple(both))
    out = []
    for k in range(n):
        before, after = agree[k]
        start, end = LENGTH - after, before
        good = (start <= end) & (before >= 0)
        if not good.any():
            out.append([])
            continue
        steps = np.bincount(np.maximum(start[good], 0), minlength=LENGTH + 2) - np.bincount(end[good] + 1, minlength=LENGTH + 2)
        inside = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(steps) > 0).astype(np.int8), 0]))
        out.append([(int(b), int(e) - 1) for b, e in zip(inside[::2], inside[1::2], strict=True)])
    return out


# ---------------------------------------------------------------- the operator


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(key, text).alias("k"), text)


def _settled(items: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of runs with gram and body: spans of those equal to another, one run of each kind where
    a gram has several, and how many kinds each gram has.
    """
    items = items.withColumn("own", F.xxhash64("k", "a", "lo", "hi"))
    kinds = common.written(items.groupBy("gram", "body").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("own")), name)
    same = items.join(kinds.where("n > 1").select("gram", "body"), ["gram", "body"], "left_semi")
    many = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    rest = items.join(kinds.select("own").distinct(), "own", "left_semi").dropDuplicates(["own"]).join(many, "gram").drop("own")
    return same.select("k", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + LENGTH).alias("e")), rest, many


def _narrower(lo: int, hi: int, body: bytes, width: int):
    """The runs that a run is divided into: (lo, hi, the bytes that all strings of its range have in common, body).

    Ranges are the same multiples of width for every run, so equal strings stay together.
    """
    for low in range(lo - lo % width, hi + 1, width):
        high = min(low + width, SPAN) - 1
        own_low, own_high = max(lo, low), min(hi, high)
        yield own_low, own_high, body[hi - low : hi - high + LENGTH], body[hi - own_high : hi - own_low + LENGTH]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, s, e): byte ranges to remove, overlapping, of the documents with k = xxhash64(key, text)."""
    spark = docs.sparkSession
    docs = keyed(docs, key, text)
    runs = common.written(runs_of(docs), "runs")
    grams = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("body") != F.max("body")).alias("mixed")).where("n > 1")
    grams = common.written(grams.select("gram", "mixed"), "grams")
    repeated = common.written(runs.join(grams, "gram"), "repeated")
    spans = [repeated.where("not mixed").select("k", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + LENGTH).alias("e"))]
    same, rest, _ = _settled(repeated.where("mixed").drop("mixed"), "kinds")
    spans.append(same)

    def bytes_of(batch: pa.RecordBatch):
        names = batch.schema.names
        whole, at = common.texts_of(batch.column(names.index(text)))
        rows = batch.column(names.index("runs")).to_pylist()
        ks = batch.column(names.index("k")).to_pylist()
        out = []
        for i, k in enumerate(ks):
            raw = whole[at[i] : at[i + 1]].tobytes()
            for r in rows[i]:
                out.append((r["gram"], r["kinds"], k, r["a"], r["lo"], r["hi"], raw[r["a"] - r["hi"] : r["a"] - r["lo"] + LENGTH]))
            if len(out) > 2000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    lists = rest.groupBy("k").agg(F.collect_list(F.struct("gram", "kinds", "a", "lo", "hi")).alias("runs"))
    items = common.written(docs.join(lists, "k").mapInArrow(common.batched(bytes_of), _ITEM).dropDuplicates(["k", "a", "lo", "hi"]), "bodies")
    n_parts = 4 * common.shuffle_partitions(spark)

    def sort(table: pa.Table) -> pa.Table:
        gram, k, a, lo, hi = (table.column(c).to_numpy() for c in ("gram", "k", "a", "lo", "hi"))
        body = table.column("bytes")
        order = np.lexsort((a, k, gram))
        cuts = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]]).tolist()
        out: list[tuple[int, int, int]] = []
        for b, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[b:e].tolist()
            if len(at) > 1:
                for x, found in zip(at, shared_strings([body[x].as_py() for x in at], [int(lo[x]) for x in at], [int(hi[x]) for x in at]), strict=True):
                    out.extend((int(k[x]), int(a[x]) - to, int(a[x]) - from_ + LENGTH) for from_, to in found)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("k", "s", "e"), zip(*out, strict=True) if out else ((), (), ()), strict=True)})

    def divider(width: int):
        def divide(batch: pa.RecordBatch):
            rows = batch.to_pydict()
            out = []
            for k, a, lo, hi, raw in zip(*(rows[c] for c in ("k", "a", "lo", "hi", "bytes")), strict=True):
                for low, high, core, piece in _narrower(lo, hi, raw, width):
                    sums = common.prefix_sums(np.frombuffer(core, np.uint8))
                    gram = common.string_hashes(sums, np.array([0]), np.array([len(core)])).view(np.int64)[0]
                    out.append((int(gram) ^ (low // width), 0, k, a, low, high, piece))
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        return common.batched(divide)

    for width in (*WIDTHS, 0):
        small = items.where(F.col("kinds") <= GROUP).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(n_parts)))
        spans.append(small.groupBy("part").applyInArrow(sort, "k long, s long, e long"))
        large = items.where(F.col("kinds") > GROUP)
        if not width or large.isEmpty():
            break
        parts = large.mapInArrow(divider(width), _ITEM).drop("kinds").withColumn("body", F.xxhash64("bytes"))
        same, rest, _ = _settled(common.written(parts, "divided"), "kinds")
        spans.append(same)
        items = common.written(rest.select("gram", "kinds", "k", "a", "lo", "hi", "bytes"), "bodies")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


_ITEM = "gram long, kinds long, k long, a long, lo int, hi int, bytes binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "kinds", "k", "a", "lo", "hi", "bytes"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, kept binary, n_bytes, n_removed, n_spans long.

    Null and empty texts, and those under LENGTH bytes, keep all they have. Repeated rows
    are copies of each other, so what is long enough goes from each. Keys may be null or
    repeated; an empty table gives an empty table; other columns are not read. The bytes
    kept need not be UTF-8, as a removed range may begin or end inside a character.
    """
    docs = docs.select(key, text)
    spans = common.written(repeated_spans(docs, key, text), "spans")
    lists = spans.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    joined = docs.withColumn("k", F.xxhash64(key, text)).join(lists, "k", "left").select(F.col(key), text, "spans")

    def work(batch: pa.RecordBatch):
        whole, at = common.texts_of(batch.column(1))
        lists = batch.column(2).to_pylist()
        kept, removed, count = [], [], []
        for i, spans in enumerate(lists):
            raw = whole[at[i] : at[i + 1]]
            if spans:
                cut = np.zeros(len(raw) + 1, np.int32)
                np.add.at(cut, [x["s"] for x in spans], 1)
                np.subtract.at(cut, [x["e"] for x in spans], 1)
                gone = np.cumsum(cut)[:-1] > 0
                kept.append(raw[~gone].tobytes())
                removed.append(int(gone.sum()))
                count.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            else:
                kept.append(raw.tobytes())
                removed.append(0)
                count.append(0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=[key, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(common.batched(work), f"`{key}` {docs.schema[key].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that occur elsewhere."""
    done = remove_repeats(common.read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeats"))


OP5_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
p as (select doc_id, i, hash(substr(x, 2 * i - 1, 800)) h from (select doc_id, x, unnest(range(1, len(x) // 2 - 398)) i from d where len(x) >= 800)),
r as (select doc_id, i from p where h in (select h from p group by h having count(*) > 1)),
g as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) > 400 gap from r),
k as (select doc_id, i, sum(case when coalesce(gap, true) then 1 else 0 end) over (partition by doc_id order by i) run from g),
s as (select doc_id, min(i) b, max(i) + 400 e from k group by doc_id, run),
l as (
  select doc_id, b, coalesce(lag(e) over (partition by doc_id order by b), 1) after, e from s
  union all select doc_id, null, max(e), null from s group by doc_id),
t as (
  select l.doc_id, string_agg(substr(d.x, 2 * l.after - 1, 2 * (coalesce(l.b, len(d.x) // 2 + 1) - l.after)), '' order by l.after) x
  from l join d on l.doc_id = d.doc_id group by l.doc_id),
z as (select doc_id, sum(e - b) n_removed, count(*) n_spans from s group by doc_id)
select d.doc_id, cast(len(d.x) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans,
  sha256(unhex(coalesce(t.x, d.x))) kept_sha256, coalesce(n_removed, 0) > 0 repeats
from d left join z on d.doc_id = z.doc_id left join t on d.doc_id = t.doc_id
"""
