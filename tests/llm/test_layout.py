"""Fill-in-middle, clustering and packing: edge cases, and brute force on small tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import parity
from tillframe.llm import clustering, fim, packing, queries

SF = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_centroid_clustering"])
def test_query_matches_its_sql(spark, name):
    parity.same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], parity.connect(SF))


# ---------------------------------------------------------------- 11


def plain_arrangement(key, text, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


LINES = [None, "", "\n", "one", "a\nb", "\n\n\nx", "<P>", "x <S> y\nz", "a<M", "<\nP>", "<P\n>\n<<S\n", "é\U0001f600\n\U0001f600", "a\r\nb\x00c\n", "  \n" * 40, "z" * 100_000 + "\n" + "y\n" * 20_000]


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_arrangement_equals_plain_python(spark, rate, spm_rate):
    rows = [(k * 100 + j, t) for j, t in enumerate(LINES) for k in range(12)] + [(None, "a\nb\nc"), (None, None), (5, "same\nrow"), (5, "same\nrow")]
    out = fim.arrange(spark.createDataFrame(rows, TEXT), rate=rate, spm_rate=spm_rate)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((k, t, *plain_arrangement(k, t, rate, spm_rate)) for k, t in rows)
    assert all(r.back == (r.text or "") for r in got)


def test_arrangement_keeps_clashing_columns(spark):
    names = ["u", "t", "row", "h1", "a", "b", "prefix", "suffix", "middle", "_"]
    df = spark.createDataFrame([(1, "x\ny", *range(10), "mine")], TEXT + "".join(f", {c} int" for c in names) + ", form string")
    out = fim.arrange(df)
    assert out.columns == ["doc_id", "text", *names, "n", "form", "prefix_chars", "middle_chars", "output"]
    r = out.first()
    assert [r[c] for c in names] == list(range(10)) and r.form in ("psm", "spm")
    assert fim.arrange(spark.createDataFrame([], TEXT)).count() == 0


def test_sentinels_that_overlap_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], TEXT)
    for bad in (("<P>", "<P>", "<M>"), ("aba", "c", "d"), ("ab", "bc", "x"), ("<a>", "<a>b", "c"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.arrange(df, sentinels=bad)
    longer = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    out = fim.arrange(spark.createDataFrame([(k, "a\nb|>\n<|\nc") for k in range(20)], TEXT), sentinels=longer)
    assert all(r.back == r.text for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"), longer)).collect())


def test_arrangement_needs_neither_python_nor_shuffle(spark):
    plan = fim.op11_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


# ---------------------------------------------------------------- 12


def plain_clusters(rows, k, rounds, dimensions, seed=3):
    kept = [(key, [math.floor(1024 * x) for x in v]) for key, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), [struct.pack("<i", x).hex() for x in r[1]]))
    centroids = [q for _, q in first[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))[::-1] for _, q in kept]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, q), (j, _) in zip(kept, assign(), strict=True):
            own[j].append(q)
        for j, some in own.items():
            centroids[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    total = Counter()
    found = assign() if kept else []
    for j, d in found:
        total[j] += d
    return Counter((key, j, d, total[j], sum(total.values()), tuple(centroids[j])) for (key, _), (j, d) in zip(kept, found, strict=True))


def clusters_of(df, **more):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in clustering.cluster(df, **more).collect())


@pytest.mark.parametrize("seed,k,dimensions,rounds", [(1, 8, 6, 10), (2, 5, 2, 4), (3, 1, 3, 2), (4, 12, 1, 6)])
def test_clusters_equal_plain_rounds(spark, seed, k, dimensions, rounds):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, r.uniform(-1, 1)]) for _ in range(dimensions)]) for i in range(120)]
    rows += [(i, list(rows[i % 7][1])) for i in range(200, 240)]  # copies
    rows += [(0, rows[5][1]), (0, rows[0][1]), (None, rows[3][1]), (300, None), (301, []), (302, [1.0] * (dimensions + 1)), (303, [math.nan] * dimensions), (304, [math.inf] * dimensions), (305, [None] * dimensions)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert clusters_of(df, clusters=k, rounds=rounds, dimensions=dimensions) == plain_clusters(rows, k, rounds, dimensions)


def test_clusters_of_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])]
    kind = "vec_id long, embedding array<float>"
    assert clusters_of(spark.createDataFrame(rows, kind), dimensions=2) == plain_clusters(rows, 8, 10, 2)
    empty = clustering.cluster(spark.createDataFrame([], kind))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    named = spark.createDataFrame([("k", [0.5, 0.5], 1, b"q")], "vec_id string, embedding array<float>, cluster int, q binary")
    assert clustering.cluster(named, dimensions=2).first().asDict()["vec_id"] == "k"
    with pytest.raises(Exception, match="not exact"):
        clustering.cluster(spark.createDataFrame([(1, [1e9, 0.0])], kind), dimensions=2).count()


def test_bounds_spare_calculations_and_keep_ties():
    r = np.random.default_rng(7)
    centres = r.integers(-900, 900, (8, 16))
    q = (centres[r.integers(0, 8, 3000)] + r.integers(-40, 40, (3000, 16))).astype(np.int32)
    now = q[:8].astype(np.int64)
    a, upper, lower, before, calculated = np.zeros(3000, np.int32), np.full(3000, np.inf), np.zeros((3000, 8)), None, []
    for _ in range(6):
        if before is not None:
            clustering.give_way(a, upper, lower, before, now)
        calculated.append(clustering.nearest(q, a, upper, lower, now))
        d = np.stack([clustering.squared(q, c) for c in now], 1)
        assert (a == d.argmin(1)).all()  # argmin takes the first of a tie
        assert (upper**2 >= d[np.arange(3000), a]).all() and (lower**2 <= d).all()
        before, now = now, np.stack([q[a == c].sum(0, dtype=np.int64) // max(1, (a == c).sum()) if (a == c).any() else now[c] for c in range(8)])
    assert calculated[0] > 5 * calculated[-1] and calculated[-1] < 3000
    twice = np.repeat(now[:1], 8, 0)
    clustering.nearest(q, a, np.full(3000, np.inf), np.zeros((3000, 8)), twice)
    assert (a == 0).all()


# ---------------------------------------------------------------- 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(rows, documents, library, capacity):
    """rows pack the documents, (key, text) each with a key of its own; returns the number of sequences and of tokens."""
    by, inside, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by[r.doc_id].append(r)
        inside[r.sequence_id].append(r)
    assert set(by) == {k for k, _ in documents}
    for k, text in documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END]
        at, total = 0, total + len(ids)
        for n, r in enumerate(sorted(by[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (r.length == capacity or n == 0) and 0 < r.length <= capacity
            assert bytes(r.tokens) == struct.pack(f"<{r.length}I", *ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for some in inside.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(inside), total


ODD = [None, "", " ", "one", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "naïve 　 \U0001f600 text", "x y  z", "it's   the\n\n end ", "word " * 3000, "z" * 5000, "é" * 40]


@pytest.mark.parametrize("capacity,partitions", [(1024, 3), (16, 5)])
def test_packing_of_odd_texts(spark, library, capacity, partitions):
    r = random.Random(2)
    documents = list(enumerate(ODD + [" ".join(r.choice(["alpha", "beta", "é", "12", "?!"]) for _ in range(r.randint(1, 60))) for _ in range(150)]))
    df = spark.createDataFrame(documents, TEXT).repartition(partitions)
    packed = packing.pack(df, packing.specification(), capacity=capacity)
    n, total = check_packed(packed.collect(), documents, library, capacity)
    assert n <= 1.02 * -(-total // capacity) + 1
    whole = packing.sequences(packed).collect()
    assert len(whole) == n and sum(x.n_tokens for x in whole) == total and all(len(x.tokens) == 4 * x.n_tokens and x.ends[-1] == x.n_tokens for x in whole)


def test_packing_of_a_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    n, total = check_packed(packing.pack(table, packing.specification()).collect(), [tuple(r) for r in table.collect()], library, 1024)
    assert n <= 1.005 * -(-total // 1024)
    rows = packing.op13_best_fit_packing(spark, d).collect()
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in rows}
    for r in packing.pack(table.where("doc_id < 50"), packing.specification()).collect():
        assert crc[r.doc_id, r.piece] == zlib.crc32(r.tokens)


def test_packing_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b", 1, "p", 7), (1, "a b", 1, "p", 7), (None, "c", 2, "q", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, row string, number int").withColumn("length", F.lit("mine"))
    packed = packing.pack(df, packing.specification())
    assert packed.columns == ["doc_id", "part", "row", "number", "piece", "start", "length", "tokens", "sequence_id", "offset"]
    got = packed.collect()
    assert Counter((r.doc_id, r.part, r.row, r.number) for r in got) == Counter((k, a, b, c) for k, _, a, b, c in rows)
    assert len({(r.sequence_id, r.offset) for r in got}) == 3
    assert packing.pack(spark.createDataFrame([], TEXT), packing.specification()).count() == 0


def used(plan):
    n = Counter()
    for lengths, times in plan:
        for x in lengths:
            n[x] += times
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 64, 1024])
    counts = {r.randint(1, capacity): r.choice([1, 3, 10**6, 10**12]) for _ in range(r.randint(0, 80))}
    plan = packing.plan(counts, capacity)
    assert used(plan) == Counter(counts) and all(sum(x) <= capacity and n > 0 for x, n in plan)
    table = packing.lay_out(plan)
    assert len(table) == len(set(table[:, 0].tolist())) and len(plan) <= 5 * len(counts) + 5


def test_plan_fills_exactly_by_one_two_and_three():
    assert sorted(packing.plan({1024: 5, 600: 4, 424: 4})) == [((600, 424), 4), ((1024,), 5)]
    assert packing.plan({500: 10, 300: 10, 224: 10}) == [((500, 300, 224), 10)]
    assert packing.plan({400: 6, 300: 6, 200: 6, 124: 6}) == [((400, 300, 200, 124), 6)]
    assert sum(n for _, n in packing.plan({400: 11})) == 6  # no complement: best fit
    assert packing.plan({512: 5}) == [((512, 512), 2), ((512,), 1)]


def smallest(counts, capacity):
    """The fewest sequences, by trying all ways."""
    items = sorted(Counter(counts).elements(), reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[k] and rooms[j] not in rooms[:j]:
                go(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_plan_is_near_the_best():
    r = random.Random(9)
    over = 0
    for _ in range(40):
        counts = Counter(r.randint(2, 20) for _ in range(r.randint(1, 11)))
        n, least = sum(n for _, n in packing.plan(counts, 20)), smallest(counts, 20)
        assert n <= least + 1
        over += n - least
    assert over <= 3
