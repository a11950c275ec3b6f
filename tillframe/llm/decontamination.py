"""Benchmark decontamination with DataFrame functions alone.

Benchmark texts become a set of n-word windows, normalised as the documents are; an item
of fewer words is one window. Wherever a window occurs in a document, it covers one of
the document's blocks, of half as many words, that stand side by side. So blocks alone
are scanned: their hashes are probed in a broadcast set of the hashes of all blocks that
windows hold, behind a check of its size; a block that is there yields the windows
around it, and these are verified word by word against the benchmark's. A text is first
divided into overlapping segments, so what a word costs does not depend on the length of
its text. Documents are never shuffled: only a few numbers of each row are, to bring its
hits together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Words of a segment, besides those it shares with the next.
SEGMENT = 1024
#: The windows with their items are broadcast up to so many bytes, and hashes of blocks up to as many, of 16 each; beyond, Spark joins by shuffle.
MAX_BROADCAST_BYTES = 64 << 20

#: Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window: hash, size, gram array<string>, items array<string>.

    Items without words have no window. Windows of an item with a null id count as hits
    and add nothing to items; repeated items count once.
    """
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w"))
    w = w.withColumn("size", F.least(F.size("w"), F.lit(window))).where("size > 0")
    grams = w.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("gram"))
    return grams.groupBy("gram", "size").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("gram"))


def _block(size: int) -> int:
    """Words of a block: any so many words in a row hold one whole, wherever blocks begin."""
    return (size + 1) // 2


def _blocks(size: int) -> Column:
    """The blocks of a segment s for windows of so many words: the words around each that windows over it can reach, the first one's place in the text, from 0, and the block's place among them."""
    b, n = _block(size), F.size("s.w")
    reach = size - b
    # blocks that windows beginning in this segment can cover; the next segment has the others
    places = F.when(n >= size, F.sequence(F.lit(0), F.least(n - b, F.lit(SEGMENT + b - 2)), F.lit(b))).otherwise(F.array().cast("array<int>"))
    first = lambda p: F.greatest(p - reach, F.lit(0))
    return F.transform(places, lambda p: F.struct((F.col("s.before") + first(p)).alias("first"), (p - first(p) + 1).alias("at"), F.lit(size).alias("size"), F.slice("s.w", first(p) + 1, p + size - first(p)).alias("around")))


def _hash(size: Column, words_: Column) -> Column:
    return F.xxhash64(size, words_)


def block_hashes(windows: DataFrame) -> DataFrame:
    """(block): the distinct hashes of the blocks, wherever they begin, that windows hold."""
    by_size = F.floor((F.col("size") + 1) / 2).cast("int")
    starts = F.transform(F.sequence(F.lit(1), F.col("size") - by_size + 1), lambda i: F.slice("gram", i, by_size))
    return windows.select("size", F.explode(starts).alias("words")).select(_hash(F.col("size"), F.col("words")).alias("block")).distinct()


def _broadcast(table: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(table) if n_bytes <= MAX_BROADCAST_BYTES else table


def scan(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_words, hits (array of struct<start,size>) and items.

    hits holds the windows that occur, each once, start counted in words from 1; items the
    ids of the benchmark items they belong to, as sorted strings. Null and empty texts
    have no words; rows are judged one by one, so repeated rows and keys stay as they are;
    columns of the new names are replaced, whatever the others are called. An empty
    table, or one without windows, gives no hits.
    """
    windows = common.written(windows, "windows")
    n_bytes = F.sum(F.size("gram") * 16 + F.octet_length(F.array_join("gram", "")) + 64 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16))
    total, sizes = windows.agg(n_bytes, F.sort_array(F.collect_set("size"))).first()
    sizes = sizes or [WINDOW]
    blocks = common.written(block_hashes(windows), "blocks")
    windows, blocks = _broadcast(windows, total or 0), _broadcast(blocks, 16 * blocks.count())
    kept = [c for c in docs.columns if c not in (text, "n_words", "hits", "items")]
    row = F.struct(common.carried(kept).alias("kept"), F.monotonically_increasing_id().alias("row"))
    rows = docs.select(row.alias("key"), words(F.col(f"`{text}`")).alias("w"))
    begins = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(SEGMENT))).otherwise(F.array(F.lit(0)))
    # a segment: the words before it, and its own with those that its last windows go on into
    segments = F.transform(begins, lambda b: F.struct(b.alias("before"), F.slice("w", b + 1, F.lit(SEGMENT + max(sizes) - 1)).alias("w")))
    rows = rows.select("key", F.size("w").cast("long").alias("n_words"), F.explode(segments).alias("s"))
    every = F.concat(*(_blocks(m) for m in sizes))
    rows = rows.select("key", "n_words", (F.col("s.before") == 0).alias("first"), F.posexplode_outer(every).alias("pos", "b"))
    # one row of each document stays, hit or not
    rows = rows.select("key", "n_words", (F.col("first") & (F.coalesce("pos", F.lit(0)) == 0)).alias("first"), "b")
    block = _hash(F.col("b.size"), F.slice("b.around", F.col("b.at"), F.floor((F.col("b.size") + 1) / 2).cast("int")))
    held = blocks.select("block", F.lit(True).alias("held"))
    rows = rows.withColumn("block", block).join(held, "block", "left").where(F.coalesce("held", F.lit(False)) | F.col("first"))
    size = F.col("b.size")
    starts = F.when(F.col("held") & (F.size("b.around") >= size), F.sequence(F.lit(0), F.size("b.around") - size)).otherwise(F.array().cast("array<int>"))
    own = F.transform(starts, lambda i: F.struct((F.col("b.first") + i + 1).alias("start"), F.slice("b.around", i + 1, size).alias("gram")))
    rows = rows.select("key", "n_words", F.col("first").alias("keep"), F.posexplode_outer(own).alias("pos", "own"))
    rows = rows.select("key", "n_words", (F.col("keep") & (F.coalesce("pos", F.lit(0)) == 0)).alias("first"), "own", F.xxhash64("own.gram").alias("hash"))
    same = F.coalesce(F.col("own.gram") == F.col("gram"), F.lit(False))
    joined = rows.join(windows, "hash", "left").where(same | F.col("first"))
    hits = joined.select("key", "n_words", F.when(same, F.struct(F.col("own.start"), F.col("size"))).alias("hit"), F.when(same, F.col("items")).alias("items"))
    # a window over two blocks is found by both
    found = hits.groupBy("key.row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.select(*(F.col("key.kept")[c].alias(c) for c in kept), "n_words", "hits", "items")


def covered(hits: Column) -> Column:
    """The numbers of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))


def remove_spans(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """docs with the words inside windows taken out of their texts, what stands between staying.

    What is cut depends on the text alone, so each different text is scanned once, and its
    rows find their cuts by its hash and length: rows, repeated ones and those of one key
    among them, stay as many as they are. Null and empty texts have no words and stay as
    they are; so does every other column, whatever it is called.
    """
    key = F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("length"))
    rows = docs.select(common.carried([c for c in docs.columns if c != text]).alias("row"), F.col(f"`{text}`").alias("text")).withColumn("key", key)
    scanned = scan(rows.where("text is not null").select("key", "text"), windows).where(F.size("hits") > 0)
    cut = common.small(common.written(scanned.groupBy("key").agg(covered(F.first("hits")).alias("cut")), "cuts"))
    parts = F.regexp_extract_all("text", F.lit(rf"{WORD}|[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    word_first = F.col("text").rlike(rf"^{WORD}")
    number = lambda i: F.when(word_first, F.when(i % 2 == 0, i / 2 + 1)).otherwise(F.when(i % 2 == 1, (i + 1) / 2))
    left = F.array_join(F.filter(parts, lambda p, i: ~F.coalesce(F.array_contains("cut", number(i).cast("int")), F.lit(False))), "")
    joined = rows.join(cut, "key", "left").withColumn("left", F.when(F.col("cut").isNull(), F.col("text")).otherwise(left))
    return joined.select(*(F.col("left").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan(docs, benchmark_windows(common.read(spark, sf_dir, "benchmark")))
    n_hit = F.size(covered(F.col("hits"))).cast("long")
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, w, least(len(w), 10) m from (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark)
  where len(w) > 0),
g as (
  select distinct item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') gram
  from (select item_id, m, w, unnest(range(1, len(w) - m + 2)) i from b)),
p as (
  select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') gram
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d, (select distinct m from g) where len(w) >= m)),
h as (select doc_id, item_id, i, p.m m from p join g on p.gram = g.gram and p.m = g.m),
c as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + m)) k from h) group by doc_id),
t as (select doc_id, count(item) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, cast(item_id as varchar) item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""
