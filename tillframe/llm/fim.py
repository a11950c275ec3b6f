"""Fill-in-middle transformation in DataFrame functions alone.

A text is cut into units (lines, the break included), two cuts drawn from a hash of its
key divide them into prefix, middle and suffix, and these are laid out anew between
sentinels, so that a model learns to write the middle last. A text in which a sentinel
occurs stays as it is. Every row is judged by itself: one pass, no shuffle, and which
form a text takes depends on its key and the seed alone.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A unit; what stands before prefix, suffix and middle.
UNIT = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 texts, how many are rearranged, and how many of these have the suffix first.
RATE, SPM_RATE = 100, 50

OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _check(sentinels: tuple[str, str, str]) -> None:
    """Sentinels whose ends could be taken for each other's beginnings would not be found again where they were put."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels, none empty")
    for a, b in product(sentinels, repeat=2):
        if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of eight hex digits of sha256("<seed>:<key>"), as numbers; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def arrange(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output.

    n is the number of units; form is plain (output is the text), psm or spm. A text is
    plain if it is null or empty (output is empty), holds a sentinel, or isn't among the
    rate in 100; prefix_chars and middle_chars, in code points, are then null. Rows are
    judged one by one: repeated rows stay and come out alike, and so do texts of one key
    where they are equal; a null key is a key like others. Columns of the new names are
    replaced, whatever the others are called; an empty table gives an empty table.
    """
    _check(sentinels)
    p, s, m = (F.lit(x) for x in sentinels)
    kept = [c for c in df.columns if c not in OUTPUTS]
    # the caller's columns travel in a struct, so that none is taken for one of these
    row = common.carried(kept)
    rows = df.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col(f"`{key}`"), seed), 1)))
    rows = rows.select("row", "t", "h1", "h2", "h3", "h4", F.regexp_extract_all("t", F.lit(UNIT), F.lit(0)).alias("u"))
    plain = (F.col("t") == "") | F.contains("t", p) | F.contains("t", s) | F.contains("t", m) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    places = F.size("u") + F.lit(1)
    a, b = F.col("h1") % places, F.col("h2") % places
    rows = rows.select("row", "t", "u", form.alias("form"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))
    part = lambda start, n: F.when(F.col("form") != "plain", F.array_join(F.slice("u", start + 1, n), ""))
    rows = rows.select(
        "row", "t", "form",
        F.size("u").cast("long").alias("n"),
        part(F.lit(0), F.col("a")).alias("prefix"),
        part(F.col("a"), F.col("b") - F.col("a")).alias("middle"),
        part(F.col("b"), F.size("u") - F.col("b")).alias("suffix"),
    )
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("t"))
    return rows.select(*(F.col("row")[c].alias(c) for c in kept), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was made of: its parts, found by their sentinels, in their old order; null of null."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substring(F.substring_index(head, second, 1), len(first) + 1, 1 << 30), F.substring_index(head, second, -1)

    prefix, suffix = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is laid out for fill-in-middle, and that it can be restored."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = arrange(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || cast(doc_id as varchar)) x from documents),
h as (
  select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u, cast('0x' || substr(x, 1, 8) as bigint) h1, cast('0x' || substr(x, 9, 8) as bigint) h2,
    cast('0x' || substr(x, 17, 8) as bigint) h3, cast('0x' || substr(x, 25, 8) as bigint) h4 from d),
c as (
  select doc_id, t, u, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from h),
p as (
  select doc_id, t, n, form, coalesce(array_to_string(list_slice(u, 1, a), ''), '') prefix, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') middle,
    coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') suffix from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(prefix) end prefix_chars, case when form <> 'plain' then length(middle) end middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else t end) output_sha256,
  sha256(t) restored_sha256
from p
"""
