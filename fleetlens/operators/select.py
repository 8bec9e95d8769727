"""Choosing hosts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as X

#: What a dot of a loose match does not stand for.
LINE_ENDS = ("\n", "\r", "\u0085", "\u2028", "\u2029")
#: Bits of the filter in ``skip_existing`` unless given: 2 MB, about 1.6 million keys at 10 bits each.
BLOOM_BITS = 1 << 24


def drop_blank_rows(df: DataFrame, column: str = "hostname") -> DataFrame:
    return df.where(F.col(column) != "")


def select_hosts(hosts: DataFrame, only: str | DataFrame | None = None) -> DataFrame:
    """Hosts named in a comma list, or in the ``hostname`` column of a table; empty means all.

    Whole, case-sensitive names, untrimmed. Order and repeats of the hosts stay; repeats
    in the list add nothing. A list becomes a filter the scan can use; a table is tested in
    one join, broadcast only if Spark measures it as small. A table without rows means all, too.
    """
    if isinstance(only, DataFrame):
        named = only.select("hostname")
        return hosts.where(F.col("hostname").isin(named) | ~named.exists())
    if not only:
        return hosts
    return hosts.where(F.col("hostname").isin(re.split("[,\n]", only)))


def _shape(hostname: Column) -> Column:
    """A name with every character but its dots masked."""
    return F.regexp_replace(hostname, r"(?s)[^.]", "x")


def _occurrences(hosts: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """All names of a shape in use that match at a place of a list: ``keys, hostname``.

    A place begins and ends where no word goes on. Its characters are taken as they are, those
    under a dot of the shape as a dot, which gives just the names of this shape that match here.
    """
    shapes = hosts.select(*keys, _shape(F.col("hostname")).alias("__shape")).where("__shape IS NOT NULL").distinct()
    chars = F.filter(F.split("addresses", ""), lambda c: c != "")
    word = F.transform("__chars", lambda c: F.regexp_like(c, F.lit(r"\w")))

    def not_after_word(at: Column) -> Column:
        return (at == 0) | ~F.get("__word", at - 1)

    starts = F.filter(F.sequence(F.lit(0), F.size("__chars")), not_after_word)
    marked = lists.select(*keys, chars.alias("__chars")).where("__chars IS NOT NULL")
    marked = marked.withColumn("__word", word).withColumn("__starts", starts)
    length = F.length("__shape")
    ends = F.filter(
        "__starts", lambda at: (at + length <= F.size("__chars")) & ~F.coalesce(F.get("__word", at + length), F.lit(False))
    )
    placed = marked.join(shapes, keys).select(*keys, "__shape", "__chars", F.explode(ends).alias("__at"))
    under = F.zip_with(
        F.slice("__chars", F.col("__at") + 1, length),
        F.filter(F.split("__shape", ""), lambda m: m != ""),
        lambda c, m: F.when((m == ".") & ~c.isin(*LINE_ENDS), ".").otherwise(c),
    )
    return placed.select(*keys, F.array_join(under, "").alias("hostname"))


def match_local(
    hosts: DataFrame, addresses: str | DataFrame, mode: str = "exact", keys=("inventory",)
) -> DataFrame:
    """Hosts that are this control machine.

    ``addresses`` is the machine's address list as text, or a table with one ``addresses``
    list per control machine and the key columns that tie it to its hosts.

    ``exact`` compares whole addresses. ``loose`` looks for the host as a word anywhere in
    the list, a dot in it standing for any character, so ``0.2.85`` matches ``192.0.2.85``.
    Against a table, the lists are indexed by the shapes (length and places of dots) of the
    hosts that share their keys, so hosts and lists meet by equality of keys and name: the work
    follows lists times shapes, and a key that holds most hosts is spread by name.
    """
    if isinstance(addresses, str):
        if mode == "exact":
            return hosts.where(F.col("hostname").isin(addresses.split()))
        pattern = F.concat(F.lit(r"(?<!\w)"), F.regexp_replace("hostname", r"([^\w.])", r"\\$1"), F.lit(r"(?!\w)"))
        return hosts.where(F.regexp_like(F.lit(addresses), pattern))
    keys = list(keys)
    if not keys:
        raise ValueError("a table of addresses needs keys that tie it to its hosts")
    if mode == "exact":
        tokens = X.drop_blank(F.split("addresses", r"\s+"))
        found = addresses.select(*keys, F.explode(tokens).alias("hostname"))
    else:
        found = _occurrences(hosts, addresses, keys)
    return hosts.join(found, [*keys, "hostname"], "left_semi")


def _bloom_place(keys: list[str], words: int) -> tuple[Column, Column]:
    """Of a key: its word in the filter, and the four bits of that word which it sets."""
    key = F.xxhash64(*keys)
    mask = F.lit(0).cast("long")
    for i in range(4):
        bit = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(1)), 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(key, F.lit(words)), mask


def maybe_existing(observed: DataFrame, keys, bits: int = BLOOM_BITS) -> Column:
    """False only for rows whose key is surely not in ``observed``: a test for the table to be filtered.

    A Bloom filter of ``bits`` bits, whatever the size of ``observed``; every task that asks holds it
    once. Bits are combined before the shuffle, a task sending no more than one row a word. With too few
    bits for the keys the test is true more often than it need be, never false where it must be true.
    """
    keys = list(keys)
    words = max(1, bits // 64)
    word, mask = _bloom_place(keys, words)
    seen = observed.select(word.alias("word"), mask.alias("bits"))
    empty = observed.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    each = seen.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits"))
    return F.get(row.scalar(), word.cast("int")).bitwiseAND(mask) == mask


def skip_existing(desired: DataFrame, observed: DataFrame, keys, bloom_bits: int | None = None) -> DataFrame:
    """Wanted rows that are not there yet.

    ``bloom_bits`` puts a Bloom filter of that size before the join, which pays when most of many wanted rows are
    absent: those that surely are pass without a shuffle, the others are compared with all of ``observed``.
    The rows are the same. Keys whose types differ on the two sides are joined without a filter.
    """
    keys = list(keys)
    there = observed.select(*keys)
    if bloom_bits is None or there.schema.simpleString() != desired.select(*keys).schema.simpleString():
        return desired.join(there, keys, "left_anti")
    maybe = maybe_existing(there, keys, bloom_bits)
    return desired.where(maybe).join(there, keys, "left_anti").unionByName(desired.where(~maybe))


def total_hosts(selected: DataFrame, by=("inventory",)) -> DataFrame:
    """Number of non-blank selected hosts, repeats included, independent of any outcome."""
    return selected.groupBy(*by).agg(F.count_if(F.col("hostname") != "").alias("total"))


def ordered_distinct(rows: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """One row per (group, value) with the position of its first occurrence."""
    return rows.groupBy(group, value).agg(F.min(pos).alias("first_pos"))
