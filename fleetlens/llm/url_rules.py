"""URL filters as a sorted sweep over reversed-host keys."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import BATCHES_PER_PARTITION, ascii_lower, numbered, partitions

ALLOW, BLOCK = "allow", "block"
#: Above every key that begins with a rule's key.
LAST = "\U0010ffff"
#: Buckets of keys for each range; one key of each is a candidate for a split.
KEYS_PER_RANGE = 16
LONGEST = (1 << 63) - 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """``a.example.org`` as ``org.example.a.``: a host's subdomains are the keys that begin with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _splits(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ``ranges`` - 1 (key, salt) that cut the rows into even ranges: a bounded list on the driver."""
    found = (
        urls.groupBy(F.pmod("salt", F.lit(KEYS_PER_RANGE * ranges)).alias("bucket"))
        .agg(F.any_value(F.struct("key", "salt")).alias("at"))
        .select("at.key", "at.salt")
        .collect()
    )
    keys = sorted((r["key"], r["salt"]) for r in found)
    return keys[KEYS_PER_RANGE // 2 :: KEYS_PER_RANGE][: ranges - 1]


class _Stack:
    """The rules whose hosts contain the host now swept, outermost first."""

    def __init__(self):
        self.open: list[tuple[str, dict, list[int]]] = []

    def at(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.at(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        paths, lengths = self.open[-1][1], self.open[-1][2]
        if path not in paths or verdict == BLOCK:
            paths[path] = (rule, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        best, size = None, -1
        for _, paths, lengths in reversed(self.open):
            for n in lengths:
                if n <= len(path) and (found := paths.get(path[:n])):
                    if len(found[0]) > size:
                        best, size = found, len(found[0])
                    break
        return best


def _sweep(default: str):
    def run(table: pa.Table) -> pa.Table:
        keys, kinds = table["key"].to_pylist(), table["is_url"].to_pylist()
        paths, rules, verdicts = table["path"].to_pylist(), table["rule"].to_pylist(), table["verdict"].to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], kinds[i]))
        stack, kept, out_rule, out_verdict = _Stack(), [], [], []
        for i in order:
            if kinds[i]:
                stack.at(keys[i])
                found = stack.longest(paths[i]) or (None, default)
                kept.append(i)
                out_rule.append(found[0])
                out_verdict.append(found[1])
            else:
                stack.add(keys[i], paths[i], rules[i], verdicts[i])
        rows = table.select(["page_id", "url", "host", "path"]).take(pa.array(kept, pa.int64()))
        return rows.append_column("rule", pa.array(out_rule, pa.string())).append_column(
            "verdict", pa.array(out_verdict, pa.string())
        )

    return run


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = ALLOW, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every page.

    ``rules``: (host, path, verdict). A rule fits its host and all subdomains where the
    url's path starts with the rule's. The longest fitting rule (host and path together, the
    longer host on a tie) decides, block before allow where both are the same rule; no
    fitting rule gives ``default`` and a null ``rule``. Rules with a null or empty host fit
    nothing; a null path is empty. A null url, or one without ``://``, has empty host and
    path and no rule. Repeated pages and null ids stay rows; other columns are not read.

    Urls are cut into even ranges of (host key, salt), so a host with a third of all pages
    spans many ranges; the salt is a number written with each row, so copies of one row do too. A rule goes to each range its interval meets: the ranges that a host
    fills are bounded by the number of ranges, and only rules on ancestors of a split go to
    several. Each range is one sorted sweep that keeps a stack of active nested rules.
    """
    spark = pages.sparkSession
    ranges = BATCHES_PER_PARTITION * partitions(spark)
    rows = numbered(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url")), "row", "urls")
    host, path = host_and_path(F.col("url"))
    urls = rows.select("page_id", "url", host.alias("host"), path.alias("path"), F.xxhash64("row").alias("salt")).select(
        "page_id", "url", "host", "path", host_key(F.col("host")).alias("key"), "salt"
    )
    splits = _splits(urls, ranges)

    def place(batches):
        for batch in batches:
            at = zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True)
            yield batch.append_column("range", pa.array([bisect_right(splits, x) for x in at], pa.int32()))

    def spread(batches):
        for batch in batches:
            at = [
                range(bisect_left(splits, (k, -LONGEST - 1)), bisect_right(splits, (k + LAST, LONGEST)) + 1)
                for k in batch.column("key").to_pylist()
            ]
            rows = pa.array([i for i, r in enumerate(at) for _ in r], pa.int64())
            yield batch.take(rows).append_column("range", pa.array([x for r in at for x in r], pa.int32()))

    placed = urls.mapInArrow(
        place, "page_id long, url string, host string, path string, key string, salt long, range int"
    ).select("range", "key", F.lit(True).alias("is_url"), "page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    named = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host != ''")
    spans = named.select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    routed = spans.mapInArrow(spread, "key string, path string, rule string, verdict string, range int").select(
        "range", "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("host"), "path", "rule", "verdict"
    )
    return (
        placed.union(routed)
        .groupBy("range")
        .applyInArrow(_sweep(default), "page_id long, url string, host string, path string, rule string, verdict string")
    )
