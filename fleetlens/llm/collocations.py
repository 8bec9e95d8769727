"""Phrase collocations from count streams in prefix and in suffix order.

Every word opens a window of up to five words of its piece. Windows are sorted into ranges,
so all phrases of one to five words are runs in one pass: a phrase's count is that of the windows that
begin with it. What is frequent goes on as a stream of counts. In prefix order a phrase's first parts are the open
phrases above it and its extensions to the right are those below; in suffix order, words from last to
first, the same walk gives its last parts and its extensions to the left. The two streams, sorted alike, are merged in lockstep.

Words are compared whole: there is no hash of a word or phrase.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import partitions
from fleetlens.llm.ranges import SAMPLES, Splitters, splitters
from fleetlens.operators.skew import salted_join
from fleetlens.sources.scratch import stored

LONGEST = 5
LEAST = 100
REPORT = 2000
#: Bytes of text whose windows are sorted at once, and bytes of text behind a range of windows.
CHUNK = 6 << 20
RANGE_BYTES = 8 << 20
#: Every word of a phrase ends with this, so a phrase's extensions are the texts that begin with it.
END = " "

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def plain(text: bytes) -> bytes:
    """Lower case, one newline for what ends a piece, one space for what parts words."""
    return text.translate(_LOWER)


def chunks(text: bytes, size: int):
    """(bytes, ahead) of a plain text: windows open in the bytes, ``ahead`` has the words that they may reach."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= size else min((x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0), default=len(text))
        ahead: list[bytes] = []
        if end < len(text):
            stop, look = end, 256
            rest = text.find(b"\n", end)
            rest = len(text) if rest < 0 else rest
            while stop < rest and len(ahead) < LONGEST:
                # One word more than needed: the last may be cut.
                stop = min(rest, end + look)
                ahead = text[end:stop].split()
                look *= 4
            ahead = ahead[: LONGEST - 1]
        yield text[at:end], ahead
        at = end


def windows(parts: list[tuple[bytes, list[bytes]]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words in order, windows, counts): the distinct windows of plain texts, sorted.

    A window is ``LONGEST`` numbers of words, from 1 in the order of their bytes; 0 after a piece's end.
    """
    flat: list[bytes] = []
    closed: list[tuple[int, int]] = []
    for text, ahead in parts:
        flat += filter(None, text.replace(b"\n", b" \n ").split(b" "))
        if ahead:
            closed.append((len(flat), len(flat) + len(ahead)))
            flat += ahead
        flat.append(b"\n")
    words = sorted(set(flat) - {b"\n"})
    code = {w: n for n, w in enumerate(words, 1)}
    code[b"\n"] = 0
    ids = np.fromiter(map(code.__getitem__, flat), np.int32, len(flat))
    opens = ids > 0
    for s, e in closed:
        opens[s:e] = False
    del flat
    at = np.flatnonzero(opens)
    ids = np.concatenate([ids, np.zeros(LONGEST, np.int32)])
    table = np.empty((len(at), LONGEST), np.int32)
    alive = np.ones(len(at), bool)
    for k in range(LONGEST):
        column = ids[at + k]
        alive &= column > 0
        table[:, k] = np.where(alive, column, 0)
    return (words, *sum_rows(table, np.ones(len(table), np.int64), len(words)))


def sum_rows(table: np.ndarray, counts: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``table`` (numbers below ``top``) in order, with their counts summed."""
    bits = max(1, int(top).bit_length())
    keys, column = [], 0
    while column < table.shape[1]:
        key = table[:, column].astype(np.uint64)
        column += 1
        used = bits
        while column < table.shape[1] and used + bits <= 64:
            key = key << np.uint64(bits) | table[:, column].astype(np.uint64)
            column, used = column + 1, used + bits
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    return table[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts


def _phrase(words: list[bytes], row) -> bytes:
    return b"".join(words[w - 1] + b" " for w in row if w)


def _pack(words: list[bytes], table: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted windows with just the words that they hold."""
    used = np.unique(table)
    used = used[used > 0]
    small = np.searchsorted(used, table) + 1
    small[table == 0] = 0
    kind = np.min_scalar_type(len(used))
    # Differences between neighbours in the first column, and columns apart, compress well.
    body = (
        b" ".join([words[w - 1] for w in used.tolist()]),
        kind.str,
        [small[:, k].astype(kind).tobytes() for k in range(LONGEST)],
        counts.astype(np.min_scalar_type(int(counts.max()))),
    )
    return zstandard.compress(pickle.dumps(body, 5), 1)


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words, kind, columns, counts = pickle.loads(zstandard.decompress(blob))
    table = np.stack([np.frombuffer(c, kind) for c in columns], axis=1).astype(np.int32)
    return words.split(b" "), table, counts.astype(np.int64)


def _chunked(batches):
    """(lang, plain text chunks) of about ``CHUNK`` bytes."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part in chunks(plain(text.as_py()), CHUNK):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[0])
                if size[lang] >= CHUNK:
                    yield lang, held.pop(lang)
                    size[lang] = 0
    yield from held.items()


def _sent(texts: DataFrame, points: list[tuple[str, tuple[bytes, ...]]]) -> DataFrame:
    """``lang, range, data``: sorted windows of each chunk, cut at the splitters."""

    def run(batches):
        for lang, parts in _chunked(batches):
            words, table, counts = windows(parts)
            if not len(table):
                continue
            low = bisect_left(points, (lang, ()))
            high = bisect_left(points, (lang + "\0", ()))
            numbers, blobs, at = [], [], 0
            lines = _Lines(words, table)
            for n in range(low, high + 1):
                to = bisect_left(lines, points[n][1]) if n < high else len(table)
                if to > at:
                    numbers.append(n)
                    blobs.append(_pack(words, table[at:to], counts[at:to]))
                at = to
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(numbers), pa.string()), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["lang", "range", "data"]
            )

    return texts.mapInArrow(run, "lang string, range int, data binary")


class _Lines:
    """Sorted windows as tuples of words, made when they are looked at."""

    def __init__(self, words, table):
        self.words, self.table = words, table

    def __len__(self):
        return len(self.table)

    def __getitem__(self, n):
        return tuple(self.words[w - 1] for w in self.table[n].tolist() if w)


def _runs(group: pa.Table, least: int) -> pa.Table:
    """Phrases of one range of one language: those that are frequent, and parts of those at its ends.

    An empty phrase has the number of all words.
    """
    found = [_unpack(b) for b in group["data"].to_pylist()]
    words = sorted(set().union(*(f[0] for f in found)))
    code = {w: n + 1 for n, w in enumerate(words)}
    tables = []
    for own, table, _ in found:
        to = np.fromiter(map(code.__getitem__, own), np.int32, len(own))
        tables.append(np.append(np.int32(0), to)[table])
    table, counts = sum_rows(np.concatenate(tables), np.concatenate([f[2] for f in found]), len(words) + 1)
    del found, tables
    phrases, sizes, totals = [b""], [0], [int(counts.sum())]
    fresh = np.zeros(len(table), bool)
    fresh[0] = True
    for k in range(LONGEST):
        fresh[1:] |= table[1:, k] != table[:-1, k]
        first = np.flatnonzero(fresh)
        runs = np.add.reduceat(counts, first)
        keep = runs >= least
        keep[[0, -1]] = True
        keep &= table[first, k] > 0
        for at, n in zip(first[keep].tolist(), runs[keep].tolist(), strict=True):
            phrases.append(_phrase(words, table[at, : k + 1]))
            sizes.append(k + 1)
            totals.append(n)
    lang = group["lang"][0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * len(phrases), pa.string()),
            "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
            "size": pa.array(sizes, pa.int32()),
            "f": pa.array(totals, pa.int64()),
        }
    )


def _window_splitters(texts: DataFrame, total: int, ranges: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """(lang, window) that part the windows about evenly: from ``SAMPLES`` places a range, drawn over all bytes."""
    every = max(1, total // (SAMPLES * ranges))

    def run(batches):
        rng = np.random.default_rng(1)
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                size = len(text.as_buffer())
                places = rng.integers(0, size, rng.poisson(size / every)).tolist()
                raw = plain(text.as_py()) if places else b""
                for at in places:
                    # From the next word on, words at full length as far as they are seen.
                    line = raw[at : at + 400].partition(b" ")[2].lstrip(b" \n").partition(b"\n")[0]
                    if window := line.split()[:LONGEST]:
                        langs.append(lang)
                        found.append(window)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.binary()))], ["lang", "window"])

    drawn = texts.mapInArrow(run, "lang string, window array<binary>").collect()
    sample = sorted((r["lang"], tuple(bytes(w) for w in r["window"])) for r in drawn)
    return sorted(set(sample[:: max(1, len(sample) // ranges)][1:]))


def count_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases that occur ``least`` times, (lang, n) words).

    A phrase is written with a space after every word.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    texts = texts.filter("octet_length(text) > 0")
    spark = docs.sparkSession
    total = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    ranges = max(partitions(spark), -(-total // RANGE_BYTES))
    points = _window_splitters(texts, total, ranges)
    sent = _sent(texts, points)
    schema = "lang string, phrase string, size int, f long"
    # As many tasks as the text asks for, whatever the session's number of partitions is.
    sent = sent.repartition(max(partitions(spark), ranges // 2), "lang", "range")
    partial = sent.groupBy("lang", "range").applyInArrow(lambda g: _runs(g, least), schema)
    # Phrases at the ends of ranges come in parts.
    counted = stored(partial.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")), "phrase_counts")
    return counted.filter((F.col("size") > 0) & (F.col("f") >= least)), counted.filter("size = 0").select("lang", F.col("f").alias("n"))


# ---------------------------------------------------------------- count streams


def reversed_words(phrase: Column) -> Column:
    """``a b c `` as ``c b a ``."""
    return F.concat(F.array_join(F.reverse(F.split(F.rtrim(phrase), END)), END), F.lit(END))


_KEY = "lang string, phrase string"


def walk(counts: DataFrame, cuts: Splitters) -> DataFrame:
    """``lang, phrase, size, f, opened, extended`` of phrases sorted by their words.

    ``opened``: counts of the phrases of fewer words that it begins with, shortest first. ``extended``: the
    largest count of a phrase that goes on from it by one word, null without.

    Each range is walked in order with the open phrases on a stack. What is open where a range
    begins are first parts of its splitter: those phrases go to that range too.
    """
    own = cuts.range_of(F.struct("lang", "phrase"))
    # The last range whose splitter begins with the phrase.
    beginning = lambda p: F.struct(p["lang"], F.left(p["phrase"], F.length("phrase")))
    last = cuts.count_while(lambda p: beginning(p) <= F.struct("lang", "phrase"))
    placed = counts.select("*", own.alias("own"), F.explode(F.sequence(own, last)).alias("range"))
    ordered = placed.repartition("range").sortWithinPartitions("range", "lang", "phrase")
    schema = pa.schema(
        [("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64()), ("opened", pa.list_(pa.int64())), ("extended", pa.int64())]
    )

    def run(batches):
        stack: list[list] = []  # open phrases: [place, lang, phrase, size, f, opened or None, extended]
        now = None

        def close(down_to, out):
            while len(stack) > down_to:
                out.append(stack.pop()[1:])

        for batch in batches:
            out: list[list] = []
            for place, own_place, lang, phrase, size, f in zip(
                *(batch.column(c).to_pylist() for c in ("range", "own", "lang", "phrase", "size", "f")), strict=True
            ):
                if (place, lang) != now:
                    close(0, out)
                    now = (place, lang)
                keep = len(stack)
                while keep and not phrase.startswith(stack[keep - 1][2]):
                    keep -= 1
                close(keep, out)
                # All first parts of a frequent phrase are frequent, so they are all open.
                if stack and stack[-1][3] == size - 1:
                    stack[-1][6] = max(stack[-1][6] or 0, f)
                opened = [s[4] for s in stack] if place == own_place else None
                stack.append([place, lang, phrase, size, f, opened, None])
            if out:
                yield _batch(out)
        out = []
        close(0, out)
        if out:
            yield _batch(out)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=schema)

    walked = ordered.select("range", "own", "lang", "phrase", "size", "f").mapInArrow(
        run, "lang string, phrase string, size int, f long, opened array<bigint>, extended long"
    )
    # A phrase that went to several ranges has its parts together again.
    same = [F.max(c).alias(c) for c in ("size", "f", "opened", "extended")]
    return walked.groupBy("lang", "phrase").agg(*same)


def _walked(counts: DataFrame) -> DataFrame:
    keys = {"lang": F.col("lang"), "phrase": F.col("phrase")}
    return walk(counts, splitters(counts, keys, _KEY, F.lit(1)))


def best_cut() -> Column:
    """(score, k, l, r) of the cut with the least score, in decimals of 38 digits."""
    # opened[k - 1] occurs with ends[size - k - 1]: together they are the phrase.
    return F.expr(
        "array_min(transform(sequence(1, size - 1), k -> struct("
        "cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0))"
        " div (cast(opened[k - 1] as decimal(17,0)) * cast(ends[size - k - 1] as decimal(17,0))) as score, k,"
        " opened[k - 1] as l, ends[size - k - 1] as r)))"
    )


def collocations(docs: DataFrame, least: int = LEAST, report: int = REPORT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``report`` best phrases of two to five words.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs. ``lang``, ``text``: a null text is empty, a null lang is ``und``; other columns
    are not read, and repeated rows count each time. A phrase occurs ``a`` times, ``least`` or more, its two parts ``l`` and ``r``
    times, and a language has ``n`` words. The score is floor(1000 a n / (l r)) at the cut where that is
    least, ties to the shortest first part, in exact numbers. A phrase that stands in a longer one which occurs as
    often is left out. Ranks go by score, then ``a``, then the phrase's bytes. No rows give no rows.
    """
    counts, words = count_phrases(docs, least)
    forward = _walked(counts).filter("size > 1")
    turned = stored(counts.select("lang", reversed_words(F.col("phrase")).alias("phrase"), "size", "f"), "phrase_suffixes")
    backward = _walked(turned).filter("size > 1").select(
        "lang", reversed_words(F.col("phrase")).alias("phrase"), F.col("opened").alias("ends"), F.col("extended").alias("extended_left")
    )
    merged = forward.hint("merge").join(backward, ["lang", "phrase"])
    a = F.col("f")
    whole = merged.filter((F.coalesce("extended", F.lit(0)) < a) & (F.coalesce("extended_left", F.lit(0)) < a))
    whole = salted_join(whole, words, ["lang"], ["phrase"])
    best = whole.withColumn("cut", best_cut()).select(
        "lang", F.rtrim("phrase").alias("phrase"), a.alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= report).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
