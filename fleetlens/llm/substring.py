"""Substring deduplication by recompression: equal passages get equal names for their inner parts.

Every document is a sequence of word names. Rounds replace short runs of one symbol, and
pairs of neighbouring symbols, by new symbols. A symbol's name is a hash of what it
stands for, and whether two neighbours merge depends on their names alone; so names are
global without a naming shuffle, and two copies of a passage are parsed alike except near
their ends, where the words around them matter. How far that reaches is bounded by the
lengths symbols may have:

* a run step with cap c may lose c - 1 words at either end of a passage,
* a pair step loses one symbol there, no longer than what can still merge.

``MARGIN`` is the sum over ``STEPS``. What is left of a window always holds a *gram*, the
symbols from one symbol's start up to ``GRAM`` words or more. So windows that occur in several
documents are found among those whose grams are shared, and are then compared as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import batch_of, mix, name_ranges, pair_name, partitions, span_hashes, squeeze, unsqueeze

WINDOW = 50
#: (kind, longest symbol in words that the step may make).
STEPS = [("run", 4), ("pair", 4), ("pair", 4), ("pair", 4), ("pair", 8)]
LONGEST = 8


def margin(steps=STEPS) -> int:
    """Words at either end of a passage whose symbols may depend on what is around it."""
    lost, longest = 0, 1
    for kind, cap in steps:
        lost += cap - 1 if kind == "run" else min(cap - 1, longest)
        longest = max(longest, cap)
    return lost


MARGIN = margin()
#: The shortest gram; with the longest symbol at its end it still fits between the margins.
GRAM = WINDOW - 2 * MARGIN - LONGEST + 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RUN, _SIDE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def span_names(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One name for each ``values[first:last]``, the same wherever the span stands.

    Polynomial sums modulo 2^64: a span's part of the prefix sums, brought to its own start
    by the inverse power.
    """
    n = len(values)
    powers, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, _STEP), out=powers[1:])
    np.cumprod(np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64))), out=back[1:])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values) * powers[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def parse(names: np.ndarray, doc: np.ndarray, steps=STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and the words they start at, after all steps; nothing merges across documents."""
    symbol, start, size, own = names.copy(), np.arange(len(names)), np.ones(len(names), np.int64), doc
    for step, (kind, cap) in enumerate(steps):
        if len(symbol) < 2:
            break
        together = own[1:] == own[:-1]
        if kind == "run":
            first = np.flatnonzero(np.concatenate([[True], ~(together & (symbol[1:] == symbol[:-1]))]))
            times = np.diff(np.append(first, len(symbol)))
            total = np.add.reduceat(size, first)
            merged = (times > 1) & (total <= cap)
            at = first[merged]
            symbol[at] = pair_name(symbol[at] ^ _RUN, times[merged].astype(np.uint64))
            size[at] = total[merged]
            stay = ~np.repeat(merged, times)
            stay[at] = True
        else:
            left = (mix(symbol ^ mix(np.array([step + 1], np.uint64) * _SIDE)) & np.uint64(1)).astype(bool)
            at = np.flatnonzero(together & left[:-1] & ~left[1:] & (size[1:] + size[:-1] <= cap))
            symbol[at] = pair_name(symbol[at], symbol[at + 1])
            size[at] += size[at + 1]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
        symbol, start, size, own = symbol[stay], start[stay], size[stay], own[stay]
    return symbol, start


def grams(symbol: np.ndarray, start: np.ndarray, stop: np.ndarray, gram: int = GRAM):
    """(name, first word, end) of every gram; ``stop``: for each word the end of its document."""
    n = len(stop)
    bounds = np.append(start, n)
    last = np.searchsorted(bounds, start + gram)
    inside = last < len(bounds)
    end = bounds[np.minimum(last, len(bounds) - 1)]
    inside &= (start + gram <= n) & (end <= stop[start])
    at = np.flatnonzero(inside)
    return span_names(symbol, at, last[at]), start[at], end[at]


class _Batch:
    """The documents of one batch: words, their names, and where documents end."""

    def __init__(self, blobs, window: int):
        self.rows = unsqueeze(blobs)
        self.words, lengths = [], []
        for text in self.rows["text"]:
            words = text.as_py().split() if text.is_valid else []
            lengths.append(len(words))
            self.words.append(words)
        self.lengths = np.array(lengths, np.int64)
        ends = np.cumsum(self.lengths)
        self.first = ends - self.lengths
        flat = [w for words in self.words for w in words]
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        stops = np.cumsum(size)
        self.names = span_hashes(b"".join(flat), stops - size, stops)
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        self.stop = ends[self.doc]
        ids = self.rows["doc_id"].combine_chunks()
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0), np.int64)
        #: Words at which a whole window of a document with an id starts.
        at = np.arange(len(flat))
        self.starts = at[(at + window <= self.stop) & self.known[self.doc]]

    def grams(self):
        symbol, start = parse(self.names, self.doc)
        name, first, end = grams(symbol, start, self.stop)
        there = self.known[self.doc[first]]
        return name[there], first[there], end[there]


def _rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(schema.items(), columns, strict=True)})


def _by_document(name: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, the smallest id that has each, and whether several ids have it."""
    order = np.lexsort((ids, name))
    name, ids = name[order], ids[order]
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(name)) - 1 if len(first) else first
    return name[first], ids[first], ids[first] != ids[last]


_GRAMS = {"bucket": pa.int32(), "batch": pa.int32(), "names": pa.binary(), "several": pa.binary()}
_SHARED = {"batch": pa.int32(), "names": pa.binary()}
_WINDOWS = {"bucket": pa.int32(), "batch": pa.int32(), "names": pa.binary(), "docs": pa.binary(), "which": pa.binary(), "several": pa.binary()}
_LOST = {"batch": pa.int32(), "lost": pa.binary(), "names": pa.binary(), "low": pa.binary()}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {'int' if t == pa.int32() else 'binary'}" for n, t in schema.items())


def _names(column) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def deduplicate_passages(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``text`` cut, plus ``n_words`` and ``n_removed``.

    Words stand between ASCII white space (0x20, 0x09-0x0D). A word goes if a window of ``window``
    words that covers it also starts in a document with a smaller ``doc_id``; windows are those
    of the input. ``text`` is the kept words joined by one space; with ``keep_text`` a text
    of which nothing went stays as it is. Null and empty texts have no words and become
    empty (stay, with ``keep_text``). Texts shorter than a window keep all words. Rows with a null id keep all words and take
    none from others. Rows that repeat an id are one document as far as others are concerned.
    Other columns stay; columns named ``n_words`` or ``n_removed`` are replaced.

    Documents go to batches by id; each batch names its grams, tasks that hold a range
    of names tell which are shared, and batches ask the same about windows of shared
    grams. A batch sends a name once, however many of its documents have it.
    """
    if window < WINDOW:
        raise ValueError(f"windows of {WINDOW} words or more")
    spark = docs.sparkSession
    buckets = partitions(spark)
    docs = docs.drop("n_words", "n_removed")
    order = docs.columns
    prepared = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("binary")})
    batch = batch_of(spark, "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    held = squeeze(prepared, batch)

    def name_grams(table: pa.Table) -> pa.Table:
        number = table["batch"][0].as_py()
        b = _Batch(table["data"].to_pylist(), window)
        name, first, _ = b.grams()
        name, _, several = _by_document(name, b.ids[b.doc[first]])
        return _rows(_GRAMS, [(k, number, name[s].tobytes(), np.packbits(several[s]).tobytes()) for k, s in name_ranges(name, buckets)])

    def shared_grams(table: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, np.uint64) for x in table["names"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) for x, n in zip(table["several"].to_pylist(), names, strict=True)]
        distinct, at, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[at[np.concatenate(several).astype(bool)]] = True
        flags = np.split(shared[at], np.cumsum([len(n) for n in names])[:-1])
        numbers = table["batch"].to_pylist()
        return _rows(_SHARED, [(b, n[f].tobytes()) for b, n, f in zip(numbers, names, flags, strict=True) if f.any()])

    def name_windows(docs_of: pa.Table, replies: pa.Table) -> pa.Table:
        shared = np.sort(_names(replies["names"]))
        if not len(shared):
            return _rows(_WINDOWS, [])
        number = replies["batch"][0].as_py()
        b = _Batch(docs_of["data"].to_pylist(), window)
        name, first, end = b.grams()
        at = np.minimum(np.searchsorted(shared, name), len(shared) - 1)
        is_shared = shared[at] == name
        count = np.append(0, np.cumsum(is_shared))
        edge, inner = b.starts + MARGIN, b.starts + window - MARGIN
        upto = np.searchsorted(end, inner, "right")
        head = np.minimum(np.searchsorted(first, edge, "right"), upto)
        some = count[np.maximum(head, np.searchsorted(first, b.starts))] > count[np.searchsorted(first, b.starts)]
        low = np.minimum(np.searchsorted(first, edge), upto)
        every = count[upto] - count[low] == upto - low
        starts = b.starts[some & every]
        found = span_names(b.names, starts, starts + window)
        found, lowest, several = _by_document(found, b.ids[b.doc[starts]])
        out = []
        for k, s in name_ranges(found, buckets):
            ids, which = np.unique(lowest[s], return_inverse=True)
            which = which.astype(np.min_scalar_type(len(ids)))
            out.append((k, number, found[s].tobytes(), ids.tobytes(), which.tobytes(), np.packbits(several[s]).tobytes()))
        return _rows(_WINDOWS, out)

    def lost_windows(table: pa.Table) -> pa.Table:
        names, lows, several = [], [], []
        for n, ids, which, some in zip(*(table[c].to_pylist() for c in ("names", "docs", "which", "several")), strict=True):
            n, ids = np.frombuffer(n, np.uint64), np.frombuffer(ids, np.int64)
            names.append(n)
            lows.append(ids[np.frombuffer(which, np.min_scalar_type(len(ids)))])
            several.append(np.unpackbits(np.frombuffer(some, np.uint8), count=len(n)).astype(bool))
        all_names, all_lows = np.concatenate(names), np.concatenate(lows)
        order = np.lexsort((all_lows, all_names))
        first = np.append(True, all_names[order][1:] != all_names[order][:-1])
        least = all_lows[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        lowest = np.empty_like(all_lows)
        lowest[order] = least
        out, at = [], 0
        for number, n, low, some in zip(table["batch"].to_pylist(), names, lows, several, strict=True):
            lost = lowest[at : at + len(n)] < low
            own = some & ~lost
            at += len(n)
            if lost.any() or own.any():
                out.append((number, n[lost].tobytes(), n[own].tobytes(), low[own].tobytes()))
        return _rows(_LOST, out)

    def cut(docs_of: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Batch(docs_of["data"].to_pylist(), window)
        removed = np.zeros(len(b.names), bool)
        if len(b.starts) and replies.num_rows:
            lost, partly = np.sort(_names(replies["lost"])), _names(replies["names"])
            lows = np.concatenate([np.frombuffer(x, np.int64) for x in replies["low"].to_pylist()])
            name = span_names(b.names, b.starts, b.starts + window)
            goes = np.zeros(len(name), bool)
            if len(lost):
                goes = lost[np.minimum(np.searchsorted(lost, name), len(lost) - 1)] == name
            if len(partly):
                by = np.argsort(partly)
                partly, lows = partly[by], lows[by]
                at = np.minimum(np.searchsorted(partly, name), len(partly) - 1)
                goes |= (partly[at] == name) & (lows[at] < b.ids[b.doc[b.starts]])
            change = np.zeros(len(b.names) + 1, np.int64)
            change[b.starts[goes]] += 1
            np.add.at(change, b.starts[goes] + window, -1)
            removed = np.cumsum(change[:-1]) > 0
        gone = np.add.reduceat(np.append(removed, 0), b.first).astype(np.int64) if len(b.first) else np.zeros(0, np.int64)
        gone[b.lengths == 0] = 0
        texts = []
        for i, words in enumerate(b.words):
            if gone[i]:
                stay = ~removed[b.first[i] : b.first[i] + b.lengths[i]]
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            elif keep_text:
                texts.append(b.rows["text"][i].as_py())
                continue
            texts.append(b" ".join(words))
        rows = b.rows.set_column(b.rows.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))
        return rows.append_column("n_words", pa.array(b.lengths)).append_column("n_removed", pa.array(gone))

    asked = held.groupBy("batch").applyInArrow(name_grams, _ddl(_GRAMS))
    shared = asked.groupBy("bucket").applyInArrow(shared_grams, _ddl(_SHARED))
    windows = held.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(name_windows, _ddl(_WINDOWS))
    lost = windows.groupBy("bucket").applyInArrow(lost_windows, _ddl(_LOST))
    schema = prepared.schema.add("n_words", "long").add("n_removed", "long")
    done = held.groupBy("batch").cogroup(lost.groupBy("batch")).applyInArrow(cut, schema)
    return done.withColumn("text", F.col("text").cast("string")).select(*order, "n_words", "n_removed")
