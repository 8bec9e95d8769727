"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import batch_of, free_name, numbered

LENGTH = 2048
END_ID = 0
#: Distinct words a task remembers the ids of: about 50 bytes each.
CACHED_WORDS = 500_000
#: Bytes of text that a task cuts into words at once, or one longer text.
BYTES_AT_ONCE = 1 << 23


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: Words that are one piece to the tokenizer, and that it does not change: lower-case Latin letters.
_LETTERS = "^[a-zß-öø-ÿ]+$"
#: The printable characters that byte-level models write bytes as: printable bytes are themselves.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: The bytes of letters beyond ASCII that are printed as another character.
_CHANGED = [(chr(b), chr(c)) for b, c in _BYTE_LETTERS.items() if b >= 0x80 and b != c]


class _Encoder:
    """Token ids of whole texts, each distinct word encoded once.

    For a tokenizer that lower-cases, drops white space and never joins across it, nor a Latin letter
    with the ASCII punctuation of ``TAIL`` after it. So words between ASCII white space are
    encoded alone, in lower case, and punctuation that ends a word after a letter apart from the rest.
    Words of plain letters go to the byte-level model itself. Texts with ``<|``, which may
    begin a special token, keep their case. A test compares with the ids of whole texts.
    Arrow cuts texts into words and numbers the distinct ones; Python sees a word only when it is new.
    """

    #: Without the apostrophe, which begins English endings, and what special tokens are written with.
    TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
    #: Words with a tail to encode apart.
    TAILED = f"[A-Za-zß-öø-ÿ][{re.escape(TAIL)}]+$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        whole = self._encode([" Straps  Été\ta.b 7\n", *(x + t for x in "Xé" for t in self.TAIL)])
        alone = self._encode(["straps", "été", "a.b", "7", "x", "é", *self.TAIL])
        apart = [x + t for x in alone[4:6] for t in alone[6:]]
        if self._letters([b"straps", "été".encode()]) != alone[:2] or whole != [sum(alone[:4], []), *apart]:
            raise ValueError("a lower-casing byte-level tokenizer that drops white space is needed")
        self._clear()

    def _clear(self):
        # A word's code is its place in words; its ids are flat[at : at + size]. The empty word has none.
        self.words, self.flat = pa.array([""], pa.string()), np.zeros(0, np.uint32)
        self.at, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> list[list[int]]:
        printed = b" ".join(words).decode("latin-1")
        if not printed.isascii():
            for byte, char in _CHANGED:
                printed = printed.replace(byte, char)
        return [[t.id for t in self.model.tokenize(word)] for word in printed.split()]

    def _add(self, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.size[codes] = sizes
        self.at[codes] = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])

    def _codes(self, words: pa.Array) -> np.ndarray:
        """The words' codes; new words get the next ones, as yet without ids."""
        known, *new = pa.chunked_array([self.words, words]).dictionary_encode().chunks  # an empty chunk goes
        self.words = known.dictionary  # that of all chunks: the known words stay first
        more = np.zeros(len(self.words) - len(self.at), np.int64)
        self.at, self.size = np.concatenate([self.at, more]), np.concatenate([self.size, more])
        return np.asarray(new[0].indices) if new else np.zeros(0, np.int32)

    def _learn(self, first: int):
        """Encodes the words from code ``first`` on, and what they consist of if they have tails."""
        tailed, _ = self._matching(first, self.TAILED)
        parts = []
        for word in self._bytes(tailed):
            base = word.rstrip(self.TAIL.encode())
            parts += [base, word[len(base) :]]
        parts = self._codes(pa.array(parts, pa.binary()).view(pa.string()))  # have no tails themselves
        plain, others = self._matching(first, _LETTERS)
        others = np.setdiff1d(others, tailed, assume_unique=True)
        found = self._letters(self._bytes(plain))
        found += self._encode([w.decode("utf-8", "replace") for w in self._bytes(others)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._add(np.concatenate([plain, others]), sizes, np.array([i for ids in found for i in ids], np.uint32))
        self._add(tailed, self.size[parts].reshape(-1, 2).sum(axis=1), self._ids(parts))

    def _bytes(self, codes: np.ndarray) -> list[bytes]:
        return self.words.take(pa.array(codes)).view(pa.binary()).to_numpy(zero_copy_only=False).tolist()

    def _matching(self, first: int, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        """The codes from ``first`` on whose words match, and the others. Bytes that are no UTF-8 match nothing."""
        found = np.asarray(pc.match_substring_regex(self.words.slice(first), pattern))
        return first + np.flatnonzero(found), first + np.flatnonzero(~found)

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        """The ids of the words of these codes, one after another."""
        size = self.size[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[codes] - ends + size, size) + np.arange(total)]

    def __call__(self, texts: pa.Array | list[bytes | None]) -> Iterator[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        texts = pc.fill_null(texts.cast(pa.binary()).view(pa.string()), "")  # not checked: texts are bytes
        part = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for start, stop in zip(cuts, cuts[1:]):
            yield from self._some(texts.slice(start, stop - start))

    def _some(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if len(self.words) > CACHED_WORDS:
            self._clear()
        lower, special = pc.ascii_lower(texts), pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, lower) if special.true_count else lower)
        bounds, first = np.asarray(lists.offsets).tolist(), len(self.words)
        codes = self._codes(lists.flatten())
        del lower, lists
        self._learn(first)
        end = np.array([END_ID], np.uint32)
        for start, stop in zip(bounds, bounds[1:]):
            yield np.concatenate([self._ids(codes[start:stop]), end])


def encode_pieces(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    value: Callable[[np.ndarray], object] | None = None,
    value_type: str = "array<int>",
    rows_at_once: int = 256,
) -> DataFrame:
    """``doc_id, piece, start, length, value``: every document's ids and then id 0, cut into pieces.

    ``value`` is ``value(ids)`` of each piece; by default the ids. A null or empty text is the
    end id alone. No shuffle; whole texts.
    """
    make = value or (lambda ids: ids.astype(np.int32))
    kind = {"array<int>": pa.list_(pa.int32()), "long": pa.int64()}[value_type]

    def run(batches):
        encoder = _Encoder(tokenizer)
        for whole in batches:
            found = encoder(whole.column("text"))
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                rows, piece, start, size, out = [], [], [], [], []
                for i, ids in enumerate(islice(found, batch.num_rows)):
                    for k, s in enumerate(range(0, len(ids), length)):
                        part = ids[s : s + length]
                        rows.append(i)
                        piece.append(k)
                        start.append(s)
                        size.append(len(part))
                        out.append(make(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(out, kind)],
                    ["doc_id", "piece", "start", "length", "value"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, piece int, start long, length long, value {value_type}")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in a bin, number of such bins) that use every length as often as it occurs.

    A bin takes the largest length that still fits, again and again. Then its smallest
    document gives way to two unpacked ones that fill the gap it leaves more tightly, as
    long as there are such. A finished bin is repeated while its lengths last, so the work
    depends on the number of distinct lengths and not on the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    sizes = np.arange(capacity + 1)
    bins = []

    def fitting() -> np.ndarray:
        """The largest length still there that is not above each number; 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    while left.any():
        items, gap = [], capacity
        below = fitting()
        while gap and (size := int(below[gap])):
            items.append(size)
            left[size] -= 1
            gap -= size
            if not left[size]:
                below = fitting()
        while gap and items:
            small = min(items)
            room = gap + small
            there = sizes[1:room][left[1:room] > 0]
            if not len(there):
                break
            below = fitting()
            second = below[room - there]
            # A length that is there once can't be taken twice: then the next smaller.
            twice = (second == there) & (left[there] < 2)
            second = np.where(twice, below[np.maximum(there - 1, 0)], second)
            both = np.where(second > 0, there + second, 0)
            best = int(both.argmax())
            if both[best] <= small:
                break
            items.remove(small)
            left[small] += 1
            for size in (int(there[best]), int(second[best])):
                items.append(size)
                left[size] -= 1
            gap = room - int(both[best])
        used = np.bincount(items, minlength=capacity + 1)
        need = used > 0
        times = 1 + int((left[need] // used[need]).min())
        left -= used * (times - 1)
        bins.append((sorted(items, reverse=True), times))
    return bins


def _slots(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset), by rank."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for items, times in bins:
        offset = 0
        for size in items:
            out.setdefault(size, []).append((taken.get(size, 0), sequence, offset))
            taken[size] = taken.get(size, 0) + times
            offset += size
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``: whole pieces in as few sequences as best-two-fit finds.

    The driver holds the number of pieces of each length (``capacity`` numbers at most), and
    packs lengths; pieces then take the places of their length by rank. Ranks are counted in
    buckets by a number written with each piece, so neither a length that a third of all pieces have
    nor the copies of one piece are a hot group.
    """
    row = free_name(pieces, "row")
    kept = numbered(pieces, row, "pieces").withColumn("bucket", batch_of(pieces.sparkSession, row))
    by_bucket = kept.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.select(
        "length",
        "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(best_two_fit(counts, capacity))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", row)
    ranked = kept.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    names = [c for c in kept.columns if c not in ("bucket", row)]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in names)

    def place(batches):
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("at"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                table = slots[int(size[rows[0]])]
                k = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                sequence[rows] = table[k, 1] + rank[rows] - table[k, 0]
                offset[rows] = table[k, 2]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    at = ranked.select(*names, (F.col("before") + F.col("rank")).alias("at"))
    return at.mapInArrow(place, f"{fields}, sequence_id long, offset long")
