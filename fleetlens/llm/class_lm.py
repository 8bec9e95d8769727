"""Language-model scores from Brown's class-based bigrams, with classes found by exchange.

P(text) is the product over its tokens of P(class | class before) P(word | class). Words are
exchanged between classes until the contexts they stand in are as likely as can be under
their class. Contexts are the neighbours' groups: at first by how neighbours are spelt, and
in later rounds their classes of the round before.

Words are named by 64-bit hashes. Word counts and contexts are summed for ranges of names,
so neither the driver nor a task ever holds the vocabulary; classes follow from a word's
contexts and one matrix (classes x contexts), which is all that goes through the driver.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.calibrate import sum_over_tasks
from fleetlens.llm.common import batch_of, mix, name_ranges, partitions, squeeze, unsqueeze, words_of
from fleetlens.sources.scratch import stored

#: Classes of words; class 0 is the end token alone.
CLASSES = 32
SWEEPS = 5
ROUNDS = 2
#: The name of the end token.
END = np.uint64(0x0123456789ABCDEF)
#: Bytes of text whose counts are summed before they are sent.
CHUNK = 6 << 20
#: Weight of the class frequencies in a class's transitions.
ALPHA = 4.0


def _pack(**arrays) -> bytes:
    small = {k: v.astype(np.min_scalar_type(int(v.max(initial=0)))) if v.dtype.kind in "iu" and k != "names" else v for k, v in arrays.items()}
    return zstandard.compress(pickle.dumps(small), 1)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.decompress(blob))


class Tokens:
    """All tokens of some texts in a row, an end token after each text's words."""

    def __init__(self, texts: list[bytes | None]):
        words, lengths, data, starts, stops = words_of([None if t is None else t.lower() for t in texts])
        self.n = lengths + 1
        self.last = np.cumsum(self.n) - 1
        self.is_word = np.ones(int(self.n.sum()), bool)
        self.is_word[self.last] = False
        self.names = np.full(len(self.is_word), END, np.uint64)
        self.names[self.is_word] = words
        # How a word ends, 1 to CLASSES - 1; 0 for the end token.
        raw = np.frombuffer(data, np.uint8)
        self.spelt = np.zeros(len(self.names), np.int64)
        if len(words):
            ending = raw[stops - 1].astype(np.uint64) * np.uint64(256) + raw[np.maximum(stops - 2, starts)]
            self.spelt[self.is_word] = (mix(ending) % np.uint64(CLASSES - 1)).astype(np.int64) + 1

    def neighbours(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group before each token and after it; the end token's at both ends of a text."""
        before = np.concatenate([groups[-1:], groups[:-1]])
        before[np.concatenate([[0], self.last[:-1] + 1]) if len(self.last) else []] = 0
        after = np.concatenate([groups[1:], groups[:1]])
        after[self.last] = 0
        return before, after


def _sum_keys(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def context_counts(tokens: Tokens, groups: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct names with their counts, how they are spelt, and their contexts.

    A context is the group before (0 to CLASSES - 1) or CLASSES + the group after.
    """
    names, first, at, counts = np.unique(tokens.names, return_index=True, return_inverse=True, return_counts=True)
    before, after = tokens.neighbours(groups)
    width = 2 * CLASSES
    keys, times = _sum_keys(np.concatenate([at * width + before, at * width + CLASSES + after]))
    return {
        "names": names,
        "counts": counts,
        "spelt": tokens.spelt[first],
        "entries": np.bincount(keys // width, minlength=len(names)),
        "codes": keys % width,
        "times": times,
    }


def _split(found: dict[str, np.ndarray], buckets: int) -> pa.Table:
    ends = np.append(0, np.cumsum(found["entries"]))
    numbers, blobs = [], []
    for k, s in name_ranges(found["names"], buckets):
        e = slice(ends[s.start], ends[s.stop])
        numbers.append(k)
        blobs.append(
            _pack(**{c: found[c][s] for c in ("names", "counts", "spelt", "entries")}, **{c: found[c][e] for c in ("codes", "times")})
        )
    return pa.table({"bucket": pa.array(numbers, pa.int32()), "data": pa.array(blobs, pa.binary())})


def _merge(table: pa.Table) -> pa.Table:
    """The words of one range of names, summed over all that was sent."""
    parts = [_unpack(b) for b in table["data"].to_pylist()]
    names, at = np.unique(np.concatenate([p["names"] for p in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([p["counts"] for p in parts])).astype(np.int64)
    spelt = np.zeros(len(names), np.int64)
    spelt[at] = np.concatenate([p["spelt"] for p in parts])
    word = np.repeat(at, np.concatenate([p["entries"] for p in parts]).astype(np.int64))
    keys, times = _sum_keys(word * 2 * CLASSES + np.concatenate([p["codes"] for p in parts]), np.concatenate([p["times"] for p in parts]).astype(np.int64))
    entries = np.bincount(keys // (2 * CLASSES), minlength=len(names))
    blob = _pack(names=names, counts=counts, spelt=spelt, entries=entries, codes=keys % (2 * CLASSES), times=times)
    return pa.table({"bucket": table["bucket"].slice(0, 1), "data": pa.array([blob], pa.binary())})


def classes_of(words: dict[str, np.ndarray], likely: np.ndarray | None) -> np.ndarray:
    """The class under which a word's contexts are likeliest; without a matrix, as it is spelt."""
    if likely is None:
        found = words["spelt"].astype(np.int64)
    else:
        ends = np.append(0, np.cumsum(words["entries"], dtype=np.int64))
        found = np.zeros(len(words["names"]), np.int64)
        for s in range(0, len(found), 16384):
            e = min(s + 16384, len(found))
            span = slice(ends[s], ends[e])
            dense = np.zeros((e - s, 2 * CLASSES))
            dense[np.repeat(np.arange(e - s), words["entries"][s:e]), words["codes"][span]] = words["times"][span]
            found[s:e] = 1 + (dense @ likely.T).argmax(axis=1)
    found[words["names"] == END] = 0
    return found


def _likelihoods(sums: np.ndarray) -> np.ndarray:
    """Log probabilities of contexts for the classes from 1 on, each side by itself."""
    sides = sums.reshape(CLASSES, 2, CLASSES)[1:] + 0.1
    return np.log(sides / sides.sum(axis=2, keepdims=True)).reshape(CLASSES - 1, 2 * CLASSES)


def exchange(vocabulary: DataFrame, likely: np.ndarray | None = None, sweeps: int = SWEEPS) -> np.ndarray:
    """The matrix that gives every word its class, after ``sweeps`` moves of all words at once."""
    for _ in range(sweeps):
        now = likely

        def run(batches):
            total = np.zeros((CLASSES, 2 * CLASSES))
            for batch in batches:
                for blob in batch.column("data").to_pylist():
                    words = _unpack(blob)
                    of = np.repeat(classes_of(words, now), words["entries"])
                    total += np.bincount(of * 2 * CLASSES + words["codes"], words["times"], total.size).reshape(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        sums = sum_over_tasks(vocabulary.select("data").mapInArrow(run, "m binary"))
        likely = _likelihoods(np.zeros((CLASSES, 2 * CLASSES)) if sums is None else sums.reshape(CLASSES, 2 * CLASSES))
    return likely


def _first_vocabulary(train: DataFrame, buckets: int) -> DataFrame:
    """Words of the training texts with their counts and spelt contexts, without moving texts."""

    def run(batches):
        for whole in batches:
            held, size = [], 0
            for text in whole.column("text"):
                held.append(text.as_py())
                size += len(held[-1] or b"")
                if size > CHUNK:
                    tokens = Tokens(held)
                    yield from _split(context_counts(tokens, tokens.spelt), buckets).to_batches()
                    held, size = [], 0
            if held:
                tokens = Tokens(held)
                yield from _split(context_counts(tokens, tokens.spelt), buckets).to_batches()

    sent = train.select("text").mapInArrow(run, "bucket int, data binary")
    return stored(sent.groupBy("bucket").applyInArrow(_merge, "bucket int, data binary"), "lm_words")


def _answers(held: DataFrame, vocabulary: DataFrame, likely: np.ndarray, buckets: int) -> DataFrame:
    """For each batch the names that its texts and the vocabulary share, with counts and classes."""

    def ask(table: pa.Table) -> pa.Table:
        names = np.unique(Tokens(unsqueeze(table["data"].to_pylist())["text"].to_pylist()).names)
        found = list(name_ranges(names, buckets))
        return pa.table(
            {
                "bucket": pa.array([k for k, _ in found], pa.int32()),
                "batch": pa.array([table["batch"][0].as_py()] * len(found), pa.int32()),
                "names": pa.array([names[s].tobytes() for _, s in found], pa.binary()),
            }
        )

    def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if known.num_rows:
            words = _unpack(known["data"][0].as_py())
            of = classes_of(words, likely)
            for batch, blob in zip(asked["batch"].to_pylist(), asked["names"].to_pylist(), strict=True):
                names = np.frombuffer(blob, np.uint64)
                at = np.minimum(np.searchsorted(words["names"], names), len(of) - 1)
                at = at[words["names"][at] == names]
                out.append((batch, _pack(names=words["names"][at], counts=words["counts"][at], classes=of[at])))
        return pa.table({"batch": pa.array([b for b, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    asked = held.groupBy("batch").applyInArrow(ask, "bucket int, batch int, names binary")
    return asked.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(tell, "batch int, data binary")


def _look_up(tokens: Tokens, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts and classes of all tokens; count 0 and class -1 for unknown words."""
    parts = [_unpack(b) for b in replies["data"].to_pylist()]
    if not parts:
        return np.zeros(len(tokens.names), np.int64), np.full(len(tokens.names), -1)
    names, counts, classes = (np.concatenate([p[c] for p in parts]) for c in ("names", "counts", "classes"))
    order = np.argsort(names)
    names, counts, classes = names[order], counts[order].astype(np.int64), classes[order].astype(np.int64)
    at = np.minimum(np.searchsorted(names, tokens.names), len(names) - 1)
    hit = names[at] == tokens.names
    return np.where(hit, counts[at], 0), np.where(hit, classes[at], -1)


def _next_vocabulary(train: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Words with their counts and the classes around them."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        tokens = Tokens(unsqueeze(texts["data"].to_pylist())["text"].to_pylist())
        _, classes = _look_up(tokens, replies)
        return _split(context_counts(tokens, classes), buckets)

    sent = train.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, "bucket int, data binary")
    return stored(sent.groupBy("bucket").applyInArrow(_merge, "bucket int, data binary"), "lm_words")


def score_texts(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, sweeps: int = SWEEPS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for every row.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end token; a null
    or empty text is the end token alone. Rows where ``held_out`` (a condition on ``doc_id``)
    holds, or whose id is null, are scored but not learned from. ``base_score`` is the log10
    probability under add-one unigrams, ``score`` that of the class model, ``perplexity``
    10 ^ (-score / n_tokens). Unknown words are a class of their own: it follows a class as
    often as words that occur once in training do, and gives each word 1 / (V + 1), V being the
    number of distinct training tokens, so that an unknown word costs more than known ones do. If nothing
    is learned from, all words are unknown and certain, and scores are 0. Rows that repeat an id stay rows, and each is
    learned from. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    # Batches and ranges of names exchange messages: fewer, larger ranges, fewer messages.
    buckets = max(1, partitions(spark) // 2)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    learns = F.col("doc_id").isNotNull() & ~F.col("held_out")
    batch = batch_of(spark, "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    vocabulary = _first_vocabulary(rows.filter(learns), buckets)
    likely = exchange(vocabulary, sweeps=sweeps)
    for _ in range(rounds - 1):
        train = squeeze(rows.filter(learns), batch)
        vocabulary = _next_vocabulary(train, _answers(train, vocabulary, likely, buckets), buckets)
        likely = exchange(vocabulary, sweeps=sweeps)

    def totals(batches):
        out = np.zeros(CLASSES + 2)
        for b in batches:
            for blob in b.column("data").to_pylist():
                words = _unpack(blob)
                out[:CLASSES] += np.bincount(classes_of(words, likely), words["counts"], CLASSES)
                out[CLASSES] += words["counts"].sum(dtype=np.int64)
                out[CLASSES + 1] += len(words["names"])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["m"])

    summed = sum_over_tasks(vocabulary.select("data").mapInArrow(totals, "m binary"))
    in_class, n, v = (np.zeros(CLASSES), 0, 0) if summed is None else (summed[:CLASSES], int(summed[CLASSES]), int(summed[CLASSES + 1]))
    held = squeeze(rows, batch)
    answers = _answers(held, vocabulary, likely, buckets)

    def first_parts(texts: pa.Table, replies: pa.Table) -> pa.Table:
        """All of a score but the transitions, and the classes of the tokens to find those."""
        table = unsqueeze(texts["data"].to_pylist())
        tokens = Tokens(table["text"].to_pylist())
        counts, classes = _look_up(tokens, replies)
        first = tokens.last - tokens.n + 1
        known = counts > 0
        base = np.log10((counts + 1) / (n + v + 1))
        # An unknown word is one of at least as many as there are known ones.
        emitted = np.full(len(counts), -np.log10(v + 1))
        emitted[known] = np.log10(counts[known] / in_class[classes[known]])
        # Unknown words are class CLASSES; words that occur once, which stand for them, are marked.
        codes = np.where(known, classes, CLASSES) + np.where(counts == 1, 128, 0)
        raw = codes.astype(np.uint8).tobytes()
        sums = [np.add.reduceat(x, first) for x in (base, emitted, known.astype(np.int64))]
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "held_out": table["held_out"],
                "n_tokens": pa.array(tokens.n),
                "n_known": pa.array(sums[2]),
                "base_score": pa.array(sums[0]),
                "emitted": pa.array(sums[1]),
                "classes": pa.array([raw[s:e] for s, e in zip(first.tolist(), (tokens.last + 1).tolist(), strict=True)], pa.binary()),
            }
        )

    parts = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"
    marked = stored(held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(first_parts, parts), "lm_classes")
    width = CLASSES + 1

    def sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all tokens, codes before them (the end token's at a start), first tokens."""
        texts = batch.column("classes").to_pylist()
        codes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        before = np.concatenate([codes[:1], codes[:-1]])
        before[first] = 0
        return codes, before, first

    def count(batches):
        total = np.zeros(2 * width * width)
        for b in batches:
            learned = b.filter(pc.and_(pc.invert(b.column("held_out")), b.column("doc_id").is_valid()))
            if not learned.num_rows:
                continue
            codes, before, _ = sequences(learned)
            now, once = codes % 128, codes >= 128
            total[: width * width] += np.bincount(before % 128 * width + now, minlength=width * width)
            # What follows a word that occurs once, and where such words follow.
            rare = total[width * width :].reshape(width, width)
            rare[:, CLASSES] += np.bincount(before[once] % 128, minlength=width)
            after = before >= 128
            rare[CLASSES, :] += np.bincount(now[after], minlength=width)
            rare[CLASSES, CLASSES] += (after & once).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    counted = sum_over_tasks(marked.select("doc_id", "held_out", "classes").mapInArrow(count, "m binary"))
    steps = transitions(np.zeros(2 * width * width) if counted is None else counted)

    def finish(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes, before, first = sequences(b)
            moved = np.add.reduceat(steps[before % 128, codes % 128], first)
            score = np.asarray(b.column("emitted")) + moved if n else np.zeros(b.num_rows)
            tokens = np.asarray(b.column("n_tokens"))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(b.num_rows, n)), b.column("base_score"), pa.array(score), pa.array(10 ** np.minimum(-score / tokens, 300))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return marked.mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )


def transitions(counted: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), the unknown word as a class: every row sums to one.

    Counts are smoothed with class frequencies; ``counted`` holds the counts of classes, then
    those where words that occur once stand for unknown words.
    """
    width = CLASSES + 1
    seen, rare = counted.reshape(2, width, width)
    seen = seen.copy()
    seen[:, CLASSES] = rare[:, CLASSES]
    seen[CLASSES, :] = rare[CLASSES, :]
    share = seen[:CLASSES].sum(axis=0) + 0.5
    share = share / share.sum()
    smooth = seen + ALPHA * share
    return np.log10(smooth / smooth.sum(axis=1, keepdims=True))
