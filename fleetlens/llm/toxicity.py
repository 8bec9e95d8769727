"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fleetlens.llm.calibrate import pool_adjacent
from fleetlens.sources.scratch import stored

#: The lexicon is learned from at most this many labelled documents of each class, those whose ids hash smallest.
LEARN_ROWS = 6000
#: A term occurs in at least this many different toxic texts, and this many times as often as in clean ones,
#: and that is no chance: the likelihood ratio statistic of its counts is at least this.
LEAST_ROWS = 4
LEAST_RATIO = 20.0
LEAST_SURPRISE = 28.0
#: A prefix stands for its longer forms until one of them holds this share of its rows.
FORM_SHARE = 0.9
SHORTEST, LONGEST = 4, 12
THRESHOLD = 0.7

# Letters of other scripts, digits and signs that are read as Latin letters.
LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "",
}
_FOLD = {ord(k): v for k, v in LOOKS_LIKE.items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
#: Full-width forms of digits and signs fold twice.
_FOLD |= {0xFEE0 + ord(k): v for k, v in LOOKS_LIKE.items() if len(k) == 1 and 0x21 <= ord(k) <= 0x7E}
_ASCII_FOLD = bytes(_FOLD.get(i, chr(i)).encode()[0] if i < 128 and i in _FOLD else i for i in range(256))
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, with look-alike letters, digits and signs as the letters they stand for."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_ASCII_FOLD).decode()
    return text.translate(_FOLD)


class Lexicon:
    """Terms with weights, found at word starts; whole words, or prefixes of words.

    ``exceptions``: folded phrases; a term inside one does not count.
    """

    def __init__(self, terms: dict[tuple[str, bool], float], exceptions: Iterable[str] = ()):
        self.terms, self.exceptions = dict(terms), sorted(set(exceptions))
        self.machine = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for (term, whole), weight in self.terms.items():
            # The digit 1 folds to i, and may stand for l.
            for form in {term, term.replace("l", "i")}:
                found.setdefault(form, []).append((whole, weight))
        for phrase in self.exceptions:
            found.setdefault(phrase, []).append((True, None))
        for form, values in found.items():
            self.machine.add_word(form, (len(form), values))
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def total(self, folded: str) -> float:
        """The weights of all terms found; of several that start at one place the heaviest counts."""
        if self.empty or not folded:
            return 0.0
        hits: dict[int, float] = {}
        spans = []
        for end, (size, values) in self.machine.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            open_end = end + 1 < len(folded) and folded[end + 1].isalnum()
            for whole, weight in values:
                if whole and open_end:
                    continue
                if weight is None:
                    spans.append((start, end))
                else:
                    hits[start] = max(hits.get(start, 0.0), weight)
        return sum(w for at, w in hits.items() if not any(s <= at <= e for s, e in spans))

    def rate(self, text: str | None) -> float:
        """Weight for each hundred words, and a part that doesn't shrink with the text's length."""
        folded = fold(text or "")
        total = self.total(folded)
        if not total:
            return 0.0
        words = 1 + folded.count(" ") + folded.count("\n")
        return float(np.log1p(100 * total / words))


def word_forms(words: Iterable[str]) -> set[tuple[str, bool]]:
    """Whole words and their prefixes."""
    forms = set()
    for w in words:
        if len(w) >= SHORTEST:
            forms.add((w, True))
            forms.update((w[:n], False) for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return forms


class _Odds:
    """Log odds of a toxic document against a clean one, from the documents of each that hold something."""

    def __init__(self, bad: int, good: int):
        self.bad, self.good = bad, good

    def __call__(self, in_bad: int, in_good: int) -> float:
        return float(np.log((in_bad + 0.5) / (self.bad + 1)) - np.log((in_good + 0.5) / (self.good + 1)))

    def strong(self, in_bad: int, in_good: int) -> bool:
        """Whether the counts are those of a term, as ``learn_lexicon`` asks of all forms."""
        if in_bad < LEAST_ROWS or self(in_bad, in_good) < np.log(LEAST_RATIO):
            return False
        share, held = self.bad / (self.bad + self.good), in_bad + in_good
        clean = in_good * np.log(in_good / (held * (1 - share))) if in_good else 0.0
        return 2 * (in_bad * np.log(in_bad / (held * share)) + clean) >= LEAST_SURPRISE


def choose_terms(counts: dict[tuple[str, bool], tuple[int, int]], odds: _Odds) -> dict[tuple[str, bool], float]:
    """Terms and weights from forms that mark toxic documents; every such form's documents get a term.

    From the shortest marking prefix the longest form that still holds most of its
    documents is taken: a whole word that always ends alike, or the stem of many words. A
    word whose longer forms are no cleaner than a term gives way to its stem. The forms that
    the term does not match go on in the same way; a prefix stays as well where what it
    holds beside its terms still marks toxic documents.
    """
    by_start: dict[str, list[tuple[str, bool]]] = {}
    for form in counts:
        by_start.setdefault(form[0][:SHORTEST], []).append(form)
    terms = {}
    for forms in by_start.values():
        left = sorted(forms, key=lambda f: (len(f[0]), f[1]))
        passed = []
        while left:
            root = left[0]
            enough = FORM_SHARE * counts[root][0]
            same = [f for f in left if f == root or not root[1] and f[0].startswith(root[0]) and counts[f][0] >= enough]
            best = max(same, key=lambda f: (len(f[0]), f[1]))
            stem = (best[0], False)
            if best[1] and stem in counts:
                bad, good = (x - y for x, y in zip(counts[stem], counts[best], strict=True))
                if bad > 0 and bad * odds.good >= LEAST_RATIO * good * odds.bad:
                    best = stem
            terms[best] = odds(*counts[best])
            passed += [f for f in left if not f[1] and f != best and best[0].startswith(f[0])]
            left = [f for f in left if f != best and f not in passed and (best[1] or not f[0].startswith(best[0]))]
        for prefix in sorted(passed, key=lambda f: -len(f[0])):
            under = [counts[t] for t in terms if t[0].startswith(prefix[0])]
            rest = counts[prefix][0] - sum(n[0] for n in under), counts[prefix][1] - max(n[1] for n in under)
            if odds.strong(*rest):
                terms[prefix] = odds(*rest)
    return terms


def _sample(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """``text, y`` of at most ``rows`` documents of each class; texts of the same folded words are one of their class."""

    def named(batches):
        for batch in batches:
            words = (_WORD.findall(fold(t.as_py().decode("utf-8", "replace") if t.is_valid else "")) for t in batch.column("text"))
            names = [xxhash.xxh3_128_digest(" ".join(w).encode()) for w in words]
            yield batch.append_column("name", pa.array(names, pa.binary()))

    parts = []
    for condition in ("y >= 0.5", "y < 0.5"):
        ids = known.filter(condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        parts.append(docs.join(ids, "doc_id").select(F.col("text").cast("binary").alias("text"), "y"))
    whole = parts[0].union(parts[1]).select("text", (F.col("y") >= 0.5).cast("double").alias("y"))
    return stored(whole.mapInArrow(named, "text binary, y double, name binary").dropDuplicates(["y", "name"]).select("text", "y"), "toxicity_sample")


def _count(sample: DataFrame, found) -> DataFrame:
    """``form, whole, bad, good``: different texts of each class for everything ``found`` in a folded text."""

    def run(batches):
        seen = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                if text.is_valid:
                    words = _WORD.findall(fold(text.as_py().decode("utf-8", "replace")))
                    seen[y >= 0.5].update(found(words))
        forms = list(seen[True].keys() | seen[False].keys())
        for at in range(0, len(forms), 50_000):
            part = forms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _ in part], pa.string()),
                    pa.array([w for _, w in part], pa.bool_()),
                    pa.array([seen[True][f] for f in part], pa.int64()),
                    pa.array([seen[False][f] for f in part], pa.int64()),
                ],
                ["form", "whole", "bad", "good"],
            )

    counted = sample.mapInArrow(run, "form string, whole boolean, bad long, good long")
    return counted.groupBy("form", "whole").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _contexts(sample: DataFrame, marking: set[tuple[str, bool]]) -> DataFrame:
    """``form, whole, contexts``: the different neighbours that marking forms have in toxic documents."""

    def run(batches):
        for batch in batches:
            found = set()
            for text in batch.column("text"):
                words = ["", *_WORD.findall(fold(text.as_py().decode("utf-8", "replace") if text.is_valid else "")), ""]
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    found.update((*form, before, after) for form in word_forms([word]) if form in marking)
            if found:
                kinds = (pa.string(), pa.bool_(), pa.string(), pa.string())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["form", "whole", "before", "after"])

    seen = sample.filter("y >= 0.5").select("text").mapInArrow(run, "form string, whole boolean, before string, after string")
    return seen.groupBy("form", "whole").agg(F.countDistinct("before", "after").alias("contexts"))


def learn_lexicon(docs: DataFrame, known: DataFrame, exceptions: Iterable[str] = (), rows: int = LEARN_ROWS) -> Lexicon:
    """A lexicon from documents with known (doc_id, y); two classes are needed, or it is empty.

    Two-word phrases with a term that mark clean documents become exceptions, beside those given.
    """
    given = [fold(p) for p in exceptions]
    sample = _sample(docs, known, rows)
    number = {bool(r["bad"]): r["n"] for r in sample.groupBy((F.col("y") >= 0.5).alias("bad")).agg(F.count("*").alias("n")).collect()}
    if len(number) < 2:
        return Lexicon({}, given)
    odds = _Odds(number[True], number[False])
    marks = F.log((F.col("bad") + 0.5) / (number[True] + 1)) - F.log((F.col("good") + 0.5) / (number[False] + 1))
    share = number[True] / (number[True] + number[False])
    held = F.col("bad") + F.col("good")
    surprise = 2 * (
        F.col("bad") * F.log(F.col("bad") / (held * share))
        + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (held * (1 - share)))).otherwise(0.0)
    )
    strong = (F.col("bad") >= LEAST_ROWS) & (marks >= float(np.log(LEAST_RATIO))) & (surprise >= LEAST_SURPRISE)
    forms = {(r["form"], r["whole"]): (r["bad"], r["good"]) for r in _count(sample, word_forms).filter(strong).collect()}
    # Texts copied with small changes say the same thing again: what counts is the places a form stands in.
    varied = _contexts(sample, set(forms)).filter(F.col("contexts") >= LEAST_ROWS).collect()
    varied = {(r["form"], r["whole"]): r["contexts"] for r in varied}
    evidence = {f: (min(bad, varied.get(f, 0)), good) for f, (bad, good) in forms.items()}
    terms = choose_terms({f: n for f, n in evidence.items() if odds.strong(*n)}, odds)

    def phrases(words: list[str]) -> set[tuple[str, bool]]:
        found = set()
        for i, w in enumerate(words):
            if (w, True) in terms or any((w[:n], False) in terms for n in range(SHORTEST, min(len(w), LONGEST) + 1)):
                found.update((" ".join(words[k : k + 2]), True) for k in (i - 1, i) if 0 <= k <= len(words) - 2)
        return found

    clean = _count(sample, phrases).filter((F.col("good") >= LEAST_ROWS) & (marks <= float(-np.log(2)))).collect()
    return Lexicon(terms, [*given, *(r["form"] for r in clean)])


def _scorer(terms: dict, exceptions: list[str]):
    def run(batches):
        lexicon = Lexicon(terms, exceptions)
        for batch in batches:
            rates = [lexicon.rate(t.as_py().decode("utf-8", "replace") if t.is_valid else "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rates, pa.float64())], ["doc_id", "rate"])

    return run


def toxicity_rates(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, rate`` for every row, over whole texts, without a shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_scorer(lexicon.terms, lexicon.exceptions), "doc_id long, rate double")


#: The rate of a row of ``drop_toxic``'s input, written with it.
RATE = "__toxic_rate"


def _known(labels: DataFrame, held_out: Column, label: str) -> DataFrame:
    """``doc_id, y`` of the rows that may be learned from."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    return known.filter(~F.coalesce(held_out, F.lit(False)))


def _calibrated(rated: DataFrame, known: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Rates and the shares of toxic rows there, never falling, from ``doc_id, rate``."""
    grid = F.ceil(F.col("rate") * 1000) / 1000.0
    bins = rated.join(known, "doc_id").groupBy(grid.alias("at")).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    bins = sorted((r["at"], r["y"], r["n"]) for r in bins)
    return pool_adjacent(*map(np.array, zip(*bins, strict=True))) if bins and lexicon.terms else (np.zeros(1), np.zeros(1))


def _scores(rate: np.ndarray, at: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The share of the lowest calibrated rate that is not below: a rate above 0 never counts as 0."""
    return share[np.minimum(np.searchsorted(at, rate - 1e-9), len(at) - 1)]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    label: str = "toxic",
    exceptions: Iterable[str] = (),
    rows: int = LEARN_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; score is the calibrated share of toxic rows.

    ``held_out``: a condition on ``doc_id``; such rows, rows with a null id and rows without a
    label are not learned from. ``labels``: (doc_id, ``label``); nulls are no labels, and of
    several labels the mean counts. Empty and null texts hold no term. Without labels of both
    classes every score is 0. Rows that repeat an id stay rows. Only ``doc_id`` and ``text`` of
    ``docs`` are read, and only the text enters a score.

    The lexicon is learned from ``rows`` documents of each class at most; the scores of all
    documents that may be learned from are then calibrated (isotonic, on rates rounded to a
    thousandth, so the driver holds a bounded table).
    """
    known = _known(labels, held_out, label)
    lexicon = learn_lexicon(docs, known, exceptions, rows)
    rated = stored(toxicity_rates(docs, lexicon).withColumn("held_out", F.coalesce(held_out, F.lit(False))), "toxicity_rates")
    at, share = _calibrated(rated, known, lexicon)

    def run(batches):
        for batch in batches:
            rate = np.asarray(batch.column("rate"), np.float64)
            score = _scores(rate, at, share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rated.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(
    docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", exceptions: Iterable[str] = (), rows: int = LEARN_ROWS
) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` predicts 0 for, each judged by its own text, whatever its id.

    A column ``__toxic_rate`` of ``docs`` is taken away. Null and empty texts stay.
    """
    docs = docs.drop(RATE)
    known = _known(labels, held_out, label)
    lexicon = learn_lexicon(docs, known, exceptions, rows)
    terms, phrases = lexicon.terms, lexicon.exceptions

    def run(batches):
        judge = Lexicon(terms, phrases)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rates = [judge.rate(t.as_py().decode("utf-8", "replace") if t.is_valid else "") for t in texts]
            yield batch.append_column(RATE, pa.array(rates, pa.float64()))

    # Texts are scored once: the rate is written with its row.
    rated = stored(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(RATE, DoubleType())])), "toxicity_rows")
    at, share = _calibrated(rated.select("doc_id", F.col(RATE).alias("rate")), known, lexicon)
    first = int(np.searchsorted(share, THRESHOLD))
    kept = F.lit(True) if first == len(share) else F.col(RATE) - 1e-9 <= (float(at[first - 1]) if first else -np.inf)
    return rated.filter(kept).drop(RATE)
