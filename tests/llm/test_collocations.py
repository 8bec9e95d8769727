"""Phrase collocations beside plain counting."""

import random
import re
from collections import Counter

import pytest

from fleetlens.llm import collocations
from tests.llm.data import awkward

ENDS, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, report=2000):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in ENDS.split((text or "").translate(UPPER)):
            found = WORD.findall(piece)
            words[lang] += len(found)
            for k in range(1, 6):
                for i in range(len(found) - k + 1):
                    counts[lang, tuple(found[i : i + k])] += 1
    candidates = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    inside = {}
    for (lang, p), f in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside.get((lang, p[i : i + k]), 0), f)
    out = {}
    for (lang, phrase), a in candidates.items():
        if inside.get((lang, phrase), 0) >= a:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            l, r = counts[lang, phrase[:k]], counts[lang, phrase[k:]]  # noqa: E741
            cuts.append((1000 * a * words[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:report], 1):  # noqa: E741
            rows.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(rows)


def check(docs, least, report=2000):
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, report).collect())
    want = brute([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], least, report)
    assert got == want
    return got


def corpus(rng, n):
    vocabulary = ["the", "The", "of", "a", "a\x01", "a\x01b", "\U0010ffff", "\U0010ffffz", "é", "日本", "x" * 50, "\x00", " ", "b\u0085"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " "]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "fr", None, "e"]), text))
    rows += [("en", "very common pair " * 60)] * 20 + [("en", None), (None, ""), ("zz", " . , ")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_counting(spark, monkeypatch, small):
    """In small ranges phrases span many of them, and texts are cut into many chunks."""
    if small:
        monkeypatch.setattr(collocations, "RANGE_BYTES", 700)
        monkeypatch.setattr(collocations, "CHUNK", 90)
    docs = spark.createDataFrame(corpus(random.Random(4), 400), "lang string, text string").repartition(6)
    got = check(docs, 5)
    assert len(got) > 100 and {r[0] for r in got} > {"en", "und"}


def test_reports_the_best(spark):
    docs = spark.createDataFrame(corpus(random.Random(5), 200), "lang string, text string")
    assert max(r[1] for r in check(docs, 3, report=7)) == 7


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs, 2)
    assert collocations.collocations(docs.filter("doc_id = -1")).collect() == []
    assert collocations.collocations(docs.filter("text is null")).collect() == []


def test_chunks_lose_no_window():
    rng = random.Random(6)
    text = collocations.plain("".join(rng.choice(["word", "w", "x" * 300]) + rng.choice([" ", "  ", ".", " "]) for _ in range(500)).encode())
    whole = collocations.windows([(text, [])])
    for size in (1, 7, 60, 1000):
        parts = collocations.windows(list(collocations.chunks(text, size)))
        assert parts[0] == whole[0] and (parts[1] == whole[1]).all() and (parts[2] == whole[2]).all()


def test_products_past_64_bits(spark):
    """The score's SQL at counts that no test table reaches."""
    from pyspark.sql import functions as F

    a, n = 10**12 + 7, 10**15 + 3
    row = spark.range(1).select(
        F.lit("en").alias("lang"), F.lit("p q ").alias("phrase"), F.lit(2).alias("size"), F.lit(a).alias("f"),
        F.array(F.lit(a + 5)).alias("opened"), F.array(F.lit(a + 11)).alias("ends"), F.lit(n).alias("n"),
    )
    assert row.select(collocations.best_cut().alias("c")).first()["c"]["score"] == 1000 * a * n // ((a + 5) * (a + 11))
