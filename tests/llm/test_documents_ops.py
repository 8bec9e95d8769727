"""Document operators beside brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import class_lm, mixing, packing, quality, simhash, substring, toxicity
from fleetlens.llm.common import components, crc_mod, span_hashes, word_spans
from fleetlens.llm.queries import LLM_QUERIES, tokenizer_path
from tests.llm.data import awkward, documents, words

SMALL = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def empty(docs):
    return docs.filter("doc_id = -1")


# ---------------------------------------------------------------- helpers


def closure(edges):
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {x: root(x) for x in low}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closure(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hashes_depend_on_the_whole_word():
    data, starts, ends = word_spans(b"a ab abcdefgh abcdefghi abcdefghi abcdefghj a\0 a")
    names = span_hashes(data, starts, ends)
    assert names[3] == names[4] and names[0] == names[-1]
    assert len(set(names.tolist())) == 6


# ---------------------------------------------------------------- op10


def fingerprint(text, shingle=3, seed=42):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = SPLIT.findall(low)
    if not found:
        return 0
    parts = [" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_all_texts(spark):
    docs = awkward(spark)
    got = sorted((r["doc_id"] or -1, r["fp"] % 2**64) for r in simhash.fingerprints(docs).collect())
    assert got == sorted((r["doc_id"] or -1, fingerprint(r["text"])) for r in docs.collect())


def test_simhash_groups_match_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = words(rng, 120, 500)
        for _ in range(9):
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = "z"
            texts.append(" ".join(near))
    texts += ["", None, "a b c", "a b c"]
    docs = documents(spark, texts, first=10)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).collect()}
    fps = {10 + i: fingerprint(t) for i, t in enumerate(texts)}
    edges = [(a, b) for a in fps for b in fps if a <= b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert got == closure(edges)
    assert len(set(got.values())) < len(got) - 5


def test_near_links_find_every_pair_of_random_bits(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = closure([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert closure([(e["a"], e["b"]) for e in edges]) == want


def test_simhash_of_an_empty_table(spark):
    assert simhash.simhash_groups(empty(awkward(spark))).collect() == []


# ---------------------------------------------------------------- op5


def cut_brute(rows, window=50):
    split = [(i, SPLIT.findall(t or "")) for i, t in rows]
    low = {}
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if low[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i if i is not None else -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_passages_match_brute_force(spark, seed):
    rng = random.Random(seed)
    # Passages of all kinds: plain, few words, runs, periods.
    shared = [words(rng, rng.randrange(50, 90), 300) for _ in range(6)]
    shared += [["a"] * rng.randrange(45, 120), ["a", "b"] * 40, ["x"] * 20 + words(rng, 32, 300), words(rng, 24, 300) + ["y"] * 27]
    shared += [words(rng, 70, 2), words(rng, 49, 300), words(rng, 50, 300), [*(["q"] * 5 + ["r"] * 3) * 9]]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += words(rng, rng.randrange(0, 30), 300)
            passage = rng.choice(shared)
            start = rng.randrange(0, 4)
            text += passage[start : len(passage) - rng.randrange(0, 4)]
        texts.append(" ".join(text))
    rows = [(rng.choice([i, i, i, None]) if i % 9 == 0 else i, t) for i, t in enumerate(texts)] + [(70, None), (71, ""), (5, texts[8])]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    got = substring.deduplicate_passages(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == cut_brute(rows)
    assert got[0]["component"] == 4 and got[0]["row"] == "r"


def test_every_shared_window_shares_a_gram():
    """The bound on what the surroundings of a passage may change, over many surroundings."""
    rng = random.Random(11)
    for _ in range(400):
        inner = words(rng, 50, rng.choice([2, 3, 10, 1000]))
        if rng.random() < 0.5:
            at = rng.randrange(40)
            inner[at : at + rng.randrange(10)] = [inner[at]] * 10
            inner = inner[:50] + words(rng, max(0, 50 - len(inner)), 10)
        found = []
        for _ in range(2):
            pad = rng.choice([0, 1, 5, 30])
            text = words(rng, pad, 3) + [inner[0]] * rng.randrange(6) + inner + [inner[-1]] * rng.randrange(6) + words(rng, pad, 3)
            at = next(k for k in range(len(text)) if text[k : k + 50] == inner)
            data, starts, ends = word_spans(" ".join(text).encode())
            names = span_hashes(data, starts, ends)
            symbol, start = substring.parse(names, np.zeros(len(names), np.int64))
            name, first, end = substring.grams(symbol, start, np.full(len(names), len(names)))
            head = (first >= at) & (first <= at + substring.MARGIN) & (end <= at + 50 - substring.MARGIN)
            inside = (first >= at + substring.MARGIN) & (end <= at + 50 - substring.MARGIN)
            found.append((set(name[head].tolist()), set(name[inside].tolist()), set(name.tolist())))
        assert found[0][0] & found[1][0]
        assert found[0][1] <= found[1][2] and found[1][1] <= found[0][2]


def test_passages_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring.deduplicate_passages(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == cut_brute(rows)
    kept = {r["doc_id"]: r["text"] for r in substring.deduplicate_passages(docs, keep_text=True).collect()}
    assert kept[3] == "  \n\t " and kept[1] is None and kept[5] == ""
    assert substring.deduplicate_passages(empty(docs)).collect() == []


# ---------------------------------------------------------------- op4


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    docs = awkward(spark).union(spark.read.parquet(f"{SMALL}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars", *[F.lit(None).alias(c) for c in ("key", "batch", "fp", "row", "rank", "data", "rate", "component")]))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = packing.pack(packing.encode_pieces(docs, tokenizer_path(), length=512), 512).collect()
    whole = sorted((r["doc_id"] or -1, tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect())
    # Equal texts under one id: their pieces can't be told apart, and need not be.
    pieces = sorted((r["doc_id"] or -1, r["start"], r["piece"], list(r["value"])) for r in out)
    want = sorted((i, s, s // 512, ids[s : s + 512]) for i, ids in whole for s in range(0, len(ids), 512))
    assert pieces == want
    n = check_packing(out, 512)
    least = -(-sum(r["length"] for r in out) // 512)
    assert n <= least * 1.03 + 1


def test_encoder_matches_the_tokenizer_on_odd_words():
    encoder = packing._Encoder(tokenizer_path())
    texts = ["it's a test. it's, A.B. end.. <|endoftext|>x. Y<|ENDOFTEXT|> e.g., (x). don't. é. 3. ., . ", "İstanbul. Σας, ΟΔΟΣ. a\x1cb.c naïve ﬁ. K."]
    for text, ids in zip(texts, encoder([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_encoder_matches_the_tokenizer_over_many_batches_of_words(monkeypatch):
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", 400)
    monkeypatch.setattr(packing, "CACHED_WORDS", 300)
    rng = random.Random(4)
    pool = [*"abXé\u00c9\u0130\u03a3\u0301.,.!?;:'\"()[]<|>-$#_/29 \t\n\x0b\x1c\x85\xa0\u3000\u6771\0", "<|endoftext|>", "'s", "été!?", "straps***", "'LL"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [None, "", " \n ", "été. " * 300]
    encoder = packing._Encoder(tokenizer_path())
    found = list(encoder([t if t is None else t.encode() for t in texts]))
    assert [ids.tolist() for ids in found] == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    raw = [b"\xff\xc3\xa9. a\xc3 \xe2\x82. b\xc3, ", b"\xc3\xa9\xc3\xa9!"]
    whole = [encoder.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in raw]
    assert [ids.tolist() for ids in encoder(raw)] == [[*ids, 0] for ids in whole]
    assert list(encoder([])) == []


def test_encoder_sends_each_word_once_and_its_tail_apart(monkeypatch):
    encoder, sent = packing._Encoder(tokenizer_path()), []
    for name in ("_encode", "_letters"):
        real = getattr(encoder, name)
        # One argument or many: a list of words, or a word.
        monkeypatch.setattr(encoder, name, lambda x, real=real: sent.extend([x] if isinstance(x, str) else [w if isinstance(w, str) else w.decode() for w in x]) or real(x))
    texts = [b"Caf\xc3\xa9! caf\xc3\xa9. caf\xc3\xa9 x***", b"CAF\xc3\xa9 x x, 7", b"caf\xc3\xa9!"]
    for _ in range(2):
        for text, ids in zip(texts, encoder(texts)):
            assert ids.tolist() == [*encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids, 0]
    assert sorted(sent) == sorted(["café", "x", "!", ".", "***", ",", "7"])


def test_best_two_fit_replaces_the_smallest():
    # Greedy: 6 + 3, a gap of 1. Without the 3 a gap of 4 takes 2 + 2.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    rng = random.Random(2)
    counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(60)}
    used = {}
    for items, times in packing.best_two_fit(counts, 100):
        assert sum(items) <= 100
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_packing_of_an_empty_table(spark):
    assert packing.pack(packing.encode_pieces(empty(awkward(spark)), tokenizer_path())).collect() == []


# ---------------------------------------------------------------- op7


def test_poisson_counts_by_hand(spark):
    docs = awkward(spark)
    weights = spark.createDataFrame([("a", 3.0), (None, 40.0), ("b", 0.0), ("unseen", 2.0)], "source string, weight double")
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(docs, weights).collect()}
    assert rates == {"a": 3 / 43 * 12 / 6, None: 40 / 43 * 12 / 2, "b": 0.0, "c": 0.0}
    out = mixing.mix_sources(docs, weights, seed="t").collect()
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    import hashlib

    for r in docs.collect():
        u = int(hashlib.md5(f"t:{'' if r['doc_id'] is None else r['doc_id']}:1".encode()).hexdigest()[:12], 16) / 2**48
        rate, k = rates[r["source"]], 0
        p = upto = math.exp(-rate)
        while upto <= u:
            k += 1
            p *= rate / k
            upto += p
        assert got.get(r["doc_id"], 0) == k
    assert set(out[0].asDict()) == {*docs.columns, "mix_copy"}
    assert mixing.mix_sources(empty(docs)).collect() == []
    assert mixing.mix_sources(docs, weights.filter("weight < 0")).collect() == []


def test_large_rates_and_their_mean(spark):
    docs = documents(spark, [(i, "x", "big" if i else "small") for i in range(2000)])
    weights = spark.createDataFrame([("small", 1.0), ("big", 1.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.mix_sources(docs, weights).groupBy("source").count().collect()}
    assert abs(n["small"] - 1000) < 160 and abs(n["big"] - 1000) < 160


# ---------------------------------------------------------------- op3, op6


def held_out_accuracy(spark, name, label, sf="/root/testdata/sf0.01"):
    out = LLM_QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    rows = out.filter(F.col(label).isNotNull()).collect()
    assert len(rows) > 50
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op3_fourier_quality", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op6_toxic_lexicon", "toxic") > 0.93


@pytest.mark.parametrize("score, label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_take_awkward_rows(spark, score, label):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, 0), (6, None), (None, 1), (99, 1)], f"doc_id long, {label} int")
    held = crc_mod(F.col("doc_id"), 4) == 2
    out = score(docs, labels, held).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert score(empty(docs), labels, held).collect() == []
    assert len(score(docs, labels.filter("doc_id = -5"), held).collect()) == docs.count()


def test_lexicon_folds_and_skips_exceptions():
    lexicon = toxicity.Lexicon({("loser", True): 3.0, ("scumm", False): 2.0}, ["sore loser"])
    for text in ("Loser!", "a l0ser", "lоser", "ＬＯＳＥＲ", "a 1oser.", "lo\u200bser"):
        assert lexicon.total(toxicity.fold(text)) == 3.0, text
    for text in ("losers", "closer", "the sore loser", "", "l o s e r"):
        assert lexicon.total(toxicity.fold(text)) == 0.0, text
    assert lexicon.total(toxicity.fold("Scummy scumm loser")) == 7.0
    assert lexicon.rate("loser") > lexicon.rate("loser and many other words here") > 0 == lexicon.rate(None)


def test_copies_of_a_toxic_text_keep_its_terms(spark):
    rng = random.Random(8)
    toxic = [" ".join([*words(rng, 12, 300), "moron", *words(rng, 12, 300)]) for _ in range(60)]
    clean = [" ".join(words(rng, 25, 300)) for _ in range(200)]
    # Copies in other spacing, case and marks are copies too.
    copied = [toxic[0], toxic[0].upper() + "!", toxic[0].replace(" ", "  ")] * 100
    docs = documents(spark, toxic + copied + clean)
    n = len(toxic + copied)
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(n + len(clean))], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, labels.select("doc_id", F.col("toxic").alias("y")))
    assert [t for t, _ in lexicon.terms] == ["moron"]
    wrong = toxicity.score_toxicity(docs, labels, F.lit(False)).join(labels, "doc_id").filter("predicted != toxic")
    assert wrong.count() == 0


def test_every_marking_form_gets_a_term():
    odds = toxicity._Odds(3000, 3000)

    def terms(rows):
        """``rows``: word -> (toxic, clean) documents, one word each."""
        counts = {}
        for word, n in rows.items():
            for form in toxicity.word_forms([word]):
                counts[form] = tuple(map(sum, zip(counts.get(form, (0, 0)), n, strict=True)))
        return toxicity.choose_terms({f: n for f, n in counts.items() if odds.strong(*n)}, odds)

    def missed(rows):
        lexicon = toxicity.Lexicon(terms(rows))
        return [w for w in rows if not lexicon.total(toxicity.fold(w))]

    assert list(terms({"moron": (100, 0)})) == [("moron", True)]
    # A rarer form, however rare; another word of the same letters; a longer word beside clean ones.
    assert missed({"idiot": (95, 0), "idiots": (5, 0)}) == []
    assert missed({"idiot": (950, 0), "idiots": (50, 0), "idiocy": (40, 0)}) == []
    assert missed({"fool": (300, 2), "foolish": (30, 0), "foolscap": (0, 60)}) == ["foolscap"]
    assert missed({"fool": (950, 0), "foolscap": (3, 20)}) == ["foolscap"]
    # Many rare words of one prefix, none of them a term by itself.
    rare = {f"scum{c}x": (5, 0) for c in "abcdefgh"}
    assert missed({"scummy": (600, 0), **rare}) == []


def test_isotonic_shares():
    from fleetlens.llm.calibrate import pool_adjacent

    at, share = pool_adjacent(np.arange(5.0), np.array([0, 2, 1, 3, 4]), np.array([2, 2, 2, 4, 4]))
    assert share.tolist() == [0, 0.75, 0.75, 0.75, 1]
    assert at.tolist() == [0, 1, 2, 3, 4]


# ---------------------------------------------------------------- op9


def test_base_scores_and_class_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(awkward(spark).select("doc_id", "text").filter("doc_id is null or doc_id < 7"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in SPLIT.findall(t or "")] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = {}
    for t, h, (i, _) in zip(tokens, held, rows, strict=True):
        for w in t if not h and i is not None else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (-1 if i is None else i, h, len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t), 6))
        for (i, _), t, h in zip(rows, tokens, held, strict=True)
    )
    out = class_lm.score_texts(docs, crc_mod(F.col("doc_id"), 7) == 2).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    unseen = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_class_probabilities_sum_to_one():
    counted = np.random.default_rng(1).integers(0, 9, 2 * (class_lm.CLASSES + 1) ** 2).astype(float)
    assert np.allclose((10 ** class_lm.transitions(counted)).sum(axis=1), 1)


def test_exchange_separates_two_vocabularies(spark):
    rng = random.Random(4)
    # Words a0..a19 stand beside words b0..b19, whatever their spelling.
    texts = [" ".join(f"{'ab'[k % 2]}{rng.randrange(20)}x{rng.randrange(3)}" for k in range(200)) for _ in range(40)]
    docs = documents(spark, texts)
    out = class_lm.score_texts(docs, F.lit(False)).collect()
    assert sum(r["score"] for r in out) > 0.9 * sum(r["base_score"] for r in out) and all(r["score"] > r["base_score"] for r in out)


def test_scores_without_training(spark):
    docs = awkward(spark)
    out = class_lm.score_texts(docs, F.lit(True)).collect()
    assert len(out) == docs.count()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in out if r["doc_id"] is not None)
    assert class_lm.score_texts(empty(docs), F.lit(False)).collect() == []


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from fleetlens.sources.scratch import stored

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        assert name == "mixing" or 0 < docs.count() <= before.count()
    out = P.STAGES[-1][1](spark, docs, "/root/testdata/sf0.01").collect()
    assert check_packing(out, 2048) > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]


def test_toxic_rows_go_whatever_their_id(spark):
    rng = random.Random(6)
    clean = [" ".join(words(rng, 20, 300)) for _ in range(80)]
    toxic = [" ".join([*words(rng, 10, 300), "moron", *words(rng, 10, 300)]) for _ in range(60)]
    odd = [(None, toxic[0], "s"), (None, clean[0], "s"), (0, toxic[1], "s")]
    docs = documents(spark, clean + toxic + odd)
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(1, 140)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels, F.lit(False))
    assert kept.schema == docs.schema
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.collect()) == sorted([*enumerate(clean), (-1, clean[0])])


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(words(random.Random(k), 60, 3000)) for k in range(4))
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (None, c), (None, c), (None, a), (7, d), (7, d)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == sorted([(1, a), (5, b), (-1, c), (7, d)])
    assert simhash.one_of_each_group(empty(docs)).collect() == []
