"""Class-based scores of texts that no model should like."""

import random
import string
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import class_lm
from fleetlens.llm.common import crc_mod

TABLE = Path("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.skipif(not TABLE.exists(), reason="driver tables are not here")
def test_junk_scores_below_real_texts(spark):
    rng = random.Random(8)
    ids = [i for i in range(10**7, 10**7 + 1000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    junk = [(i, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 12))) for _ in range(80))) for i in ids]
    real = spark.read.parquet(str(TABLE)).select("doc_id", "text")
    docs = real.unionByName(spark.createDataFrame(junk, real.schema))
    out = class_lm.score_texts(docs, crc_mod(F.col("doc_id"), 7) == 2).collect()
    per_token = {r["doc_id"]: r["score"] / r["n_tokens"] for r in out if r["n_tokens"] > 20}
    texts = [v for k, v in per_token.items() if k < 10**7]
    assert max(per_token[i] for i in ids) < sorted(texts)[len(texts) // 50]
    assert sorted(r["perplexity"] for r in out if r["doc_id"] in set(ids))[20] > 10 * sorted(10**-v for v in texts)[len(texts) // 2]
    # Better than unigrams where every word is known, too.
    known = [r for r in out if r["n_known"] == r["n_tokens"]]
    assert len(known) > 100 and sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 10**7]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
