"""The registered query of each operator, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    class_lm,
    collocations,
    conversations,
    embed_dedup,
    exact_dedup,
    mixing,
    packing,
    quality,
    simhash,
    substring,
    topk,
    toxicity,
    url_rules,
)
from fleetlens.llm.common import crc_mod, read

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

#: (host, path, verdict) of the url query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query(
    "op1_kd_topk",
    """
WITH ok AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
)
def op1_kd_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    parts = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256))
    whole = vectors.filter(topk.finite(F.col("embedding"))).select("vec_id", parts.alias("v"))
    return topk.top_k(whole, F.col("vec_id") % 50 == 0)


@query(
    "op2_url_rules",
    r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (
    SELECT row_number() OVER () AS n, page_id, url,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
    FROM pages),
parts AS (
    SELECT n, page_id, url,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut),
fits AS (
    SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY n)
SELECT page_id, url, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
""",
)
def op2_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), rules)


@query("op3_fourier_quality")
def op3_fourier_quality(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels, crc_mod(F.col("doc_id"), 4) == 2)


@query("op4_best_two_fit")
def op4_best_two_fit(spark, sf_dir):
    pieces = packing.encode_pieces(
        read(spark, sf_dir, "documents"), tokenizer_path(), value=packing.crc32_of_ids, value_type="long"
    )
    return packing.pack(pieces).withColumnRenamed("value", "ids_crc32")


@query(
    "op5_recompression",
    r"""
WITH cut AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT r, doc_id, i, list_slice(w, i, i + 49) AS words
    FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM cut WHERE doc_id IS NOT NULL)),
named AS (SELECT r, doc_id, i, md5(array_to_string(words, ' ')) AS h FROM windows),
lost AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM named) WHERE low < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM lost),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM cut),
kept AS (
    SELECT words.r, count(gone.k) AS n_removed, coalesce(string_agg(CASE WHEN gone.k IS NULL THEN word END, ' ' ORDER BY words.k), '') AS text
    FROM words LEFT JOIN gone USING (r, k) GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (r)
""",
)
def op5_recompression(spark, sf_dir):
    done = substring.deduplicate_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_toxic_lexicon")
def op6_toxic_lexicon(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels, crc_mod(F.col("doc_id"), 3) == 1)


@query(
    "op7_poisson_mix",
    f"""
WITH RECURSIVE sizes AS (
    SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM documents GROUP BY source),
rates AS (
    SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT source, greatest(ceil(rate / 32.0), 1)::INT AS m, rate / greatest(ceil(rate / 32.0), 1) AS mean FROM rates),
cdf(source, m, mean, k, p, upto) AS (
    SELECT source, m, mean, 0, exp(-mean), exp(-mean) FROM parts
    UNION ALL
    SELECT source, m, mean, k + 1, p * mean / (k + 1), upto + p * mean / (k + 1) FROM cdf
    WHERE k < ceil(mean + 12 * sqrt(mean) + 20)),
docs AS (
    SELECT row_number() OVER () AS r, d.*, unnest(range(1, p.m + 1)) AS j
    FROM documents d JOIN parts p USING (source)),
draws AS (
    SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || j), 1, 12))::BIGINT / 281474976710656.0 AS u FROM docs),
counted AS (
    SELECT r, sum((SELECT count(*) FROM cdf c WHERE c.source = draws.source AND c.upto <= draws.u)) AS copies
    FROM draws GROUP BY r),
once AS (SELECT * FROM docs WHERE j = 1)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, copies::BIGINT))::INT AS mix_copy
FROM once JOIN counted USING (r)
""",
)
def op7_poisson_mix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    weights = docs.select("source").distinct().withColumn("weight", F.when(F.col("source") == "src0", 1.0).otherwise(2.0))
    return mixing.mix_sources(docs, weights)


@query(
    "op8_embedding_dedup",
    """
WITH RECURSIVE marked AS (
    SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v,
        vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
    FROM embeddings),
links AS (
    SELECT a.r AS x, b.r AS y, b.vec_id FROM marked a JOIN marked b
    ON a.ok AND b.ok AND a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
    AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach(x, y, vec_id) AS (
    SELECT x, y, vec_id FROM links UNION SELECT reach.x, links.y, links.vec_id FROM reach JOIN links ON reach.y = links.x),
least_id AS (SELECT x, min(vec_id) AS low FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
    vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(low, vec_id)) AS kept
FROM marked LEFT JOIN counts ON marked.r = counts.x LEFT JOIN least_id ON marked.r = least_id.x
""",
)
def op8_embedding_dedup(spark, sf_dir):
    return embed_dedup.embedding_groups(read(spark, sf_dir, "embeddings"))


@query("op9_brown_classes")
def op9_brown_classes(spark, sf_dir):
    return class_lm.score_texts(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op13_exact_dedup",
    r"""
WITH plain AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, r) AS keep_id,
    count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, r) = 1 AS kept, sha256(t) AS text_sha256
FROM plain
""",
)
def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


@query(
    "op11_conversation_repair",
    r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
        lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
faulty AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_concat([4294967295], list_transform(
            string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
    FROM conversations, crc_table),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN fault = 0 THEN 0 WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM faulty),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 24), left(text, 24),
            sha256(strlen(role) || ':' || role || text), copy) AS i,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain
    FROM damaged),
marked AS (
    SELECT *, instr('sua', left(role, 1)) * (role <> '')::INT AS init,
        CASE WHEN plain = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
            WHEN right(plain, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM ordered),
inserts(p, q, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
keeps(init, q, e) AS (VALUES (1, 0, 1), (2, 0, 2), (2, 1, 2), (2, 3, 2), (3, 2, 3)),
options AS (
    SELECT init, fault, q, q AS e, 2 AS c, 'D' AS s FROM range(4) a(init), range(4) b(fault), range(4) d(q)
    UNION ALL SELECT init, fault, q, CASE WHEN q = 2 THEN 3 ELSE 2 END, 1 + 5 * fault, 'R' FROM range(4) a(init), range(2) b(fault), range(4) d(q)
    UNION ALL SELECT init, fault, q, e, 5 * fault, 'K' FROM keeps, range(2) b(fault)),
moves AS (
    SELECT init, fault, list({'p': p, 'e': e, 'c': c + 5 * k, 's': repeat('I', k::BIGINT) || s}) AS ways
    FROM options JOIN inserts USING (q) GROUP BY init, fault),
best(conv_id, i, state) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, [{'c': 0::BIGINT, 'a': ''}, NULL, NULL, NULL] FROM conversations
    UNION ALL
    SELECT b.conv_id, r.i, list_transform([0, 1, 2, 3], lambda e: list_min(list_transform(
        list_filter(ways, lambda w: w.e = e AND b.state[w.p + 1] IS NOT NULL),
        lambda w: {'c': (b.state[w.p + 1].c + w.c)::BIGINT, 'a': b.state[w.p + 1].a || w.s})))
    FROM best b JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN moves USING (init, fault)),
finished AS (
    SELECT conv_id, list_min(list_filter([state[1], CASE WHEN state[2] IS NOT NULL THEN {'c': state[2].c + 10, 'a': state[2].a || 'II'} END,
        CASE WHEN state[3] IS NOT NULL THEN {'c': state[3].c + 5, 'a': state[3].a || 'I'} END, state[4]], lambda x: x IS NOT NULL)) AS won
    FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
edits AS (
    SELECT conv_id, n, substr(won.a, n, 1) AS edit, n - strlen(replace(substr(won.a, 1, n), 'I', '')) AS inserted
    FROM (SELECT conv_id, won, unnest(range(1, strlen(won.a) + 1)) AS n FROM finished)),
turns AS (
    SELECT e.conv_id, n, edit, role, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY n) AS m,
        max((n = 1 OR edit <> 'D') AND edit = 'K' AND init = 1) OVER (PARTITION BY e.conv_id) AS has_system
    FROM edits e LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND edit <> 'I' AND r.i = n - inserted
    WHERE edit <> 'D'),
repaired AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (m + has_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY n)) AS digest
    FROM turns GROUP BY conv_id),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
        count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, won.c AS cost, won.a AS audit,
    coalesce(digest, sha256('')) AS repaired_sha256
FROM finished f LEFT JOIN repaired r ON f.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN counted c ON f.conv_id IS NOT DISTINCT FROM c.conv_id
""",
)
def op11_conversation_repair(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return conversations.repaired_digests(rows, conversations.with_faults(rows))


@query(
    "op12_phrase_streams",
    r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM split, range(1, 6) sizes(k)),
counts AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100),
cuts AS (
    SELECT lang, phrase, f, c, array_to_string(w[:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest
    FROM candidates, range(1, 5) cut(c) WHERE c < k),
scored AS (
    SELECT t.lang, t.phrase, t.f AS a, l.f AS l, r.f AS r, n::BIGINT AS n, c, (1000::HUGEINT * t.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM cuts t JOIN counts l ON l.lang = t.lang AND l.phrase = t.first JOIN counts r ON r.lang = t.lang AND r.phrase = t.rest
        JOIN totals ON totals.lang = t.lang
    QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, c) = 1),
inside AS (
    SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, f
    FROM candidates, range(2, 5) sizes(m), range(1, 5) starts(s) WHERE m < k AND s + m - 1 <= k),
left_out AS (SELECT x.lang, x.phrase FROM scored x JOIN inside y ON x.lang = y.lang AND x.phrase = y.phrase AND 100 * y.f >= 100 * x.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM scored ANTI JOIN left_out USING (lang, phrase)) WHERE rank <= 2000
""",
)
def op12_phrase_streams(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))
