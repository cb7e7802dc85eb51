"""The registered queries of the operators, and check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm import (
    bpe, chat, line_quality, lm_scores, mixing, multi_index, ngram_join, quality_rules, resampling, secrets, sharding,
    token_counts, whitening,
)
from transitlake.llm.common import stored, table, word_count

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its check SQL."""

    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def vocabulary_path(name: str) -> str:
    """Where the published vocabularies lie on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op10_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary_path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op5_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    measured = stored(quality_rules.measure(docs, keep_text=False))
    cutoffs = quality_rules.fit(measured, table(spark, folder, "labels"))
    judged = quality_rules.judge(measured, cutoffs)
    return judged.select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept", "lang")


@query()
def op7_slots(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.place(stored(rows), ["doc_id", "text_crc32", "size"], "size", 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@query()
def op9_mix(spark, folder):
    docs = table(spark, folder, "documents")
    rows = stored(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("content")))
    mixed = mixing.mix(rows, ["doc_id", "content"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op2_secrets(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scanned = secrets.scan(docs)
    base = F.filter("spans", lambda s: s["order"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query(
    r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (SELECT *, list_sum(list_transform([role, text], lambda t: length(t) + length(t) - length(replace(t, '\', ''))
  + length(t) - length(replace(t, '#', '')) - len(regexp_extract_all(t, '#+')) + len(regexp_extract_all(t, '</')))) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  sum(escaped + length('### ') + length('</role>') + length('</turn>') + 2)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""
)
def op3_chat(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    trees = stored(chat.as_trees(given.unionByName(added), "conv_id", "turn", "role", "text"))
    made = stored(chat.format_trees(trees, "conv_id", "node", "parent", "score"))
    read = made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "learned", chat.under_mask(F.col("formatted"), F.col("mask"))
    )
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op6_multi_index(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return multi_index.search(vectors, F.col("vec_id") % 20 == 0)


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\t-\r ]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
)
def op1_ngram_join(spark, folder):
    return ngram_join.join_components(table(spark, folder, "documents"), n=4, percent=85)


@query(
    """WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+') AS ws FROM documents)),
n AS (SELECT count(*) AS total FROM w), size AS (SELECT doc_id, count(*) AS k FROM w GROUP BY 1),
p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS b, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM w),
one AS (SELECT w, count(*) AS c FROM w GROUP BY 1), mine AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY ALL),
two AS (SELECT b, w, count(*) AS c FROM p WHERE b IS NOT NULL GROUP BY ALL),
mine2 AS (SELECT doc_id, b, w, count(*) AS c FROM p WHERE b IS NOT NULL GROUP BY ALL),
three AS (SELECT a, b, w, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY ALL),
mine3 AS (SELECT doc_id, a, b, w, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY ALL),
scored AS (SELECT p.doc_id, CASE
  WHEN p.a IS NOT NULL AND three.c - mine3.c > 0 THEN ln(three.c - mine3.c) - ln(pair.c - ownpair.c)
  WHEN p.b IS NOT NULL AND two.c - mine2.c > 0 THEN ln(two.c - mine2.c) - ln(before.c - own.c) + CASE WHEN p.a IS NULL THEN 0 ELSE ln(0.4) END
  ELSE ln(greatest(one.c - mine.c, 1)) - ln(greatest(total - k, 1)) + CASE WHEN p.a IS NOT NULL THEN 2 * ln(0.4) WHEN p.b IS NOT NULL THEN ln(0.4) ELSE 0 END END AS s
  FROM p JOIN n ON true JOIN size USING (doc_id) JOIN one ON one.w = p.w JOIN mine ON mine.doc_id = p.doc_id AND mine.w = p.w
  LEFT JOIN two ON two.b = p.b AND two.w = p.w LEFT JOIN mine2 ON mine2.doc_id = p.doc_id AND mine2.b = p.b AND mine2.w = p.w
  LEFT JOIN three ON three.a = p.a AND three.b = p.b AND three.w = p.w
  LEFT JOIN mine3 ON mine3.doc_id = p.doc_id AND mine3.a = p.a AND mine3.b = p.b AND mine3.w = p.w
  LEFT JOIN one before ON before.w = p.b LEFT JOIN mine own ON own.doc_id = p.doc_id AND own.w = p.b
  LEFT JOIN two pair ON pair.b = p.a AND pair.w = p.b LEFT JOIN mine2 ownpair ON ownpair.doc_id = p.doc_id AND ownpair.b = p.a AND ownpair.w = p.b)
SELECT d.doc_id, coalesce(k, 0) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / k, 6) AS mean_log_score
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY 1) USING (doc_id)"""
)
def op4_lm_scores(spark, folder):
    scored = lm_scores.score(table(spark, folder, "documents").select("doc_id", "text"))
    return scored.select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score")
    )


@query()
def op8_token_counts(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return token_counts.count(docs, vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    r"""WITH steps AS (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(b)), t AS (SELECT list(v ORDER BY b) AS t FROM steps),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
named AS (SELECT w, hex(w) AS h, strlen(w) AS n FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM named, t),
s AS (SELECT k, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY 1), tt AS (SELECT k, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS cs, (SELECT count(*) FROM bw)::DOUBLE AS ct),
gain AS (SELECT k, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (cs + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * (ct + 10000))))::BIGINT AS g
  FROM (SELECT range AS k FROM range(10000)) LEFT JOIN s USING (k) LEFT JOIN tt USING (k), totals),
own AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (k) GROUP BY 1),
scored AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN own USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
)
def op11_resampling(spark, folder):
    docs, target = (table(spark, folder, name) for name in ("documents", "benchmark"))
    return resampling.resample(docs.select("doc_id", "text"), target).drop("n_words")


@query()
def op12_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query()
def op13_line_quality(spark, folder):
    return line_quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
