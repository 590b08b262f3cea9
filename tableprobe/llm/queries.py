"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.llm import chunk_bpe, embedding_dedup, language_id, lexical_packing, masked_lm, member_lloyd, packing, phrase_graph, quality_rules, ring_sharding, sketch_dedup, token_scan, zip_warc
from tableprobe.llm.common import durable, run_dir, table

#: Files of public tokenizers come with this module; their places are parameters of the operators.
WORD_BPE, BYTE_BPE, BYTE_RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links_and_components(table(spark, sf_dir, "embeddings"), embedding_dedup.Settings(threshold=0.9))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), WORD_BPE, max_tokens=4096, end_id=1, with_ids=False)
    return packing.pack(cut, packing.Capacity(tokens=4096))


def op3_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = chunk_bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_RANKS, public_tokenizers.PATTERN, decoded=True)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.POLICIES["v1"].mask()
    kept = quality_rules.apply_policy(book, quality_rules.POLICIES["v2"])
    return kept.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"), "kept", "failure_bits",
    )


OP4_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\\p{Lu}', '', 'g')) AS n_caps,
         length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 3 AND 20 * n_dup_lines > n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_caps > 30 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_bangs > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failure_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits
FROM b
"""


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the second policy rejects, alone and with others."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["v2"])


_RULE_BITS = ", ".join(f"('{r.name}', {1 << k}::BIGINT)" for k, r in enumerate(quality_rules.RULES))
ABLATION_SQL = f"""{OP4_SQL[: OP4_SQL.rindex("SELECT doc_id, n_words")]}
SELECT rule, bit, count(*) AS n_docs, count(*) FILTER (failure_bits & bit <> 0) AS n_failed, count(*) FILTER (failure_bits = bit) AS n_only,
       bit_or(failure_bits) AS bits_ever, bit_and(failure_bits) AS bits_always
FROM b, (VALUES {_RULE_BITS}) r(rule, bit) GROUP BY rule, bit
"""


def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "warc")
    packages = zip_warc.write_packages(zip_warc.roles(table(spark, sf_dir, "pages"), min_bytes=0), folder)
    records = zip_warc.read_records(zip_warc.locate(packages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = durable(masked_lm.word_counts(docs))
    vocab = masked_lm.vocabulary(docs, masked_lm.Settings(), counts=counts)
    return masked_lm.score(docs, masked_lm.train(docs, vocab), vocab, spelled=masked_lm.spelling(counts, vocab))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, end = run_dir(spark, "tokens"), 49407
    written = token_scan.write_token_files(table(spark, sf_dir, "documents"), folder, WORD_BPE, end)
    counts = token_scan.scan(token_scan.token_files(spark, folder), folder, end)
    return written.join(counts, ["file", "ordinal"], "full").select("doc_id", "n_tokens", "file", "ordinal", "start", "terminated")


def op9_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_sharding.assign(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def op10_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.components(table(spark, sf_dir, "documents"), sketch_dedup.Settings(words=3, percent=85))


def op11_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing.lexical_packing(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_RANKS, public_tokenizers.PATTERN, lexical_packing.Settings(window=1024, end_id=0))


def op12_member_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_lloyd.compress(table(spark, sf_dir, "embeddings"), member_lloyd.Settings(parts=8, entries=16, rounds=6, scale=4096))


def _op12_sql(rounds: int = 6) -> str:
    """Parts by position; then, for each round, nearest entries and means rounded down; then codes and errors."""
    near = lambda book: f"""SELECT p.rid, p.pos, p.x, arg_min(c.entry, c.d * 16 + c.entry) AS entry, min(c.d) AS d FROM parts p JOIN LATERAL (
  SELECT b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM {book} b WHERE b.pos = p.pos) c ON true GROUP BY ALL"""  # noqa: E731
    steps = []
    for k in range(rounds):
        steps += [
            f"a{k} AS MATERIALIZED ({near(f'b{k}')})",
            f"m{k} AS (SELECT pos, entry, list(v ORDER BY i) AS x FROM (SELECT pos, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM a{k}, (SELECT unnest(range(1, 9)) AS i) GROUP BY ALL) GROUP BY ALL)",
            f"b{k + 1} AS MATERIALIZED (SELECT b{k}.pos, b{k}.entry, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} ON b{k}.pos = m{k}.pos AND b{k}.entry = m{k}.entry)",
        ]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, pos, v[pos * len(v) // 8 + 1 : (pos + 1) * len(v) // 8] AS x FROM kept, (SELECT unnest(range(8)) AS pos)),
b0 AS MATERIALIZED (SELECT pos, rid - 1 AS entry, x FROM parts WHERE rid <= 16),
{", ".join(steps)},
f AS MATERIALIZED ({near(f"b{rounds}")}),
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM f GROUP BY rid),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept ON coded.rid = kept.rid, sha
"""


def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.phrases(table(spark, sf_dir, "documents"), phrase_graph.Settings(most=4, least=30, percent=80, top=2000)).drop("path_words")


def _op13_sql() -> str:
    """All phrases of 1 to 4 words counted one by one."""
    gram = lambda k: "||' '||".join(f"ws[i+{j}]" for j in range(k))
    counted = " UNION ALL ".join(f"SELECT lang, {k} AS w, x AS phrase, count(*) AS f FROM (SELECT lang, {gram(k)} AS x FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM p)) GROUP BY ALL" for k in range(1, 5))
    cuts = " UNION ALL ".join(
        f"SELECT lang, phrase, f, {k} AS k, array_to_string(ws[:{k}], ' ') AS x, array_to_string(ws[{k + 1}:], ' ') AS y FROM c WHERE w > {k}" for k in range(1, 4)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, f, array_to_string(ws[{i}:{i + n - 1}], ' ') AS phrase FROM c WHERE w > {n} AND w >= {i + n - 1}" for n in (2, 3) for i in range(1, 4)
    )
    return f"""
WITH p AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS MATERIALIZED (SELECT * FROM ({counted}) WHERE f >= 30),
c AS MATERIALIZED (SELECT lang, w, phrase, f, string_split(phrase, ' ') AS ws FROM g WHERE w > 1),
held AS (SELECT lang, phrase, max(f) AS most FROM ({inner}) GROUP BY ALL),
cut AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * cuts.f // (l.f + r.f) AS score
  FROM ({cuts}) cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = cuts.x JOIN g r ON r.lang = cuts.lang AND r.phrase = cuts.y),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
n AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase WHERE most IS NULL OR 100 * most < 80 * a)
SELECT ranked.lang, rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_best_fit_packing, op3_chunk_bpe, op4_quality_rules, op5_zip_warc, op6_language_id, op7_masked_lm, op8_separator_scan, op9_ring_sharding, op10_bottom_k_dedup, op11_lexical_packing, op12_member_lloyd, op13_phrase_graph, quality_rule_ablation)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "quality_rule_ablation": ABLATION_SQL, "op12_member_lloyd": _op12_sql(), "op13_phrase_graph": _op13_sql()}
