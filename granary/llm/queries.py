"""One query an operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bloom_lm, language_id, toxicity
from granary.llm.bayes_jaccard import jaccard_classes
from granary.llm.common import documents, fold, table
from granary.llm.decontaminate import benchmark, contamination
from granary.llm.exact_dedup import exact_dedup
from granary.llm.exponion import exponion_clusters, integer_vectors, with_inertia
from granary.llm.merge_codec import encode_documents
from granary.llm.packing import pack
from granary.llm.secret_scan import labelled_samples, secret_scan, train
from granary.llm.sharding import rendezvous_shards
from granary.llm.token_counts import token_counts
from granary.llm.turn_repair import damaged, digests, repair


def piece_model() -> bytes:
    """The public vocabulary's file, of about half a megabyte, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def word_tokenizer() -> str:
    """The public tokenizer's file, of about two megabytes, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan(docs, train(labelled_samples(spark, docs)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = toxicity.bounded_labels(table(spark, sf_dir, "labels"), fold(modulus=5) == 0)
    model = toxicity.train(docs.join(F.broadcast(labels), "doc_id").select("text", "toxic"))
    scored = toxicity.score(docs.select("doc_id", (fold(modulus=5) == 0).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), benchmark(table(spark, sf_dir, "benchmark")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), piece_model())


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(modulus=5) == 1
    model, counts = bloom_lm.train(docs.filter(~held_out))
    return bloom_lm.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, counts)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op7_merge_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), piece_model())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(modulus=4) == 2
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_shingles")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous_shards(documents(spark, sf_dir), [1.0] * 16)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), word_tokenizer())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(table(spark, sf_dir, "conversations"))))


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*exponion_clusters(integer_vectors(table(spark, sf_dir, "embeddings")), k=16, rounds=3, seed="1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_bloom_lm": op5_bloom_lm,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_merge_codec": op7_merge_codec,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sharding": op10_sharding,
    "op11_packing": op11_packing,
    "op12_turn_repair": op12_turn_repair,
    "op13_exponion": op13_exponion,
}


def _sharding_sql(shards: int = 16) -> str:
    """crc32 by the bytes' fold over its table, which is built from the polynomial; a shard is the place of its least score."""
    score = lambda i: f"-ln((('0x' || substr(md5(name || ':{i}'), 1, 15))::BIGINT::DOUBLE + 0.5::DOUBLE) / {1 << 60}::DOUBLE)"
    return rf"""
        WITH RECURSIVE steps(n, k, c) AS (
          SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
          UNION ALL SELECT n, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
        d AS (
          SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS name, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
                 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
          FROM documents),
        c AS (
          SELECT doc_id, name, size, CASE WHEN len(bytes) = 0 THEN 0 ELSE
                 xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), {0xFFFFFFFF}::BIGINT), {0xFFFFFFFF}) END AS text_crc32
          FROM d, crc),
        s AS (
          SELECT doc_id, size, text_crc32, [{', '.join(map(score, range(shards + 1)))}] AS s,
                 ('0x' || substr(md5(concat_ws('#', name, text_crc32, size)), 1, 15))::BIGINT AS place
          FROM c),
        p AS (
          SELECT doc_id, size, text_crc32, place, list_position(s[1:{shards}], list_min(s[1:{shards}]))::INT - 1 AS shard,
                 list_position(s, list_min(s))::INT - 1 AS grown_shard
          FROM s)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard
        FROM p"""


def _turn_repair_sql() -> str:
    """The program from the first row to the last: each state's least (cost, audit), with the repaired text of that audit."""
    none = "{'c': 1099511627776, 'a': '', 'x': ''}"
    state = {"": "s0", "s": "s1", "u": "s2", "a": "s3"}

    def step(of: str, cost: str, letters: str, text: str = "''") -> str:
        return f"{{'c': {of}.c + {cost}, 'a': {of}.a || {letters}, 'x': {of}.x || {text}}}"

    def stays(role: str, to: str) -> str:
        kept = f"CASE WHEN initial = '{role}' THEN 'K' ELSE 'R' END"
        name = f"CASE WHEN initial = '{role}' THEN role ELSE '{to}' END"
        cost = f"short + CASE WHEN initial = '{role}' THEN 0 ELSE 1 END"
        follows = {"u": ("s0", "s1", "s3"), "a": ("s2",)}[role]
        ways = []
        for s in state.values():
            put = "" if s in follows else f"chr(10) || '{'assistant' if role == 'u' else 'user'}:' || "
            ways.append(step(s, f"{cost} + {0 if s in follows else 5}", f"'{'' if s in follows else 'I'}' || {kept}", f"{put}chr(10) || {name} || ':' || text"))
        own = step(state[role], "2", "'D'")
        return f"CASE WHEN forced THEN {own} ELSE list_min([{own}, {', '.join(ways)}]) END"

    system = step("s0", "short", "'K'", "chr(10) || role || ':' || text")
    return rf"""
        WITH RECURSIVE steps(n, k, c) AS (
          SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
          UNION ALL SELECT n, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
        b AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda y: ('0x' || y)::BIGINT) AS bytes
          FROM conversations),
        d AS (
          SELECT conv_id, turn, role, text,
                 xor(list_reduce(bytes, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), {0xFFFFFFFF}::BIGINT), {0xFFFFFFFF}) % 20 AS kind
          FROM b, crc),
        x AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
          FROM d WHERE kind <> 0),
        m AS (
          SELECT conv_id, turn, role, text, left(role, 1) AS initial,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                 NOT regexp_matches(text, '[^ 	-
]') AS blank,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
          FROM x),
        r AS (
          SELECT conv_id, turn, i, role, text, initial, blank, NOT blank AND again AS duplicate, blank OR again AS forced,
                 NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS truncated,
                 lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
          FROM m),
        w AS (SELECT conv_id, i, role, text, initial, forced, CASE WHEN truncated THEN 5 ELSE 0 END AS short FROM r),
        p AS (
          SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'x': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM conversations
          UNION ALL
          SELECT p.conv_id, w.i, {step('s0', '2', "'D'")},
                 CASE WHEN forced OR initial <> 's' THEN {step('s1', '2', "'D'")} ELSE list_min([{step('s1', '2', "'D'")}, {system}]) END,
                 {stays('u', 'user')}, {stays('a', 'assistant')}
          FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = p.i + 1),
        e AS (
          SELECT conv_id, list_min([s0, s3, {step('s2', '5', "'I'", "chr(10) || 'assistant:'")},
                                    {step('s1', '10', "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")}]) AS best
          FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        n AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                 count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM r GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
               sha256(substr(best.x, 2)) AS repaired_sha256
        FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Every round over all vectors and centroids."""
    far = "list_sum(list_transform(list_zip(v.vector, c.vector), lambda z: (z[1]::BIGINT - z[2]) * (z[1]::BIGINT - z[2])))::BIGINT"
    parts = [
        rf"""v AS (
          SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(greatest(-{1 << 24}::DOUBLE, least({1 << 24}::DOUBLE, x::DOUBLE * 64)))::INT) AS vector
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        rf"""c0 AS (
          SELECT row_number() OVER (ORDER BY digest, vector) - 1 AS cluster, vector
          FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, 'null')) AS digest, vector FROM v) ORDER BY digest, vector LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(rf"a{i} AS (SELECT id, min({{'d': {far}, 'k': c.cluster}}) AS best FROM v, c{i} AS c GROUP BY id)")
        if i < rounds:
            parts.append(rf"""s{i} AS (
          SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS vector
          FROM (SELECT best.k AS cluster, pos, sum(x)::BIGINT AS s, count(*) AS n
                FROM (SELECT best, unnest(vector) AS x, unnest(range(64)) AS pos FROM v JOIN a{i} USING (id)) GROUP BY ALL) GROUP BY cluster)""")
            parts.append(rf"c{i + 1} AS (SELECT cluster, coalesce(s.vector, c.vector::BIGINT[]) AS vector FROM c{i} AS c LEFT JOIN s{i} AS s USING (cluster))")
    return rf"""
        WITH {', '.join(parts)}
        SELECT vec_id, best.k::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c.vector, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (id) JOIN c{rounds} AS c ON c.cluster = best.k"""


SQL: dict[str, str] = {
    "op12_turn_repair": _turn_repair_sql(),
    "op13_exponion": _clusters_sql(),
    "op10_sharding": _sharding_sql(),
    "op6_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        g AS (
          SELECT doc_id, text_sha256,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
