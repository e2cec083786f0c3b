"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, pii, toxicity
from .common import table
from .conversation_repair import conversation_repair, damage
from .line_dedup import line_dedup
from .lm_score import lm_score
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard
from .quality_rules import quality_rules
from .token_counts import token_counts
from .topk import top_k
from .url_filter import host_of, url_filter
from .vector_codes import vector_codes

VOCABULARY, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the documents' sources."""
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op5_pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the hosts of pages' urls, lines what stands between their tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    kept = line_dedup(pages, "host")
    return kept.select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.toxicity(docs, machine)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair(rows, damage(rows))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op5_pages_by_host": op5_pages_by_host,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_top_k": op9_top_k,
    "op10_lm_score": op10_lm_score,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_counts": op13_token_counts,
}


def _code_rounds(rounds: int) -> str:
    """The rounds of op12, one after the other: a{k} has each part's nearest entry, b{k} the codebooks."""
    out = ""
    for k in range(rounds + 1):
        out += f"""
        a{k} AS MATERIALIZED (
            SELECT r, p, e, s FROM (SELECT r, p, e, sum((d.x - b.x) * (d.x - b.x))::BIGINT AS s FROM d JOIN b{k} b USING (p, c) GROUP BY r, p, e)
            QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY s, e) = 1
        ),"""
        if k < rounds:
            out += f"""
        b{k + 1} AS MATERIALIZED (
            SELECT b.p, b.e, b.c, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
                SELECT p, e, c, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM d JOIN a{k} USING (r, p) GROUP BY p, e, c
            ) m USING (p, e, c)
        ),"""
    return out



ORACLES = {
    "op1_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), g AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS g FROM w
        ), s AS (
            SELECT min(doc_id) AS doc_id, len(any_value(g)) AS n, list_sort(g) AS g FROM g WHERE len(g) > 0 GROUP BY list_sort(g)
        ), t AS (
            SELECT doc_id, n, unnest(g) AS t FROM s
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id
            AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), e AS (
            SELECT a, b FROM p UNION ALL SELECT b, a FROM p
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        ), c AS (
            SELECT a, min(b) AS c FROM r GROUP BY a
        )
        SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, CASE WHEN len(g.g) = 0 THEN g.doc_id ELSE c.c END AS component_id
        FROM g LEFT JOIN s ON list_sort(g.g) = s.g LEFT JOIN c ON c.a = s.doc_id
    """,
    "op4_mixing": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS pos FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
        ), o AS (
            SELECT *, 3.0::DOUBLE * source_size AS cap,
                (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))::DOUBLE / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS place
            FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), f AS (
            SELECT min(place) AS place, arg_min(level, place) AS level FROM o WHERE level * weight <= cap
        ), t AS (
            SELECT o.source, o.source_size, CASE WHEN o.place < f.place THEN o.cap ELSE least(f.level * o.weight, o.cap) END AS target FROM o, f
        ), p AS (
            SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY pos, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
            (size * (whole + CASE WHEN size > 0 AND before + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM p
    """,
    "op5_line_dedup": """
        WITH l AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
        ), c AS (
            SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line
        ), t AS (
            SELECT source, count(*) AS pages FROM documents GROUP BY source
        ), b AS (
            SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n > 0.06 * pages
        ), k AS (
            SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.line IS NULL), '') AS text
            FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.doc_id
        )
        SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, length(k.text)::BIGINT AS n_chars_kept, sha256(k.text) AS text_sha256
        FROM documents d LEFT JOIN k USING (doc_id)
    """,
    "op5_pages_by_host": r"""
        WITH p AS (
            SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages
        ), l AS (
            SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p WHERE text IS NOT NULL
        ), b AS (
            SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY host, line) JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) USING (host) WHERE n >= 5 AND n > 0.06 * pages
        ), k AS (
            SELECT l.r, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.line IS NULL), '') AS text FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY l.r
        )
        SELECT page_id, host, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, length(k.text)::BIGINT AS n_chars_kept, sha256(k.text) AS text_sha256 FROM p LEFT JOIN k USING (r)
    """,
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc AS MATERIALIZED (
            SELECT list(c ORDER BY i) AS tab FROM (
                SELECT i, list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i)
            )
        ), k AS MATERIALIZED (
            SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)
        ), o AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
                [4294967295]::BIGINT[] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]))) % 20 AS hit
            FROM conversations, crc
        ), h AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy,
                CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM o WHERE hit <> 0
        ), n AS (
            SELECT k, turn, role, text, left(role, 1) AS c, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t
            FROM h JOIN k ON h.conv_id IS NOT DISTINCT FROM k.conv_id
        ), r AS MATERIALIZED (
            SELECT *, blank OR duplicate AS goes, CASE WHEN late THEN 3 ELSE 0 END AS z FROM (
                SELECT *, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS duplicate,
                    t <> '' AND row_number() OVER (PARTITION BY k, role, text ORDER BY i) = 1 AND right(t, 1) NOT IN ('.', '!', '?') AS late,
                    i > 1 AND coalesce(lag(c) OVER (PARTITION BY k ORDER BY i), '') || c NOT IN ('su', 'ua', 'au') AS illegal
                FROM n
            )
        ), b AS (
            SELECT k, max(i) + 1 AS i, 0 AS e, 6 AS s, 3 AS u, 0 AS a FROM r GROUP BY k
            UNION ALL
            SELECT k, i, least(re, 3 + ru, 6 + ra), least(rs, 3 + ru, 6 + ra), least(ru, 3 + ra), least(ra, 3 + ru) FROM (
                SELECT r.k, r.i, b.i AS j,
                    least(4 + e, CASE WHEN goes THEN 4 + e WHEN c = 's' THEN least(z + s, 3 + z + u) WHEN c = 'u' THEN z + u ELSE 3 + z + u END) AS re,
                    least(4 + s, CASE WHEN goes THEN 4 + s WHEN c = 'u' THEN z + u ELSE 3 + z + u END) AS rs,
                    least(4 + u, CASE WHEN goes THEN 4 + u WHEN c = 'a' THEN z + a ELSE 3 + z + a END) AS ru,
                    least(4 + a, CASE WHEN goes THEN 4 + a WHEN c = 'u' THEN z + u ELSE 3 + z + u END) AS ra
                FROM b JOIN r ON r.k = b.k AND r.i = b.i - 1
            )
        ), w AS MATERIALIZED (
            -- costs before (b) and after (n) each row, and the row; the last has no row
            SELECT b.k, b.i, [b.e, b.s, b.u, b.a] AS b, [n.e, n.s, n.u, n.a] AS n, r.goes, r.z, r.c, r.role, r.text FROM b LEFT JOIN b n ON n.k = b.k AND n.i = b.i + 1 LEFT JOIN r ON r.k = b.k AND r.i = b.i
        ), t AS (
            SELECT k, 1::BIGINT AS i, 1 AS state, '' AS audit, []::VARCHAR[] AS lines FROM k
            UNION ALL
            SELECT k, CASE WHEN x = 'I' THEN i ELSE i + 1 END, CASE x WHEN 'D' THEN state WHEN 'K' THEN keeps ELSE next END, audit || x,
                CASE x WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, name || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, name || ':' || text) END
            FROM (
                SELECT *, CASE WHEN 4 + n[state] = b[state] THEN 'D' WHEN 3 + b[next] = b[state] THEN 'I' WHEN n[state] IS NULL THEN NULL
                    WHEN keeps > 0 AND z + n[keeps] = b[state] THEN 'K' ELSE 'R' END AS x
                FROM (
                    SELECT t.*, w.b, w.n, w.z, w.role, w.text, CASE WHEN state = 3 THEN 4 ELSE 3 END AS next, CASE WHEN state = 3 THEN 'assistant' ELSE 'user' END AS name,
                        CASE WHEN c = 's' AND state = 1 THEN 2 WHEN c = 'u' AND state <> 3 THEN 3 WHEN c = 'a' AND state = 3 THEN 4 ELSE 0 END AS keeps
                    FROM t JOIN w ON w.k = t.k AND w.i = t.i
                )
            ) WHERE x IS NOT NULL
        ), done AS (
            SELECT k, arg_max(audit, len(audit)) AS audit, sha256(array_to_string(arg_max(lines, len(audit)), chr(10))) AS repaired_sha256 FROM t GROUP BY k
        ), f AS (
            SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                count(*) FILTER (late) AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY k
        )
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.b[1], 0)::BIGINT AS cost, audit, repaired_sha256
        FROM k LEFT JOIN f USING (k) LEFT JOIN done USING (k) LEFT JOIN w ON w.k = k.k AND w.i = 1
    """,
    "op12_vector_codes": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), d AS MATERIALIZED (
            SELECT r, i // (len // 8) AS p, i % (len // 8) AS c, x FROM (SELECT r, len(v) AS len, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM v)
        ), b0 AS MATERIALIZED (
            SELECT p, r - 1 AS e, c, x FROM d WHERE r <= 16
        ),{_code_rounds(6)} t AS (
            SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(s)::BIGINT AS error FROM a6 JOIN v USING (r) GROUP BY r, vec_id, label
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, c)) FROM b6) AS codebooks_sha256
        FROM t
    """,
}
