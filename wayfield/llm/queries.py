"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .license_scan import PHRASES, TEMPLATES, THRESHOLD, scan
from .lm_scoring import lm_scores
from .merkle import manifest
from .near_dup import near_dup
from .packing import pack_documents
from .substring_dedup import drop_repeats
from .token_counts import count_tokens
from .top_k import top_k
from .toxicity import toxicity
from .warc import warc_round_trip


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), window=20)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("stored_bytes")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("blocks", lambda b: F.format_string("%d@%d-%d", b["template"], b["first"], b["last"]))
    return scan(table(spark, sf_dir, "documents")).withColumn("blocks", F.array_join(said, ","))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(table(spark, sf_dir, "documents"), n=5, threshold=0.8).drop("text_hash")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20, scale=64)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered=F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_substring_dedup, op3_lm_scores, op4_warc, op5_license_scan, op6_near_dup, op7_packing,
        op8_decontamination, op9_exact_dedup, op10_toxicity, op11_top_k, op12_hard_negatives, op13_merkle,
    )
}

def _whole_sql(scale: int) -> str:
    good = "embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0"
    return f"SELECT *, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {good}"


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"


def _said(text: str) -> str:
    said = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_MERKLE = f"""
        WITH RECURSIVE c AS (SELECT doc_id, source, {_said('text')} AS leaf,
            {_said("(CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS now
            FROM (SELECT *, {_CRC} AS crc FROM (SELECT *, doc_id::VARCHAR AS s FROM documents))),
        d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM c),
        low AS (SELECT source, 0 AS lev, pos, leaf AS h, n FROM d UNION ALL
            SELECT source, min(lev) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), ceil(min(n) / 3)::BIGINT FROM low WHERE n > 1 GROUP BY source, pos // 3),
        sub AS (SELECT source, h AS subroot, lev AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
        high AS (SELECT 0 AS lev, pos, subroot AS h, n FROM sub UNION ALL
            SELECT min(lev) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), ceil(min(n) / 3)::BIGINT FROM high WHERE n > 1 GROUP BY pos // 3),
        top AS (SELECT h AS root, lev AS height FROM high WHERE n = 1),
        step AS (SELECT row_number() OVER () AS k, d.*, subroot, sub.pos AS spos, sub.height AS h1, top.height AS h2, root FROM d JOIN sub ON sub.source IS NOT DISTINCT FROM d.source CROSS JOIN top),
        kin AS (SELECT k, low.lev, low.pos < step.pos // (3 ** low.lev)::BIGINT AS before, low.pos, low.h FROM step JOIN low ON low.source IS NOT DISTINCT FROM step.source AND low.lev < h1
                AND low.pos // 3 = step.pos // (3 ** (low.lev + 1))::BIGINT AND low.pos <> step.pos // (3 ** low.lev)::BIGINT
            UNION ALL SELECT k, h1 + high.lev, high.pos < spos // (3 ** high.lev)::BIGINT, high.pos, high.h FROM step JOIN high ON high.lev < h2
                AND high.pos // 3 = spos // (3 ** (high.lev + 1))::BIGINT AND high.pos <> spos // (3 ** high.lev)::BIGINT),
        side AS (SELECT k, lev, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS b FROM kin GROUP BY 1, 2),
        proof AS (SELECT k, sha256(string_agg(a || b, '' ORDER BY lev)) AS p FROM side GROUP BY 1),
        way AS (SELECT k, list(a ORDER BY lev) AS aa, list(b ORDER BY lev) AS bb FROM (SELECT k, lev, coalesce(a, '') AS a, coalesce(b, '') AS b FROM (SELECT k, unnest(range(0, h1 + h2)) AS lev FROM step) LEFT JOIN side USING (k, lev)) GROUP BY 1),
        climb AS (SELECT k, 0 AS lev, now AS h FROM step UNION ALL
            SELECT k, lev + 1, sha256(aa[lev + 1] || h || bb[lev + 1]) FROM climb JOIN way USING (k) WHERE lev < len(aa)),
        seen AS (SELECT k, arg_max(h, lev) AS h FROM climb GROUP BY 1)
        SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, seen.h AS folded_root, seen.h = root AS verified
        FROM step JOIN seen USING (k) LEFT JOIN proof USING (k)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(
        f"({k}, '{label}', {sorted(set(t.split()))!r}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)}, {math.ceil(len(t.split()) / THRESHOLD - 1e-9)})"
        for k, (label, t) in enumerate(TEMPLATES)
    )
    return f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
        w AS (SELECT doc_id, regexp_extract_all(t, '{_WORDS}') AS ws FROM d),
        phrase(p, label) AS (VALUES {phrases}),
        spot AS (SELECT doc_id, label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + len(p) - 1] = p)) - 1 AS i FROM w CROSS JOIN phrase),
        base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS l FROM spot GROUP BY 1),
        template(k, label, t, need, span) AS (VALUES {templates}),
        word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM w),
        found AS (SELECT doc_id, k, word, i FROM word JOIN (SELECT k, unnest(t) AS word FROM template) USING (word)),
        enough AS (SELECT doc_id, k, need, span, len(t) AS size FROM found JOIN template USING (k) GROUP BY ALL HAVING count(DISTINCT word) >= need),
        near AS (SELECT f.*, need, span, size FROM found f JOIN enough e ON e.doc_id = f.doc_id AND e.k = f.k),
        hit AS (SELECT a.doc_id, a.k, a.i, a.span, count(DISTINCT b.word) / a.size AS c FROM near a JOIN near b ON b.doc_id = a.doc_id AND b.k = a.k AND b.i BETWEEN a.i AND a.i + a.span - 1
            GROUP BY a.doc_id, a.k, a.i, a.span, a.need, a.size HAVING count(DISTINCT b.word) >= a.need),
        part AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) < span THEN 0 ELSE 1 END AS fresh FROM hit)),
        block AS (SELECT doc_id, k, min(i) AS f, max(i) AS l, max(c) AS c FROM part GROUP BY doc_id, k, run),
        best AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS l, string_agg(k || '@' || f || '-' || block.l, ',' ORDER BY f, k) AS s FROM block JOIN template USING (k) GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word,
            coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(best.l, [])))), ','), '') AS labels,
            CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0) END AS score, coalesce(best.s, '') AS blocks
        FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN best ON best.doc_id = w.doc_id"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1)::INT, 1)" for g in range(8) for s in (15, 10, 5, 0)
)

ORACLES = {
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS passage FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
        late AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j.j AS at FROM late CROSS JOIN range(20) j(j)),
        word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS at, unnest(ws) AS word FROM w),
        kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.at) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.at = word.at GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op4_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to FROM p""",
    "op5_license_scan": _license_sql(),
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op11_top_k": f"""
        WITH v AS ({_whole_sql(64)})
        SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id)::INT AS rank, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 20""",
    "op12_hard_negatives": f"""
        WITH v AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({_whole_sql(256)}) WHERE label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
    "op13_merkle": _MERKLE,
}
