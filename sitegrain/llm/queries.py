"""The opN_ queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language, line_dedup, merkle, mixing, pii, replay, simhash, token_files, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The vocabulary file that the token queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; null texts and texts without letters are ``und`` with score 0, rows without an id are
    scored and teach nothing, rows that repeat give a row each, and empty tables none."""
    return language.predict_languages(_table(spark, sf_dir, "documents"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives it was written to; null html is an empty payload, null urls are empty,
    rows that repeat an id give a record each, and empty tables no rows."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text, null and empty ones included; rows without an id are scored and teach nothing,
    rows that repeat give a row each, an id with contrary labels counts as toxic, and empty tables give no rows."""
    return toxicity.predict_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text; null, empty and wordless texts have fingerprint 0 and are linked like any
    other, null ids get the smallest id of their component, rows that repeat give a row each, empty tables none."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of every document; null texts have size 0, the null source is the last, rows that
    repeat count each, and empty tables give no rows."""
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every group of equal texts; null texts count as empty, null ids come last, of rows that
    share the largest id one stays, and empty tables give no rows."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text; the counts are of base spans, which the contract fixes, and ``spans`` holds what the
    method adds as well.  Null and empty texts have none, rows that repeat give a row each, empty tables none."""
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    counts = (F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in pii.KINDS)
    return found.select("doc_id", *counts, "base_sha256", "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text, how many of them stay, and the numbers of those that go; null and empty texts have none, rows
    that repeat are rows of their own whose later lines go, and empty tables give no rows."""
    return line_dedup.deduplicated_lines(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text inside occurrences of benchmark windows; null texts have no words, items without an id are left
    out of the list alone, rows that repeat give a row each, and either table may be empty."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, read back from the files; null and empty texts have the end id alone, rows
    without an id come first, rows that share one follow one another, and empty tables give no rows."""
    return token_files.token_digest(_table(spark, sf_dir, "documents"), tokenizer_file())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every row, and the root that its tampered text gives; null fields are dashes, null ids come
    first and are not tampered with, rows that repeat are leaves each, and empty tables give no rows."""
    proofs = merkle.manifest(_table(spark, sf_dir, "documents"), merkle.tampered_text(F.col("doc_id"), F.col("text")))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_log_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after every epoch of the log, and every undone change; rows without an id have no place in the log, null
    sources are a stream, null texts delete, rows that repeat are replayed each, and empty tables give no rows."""
    return replay.reassemble(replay.log_records(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every fiftieth; null vectors and those with null or non-finite components
    take no part, rows that repeat are vectors of their own, and empty tables give no rows."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def warc_salvage_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the salvage reader recovers from damaged archives of the whole ``pages`` table."""
    return warc.salvage_damaged(_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_warc_salvage,
        op3_toxicity,
        op4_simhash_near_dedup,
        op5_source_mixing,
        op6_exact_dedup,
        op7_personal_data,
        op8_line_dedup,
        op9_decontamination,
        op10_token_files,
        op11_merkle_manifest,
        op12_log_reassembly,
        op13_exact_top_k,
        warc_salvage_damaged,
    )
}

#: CRC-32 in SQL: ``crc`` holds the table of the polynomial, and a digest is a fold of a text's bytes over it.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc32(text: str) -> str:
    return f"xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    parts = (f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


ORACLES = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS (SELECT *, {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS hit FROM documents, crc),
        l AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN hit THEN {_leaf(_LOWERED)} ELSE {_leaf("text")} END AS other FROM d),
        leaves AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM l WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
        up AS (
          SELECT lang, 0 AS lvl, idx, leaf AS node, n FROM leaves
          UNION ALL
          SELECT lang, lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, lvl, idx // 8, n),
        sub AS (SELECT lang, node, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (
          SELECT 0 AS lvl, idx, node, n FROM sub
          UNION ALL
          SELECT lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, idx // 8, n),
        run AS (
          SELECT lang, lvl, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM up WHERE n > 1 WINDOW w AS (PARTITION BY lang, lvl, idx // 8 ORDER BY idx)),
        toprun AS (
          SELECT lvl, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // 8 ORDER BY idx)),
        climb AS (
          SELECT lang, idx AS id, 0 AS lvl, idx, n, other AS node, '' AS proof FROM leaves
          UNION ALL
          SELECT c.lang, c.id, c.lvl + 1, c.idx // 8, (c.n + 7) // 8, sha256(l || c.node || r), proof || l || r
          FROM climb c JOIN run s ON c.lang IS NOT DISTINCT FROM s.lang AND c.lvl = s.lvl AND c.idx = s.idx WHERE c.n > 1),
        over AS (
          SELECT c.lang, c.id, 0 AS lvl, sub.idx, sub.n, c.node, proof FROM climb c JOIN sub ON c.lang IS NOT DISTINCT FROM sub.lang WHERE c.n = 1
          UNION ALL
          SELECT c.lang, c.id, c.lvl + 1, c.idx // 8, (c.n + 7) // 8, sha256(l || c.node || r), proof || l || r
          FROM over c JOIN toprun s ON c.lvl = s.lvl AND c.idx = s.idx WHERE c.n > 1)
        SELECT doc_id, leaf, sub.node AS subroot, top.node AS root, sha256(proof) AS proof_sha256, over.node AS folded_root, over.node = top.node AS verified
        FROM leaves JOIN over ON leaves.lang IS NOT DISTINCT FROM over.lang AND leaves.idx = over.id AND over.n = 1
        JOIN sub ON leaves.lang IS NOT DISTINCT FROM sub.lang JOIN top ON top.n = 1
    """,
    "op12_log_reassembly": f"""
        WITH {_CRC_TABLE},
        d AS (
          SELECT doc_id, source, text, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic, {_crc32("CAST(doc_id AS VARCHAR)")} AS h
          FROM documents, crc WHERE doc_id IS NOT NULL),
        r AS (
          SELECT doc_id, source, h % 17 AS p, h // 100 % 30000 AS key,
                 CASE WHEN h % 17 > 6 AND NOT coalesce(toxic, false) THEN {_crc32("(h // 100 % 30000) || ':' || text")} END AS value,
                 sum(CASE WHEN h % 17 <= 1 THEN 1 END) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS commits,
                 coalesce(sum(CASE WHEN h % 17 <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn
          FROM d, crc),
        s AS (
          SELECT *, CASE WHEN p IN (3, 4) THEN 1 WHEN p IN (5, 6) THEN -1 ELSE 0 END AS step,
                 sum(step) OVER (PARTITION BY source, txn ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total,
                 max(CASE WHEN p <= 2 THEN doc_id END) OVER (PARTITION BY source, txn) AS ended,
                 max(CASE WHEN p <= 1 THEN (commits - 1) // 64 + 1 END) OVER (PARTITION BY source, txn) AS epoch
          FROM r),
        v AS (
          SELECT *, total - step - least(0, coalesce(min(total) OVER (PARTITION BY source, txn ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS open,
                 CASE WHEN p IN (3, 4) THEN open + 1 ELSE open END AS level
          FROM s WHERE p > 2),
        u AS (
          SELECT *, min(CASE WHEN p IN (5, 6) THEN doc_id END) OVER (PARTITION BY source, txn, level ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back
          FROM v),
        c AS (SELECT * FROM u WHERE p > 6),
        last AS (
          SELECT key, epoch, max_by(struct_pack(v := value), struct_pack(e := ended, d := doc_id)).v AS value FROM c WHERE back IS NULL AND epoch IS NOT NULL GROUP BY key, epoch),
        steps AS (
          SELECT epoch, CAST(value IS NOT NULL AS INT) - CAST(lag(value) OVER w IS NOT NULL AS INT) AS dn, coalesce(value, 0) - coalesce(lag(value) OVER w, 0) AS dv
          FROM last WINDOW w AS (PARTITION BY key ORDER BY epoch)),
        epochs AS (SELECT epoch, 0 AS dn, 0 AS dv FROM s WHERE p <= 1 UNION ALL SELECT * FROM steps)
        SELECT 'state' AS kind, epoch AS id, CAST(sum(sum(dn)) OVER w AS BIGINT) AS n, CAST(sum(sum(dv)) OVER w AS BIGINT) AS value
        FROM epochs GROUP BY epoch WINDOW w AS (ORDER BY epoch)
        UNION ALL
        SELECT CASE WHEN back IS NULL THEN 'abort' ELSE 'rollback' END, doc_id, coalesce(back, ended), key FROM c WHERE back IS NOT NULL OR epoch IS NULL
    """,
    "op13_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op2_warc_salvage": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "warc_salvage_damaged": """
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, left(md5(CAST(page_id AS VARCHAR)), 1) <> '0' AS recovered FROM pages
    """,
    "op5_source_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
          FROM documents),
        s AS (
          SELECT source, sum(size) AS source_size,
                 CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
          FROM d GROUP BY source),
        v AS (
          SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM s WINDOW o AS (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST)),
        t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM v),
        q AS (
          SELECT doc_id, size, source_size, target,
                 sum(size) OVER (PARTITION BY d.source ORDER BY mixed, doc_id ROWS UNBOUNDED PRECEDING) - size AS queue
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(greatest(0, least(size, floor(target) - queue)) + greatest(0, least(size, floor(target) - source_size - queue)) AS BIGINT) AS taken
        FROM q
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_decontamination": r"""
        WITH d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
          FROM documents),
        b AS (
          SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
          FROM benchmark),
        bw AS (
          SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS win
          FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        dw AS (
          SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, item_id, s, dw.k FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
        item AS (
          SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN item USING (doc_id)
    """,
}
