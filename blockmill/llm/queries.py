"""The pN_ queries: each takes (spark, data directory) and gives a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockmill.functions.sizing import resolved_target
from blockmill.llm import encodings, mail, mixing, neardup, packing, pieces, spans, tokens
from blockmill.sources.tables import latest_rows, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.marked_lines(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "mails")).select("block_id", "line_no")


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.new_texts(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "mails"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = encodings.block_and_chunk_texts(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "chunks"))
    return encodings.find_garbled(records)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_restored(spark, sf_dir).select("rec", "rec_id")


def p3_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, chunks, uploads = (read_table(spark, sf_dir, t) for t in ("blocks", "chunks", "uploads"))
    return packing.pack_items(packing.upload_items(blocks, chunks, uploads))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers of each upload hold: items, bytes, and whether all keep to the capacity."""
    held = p3_containers(spark, sf_dir)
    uploads = latest_rows(read_table(spark, sf_dir, "uploads").where("upload_id IS NOT NULL"), ["upload_id"], "received_at", ["upload_id", "target_chars"])
    sizes = uploads.select("upload_id", resolved_target(F.col("target_chars")).alias("capacity"))
    filled = held.groupBy("rec", "upload_id", "container").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("piece_no") <= 1, 1).otherwise(0)).alias("items")).join(sizes, "upload_id", "left")
    fits = F.col("bytes") <= F.coalesce("capacity", resolved_target(F.lit(0)))
    return filled.groupBy("rec", "upload_id").agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes"), F.bool_and(fits).alias("fits"))


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each oversized chunk cover it from end to end, keep to the limit and repeat what was asked."""
    chunks, uploads = read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "uploads")
    limits = pieces.oversized_chunks(chunks, uploads).select("chunk_id", F.col("__limit").alias("limit"), F.greatest(F.lit(0), F.least("__overlap", F.col("__limit") - 4)).alias("overlap"))
    order = Window.partitionBy("chunk_id").orderBy("piece_no")  # the pieces of one text
    rows = pieces.chunk_pieces(chunks, uploads).join(limits, "chunk_id").withColumn("before", F.lag("end_byte").over(order))
    repeated = F.col("before") - F.col("start_byte")
    good = F.when(F.col("before").isNull(), F.col("start_byte") == 0).otherwise(repeated.between(F.col("overlap") - 3, F.col("overlap")))
    good = good & (F.octet_length("piece") == F.col("end_byte") - F.col("start_byte")) & ((F.octet_length("piece") <= F.col("limit")) | (F.length("piece") == 1))
    return rows.groupBy("chunk_id").agg(F.max("end_byte").alias("n_bytes"), F.bool_and(good).alias("whole"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.chunk_pieces(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "uploads"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).select("chunk_id").distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(read_table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs_within(p5_groups(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(read_table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tokens.encode_with_offsets(read_table(spark, sf_dir, "documents"))
    last = F.when(F.size("ids") > 0, F.element_at("char_starts", -1) < F.col("n_chars")).otherwise(F.lit(True))
    sizes = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_bytes", "n_chars")]
    return coded.select("doc_id", *sizes, (F.col("restored") & F.coalesce(last, F.lit(True))).alias("restored"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read_table(spark, sf_dir, "mix_targets")
    sized = mixing.weighed_documents(read_table(spark, sf_dir, "documents"))
    return mixing.reached_shares(mixing.mix_sources(sized, targets), sized, targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.documents_with_shared_spans(read_table(spark, sf_dir, "documents"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_containers": p3_containers,
    "p3_totals": p3_totals,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_cover": p4_cover,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_share": p8_share,
}

SIZED_UPLOADS = """
    sized AS (
        SELECT upload_id, CASE WHEN target_chars > 0 THEN target_chars ELSE 5500 END AS target,
               greatest(CASE WHEN max_chars > 0 THEN max_chars ELSE 6000 END,
                        CASE WHEN target_chars > 0 THEN target_chars ELSE 5500 END) AS limit_bytes
        FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY received_at DESC) AS n FROM uploads) WHERE n = 1
    )"""

SHARED_WINDOWS = """
    WITH starts AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200),
    windows AS (SELECT DISTINCT doc_id, hash(substring(text, CAST(i AS INTEGER), 200)) AS h FROM starts),
    shared AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
    SELECT DISTINCT doc_id FROM windows SEMI JOIN shared USING (h)"""

LINKED_PAIRS = """
    WITH RECURSIVE once AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
    words AS (SELECT chunk_id, list_filter(string_split_regex(lower(text), '[ \t\n]+'), lambda x: x <> '') AS w FROM once),
    sets AS (SELECT chunk_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]))) AS s FROM words WHERE len(w) >= 20),
    sizes AS (SELECT chunk_id, count(*) AS n FROM sets GROUP BY chunk_id),
    pairs AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE pairs.n >= 0.6 * (x.n + y.n - pairs.n)),
    ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
    SELECT DISTINCT a AS chunk_id_a, b AS chunk_id_b FROM reach WHERE a < b"""

SHARED_CHARS = """
    WITH starts AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200),
    windows AS (SELECT doc_id, i, hash(substring(text, CAST(i AS INTEGER), 200)) AS h FROM starts),
    shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
    held AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows SEMI JOIN shared USING (h)),
    chars AS (SELECT doc_id, CAST(sum(least(200, coalesce(i - before, 200))) AS BIGINT) AS shared_chars FROM held GROUP BY doc_id)
    SELECT doc_id, shared_chars, shared_chars / length(text) AS share FROM chars JOIN documents USING (doc_id)"""

ORACLES = {
    "p4_found": f"""
        WITH {SIZED_UPLOADS}
        SELECT DISTINCT chunk_id FROM chunks LEFT JOIN sized USING (upload_id)
        WHERE strlen(text) > coalesce(limit_bytes, 6000)""",
    "p3_totals": """
        WITH items AS (
            SELECT 'block' AS rec, upload_id, text FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC) AS n FROM blocks WHERE block_id IS NOT NULL) WHERE n = 1
            UNION ALL SELECT 'chunk', upload_id, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1)
        SELECT rec, upload_id, CAST(count(*) AS BIGINT) AS items, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes, TRUE AS fits FROM items GROUP BY rec, upload_id""",
    "p4_cover": f"""
        WITH {SIZED_UPLOADS}
        SELECT chunk_id, CAST(max(strlen(text)) AS BIGINT) AS n_bytes, TRUE AS whole FROM chunks LEFT JOIN sized USING (upload_id)
        WHERE strlen(text) > coalesce(limit_bytes, 6000) GROUP BY chunk_id""",
    "p5_found": LINKED_PAIRS,
    "p8_found": SHARED_WINDOWS,
    "p8_share": SHARED_CHARS,
    "p5_groups": f"""
        WITH RECURSIVE {LINKED_PAIRS.split("WITH RECURSIVE", 1)[1].rsplit("SELECT DISTINCT a AS", 1)[0]}
        SELECT chunk_id, CAST(least(chunk_id, coalesce(min(b), chunk_id)) AS BIGINT) AS group_id FROM sizes LEFT JOIN reach ON a = chunk_id GROUP BY chunk_id""",
    "p6_roundtrip": """
        SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, TRUE AS restored FROM documents""",
}
