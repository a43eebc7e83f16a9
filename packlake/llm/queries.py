"""All queries of the training-data operators, by name, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packlake.llm import bpe, generated, languages, packing, parsing, secrets, splitting
from packlake.llm.common import spread, table


def _parsed(spark, sf_dir):
    files = table(spark, sf_dir, "files").select("file_id", "repo", "rel_path", "content")
    return parsing.parse_files(spread(files))


def p1_found(spark, sf_dir):
    return _parsed(spark, sf_dir).where(~F.col("valid")).select("file_id").distinct()


def p1_error_rates(spark, sf_dir):
    return parsing.error_rates(_parsed(spark, sf_dir))


def p1_file_symbols(spark, sf_dir):
    return parsing.repaired_headers(table(spark, sf_dir, "file_symbols"), _parsed(spark, sf_dir))


def _texts(spark, sf_dir):
    files = spread(table(spark, sf_dir, "files").select("file_id", "repo", "rel_path", "content"))
    selected = spread(table(spark, sf_dir, "selected").select("result_id", "task_id", "file_id", "repo", "rel_path", "content"))
    return files, selected


def p2_found(spark, sf_dir):
    files, selected = _texts(spark, sf_dir)
    lines = secrets.secret_lines(files, "file_id", "files").unionByName(secrets.secret_lines(selected, "result_id", "selected"))
    return lines.select("table_name", "row_id", "line_no")


def p2_redacted(spark, sf_dir):
    """Every text with its credentials replaced."""
    files, selected = _texts(spark, sf_dir)
    a = secrets.redacted(files.withColumn("table_name", F.lit("files")).withColumnRenamed("file_id", "row_id"), "table_name", "row_id")
    b = secrets.redacted(selected.withColumn("table_name", F.lit("selected")).withColumnRenamed("result_id", "row_id"), "table_name", "row_id")
    return a.unionByName(b)


def p2_warnings(spark, sf_dir):
    """Warnings of the selected results, in the form of the table secret_warnings."""
    _, selected = _texts(spark, sf_dir)
    return secrets.warnings_of(selected)


def p3_pieces(spark, sf_dir):
    return splitting.split_oversized(table(spark, sf_dir, "selected"), table(spark, sf_dir, "size_limits"), table(spark, sf_dir, "symbols"))


def p3_found(spark, sf_dir):
    """Results that come out of the splitter in more than one piece."""
    return p3_pieces(spark, sf_dir).where("piece_no = 1 AND n_pieces > 1").select("result_id")


def p3_piece_checks(spark, sf_dir):
    """Per oversized result: its bytes and whether its pieces cover it, keep the limit, share the overlap and are its own bytes."""
    pieces, limits = p3_pieces(spark, sf_dir), table(spark, sf_dir, "size_limits")
    sized = splitting.with_limit(table(spark, sf_dir, "selected").select("result_id", "file_id", "kind", "content"), limits).dropDuplicates(["result_id"])
    order = Window.partitionBy("result_id").orderBy("piece_no")
    shared = F.lag("end_byte").over(order) - F.col("start_byte")
    told = pieces.withColumn("shared", shared).join(sized.select("result_id", "content", "max_size", "overlap_size"), "result_id")
    own = F.expr("octet_length(piece) = end_byte - start_byte AND decode(substring(encode(content, 'utf-8'), start_byte + 1, end_byte - start_byte), 'utf-8') = piece")
    return told.groupBy("result_id").agg(
        F.max(F.octet_length("content")).cast("bigint").alias("n_bytes"),
        ((F.min("start_byte") == 0) & (F.max("end_byte") == F.max(F.octet_length("content"))) & (F.count(F.lit(1)) == F.max("n_pieces"))).alias("covers"),
        F.bool_and(F.col("end_byte") - F.col("start_byte") <= F.col("max_size")).alias("within_limit"),
        F.bool_and(F.coalesce((F.col("shared") >= F.col("overlap_size")) & (F.col("shared") <= F.col("overlap_size") + 3), F.lit(True))).alias("overlap_kept"),
        F.bool_and(own).alias("same_bytes"),
    )


def _origins(spark, sf_dir):
    files = spread(table(spark, sf_dir, "files").select("file_id", "repo", "rel_path", "content"))
    return generated.classify(files, table(spark, sf_dir, "vendor_index"))


def p5_found(spark, sf_dir):
    return _origins(spark, sf_dir).where("origin <> 'written'").select("file_id")


def p5_origin_rates(spark, sf_dir):
    return generated.origin_rates(_origins(spark, sf_dir))


def p6_ids(spark, sf_dir):
    return bpe.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_round_trip(spark, sf_dir):
    """What the ids of every document decode to, as a digest."""
    ids = p6_ids(spark, sf_dir)
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(bpe.decoded(F.col("ids"))).alias("digest")).select("doc_id", "digest", (F.col("n") == 0).alias("is_empty"))


def _capacity(spark, sf_dir):
    limits = table(spark, sf_dir, "size_limits").where("lower(trim(use_case)) = 'fill'")
    return limits.agg(F.max("max_size")).first()[0]


def p7_containers(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack_documents(documents, _capacity(spark, sf_dir))


def p7_fill(spark, sf_dir):
    return packing.container_fill(p7_containers(spark, sf_dir), _capacity(spark, sf_dir))


def p7_container_checks(spark, sf_dir):
    """Per document: whether its parts follow each other without a gap, only one above the capacity has several, and whether a container holds it."""
    capacity = _capacity(spark, sf_dir)
    placed = p7_containers(spark, sf_dir)
    order = Window.partitionBy("doc_id").orderBy("part_no")
    follows = F.col("start_token") == F.coalesce(F.lag(F.col("start_token") + F.col("n_tokens")).over(order), F.lit(0))
    fill = placed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    told = placed.withColumn("follows", follows).join(fill, "container_id", "left")
    return told.groupBy("doc_id").agg(
        F.bool_and("follows").alias("in_order"),
        ((F.count(F.lit(1)) == 1) | (F.sum("n_tokens") > capacity)).alias("whole_if_it_fits"),
        F.coalesce(F.bool_and(F.col("used") <= capacity), F.lit(True)).alias("within_capacity"),
        (F.count("container_id") == F.count(F.lit(1))).alias("held"),
    )


def _labelled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "doc_kind", "rel_path")
    counts = languages.host_counts(documents)
    documents = spread(documents)
    return languages.label_documents(documents, languages.fit(documents, counts=counts), counts)


def p8_found(spark, sf_dir):
    return languages.unnamed_languages(_labelled(spark, sf_dir))


def p8_documents(spark, sf_dir):
    return languages.document_languages(_labelled(spark, sf_dir))


def p8_segments(spark, sf_dir):
    return languages.segments_of(_labelled(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_error_rates": p1_error_rates, "p1_file_symbols": p1_file_symbols, "p2_found": p2_found, "p2_redacted": p2_redacted, "p2_warnings": p2_warnings, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_piece_checks": p3_piece_checks, "p5_found": p5_found, "p5_origin_rates": p5_origin_rates, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_container_checks": p7_container_checks, "p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments}
_OVERSIZED = """l AS (SELECT lower(trim(kind)) AS k, max_size FROM size_limits WHERE lower(trim(use_case)) = 'split'),
  o AS (SELECT DISTINCT s.result_id, strlen(s.content) AS n_bytes FROM selected s LEFT JOIN l ON lower(trim(s.kind)) = l.k WHERE strlen(s.content) > coalesce(l.max_size, (SELECT max_size FROM l WHERE k = 'other')))"""
ORACLES = {
    "p3_found": f"WITH {_OVERSIZED} SELECT result_id FROM o",
    "p3_piece_checks": f"WITH {_OVERSIZED} SELECT result_id, n_bytes, true AS covers, true AS within_limit, true AS overlap_kept, true AS same_bytes FROM o",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(text, '') = '' AS is_empty FROM documents",
    "p7_container_checks": "SELECT doc_id, true AS in_order, true AS whole_if_it_fits, true AS within_capacity, coalesce(text, '') <> '' AS held FROM documents",
}
