"""Views of a chunk table: files, methods, counts, exploration, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import clip
from .numbering import fill_missing


def coalesce_text(*cols: str) -> Column:
    """First of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def source_files(chunks: DataFrame) -> DataFrame:
    return chunks.select(coalesce_text("source_file", "file_name").alias("source_file")).filter(
        F.col("source_file").isNotNull()
    ).distinct()


def methods(chunks: DataFrame) -> DataFrame:
    """Methods in use with their display order: hierarchical first, then by name."""
    rows = chunks.select("chunking_method").filter(F.col("chunking_method").isNotNull()).distinct()
    order = [F.col("chunking_method") != "hierarchical", F.col("chunking_method")]
    return rows.withColumn("ord", F.row_number().over(W.orderBy(*order)))


def file_statistics(chunks: DataFrame) -> DataFrame:
    """Per file: chunks, methods with counts, first upload, model.

    Two levels, so a file with most of the chunks is already one row per method and
    task before anything is shuffled.
    """
    per_method = chunks.withColumn("source_file", coalesce_text("source_file", "file_name")).filter(
        F.col("source_file").isNotNull()
    ).groupBy("source_file", "chunking_method").agg(
        F.count("*").alias("n"), F.min("upload_timestamp").alias("ts"), F.min("embedding_model").alias("model")
    )
    pairs = F.sort_array(F.collect_list(F.when(
        F.col("chunking_method").isNotNull(), F.struct(F.col("chunking_method").alias("method"), F.col("n").alias("n"))
    )))
    rows = per_method.groupBy("source_file").agg(
        F.sum("n").alias("chunk_count"), pairs.alias("pairs"),
        F.min("ts").alias("upload_timestamp"), F.coalesce(F.min("model"), F.lit("Unknown")).alias("embedding_model"),
    )
    names = F.transform("pairs", lambda p: p["method"])
    stamp = F.date_format(F.col("upload_timestamp").try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "source_file", "chunk_count", names.alias("chunking_methods"),
        F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("Unknown").alias("chunking_methods_str"),
        F.map_from_entries("pairs").alias("chunking_method_counts"), "upload_timestamp",
        F.coalesce(stamp, F.col("upload_timestamp"), F.lit("Unknown")).alias("upload_date"), "embedding_model",
    )


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("source_file", coalesce_text("source_file", "file_name")).filter(
        F.col("source_file").isNotNull()
    ).groupBy("source_file").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("total_files"), F.sum("n").alias("total_chunks")
    )


def first_seen(chunks: DataFrame) -> DataFrame:
    """Per file: chunks and the method and time of its first chunk."""
    first = F.min(F.struct("chunk_number", "chunking_method", "upload_timestamp"))
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunk_count"), first.alias("f")).select(
        "source_file", "chunk_count", F.col("f.chunking_method").alias("chunking_method"),
        F.col("f.upload_timestamp").alias("upload_timestamp"),
    )


def processed_files(chunks: DataFrame) -> DataFrame:
    """Per file: chunks and type, taken from the source type or the file extension."""
    ext = F.nullif(F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    kind = F.coalesce(F.nullif(F.col("source_type"), F.lit("")), ext, F.lit("unknown"))
    return chunks.withColumn("file_type", kind).groupBy("file_name").agg(
        F.count("*").alias("chunk_count"), F.min("file_type").alias("file_type")
    )


def exploration_summary(chunks: DataFrame) -> DataFrame:
    chars = F.coalesce("char_count", F.length("text"))
    return chunks.agg(
        F.count("*").alias("chunks"), F.sum(chars).cast("long").alias("chars"),
        F.round(F.avg(chars), 6).alias("mean_chars"), F.count_distinct("page").alias("pages"),
    )


def shares(chunks: DataFrame, key: str) -> DataFrame:
    """Count and percentage per value."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("n"))
    total = chunks.agg(F.count("*")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 1))


def explore(chunks: DataFrame, source_file: str | None, method: str, level: int | None = None) -> DataFrame:
    """Chunks of a file and method in reading order, every one numbered; negative numbers don't count."""
    rows = chunks.filter(F.col("chunking_method") == method)
    if source_file is not None:
        rows = rows.filter(F.col("source_file") == source_file)
    if level is not None:
        rows = rows.filter(F.col("chunk_level") == level)
    number = F.coalesce(*[
        F.when(F.col(c) >= 0, F.col(c)) for c in ("chunk_number", "chunk_index")
    ])
    # Rows without a page come last.
    rows = rows.withColumns({"chunk_number": number, "_page": F.coalesce("page", F.lit(2**31 - 1))})
    return fill_missing(rows, ["source_file"], ["_page", "id"]).drop("_page")


def neighbours(chunks: DataFrame, by: list[str], order: str, id_col: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(order)
    return chunks.withColumns({
        "previous_id": F.lag(id_col).over(w), "next_id": F.lead(id_col).over(w),
    })


def preview(c: Column, n: int = 200) -> Column:
    return clip(c, n)


def unprocessed(files: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Files that have no chunk yet."""
    return files.join(chunks.select(key).distinct(), key, "left_anti")


def delete_files(chunks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and a one-row report of what went."""
    gone = chunks.join(files, "source_file", "left_semi")
    report = gone.agg(
        (F.count("*") > 0).alias("success"), F.count("*").alias("deleted_count"),
        F.concat(F.lit("deleted "), F.count("*"), F.lit(" chunks")).alias("message"),
    )
    return chunks.join(files, "source_file", "left_anti"), report


def merge_by_key(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows without those the incoming ones replace, plus the last of each incoming key."""
    # Winners are chosen on key, order and a digest, so reruns agree; what is left of a key are equal rows.
    rank = F.struct(F.col(order).alias("o"), F.md5(F.to_json(F.struct(*incoming.columns)).cast("binary")).alias("d"))
    # A row moves once, with its rank.
    last = incoming.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*incoming.columns), rank).alias("_row"))
    latest = last.select("_row.*")
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def check_vectors(chunks: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector does not have the dimension of the collection."""
    return chunks.filter(F.col("embedding").isNull() | (F.size("embedding") != dim))
