"""Raw texts, catalogue lines, CSV with JSON columns, and graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text, sentence_array

SENTENCE_CSV = "TextID long, Author string, Title string, Sentence string"
METRICS_CSV = (
    "TextID long, TextTitle string, Text_Author string, Text_year_creation int, total_sentences long, token_sentences long, "
    "token_sentence_percent double, top_tokens string, avg_words_per_token_sentence double, avg_words_for_token_sentence double, top_pos_stats string"
)
TOKENS_JSON = "array<struct<token:string,count:bigint>>"
POS_JSON = "map<string,array<struct<part_of_speech:string,frequency:bigint,examples:array<string>>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, text) per UTF-8 file, cleaned. A file is one row, so split sentences before repartitioning few huge files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), clean_text(F.col("value")).alias("text"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, sentence) of UTF-8 files of any size: those of ``split_sentences`` over whole texts, without a row that holds a whole file.

    No sentence goes beyond its line, so files are read by ranges of lines, which Spark cuts at ``spark.sql.files.maxPartitionBytes``. A place is the place within
    its range and the sentences of the ranges before it; one task sees one range, or the counts of one file's ranges. A single line has to fit a row.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    found = lines.select(*place, F.posexplode(sentence_array(F.translate("value", "\x00", ""))).alias("_nth", "sentence"))
    counts = found.groupBy("path", "_block").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("path").alias("_path"), F.col("_block").alias("_start"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_line", "_nth"))
    placed = found.withColumn("_i", within).join(before, (F.col("path") == F.col("_path")) & (F.col("_block") == F.col("_start")))
    return placed.select("path", (F.col("_before") + F.col("_i") - 1).alias("pos"), "sentence")


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """Rows (text_id, title, author, genre, year_from, year_to) of ``lines(n long, value string)``: ``N. Title / Author[ / genre] / year``.

    The last field is the year or a range; the one before it is a genre if it starts with a small letter, else the author; what is
    left before is the title. Lines from the first ``---`` on are notes. Lines of another form are dropped.
    """
    stop = lines.where(F.col("value").rlike(r"^\s*---")).agg(F.min("n").alias("stop"))
    kept = lines.join(F.broadcast(stop), F.expr("stop is null or n < stop"))
    body = kept.select(F.regexp_extract("value", r"^\s*(\d+)\.\s*(.*\S)\s*$", 1).alias("id"), F.regexp_extract("value", r"^\s*(\d+)\.\s*(.*\S)\s*$", 2).alias("body"))
    parts = body.where("id <> ''").withColumn("p", F.split("body", r"\s+/\s+")).where("size(p) >= 3").withColumn("k", F.size("p"))
    before_year = F.get("p", F.col("k") - 2)
    has_genre = before_year.rlike(r"^\p{Ll}") & (F.col("k") > 3)
    n_title = F.col("k") - F.when(has_genre, 3).otherwise(2)
    year = F.get("p", F.col("k") - 1)
    years = parts.select(
        F.col("id").cast("long").alias("text_id"),
        F.array_join(F.slice("p", F.lit(1), F.when(has_genre, F.col("k") - 3).otherwise(F.col("k") - 2)), " / ").alias("title"),
        F.get("p", n_title).alias("author"),
        F.when(has_genre, before_year).alias("genre"),
        F.expr("try_cast(regexp_extract(p[k - 1], '([0-9]{4})', 1) as int)").alias("year_from"),
        F.regexp_extract(year, r"(\d{4})\s*-\s*(\d{4})", 2).alias("last"),
    )
    return years.select("text_id", "title", "author", "genre", "year_from", F.coalesce(F.expr("try_cast(last as int)"), "year_from").alias("year_to"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")


def read_sentences_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SENTENCE_CSV)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_columns(read_csv(spark, path, METRICS_CSV))


def read_wide_csv(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The wide table of texts with its n top tokens and n top parts of speech side by side, as ``analytical_table`` has them."""
    ranks = [f"{name} {kind}" for names in (("Top{}_Token", "Top{}_Count"), ("POS{}", "POS{}_Count")) for form, kind in zip(names, ("string", "long"), strict=True) for name in (form.format(i) for i in range(1, n + 1))]
    return read_csv(spark, path, ", ".join(["text_id long, total_sentences long, token_sentences long, avg_words double", *ranks]))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with header; nested columns must be strings by now."""
    df.write.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def parse_json_columns(df: DataFrame) -> DataFrame:
    """Decode ``top_tokens`` and ``top_pos_stats``; single quotes count as double ones, malformed or missing text gives an empty value."""
    quoted = {c: F.translate(c, "'", '"') for c in ("top_tokens", "top_pos_stats")}
    return df.withColumn("top_tokens", F.coalesce(F.from_json(quoted["top_tokens"], TOKENS_JSON), F.array().cast(TOKENS_JSON))).withColumn(
        "top_pos_stats", F.coalesce(F.from_json(quoted["top_pos_stats"], POS_JSON), F.create_map().cast(POS_JSON))
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
