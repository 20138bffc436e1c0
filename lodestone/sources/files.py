"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: lines with their number from 0 within each file, final line end or not.

    A line's number needs all lines before it, so a file is one record; folders of files are read in parallel.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("v"))
    lines = F.split(F.regexp_replace("v", "\r\n?", "\n"), "\n")
    return whole.select("file", F.posexplode(lines).alias("line", "value"))


def _ints(text: Column, kind: str = "int") -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.cast(kind))


def baskets_text(spark: SparkSession, path: str) -> DataFrame:
    """``basket_id, items``: a basket per line, whole numbers between white space, repeats dropped; a blank line is an empty basket.

    A missing path raises when the plan is made.  Ids are unique, not consecutive.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("basket_id"), F.array_distinct(_ints(F.col("value"))).alias("items"))


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` of a comma-separated list, ids from 1."""
    return spark.read.schema("src INT, dst INT").csv(path)


def edges_text(spark: SparkSession, path: str) -> DataFrame:
    """``seq, u, v`` of a white-space list: lines of fewer than two numbers (comments too) fall out, further fields are ignored.

    ``seq`` rises in file order.
    """
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), parts.alias("p"))
    return rows.select("seq", F.expr("try_cast(try_element_at(p, 1) AS INT)").alias("u"), F.expr("try_cast(try_element_at(p, 2) AS INT)").alias("v")).where("u is not null and v is not null")


def graph_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``id, neighbours`` of an adjacency file: comments before the header ``N M``, then line i names node i's neighbours.

    A comment after the header uses up an id without giving a node.
    """
    lines = numbered_lines(spark, path)
    comment = F.col("value").startswith("%") | F.col("value").startswith("#")
    header = lines.where(~comment).groupBy("file").agg(F.min("line").alias("header"))
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    body = lines.join(header, "file").join(last, "file").where((F.col("line") > F.col("header")) & ~comment)
    body = body.where((F.col("line") < F.col("last")) | (F.col("value") != ""))  # what follows the final line end is no line
    return body.select((F.col("line") - F.col("header")).cast("int").alias("id"), _ints(F.col("value")).alias("neighbours"))


def graph_parts(spark: SparkSession, path: str) -> DataFrame:
    """``id, part``: line i holds node i's part."""
    return numbered_lines(spark, path).where(F.trim("value") != "").select((F.col("line") + 1).alias("id"), F.trim("value").cast("int").alias("part"))


def documents_text(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, name, text``: a document per file, ids in order of name."""
    from pyspark.sql import Window

    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    ids = d.select("name").withColumn("doc_id", F.row_number().over(Window.orderBy("name")) - 1)  # names only
    return d.join(ids, "name").select("doc_id", "name", "text")


def books_csv(spark: SparkSession, path: str) -> DataFrame:
    """``bookno, Title, Author, Language``, trimmed."""
    b = spark.read.option("header", True).csv(path)
    return b.select(*[F.trim(F.col(c)).alias(c) for c in ("bookno", "Title", "Author", "Language")])


def stories_csv(spark: SparkSession, path: str) -> DataFrame:
    """``bookno, content``: content is all columns after the first, joined by commas; of several rows of a book the last counts."""
    s = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    first, rest = s.columns[0], s.columns[1:]
    rows = s.select(F.trim(F.col(first)).alias("bookno"), F.concat_ws(",", *[F.col(c) for c in rest]).alias("content"), F.monotonically_increasing_id().alias("seq"))
    return rows.groupBy("bookno").agg(F.max_by("content", "seq").alias("content"))


def books_of(books: DataFrame, stories: DataFrame, author: str) -> DataFrame:
    """``bookno, content`` of an author's books."""
    return stories.join(books.where(F.col("Author") == author).select("bookno"), "bookno", "left_semi")


def round_report(report: DataFrame, path: str) -> None:
    """Rounds as tab-separated text with a header; the folder's name is the caller's to choose."""
    report.orderBy("round").write.option("sep", "\t").option("header", True).csv(path)
