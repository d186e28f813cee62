"""Readers and writers of the pipeline's files (S-01..S-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "array<struct<text:string,bbox:array<double>,conf:double>>"


def images(spark: SparkSession, folder: str, glob: str = "*.jpg") -> DataFrame:
    """S-01..S-03: image files with path, size and time; contents stay unread unless selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-05: a whole-file JSON document with an explicit schema; broken ones give nulls instead of an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """S-04, S-06: words of a JSON object {page: [word, ...]}, one row each: page, ocr_index, text, box, conf.

    The metadata entry _meta is no page. Empty pages have no row."""
    text = spark.read.option("wholetext", "true").text(path)
    pages = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("page", "words")).filter("page <> '_meta'")
    w = pages.select("page", F.posexplode(F.from_json("words", WORD)).alias("ocr_index", "w"))
    return w.select("page", "ocr_index", "w.text", *[F.get("w.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("w.conf").alias("conf"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """S-07, E5: annotations with file and label: image_id, file_name, width, height, label, corners, ann_idx."""
    schema = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"
    d = json_document(spark, path, schema).withColumn("doc", F.col("_metadata.file_path"))  # ids hold within their document
    i = d.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    c = d.select("doc", F.explode("categories").alias("c")).select("doc", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    a = d.select("doc", F.posexplode("annotations").alias("ann_idx", "a")).select("doc", "ann_idx", "a.image_id", "a.category_id", "a.bbox")
    b = [F.get("bbox", F.lit(k)) for k in range(4)]
    return a.join(i, ["doc", "image_id"]).join(c, ["doc", "category_id"], "left").select("image_id", "file_name", "width", "height", "label", b[0].alias("x0"), b[1].alias("y0"), (b[0] + b[2]).alias("x1"), (b[1] + b[3]).alias("y1"), "ann_idx")


def page_rows(documents: DataFrame) -> DataFrame:
    """S-10: a row per page: document, page, text; documents without pages have none."""
    p = documents.select("document", F.explode("pages").alias("p"))
    return p.select("document", F.col("p.page").alias("page"), F.col("p.text").alias("text"))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S-08, S-09: CSV with header, quoted line breaks allowed. Empty fields are null."""
    r = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S-14: CSV with header; the columns keep their order, texts their white space."""
    w = df.write.mode("overwrite").option("header", "true").option("escape", '"').option("encoding", "UTF-8")
    w.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """S-11, S-12, S-21, Q-1, Q-2: Parquet by run; a run written again replaces its own partition only, and the committer
    makes it visible as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """S-12, S-18: one JSON object a line, null fields left out."""
    df.write.mode("overwrite").json(path)


def manifest(df: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """S-11: metadata beside the data, never in it: schema version, columns, rows."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(schema_version).alias("schema_version"), F.lit(",".join(df.columns)).alias("columns"), "n_rows")


def pending(facts: DataFrame) -> DataFrame:
    """S-13: facts that still need a scope."""
    return facts.filter("needs_classification")


def upload_ok(name: Column, content: Column, most: int = 50 * 1024 * 1024) -> Column:
    """S-22: a PDF by name and first bytes, within the size limit."""
    return F.coalesce(name.rlike(r"(?i)\.pdf$") & (F.octet_length(content) <= most) & (F.substring(content, 1, 5) == F.lit(b"%PDF-")), F.lit(False))


def write_vectors(df: DataFrame, path: str) -> None:
    """S-19: vectors with their key as Parquet; the key, not the position, ties them to their metadata."""
    df.write.mode("overwrite").parquet(path)


def html_table(df: DataFrame, title: str, most: int = 200) -> str:
    """S-15, S-16: a thin HTML page over a summary; beyond `most` rows it says how many there are and shows the first."""
    esc = lambda x: str("" if x is None else x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    rows = df.limit(most + 1).collect()
    note = f"<p>The first {most} of {df.count()} rows.</p>" if len(rows) > most else ""
    rows = rows[:most]
    head = "".join(f"<th>{esc(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{esc(title)}</title><h1>{esc(title)}</h1>{note}<table><tr>{head}</tr>{body}</table>"
