"""Reading, assembling, routing and naming of documents, and snapshots of analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.spans import strip

# Handlers by MIME type and suffix, and the words of a file name that tell its type.
HANDLERS = (
    ("text", ("text/plain",), ("txt", "text", "md")),
    ("pdf", ("application/pdf",), ("pdf",)),
    ("docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), ("docx",)),
)
TYPE_RULES = (
    (("pitch", "deck"), "PITCH_DECK"), (("financial", "model"), "FINANCIAL_MODEL"), (("financials",), "FINANCIAL_MODEL"), (("business", "plan"), "BUSINESS_PLAN"),
    (("term", "sheet"), "TERM_SHEET"), (("sha",), "SHA"), (("cap", "table"), "CAP_TABLE"), (("bank", "statement"), "BANK_STATEMENT"), (("gst",), "GST"), (("roc",), "ROC"),
    (("patent",), "PATENT"), (("demo",), "PRODUCT_DEMO"),
)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1))


def title_case(text: Column) -> Column:
    """Each run of cased letters with its first letter in title case and the others in lower case, whatever stands between."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"[{cased}]+|[^{cased}]+"), F.lit(0)), F.initcap), "")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text, encoding, extension, length): UTF-8, else Latin-1, with lines ended by a line feed."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.when(good, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")), r"\r\n?", "\n")
    name = base_name(F.col("path"))
    return raw.select("path", stem(name).alias("title"), text.alias("text"), F.when(good, "utf-8").otherwise("latin-1").alias("encoding"), suffix(name).alias("extension"), F.char_length(text).alias("length"))


def assemble_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) of pages (doc_id, page_no, text): stripped pages joined by blank lines, with each page's offsets.

    A document's pages meet in one row, as they do in its text.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page_no", strip(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"])
    docs = pages.groupBy("doc_id").agg(ordered.alias("_pages"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<idx: int, start_offset: int, end_offset: int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.char_length(p)
        one = F.array(F.struct(F.size(acc["found"]).alias("idx"), acc["at"].alias("start_offset"), end.alias("end_offset")))
        return F.struct((end + 2).alias("at"), F.concat(acc["found"], one).alias("found"))

    segments = docs.select("doc_id", F.inline(F.aggregate("_pages", zero, step, lambda acc: acc["found"]))).withColumn("page", F.col("idx") + 1)
    return docs.select("doc_id", F.array_join("_pages", "\n\n").alias("text"), F.size("_pages").alias("page_count")), segments


def assemble_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text, paragraph_count) of (doc_id, idx, text): non-empty stripped paragraphs by lines; the count has all."""
    stripped = strip(F.coalesce("text", F.lit("")))
    kept = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("idx", stripped.alias("t")))), lambda x: x["t"]), lambda t: t != "")
    return paragraphs.groupBy("doc_id").agg(F.array_join(kept, "\n").alias("text"), F.count("*").alias("paragraph_count"))


def route(mime: Column, filename: Column, strict: bool = False) -> Column:
    """The first handler that takes the MIME type, as it is written, or the suffix; if none does null, or an error where strict."""
    out, end = None, suffix(filename)
    for name, mimes, ends in HANDLERS:
        takes = F.coalesce(mime.isin(*mimes), F.lit(False)) | F.coalesce(end.isin(*ends), F.lit(False))
        out = F.when(takes, name) if out is None else out.when(takes, name)
    return out.otherwise(F.raise_error(F.concat_ws(" ", F.lit("no handler for"), mime, filename))) if strict else out


def resolve_title(kind: Column, title: Column, filename: Column) -> Column:
    """The file's own title unless it says nothing, else the file's stem."""
    t = strip(title)
    blank = t.isNull() | (t == "") | ((kind == "pdf") & F.lower(t).isin("untitled", "none"))
    return F.when(~blank, t).otherwise(stem(filename))


def infer_document_type(filename: Column) -> Column:
    name, out = F.regexp_replace(F.lower(stem(filename)), "[- ]", "_"), None
    for words, kind in TYPE_RULES:
        all_ = F.lit(True)
        for w in words:
            all_ = all_ & name.contains(w)
        out = F.when(all_, kind) if out is None else out.when(all_, kind)
    return out.otherwise("OTHER")


def discover(files: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, metadata rows without a visible file): such files with given or derived title and type; an empty title is none."""
    visible, name = files.where(~F.col("filename").startswith(".")), F.col("filename")
    title = F.coalesce(F.nullif("given_title", F.lit("")), title_case(F.translate(stem(name), "_", " ")))
    docs = visible.join(metadata, "filename", "left").select("filename", title.alias("title"), F.coalesce("given_type", infer_document_type(name)).alias("document_type"))
    return docs, metadata.join(visible, "filename", "left_anti")


def storage_path(startup: Column, document: Column, filename: Column) -> Column:
    return F.concat_ws("/", startup, document, filename)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def analysis_snapshots(runs: DataFrame, model: str) -> DataFrame:
    """Rows to store: input, metrics and result as JSON, and the fields that listings need."""
    result = F.col("result")
    return runs.select(
        F.coalesce("startup_id", F.raise_error(F.lit("startup_id is required"))).alias("startup_id"), "id", F.lit("completed").alias("status"), F.coalesce("model_name", F.lit(model)).alias("model_name"),
        F.to_json("input").alias("input_snapshot"), F.to_json("metrics").alias("metrics_snapshot"), F.to_json(result).alias("result_snapshot"), result["preliminary_recommendation"].alias("recommendation"), result["investment_thesis"].alias("investment_thesis"),
    )


def write_snapshots(snapshots: DataFrame, path: str, partitions: str = "status") -> None:
    snapshots.write.mode("append").partitionBy(partitions).parquet(path)


HISTORY = ("id", "startup_id", "mode", "status", "recommendation", "created_at")


def history_item(analyses: DataFrame) -> DataFrame:
    return analyses.select(*HISTORY)


#: What the detail of an analysis has besides: how it ran, and what was stored of it.
RUN = ("analysis_version", "model_name", "thinking_enabled", "max_tokens", "temperature", "finish_reason", "prompt_tokens", "completion_tokens")
STORED = ("inference_time_seconds", "investment_thesis", "input_snapshot", "metrics_snapshot", "result_snapshot", "error_message")


def history_detail(analyses: DataFrame) -> DataFrame:
    """A history item with how the analysis ran, its tokens in all, and its input, metrics, result and error as stored."""
    return analyses.select(*HISTORY, *RUN, (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), *STORED)
