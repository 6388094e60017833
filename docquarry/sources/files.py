"""Document sources: files by suffix, evaluation sets, question files, HTML pages, JSON reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T

PLAIN = (".txt", ".md")
SUFFIXES = (*PLAIN, ".pdf", ".docx")
#: Lines and paragraphs that count as a page.
LINES_A_PAGE, PARAGRAPHS_A_PAGE = 40, 30
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> list[str]:
    """The paragraphs of a Word file that are not blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))
    return [t for t in texts if t.strip()]


#: Reads the page texts of a PDF.
PageReader = Callable[[bytes], list[str]]


def first_pages(data: bytes, readers: Sequence[PageReader]) -> list[str]:
    """The pages of the first reader that finds any text; readers that fail are passed over unless none comes to an end."""
    pages, failed = None, None
    for read in readers:
        try:
            pages = read(data)
        except Exception as e:  # noqa: BLE001  a reader of files may raise anything
            failed = e
            continue
        if any(p.strip() for p in pages):
            return pages
    if pages is None:
        raise failed
    return pages


def parse(path: str, data: bytes, pdf_pages: PageReader | Sequence[PageReader] | None = None) -> tuple[str, int, int]:
    """Text, pages and lines of a file by its suffix; ValueError for another suffix, or a PDF without a reader.

    Several readers of PDF are tried in order, see ``first_pages``.

    Bytes that are no UTF-8 become replacement characters. Pages without text are left out.
    """
    suffix = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in PLAIN:
        text = data.decode("utf-8", "replace").removeprefix("\ufeff")
        lines = len(text.splitlines())
        return text, lines // LINES_A_PAGE or 1, lines
    if suffix == ".docx":
        parts = docx_paragraphs(data)
        return "\n\n".join(parts), len(parts) // PARAGRAPHS_A_PAGE or 1, len(parts)
    if suffix == ".pdf" and pdf_pages:
        pages = [p.strip() for p in first_pages(data, [pdf_pages] if callable(pdf_pages) else pdf_pages)]
        return "\n\n".join(p for p in pages if p), len(pages), sum(p.count("\n") + 1 for p in pages if p)
    raise ValueError(f"unsupported file: {path}")


def read_files(spark: SparkSession, path: str, pdf_pages: PageReader | Sequence[PageReader] | None = None, errors: bool = False) -> DataFrame:
    """(path, text, page_count, line_count) of all files under ``path``. ``pdf_pages`` reads the page texts of a PDF.

    Spark's scan leaves out files without any bytes, so those have no row. A file that cannot be read fails the job. With ``errors`` there is a fifth column, ``error``: null, or the reason why the
    row's file could not be read, while its text and counts are null and all other files are read.
    """

    def row(path: str, data: bytes) -> tuple:
        try:
            return (path, *parse(path, data, pdf_pages), None)
        except Exception as e:  # noqa: BLE001  damaged files raise whatever their format's reader raises
            if not errors:
                raise
            return path, None, None, None, f"{type(e).__name__}: {e}"

    names = ["path", "text", "page_count", "line_count", "error"][: 5 if errors else 4]

    def run(frames):
        for f in frames:
            rows = [row(p, bytes(c)) for p, c in zip(f.path, f.content, strict=True)]
            table = pd.DataFrame(rows, columns=["path", "text", "page_count", "line_count", "error"]).astype({"page_count": "Int32", "line_count": "Int32"})
            yield table[names]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string, page_count int, line_count int" + ", error string" * errors)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of the files that can be parsed; their content is not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def first_text(*candidates: Column) -> Column:
    """The first candidate that is not blank, as a chain of extractors gives them."""
    return F.coalesce(*[F.when(T.strip(c) != "", c) for c in candidates], F.lit(""))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc, text) of ``pages(doc, page, text)``, whatever order they were recognised in; blank pages go."""
    kept = pages.where(T.strip(F.col("text")) != "")
    return kept.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", T.strip(F.col("text")).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def replaced_regions(regions: DataFrame, reread: DataFrame, least: float = 0.5) -> DataFrame:
    """``regions(doc, n, text, confidence)`` where those under ``least`` take the line ``[n] text`` of a second reading ``(doc, answer)``."""
    lines = reread.select("doc", F.explode(F.regexp_extract_all("answer", F.lit(r"(?m)^(\[\d+\].*)$"), F.lit(1))).alias("line"))
    better = lines.select("doc", F.regexp_extract("line", r"^\[(\d+)\]", 1).cast("int").alias("n"), T.strip(F.regexp_replace("line", r"^\[\d+\]\s*", "")).alias("better"))
    return regions.join(better, ["doc", "n"], "left").withColumn("text", F.when((F.col("confidence") < least) & (F.col("better") != ""), F.col("better")).otherwise(F.col("text"))).drop("better")


def corpus_chunks(corpus: DataFrame, most: int = 2000) -> DataFrame:
    """Rows of an evaluation corpus ``(doc_id, title, text)`` as chunks: title and text, ``most`` characters; blank ones go."""
    whole = F.when(T.strip(F.coalesce("title", F.lit(""))) == "", F.col("text")).otherwise(F.concat_ws("\n\n", "title", "text"))
    return corpus.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.substring(whole, 1, most))


def custom_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(doc_id, text), queries(qid, text) and qrels(qid, doc_id, grade) of a JSON array of questions.

    A chunk's text in the corpus is the first question that names it.
    """
    schema = "question_id string, question string, relevant_chunks array<string>, relevant_concepts array<string>, expected_keywords array<string>, difficulty string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    qrels = rows.select(F.col("question_id").alias("qid"), F.explode("relevant_chunks").alias("doc_id"), "question").distinct()
    corpus = qrels.groupBy("doc_id").agg(F.min_by("question", "qid").alias("text"))
    return corpus, rows.select(F.col("question_id").alias("qid"), F.col("question").alias("text")), qrels.select("qid", "doc_id", F.lit(1).alias("grade"))


def question_file(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a .json array (strings, or objects with ``question``) or of a text file, without blank lines and those that begin with #."""
    if path.lower().endswith(".json"):
        values = F.from_json("value", "array<string>")  # objects come as their JSON text
        each = spark.read.text(path, wholetext=True).select(F.explode(values).alias("v"))
        return each.select(T.strip(F.coalesce(F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.question")), F.col("v"))).alias("question")).where("question <> ''")
    return spark.read.text(path).select(T.strip(F.col("value")).alias("question")).where("question <> '' and not startswith(question, '#')")


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON object per row."""
    rows.write.mode("overwrite").json(path)


def event_frames(replies: DataFrame, size: int = 8) -> DataFrame:
    """``replies(id, text)`` as server-sent events of ``size`` characters each: (id, n, frame)."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))
    return replies.select("id", F.posexplode(parts).alias("n", "part")).select("id", "n", F.concat(F.lit("data: "), F.to_json(F.struct(F.col("part").alias("content"))), F.lit("\n\n")).alias("frame"))


def evaluation_set(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(_id, title, text), queries(_id, text) and qrels(query-id, corpus-id, score) of a folder."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    return corpus, queries, qrels


def html_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles, comments and tags go, white space is one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))
