"""File sources: PDF folders, layout blocks, landed uploads, cached extractor answers, settings."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, guess_title, iso_date, pdf_date, published_date, title_line
from ..functions.units import magnitude_from_header, page_unit_hint
from ..operators.ingest import keep_text_blocks, with_reading_order
from ..schemas import BLOCKS, UNITS
from ..session import strip_blanks


@dataclass(frozen=True)
class Settings:
    """What can be set of the pipeline; ``from_env`` reads CLAIMLOOM_<NAME>, the first value set counts."""

    root: str = "data/layer"
    cache: str = "data/cache"
    uploads: str = "data/uploads"
    extractor: str = "auto"
    extract_model: str = ""
    adjudicate_model: str = ""
    max_concurrency: int = 4
    max_units_per_doc: int = 14
    batch_chars: int = 16_000
    batch_pages: int = 10
    max_output_tokens: int = 32_000
    min_density: float = 0.12
    fy_end_month: int = 3
    fuzzy_ratio: float = 0.82
    max_block: int = 120

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        return cls(**{f.name: type(f.default)(env[k]) for f in fields(cls) if (k := f"CLAIMLOOM_{f.name.upper()}") in env})

    @classmethod
    def of_project(cls, start: str | None = None, env: dict[str, str] | None = None) -> Settings:
        """Settings of the nearest ``.env`` under those of ``env``; relative folders are those of the project that holds it."""
        env = dict(os.environ) if env is None else env
        found = project_env(start)
        if found is None:
            return cls.from_env(env)
        got = cls.from_env(read_env_file(found, env))
        home = os.path.dirname(found)
        return replace(got, **{n: p if os.path.isabs(p := getattr(got, n)) or "://" in p else os.path.join(home, p) for n in ("root", "cache", "uploads")})


def project_env(start: str | None = None, parents: int = 5) -> str | None:
    """The nearest ``.env`` file: of a folder, up to five above it, then of the folder that holds this package."""
    here = os.path.realpath(start or os.getcwd())
    searched = [here]
    for _ in range(parents):
        searched.append(os.path.dirname(searched[-1]))
    searched.append(os.path.dirname(os.path.dirname(os.path.dirname(os.path.realpath(__file__)))))
    return next((p for d in dict.fromkeys(searched) if os.path.isfile(p := os.path.join(d, ".env"))), None)


def read_env_file(path: str, env: dict[str, str]) -> dict[str, str]:
    """Settings of a ``KEY=value`` file under those already set."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and key and not key.startswith("#"):
                    found.setdefault(key.strip(), value.strip().strip("\"'"))
    return found | env


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder (not below it), by path: ``path, content, sha256, id``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    digest = F.sha2("content", 256)
    return files.select("path", "content", digest.alias("sha256"), F.concat(F.lit("d_"), F.substring(digest, 1, 12)).alias("id"))


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Layout blocks of PDF files with the size of their largest letters, where a PDF library can be imported; otherwise an
    error says so. Blocks of other tools can be read with the same columns and go through the same operators."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("no PDF library here: supply a block table with the columns of schemas.BLOCKS") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            rows = []
            for doc_id, content in zip(b["id"], b["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc, 1):
                        sizes = {x["number"]: max((s["size"] for line in x.get("lines", ()) for s in line["spans"]), default=None) for x in page.get_text("dict")["blocks"]}
                        rows += [(doc_id, n, x[5], x[6], *x[:4], page.rect.width, x[4], sizes.get(x[5])) for x in page.get_text("blocks")]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "block_no", "block_type", "x0", "y0", "x1", "y1", "page_width", "text", "size"])

    return files.mapInPandas(run, BLOCKS.replace("text string", "page_width double, text string"))


def largest_lines(blocks: DataFrame) -> DataFrame:
    """``doc_id, largest``: the line set largest on each of the first four pages, in page order, that could be a title."""
    lines = blocks.where("page <= 4 and size is not null").select("doc_id", "page", "block_no", "size", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", title_line(F.col("t"))).where("t is not null")
    first = lines.groupBy("doc_id", "page").agg(F.min_by("t", F.struct(-F.col("size"), "block_no", "line")).alias("t"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]).alias("largest"))


def pages_of(blocks: DataFrame) -> DataFrame:
    """Page texts in reading order with their scale and unit hints, from layout blocks."""
    ordered = with_reading_order(keep_text_blocks(blocks.withColumn("text", clean_text(F.col("text")))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_idx", F.trim("text").alias("t")))), lambda b: b["t"]), "\n")
    pages = ordered.groupBy("doc_id", "page").agg(text.alias("text"))
    return pages.withColumns({"magnitude_hint": magnitude_from_header(F.col("text")), "unit_hint": page_unit_hint(F.col("text"))})


def document_rows(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Title and date of each document from its first pages and the metadata table (doc_id, title, filename, created and
    ``largest``, the largest line of each of the first four pages)."""
    first = pages.where("page <= 3").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("head"))
    joined = meta.join(first, "doc_id", "left")
    return joined.select("doc_id", guess_title(F.col("title"), F.col("largest"), F.col("head"), F.col("filename")).alias("title"), published_date(F.col("head"), pdf_date(F.col("created"))).alias("published"))


#: What an extractor is asked about a document, and how much of its opening it sees.
METADATA = "struct<title:string,publisher:string,published:string,principal_entity:string>"
OPENING_PAGES, OPENING_CHARS = 3, 9_000


def openings(pages: DataFrame) -> DataFrame:
    """``doc_id, opening``: the first three pages of each document, 9,000 characters at most."""
    first = pages.where(F.col("page") <= OPENING_PAGES).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return first.select("doc_id", F.substring(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), 1, OPENING_CHARS).alias("opening"))


def document_metadata(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_id, title, publisher, published, principal_entity`` of every document from an extractor's answers (doc_id,
    payload). No answer, a failed one and one of another shape leave all fields null; partial dates count as their first
    day."""
    body = F.when(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{"), F.from_json("payload", METADATA))
    one = answers.select("doc_id", body.alias("m")).where("m is not null").groupBy("doc_id").agg(F.max("m").alias("m"))
    text = lambda c: F.nullif(strip_blanks(F.col(f"m.{c}")), F.lit("")).alias(c)
    return documents.select("doc_id").join(one, "doc_id", "left").select("doc_id", text("title"), text("publisher"), iso_date(F.col("m.published"), partial=True).alias("published"), text("principal_entity"))


UPLOADED = (".pdf", ".json")


def land(path: str, content: bytes, folder: str) -> str:
    """Save an upload under a name of its own in the landing folder, whole or not at all; other kinds of files are refused."""
    name = os.path.basename(path)
    if not name.lower().endswith(UPLOADED):
        raise ValueError("only PDF files and landed answers are taken")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"{uuid.uuid4().hex[:8]}-{name}")
    with open(f"{target}.part", "wb") as f:
        f.write(content)
    os.replace(f"{target}.part", target)
    return target


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of PDF files landed in a folder: path, content, sha256, id."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", 64).load(folder)
    digest = F.sha2("content", 256)
    return files.select("path", "content", digest.alias("sha256"), F.concat(F.lit("d_"), F.substring(digest, 1, 12)).alias("id"))


def landed_units(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of extractor answers landed as JSON lines with the columns of ``schemas.UNITS``."""
    return spark.readStream.schema(UNITS).option("maxFilesPerTrigger", 64).json(folder)


#: An extractor turns units (doc_id, batch, pages, prompt) into answers (doc_id, batch, pages, payload).
Extractor = Callable[[DataFrame], DataFrame]


def cached_answers(units: DataFrame, cache: DataFrame, model: str, extract: Extractor) -> tuple[DataFrame, DataFrame]:
    """Answers for all units and the rows new to the cache: only units without a cached answer reach the extractor.

    The cache key is a SHA-256 of the model's name and the prompt.
    """
    keyed = units.withColumn("key", F.sha2(F.concat_ws("\x00", F.lit(model), "prompt"), 256))
    known = keyed.join(cache.select("key", "payload"), "key")
    fresh = extract(keyed.join(cache.select("key"), "key", "left_anti")).join(keyed.select("doc_id", "batch", "key"), ["doc_id", "batch"])
    cols = ["doc_id", "batch", "pages", "payload", "key"]
    return known.select(*cols).unionByName(fresh.select(*cols)), fresh.select("key", "payload").dropDuplicates(["key"])


def no_extractor(units: DataFrame) -> DataFrame:
    """The extractor used where none is configured: no answers."""
    return units.select("doc_id", "batch", "pages", F.lit(None).cast("string").alias("payload")).where("false")


class Pace:
    """A least interval between calls of one worker; 0 calls a minute sets none."""

    def __init__(self, per_minute: float):
        self.interval, self.next_at = 60.0 / per_minute if per_minute > 0 else 0.0, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if self.next_at > now:
            time.sleep(self.next_at - now)
        self.next_at = max(now, self.next_at) + self.interval


def calling(complete: Callable[[str], str], retries: int = 2, pause: float = 1.5, per_minute: float = 0.0, workers: int = 4) -> Extractor:
    """An extractor that calls ``complete(prompt)`` for each unit, at most ``workers`` at a time.

    A failed call is tried again ``retries`` times after 1.5, 3, ... seconds with a little spread. One that fails for
    good is a row with a null payload and its ``error``: other units go on. Each worker keeps to its share of
    ``per_minute``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_minute / workers)
        for b in batches:
            payloads, errors = [], []
            for prompt in b["prompt"]:
                payload = error = None
                for attempt in range(retries + 1):
                    try:
                        pace.wait()
                        payload, error = complete(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a backend raises is a failed call
                        error = f"{type(e).__name__}: {e}"[:400]
                        if attempt < retries:
                            time.sleep(pause * 2**attempt + os.getpid() % 7 * pause / 30)
                payloads.append(payload)
                errors.append(error)
            yield pd.DataFrame({"doc_id": b["doc_id"], "batch": b["batch"], "pages": b["pages"], "payload": payloads, "error": errors})

    def extract(units: DataFrame) -> DataFrame:
        kind = units.schema["doc_id"].dataType.simpleString()
        return units.select("doc_id", F.col("batch").cast("int").alias("batch"), F.col("pages").cast("array<int>").alias("pages"), "prompt").repartition(workers).mapInPandas(run, f"doc_id {kind}, batch int, pages array<int>, payload string, error string")

    return extract


def chosen(backends: list[tuple[str, Callable[[], bool], Extractor]], name: str = "auto") -> Extractor:
    """The named backend, or for "auto" the first that is available; without any, no answers."""
    for known, available, extract in backends:
        if name == known or name == "auto" and available():
            return extract
    if name in ("auto", "none"):
        return no_extractor
    raise ValueError(f"no extractor named {name}")
