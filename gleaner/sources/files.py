"""Documents from folders."""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from importlib.util import find_spec
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.chunking import clean

TEXT, DOCUMENTS = (".txt", ".md", ".markdown", ".log"), (".pdf", ".pptx")
SUPPORTED = TEXT + DOCUMENTS
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
SPANS = "source_path string, source_name string, file_type string, page_number int, text string, error string"


def scan(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """(source_path, source_name, file_type, content) of every file,
    of any kind; filter file_type by SUPPORTED or IMAGES."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("source_path"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source_name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("file_type"), "content")


#: Readers of further kinds of files, such as an external parser or a vision model: bytes to the text of each page.
Parsers = Mapping[str, Callable[[bytes], list[str]]]


def existing(spark: SparkSession, paths: Iterable[str]) -> tuple[list[str], list[str]]:
    """The paths that are folders or files, and those that aren't."""
    found: tuple[list[str], list[str]] = ([], [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found[not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)].append(path)
    return found


def without_noise(pages: list[str]) -> list[str]:
    """C9 for the pages of one file (sections.without_page_noise in a row)."""
    if len(pages) < 3:
        return pages
    split = [[line for line in map(str.strip, page.split("\n")) if line] for page in pages]
    enough = max(2, len(pages) * 6 // 10)
    noise = [{line for line, n in Counter(own[at] for own in split if own).items() if n >= enough and len(line) <= 120} for at in (0, -1)]
    out = []
    for own in split:
        top, bottom = bool(own) and own[0] in noise[0], bool(own) and own[-1] in noise[1]
        rest = own[1:] if top else own
        out.append(clean("\n".join(rest[:-1] if bottom and rest else rest)))
    return out


def pages_of(kind: str, data: bytes, parsers: Parsers = MappingProxyType({})) -> list[str]:
    """The cleaned text of each page; raises for what can't be read."""
    if kind in parsers:
        return [clean(page) for page in parsers[kind](data)]
    if kind in TEXT:
        return [clean(data.decode("utf-8", "ignore"))]
    if kind == ".pdf":
        from pypdf import PdfReader

        return without_noise([clean(p.extract_text() or "") for p in PdfReader(io.BytesIO(data)).pages])
    if kind == ".pptx":
        from pptx import Presentation

        slides = Presentation(io.BytesIO(data)).slides
        return [clean("\n".join(filter(None, (clean(str(getattr(shape, "text", "") or "")) for shape in slide.shapes)))) for slide in slides]
    raise ValueError(f"unsupported file type: {kind}")


def spans(files: DataFrame, parsers: Parsers = MappingProxyType({})) -> DataFrame:
    """A row for each page with text. parsers: readers of
    other file types, or in place of the own ones. A file that can't be read gives
    one row with its error; one without text gives one row with neither."""

    readers = dict(parsers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                head = (row["source_path"], row["source_name"], row["file_type"])
                try:
                    found = [(*head, i, t, None) for i, t in enumerate(pages_of(row["file_type"], row["content"] or b"", readers), 1) if t] or [(*head, 1, "", None)]
                except Exception as error:  # one bad file must not end the batch
                    found = [(*head, 1, "", f"{row['source_name']}: {error}")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [f.split()[0] for f in SPANS.split(", ")])

    return files.select("source_path", "source_name", "file_type", "content").mapInArrow(run, SPANS)


def pdf_images(files: DataFrame, most: int = 12) -> DataFrame:
    """(source_path, name, page_number, image_index, content), up to `most`
    images of each file. Needs pypdf on the executors."""
    if find_spec("pypdf") is None:
        raise RuntimeError("pypdf is required for images of PDF files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pypdf import PdfReader

        for batch in batches:
            for row in batch.to_pylist():
                taken = 0
                for number, page in enumerate(PdfReader(io.BytesIO(row["content"])).pages, 1):
                    for index, image in enumerate(page.images, 1):
                        if taken >= most:
                            break
                        taken += 1
                        stem, _, ending = image.name.rpartition(".")
                        name = f"{row['source_name'].rsplit('.', 1)[0]}_p{number}_img{index}.{ending.lower() if stem and f'.{ending.lower()}' in IMAGES else 'png'}"
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((row["source_path"], pa.string()), (name, pa.string()), (number, pa.int32()), (index, pa.int32()), (image.data, pa.binary()))], ["source_path", "name", "page_number", "image_index", "content"])

    return files.filter(F.col("file_type") == ".pdf").mapInArrow(run, "source_path string, name string, page_number int, image_index int, content binary")
