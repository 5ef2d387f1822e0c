"""Readers (R1-R8): documents to chunks ``(id, name, content, type, ...)``."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import hash_id
from graphloom.operators.graph import Graph, as_edges, as_nodes, properties_of

SECTION_SCHEMA = "doc_id string, ordinal int, kind string, level int, title string, path string, content string, before_text string, after_text string"
#: Characters of texts whose sections a task holds at a time.
HELD_CHARS = 1 << 18


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file one chunk named by its stem."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select(hash_id(F.col("path")).alias("id"), stem.alias("name"), F.col("value").alias("content"), F.lit("TEXT").alias("type"))


def literal_texts(rows: DataFrame, text: str = "content") -> DataFrame:
    """R1 on text itself."""
    return rows.select(hash_id(F.col(text)).alias("id"), F.lit("direct_content").alias("name"), F.col(text).alias("content"), F.lit("TEXT").alias("type"))


def renamed(rows: DataFrame, i: str = "id", name: str = "name", content: str = "content") -> DataFrame:
    """R2: columns renamed, all others in the map ``kwargs``."""
    extra = [c for c in rows.columns if c not in (i, name, content)]
    return rows.select(F.col(i).cast("string").alias("id"), F.col(name).cast("string").alias("name"), F.col(content).cast("string").alias("content"), properties_of(*extra).alias("kwargs") if extra else F.create_map().cast("map<string,string>").alias("kwargs"))


def normal_markdown(text: str) -> str:
    """Headings unindented with a blank line before; a title from the first line if there is no heading."""
    text = re.sub(r"(?m)^[ \t]+(#{1,6} )", r"\1", text or "")
    text = re.sub(r"([^\n])\n(#{1,6} )", r"\1\n\n\2", text)
    if text.strip() and not re.search(r"(?m)^#{1,6} ", text):
        head, _, rest = text.strip().partition("\n")
        text = f"# {head.strip()}\n\n{rest}"
    return text


def markdown_parts(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of headings, tables and runs of other lines, in order; fenced code is never a heading."""
    out: list[tuple[str, int, str]] = []
    run: list[str] = []
    table: list[str] = []
    fenced = False

    def close():
        if table:
            kind = "table" if len(table) > 1 and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", table[1]) else "text"
            out.append((kind, 0, "\n".join(table)))
            table.clear()
        if run and "\n".join(run).strip():
            out.append(("text", 0, "\n".join(run).strip()))
        run.clear()

    for line in normal_markdown(text).split("\n"):
        fenced ^= line.lstrip().startswith("```")
        heading = None if fenced else re.match(r"(#{1,6})\s+(.*)", line)
        if heading:
            close()
            out.append(("title", len(heading[1]), heading[2].strip()))
        elif "|" in line and not fenced:
            if run:
                close()
            table.append(line)
        else:
            if table:
                close()
            run.append(line)
    close()
    return out


class _Parts(HTMLParser):
    """Headings, tables and text blocks of a page; scripts, styles and navigation are left out."""

    SKIP = {"script", "style", "nav", "noscript", "template"}
    BLOCK = {"p", "div", "article", "section", "li", "ul", "ol", "br", "header", "footer", "main", "body", "title", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.text: list[str] = []
        self.skip, self.level, self.rows = 0, 0, None

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text and self.rows is None:
            self.out.append(("title", self.level, text) if self.level else ("text", 0, text))
        self.text = [] if self.rows is None else self.text

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.text = []
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag in self.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.text)).strip())
            self.text = []
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.text = [r for r in self.rows if r], None, []
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.out.append(("table", 0, "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])))
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = 0
        elif tag in self.BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_parts(html: str) -> list[tuple[str, int, str]]:
    parser = _Parts()
    parser.feed(html or "")
    parser.close()
    parser.level = 0
    parser.flush()
    return parser.out


def fold_parts(parts: list[tuple[str, int, str]], depth: int = 3) -> list[dict]:
    """R3, R3d: sections cut at headings up to ``depth``; deeper headings stay as text; tables apart.

    A table keeps the text before and after it in its section.
    """
    rows: list[dict] = []
    stack: list[tuple[int, str]] = []
    section: dict | None = None

    def open_section(level: int, title: str) -> dict:
        path = " / ".join(t for _, t in stack)
        rows.append({"kind": "section", "level": level, "title": title, "path": path, "content": [], "before_text": None, "after_text": None})
        return rows[-1]

    tables = 0
    waiting: list[dict] = []
    for kind, level, text in parts:
        if kind == "title" and level <= depth:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
            section, waiting, tables = open_section(level, text), [], 0
            continue
        if section is None:
            section = open_section(0, "")
        if kind == "table":
            tables += 1
            before = section["content"][-1] if section["content"] else None
            row = {"kind": "table", "level": section["level"], "title": f"{section['title']} / Table {tables}", "path": section["path"], "content": [text], "before_text": before, "after_text": None}
            rows.append(row)
            waiting.append(row)
        else:
            for row in waiting:
                row["after_text"] = text
            waiting = []
            section["content"].append(f"{'#' * level} {text}" if kind == "title" else text)
    for i, row in enumerate(rows):
        row["content"] = "\n".join(row["content"])
        row["ordinal"] = i
    return rows


def sections(docs: DataFrame, i: str, text: str, form: str = "markdown", depth: int = 3) -> DataFrame:
    """One row per section or table of each document; a task holds those of about ``HELD_CHARS`` of text."""
    parse = {"markdown": markdown_parts, "html": html_parts}[form]
    columns = [c.split()[0] for c in SECTION_SCHEMA.split(", ")]
    types = [pa.int32() if c in ("ordinal", "level") else pa.string() for c in columns]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, types, strict=True)], columns)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                content = t.as_py()
                rows += [{"doc_id": d.as_py(), **row} for row in fold_parts(parse(content), depth)]
                held += len(content or "")
                if held >= HELD_CHARS:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return docs.select(F.col(i).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SECTION_SCHEMA)


def section_chunks(found: DataFrame) -> DataFrame:
    """Chunks of sections and tables; ids hash the document and the place."""
    return found.select(
        hash_id(F.concat_ws("#", "doc_id", "path", "ordinal")).alias("id"), F.col("path").alias("name"), "content",
        F.when(F.col("kind") == "table", "TABLE").otherwise("TEXT").alias("type"), "doc_id", "level", "title", "before_text", "after_text",
    )


def document_graph(found: DataFrame) -> Graph:
    """Title, Chunk and Table nodes with edges both ways."""
    key = hash_id(F.concat_ws("#", "doc_id", "path"))
    parent = hash_id(F.concat_ws("#", "doc_id", F.array_join(F.slice(F.split("path", " / "), F.lit(1), F.size(F.split("path", " / ")) - 1), " / ")))
    sect, tab = found.where("kind = 'section'"), found.where("kind = 'table'")
    body = hash_id(F.concat_ws("#", "doc_id", "path", "ordinal"))
    filled = sect.where("content <> ''")
    nested = sect.where(F.size(F.split("path", " / ")) > 1)
    nodes = (
        as_nodes(sect, key, "Title", F.col("title")).dropDuplicates(["id"])
        .unionByName(as_nodes(filled, body, "Chunk", F.col("path"), properties_of("content")))
        .unionByName(as_nodes(tab, body, "Table", F.col("title"), properties_of("content", beforeText=F.col("before_text"), afterText=F.col("after_text"))))
    )
    edges = None
    for rows, a, at, there, back, b, bt in (
        (nested, parent, "Title", "hasChild", "hasParent", key, "Title"),
        (filled, key, "Title", "hasContent", "belongsToTitle", body, "Chunk"),
        (tab, key, "Title", "hasTable", "belongsToTitle", body, "Table"),
    ):
        pair = as_edges(rows, a, at, there, b, bt).unionByName(as_edges(rows, b, bt, back, a, at))
        edges = pair if edges is None else edges.unionByName(pair)
    return Graph(nodes, edges)


def cleaned_pages(pages: DataFrame, watermark: str | None = None, removed: tuple[str, ...] = ()) -> DataFrame:
    """Pages (stem, page, content) as chunks ``stem#page`` without first and last line and marked strings."""
    lines = F.split("content", "\n")
    text = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    for gone in (watermark, *removed):
        if gone:
            text = F.replace(text, F.lit(gone), F.lit(""))
    name = F.concat_ws("#", "stem", F.col("page").cast("string"))
    return pages.select(hash_id(name).alias("id"), name.alias("name"), text.alias("content"), F.lit("TEXT").alias("type"))


def by_suffix(found: DataFrame, readers: dict[str, object]) -> DataFrame:
    """``files`` rows dispatched on their suffix; an unknown suffix is an error."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.array(*[F.lit(x) for x in readers])
    checked = found.withColumn("suffix", F.when(F.array_contains(known, suffix), suffix).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.col("path")))))
    out = None
    for name, reader in readers.items():
        part = reader(checked.where(F.col("suffix") == name).drop("suffix"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pdf_pages(found: DataFrame) -> DataFrame:
    """(stem, page, content) of PDF files; needs the optional package pypdf on executors."""

    def run(batches):
        import io

        from pypdf import PdfReader

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
                rows += [(stem, i, page.extract_text() or "") for i, page in enumerate(PdfReader(io.BytesIO(content)).pages)]
            yield pd.DataFrame(rows, columns=["stem", "page", "content"])

    return found.mapInPandas(run, "stem string, page int, content string")


def docx_sections(found: DataFrame, depth: int = 3) -> DataFrame:
    """Sections of DOCX files by heading style, then outline level, then bold numbering; needs python-docx."""
    columns = [c.split()[0] for c in SECTION_SCHEMA.split(", ")]

    def level_of(p) -> int:
        style = re.match(r"heading (\d)", (p.style.name or "").lower())
        if style:
            return int(style[1])
        outline = p._p.find(".//{*}outlineLvl")
        if outline is not None:
            return int(next(iter(outline.attrib.values()))) + 1
        numbered = re.match(r"(\d+(?:\.\d+)*)\s", p.text)
        return numbered[1].count(".") + 1 if numbered and p.runs and all(r.bold for r in p.runs) else 0

    def run(batches):
        import io

        from docx import Document

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                parts = [("title", n, p.text) if (n := level_of(p)) else ("text", 0, p.text) for p in Document(io.BytesIO(content)).paragraphs if p.text.strip()]
                rows += [{"doc_id": path, **row} for row in fold_parts(parts, depth)]
            yield pd.DataFrame(rows, columns=columns)

    return found.mapInPandas(run, SECTION_SCHEMA)
