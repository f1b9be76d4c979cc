"""File sources: discovery, text, CSV, code, HTML and DOCX loaders that return flat nodes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions import text as T

#: fixed values: extensions that a folder walk takes
EXTENSIONS = ["pdf", "docx", "html", "htm", "txt", "md", "csv", "py", "js", "java", "json"]
#: formats that a walk finds and no loader here reads
UNREAD = ["pdf"]
NODES = "doc_id string, node_ord int, node_type string, heading string, level int, content string"
CODE = r"(?m)^(?=(?:def|class)\s+\w+)"


def discover(spark: SparkSession, folders: list[str], pattern: str = "*") -> DataFrame:
    """(path, content, mtime, size) of files below the folders; each path once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folders)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.select("path", ext.alias("extension"), "content", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))
    return named.filter(F.col("extension").isin(EXTENSIONS)).dropDuplicates(["path"])


def with_fingerprints(files: DataFrame) -> DataFrame:
    return files.select("*", T.fingerprint("content").alias("_f")).select("*", "_f.content_hash", "_f.file_hash").drop("_f")


@F.pandas_udf(StringType())
def decode_lossy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def _node(rows: DataFrame, kind: str, content, heading=None, ord_=None) -> DataFrame:
    return rows.select(F.col("path").alias("doc_id"), (F.lit(0) if ord_ is None else ord_).cast("int").alias("node_ord"), F.lit(kind).alias("node_type"), (F.lit(None) if heading is None else heading).cast("string").alias("heading"), F.lit(1).alias("level"), content.alias("content"))


def load_text(files: DataFrame) -> DataFrame:
    """One section with the whole file."""
    return _node(files, "section", decode_lossy("content"))


def load_code(files: DataFrame) -> DataFrame:
    """Top-level definitions and what stands before them; a file without any is one node."""
    text = files.withColumn("_text", decode_lossy("content"))
    parts = F.filter(F.split("_text", CODE), lambda x: F.trim(x) != "")
    split = text.filter(F.col("_text").rlike(CODE)).select("*", F.posexplode(parts).alias("_i", "_part"))
    name = F.regexp_extract("_part", r"^(?:def|class)\s+(\w+)", 1)
    found = _node(split, "block", F.col("_part"), F.nullif(name, F.lit("")), F.col("_i")).withColumn("node_type", F.when(F.col("content").startswith("class "), "class").when(F.col("content").startswith("def "), "function").otherwise("block"))
    return found.unionByName(_node(text.filter(~F.col("_text").rlike(CODE)), "file", F.col("_text")))


def sniff_delimiter(sample: str) -> str:
    """The delimiter of a sample of 8 192 characters; a comma if it can't be told."""
    import csv

    try:
        return csv.Sniffer().sniff(sample[:8192], ",;\t|").delimiter
    except csv.Error:
        return ","


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _csv_rows(content: pd.Series) -> pd.Series:
    import csv
    import io

    csv.field_size_limit(2**31 - 1)

    def rows(b):
        text = bytes(b or b"").decode("utf-8", "ignore")
        return [[str(c) for c in r] for r in csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text))]

    return content.map(rows)


def load_csv(files: DataFrame, every: int = 50) -> DataFrame:
    """Groups of rows as tables with a caption; all cells are strings; an empty file gives none."""
    rows = files.withColumn("_rows", _csv_rows("content")).filter(F.size("_rows") > 1).withColumn("_head", F.col("_rows")[0])
    groups = F.sequence(F.lit(0), F.floor((F.size("_rows") - 2) / every).cast("int"))
    each = rows.select("*", F.explode(groups).alias("_g")).withColumn("_body", F.slice("_rows", F.col("_g") * every + 2, F.lit(every)))
    caption = F.concat(F.lit("Rows "), F.col("_g") * every + 1, F.lit("-"), F.col("_g") * every + F.size("_body"))
    lines = F.array_join(F.transform("_body", lambda r: F.array_join(r, " | ")), "\n")
    content = F.concat(F.lit("[TABLE: "), caption, F.lit("]\n"), F.array_join("_head", " | "), F.lit("\n"), F.expr("repeat('-', aggregate(_head, 0, (a, x) -> a + length(x)) + 3 * size(_head))"), F.lit("\n"), lines)
    return _node(each, "table", content, caption, F.col("_g"))


class _Text(HTMLParser):
    """Text of a page without some elements; blocks end lines."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
    BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "main", "blockquote", "pre"}

    def __init__(self, drop: set[str], want=None):
        super().__init__(convert_charrefs=True)
        self.drop, self.want = drop, want
        self.stack: list[tuple[str, bool]] = []
        self.hidden = self.inside = 0
        self.parts: list[list[str]] = []
        self.open: list[tuple[int, int]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self._add("\n")
        if tag in self.VOID:
            return
        self.stack.append((tag, False))
        if tag in self.drop:
            self.hidden += 1
        if self.want is not None and self.want(tag, dict(attrs)):
            self.open.append((len(self.stack), len(self.parts)))
            self.parts.append([])

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            own, _ = self.stack[-1]
            if self.open and self.open[-1][0] == len(self.stack):
                self.open.pop()
            self.stack.pop()
            if own in self.drop:
                self.hidden -= 1
            if own == tag:
                break
        if tag in self.BLOCK:
            self._add("\n")

    def _add(self, data):
        if self.hidden:
            return
        for _, i in self.open:
            self.parts[i].append(data)
        if self.want is None:
            if not self.parts:
                self.parts.append([])
            self.parts[0].append(data)

    def handle_data(self, data):
        self._add(data)


def html_text(html: str | None, drop: set[str] = frozenset(("script", "style")), want=None) -> list[str]:
    """Texts of the wanted elements, or of the whole page, without the dropped ones."""
    reader = _Text(set(drop), want)
    reader.feed(html or "")
    reader.close()
    return ["".join(p) for p in reader.parts]


#: fixed values: elements that are no content, and the order in which content is looked for
CHROME = {"script", "style", "nav", "footer", "aside", "header"}
SELECTORS = ["main", "article", "[role=main]", ".content", ".post-content", ".entry-content", ".article-body", ".story-body", ".main-content"]
CONTENT_WORDS = ("content", "post", "article", "entry")


def _selects(selector: str):
    if selector.startswith("."):
        return lambda tag, a: selector[1:] in (a.get("class") or "").split()
    if selector.startswith("["):
        return lambda tag, a: a.get("role") == "main"
    return lambda tag, a: tag == selector


_WANTED = [_selects(s) for s in [*SELECTORS, "body"]]


def heuristic_extract(html: str | None) -> str:
    """The first selected element of over 200 words, else the body; all are gathered in one pass."""
    firsts: dict[int, int] = {}
    seen = 0

    def want(tag, attrs):
        nonlocal seen
        hits = [k for k, wanted in enumerate(_WANTED) if k not in firsts and wanted(tag, attrs)]
        firsts.update((k, seen) for k in hits)
        seen += bool(hits)
        return bool(hits)

    found = html_text(html, CHROME, want)
    for k in range(len(SELECTORS)):
        if k in firsts and len(found[firsts[k]].split()) > 200:
            return found[firsts[k]]
    return found[firsts[len(SELECTORS)]] if len(SELECTORS) in firsts else ""


def readability_extract(html: str | None) -> str:
    """The longest text of an article, main or div whose class sounds like content."""
    found = html_text(html, {"script", "style"}, lambda tag, a: tag in ("article", "main", "div") and any(w in (a.get("class") or "").lower() for w in CONTENT_WORDS))
    return max(found, key=len, default="")


def largest_paragraph(html: str | None) -> str:
    whole = html_text(html, frozenset())
    return max(re.split(r"\n\s*\n", whole[0] if whole else ""), key=len)[:3000]


@F.pandas_udf(ArrayType(StructType().add("method", StringType()).add("content", StringType())))
def extract_candidates(html: pd.Series) -> pd.Series:
    """What each method finds on a page, with over 100 characters; hooks for other extractors belong here."""
    def one(h):
        found = [{"method": m, "content": c} for m, c in (("readability", readability_extract(h)), ("heuristic", heuristic_extract(h))) if len(c.strip()) > 100]
        return found or [{"method": "fallback", "content": largest_paragraph(h)}]

    return html.map(one)


HEADING = r"^(?=.{1,99}$)(?!.*[.!?,;:]$)(?:(?=.*\p{Lu})[^\p{Ll}]+|\d+\..*|#.*)$"


def split_headings(texts: DataFrame, text: str = "content") -> DataFrame:
    """Sections of a text by heading lines: (all columns, node_ord, heading, content)."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    start = F.array(F.struct(F.lit("").alias("heading"), F.array().cast("array<string>").alias("lines")))

    def step(acc, line):
        last = F.element_at(acc, -1)
        more = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["heading"].alias("heading"), F.concat(last["lines"], F.array(line)).alias("lines"))))
        return F.when(line.rlike(HEADING), F.concat(acc, F.array(F.struct(line.alias("heading"), F.array().cast("array<string>").alias("lines"))))).otherwise(more)

    folded = F.filter(F.aggregate(lines, start, step), lambda s: (F.size(s["lines"]) > 0) | (s["heading"] != ""))
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(folded).alias("node_ord", "_s")).select(*keep, "node_ord", F.nullif(F.col("_s.heading"), F.lit("")).alias("heading"), F.array_join("_s.lines", "\n").alias("content"))


def load_html(files: DataFrame) -> DataFrame:
    best = F.udf(heuristic_extract, "string", useArrow=True)
    pages = files.select("path", best(decode_lossy("content")).alias("content"))
    parts = split_headings(pages)
    return parts.select(F.col("path").alias("doc_id"), "node_ord", F.lit("section").alias("node_type"), "heading", F.lit(1).alias("level"), "content")


@F.pandas_udf(ArrayType(StructType().add("node_type", StringType()).add("heading", StringType()).add("level", IntegerType()).add("content", StringType())))
def _docx_nodes(content: pd.Series) -> pd.Series:
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(b):
        try:
            return nodes(b)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError) as e:
            return [{"node_type": "error", "heading": None, "level": 1, "content": f"{type(e).__name__}: {e}"}]

    def nodes(b):
        with zipfile.ZipFile(io.BytesIO(bytes(b))) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        out, tables = [], []
        for el in body:
            if el.tag == f"{w}p":
                text = "".join(t.text or "" for t in el.iter(f"{w}t")).strip()
                style = next((s.get(f"{w}val", "") for s in el.iter(f"{w}pStyle")), "")
                if not text:
                    continue
                if m := re.match(r"Heading\s*(\d+)", style):
                    out.append({"node_type": "section", "heading": text, "level": int(m[1]), "content": ""})
                else:
                    out.append({"node_type": "paragraph", "heading": None, "level": 9, "content": "• " + text if style.startswith("List") else text})
            elif el.tag == f"{w}tbl":
                rows = [["".join(t.text or "" for t in c.iter(f"{w}t")) for c in r.iter(f"{w}tc")] for r in el.iter(f"{w}tr")]
                if rows:
                    tables.append({"node_type": "table", "heading": None, "level": 1, "content": "\n".join([" | ".join(rows[0]), "-" * (sum(map(len, rows[0])) + 3 * len(rows[0])), *(" | ".join(r) for r in rows[1:])])})
        return out + tables

    return content.map(one)


def load_docx(files: DataFrame) -> DataFrame:
    """Paragraphs, headings and, after them, tables; a list item begins with a bullet; a file that can't be read is one node of type error."""
    nodes = files.select(F.col("path").alias("doc_id"), F.posexplode(_docx_nodes("content")).alias("node_ord", "_n"))
    return nodes.select("doc_id", "node_ord", "_n.node_type", "_n.heading", "_n.level", "_n.content")


def load_files(files: DataFrame) -> DataFrame:
    """Nodes of all files, by extension; other formats are read as text. PDFs come as word tables (sources.pdf)."""
    ext = F.col("extension")
    rest = files.filter(~ext.isin("csv", "html", "htm", "docx", "pdf", "py", "js", "java"))
    out = load_text(rest).unionByName(load_csv(files.filter(ext == "csv"))).unionByName(load_code(files.filter(ext.isin("py", "js", "java"))))
    return out.unionByName(load_html(files.filter(ext.isin("html", "htm")))).unionByName(load_docx(files.filter(ext == "docx")))
