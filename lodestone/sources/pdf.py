"""Page text from word boxes (doc_id, page, page_height, top, bottom, x0, x1, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: lines that repeat on pages
BOILERPLATE = [r"^\s*(?i)Page\s+\d+\s+(?:of|/)\s+\d+\s*$", r"^\s*\d+\s*$", r"^(?i)©.*\d{4}.*", r"^(?i)Copyright\s+©.*", r"^(?i)All\s+rights\s+reserved", r"^(?i)Confidential"]
GAP, MARGIN = 3.0, 50.0


def lines(words: DataFrame) -> DataFrame:
    """Lines of words: a new one where the top, to a tenth, moves by the gap or more from the word before; words by x, joined by spaces.

    y is the top of a line's last word, to a tenth.
    """
    words = words.withColumn("y", F.round("top", 1))
    w = Window.partitionBy("doc_id", "page").orderBy("y", "x0", "text")
    new = F.when(F.round(F.abs(F.col("y") - F.lag("y").over(w)), 6) < GAP, 0).otherwise(1)
    numbered = words.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("x0", "text")))
    boxes = [F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("page_height").alias("page_height"), F.max("y").alias("y")]
    return numbered.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), *boxes)


def is_header_footer(text: Column, y: Column, height: Column) -> Column:
    hit = F.lit(False)
    for p in BOILERPLATE:
        hit = hit | F.trim(text).rlike(p)
    return ((y < MARGIN) | (y > height - MARGIN)) & hit


def is_heading(text: Column) -> Column:
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    numbered = text.rlike(r"^\d+[.\s]")
    title = (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= 10) & ~F.substring(text, 1, 5).rlike(r"\p{Ll}")
    return (F.length(text) < 100) & ~text.rlike(r"[.!?,;:]$") & (upper | numbered | title)


def heading_level(text: Column) -> Column:
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    return F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1).when(upper, 1).otherwise(2)


def fix_hyphens(text: Column) -> Column:
    soft = F.regexp_replace(text, r"(?U)(\w)\x{AD}\s*(\w)", "$1$2")
    return F.regexp_replace(soft, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def blocks(words: DataFrame) -> DataFrame:
    """Headings and paragraphs of pages in order: consecutive paragraph lines are joined by a space."""
    kept = lines(words).filter(~is_header_footer(F.col("text"), F.col("y"), F.col("page_height"))).withColumn("kind", F.when(is_heading(F.col("text")), "heading").otherwise("paragraph"))
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    new = F.when((F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph"), 0).otherwise(1)
    numbered = kept.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    out = numbered.groupBy("doc_id", "page", "block", "kind").agg(fix_hyphens(joined).alias("content"), F.min("y").alias("y"))
    return out.withColumn("level", F.when(F.col("kind") == "heading", heading_level(F.col("content"))))


def keep_image(width: Column, height: Column, page_area: Column) -> Column:
    return (width >= 20) & (height >= 20) & (width * height >= 0.001 * page_area) & (F.greatest(width, height) / F.least(width, height) <= 20)


def ocr_confidence(text: Column) -> Column:
    """Six tenths of the share of letters, digits and spaces, and four of whether words are 3 to 10 long on average."""
    fine = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")) / F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    mean = F.aggregate(words, F.lit(0), lambda a, x: a + F.length(x)) / F.size(words)
    return F.when(F.length(F.trim(text)) > 0, 0.6 * fine + 0.4 * F.when(mean.between(3, 10), 1.0).otherwise(0.5)).otherwise(0.0)
