"""Web pages: extraction, scoring, structuring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from ..sources.files import extract_candidates


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page columns but html, main_content, method, confidence_score, content_word_count, extraction_status).

    The best candidate by confidence times words, the first of equals; a page where only the
    fallback finds text has confidence 0.3, one without any has failed.
    """
    keep = [c for c in pages.columns if c != "html"]
    found = pages.select(*keep, extract_candidates("html").alias("_c"))
    confident = F.transform("_c", lambda c, i: F.struct(T.extraction_confidence(c["content"], c["method"]).alias("confidence"), (-i).alias("first"), c["method"].alias("method"), c["content"].alias("content")))
    scored = F.transform(confident, lambda s: F.struct((s["confidence"] * F.size(T.words(s["content"]))).alias("rank"), s["first"].alias("first"), s["confidence"].alias("confidence"), s["method"].alias("method"), s["content"].alias("content")))
    best = found.select(*keep, F.array_max(scored).alias("_b"))
    out = best.select(*keep, F.col("_b.content").alias("main_content"), F.col("_b.method").alias("method"), F.when(F.col("_b.method") == "fallback", 0.3).otherwise(F.col("_b.confidence")).alias("confidence_score"))
    out = out.withColumn("content_word_count", F.size(T.words("main_content")))
    return out.withColumn("extraction_status", F.when(F.col("content_word_count") > 0, "success").otherwise("failed"))


def structure(records: DataFrame) -> DataFrame:
    """Structured records: cleaned text, paragraphs, sections, sentences, keywords, readability, signals and quality."""
    out = T.with_nfkc(records, "main_content", "_plain", unescape=True).withColumn("cleaned_content", T.advanced_clean("_plain")).drop("_plain")
    out = out.withColumn("quality_signals", T.quality_signals("cleaned_content")).withColumn("paragraphs", T.paragraphs("cleaned_content"))
    out = out.withColumn("first_paragraph", F.coalesce(F.try_element_at("paragraphs", F.lit(1)), F.lit(""))).withColumn("_sentences", T.sentences("cleaned_content"))
    out = out.withColumn("sentences_count", F.size("_sentences")).withColumn("sample_sentences", F.slice("_sentences", 1, 5)).withColumn("top_keywords", T.top_keywords("cleaned_content"))
    out = out.withColumn("content_sections", T.sections("cleaned_content")).withColumn("readability_metrics", T.readability("cleaned_content")).withColumn("content_type", T.url_content_type("url"))
    score = T.page_quality("cleaned_content", "confidence_score", F.size("content_sections"), F.size("paragraphs"), F.col("quality_signals.has_natural_language"))
    return out.withColumn("content_quality_score", score).drop("_sentences")


def process_results(records: DataFrame, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """Structured successful records by quality and position, and the counts.

    The structured records are stored once: a global sort samples its input first, which would compute them twice.
    """
    records = materialise(records, "pages-extracted")
    ranked = materialise(structure(records.filter("extraction_status = 'success'")), "pages-structured").orderBy(F.desc("content_quality_score"), position)
    ok = F.count_if(F.col("extraction_status") == "success")
    return ranked, records.agg(F.count("*").alias("total_input"), ok.alias("successful"), (F.count("*") - ok).alias("failed"), ok.alias("processed"))


def search_stats(records: DataFrame) -> DataFrame:
    ok = F.col("extraction_status") == "success"
    return records.agg(F.count("*").alias("total_results"), F.count_if(ok).alias("successful_extractions"), F.count_if(ok & (F.col("confidence_score") > 0.7)).alias("high_quality"), F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.sum("content_word_count"), F.lit(0)).alias("total_words"))


def safe_filename(text, most: int = 50):
    """A file name of the text's word characters, or its MD5 where none is left."""
    clean = F.substring(F.regexp_replace(F.trim(F.regexp_replace(text, r"[^\w\s-]", "")), r"[-\s]+", "_"), 1, most)
    return F.when(clean != "", clean).otherwise(F.md5(text))


def exportable(records: DataFrame) -> DataFrame:
    return records.filter("extraction_status = 'success' and confidence_score > 0.75 and content_word_count > 300")
