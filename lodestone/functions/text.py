"""Scalar text functions as Column expressions. Python runs only where Spark has no built-in (NFKC, HTML entities)."""

from __future__ import annotations

import html
import math
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

C = Column | str

# --- fixed values: patterns and word lists -----------------------------------------------------
BOILERPLATE_LINES = [
    r"(?i)page\s+\d+\s+(?:of|/)\s+\d+", r"\s*\d+\s*$", r"(?i)copyright\s+©?\s*\d{4}", r"(?i)all\s+rights\s+reserved",
    r"(?i)confidential\s+and\s+proprietary", r"(?i)document\s+version", r"(?i)last\s+updated", r"(?i)printed\s+from",
]
NOISE = [r"page\s+\d+", "copyright", r"all\s+rights\s+reserved", "confidential", "draft", r"version\s+\d"]
NAVIGATION = [r"home\s*\|.*", r"about\s*us.*", r"contact\s*us.*", "sitemap.*", r"privacy\s*policy.*", r"terms\s*of\s*use.*", r"cookie\s*policy.*", r"accessibility\s*statement.*", r"legal\s*notice.*", r"copyright\s*©.*", r"all\s*rights\s*reserved.*"]
SOCIAL = [r"follow\s*us\s*on.*", r"like\s*us\s*on.*", r"share\s*this\s*page.*", r"tweet\s*this.*", r"sponsored\s*content.*", "advertisement.*", r"promoted\s*by.*", r"partner\s*content.*"]
ABBREVIATIONS = ["Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "etc.", "e.g.", "i.e.", "vs.", "U.S.", "U.K.", "Jan.", "Feb.", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."]
TECHNICAL_TERMS = ["function", "class", "method", "variable", "import", "def", "return", "if", "else", "for", "while", "try", "except", "database", "api", "server", "client", "json", "xml", "html", "css", "javascript", "python", "java"]
CODE = [r"def\s+\w+\(.*\):", r"class\s+\w+:", r"import\s+\w+", r"print\(.*\)", r"console\.log\(.*\)", r"System\.out\.println\(.*\)", r"<[a-zA-Z][^>]*>"]
CONTENT_TYPES = {
    "code_heavy": [r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+\b", r"\bfunction\b", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\bconst\s+\w+", r"\bvar\s+\w+", r"\blet\s+\w+", r"#include\b", r"package\s+\w+"],
    "technical": [r"\bAPI\b", r"\bendpoint\b", r"\bparameter\b", r"\bconfiguration\b", r"\bimplementation\b", r"\balgorithm\b", r"\bfunction\b", r"\bmodule\b", r"\bcomponent\b", r"\bsystem\b"],
    "legal": [r"\bshall\b", r"\bparty\b", r"\bparties\b", r"\bcontract\b", r"\bagreement\b", r"\bliability\b", r"\bterms?\s+and\s+conditions?\b", r"\bwarranty\b", r"\bindemnification\b", r"\bconfidentiality\b"],
    "conversational": [r"^\s*Q:\s*", r"^\s*A:\s*", r"^\s*Question:\s*", r"^\s*Answer:\s*", r"^\s*>\s", r"\binterview\b", r"\btranscript\b", r"\bdialogue\b"],
    "narrative": [r"\bchapter\b", r"\bstory\b", r"\bcharacter\b", r"\bscene\b", r"\bplot\b", r"\bnovel\b", r"\bfiction\b", r"\bnarrative\b"],
    "tabular": [r"\|\s*[\w\s]+\s*\|", r"\t"],
}
PROPER_NOUN = r"(?U)(?=[A-Z])\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
ORGANISATION = r"(?U)\b[A-Z][a-zA-Z]*\s+(?:Inc\.?|LLC|Ltd\.?|Corp\.?|Company)\b"
DATE = r"(?U)\b(?:\d{1,2}[/-])?\d{1,2}[/-]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "with", "was", "for"], "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "nicht"],
    "fr": ["le", "de", "la", "et", "les", "des", "en", "un", "une", "est"], "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "una"],
}
URL_TYPES = [
    ("encyclopedia", ["wikipedia.org", "wiki."]), ("official_docs", ["docs.python.org", "documentation"]), ("tutorial", ["tutorial", "course", "learn"]), ("blog", ["blog", "medium.com", "dev.to"]),
    ("qna", ["stackoverflow.com", "stackexchange.com"]), ("code_repository", ["github.com", "gitlab.com"]), ("research_paper", ["research", "arxiv.org", "academic"]), ("news_article", ["news", "article", "press"]),
]
#: what NFKC may change; it leaves the other characters alone, and they join with nothing before them, so that what lies between two of them is normalised on its own. Common characters are turned away by the first parts
CHANGING = r"[\x{A0}-\x{10FFFF}&&[^\x{BF}-\x{131}]&&[^\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{482}\x{2012}-\x{2016}\x{2018}-\x{201F}\x{20AC}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]]"
#: about the order of letters in the texts' languages; any other character is counted too
FREQUENT = [*" enairstodlhucmpgfb.vwyk,qzxj"]
# ------------------------------------------------------------------------------------------------


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: Spark evaluates a lambda's outer expressions at every call.

    It is the end of a fold over nothing. An item of a transformed array would do too, but asks for its type
    at every row, which takes twice as long with each ``let`` inside another.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, use)


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_parts(parts: pd.Series) -> pd.Series:
    return parts.map(lambda ps: ps if ps is None else [unicodedata.normalize("NFKC", p) for p in ps])


def nfkc(text: C) -> Column:
    """The NFKC form. Python gets only the stretches that may change, each with the character before it."""
    text, changing = _c(text), f"(?s).?{CHANGING}+"
    some = text.rlike(CHANGING)
    parts = _nfkc_parts(F.when(some, F.regexp_extract_all(text, F.lit(changing), 0)))
    joined = F.zip_with(F.split(text, changing), parts, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(some, F.array_join(joined, "")).otherwise(text)


def with_nfkc(rows: DataFrame, column: str, out: str, unescape: bool = False) -> DataFrame:
    """Adds the NFKC form of a column, HTML entities resolved first if asked, as a step of its own.

    Higher-order functions can't hold a Python function, and Spark would move one into them from a projection.
    """
    def one(t):
        return t if t is None else unicodedata.normalize("NFKC", html.unescape(t) if unescape else t)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(t) for t in b.column(column).to_pylist()], pa.string())], [*b.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def needed(pattern: str) -> str:
    """The longest lower-case string that every match of a pattern without groups or alternatives holds, in any case; empty if none is known."""
    parts = re.findall(r"(\\.|\[[^\]]*\]|.)([?*+]?)", pattern)
    if any(p in "(|" for p, _ in parts):
        return ""
    runs = [""]
    for p, many in parts:
        plain = "\t" if p == r"\t" else p[1:] if re.match(r"\\\W", p) else p if re.match(r"[^\\^$.\[{}]", p) else ""
        if not plain or many in ("?", "*"):
            runs.append("")
            continue
        runs[-1] += plain.lower()
        if many:
            runs.append("")
    return max(runs, key=len)


def hits(held: Column, patterns: list[str]) -> Column:
    """Matches of the patterns, in any case, in ``held.t``; one is looked for only where ``held.low``, the text lower-cased, has the string it needs."""
    return sum((F.when(F.contains(held["low"], F.lit(needed(p))), F.regexp_count(held["t"], F.lit(f"(?i){p}"))).otherwise(0) for p in patterns), F.lit(0))


def words(text: C) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: C) -> Column:
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("int")


def normalised(text: C, unicode: bool = True) -> Column:
    """Text without boilerplate lines, with URLs and addresses masked, sentences parted and white space single."""
    text = nfkc(_c(text)) if unicode else _c(text)
    prefix = "|".join(f"(?:{p})" for p in BOILERPLATE_LINES)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).rlike(f"^(?:{prefix})")), "\n")

    def masked(t: Column) -> Column:
        t = F.when(F.contains(t, F.lit("http")) | F.contains(t, F.lit("www.")), F.regexp_replace(t, r"https?://\S+|www\.\S+", " [URL] ")).otherwise(t)
        return let(t, lambda u: F.when(F.contains(u, F.lit("@")), F.regexp_replace(u, r"\S+@\S+\.\S+", " [EMAIL] ")).otherwise(u))

    out = F.regexp_replace(let(kept, masked), r"([.!?])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(out, r"(?U)\s{2,}|(?! )\s", " "))  # single spaces stay


def sentences(text: C) -> Column:
    """Sentences of over 15 characters; a stop after a known abbreviation ends none."""
    out = _c(text)
    for a in ABBREVIATIONS:
        out = F.replace(out, F.lit(a), F.lit(a.replace(".", "#")))
    parts = F.split(out, r"(?<=[.!?])\s+(?=[A-Z])")

    def restore(s: Column) -> Column:
        whole = s
        for a in ABBREVIATIONS:
            whole = F.replace(whole, F.lit(a.replace(".", "#")), F.lit(a))
        return F.trim(F.when(F.contains(s, F.lit("#")), whole).otherwise(s))

    return F.coalesce(F.filter(F.transform(parts, restore), lambda s: F.length(s) > 15), F.array().cast("array<string>"))


def paragraphs(text: C) -> Column:
    """Paragraphs of at least 40 characters of which four tenths are letters."""
    parts = F.transform(F.split(_c(text), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    letters = lambda p: F.length(F.regexp_replace(p, r"[^\p{L}]", ""))
    return F.coalesce(F.filter(parts, lambda p: (F.length(p) >= 40) & (letters(p) / F.length(p) >= 0.4)), F.array().cast("array<string>"))


def top_counts(found: Column, n: int) -> Column:
    """The n most frequent strings of an array, ties by first occurrence.

    The strings are sorted with their places, and the lengths of equal stretches are the counts.
    """
    def ranked(all_: Column) -> Column:
        first = lambda x, i: (i == 0) | (F.get(all_, i - 1)["w"] != x["w"])
        heads = F.filter(F.transform(all_, lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())
        return let(heads, lambda starts: counted(all_, starts))

    def counted(all_: Column, starts: Column) -> Column:
        n_of = lambda i, k: F.coalesce(F.get(starts, k + 1), F.size(all_)) - i
        scored = F.transform(starts, lambda i, k: F.struct((-n_of(i, k)).alias("n"), F.get(all_, i)["at"].alias("at"), F.get(all_, i)["w"].alias("w")))
        return F.transform(F.slice(F.array_sort(scored), 1, n), lambda s: s["w"])

    return let(F.array_sort(F.transform(found, lambda w, at: F.struct(w.alias("w"), at.alias("at")))), ranked)


def keywords(text: C, n: int = 10, least: int = 5) -> Column:
    return top_counts(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}_]{%d,})" % least), 1), n)


def top_keywords(text: C, n: int = 15, least: int = 4) -> Column:
    return top_counts(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"((?U)\b[a-zA-Z'][a-zA-Z'-]{%d,}\b)" % (least - 1)), 1), n)


def char_entropy(text: C) -> Column:
    """Shannon entropy of lower-cased characters, an eighth of it, at most 1.

    A fold takes one character after the other out of the text, the frequent ones first, so that what is
    left to look through soon is short. Each character is lowered to one. Terms are summed with
    compensation, so that their order leaves no trace in the last digits.
    """
    text, zero = _c(text), F.lit(0.0)

    def less(acc: Column, c: Column) -> Column:
        return F.struct(acc["total"].alias("total"), F.replace(acc["rest"], c, F.lit("")).alias("rest"), F.concat(acc["left"], F.array(F.length(acc["rest"]))).alias("left"))

    def add(acc: Column, x: Column) -> Column:
        y = x - acc["lost"]
        t = acc["sum"] + y
        return F.struct(t.alias("sum"), (t - acc["sum"] - y).alias("lost"))

    def rare(acc: Column) -> Column:
        return F.aggregate(F.filter(F.array_distinct(F.split(acc["rest"], "")), lambda c: c != ""), acc, less, bits)

    def bits(acc: Column) -> Column:
        shares = F.transform(acc["left"], lambda n, i: (n - F.coalesce(F.get(acc["left"], i + 1), F.lit(0))) / acc["total"])
        terms = F.transform(F.filter(shares, lambda p: p > 0), lambda p: p * F.log(p))
        return F.aggregate(terms, F.struct(zero.alias("sum"), zero.alias("lost")), add, lambda acc: acc["sum"])

    low = F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))
    start = F.struct(F.length(text).cast("double").alias("total"), low.alias("rest"), F.array().cast("array<int>").alias("left"))
    found = F.aggregate(F.array(*[F.lit(c) for c in FREQUENT]), start, less, rare)
    return F.when(F.length(text) > 0, F.least(F.lit(1.0), -found / math.log(2) / 8)).otherwise(0.0)


def information_density(text: C) -> Column:
    text = _c(text)

    def value(w: Column) -> Column:
        n = F.size(w).cast("double")
        unique = F.size(F.array_distinct(F.transform(w, F.lower)))
        length = F.length(F.array_join(w, ""))
        named = F.regexp_count(text, F.lit(PROPER_NOUN))
        marks = F.regexp_count(text, F.lit("[.,;:!?]"))
        score = unique / n * 0.4 + F.least(length / n / 10, F.lit(1.0)) * 0.2 + F.least(named / n * 5, F.lit(1.0)) * 0.3 + F.least(marks / F.length(text) * 10, F.lit(1.0)) * 0.1
        return F.when(n > 0, F.least(F.lit(1.0), score)).otherwise(0.0)

    return let(words(text), value)


def signal_to_noise(text: C) -> Column:
    text = _c(text)
    noise = let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda h: hits(h, NOISE))
    return F.greatest(F.lit(0.0), 1.0 - noise / F.size(F.split(text, "\n")))


def entities(text: C) -> Column:
    """Array of (text, type): ten proper nouns of the first 5 000 characters, organisations, five dates; first occurrences."""
    text = _c(text)
    some = lambda t, p: F.array_distinct(F.regexp_extract_all(t, F.lit(f"({p})"), 1))
    typed = lambda a, kind: F.transform(a, lambda x: F.struct(x.alias("text"), F.lit(kind).alias("type")))
    return F.concat(typed(F.slice(some(F.substring(text, 1, 5000), PROPER_NOUN), 1, 10), "PROPER_NOUN"), typed(some(text, ORGANISATION), "ORGANIZATION"), typed(F.slice(some(text, DATE), 1, 5), "DATE"))


def quality_score(tokens: C, density: C, entropy: C, s2n: C, coherence: C) -> Column:
    """One less its penalties, in this order, in doubles."""
    rules = [(_c(tokens) < 30, 0.3), (_c(density) < 0.3, 0.2), (_c(entropy) < 0.4, 0.15), (_c(s2n) < 0.7, 0.2), (_c(coherence) < 0.5, 0.15)]
    score = F.lit(1.0)
    for fails, by in rules:
        score = score - F.when(fails, by).otherwise(0.0)  # named once, so that the expression grows by rules only
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def first_best(scores: dict[str, Column], least: int, other: str) -> Column:
    """The name of the highest score, the first of equals; ``other`` below ``least`` or without scores. Each score is computed once."""
    def pick(h: Column) -> Column:
        best = F.greatest(*[h[k] for k in scores])
        out = F.when(best.isNull() | (best < least), other)
        for k in scores:
            out = out.when(h[k] == best, k)
        return out

    return let(F.struct(*[v.alias(k) for k, v in scores.items()]), pick)


def content_type(text: C) -> Column:
    """The type with most pattern hits in the first 5 000 characters, the first named of equals; under two hits, mixed."""
    sample = F.substring(_c(text), 1, 5000)
    return let(F.struct(sample.alias("t"), F.lower(sample).alias("low")), lambda h: first_best({k: hits(h, ps) for k, ps in CONTENT_TYPES.items()}, 2, "mixed"))


def detect_language(text: C) -> Column:
    """Most stop words among the first 1 000 characters' words; none is unknown."""
    found = F.regexp_extract_all(F.lower(F.substring(_c(text), 1, 1000)), F.lit(r"([\p{L}]+)"), 1)
    return let(found, lambda w: first_best({k: F.size(F.filter(w, lambda x: x.isin(stop))) for k, stop in STOP_WORDS.items()}, 1, "unknown"))


def quality_signals(text: C) -> Column:
    text = F.coalesce(_c(text), F.lit(""))
    w = F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\b[a-zA-Z]{3,}\b)"), 1)
    code = F.lit(False)
    for p in CODE:
        code = code | text.rlike(p)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.struct(
        (F.size(w) > 100).alias("has_natural_language"), (F.size(F.filter(w, lambda x: x.isin(TECHNICAL_TERMS))) > 5).alias("has_technical_terms"), code.alias("has_code_examples"),
        text.rlike(r"\[\d+\]|\(\d{4}\)|et al\.|pp\.").alias("has_references"), (F.regexp_count(text, F.lit(r"(?m)^\s*(#+|\*+|\-+|\d+\.)\s+")) > 2).alias("has_structure"),
        F.when(F.length(text) > 0, letters / F.length(text)).otherwise(0.0).alias("content_density"),
    )


def readability(text: C) -> Column:
    """Counts, means and reading ease; null where there is no sentence or word."""
    text = _c(text)
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    # one pass for short words, one for the vowel groups of the longer ones, joined by a mark that is no vowel
    long_ = lambda w: F.array_join(F.filter(w, lambda x: F.length(x) > 3), "|")
    held = let(found, lambda w: F.struct(F.size(w).alias("n"), (F.size(F.filter(w, lambda x: F.length(x) <= 3)) + F.regexp_count(F.lower(long_(w)), F.lit("[aeiouy]+"))).alias("syl"), F.length(F.array_join(w, "")).alias("len"), F.size(sentences(text)).alias("s")))

    def metrics(h: Column) -> Column:
        n, n_sent = h["n"], h["s"]
        ease = F.lit(206.835) - F.lit(1.015) * (n / n_sent) - F.lit(84.6) * (h["syl"] / n)
        return F.when((n_sent > 0) & (n > 0), F.struct(n.alias("word_count"), n_sent.alias("sentence_count"), F.round(n / n_sent, 1).alias("avg_sentence_length"), F.round(h["len"] / n, 1).alias("avg_word_length"), F.greatest(F.lit(0.0), F.round(ease, 1)).alias("flesch_reading_ease"), h["syl"].alias("syllable_count")))

    return let(held, metrics)


def url_content_type(url: C) -> Column:
    low = F.lower(_c(url))
    out = None
    for kind, marks in URL_TYPES:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def without_repeated_headers(text: Column) -> Column:
    """In texts of over ten lines, short lines of under five words that come more than three times are kept once."""
    def repeated(lines: Column) -> Column:
        short = F.filter(lines, lambda x: (F.length(x) < 80) & (F.size(words(x)) < 5))
        return let(F.array_sort(short), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i >= 3) & (F.get(s, i - 3) == x))))

    def once(h: Column) -> Column:
        return F.filter(h["l"], lambda x, i: ~F.array_contains(h["r"], x) | (F.array_position(h["l"], x) == i + 1))

    def clean(t: Column) -> Column:
        held = let(F.split(t, "\n"), lambda lines: F.struct(lines.alias("l"), repeated(lines).alias("r")))
        return let(held, lambda h: F.when((F.size(h["l"]) > 10) & (F.size(h["r"]) > 0), F.array_join(once(h), "\n")).otherwise(t))

    return let(text, clean)


def advanced_clean(text: C) -> Column:
    """Text without control characters, separators, page numbers, breadcrumbs, navigation and social tails.

    Entities and compatibility characters are resolved by ``with_nfkc`` beforehand.
    """
    out = F.regexp_replace(_c(text), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    lines = F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    artefact = r"^[=*\-_~]{3,}$|^\s*\d+\s*$|^Page\s+\d+|^[A-Za-z]+\s*>\s*[A-Za-z]+(?:\s*>\s*[A-Za-z]+)*$"
    out = F.array_join(F.filter(lines, lambda x: ~x.rlike(artefact)), "\n")
    for p in NAVIGATION + SOCIAL:
        out = F.regexp_replace(out, f"(?i){p}", "")
    out = without_repeated_headers(out)
    out = F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.coalesce(F.regexp_replace(out, r"(?U)^\s+|\s+$", ""), F.lit(""))


def sections(text: C) -> Column:
    """Map of section title to lines: a title met again starts anew, lines of up to ten characters and empty sections go."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    patterns = [r"^#{1,6}\s+(.*)$", r"^([A-Z][A-Za-z\s]{3,50}):?$", r"^(Introduction|Overview|Background|Methods|Results|Discussion|Conclusion|References):?$", r"^([A-Z\s]{5,30})$"]

    def title(line: Column) -> Column:
        hit = F.when(F.lit(False), F.lit(""))
        for p in patterns:
            hit = hit.when(line.rlike(p), F.regexp_extract(line, p, 1))
        bare = F.regexp_replace(F.trim(F.regexp_replace(hit, "^:+|:+$", "")), r"[#*_`]", "")
        return F.when(F.size(words(line)) < 10, bare)

    empty = F.create_map(F.lit("Main Content"), F.array().cast("array<string>"))
    start = F.struct(F.lit("Main Content").alias("at"), empty.alias("m"))
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))

    def step(acc: Column, line: Column, t: Column) -> Column:
        heading = t.isNotNull()
        enter = heading & (t != "") & (t != acc["at"])
        return F.when(enter, F.struct(t.alias("at"), put(acc["m"], t, F.array().cast("array<string>")).alias("m"))).when(~heading & (F.length(line) > 10), F.struct(acc["at"].alias("at"), put(acc["m"], acc["at"], F.concat(F.element_at(acc["m"], acc["at"]), F.array(line))).alias("m"))).otherwise(acc)

    folded = F.aggregate(lines, start, lambda acc, line: let(F.struct(acc.alias("a"), line.alias("l"), title(line).alias("t")), lambda h: step(h["a"], h["l"], h["t"])), lambda acc: acc["m"])
    return F.map_filter(folded, lambda _, v: F.size(v) > 0)


def extraction_confidence(content: C, method: C) -> Column:
    """Length band, method prior, and three tenths for names, few links and stops; at most 1."""
    content, method = _c(content), _c(method)
    return let(F.size(words(content)), lambda n: _confidence(content, method, n))


def _confidence(content: Column, method: Column, n: Column) -> Column:
    prior = F.when(method == "trafilatura", 0.95).when(method == "justext", 0.85).when(method == "boilerpy3", 0.8).when(method == "readability", 0.75).otherwise(0.5)
    score = F.when((n > 300) & (n < 8000), 0.3).when(n > 8000, 0.2).otherwise(0.0) + prior
    score = score + F.when(F.regexp_count(content, F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b")) > 5, 0.1).otherwise(0.0)
    score = score + F.when(F.regexp_count(content, F.lit("https?://")) < n * 0.02, 0.1).otherwise(0.0)
    score = score + F.when(F.length(content) - F.length(F.replace(content, F.lit("."), F.lit(""))) > n * 0.03, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def page_quality(cleaned: C, confidence: C, n_sections: C, n_paragraphs: C, natural: C) -> Column:
    return let(F.size(words(cleaned)), lambda n: _page_quality(n, cleaned, confidence, n_sections, n_paragraphs, natural))


def _page_quality(n: Column, cleaned: C, confidence: C, n_sections: C, n_paragraphs: C, natural: C) -> Column:
    length = F.when(n > 1000, 0.4).when(n > 500, 0.3).when(n > 200, 0.2).when(n > 50, 0.1).otherwise(0.0)
    score = F.coalesce(_c(confidence), F.lit(0.0)) * 0.3 + length + F.when(_c(n_sections) > 1, 0.2).otherwise(0.0) + F.when(_c(n_paragraphs) > 5, 0.1).otherwise(0.0) + F.when(_c(natural), 0.1).otherwise(0.0)
    return F.when(F.length(_c(cleaned)) > 0, F.round(F.least(score, F.lit(1.0)), 2)).otherwise(0.0)


def chunk_id(*parts: C) -> Column:
    return F.md5(F.concat_ws("\x1f", *[_c(p).cast("string") for p in parts]))


def fingerprint(content: C) -> Column:
    """(content_hash, file_hash, size) of a binary column; over 16 384 bytes the first hash samples head, middle and tail."""
    content = _c(content)
    size = F.octet_length(content)
    sample = F.concat(F.substring(content, 1, 8192), F.substr(content, F.floor(size / 2).cast("int") + 1, F.lit(4096)), F.substr(content, size - 4095, F.lit(4096)))
    return F.struct(F.when(size > 16384, F.md5(sample)).otherwise(F.md5(content)).alias("content_hash"), F.md5(content).alias("file_hash"), size.cast("long").alias("size"))


def strip_special(text: C, tokens: list[str]) -> Column:
    out = _c(text)
    for t in tokens:
        out = F.replace(out, F.lit(t), F.lit(""))
    return F.trim(out)


def normalise_tool_name(name: C) -> Column:
    low = F.translate(F.lower(F.trim(_c(name))), " -", "__")
    return F.when(F.contains(low, F.lit("web")) & F.contains(low, F.lit("search")) | (low == "search"), "web_search").otherwise(F.coalesce(low, F.lit("")))


def tool_payload(text: C) -> Column:
    """What stands between the call markers, or the text itself if it looks like JSON or a call; null otherwise."""
    text = _c(text)
    inner = F.trim(F.regexp_extract(text, r"(?s)<\|tool_call_start\|>(.*?)(?:<\|tool_call_end\|>|$)", 1))
    inner = F.regexp_replace(inner, r"(?s)^\[(.*)\]$", "$1")
    bare = F.trim(text)
    return F.when(F.contains(text, F.lit("<|tool_call_start|>")), F.trim(inner)).when(bare.rlike(r"(?s)^\{.*\}$") | F.contains(bare, F.lit("(")) & F.contains(bare, F.lit(")")), bare)


def tool_call(text: C) -> Column:
    """(name, query, max_results) of a call written as JSON or as a function; query= prefixes and result counts are parted."""
    payload = tool_payload(text)
    json = F.try_parse_json(payload)
    is_json = json.isNotNull() & payload.startswith("{")
    get = lambda *ps: F.coalesce(*[F.try_variant_get(json, p, "string") for p in ps])
    name = F.when(is_json, get("$.name", "$.tool", "$.function")).otherwise(F.regexp_extract(payload, r"^\s*([\w\- ]+?)\s*\(", 1))
    body = F.regexp_extract(payload, r"(?s)\((.*)\)", 1)
    quoted = F.regexp_extract(body, r"""(?s)["'](.*?)["']""", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"^\s*query\s*=\s*", ""), r",\s*max_results\s*=\s*\d+\s*$", ""))
    query = F.when(is_json, get("$.arguments.query", "$.parameters.query", "$.args.query", "$.query")).otherwise(F.when(quoted != "", quoted).otherwise(plain))
    count = F.coalesce(F.when(is_json, get("$.arguments.max_results", "$.parameters.max_results", "$.max_results")).otherwise(F.regexp_extract(body, r"max_results\s*=\s*(\d+)", 1)), F.lit(""))
    return F.when(payload.isNotNull(), F.struct(normalise_tool_name(name).alias("name"), query.alias("query"), count.try_cast("int").alias("max_results")))


def last_of_role(messages: C, role: str) -> Column:
    """The content of the last message of a role in an array of (role, content)."""
    return F.try_element_at(F.transform(F.filter(_c(messages), lambda m: m["role"] == role), lambda m: m["content"]), F.lit(-1))


def chat_text(messages: C) -> Column:
    """Messages as text: role prefixes, blank lines between, and the assistant's turn at the end."""
    line = lambda m: F.concat(F.when(m["role"] == "system", "System: ").when(m["role"] == "user", "User: ").otherwise("Assistant: "), m["content"])
    return F.concat(F.array_join(F.transform(_c(messages), line), "\n\n"), F.lit("\n\nAssistant:"))
