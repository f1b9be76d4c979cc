"""Language identification by hierarchical discrimination.

A first stage predicts the language family; within it, one-versus-one linear support vector machines
separate the related languages. Both stages are linear in a text's frequencies of hashed character
n-grams, so a whole text's decision values are sums of table entries over its characters, divided by
their number. Families come from a fixed table; a language that it lacks is a family of its own.

Models are fitted on the driver to at most ``PER_LANGUAGE`` texts of each language (a documented
bound), those of least hash of their id among the rows whose ids are not held out. The tables are
small and of fixed size for each pair of classes; a pair's machine sees its two classes' texts alone.

Defined cases: null texts and texts without letters are ``und`` with score 1; with no labelled text
every text is ``und`` with score 0; a single language is predicted for all with score 1; rows that
repeat and null ids are predicted like any other; of rows that share an id and are picked one is
learnt from; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import runs, slices, utf8

#: fixed values: language families by ISO 639-1 code
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ur", "pa", "gu", "ne"],
    "sinitic": ["zh"],
    "semitic": ["ar", "he"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
PER_LANGUAGE, BITS, HELD_OUT = 400, 13, 1
ROWS = 2048
_LETTERS = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"only:{lang}")


def grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-byte grams at each byte: an index array of three rows, and which bytes count.

    Bytes that are no letters become spaces, runs of them one, and capitals small. Grams don't cross rows.
    """
    low = _KEEP[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    big = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] < 0x9F) & (data[lead + 1] != 0x97)]
    low[big + 1] += 0x20
    edge = np.zeros(len(low) + 1, bool)
    edge[rows] = True
    space = low == 32
    one = np.ones(len(low), bool)
    one[1:] = ~(space[1:] & space[:-1]) | edge[1 : len(low)]
    keep = np.flatnonzero(one)
    kept = low[keep].astype(np.uint32)
    first = edge[keep]
    before, before2 = np.full(len(kept), 32, np.uint32), np.full(len(kept), 32, np.uint32)
    before[1:] = kept[:-1]
    before[first] = 32
    before2[1:] = before[:-1]
    before2[first] = 32
    two = kept | before << np.uint32(8)
    three = two | before2 << np.uint32(16)
    spread = lambda x, k: ((x + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return np.stack([spread(kept, 1), spread(two, 2), spread(three, 3)]).astype(np.int32), keep


def features(texts: list[str]) -> np.ndarray:
    """Frequencies of hashed grams, a row a text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw):
            index, keep = grams(raw, np.array([0, len(raw)]))
            out[i] = np.bincount(index.ravel(), minlength=1 << BITS) / len(keep)
    return out


def fit_svm(kernel: np.ndarray, y: np.ndarray, steps: int = 300, c: float = 20.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps; y is -1 or 1.

    The weights are a sum of the samples, so steps need the samples' inner products alone. Returns
    each sample's coefficient, and the offset.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1.0 / (1.0 + 2 * c * (float(kernel.diagonal().max()) + 1.0))
    a = va = np.zeros(len(y))
    b = vb = 0.0
    for t in range(steps):
        margin = y * (kernel @ va + vb)
        pull = np.where(margin < 1, weight * y * (1 - margin), 0.0)
        new_a, new_b = va - rate * (va - 2 * c * pull), vb + rate * 2 * c * pull.sum()
        push = t / (t + 3)
        va, vb = new_a + push * (new_a - a), new_b + push * (new_b - b)
        a, b = new_a, new_b
    return a, float(b)


class Model:
    """Tables of a family stage and of the stages within families, one column a pair of classes."""

    def __init__(self, texts: list[str], langs: list[str]):
        order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
        langs = [langs[i] for i in order]
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        self.stages: list[tuple[str, list[str], list[tuple[int, int, int]]]] = []
        columns, self.offsets = [], []
        if len(self.langs) > 1:
            x = features([texts[i] for i in order])
            scale = x.std(axis=0) + 1e-4
            x /= scale
            y = np.array(langs)
            kin = np.array([family(v) for v in langs])
            for name, classes, labels in [("", self.families, kin), *((f, m, y) for f, m in self.members.items())]:
                pairs = []
                for a, b in combinations(range(len(classes)), 2):
                    of = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
                    kernel = (x[of] @ x[of].T).astype(np.float64)  # of these two classes' samples alone
                    part, offset = fit_svm(kernel, np.where(labels[of] == classes[a], 1.0, -1.0))
                    pairs.append((a, b, len(columns)))
                    columns.append((part.astype(np.float32) @ x[of]) / scale)
                    self.offsets.append(offset)
                self.stages.append((name, classes, pairs))
        self.table = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((1 << BITS, 0), np.float32)

    def _vote(self, values: np.ndarray, classes: list[str], pairs) -> tuple[np.ndarray, np.ndarray]:
        """Winner and its confidence: votes of the pairs, ties by summed margins."""
        n, size = len(values), len(classes)
        votes, margins = np.zeros((n, size)), np.zeros((n, size))
        for a, b, col in pairs:
            m = values[:, col]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            margins[:, a] += np.tanh(m)
            margins[:, b] -= np.tanh(m)
        best = np.argmax(votes + margins / (4 * size), axis=1)
        worst = np.full(n, np.inf)
        for a, b, col in pairs:
            m = values[:, col]
            worst = np.where(best == a, np.minimum(worst, m), np.where(best == b, np.minimum(worst, -m), worst))
        return best, np.where(np.isinf(worst), 1.0, 1 / (1 + np.exp(-2 * np.clip(worst, -20, 20))))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, letters or not."""
        n = len(column)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        if len(self.langs) == 1:
            return [self.langs[0]] * n, np.ones(n)
        values = np.zeros((n, self.table.shape[1]))
        data, offsets = utf8(column)
        for lo, hi in slices(offsets):
            rows = offsets[lo : hi + 1] - offsets[lo]
            raw = data[offsets[lo] : offsets[hi]]
            if not len(raw):
                continue
            index, keep = grams(raw, rows)
            bounds = np.searchsorted(keep, rows)
            some = np.flatnonzero(np.diff(bounds))
            sums = self.table[index[0]]
            sums += self.table[index[1]]
            sums += self.table[index[2]]
            values[lo + some] = np.add.reduceat(sums, bounds[some], axis=0, dtype=np.float64) / np.diff(bounds)[some, None]
        values += np.array(self.offsets)
        _, families, pairs = self.stages[0]
        kin, sure = self._vote(values, families, pairs)
        langs, score = [""] * n, np.array(sure)
        for k, (name, classes, inner) in enumerate(self.stages[1:]):
            own = np.flatnonzero(kin == families.index(name)) if name in families else np.array([], int)
            if len(own):
                best, conf = self._vote(values[own], classes, inner)
                score[own] = sure[own] * conf
                for i, x in zip(own.tolist(), best.tolist(), strict=True):
                    langs[i] = classes[x]
        return langs, score


def held_out():
    """Whether a row is held out: crc32 of its id, as text, modulo 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of the labelled texts that are not held out; ids are picked before texts are read."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = ids.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id").distinct()
    names = picked.collect()  # at most per_language ids for each language
    if not names:
        return Model([], [])
    few = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in names], f"doc_id {dict(docs.dtypes)['doc_id']}")
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).collect()
    return Model([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; the model is fitted to the documents unless given."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32 kB for each pair of classes
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in runs(batches, ROWS):
            texts = b.column("text")
            langs, score = shared.value.predict(texts)
            for i, t in enumerate(texts.to_pylist()):
                if not t or not _LETTERS.search(t):
                    langs[i], score[i] = "und", 1.0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
