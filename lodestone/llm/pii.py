"""Personal data: exact base patterns, and a semi-Markov conditional random field for other forms.

Base spans are found over whole texts, leftmost and without overlap for each kind, by scans that are
linear in the text, and always stay. The field adds spans in forms that the patterns don't know: a
phone number without a plus sign, a card number with other separators, an address with a spelt-out at
sign, and a further kind, secrets (keys and tokens). It scores candidate segments of up to ``LONGEST``
tokens and ``WIDEST`` characters as wholes: number of digits, grouping, separators, check digit,
ranges, what touches the ends and, for secrets, what they are assigned to. A dynamic program over the
tokens, bounded by that length, chooses boundaries and kinds together: the segmentation of largest
score, where a segment scores the sum of its features' weights less ``MARGIN`` (a fixed offset that
favours precision; a grouping or separator never seen in training weighs ``UNSEEN``) and text outside
entities scores 0. A segment with neither seven digits, an at mark nor a long run of letters and digits
is no candidate, so the program runs on the regions that can hold one, with the result of the whole.

The field is trained here, by gradient steps on the likelihood of marked lines that ``examples``
writes from a fixed seed, with look-alikes such as dates, prices, versions and identifiers among them.

Defined cases: null and empty texts have no spans; offsets count code points, the end excluded; rows
that repeat are read each; other columns are ignored by ``find_pii`` and kept by ``mask_pii``; runs of
digits or address characters may have any length.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import runs

#: kinds of the base patterns, and all kinds
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LONGEST, WIDEST, MARGIN, UNSEEN = 16, 200, 1.0, -1.0
#: a numeric candidate has at most so many digits and groups of them
MOST_DIGITS, MOST_GROUPS = 20, 8

# fixed values: the base patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9]+")
_ZONE = re.compile(r"[0-9+(](?:\s?[^\sA-Za-z])*+")
_BRACED = r"[\[({<]\s?(?:at|AT)\s?[\])}>]"
_SPELT = r"(?<=[A-Za-z0-9])\s(?:at|AT)\s(?=[A-Za-z0-9-]{1,60}\s(?:dot|DOT)\s[A-Za-z0-9])"
_AT = re.compile(rf"@|{_BRACED}|{_SPELT}")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_OBFUSCATED = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:\s?(?:@|{_BRACED})\s?|\s(?:at|AT)\s)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{20,}+")
_NAMED = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|credential)s?\W{0,6}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """An address needs a run of local characters right before its at sign and two labels right after it."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            out.append((lo, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", at + 1)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """Runs of digits joined by single dots are taken by fours."""
    out = []
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") > 2:
            at, parts = chain.start(), chain[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in four):
                    out.append((at, at + size))
                at += size + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *s) for s in _ips(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Ranges of the text that hold every candidate segment.

    A numeric one lies in one zone without letters and wide gaps, a secret is a maximal run, and one with
    an at mark reaches no further than ``WIDEST`` from it.
    """
    found = []
    if _DIGIT.search(text):
        for m in _ZONE.finditer(text):
            if m.end() - m.start() >= 7 and len(_DIGIT.findall(m[0])) >= 7:
                found.append(m.span())
        found += [m.span() for m in _KEY.finditer(text) if _is_key(m[0])]
    for m in _AT.finditer(text):
        found.append((max(0, m.start() - WIDEST), min(len(text), m.end() + WIDEST)))
    found.sort()
    out: list[tuple[int, int]] = []
    for lo, hi in found:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _is_key(s: str) -> bool:
    return 20 <= len(s) <= WIDEST and bool(_DIGIT.search(s)) and any(c.isalpha() for c in s)


def span_features(text: str, lo: int, hi: int) -> list[str]:
    """What the field sees of a segment as a whole."""
    s = text[lo:hi]
    groups = _RUN.findall(s)
    digits = "".join(groups)
    n = len(digits)
    before, after = text[max(0, lo - 1) : lo], text[hi : hi + 1]
    out = ["bias"]
    if _AT.search(s):
        out.append("address" if _OBFUSCATED.fullmatch(s) else "at")
        out.append("top:alpha" if re.search(r"[A-Za-z]{2,}$", s) else "top:other")
        if re.search(_SPELT, s):
            out.append("spelt")
    elif _KEY.fullmatch(s):
        out.append("key")
        out.append("key:long" if len(s) >= 32 else "key:short")
        out.append("key:digits" if 10 * n >= len(s) else "key:few-digits")
        out.append("key:hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else "key:words" if re.search(r"[A-Za-z]{9,}", s) else "key:mixed")
        out.append("named" if _NAMED.search(text[max(0, lo - 24) : lo]) else "unnamed")
    else:
        out.append("letters" if re.search(r"[^\W\d_]", s) else f"n:{min(n, 20) if n < 13 else '13-15' if n < 16 else '16-19' if n < 20 else 'more'}")
        out.append("shape:" + "-".join(map(str, map(len, groups))) if len(groups) < 6 else "shape:many")
        seps = {c for c in s if not c.isdigit()} - set("+()")
        out.append("seps:" + "".join(sorted(seps)))
        out.append("luhn" if 13 <= n < 20 and luhn(digits) else "no-luhn")
        out.append("octets" if len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups) else "no-octets")
        if s[:1] == "+":
            out.append("plus")
        if re.match(r"00[1-9]", s):
            out.append("double-zero")
        if "(" in s and ")" in s:
            out.append("area")
        if ("(" in s) != (")" in s):
            out.append("half")
    if before and (before.isalnum() or before in "._%+-@#$€£/"):
        out.append("touch:left")
    if after and (after.isalnum() or after in "_%@#/" or after in ".-" and text[hi + 1 : hi + 2].isalnum()):
        out.append("touch:right")
    return out


def segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Tokens of a region, and its candidate segments (first token, last + 1, features)."""
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    marks = [m.span() for m in _AT.finditer(text, lo, hi)]
    keys = {m.start(): m.end() for m in _KEY.finditer(text, lo, hi) if _is_key(m[0])}
    digits = [len(_DIGIT.findall(text, a, min(z, a + WIDEST))) for a, z in tokens]
    numeric = [text[a].isdecimal() and n == z - a if text[a].isalnum() else not text[a].isalpha() for (a, z), n in zip(tokens, digits, strict=True)]
    out, mark = [], 0
    for i, (a, z) in enumerate(tokens):
        c = text[a]
        if a in keys:
            j = next((j for j in range(i, min(len(tokens), i + WIDEST)) if tokens[j][1] >= keys[a]), i)
            if tokens[j][1] == keys[a]:
                out.append((i, j + 1, span_features(text, a, keys[a])))
        while mark < len(marks) and marks[mark][1] <= a:
            mark += 1
        near = mark < len(marks) and marks[mark][1] <= a + WIDEST and c.isalnum()
        plain = numeric[i] and (c.isalnum() or c in "+(")
        if not near and not plain:
            continue
        n = groups = 0
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            start, end = tokens[j - 1]
            if end - a > WIDEST or j > i + 1 and start - tokens[j - 2][1] > 1:
                break
            n += digits[j - 1]
            groups += digits[j - 1] > 0
            plain = plain and numeric[j - 1] and n <= MOST_DIGITS and groups <= MOST_GROUPS
            last = text[end - 1]
            if not (last.isalnum() or last == ")"):
                continue
            if near and marks[mark][1] < end:
                if _OBFUSCATED.fullmatch(text, a, end):
                    out.append((i, j, span_features(text, a, end)))
            elif plain and n >= 7:
                out.append((i, j, span_features(text, a, end)))
            if not near and not plain:
                break
    return tokens, out


class Field:
    """Weights by kind and feature; segments outside entities are single tokens of score 0."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = {}
        self.best: dict[tuple[str, ...], tuple[str, float]] = {}

    def score(self, kind: str, features: list[str]) -> float:
        w = self.w
        return sum(w.get((kind, f), UNSEEN if f.startswith(("shape:", "seps:")) else 0.0) for f in features)

    def decode(self, text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
        """The entities of the segmentation of largest score."""
        tokens, found = segments(text, lo, hi)
        if not found:
            return []
        ending: dict[int, list] = {}
        for i, j, features in found:
            key = tuple(features)
            known = self.best.get(key)
            if known is None:
                if len(self.best) > 20_000:
                    self.best.clear()
                known = self.best[key] = max(((k, self.score(k, features) - MARGIN) for k in KINDS), key=lambda x: x[1])
            if known[1] > 0:
                ending.setdefault(j, []).append((i, *known))
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = best[j - 1]
            for i, kind, s in ending.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return out[::-1]

    def train(self, lines: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 40, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Stochastic gradient steps on the log-likelihood, by the forward and backward sums of each line."""
        ready = []
        for text, gold in lines:
            tokens, found = segments(text, 0, len(text))
            marked = {(a, z): kind for kind, a, z in gold}
            ready.append((len(tokens), [(i, j, f, marked.get((tokens[i][0], tokens[j - 1][1]))) for i, j, f in found]))
        order = random.Random(11)
        for epoch in range(epochs):
            order.shuffle(ready)
            step = rate / (1 + epoch / 8)
            for n, found in ready:
                arcs = [(i, j, f, g, kind, self.score(kind, f)) for i, j, f, g in found for kind in KINDS]
                into: dict[int, list] = {}
                out: dict[int, list] = {}
                for arc in arcs:
                    into.setdefault(arc[1], []).append(arc)
                    out.setdefault(arc[0], []).append(arc)
                alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    alpha[j] = _logsum([alpha[j - 1], *(alpha[a[0]] + a[5] for a in into.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    beta[i] = _logsum([beta[i + 1], *(beta[a[1]] + a[5] for a in out.get(i, ()))])
                for i, j, features, gold, kind, s in arcs:
                    slope = (gold == kind) - math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
                    if abs(slope) > 1e-3:
                        for f in features:
                            k = (kind, f)
                            old = self.w.get(k, 0.0)
                            self.w[k] = old + step * (slope - decay * old)
        self.best.clear()
        return self


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs)) if len(xs) > 1 else top


def examples(n: int = 700, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with marked entities, in base and other forms, and look-alikes that are none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))

    def card(sep: str) -> str:
        body = num(15)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, str]:
        a, b, c = num(3), num(3), num(4)
        kind = rng.choice(KINDS)
        if kind == "email":
            at, dot = rng.choice([("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), (" @ ", "."), (" at ", " dot ")])
            return kind, word() + rng.choice(["", "." + word(), num(2)]) + at + word() + dot + rng.choice(["com", "org", "net", "de", "example.com"])
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, card(rng.choice(["", " ", "-", ".", "/"]))
        if kind == "secret":
            alphabet = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-"])
            return kind, "A1" + "".join(rng.choice(alphabet) for _ in range(rng.choice([18, 22, 30, 38, 62]))) + "b2"
        return kind, rng.choice([f"00{num(2)} {num(2)} {num(7)}".replace("000", "001"), f"0049 {num(3)} {num(7)}", f"0033 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+49 {a} {num(7)}", f"1-{a}-{b}-{c}", f"+{num(11)}", f"({a}){b}-{c}"])

    def other() -> str:
        return rng.choice([
            f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{num(8)}", f"{num(10)}", f"{num(7)}", f"{num(12)}", f"{num(9)}", f"{num(14)}", f"{num(16)}", f"{num(20)}",
            f"{num(3)},{num(3)},{num(3)}", f"{num(2)}.{num(8)}", f"{num(1)}.{num(2)}.{num(3)}.{num(4)}.{num(2)}", f"{num(4)}/{num(2)}/{num(2)}", f"{num(4)}-{num(4)}", f"{num(4)} {num(4)}",
            f"{num(5)} {num(5)} {num(5)}", f"{num(4)} {num(4)} {num(4)}", f"978-{num(1)}-{num(3)}-{num(5)}-{num(1)}", f"{num(5)}-{num(4)}", f"{word()}{num(8)}", f"{num(8)}{word()}", f"{num(2)}:{num(2)}:{num(2)}", f"#{num(10)}", f"${num(7)}", f"{num(4)} {num(2)} {num(2)}",
            f"@{word()}", f"{word()}@{word()}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)} {num(5)}", f"{num(6)}-{num(6)}",
            f"{word()} at {word()}", f"{word()} at {word()} dot", f"{word()}-{word()}-{word()}-{word()}-{num(4)}", f"{word()}_{word()}_{word()}_{word()}{num(2)}", f"/{word()}/{word()}/{word()}/{word()}{num(1)}", "=" * 20 + num(2), f"{word()}/{num(4)}/{num(2)}/{word()}-{word()}-{word()}",
        ])

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(2, 4))) + rng.choice([" ", ": ", ", "])
            if rng.random() < 0.5:
                kind, s = entity()
                if kind == "secret":
                    name, quote = rng.choice(["key", "token", "api_key", "secret", "password", "Authorization: Bearer", "AUTH_TOKEN"]), rng.choice(["", '"', "'"])
                    text += name + rng.choice([" = ", "=", ": ", " "]) + quote
                gold.append((kind, len(text), len(text) + len(s)))
            else:
                s = other()
            text += s + rng.choice([" ", ". ", ", "])
        out.append((text + word(), gold))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field().train(examples())


def all_spans(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the field's further spans, which overlap none of them."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((a, z) for _, a, z in base)
    more = []
    for lo, hi in regions(text):
        if any(a <= lo and hi <= z for a, z in taken):
            continue
        for kind, a, z in field.decode(text, lo, hi):
            if all(z <= x or y <= a for x, y in taken):
                more.append((kind, a, z))
    return base, more


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_spans): base counts, base spans and all spans as kind:start:end, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in runs(batches):
            counts, base_text, spans, n = {k: [] for k in BASE_KINDS}, [], [], []
            for text in b.column("text").to_pylist():
                base, more = all_spans(text, shared.value)
                for k in BASE_KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                base_text.append(_written(base))
                spans.append(_written(base + more))
                n.append(len(base) + len(more))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(base_text, pa.string()), pa.array(spans, pa.string()), pa.array(n, pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base", "spans", "n_spans"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long")


def masked(text: str | None, field: Field) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    base, more = all_spans(text, field)
    if not base and not more:
        return text
    parts, at = [], 0
    for kind, a, z in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, z)
    return "".join(parts) + text[at:]


def mask_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents, with their columns, spans masked, and n_chars (where there is one) set anew for changed texts."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        for b in runs(batches):
            texts = b.column("text").to_pylist()
            new = [masked(t, shared.value) for t in texts]
            at = b.schema.get_field_index("text")
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if (n := b.schema.get_field_index("n_chars")) >= 0:
                old = b.column(n).to_pylist()
                b = b.set_column(n, b.schema.field(n), pa.array([o if t is u else len(u) for o, t, u in zip(old, texts, new, strict=True)], b.schema.field(n).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
