"""Personal data: base rules, and boosted trees over the candidates of wider generators.

The base rules (e-mail, IP, card, phone) are exact patterns with validations; what they find always stays. Generators of
high recall propose further, overlapping spans of each kind: spelled-out e-mail addresses, addresses with ports or in brackets,
phone numbers without a leading plus, card numbers with other separators; besides the longest matches, every sub-run of digit
groups and of domain labels that fits its kind, and bare runs of 7 to 15 digits. Boosted trees score each candidate on its format and
its context; a threshold for each kind, calibrated on held-out examples for precision, selects redactions; of overlapping
selected spans of one kind the most probable stays. Trees are trained on the driver, once in a process, and broadcast; their labelled examples are generated
from formats of personal data and of look-alikes (versions, hashes, dates, order numbers) in a fixed, seeded number.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Labelled candidates that the trees are trained and calibrated on.
EXAMPLES = 15000
#: Least share of true spans among calibration examples above a threshold.
PRECISION = 0.995
#: Characters on each side that context features see.
CONTEXT = 40

# The base patterns.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Generators of candidates.
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}|＠|@|&#64;)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\.)\s?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ._/-]{0,2}[0-9]{2,6}){2,5}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])"),
}
#: What a text must hold for a generator to be tried.
_NEEDS = {"email": re.compile(r"@|＠|&#64;|[\[({](?:at|dot)[\])}]"), "ip": _DIGIT, "card": _DIGIT, "phone": _DIGIT}
# Words that speak for a kind when they stand near.
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|addr|login|client)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|debit|cc|pan|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|tél|móvil|handy)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:version|release|build|order|invoice|isbn|ref|id|sha|commit|hash|date|page|section|serial|part|sku|figure|table)\b|[#v]$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its validation; no retry after one that fails."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:  # the same matches as _EMAIL.finditer, found from the @ signs
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out["email"].append((start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans of all generators."""
    return [(k, *m.span()) for k in KINDS if _NEEDS[k].search(text) for m in _WIDE[k].finditer(text)]


_DIGITS, _GAP, _IP_GAP = re.compile(r"[0-9]+"), re.compile(r"[ ._/()-]{0,4}"), re.compile(r"\s?(?:\[\.\]|\.)\s?")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([ ./-])[0-9]{1,2}\1[0-9]{1,2} $")
_LABEL_END = re.compile(r"[A-Za-z0-9-](?![A-Za-z0-9-])")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """``candidates`` and the shorter spans of the same kinds within and beside them; a bounded number for each digit group."""
    found = dict.fromkeys(candidates(text))
    for kind, start, end in list(found):
        if kind == "email":
            for m in _LABEL_END.finditer(text, start, end):
                if _WIDE["email"].fullmatch(text, start, m.end()):
                    found[kind, start, m.end()] = None
    groups = [m.span() for m in _DIGITS.finditer(text)]
    joined = [bool(_GAP.fullmatch(text, a[1], b[0])) for a, b in zip(groups, groups[1:])]
    dotted = [bool(_IP_GAP.fullmatch(text, a[1], b[0])) for a, b in zip(groups, groups[1:])]
    for i, (a, b) in enumerate(groups):
        if 7 <= b - a <= 15 and not text[a - 1 : a].isalpha() and not text[b : b + 1].isalpha():
            found["phone", a, b] = None
        if all(dotted[i : i + 3]) and i + 3 < len(groups) and all(y - x <= 3 for x, y in groups[i : i + 4]):
            found["ip", a, groups[i + 3][1]] = None
        starts = {a} | {a - n for n in (1, 2) if n <= a and text[a - n : a] in ("(", "+", "+(")}
        for j in range(i + 1, min(i + 6, len(groups))):
            if not joined[j - 1]:
                break
            end = groups[j][1]
            if _WIDE["card"].fullmatch(text, a, end):
                found["card", a, end] = None
            for start in starts:
                for stop in {end, end + (text[end : end + 1] == ")")}:
                    if not text[stop : stop + 1].isalnum() and _WIDE["phone"].fullmatch(text, start, stop):
                        found["phone", start, stop] = None
    return list(found)


def _beside(text: str) -> tuple[int, int]:
    """Lengths of the gap to the next digit group, and of that group, or zeros."""
    m = re.match(r"([ ._/()-]{0,4})([0-9]+)", text)
    return (len(m[1]), len(m[2])) if m else (0, 0)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span; labels and ids of documents play no part."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits, letters = _digits(span), sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    return [
        KINDS.index(kind), len(span), len(digits), letters, len(groups), max(groups, default=0), min(groups, default=0),
        luhn(digits) if digits else 0, all(int(g) <= 255 for g in re.findall(r"[0-9]{1,9}", span)), span.count("."), span.count("-"), span.count(" "),
        sum(span.count(c) for c in "()"), span.startswith("+"), span.startswith("00"), "@" in span, bool(re.search(r"at[\])}]", span)), len(set(digits)),
        bool(_CUES[kind].search(before)), bool(_CUES[kind].search(after)), bool(_AGAINST.search(before.rstrip())), before[-1:].isalnum(), after[:1].isalnum(),
        before[-1:] in ".,-_/=#:", after[:1] in "-_/=", sum(c.isdigit() for c in before[-12:]), sum(c.isdigit() for c in after[:12]),
        len(re.split(r"\.", span)[-1]), bool(re.search(r"[a-z]{2,6}$", span)), len(set(groups)),
        groups[0] if groups else 0, groups[-1] if groups else 0, groups[-2] if len(groups) > 1 else 0, bool(re.match(r"(?:19|20)[0-9]{2}(?![0-9])", span)), before[-1:] in "(+[", ". " in span,
        *_beside(before[::-1]), *_beside(after), bool(_DATE.search(before)), bool(_CUES[kind].search(before[-12:])), span.count("/"), span.count("(") - span.count(")"),
    ]


def _example(rng: random.Random) -> tuple[str, str, bool]:
    """(text, kind of the generator, whether its span is personal data)."""
    before, span, after, kind, true = _parts(rng)
    return before + span + after, kind, true


def _placed(rng: random.Random) -> tuple[str, str, bool, int, int]:
    """(text, kind, whether its span is personal data, start, end): an example whose span often stands beside other digits."""
    before, span, after, kind, true = _parts(rng)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "phone" and rng.random() < 0.2:
        span = num(10) if true else num(rng.choice([7, 8, 9, 12, 13, 14]))
        if not true:
            before = f"{rng.choice(['order', 'ref', 'id', 'serial', 'invoice'])} "
    if kind in ("phone", "card") and rng.random() < 0.5:
        date = rng.choice([f"20{num(2)}-{rng.randint(1, 12):02}-{rng.randint(10, 28)} ", f"20{num(2)} {rng.randint(1, 12):02} {rng.randint(10, 28)} ", f"{rng.choice(['room', 'page', 'on'])} {num(2)} ", f"{num(rng.randint(1, 3))} "])
        before += date if rng.random() < 0.7 else ""
        after = f" {num(rng.randint(1, 3))}{after}" if rng.random() < 0.3 else after
    if kind == "ip" and not true and rng.random() < 0.3:
        span += "".join(f".{rng.randint(0, 99)}" for _ in range(rng.randint(1, 2)))
    if kind == "email" and rng.random() < 0.3:
        after = f". {after.strip(' .,').capitalize()}"
    return before + span + after, kind, true, len(before), len(before) + len(span)


def _parts(rng: random.Random) -> tuple[str, str, str, str, bool]:
    """(text before the span, span, text after it, kind of the generator, whether the span is personal data)."""
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind, true = rng.choice(KINDS), rng.random() < 0.5
    if kind == "email":
        at, dot = rng.choice([("@", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("{at}", "{dot}"), ("＠", "."), ("&#64;", ".")])
        span = f"{word()}{rng.choice(['.', '_', ''])}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}" if true else (
            rng.choice([f"{word()} @ {num(2)}.{num(2)}", f"{word()}@{num(1)}.{num(2)}.{num(1)}", f"{word()} @{word()}. {word()}", f"{word()}[at]{num(3)}.{num(2)}"])
        )
    elif kind == "ip":
        part = lambda: str(rng.randint(0, 255))
        span = rng.choice([".", "[.]"]).join(part() for _ in range(4)) if true else rng.choice([
            ".".join(str(rng.randint(0, 20)) for _ in range(4)), ".".join(num(3) for _ in range(4)), " . ".join(part() for _ in range(4))])
    elif kind == "card":
        body = rng.choice("3456") + num(rng.choice([14, 14, 13]))
        body += next(d for d in "0123456789" if luhn(body + d))
        if not true:
            body = num(rng.choice([12, 14, 16, 18])) if rng.random() < 0.7 else body[:-1] + str((int(body[-1]) + 5) % 10)
            true = False
        sep = rng.choice([" ", "-", ".", "  ", ""])
        span = sep.join(body[i : i + 4] for i in range(0, len(body), 4))
    else:
        span = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(6)[:5]}", f"0{num(2)}/{num(3)} {num(4)}", f"+{num(2)} {num(3)}/{num(4)}"]) if true else rng.choice([
            f"20{num(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)}-{num(4)}", f"{num(2)} {num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(2)}.{num(4)}"])
    cue = {"email": ["email", "contact", "write"], "ip": ["host", "server", "ip"], "card": ["card", "visa", "credit"], "phone": ["tel", "phone", "call"]}[kind]
    against = ["version", "order", "ref", "build", "date", "page", "serial", "invoice"]
    near = rng.choice(cue) if rng.random() < (0.6 if true else 0.05) else rng.choice(against) if rng.random() < (0.02 if true else 0.4) else word()
    return f"{word()} {word()} {near}{rng.choice([' ', ': ', ' '])}", span, f"{rng.choice([' ', '. ', ', '])}{word()} {word()}", kind, true


@functools.lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the least probability that keeps ``PRECISION`` on examples not trained on."""
    rng = random.Random(11)
    rows, y, group, n = [], [], [], 0
    while len(y) < EXAMPLES:
        text, kind, true, start, end = _placed(rng)
        n += 1
        for k, a, b in proposals(text):
            rows.append(features(text, k, a, b))
            y.append(float(true and (k, a, b) == (kind, start, end)))
            group.append((n, k))
    x, y = np.array(rows, dtype=float), np.array(y)
    cut = len(y) * 2 // 3
    trees = Boosted(depth=4).fit(x[:cut], y[:cut])
    p, limits = trees.probability(x[cut:]), {}
    best: dict[tuple[int, str], int] = {}  # the most probable proposal of each text and kind, which the overlap rule keeps
    for i, g in enumerate(group[cut:]):
        if g not in best or p[i] > p[best[g]]:
            best[g] = i
    for kind in KINDS:
        own = np.array([i for (_, k), i in best.items() if k == kind])
        order = own[np.argsort(-p[own], kind="stable")]
        hits = np.cumsum(y[cut:][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(hits >= PRECISION)
        limits[kind] = max(0.5, float(p[order][good[-1]])) if len(good) else 1.1
    return trees, limits


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], fitted: tuple[Boosted, dict[str, float]] | None = None) -> list[tuple[str, int, int]]:
    """Selected candidates that overlap no base span; of overlapping ones of a kind, the most probable, then the first."""
    taken = Spans()
    for spans in base.values():
        for a, b in spans:
            taken.add(a, b)
    found = [(k, a, b) for k, a, b in proposals(text) if not taken.meets(a, b)]
    if not found:
        return []
    trees, limits = fitted or model()
    p = trees.probability(np.array([features(text, *f) for f in found], dtype=float))
    out: list[tuple[str, int, int]] = []
    chosen = {k: Spans() for k in KINDS}
    for _, (k, a, b) in sorted((-q, f) for q, f in zip(p, found) if q >= limits[f[0]]):
        if not chosen[k].meets(a, b):
            chosen[k].add(a, b)
            out.append((k, a, b))
    return out


class Spans:
    """A union of intervals, kept as sorted disjoint ones."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i, j = bisect.bisect_right(self.ends, a), bisect.bisect_left(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def listed(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _find(with_text: bool, fitted):
    def run(batches):
        for batch in batches:
            counts, digests, spans, texts = [[] for _ in KINDS], [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                own = [(k, a, b) for k in KINDS for a, b in base[k]]
                every = own + added_spans(text, base, fitted.value)
                for c, k in zip(counts, KINDS):
                    c.append(len(base[k]))
                digests.append(hashlib.sha256(listed(own).encode()).hexdigest())
                spans.append(listed(every))
                if with_text:
                    texts.append(redact(text, every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``<id_col>, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and, on request, ``redacted``.

    Counts and ``base_sha256`` are those of the base rules; ``spans`` lists base and added spans as kind:start:end in code
    points, by kind, then start. A null text counts as empty and has no spans. Null and repeated ids pass through;
    other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string" + ", redacted string" * with_text
    return rows.mapInArrow(_find(with_text, docs.sparkSession.sparkContext.broadcast(model())), schema).withColumnRenamed("id", id_col)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows and columns with personal data replaced in the text; a null text stays null."""
    position, fitted = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(position).to_pylist():
                if text is not None:
                    base = base_spans(text)
                    text = redact(text, [(k, a, b) for k in KINDS for a, b in base[k]] + added_spans(text, base, fitted.value))
                out.append(text)
            yield batch.set_column(position, batch.schema.names[position], pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
