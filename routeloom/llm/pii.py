"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field cuts a region of text (the tokens near a digit, an at sign or a bracketed "at") into segments, each an entity of at
most MAX_TOKENS tokens with a type, or one plain token. Features look at a whole candidate segment: its shape, digit count,
token count, signs, checksum and octet range, and its neighbours. Training maximises the likelihood of labelled segmentations
with forward and backward sums; decoding finds the best one by dynamic programming over bounded entities, which chooses
boundaries and types together. An entity must hold a sign, so text outside the regions cannot be part of one and is skipped
without changing the result.

Labels come from a bounded sample of regions (``sample_regions``; one of more than SAMPLE_TOKENS tokens is cut). Each is used as
it is, with the base spans as entities, and again with every base span rewritten in a form that the base patterns don't know
(a bracketed at or dot, other separators, no plus sign) as an entity still, and with every base span replaced by a number that
is no personal data (an amount, a date, a version, digits that fail the check) as plain text. So the field learns the forms in
the texts' own contexts, and adds spans that the base patterns miss.

Base spans always stay; a decoded entity that overlaps none of them is added. Positions are code points, ends exclusive.

Defined results: null text counts as empty and has no span; repeated rows get the same spans; without a sample nothing is
added; an empty table gives an empty result. Base patterns are leftmost and non-overlapping for each kind; a match that
fails its check is dropped without another try.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 5
SAMPLE_TOKENS = 120
DIM = 1 << 13

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]|[(\[{][Aa][Tt][)\]}]")
_TOKEN = re.compile(r"\S+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Linear in the text: a match runs from the start of the signs before an at sign, if a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind as listed."""
    if not _SIGN.search(text):
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token bounds around tokens with a sign, with all that an entity may hold before and after it."""
    out: list[list[tuple[int, int]]] = []
    before: deque[tuple[int, int]] = deque(maxlen=MAX_TOKENS)  # one more than an entity, as context
    wait = 0
    for m in _TOKEN.finditer(text) if _SIGN.search(text) else ():
        token = m.span()
        if _SIGN.search(m[0]):
            if not wait:
                out.append(list(before))
            out[-1].append(token)
            wait = MAX_TOKENS
        elif wait:
            out[-1].append(token)
            wait -= 1
        if wait:
            before.clear()
        else:
            before.append(token)
    return out


_OPEN, _CLOSE = "\"'<[{", "\"'>]},.;:!?"


def segment_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Bounds of a segment without quotes and punctuation around it; a bracket goes if it has no partner."""
    while start < end and (text[start] in _OPEN or (text[start] == "(" and ")" not in text[start:end])):
        start += 1
    while end > start and (text[end - 1] in _CLOSE or (text[end - 1] == ")" and "(" not in text[start:end])):
        end -= 1
    return start, end


_AT, _DOT = re.compile(r"[(\[{][Aa][Tt][)\]}]"), re.compile(r"\.|[(\[{][Dd][Oo][Tt][)\]}]")
_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SHAPES = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\W\d_]+"), "a")]


def shape(s: str) -> str:
    """Runs of digits, capitals and letters as one sign each."""
    for pattern, sign in _SHAPES:
        s = pattern.sub(lambda m, c=sign: c if c != "a" or m[0] != "A" else "A", s)
    return s


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Hashed features of the candidate segment of tokens i to j, without its type."""
    s, e = segment_span(text, tokens[i][0], tokens[j - 1][1])
    body = text[s:e]
    digits = "".join(c for c in body if c in "0123456789")
    n = len(digits)
    form = shape(body)
    letters = any(c.isalpha() for c in body)
    names = ["bias", f"shape={form}", f"tokens={j - i}", f"digits={min(n, 20)}", f"tokens={j - i},digits={min(n, 20)}", f"letters={letters}", f"at={body.count('@')}", f"dots={min(4, body.count('.'))}", f"plus={body.startswith('+')}"]
    at = _AT.search(body)
    names.append(f"spelt={bool(at)},{bool(_DOT.search(body, at.end()) if at else '.' in body)},{j - i}")
    names.append(f"ends={form[:2]},{form[-2:]}")
    names.append(f"separators={''.join(sorted(set(body) - _ALNUM))},{min(n, 20)}")
    names.append(f"bracket={'(' in body},plus={body.startswith('+')},phone={10 <= n <= 15}")
    names.append(f"luhn={not letters and 14 <= n <= 19 and luhn(digits)}")
    if form == "9.9.9.9":
        names.append(f"octets={all(len(p) < 4 and int(p) <= 255 for p in body.split('.'))}")
    if "@" in body:
        names.append(f"mail={shape(body[body.rfind('@') :])}")
    if i:
        names.append(f"before={shape(text[tokens[i - 1][0] : tokens[i - 1][1]])[-3:]}")
    if j < len(tokens):
        names.append(f"after={shape(text[tokens[j][0] : tokens[j][1]])[:3]}")
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % DIM for x in names]


class SemiCrf:
    """Weights of (type, feature); type 0 is plain text."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS) + 1, DIM)) if weights is None else weights

    def allowed(self, text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[list[int], list[float | None]] | None:
        """Features of a candidate segment and the score of each type, None where the type is not allowed; None for no candidate."""
        sign = bool(_SIGN.search(text, tokens[i][0], tokens[j - 1][1]))
        if j > i + 1 and not sign:
            return None
        f = features(text, tokens, i, j)
        s = self.weights[:, f].sum(1).tolist()
        return f, [s[0] if j == i + 1 else None, *(s[1:] if sign else [None] * len(KINDS))]

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """Entities of the best segmentation; ties go to plain text, then shorter segments. Kept are two numbers for each token."""
        best, back = [0.0] + [-math.inf] * len(tokens), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            for i in range(j - 1, max(-1, j - MAX_TOKENS - 1), -1):
                _, score = self.allowed(text, tokens, i, j) or (None, ())
                for y, s in enumerate(score):
                    if s is not None and best[i] + s > best[j]:
                        best[j], back[j] = best[i] + s, (i, y)
        out, j = [], len(tokens)
        while j:
            i, y = back[j]
            if y:
                out.append((KINDS[y - 1], *segment_span(text, tokens[i][0], tokens[j - 1][1])))
            j = i
        return out[::-1]

    def gradient(self, text: str, tokens: list[tuple[int, int]], gold: list[tuple[int, int, int]]) -> dict[tuple[int, int], list[tuple[int, float]]]:
        """For each segment's features: (type, gold count less expected count)."""
        n = len(tokens)
        found = {(i, j): x for i in range(n) for j in range(i + 1, min(n, i + MAX_TOKENS) + 1) if (x := self.allowed(text, tokens, i, j))}
        feats, score = {k: f for k, (f, _) in found.items()}, {k: s for k, (_, s) in found.items()}
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        joint = {k: np.logaddexp.reduce([x for x in v if x is not None]) for k, v in score.items() if any(x is not None for x in v)}
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[i] + joint[i, j] for i in range(max(0, j - MAX_TOKENS), j) if (i, j) in joint])
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([joint[i, j] + beta[j] for j in range(i + 1, min(n, i + MAX_TOKENS) + 1) if (i, j) in joint])
        right = {(i, j): y for i, j, y in gold}
        return {(i, j): (feats[i, j], [(y, float(right.get((i, j)) == y) - math.exp(alpha[i] + s + beta[j] - alpha[n])) for y, s in enumerate(v) if s is not None]) for (i, j), v in score.items()}

    def fit(self, examples: list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]], epochs: int = 4, rate: float = 0.3) -> SemiCrf:
        """Stochastic gradient ascent of the likelihood, with adaptive steps."""
        seen = np.full_like(self.weights, 1.0)
        for _ in range(epochs):
            for text, tokens, gold in examples:
                for f, parts in self.gradient(text, tokens, gold).values():
                    for y, g in parts:
                        if abs(g) > 1e-4:
                            seen[y, f] += g * g
                            self.weights[y, f] += rate * g / np.sqrt(seen[y, f])
        return self


def example(text: str, spans: list[Span]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]] | None:
    """A training region: tokens, and the segmentation that the spans give. None if a span's bounds can't be those of a segment."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    gold, i = [], 0
    cover = {}
    for kind, s, e in spans:
        inside = [t for t, (a, b) in enumerate(tokens) if a < e and b > s]
        if not inside or len(inside) > MAX_TOKENS or segment_span(text, tokens[inside[0]][0], tokens[inside[-1]][1]) != (s, e):
            return None
        cover.setdefault(inside[0], (inside[-1] + 1, KINDS.index(kind) + 1))
    while i < len(tokens):
        j, y = cover.get(i, (i + 1, 0))
        gold.append((i, j, y))
        i = j
    return (text, tokens, gold) if tokens else None


def rewritten(kind: str, body: str, seed: int) -> str:
    """A base span in a form that the base patterns don't know."""
    digits = "".join(c for c in body if c.isdigit())
    if kind == "email":
        name, _, domain = body.partition("@")
        at, dot = [("(at)", "."), ("[at]", "."), ("{at}", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")][seed % 8]
        return name + at + domain.replace(".", dot, 1 if " " in dot else -1)
    if kind == "ip":
        return body.replace(".", ["[.]", "(.)", "[.]"][seed % 3])
    if kind == "card":
        sign = [".", "/", "_", " . "[1]][seed % 4]
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:]
    return [f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"00{digits}", f"{own[:3]}.{own[3:6]}.{own[6:]}", f"00 {digits[:-10]} {own[:3]} {own[3:6]} {own[6:]}".replace("  ", " ")][seed % 5]


def harmless(seed: int) -> str:
    """A number that is no personal data."""
    a, b, c = seed % 89 + 10, seed // 89 % 89 + 10, seed // 7921 % 9 + 1
    wrong = next(x for i in range(10) if not luhn(x := f"4{a}{b}{seed % 10**8:08d}{c}{a % 10}{i}"))
    return [f"{a}", f"{a}.{b}", f"20{a}-{c:02d}-{b % 28 + 1:02d}", f"{c}.{a}.{b}", f"{a},{b}0", f"{a}:{b}", f"{a}{b}{c}", f"v{c}.{a}", f"{a}%", f"{c}{a}{b}{seed % 10**6:06d}", wrong, f"3{a}.4{b}.5{a}.6{b}"][seed % 12]


def replaced(text: str, spans: list[Span], put) -> tuple[str, list[Span]]:
    """The text with each span's body put in anew, and where the new bodies are."""
    out, found, done, size = [], [], 0, 0
    for kind, s, e in spans:
        body = put(kind, text[s:e])
        out += [text[done:s], body]
        size += s - done
        found.append((kind, size, size + len(body)))
        size += len(body)
        done = e
    return "".join(out) + text[done:], found


def labelled(region: str) -> list[Span]:
    """Spans that a region is labelled with: base ones that don't overlap, and single tokens outside them that pass a base pattern alone, as two numbers side by side do that the pattern takes for one."""
    spans, last = [], 0
    for x in base_spans(region):
        if x[1] >= last:
            spans.append(x)
            last = x[2]
    for m in _TOKEN.finditer(region):
        s, e = segment_span(region, *m.span())
        if not any(a < e and b > s for _, a, b in spans):
            spans += [(kind, s, e) for kind, a, b in base_spans(region[s:e])[:1] if (a, b) == (0, e - s)]
    return sorted(spans, key=lambda x: x[1])


def examples(region: str) -> list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]]:
    """A region as it is, with its base spans rewritten, and with them replaced by harmless numbers."""
    spans = labelled(region)
    seed = int.from_bytes(hashlib.blake2b(region.encode(), digest_size=6).digest(), "little")
    found = [example(region, spans)]
    if spans:
        for i in range(2):
            found.append(example(*replaced(region, spans, lambda kind, body, i=i: rewritten(kind, body, seed + i))))
            found.append(example(replaced(region, spans, lambda kind, body, i=i: harmless(seed // 13 + i))[0], []))
    return [x for x in found if x]


def fit(docs: DataFrame, sample_regions: int = 200, text: str = "text") -> SemiCrf:
    """Trains on regions that come first by hash, at most sample_regions of them with a base span and as many others, of the whole table's texts."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, 200) for batch in it for i in range(0, batch.num_rows, 200)):
            found = [t[r[i][0] : r[min(len(r), i + SAMPLE_TOKENS) - 1][1]] for t in b.column(0).to_pylist() for r in regions(t) for i in range(0, len(r), SAMPLE_TOKENS)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([bool(base_spans(x)) for x in found])], ["region", "marked"])

    rows = docs.select(text).filter(F.col(text).rlike(_SIGN.pattern)).mapInArrow(cut, "region string, marked boolean").distinct()
    # the hash comes first, and a shorter list of each partition at a time: only the sample reaches the driver
    sample = [r.region for marked in (True, False) for r in rows.filter(F.col("marked") == marked).orderBy(F.md5("region")).limit(sample_regions).collect()]
    sample.sort(key=lambda x: hashlib.md5(x.encode()).digest())
    return SemiCrf().fit([x for r in sample for x in examples(r)])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(text: str | None, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those that the model adds."""
    if not text or not _SIGN.search(text):
        return [], []
    base = base_spans(text)
    added = [x for r in regions(text) for x in model.decode(text, r) if x[1] < x[2] and not any(s < x[2] and e > x[1] for _, s, e in base)]
    return base, sorted(set(base) | set(added), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _mapped(docs: DataFrame, model: SemiCrf, row, fields: list[T.StructField], drop_text: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    docs = docs.select("text", *[c for c in docs.columns if c not in {"text"} | {f.name for f in fields}]) if drop_text else docs
    kept = [f for f in docs.schema.fields if f.name != "text"] if drop_text else docs.schema.fields

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiCrf(shared.value)
        for b in (batch.slice(i, 200) for batch in it for i in range(0, max(1, batch.num_rows), 200)):
            found = [row(t, *find(t, own)) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            more = [pa.array([x[i] for x in found], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), *more], [*(f.name for f in kept), *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*kept, *fields]))


def annotate(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """Columns of docs but text, with n_email, n_ip, n_card, n_phone, base_sha256 and spans."""

    def row(_, base, spans):
        return (*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return _mapped(docs, model, row, fields, True)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, done = [], 0
    for kind, s, e in spans:
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:] if spans else text


def redact(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """docs with personal data in text masked."""
    found = _mapped(docs, model, lambda t, _, spans: (masked(t, spans),), [T.StructField("_masked", T.StringType())], False)
    return found.withColumn("text", F.col("_masked")).select(docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, fit(docs))
