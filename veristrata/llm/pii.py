"""Personal data (operator 10).

Exact patterns give the base spans. A semi-Markov conditional random field adds
more: it scores whole candidate segments, by features of the segment as a whole
(its shape and digit groups, separators, checksums, neighbours, the words before
it), and a dynamic program over segments of bounded length chooses boundaries
and types together: the set of segments apart from each other and from the base
spans whose scores, ``MARGIN`` taken off each, sum highest. A lone character
outside segments scores 0.

Besides the four kinds of the base, the field knows ``id`` (national numbers),
``iban`` and ``secret`` (keys, tokens and passwords), and other forms of the four:
spelled or spaced addresses, IPv6, national phone numbers, dotted cards.

The field is trained here, by the gradient of its exact log-likelihood (forward
and backward sums over segmentations), on labelled cases of written forms
(``pii_cases``), most of which no base pattern matches, and on the surroundings
of base spans in a bounded sample of documents (``SAMPLE_DOCS``).

Candidates are made in one pass over a text, with a bounded number for each place
(``LONGEST`` characters), scores of number shapes are remembered, and only
candidates worth more than ``MARGIN`` are kept, so time is linear in the text.

Defined results: a null or empty text has no spans; texts are read whole;
repeated rows give repeated results; columns other than the id and the text
play no part.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import in_batches
from veristrata.llm.pii_cases import cases

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the field gives.
MORE = ("id", "iban", "secret")
#: Training sample: so many documents with a digit or an at sign, none above so many characters; and so many written cases.
SAMPLE_DOCS, SAMPLE_CHARS, CASES = 300, 20_000, 700
#: Longest segment of digits and separators, in characters. Keys and passwords are taken whole, however long.
LONGEST = 40
EPOCHS, RATE, DECAY = 80, 0.7, 1e-3
#: What a span must score above nothing.
MARGIN = 1.5
#: Remembered shapes of numbers.
SHAPES = 50_000

HINT = re.compile("[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can't start inside a run of digits after failing at its start, so starts there are skipped.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")


def may_hold(text: str) -> bool:
    """Could a text hold a span of any kind?"""
    return HINT.search(text) is not None or SPELLED_HINT.search(text) is not None or VALUE.search(text) is not None


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 if d > 4 else d * 2 for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each at sign."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact patterns' spans, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


# ---- candidate segments and their features ----

NUMBERS = re.compile(r"[+(]{0,2}[0-9][0-9\x20().+/-]*+")
RUN = re.compile(r"[0-9]+")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(\x20?(?:@|\((?:at|AT)\)|\[(?:at|AT)\])\x20?|\x20(?:at|AT)\x20)((?:[A-Za-z0-9-]{1,63}(?:\.|\x20?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?|\x20(?:dot|DOT)\x20)){1,5}[A-Za-z0-9-]{2,63})")
#: Without one of these a text holds no spelled address.
SPELLED_HINT = re.compile(r"\x20dot\x20|\x20DOT\x20|[(\[](?:dot|DOT|at|AT)[)\]]|\x20@|@\x20")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
LETTERED_ID = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-Z](?![A-Za-z0-9])")
KEY = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+=/-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_=-]++(?:\.[A-Za-z0-9_=-]++)++")
VALUE = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\x20{0,2}[:=]\x20{0,2}[\"']?([^\s\"',;]{6,}+)")
#: Words before a segment that tell of its kind.
CONTEXT = {
    "email": "email e-mail mail contact write".split(),
    "ip": "ip host server address addr".split(),
    "card": "card visa mastercard amex credit".split(),
    "phone": "call tel phone mobile fax ring cell telephone".split(),
    "id": "ssn social security national id tax passport nino".split(),
    "iban": "iban account transfer bank".split(),
    "secret": "token password secret key apikey api_key pwd passwd auth".split(),
}
TOLD = {word: kind for kind, words in CONTEXT.items() for word in words}
WORD = re.compile(r"[a-z][a-z_-]*[a-z]")
NINES = str.maketrans("0123456789", "9999999999")

Candidate = tuple[int, int, str, list[str]]


def told(text: str, start: int) -> frozenset[str]:
    """Kinds that the words just before a place tell of."""
    return frozenset(TOLD[w] for w in WORD.findall(text[max(0, start - 28) : start].lower()) if w in TOLD)


def left_of(text: str, start: int) -> str:
    """What stands before a place: part of a word (w), a mark after a letter or digit (d), or something else (o)."""
    c = text[start - 1 : start]
    return "w" if c.isalnum() or c in ("_", "@") else "d" if c in (".", "-", "/", "+") and text[start - 2 : start - 1].isalnum() else "o"


def right_of(text: str, end: int) -> str:
    c = text[end : end + 1]
    return "w" if c.isalnum() or c in ("_", "@") else "d" if c in (".", "-", "/", "+") and text[end + 1 : end + 2].isalnum() else "o"


def number_features(shape: str) -> dict[str, list[str]]:
    """What a number's shape may be, and its features as that."""
    groups = RUN.findall(shape)
    n, gaps = sum(map(len, groups)), frozenset(shape) - {"9"}
    out: dict[str, list[str]] = {}
    exact = [f"shape{shape}", "groups" + "-".join(str(len(g)) for g in groups)] if len(shape) <= 20 else []
    marks = "gaps" + "".join(sorted(gaps))
    if gaps == {"."} and len(groups) in (3, 4, 5, 6) and ".." not in shape:
        out["ip"] = [f"parts{len(groups)}"]
    if not gaps - set(" -.") and 12 <= n <= 19 and shape[0] == "9":
        out["card"] = [f"size{n}", f"even{len(set(map(len, groups[:-1]))) <= 1 and len(groups) in (1, 3, 4)}", marks]
    if n >= 7 and n <= 15 and shape.count("+") <= 1 and ("+" not in shape[1:]) and shape.count("(") == shape.count(")") <= 1 and "/" not in shape.replace("9/9", "99", 1):
        out["phone"] = [f"plus{shape[0] == '+'}", f"size{n}", f"groups{min(len(groups), 6)}", f"brackets{'(' in shape}", marks, *exact]
    if not gaps - set(" -") and 8 <= n <= 12 and shape[0] == "9":
        out["id"] = [f"size{n}", f"groups{min(len(groups), 6)}", *exact]
    return out


class Shapes(dict):
    """Shape of a number to its features by kind."""

    def __missing__(self, shape: str) -> dict[str, list[str]]:
        if len(self) >= SHAPES:
            self.clear()
        got = self[shape] = number_features(shape)
        return got


_shapes = Shapes()


def stretches(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Every stretch of digit groups of 4 to 19 digits: (start, end, its first digit, what stands beside it)."""
    for m in NUMBERS.finditer(text):
        groups = [g.span() for g in RUN.finditer(text, *m.span())]
        if len(groups) == 1 and not 8 <= groups[0][1] - groups[0][0] <= 19:
            continue
        rights = [right_of(text, e) for _, e in groups]
        for a, (first, _) in enumerate(groups):
            starts = [(first, left_of(text, first))]
            while len(starts) < 3 and starts[-1][0] > m.start() and text[starts[-1][0] - 1] in "+(":
                starts.append((starts[-1][0] - 1, left_of(text, starts[-1][0] - 1)))
            n = 0
            for b in range(a, len(groups)):
                end = groups[b][1]
                n += end - groups[b][0]
                if end - first > LONGEST or n > 19:
                    break
                if n >= 4:
                    for start, left in starts:
                        yield start, end, first, left + rights[b]


def context(kind: str, beside: str, lead: frozenset[str]) -> list[str]:
    return [f"{kind}:", f"{kind}:edge{beside}", f"{kind}:told{kind in lead}", f"{kind}:toldother{bool(lead - {kind})}"]


def checked(kind: str, span: str) -> str | None:
    """The feature of a kind that takes the digits themselves."""
    if kind == "ip":
        return f"ip:range{span.count('.') == 3 and small_parts(span)}"
    if kind == "card":
        return f"card:luhn{13 <= len(d := NOT_DIGITS.sub('', span)) <= 19 and luhn(d)}"
    return None


def numbers(text: str) -> Iterator[Candidate]:
    """Every stretch of digit groups that could be of a kind."""
    for start, end, first, beside in stretches(text):
        span = text[start:end]
        for kind, static in _shapes[span.translate(NINES)].items():
            check = checked(kind, span)
            yield start, end, kind, [*context(kind, beside, told(text, first)), *(f"{kind}:{x}" for x in static), *([check] if check else [])]


def scored(text: str, weight: dict[str, float], known: dict) -> Iterator[tuple[int, int, str, float]]:
    """Candidates with their scores. ``known`` remembers the scores of number shapes."""
    at, lead = -1, frozenset()
    for start, end, first, beside in stretches(text):
        if first != at:
            at, lead = first, told(text, first)
        span = text[start:end]
        key = (span.translate(NINES), beside, lead)
        kinds = known.get(key)
        if kinds is None:
            if len(known) >= SHAPES:
                known.clear()
            kinds = known[key] = [(kind, sum(weight.get(x, 0.0) for x in [*context(kind, beside, lead), *(f"{kind}:{x}" for x in static)])) for kind, static in _shapes[key[0]].items()]
        for kind, score in kinds:
            check = checked(kind, span) if kind == "ip" or kind == "card" else None
            yield start, end, kind, score + weight.get(check, 0.0) if check else score
    for start, end, kind, f in lettered(text):
        yield start, end, kind, sum(weight.get(x, 0.0) for x in f)


def lettered(text: str) -> Iterator[Candidate]:
    """Candidates with letters: spelled addresses, IPv6, account numbers, lettered national numbers, keys."""

    def make(kind: str, start: int, end: int, more: list[str]) -> Candidate:
        return start, end, kind, [*context(kind, left_of(text, start) + right_of(text, end), told(text, start)), *(f"{kind}:{x}" for x in more)]

    if SPELLED_HINT.search(text):
        for m in SPELLED.finditer(text):
            labels = re.split(r"[^A-Za-z0-9-]+|\x20", m[2])
            yield make("email", *m.span(), ["spelled", f"at{m[1].strip().lower()}", f"end{labels[-1].lower() if len(labels[-1]) <= 4 else 'long'}", f"endsize{min(len(labels[-1]), 5)}", f"spaced{' ' in m[2]}"])
    if ":" in text:
        for m in IPV6.finditer(text):
            yield make("ip", *m.span(), [f"six{is_ipv6(m[0])}", f"long{m.end() - m.start() > 8}"])
    for m in IBAN.finditer(text):
        value = m[0].replace(" ", "")
        yield make("iban", *m.span(), [f"sum{int(''.join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1}", f"size{15 <= len(value) <= 34}"])
    for m in LETTERED_ID.finditer(text):
        yield make("id", *m.span(), ["lettered", f"last{m[0][-1] in 'ABCD'}"])
    taken, past = set(), 0
    for m in KEY.finditer(text):
        start, end = m.start(), m.end()
        if start < past:
            continue
        if text.startswith("eyJ", start) and (joined_parts := TOKEN.match(text, start)):  # the parts of a signed token are one secret
            end = past = joined_parts.end()
        while end > start and text[end - 1] in "-=/+" and not text[end - 1] == "=":
            end -= 1
        taken.add((start, end))
        yield make("secret", start, end, key_features(text, start, end))
    if "=" in text or ":" in text:
        for m in VALUE.finditer(text):
            if m.span(1) not in taken:
                yield make("secret", *m.span(1), ["value", *key_features(text, *m.span(1))])


def is_ipv6(x: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(x))
    except ValueError:
        return False


def key_features(text: str, start: int, end: int) -> list[str]:
    key = text[start:end]
    lead = text[max(0, start - 3) : start].rstrip("\"' ")
    some = [any(c.islower() for c in key), any(c.isupper() for c in key), any(c.isdigit() for c in key)]
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(key, key[1:]))
    dashes = sum(map(key.count, "-_/"))
    return [f"size{min(len(key) // 8, 8)}", f"hex{set(key) <= set('0123456789abcdef')}", f"mixed{sum(some)}", f"changes{min(4, 8 * changes // len(key))}", f"dashes{min(dashes, 4)}", f"assigned{lead[-1:] in ('=', ':')}", f"quoted{text[start - 1 : start] in tuple('\"' + chr(39))}"]


def candidates(text: str) -> Iterator[Candidate]:
    yield from numbers(text)
    yield from lettered(text)


# ---- the field ----


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _sums(n: int, cands: list[tuple[int, int]], scores: list[float]) -> tuple[list[float], list[float]]:
    """Log-sums over all segmentations before, and from, each of ``n`` places. What is outside spans scores 0."""
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(cands):
        ends.setdefault(j, []).append(k)
        starts.setdefault(i, []).append(k)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        total = forward[j - 1]
        for k in ends.get(j, ()):
            total = _log_add(total, forward[cands[k][0]] + scores[k])
        forward[j] = total
    for i in range(n - 1, -1, -1):
        total = backward[i + 1]
        for k in starts.get(i, ()):
            total = _log_add(total, backward[cands[k][1]] + scores[k])
        backward[i] = total
    return forward, backward


def train(labelled: Iterable[tuple[str, set[tuple[str, int, int]]]]) -> dict[str, float]:
    """Weights that maximise the regularised likelihood of labelled texts (text, spans)."""
    seen: dict[tuple, int] = {}
    for text, truth in labelled:
        cands = list(candidates(text))
        places = {p: i for i, p in enumerate(sorted({p for s, e, *_ in cands for p in (s, e)}))}
        key = (len(places), tuple((places[s], places[e], tuple(f), (kind, s, e) in truth) for s, e, kind, f in cands))
        if cands:
            seen[key] = seen.get(key, 0) + 1
    items = [(math.sqrt(c), n, cands) for (n, cands), c in seen.items()]
    total = sum(c for c, *_ in items) or 1
    weight: dict[str, float] = {}
    square: dict[str, float] = {}
    for _ in range(EPOCHS):
        slope: dict[str, float] = {x: -DECAY * v for x, v in weight.items()}
        for c, n, cands in items:
            scores = [sum(weight.get(x, 0.0) for x in f) for _, _, f, _ in cands]
            forward, backward = _sums(n, [(i, j) for i, j, *_ in cands], scores)
            for (i, j, f, gold), score in zip(cands, scores, strict=True):
                g = gold - math.exp(min(0.0, forward[i] + score + backward[j] - forward[n]))
                if abs(g) > 1e-4:
                    for x in f:
                        slope[x] = slope.get(x, 0.0) + c * g / total
        for x, g in slope.items():
            square[x] = square.get(x, 0.0) + g * g
            weight[x] = weight.get(x, 0.0) + RATE * g / math.sqrt(square[x] + 1e-12)
    return weight


def decode(found: list[tuple[int, int, str, float]]) -> list[tuple[str, int, int]]:
    """The segments (start, end, kind, score) apart from each other whose scores sum highest; ties to fewer and earlier ones."""
    found = sorted(found, key=lambda x: (x[1], x[0], x[2]))
    ends = [e for _, e, *_ in found]
    best, take = [0.0], []
    for s, _, _, score in found:
        before = best[bisect_right(ends, s, 0, len(take))]
        take.append(before + score > best[-1])
        best.append(max(best[-1], before + score))
    out, k = [], len(found)
    while k:
        if take[k - 1]:
            s, e, kind, _ = found[k - 1]
            out.append((kind, s, e))
            k = bisect_right(ends, s, 0, k - 1)
        else:
            k -= 1
    return out[::-1]


#: Scores of number shapes under the last weights seen.
_known: tuple[dict[str, float], dict] = ({}, {})


def added_spans(text: str, base: list[tuple[str, int, int]], weight: dict[str, float]) -> list[tuple[str, int, int]]:
    """The field's spans, which overlap no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach: list[int] = []  # how far base spans up to each one go
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    found = []
    global _known
    if _known[0] is not weight:
        _known = (weight, {})
    for s, e, kind, score in scored(text, weight, _known[1]):
        score -= MARGIN
        if score > 0 and not ((k := bisect_right(starts, e - 1)) and reach[k - 1] > s):
            found.append((s, e, kind, score))
    return decode(found)


def surroundings(text: str) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """Each base span of a text with what stands around it, as a case of its own. Base spans overlap at times: the longest counts."""
    base = base_spans(text)
    for kind, s, e in base:
        lo, hi = max(0, s - 30), min(len(text), e + 10)
        near = [x for x in base if x[1] < hi and lo < x[2]]
        if kind != "email" and len(near) == 1:
            yield text[lo:hi], {(kind, s - lo, e - lo)}


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, float]:
    """Train on written cases and a bounded sample of the corpus: the different texts of smallest hash that hold a digit or an at sign."""
    fit_for = docs.select("text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("text", F.xxhash64("text").alias("h"))
    chosen = fit_for.select("h").distinct().orderBy("h").limit(sample_docs)
    rows = fit_for.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h").limit(sample_docs).collect()
    return train([*cases(CASES), *(c for r in rows for c in surroundings(r["text"]))])


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: ((*KINDS, *MORE).index(x[0]), x[1], x[2])))


def find(docs: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, and how many these are."""
    weight = fit(docs) if weight is None else weight

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                base, more = [], []
                if text and may_hold(text):
                    base = base_spans(text)
                    more = added_spans(text, base, weight)
                n = [sum(k == kind for k, *_ in base) for kind in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(base) + len(more)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]).astype({"doc_id": "Int64"})

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """The same rows and columns, with every span of ``text`` masked. Null stays null."""
    weight = fit(docs) if weight is None else weight

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if not text or not may_hold(text):
                return text
            base = base_spans(text)
            return mask(text, base + added_spans(text, base, weight))

        return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)

    return in_batches(docs).withColumn("text", clean("text"))
