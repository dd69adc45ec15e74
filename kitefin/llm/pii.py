"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns give the base spans. Where a text has digits or an `@`, a window of tokens around them goes to a
semi-Markov CRF: every segment of up to MAX_TOKENS tokens is scored as a whole for each type, and dynamic programming
over segments, bounded by that length, chooses boundaries and types jointly. What it finds beside the base spans is
added. The model is trained when first needed, by maximum likelihood on windows made from a fixed seed; it has the
same few hundred weights whatever the data.
"""

from __future__ import annotations

import collections
import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_groups

#: Kinds in the order in which spans with equal starts are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "ssn")
BASE = KINDS[:4]
FINDINGS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
#: Of an entity segment.
MAX_TOKENS = 17
FEWEST_DIGITS, MOST_DIGITS = 7, 19
TRAIN_WINDOWS, TRAIN_STEPS, SEED = 400, 30, 9
#: An added span's score is above that of no entity by so much at least.
MARGIN = 1.5
#: Scores that a worker remembers.
MOST_KNOWN = 200_000

# Runs are matched from their starts and once, so that long ones take linear time.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")

_CHUNK, _HOT = re.compile(r"\S+"), re.compile(r"[0-9@]")
#: Of the chunks of text before and after one that has a digit or an at sign, as many and so many characters are looked at.
BEFORE, AFTER, CHUNK_CHARS = 3, 1, 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): leftmost non-overlapping matches of each kind that pass its test."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    if _DIGITS.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# The semi-Markov CRF.


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Spans of text with digits or at signs, with a few words around them, merged where they overlap."""
    held: list[int] = []
    before: collections.deque[tuple[int, int]] = collections.deque(maxlen=BEFORE)
    open_ = 0  # chunks that may still follow
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        if _HOT.search(text, a, b):
            low = a
            for x, y in reversed(before):
                low = max(x, y - CHUNK_CHARS)
                if low > x:
                    break
            if held and low <= held[1]:
                held[1] = b
            else:
                if held:
                    yield held[0], held[1]
                held = [low, b]
            open_ = AFTER
        elif held and open_ and held[1] < a:
            held[1] = min(b, a + CHUNK_CHARS)
            open_ = open_ - 1 if held[1] == b else 0
        before.append((a, b))
    if held:
        yield held[0], held[1]


def _shape(tokens: list[str]) -> str:
    return "".join(f"d{min(len(t), 9)}" if t.isdigit() else "a" if t[0].isalpha() else " " if t.isspace() else t for t in tokens)


_CUES = {w: c for c, words in {"phone": "phone tel telephone call mobile fax cell", "email": "email mail e contact write", "ip": "ip host address server login", "card": "card visa credit payment debit", "ssn": "ssn social security taxpayer", "other": "version v no order page item id ref date chapter year section price prices total sum count size rows"}.items() for w in words.split()}


def _cue(tokens: list[str], start: int) -> str:
    words = [t.lower() for t in tokens[max(0, start - 6) : start] if t.isalpha()]
    return next((_CUES[w] for w in reversed(words) if w in _CUES), "none")


def span_features(tokens: list[str], start: int, end: int) -> list[str]:
    """Of the segment as a whole."""
    part = tokens[start:end]
    text = "".join(part)
    digits = "".join(t for t in part if t.isdigit())
    shape = _shape(part)
    groups = re.findall(r"d[0-9]", shape)
    marks = "".join(sorted(set(re.sub(r"d[0-9]|a", "", shape))))
    domain = text.rpartition("@")[2]
    alone = (start == 0 or not tokens[start - 1].isalnum()) and (end == len(tokens) or not tokens[end].isalnum())
    out = [f"groups={''.join(groups)}", f"marks={marks}", f"digits={min(len(digits), 20)}", f"first={shape[0]}", f"alone={alone}", f"at={text.count('@')}", f"letters={any(t.isalpha() for t in part)}", f"cue={_cue(tokens, start)}"]
    if len(digits) >= 13:
        out.append(f"luhn={luhn(digits) and len(digits) <= 19}")
    if text.count(".") == 3 and len(groups) == 4 and marks == ".":
        out.append(f"octets={octets(text)}")
    if "@" in text:
        out.append(f"domain={bool(re.fullmatch(r'[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}', domain))}")
        out.append(f"local={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+', text.partition('@')[0]))}")
    return out + [f"next={_beside(tokens, end)}", f"before={_beside(tokens, start - 1)}"]


def _beside(tokens: list[str], k: int) -> str:
    if not 0 <= k < len(tokens):
        return ""
    return "d" if tokens[k].isdigit() else "a" if tokens[k].isalpha() else tokens[k][0]


def ends_of(tokens: list[str], a: int) -> list[int]:
    """Ends of the candidates that start at a: up to MAX_TOKENS tokens of what entities consist of, no blank or closing
    mark at the ends, with one at sign and a dot behind it, or with no letters and FEWEST_DIGITS to MOST_DIGITS digits, or three dots."""
    out: list[int] = []
    if not (tokens[a].isalnum() or tokens[a] in "+("):
        return out
    digits = dots = 0
    letter = at = domain = blank = False
    for b in range(a + 1, min(len(tokens), a + MAX_TOKENS) + 1):
        last = tokens[b - 1]
        if last.isdigit():
            digits += len(last)
        elif last.isalpha():
            letter = True
        elif last == ".":
            dots += 1
            domain = domain or at
        elif last == "@":
            if at:
                break
            at = True
        elif last in " ()":
            blank = True
        elif last not in "+-_%":
            break
        if at and blank:
            break
        if not at and (letter or digits > MOST_DIGITS) and "@" not in tokens[b : a + MAX_TOKENS]:
            break
        if last.isalnum() and (domain or not at and not letter and (FEWEST_DIGITS <= digits <= MOST_DIGITS or dots == 3 and digits)):
            out.append(b)
    return out


def segments(tokens: list[str]) -> list[tuple[int, int]]:
    return [(a, b) for a in range(len(tokens)) for b in ends_of(tokens, a)]


class SemiCRF:
    """Segments are `no entity` of one token, score 0, or entities, whose score is the sum of their features' weights."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        #: Of segments without an at sign, by all that their features depend on.
        self.known: dict[tuple, tuple[int, float]] = {}

    def score(self, tokens: list[str], a: int, b: int, cue: str) -> tuple[int, float]:
        """The best kind of a segment, and its score."""
        part, key = tokens[a:b], None
        if "@" not in part:
            text = "".join(part)
            digits = [t for t in part if t.isdigit()]
            long = sum(map(len, digits)) >= 13 and luhn("".join(digits))
            four = text.count(".") == 3 and len(digits) == 4 and octets("".join(t for t in part if t.isdigit() or t == "."))
            key = (_shape(part), cue, long, four, _beside(tokens, a - 1), _beside(tokens, b))
            if key in self.known:
                return self.known[key]
        total = sum((self.weights[f] for f in span_features(tokens, a, b) if f in self.weights), np.zeros(len(KINDS)))
        found = int(total.argmax()), float(total.max())
        if key:
            if len(self.known) > MOST_KNOWN:
                self.known = {}
            self.known[key] = found
        return found

    def fit(self, windows: list[tuple[list[str], list[tuple[int, int, int]]]], steps: int = TRAIN_STEPS) -> SemiCRF:
        """Maximum likelihood with a quadratic penalty, by adaptive gradient steps over all windows at once."""
        number: dict[str, int] = {}
        data = []
        for tokens, truth in windows:
            cut = segments(tokens)
            features = [[number.setdefault(f, len(number)) for f in span_features(tokens, a, b)] for a, b in cut]
            data.append((len(tokens), cut, features, {(a, b): k for a, b, k in truth}))
        w, squares = np.zeros((len(number), len(KINDS))), np.full((len(number), len(KINDS)), 1e-6)
        for _ in range(steps):
            gradient = -0.02 * w
            for n, cut, features, truth in data:
                if not cut:
                    continue
                scores = np.array([w[f].sum(0) for f in features])
                chance = self._marginals(n, cut, scores)
                for s, f in enumerate(features):
                    g = -chance[s]
                    if cut[s] in truth:
                        g[truth[cut[s]]] += 1
                    if np.abs(g).max() > 1e-5:
                        gradient[f] += g
            squares += gradient**2
            w += 0.6 * gradient / np.sqrt(squares)
        self.weights = {f: w[k] for f, k in number.items()}
        return self

    @staticmethod
    def _marginals(n: int, cut: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        """P(segment, kind), by the forward and backward sums over segmentations."""
        joint = np.logaddexp.reduce(scores, axis=1)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (a, b) in enumerate(cut):
            ends[b].append(s)
            starts[a].append(s)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for b in range(1, n + 1):
            forward[b] = np.logaddexp.reduce([forward[b - 1], *(forward[cut[s][0]] + joint[s] for s in ends[b])])
        for a in range(n - 1, -1, -1):
            backward[a] = np.logaddexp.reduce([backward[a + 1], *(backward[cut[s][1]] + joint[s] for s in starts[a])])
        around = np.array([forward[a] + backward[b] for a, b in cut]) - forward[n]
        return np.exp(scores + around[:, None])

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, score) of the best segmentation's entities; of equal ones that with fewer entities."""
        n = len(tokens)
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for a in range(n):  # all that ends at a is known by now
            ends = ends_of(tokens, a)
            cue = _cue(tokens, a) if ends else ""
            for b in ends:
                k, score = self.score(tokens, a, b, cue)
                if best[a] + score > best[b]:
                    best[b], back[b] = best[a] + score, (a, k, score)
            if best[a] >= best[a + 1]:
                best[a + 1], back[a + 1] = best[a], None
        out, b = [], n
        while b:
            if back[b]:
                a, k, score = back[b]
                out.append((a, b, k, score))
                b = a
            else:
                b -= 1
        return out[::-1]


def training_windows(n: int, seed: int) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Windows with known entities among words, numbers that are none, and cues."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda k=8: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, k)))

    def card() -> str:
        head = digits(15)
        whole = head + next(c for c in "0123456789" if luhn(head + c))
        mark = r.choice(["", "", " ", "-"])
        return mark.join(whole[k : k + 4] for k in range(0, 16, 4))

    entities = {
        "email": lambda: f"{word()}{r.choice(['', '.' + word(), digits(2), '.' + digits(2)])}@{word()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com', 'net', 'de'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(4)} {digits(6)}"]),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    nothing = [lambda: digits(r.randint(1, 12)), lambda: f"{r.randint(1, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: digits(16), lambda: f"{word()}{digits(3)}", lambda: "".join(r.choices("0123456789abcdef", k=24)), lambda: f"{digits(2)}:{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(1)},{digits(3)}.{digits(2)}", lambda: f"{r.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: f"{digits(2)}-{digits(2)}", lambda: " ".join(str(r.randint(1, 10 ** r.randint(1, 4))) for _ in range(r.randint(2, 6)))]
    out = []
    cues: dict[str, list[str]] = {}
    for w, c in _CUES.items():
        cues.setdefault(c, []).append(w)
    for k in range(n):
        tokens: list[str] = []
        truth = []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([*KINDS, None, None, None, None])
            said = cues[kind or "other"]
            tokens += _TOKEN.findall(f"{word()} {r.choice([*said, word(), word()])}{r.choice([' ', ': '])}")
            inner = _TOKEN.findall(entities[kind]() if kind else r.choice(nothing)())
            if kind:
                truth.append((len(tokens), len(tokens) + len(inner), KINDS.index(kind)))
            tokens += inner + _TOKEN.findall(f"{r.choice(['', '', '.', ','])} {word()} ")
        out.append((tokens, truth))
    return out


@functools.cache
def model() -> SemiCRF:
    return SemiCRF().fit(training_windows(TRAIN_WINDOWS, SEED))


def find_personal_data(text: str, crf: SemiCRF) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a whole text in code points, by start, then kind; base spans first of equals."""
    base = base_spans(text)
    if not base and not _DIGITS.search(text) and "@" not in text:
        return []
    out = [(*x, True) for x in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else starts
    for low, high in windows(text):
        tokens = _TOKEN.findall(text, low, high)
        ends = low + np.cumsum([len(t) for t in tokens])
        for a, b, kind, score in crf.decode(tokens):
            start, end = int(ends[a]) - len(tokens[a]), int(ends[b - 1])
            k = int(np.searchsorted(starts, end)) if taken else 0  # spans that start before the end
            if score >= MARGIN and not (k and reach[k - 1] > start):
                out.append((KINDS[kind], start, end, False))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), not x[3], x[2]))


def find_pii(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, findings (kind, start, end, base) by start, then kind.

    Null and empty texts have none; whole texts are searched; repeated rows each give a row; an empty table gives an
    empty result; columns besides doc_id and text are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model().weights)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        crf = SemiCRF()
        crf.weights = shared.value
        for batch, texts in text_groups(batches):
            found = [[dict(zip(("kind", "start", "end", "base"), x)) for x in find_personal_data(t or "", crf)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kinds)], names=["doc_id", "findings"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, findings {FINDINGS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of findings for comparison."""
    spans = lambda array: F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("findings", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("findings", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(spans(base).cast("binary"), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
