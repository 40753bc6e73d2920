"""Personal data by a semi-Markov conditional random field over whole spans.

Fixed patterns find base spans, which always stay. The model adds spans that the patterns miss (masked at-signs and dots,
addresses in words, numbers without a plus, other separators). Texts are cut into islands, runs of words with digits,
at-signs or masks of these, with the words beside a mask that stands alone; an island's tokens are split into segments of
bounded length (LONGEST tokens), each other text (one token) or an entity. A segment is a candidate for those kinds alone
whose own bounds it keeps: octets up to 255, 16 to 19 digits that pass Luhn, 8 to 15 digits that aren't written as a date, a
dotted quad or a social security number, and numbers that end where the digits do. It scores by features of the whole span,
and dynamic programming chooses boundaries and types jointly. Weights are fitted by gradient on the log-likelihood
(forward-backward) on islands of a bounded hash sample whose labels come from the base patterns, a part of them varied as
above, and on numbers written like references and counts, which are no entities.

Null texts count as empty; repeated rows get equal spans; an empty table gives an empty result; further columns are only
passed on. Offsets are code points, ends exclusive. Added spans never overlap base ones."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, bound_batches, map_texts
from .language import hash_sample

KINDS = ("email", "ip", "card", "phone")
#: Rows and distinct islands that the model learns from.
SAMPLE_ROWS = 4_000
ISLANDS = 1_500
LONGEST = 24  # tokens of an entity
_EMAIL = regex.compile(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = regex.compile(r"(?:(?<![0-9])|\G)([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = regex.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MASKS = ("[at]", "(at)")
_AT = r"(?:\[at\]|\(at\))"
_MASKED = regex.compile(rf" ?{_AT} ?")
_MARKED = rf"(?:\S++ (?={_AT}))?+\S*(?:[0-9@]|{_AT})\S*+(?:(?<={_AT}) \S++)?+"
#: An address in words: a name, "at", and parts with "dot" between them.
_SPOKEN = r"[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)+"
_ISLAND = regex.compile(rf"(?<!\S)(?:{_SPOKEN}|{_MARKED}(?: {_MARKED})*)")
_TOKEN = regex.compile(r"[0-9]+|[A-Za-z]+|\s+|.", regex.S)
_DIGITS = regex.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern spans by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text)]
    if not regex.search("[0-9]", text):
        return out
    if text.count(".") > 2:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


_ADDRESS = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = regex.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})")
_NUMBER = regex.compile(r"\+?[0-9(][0-9 ().-]*[0-9]")
#: What has as many digits as a phone number but is none: dotted quads, social security numbers, dates, decimals, bare runs.
_NO_PHONE = regex.compile(r"[0-9]+(?:\.[0-9]+){3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([-.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-.])[0-9]{1,2}\2[0-9]{2,4}|[0-9]+(?:\.[0-9]*)?|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}|97[89][ -].*")
_RUNS_ON = regex.compile(r"[0-9][.-]?$"), regex.compile(r"[.-]?[0-9]")


def plain(s: str) -> str:
    """A candidate without the masks of at-signs and dots."""
    s = _MASKED.sub("@", s).replace("[.]", ".")
    return s.replace(" at ", "@", 1).replace(" dot ", ".") if " dot " in s else s


def possible(s: str, before: str, after: str) -> list[bool]:
    """Of which kinds a candidate can be at all, by the bounds of each: octets up to 255, 16 to 19 digits that pass Luhn, 8
    to 15 digits; a number that runs on beyond a dot or dash is none."""
    t = plain(s)
    if regex.search("[A-Za-z@]", t):
        return [bool(_ADDRESS.fullmatch(t)), False, False, False]
    alone = not _RUNS_ON[0].search(before) and not _RUNS_ON[1].match(after)
    if not alone or not _NUMBER.fullmatch(t):
        return [False] * 4
    n = len(digits := _DIGITS.sub("", t))
    four = _QUAD.fullmatch(t)
    return [False, bool(four) and all(int(g) <= 255 for g in four.groups()), 16 <= n <= 19 and t[0] not in "+(" and t == s and luhn(digits), 8 <= n <= 15 and t == s and t.count("(") == t.count(")") and not _NO_PHONE.fullmatch(t)]


def features(s: str, before: str, after: str) -> np.ndarray:
    """Of a whole candidate span and the characters beside it."""
    digits = _DIGITS.sub("", s)
    n, t = len(digits), plain(s)
    at, tail = "@" in t, t.split("@")[-1]
    mixed = bool(regex.search("[A-Za-z]", s))
    groups = [len(g) for g in _DIGITS.split(s) if g]
    return np.array(
        [
            1.0,
            at,
            at and "." in tail,
            t.count(".") == 3 and not mixed,
            16 <= n <= 19 and not mixed,
            8 <= n <= 15 and not mixed,
            s[0] == "+",
            s[0] == "(" or ") " in s,
            groups[-2:] in ([3, 4], [4, 4]) and not mixed,
            len(set(groups)) == 1 and len(groups) > 1 and not mixed,
            len(groups) > 4 and not mixed,
            t != s,
            mixed,
            before == "" or before in " \n\t(<\"':;,=|",
            after == "" or after in " \n\t)>\"':;,.|!?",
            n / 16.0,
            len(s) / 32.0,
            min(groups, default=0) == 1 and not mixed,
        ],
        float,
    )


WIDTH = 18


class Island:
    """The tokens of an island, and its candidate segments (start, end, features)."""

    def __init__(self, s: str):
        self.text, self.bounds = s, [0]
        for m in _TOKEN.finditer(s):
            self.bounds.append(m.end())
        b, n = self.bounds, len(self.bounds) - 1
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]  # by end: (start, features, what is impossible)
        # a candidate holds seven digits, an at-sign or a mask of one
        marks = [0]
        for i in range(n):
            t = s[b[i] : b[i + 1]]
            marks.append(marks[-1] + (len(t) if t[0].isdigit() else 7 if "@" in t or t == "at" else 0))
        for i in range(n):
            first = s[b[i]]
            if not (first.isalnum() or first in "+("):
                continue
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                own = s[b[i] : b[j]]
                if not own[-1].isalnum() or marks[j] - marks[i] < 4 or marks[j] - marks[i] < 7 and own.count(".") != 3:
                    continue
                if any(ok := possible(own, s[max(0, b[i] - 2) : b[i]], s[b[j] : b[j] + 2])):
                    self.segments[j].append((i, features(own, s[b[i] - 1 : b[i]] if i else "", s[b[j] : b[j] + 1]), np.where(ok, 0.0, -np.inf)))

    def scores(self, w: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        return [[(i, w @ f + no) for i, f, no in own] for own in self.segments]

    def best(self, w: np.ndarray) -> list[tuple[str, int, int]]:
        n = len(self.segments) - 1
        score, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            score[j] = score[j - 1]
            for i, f, no in self.segments[j]:
                v = w @ f + no
                k = int(v.argmax())
                if score[i] + v[k] > score[j]:
                    score[j], back[j] = score[i] + v[k], (i, k)
        out, j = [], n
        while j:
            if back[j]:
                i, k = back[j]
                out.append((KINDS[k], self.bounds[i], self.bounds[j]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: list[tuple[str, int, int]]) -> np.ndarray:
        n = len(self.segments) - 1
        sc = self.scores(w)
        fwd = np.zeros(n + 1)
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1], *[fwd[i] + x for i, v in sc[j] for x in v]])
        bwd = np.zeros(n + 1)
        ahead: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, v in sc[j]:
                ahead[i].append((j, v))
        for i in range(n - 1, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *[bwd[j] + x for j, v in ahead[i] for x in v]])
        g = np.zeros_like(w)
        at = {p: i for i, p in enumerate(self.bounds)}
        want = {(at[a], at[b], KINDS.index(k)) for k, a, b in gold if a in at and b in at}
        for j in range(1, n + 1):
            for (i, f, no), (_, v) in zip(self.segments[j], sc[j], strict=True):
                p = np.exp(fwd[i] + v + bwd[j] - fwd[n])
                for k in np.flatnonzero(no == 0):
                    g[k] += (((i, j, k) in want) - p[k]) * f
        return g


def vary(s: str, spans: list[tuple[str, int, int]], rng: random.Random):
    """A variant of an island with one span as the patterns would miss it."""
    for kind, a, b in spans:
        own = s[a:b]
        if kind == "email":
            name, _, host = own.partition("@")
            new = f"{name} at {host.replace('.', ' dot ')}" if rng.random() < 0.3 else own.replace("@", rng.choice([*_MASKS, *(f" {m} " for m in _MASKS)]))
        else:
            new = {"phone": own[1:], "card": own.replace(" ", ".").replace("-", "."), "ip": own.replace(".", "[.]")}[kind]
        if new != own:
            moved = [(k, x, y) if y <= a else (k, x + len(new) - len(own), y + len(new) - len(own)) for k, x, y in spans if y <= a or x >= b]
            return s[:a] + new + s[b:], [*moved, (kind, a, a + len(new))]
    return None


def near_misses(n: int, rng: random.Random) -> list[str]:
    """Islands of numbers that are as long as phone numbers but are none, as references, counts and codes are written."""
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    forms = [lambda: f"{d(2)}-{d(6)}", lambda: f"{d(1)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(4)}-{d(2)}-{d(5)}", lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"{d(5)} {d(5)}", lambda: f"{d(1)}-{d(2)}-{d(1)}-{d(2)}-{d(3)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(6)}-{d(2)}"]
    return [rng.choice(forms)() for _ in range(n)]


def undotted(s: str, spans: list[tuple[str, int, int]]) -> str | None:
    """A variant of an island whose masked address has no dot in its domain, so that it is none."""
    for kind, a, b in spans:
        if kind == "email" and (m := _MASKED.search(s, a, b)):
            return s[a : m.end()] + _TOKEN.match(s, m.end()).group()
    return None


def clean(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without overlaps, earlier kinds first."""
    out: list[tuple[str, int, int]] = []
    for s in spans:
        if all(s[2] <= o[1] or s[1] >= o[2] for o in out):
            out.append(s)
    return out


def pieces(island: str, most: int = 200) -> list[str]:
    """An island to learn from, a long one in parts that end at a blank where there is one."""
    out = []
    while len(island) > most:
        at = island.rfind(" ", 1, most) if " " in island[1:most] else most
        out.append(island[:at])
        island = island[at:].lstrip(" ")
    return [*out, island] if island else out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, islands: int = ISLANDS, rounds: int = 4) -> np.ndarray:
    """The weights (kind x feature); zero weights, which add nothing, without examples."""
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            out = sorted({p for t in b.column(0).to_pylist() for m in _ISLAND.finditer(t) for p in pieces(m.group())})
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["island"])

    found = hash_sample(picked, sample_rows, "doc_id").select("text").mapInArrow(run, "island string").distinct()
    rows = sorted(r[0] for r in found.orderBy(F.xxhash64("island"), "island").limit(islands).collect())
    return fit(rows, rounds)


def fit(islands: list[str], rounds: int = 4, rate: float = 0.3) -> np.ndarray:
    rng = random.Random(7)
    examples = []
    for s in islands:
        gold = clean(base_spans(s))
        examples.append((Island(s), gold))
        if gold and (v := vary(s, gold, rng)):
            examples.append((Island(v[0]), v[1]))
            if none := undotted(*v):
                examples.append((Island(none), []))
    w = np.zeros((len(KINDS), WIDTH))
    if not any(g for _, g in examples):
        return w
    examples += [(Island(s), []) for s in near_misses(len(islands) // 4 + 20, rng)]
    w[:, 0] = -3.0
    total = np.full_like(w, 1.0)
    for _ in range(rounds):
        rng.shuffle(examples)
        for island, gold in examples:
            if any(island.segments):
                g = island.gradient(w, gold) - 1e-3 * w
                total += g * g
                w = w + rate * g / np.sqrt(total)
    return w


def added_spans(text: str, base: list[tuple[str, int, int]], w: np.ndarray, cache: Recent) -> list[tuple[str, int, int]]:
    out = []
    for m in _ISLAND.finditer(text):
        for kind, a, b in cache[m.group()]:
            a, b = a + m.start(), b + m.start()
            if all(b <= o[1] or a >= o[2] for o in base):
                out.append((kind, a, b))
    return out


class Finder:
    def __init__(self, weights: np.ndarray):
        self.w = weights
        self.cache = Recent(lambda s: Island(s).best(self.w) if self.w.any() else [], 20_000)

    def find(self, text: str) -> tuple[list, list]:
        """(base spans, all spans), each by kind as listed, then start."""
        base = base_spans(text)
        more = added_spans(text, base, self.w, self.cache) if any(c in text for c in (*"0123456789@", *_MASKS, " dot ")) else []
        return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, weights: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans``."""

    def make():
        finder = Finder(weights)

        def fn(_, texts):
            cols = [[] for _ in range(6)]
            for t in texts:
                base, every = finder.find(t or "")
                for c, x in zip(cols, [*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)], strict=True):
                    c.append(x)
            return [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)]

        return fn

    return map_texts(docs, make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", key)


def personal_data(docs: DataFrame) -> DataFrame:
    """The thin query."""
    return find_spans(docs, train(docs))


def redact(text: str | None, finder: Finder) -> str | None:
    if not text:
        return text
    _, spans = finder.find(text)
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind}>"] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; other columns as they were."""
    place, names = docs.columns.index("text"), docs.columns
    bound_batches(docs.sparkSession)

    def run(batches):
        finder = Finder(weights)
        for b in batches:
            cols = list(b.columns)
            cols[place] = pa.array([redact(t, finder) for t in cols[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
