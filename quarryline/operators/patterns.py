"""Texts joined with a table of patterns (regular expressions), however many there are.

A pattern can't match where a literal part that it needs is missing. So each pattern is taken apart once into needed words:
a match holds at least one of them, inside some word of the text. The distinct words of all texts are joined with the needed
words by their first letters (a gram), which gives, for each word of the corpus, the patterns it may belong to; texts meet
their candidates through their words, and only candidates are searched for. The plan has the same few joins by equality for any
number of patterns. Patterns without a needed word are rare; each text tries those one by one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from re import _constants as K
from re import _parser as P

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Bits of a number of ``occurring``, and bytes of text looked through at once.
BITS, BLOCK = 63, 1 << 20


def needed(pattern: str) -> list[str] | None:
    """Runs of a-z and 0-9, at least one of which is in the lower-cased text of any match; None if there is no telling."""
    try:
        found = _of(P.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None  # another dialect's syntax
    return sorted(found) if found else None


def wanted(pattern: str, most: int = 2) -> list[list[str]]:
    """The ``most`` best choices of needed runs: the lower-cased text of a match has one run of each; none if there is no telling."""
    try:
        found = _all(P.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []
    return [sorted(some) for some in sorted(found, key=lambda some: -min(map(len, some)))[:most]]


def _of(parsed) -> set[str] | None:
    """The best choice of a sequence: the one whose shortest run is longest."""
    return max(_all(parsed), key=lambda some: min(map(len, some)), default=None)


def _all(parsed) -> list[set[str]]:
    """Each choice of a sequence: of every set of runs a match has one."""
    out, run = [], ""

    def take(some: set[str] | None) -> None:
        if some:
            out.append(some)

    for op, arg in parsed:
        c = chr(arg).lower() if op is K.LITERAL else ""
        if len(c) == 1 and c.isascii() and c.isalnum():
            run += c
            continue
        before = run
        if run:
            take({run})
            run = ""
        if op is K.SUBPATTERN:
            out += _all(arg[-1])
        elif op is K.ATOMIC_GROUP:
            out += _all(arg)
        elif op is K.BRANCH:
            # the parser moves what alternatives begin with alike before them
            parts = [_of([(K.LITERAL, ord(x)) for x in before] + list(x)) for x in arg[1]]
            take(set().union(*parts) if all(parts) else None)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _all(arg[2])
    if run:
        take({run})
    return out


def occurring(literals: list[str]) -> Callable[[Column], Column]:
    """Of a text, which of some fixed strings (two bytes at least) it holds: an array of numbers, for ``holds``; null of null.

    A block of texts is one array of bytes. Places whose two bytes begin a string come from a table of all pairs of bytes, and are
    sorted by pair; each string is compared at the places of its own pair alone. So the cost is a pass over the bytes for any
    number of strings, where a search a string would be a pass each."""
    spelt = [np.frombuffer(x.encode(), np.uint8) for x in literals]
    heads = [int(w[0]) << 8 | int(w[1]) for w in spelt]
    longest, kind = max(map(len, spelt)), pa.list_(pa.int64(), -(-len(spelt) // BITS))

    def looked(data: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        """Sets the bits of some texts that lie one after the other in ``data``."""
        starts = np.zeros(1 << 16, bool)
        starts[heads] = True
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        at = np.flatnonzero(starts.take(pair, mode="clip"))
        begun = pair[at]
        order = np.argsort(begun, kind="stable")
        at, begun = at[order], begun[order]
        padded = np.concatenate([data, np.zeros(longest, np.uint8)])
        for i, (word, low, high) in enumerate(zip(spelt, np.searchsorted(begun, heads), np.searchsorted(begun, heads, "right"), strict=True)):
            places = at[low:high]
            for j in range(2, len(word)):
                places = places[padded[places + j] == word[j]]
            rows = np.searchsorted(ends, places, "right")
            rows = rows[places + len(word) <= ends[rows]]  # what reaches over an end lies in no text
            out[rows, i // BITS] |= 1 << i % BITS

    @F.arrow_udf("array<bigint>")
    def held(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        n, (_, offsets, data) = len(texts), texts.buffers()
        out = np.zeros((n, kind.list_size), np.int64)
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        some = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            to = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
            if at[to] - at[row] > 1:
                looked(some[at[row] : at[to]], at[row + 1 : to + 1] - at[row], out[row:to])
            row = to
        numbers = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), kind.list_size).cast(pa.list_(pa.int64()))
        return pa.compute.if_else(texts.is_null(), pa.scalar(None, numbers.type), numbers)

    return held


def holds(held: Column, literals: list[str], wanted: list[str]) -> Column:
    """Whether a text holds one of the wanted strings, by what ``occurring(literals)`` says of it: one look at each number."""
    masks: dict[int, int] = {}
    for i in (literals.index(w) for w in wanted):
        masks[i // BITS] = masks.get(i // BITS, 0) | 1 << i % BITS
    return reduce(Column.__or__, [held[k].bitwiseAND(F.lit(mask).cast("bigint")) != 0 for k, mask in masks.items()])


def begun(pattern: str) -> str:
    """A pattern that begins with words after a boundary as one that begins with the words themselves, so that a search goes from
    one place of them to the next instead of looking for boundaries; any other stays as it is."""
    begin = re.match(r"((?:\(\?s\))?)\\b([a-z0-9]+(?: [a-z0-9]+)* ?)(?![a-z0-9 ])", pattern)
    words = begin.group(2) if begin else ""
    if begin and pattern[begin.end() : begin.end() + 1] in ("?", "*", "+", "{"):
        words = words[:-1]  # the last letter belongs to what follows
    return rf"{begin.group(1)}{words}(?<=\b{words}){pattern[begin.start(2) + len(words) :]}" if words.strip() else pattern


#: Lower-case words, digits and plain syntax, without classes, flags or other escapes than these.
_CASELESS = r"(?:[a-z0-9 |/)+?*.,:!=<-]|\((?!\?[^:!=<])|\\[bsdw])*"


def caseless(pattern: str) -> bool:
    """Whether the pattern finds as it is in lower-cased ASCII text what it finds without regard to case in the text itself."""
    return re.fullmatch(_CASELESS, pattern) is not None


def led(pattern: str) -> str:
    """``begun``, or else the pattern behind a look at the next character, so that a search tries the pattern itself only where it may
    begin. One that may begin with too many stays as it is."""
    if not _forks(pattern) and (words := begun(pattern)) != pattern:
        return words
    try:
        some = _first(list(P.parse(pattern)))
    except (re.error, OverflowError, RecursionError):
        return pattern
    return rf"(?=[{''.join(sorted(some))}])(?:{pattern})" if some else pattern


def _forks(pattern: str) -> bool:
    """Whether the pattern as a whole is one of several alternatives."""
    flat, before = re.sub(r"\\.|\[[^]]*\]", "", pattern), None
    while flat != before:
        flat, before = re.sub(r"\([^()]*\)", "", flat), flat
    return "|" in flat


def _first(parsed: list) -> set[str] | None:
    """What a match's first character is one of, as parts of a class; None if there is no telling."""
    for i, (op, arg) in enumerate(parsed):
        if op is K.AT:
            continue
        if op is K.LITERAL:
            return {re.escape(chr(arg))} if chr(arg).isascii() else None
        if op is K.IN and all(o is K.LITERAL and chr(a).isascii() or (o, a) == (K.CATEGORY, K.CATEGORY_DIGIT) for o, a in arg):
            return {re.escape(chr(a)) if o is K.LITERAL else r"\d" for o, a in arg}
        if op is K.SUBPATTERN and not any(arg[1:3]):
            return _first(list(arg[-1]) + parsed[i + 1 :])
        if op is K.BRANCH:
            parts = [_first(list(x) + parsed[i + 1 :]) for x in arg[1]]
            return set().union(*parts) if all(parts) else None
        if op is K.MAX_REPEAT:
            own, rest = _first(list(arg[2])), _first(parsed[i + 1 :]) if arg[0] == 0 else set()
            return own | rest if own is not None and rest is not None else None
        return None
    return None


def needs(patterns: DataFrame, key: str, pattern: str) -> DataFrame:
    """``key, need``: a row a needed word, one with null for a pattern without."""
    kind = patterns.schema[key].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, p in enumerate(b.column(1).to_pylist()) if p is not None for w in needed(p) or [None]]
            keys = b.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([w for _, w in rows], pa.string())], names=[key, "need"])

    return patterns.select(key, pattern).mapInArrow(told, f"`{key}` {kind}, need string")


def matches(texts: DataFrame, patterns: DataFrame, text_key: str, text: str, pattern_key: str, pattern: str) -> DataFrame:
    """``text_key, pattern_key``: every pair in which the pattern occurs in the text. Both keys are distinct in
    their tables. Null texts and patterns match nothing; an empty pattern matches every text."""
    # texts and their words are never broadcast, however small their columns are guessed to be (``hint``)
    own = texts.select(F.col(text_key), F.col(text).cast("string").alias("_text")).where("_text is not null")
    rules = patterns.select(F.col(pattern_key), F.col(pattern).alias("_pattern")).where("_pattern is not null")
    wanted = needs(patterns, pattern_key, pattern)
    words = own.select(text_key, F.explode(F.array_distinct(F.split(F.lower("_text"), "[^a-z0-9]+"))).alias("_word")).where("_word <> ''")
    # by their first letters, up to GRAM of them, needed words meet the corpus's distinct words
    of = wanted.where("need is not null").select(pattern_key, "need", F.substring("need", 1, GRAM).alias("_gram"))
    starts = F.sequence(F.lit(1), F.length("_word"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring("_word", i, n)))))
    spelt = words.select("_word").distinct().select("_word", F.explode(grams).alias("_gram"))
    hints = spelt.hint("merge").join(of, "_gram").where(F.contains("_word", "need")).select("_word", pattern_key).distinct()
    candidates = words.hint("merge").join(hints, "_word").select(text_key, pattern_key).distinct()
    found = candidates.join(own.hint("merge"), text_key).join(rules, pattern_key).where(F.expr("_text rlike _pattern")).select(text_key, pattern_key)
    # without a needed word: one row that lists them, beside every text
    open_ = wanted.where("need is null").join(rules, pattern_key).agg(F.collect_list(F.struct(pattern_key, "_pattern")).alias("_open")).where(F.size("_open") > 0)
    tried = own.join(F.broadcast(open_)).select(text_key, "_text", F.explode("_open").alias("_o")).where(F.expr("_text rlike _o._pattern")).select(text_key, F.col(f"_o.{pattern_key}").alias(pattern_key))
    return found.unionByName(tried)
