"""Problem 2: damage that scanning leaves in text, and its repair into continuous paragraphs.

Method: the lines of a text are a sequence whose hidden states (body, running line, page number, break, other block) are
decoded by a hidden Markov model over layout features: shape, relative length, and whether the line interrupts a sentence.
It is trained here by expectation maximisation on a bounded sample of lines, from a prior that only ties
shapes to states. Body lines are then joined, words divided at line ends are closed, and wrongly recognised characters are
corrected by a noisy-channel test against word counts of the whole corpus. The counts stay distributed: each distinct token is
joined once with the counts of the words it may stand for, and each bucket of texts gets what its own tokens need.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.normalize import INVISIBLE
from folioflow.runtime import cut

#: Documented bounds: texts the model is fitted on, EM rounds, characters of text that are repaired together, and bits of the
#: word filter (8 MB are broadcast, whatever the corpus holds).
SAMPLE, ROUNDS, BUCKET_CHARS, FILTER_BITS = 4000, 4, 1 << 20, 1 << 26
#: Longest word that is counted, in letters, and length from which a text of one line is no page number or running line.
WORD_LETTERS, LONG_LINE = 40, 80
BODY, RUNNING, PAGE, BREAK, OTHER = range(5)
KINDS = ("broken_word", "misread", "running_line", "page_number")

# Shapes that optical recognition confuses, written as read -> meant, and words that open a coordination.
CONFUSED = [("cl", "d"), ("rn", "m"), ("ii", "u"), ("vv", "w"), ("h", "li"), ("b", "h"), ("c", "e"), ("d", "cl"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("+", "t"), ("!", "i"), ("!", "l"), ("@", "a"), ("$", "s"), ("8", "b"), ("6", "b"), ("|", "l"), ("3", "e"), ("4", "a"), ("7", "t"), ("€", "e"), ("m", "rn"), ("u", "ii"), ("w", "vv"), ("e", "c"), ("h", "b"), ("tl", "d"), ("i", "l"), ("l", "i"), ("f", "t"), ("nn", "m"), ("ri", "n"), ("ln", "m")]
COORDINATORS = {"and", "or", "und", "oder", "sowie", "bzw", "et", "ou", "y", "e", "o", "u", "to", "bis", "as", "nor", "but"}

_ROMAN = r"(?=[ivxlcdm])(?:m{0,3})(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})"
_NUMBER = r"[\dlIOoSB]{0,3}\d[\dlIOoSB]{0,3}|[lIO]\d+"
_PAGE_LINE = re.compile(rf"^\s*[\[(]?\s*[-–—~]?\s*(?:(?:p|pp|pg|page|seite|página|s)\.?\s*)?(?:{_NUMBER}|{_ROMAN})(?:\s*(?:of|/|von|sur|de)\s*(?:{_NUMBER}))?\s*[-–—~]?\s*[\])]?\s*$", re.I)
_PAGE_SUFFIX = re.compile(rf"^(?P<line>.*\S)\s+[|·•]\s*(?:(?:p|page)\.?\s*)?(?:{_NUMBER}|{_ROMAN})\s*$", re.I)
_PAGE_PREFIX = re.compile(rf"^\s*(?:(?:p|page)\.?\s*)?(?:{_NUMBER}|{_ROMAN})\s+[|·•]\s+(?P<line>\S.*)$", re.I)
_AUTHORS = re.compile(r"^\s*[^\W\d_][\w'’.-]*(?:,? (?:and|&) [^\W\d_][\w'’.-]*)? et al\.?\s*$")
_CAPITALS = re.compile(r"^[^a-zß-öø-ÿ]*[A-Z][^a-zß-öø-ÿ]*[A-Z][^a-zß-öø-ÿ]*$")
_MARK = re.compile(r"(?P<left>[^\s]*[^\W_])(?P<mark>[-¬~=­‐])[ \t\r]*$")
_FORMULA, _BULLET = re.compile(r"\s=\s|[=≤≥∑∫√]\s*[A-Za-z(]"), re.compile(r"^\s*(?:[-*•]|\d{1,2}[.)])\s")
_FIELD, _HEADING = re.compile(r"\S\s\|\s\S+:\s|^\s*Table:?\s*$"), re.compile(r"^\s*\d{1,2}(?:\.\d{1,2})*\.?\s+[A-Z][^.!?]{2,60}$")
_DANGLING = re.compile(r"\s(?:of|with|the|an?|and|or|to|for|in|on|by|from|der|die|das|und|mit|von|de|la|le|et|y|en)$", re.I)
_STOP = re.compile(r"[.!?;:。！？；：][\"'”’)\]]*\s*$")

SHAPES = ("blank", "page", "titled_page", "authors", "capitals", "formula", "bullet", "field", "heading", "stop", "divided", "title", "open")


def shape(line: str) -> int:
    """The layout shape of one line, an index into ``SHAPES``."""
    text = line.strip()
    if not text:
        return 0
    if _PAGE_LINE.match(text):
        return 1
    if (m := _PAGE_SUFFIX.match(text) or _PAGE_PREFIX.match(text)) and not _FIELD.search(text) and len(text) < 80:
        return 2
    if _AUTHORS.match(text):
        return 3
    if _CAPITALS.match(text) and len(text) < 60 and not _STOP.search(text):
        return 4
    if _FORMULA.search(text) and len(text) < 60:
        return 5
    if _BULLET.match(text):
        return 6
    if _FIELD.search(text):
        return 7
    if _HEADING.match(text):
        return 8
    if _STOP.search(text):
        return 9
    if _MARK.search(line):
        return 10
    if len(text) < 60 and text[0].isupper() and not text.endswith(",") and not _DANGLING.search(text):
        return 11
    return 12


def observe(lines: list[str]) -> list[tuple[int, int, int]]:
    """(shape, relative length, place in the sentence) of each line.

    Place: 3 where a sentence begins in the line and goes on in lower case after it, 2 where the text before is unfinished and
    the text after goes on in lower case, 1 where only the text before is unfinished, else 0.
    """
    full = sorted(len(x.strip()) for x in lines)[int(0.8 * (len(lines) - 1))] or 1
    table = lines[0].strip().rstrip(":") == "Table"
    shapes = []
    for x in lines:
        n, k = len(x.strip()), shape(x)
        shapes.append(7 if table and k else 12 if k == 11 and n > 0.85 * full else k)
    text = (9, 10, 12)
    seen: list[tuple[int, int, int]] = []
    for i, line in enumerate(lines):
        ratio = len(line.strip()) / full
        before = next((lines[j].strip() for j in range(i - 1, -1, -1) if shapes[j] in text), "")
        after = next((lines[j].strip() for j in range(i + 1, len(lines)) if shapes[j] in text), "")
        unfinished, lower = bool(before) and not _STOP.search(before), after[:1].islower() or after[:1].isdigit()
        place = (2 if lower else 1) if unfinished else 3 if lower and not _STOP.search(line.strip()) else 0
        seen.append((shapes[i], 0 if ratio < 0.5 else 1 if ratio < 0.8 else 2, place))
    return seen


# What the prior says of a shape: weights of (body, running, page, break, other).
_PRIOR = {
    "blank": (0, 0, 0, 1, 0), "page": (0, 0, 1, 0, 0), "titled_page": (0.01, 1, 0, 0, 0.01), "authors": (0.02, 1, 0, 0, 0.01), "capitals": (0.02, 1, 0, 0, 0.05),
    "formula": (0.05, 0.01, 0, 0, 1), "bullet": (0.1, 0, 0, 0, 1), "field": (0.05, 0, 0, 0, 1), "heading": (0.05, 0.02, 0, 0, 1), "stop": (1, 0.001, 0, 0, 0.01), "divided": (1, 0, 0, 0, 0), "title": (0.3, 0.6, 0, 0, 0.1), "open": (1, 0.01, 0, 0, 0.01),
}


class LineModel:
    """A hidden Markov model with three categorical emissions, trained by expectation maximisation under the prior."""

    SIZES = (len(SHAPES), 3, 4)

    def __init__(self):
        states = range(5)
        self.start = [0.5, 0.3, 0.1, 0.02, 0.08]
        self.move = [[0.8, 0.06, 0.06, 0.06, 0.02], [0.7, 0.02, 0.15, 0.1, 0.03], [0.7, 0.15, 0.02, 0.1, 0.03], [0.7, 0.1, 0.1, 0.05, 0.05], [0.3, 0.03, 0.03, 0.04, 0.6]]
        columns = [_PRIOR[s] for s in SHAPES]
        weight = [0.0] * 5
        for k in states:
            weight[k] = sum(c[k] for c in columns)
        # length: running lines and page numbers are short; interruption: furniture stands inside sentences
        self.emit = [
            [[(c[k] + 1e-4) / (weight[k] + 1e-4 * len(columns)) for c in columns] for k in states],
            [[0.08, 0.17, 0.75], [0.6, 0.3, 0.1], [0.95, 0.04, 0.01], [0.98, 0.01, 0.01], [0.4, 0.3, 0.3]],
            [[0.2, 0.2, 0.35, 0.25], [0.5, 0.1, 0.37, 0.03], [0.5, 0.1, 0.37, 0.03], [0.5, 0.1, 0.37, 0.03], [0.8, 0.1, 0.05, 0.05]],
        ]

    def _emission(self, o: tuple[int, ...]) -> list[float]:
        return [self.emit[0][k][o[0]] * self.emit[1][k][o[1]] * self.emit[2][k][o[2]] for k in range(5)]

    def fit(self, sequences: list[list[tuple[int, ...]]], rounds: int = ROUNDS, strength: float = 1000.0) -> "LineModel":
        """EM; the prior counts as ``strength`` lines a state, so that little data leaves it standing. Repeated sequences
        are counted once with their number."""
        prior = ([*self.start], [[*r] for r in self.move], [[[*r] for r in f] for f in self.emit])
        counted: dict[tuple, int] = {}
        for s in sequences:
            counted[tuple(s)] = counted.get(tuple(s), 0) + 1
        for _ in range(rounds):
            start = [strength * x for x in prior[0]]
            move = [[strength * x for x in r] for r in prior[1]]
            emit = [[[strength * x for x in r] for r in f] for f in prior[2]]
            for seq, times in counted.items():
                e = [self._emission(o) for o in seq]
                alpha, scale = [], []
                for t, b in enumerate(e):
                    row = [self.start[k] * b[k] for k in range(5)] if t == 0 else [b[k] * sum(alpha[-1][j] * self.move[j][k] for j in range(5)) for k in range(5)]
                    z = sum(row) or 1e-300
                    alpha.append([x / z for x in row])
                    scale.append(z)
                beta = [1.0] * 5
                for t in range(len(seq) - 1, -1, -1):
                    gamma = [alpha[t][k] * beta[k] for k in range(5)]
                    z = sum(gamma) or 1e-300
                    for k in range(5):
                        g = times * gamma[k] / z
                        for f, v in enumerate(seq[t]):
                            emit[f][k][v] += g
                        if t == 0:
                            start[k] += g
                    if t:
                        ahead = [e[t][k] * beta[k] / scale[t] for k in range(5)]
                        for j in range(5):
                            for k in range(5):
                                move[j][k] += times * alpha[t - 1][j] * self.move[j][k] * ahead[k]
                        beta = [sum(self.move[j][k] * ahead[k] for k in range(5)) for j in range(5)]
            norm = lambda row: [x / sum(row) for x in row]
            self.start, self.move, self.emit = norm(start), [norm(r) for r in move], [[norm(r) for r in f] for f in emit]
        return self

    def decode(self, seq: list[tuple[int, ...]]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not seq:
            return []
        log = lambda x: math.log(x) if x > 0 else -1e9
        move = [[log(x) for x in r] for r in self.move]
        best = [log(self.start[k]) + log(x) for k, x in enumerate(self._emission(seq[0]))]
        back: list[list[int]] = []
        for o in seq[1:]:
            e, step, new = self._emission(o), [], []
            for k in range(5):
                j = max(range(5), key=lambda j: best[j] + move[j][k])
                step.append(j)
                new.append(best[j] + move[j][k] + log(e[k]))
            back.append(step)
            best = new
        path = [max(range(5), key=lambda k: best[k])]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


# --- words ------------------------------------------------------------------------------------------------------------
_LETTERS = re.compile(r"[^\W\d_]+")
#: What may be one damaged word: letters with confusable digits and signs among them, no white space or other punctuation.
_TOKEN = re.compile(r"(?<![\w@+!$|€])[\w@+!$|€]*[^\W\d_][\w@+!$|€]*")
_REGULAR = re.compile(r"^(?:[A-Za-z]{1,2}\d{1,4}|\d+(?:st|nd|rd|th|[MBKkx%])|[A-Z]@\d+|[A-Z][a-z]+@\d+|[Vv]\d+|\d[A-Z]|\d+[A-Za-z])$")


def doubtful(token: str) -> bool:
    """Whether a token may be a misread word at all: no number, model name or unit, and no longer than a word with its confusions."""
    low = token.lower()
    return not (len(low) < 3 and low.isalpha() or len(low) > WORD_LETTERS + 3 or low.isdigit() or _REGULAR.match(token))


def variants(low: str, own: int) -> Iterator[tuple[int, str]]:
    """(confusions, word) of the words that ``low``, seen ``own`` times, may stand for: two confusions, or three where there are signs or
    digits among the letters; short words and those seen more than three times have one."""
    letters = low.isalpha()
    deepest = 3 if not letters else 1 if own > 3 or len(low) < 5 else 2
    tried, frontier = {low}, {low}
    for depth in range(1, deepest + 1):
        new = set()
        for w in frontier:
            for read, meant in CONFUSED:
                at = w.find(read)
                while at >= 0:
                    v = w[:at] + meant + w[at + len(read) :]
                    # a confusion clears one sign, so what has more of them than steps are left is no way to a word
                    if v not in tried and sum(not c.isalpha() for c in v) <= deepest - depth:
                        tried.add(v)
                        new.add(v)
                        if v.isalpha():
                            yield depth, v
                    at = w.find(read, at + 1)
        frontier = new


def meant(low: str, own: int, found: list[tuple[int, str, int]]) -> str | None:
    """The word that ``low`` is a misreading of, or None; ``found``: (confusions, word, count) of its variants in the corpus."""
    signs, best = not low.isalpha(), (0, "")
    for depth in (1, 2, 3):
        for d, v, n in found:
            if d == depth and (n > best[0] or n == best[0] and v < best[1]):
                best = (n, v)
        if best[0] and (signs and best[0] >= 2 or _clearly(own, best[0], depth, low)):
            return best[1]
    return None


def _clearly(own: int, meant: int, depth: int, low: str) -> bool:
    """A misreading is rare beside the word it stands for; short words and second confusions need more evidence."""
    rare = own <= 1 or own <= 0.1 * meant
    return rare and meant >= (3 if depth == 1 else 20) * max(1, own) * (4 if len(low) < 4 else 1)


class Words:
    """What the corpus says of the words of some texts: ``counts`` of words seen more than once, and ``corrections`` of misread ones,
    both in lower case."""

    def __init__(self, counts: dict[str, int], corrections: dict[str, str] | None = None):
        self.counts, self.corrections = counts, corrections or {}

    @classmethod
    def of_corpus(cls, counts: dict[str, int], tokens) -> "Words":
        """From the counts of a whole (small) corpus, for the given tokens."""
        fixed = {}
        for low in {t.lower() for t in tokens if doubtful(t)}:
            own = counts.get(low, 0)
            if (m := meant(low, own, [(d, v, counts[v]) for d, v in variants(low, own) if v in counts])) is not None:
                fixed[low] = m
        return cls(counts, fixed)

    def known(self, word: str, least: int = 2) -> bool:
        return self.counts.get(word.lower(), 0) >= least

    def meant(self, token: str) -> str | None:
        return self.corrections.get(token.lower()) if doubtful(token) else None


def lines_of(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def states_of(text: str, model: LineModel) -> str:
    """The state of each line, as digits."""
    return "".join(map(str, model.decode(observe(lines_of(text)))))


def _paragraphs(text: str, states: str, close: Callable[[str, str, str], str | None], kinds: set[str]) -> list[str]:
    """Body lines put together; ``close`` (left part, mark, what follows) gives the closed word and its line, or None where the mark
    divides no word."""
    paragraphs: list[str] = []
    current = ""
    pending: tuple[str, str] | None = None  # left part and mark of a word that the last body line divides
    for line, state in zip(lines_of(text), map(int, states)):
        stripped = line.strip()
        if state == RUNNING:
            kinds.add("running_line")
            if _PAGE_SUFFIX.match(stripped) or _PAGE_PREFIX.match(stripped):
                kinds.add("page_number")
            continue
        if state == PAGE:
            kinds.add("page_number")
            continue
        if state == BREAK or not stripped:
            if current and _STOP.search(current) and pending is None:
                paragraphs.append(current)
                current = ""
            continue
        if state == OTHER:
            if current:
                paragraphs.append(current)
                current, pending = "", None
            paragraphs.append(stripped)
            continue
        joined = close(*pending, stripped) if pending is not None else None
        if joined is not None:
            kinds.add("broken_word")
            current = current[: len(current) - len(pending[0]) - len(pending[1])] + joined
        else:
            current = f"{current} {stripped}" if current else stripped
        m = _MARK.search(line)
        pending = (m["left"], m["mark"]) if m else None
    return [*paragraphs, current] if current else paragraphs


def questions(text: str, states: str) -> tuple[set[str], set[str]]:
    """(tokens, words) of a text that the corpus is asked about: tokens that may be misread, also those a closed word would make, and words
    that decide how a divided one is closed or a token ends."""
    tokens, words = set(), set()

    def ask(text: str) -> None:
        for token in _TOKEN.findall(text):
            core = token.rstrip("!|+")
            if core != token:
                words.add(core.lower())
            tokens.update(t.lower() for t in (token, core) if doubtful(t))

    def close(left: str, mark: str, following: str) -> None:
        if (parts := _divided(left, following)) is not None:
            stem, tail = (x.lower() for x in parts)
            words.update((stem, stem + tail, tail.split("-")[0], stem + tail.split("-")[0]))
        ask(left + following.split(maxsplit=1)[0])  # no token goes beyond white space

    for paragraph in _paragraphs(text, states, close, set()):
        ask(paragraph)
    return tokens, words


def analyse(text: str, states: str, words: Words) -> tuple[list[str], list[str]]:
    """(kinds of damage, repaired paragraphs) of one text of several lines."""
    kinds: set[str] = set()
    paragraphs = _paragraphs(text, states, lambda left, mark, following: _join(left, mark, following, words), kinds)
    repaired = [_TOKEN.sub(lambda m: _correct(m[0], words, kinds), p) for p in paragraphs]
    return [k for k in KINDS if k in kinds], repaired


_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def visible(text: str) -> str:
    """The text without characters that nobody sees, which would make two pieces of a word look like misread words."""
    return text if text.isascii() else _INVISIBLE.sub("", text)


def _divided(left: str, following: str) -> tuple[str, str] | None:
    """The two parts of a word that a line end divides."""
    right = re.match(r"[\w@+!$'’-]+", following)
    return None if right is None else (re.split(r"[^\w@+!$]", left)[-1], right[0])


def _join(left: str, mark: str, following: str, words: Words) -> str | None:
    """The closed word and what follows it, or None where the mark is a dash, a range or a shortened compound."""
    if (parts := _divided(left, following)) is None:
        return None
    stem, tail = parts
    if mark == "-":
        if stem.isdigit() and tail[0].isdigit():
            return None
        if tail.lower() in COORDINATORS and not (words.known(stem + tail) and not words.known(stem, 3)):
            return None
    elif stem.isdigit() and tail[0].isdigit():
        return None
    together = words.counts.get((stem + tail.split("-")[0]).lower(), 0)
    apart = min(words.counts.get(stem.lower(), 0), words.counts.get(tail.split("-")[0].lower(), 0))
    compound = tail[0].isupper() or tail[0].isdigit() or together == 0 and apart >= 2 or apart > 20 * max(1, together)
    return left + ("-" if compound else "") + following


def _correct(token: str, words: Words, kinds: set[str]) -> str:
    core = token.rstrip("!|+") if token[-1:] in "!|+" and words.known(token.rstrip("!|+")) else token
    found = words.meant(core)
    if found is None:
        return token
    kinds.add("misread")
    return (found.upper() if core.isupper() and len(core) > 1 else found.capitalize() if core[0].isupper() else found) + token[len(core) :]


# --- Spark ------------------------------------------------------------------------------------------------------------
def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n) of all words that occur more than once in any text, counted with map-side aggregation."""
    each = chunks.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{2,{WORD_LETTERS}}}"), F.lit(0))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


class Filter:
    """A set of words as bits of a fixed number: what is not in it occurs nowhere; the rest is looked up in the counts. The more words
    a corpus has, the more are looked up in vain; none is lost."""

    def __init__(self, counts: DataFrame, bits: int = FILTER_BITS):
        at = F.crc32(F.encode("word", "utf-8")) % bits + 1
        rows = counts.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
        self.bits, self.bytes = bits, np.zeros(max(bits // 8, 4096), np.uint8)
        for r in rows:  # at most bits / 32,768 of 4 KB each
            self.bytes[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)

    def __contains__(self, word: str) -> bool:
        at = zlib.crc32(word.encode()) % self.bits
        return bool(self.bytes[at >> 3] >> (at & 7) & 1)


def fitted(chunks: DataFrame, sample: int = SAMPLE) -> LineModel:
    """The line model, fitted on the ``sample`` texts of several lines with the smallest hashes of their ids."""
    several = chunks.where(F.col("text").contains("\n")).select("text", F.xxhash64("chunk_id").alias("h"), "chunk_id")
    rows = several.orderBy("h", "chunk_id").limit(sample).select("text").collect()
    return LineModel().fit([observe(lines_of(r["text"])) for r in rows])


def corrections(tokens: DataFrame, counts: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(token, meant) of the distinct ``tokens`` (in lower case) that are misreadings.

    One row a token goes to Python, one per variant that the filter lets through comes back and is joined with the counts; it never
    depends on how often a token occurs, so no word is hot.
    """
    context = tokens.sparkSession.sparkContext
    known = context.broadcast(Filter(counts, bits))
    own = tokens.join(counts.withColumnRenamed("word", "token"), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("own"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = known.value
        for batch in batches:
            out = [(t, n, d, v) for t, n in zip(batch["token"], batch["own"]) for d, v in variants(t, n) if v in seen]
            yield pd.DataFrame(out, columns=["token", "own", "depth", "word"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(t, meant(t, n, [(x["depth"], x["word"], x["n"]) for x in found])) for t, n, found in zip(batch["token"], batch["own"], batch["found"])]
            yield pd.DataFrame([x for x in out if x[1] is not None], columns=["token", "meant"])

    every = own.mapInPandas(expand, "token string, own long, depth int, word string").join(counts, "word")
    found = every.groupBy("token").agg(F.max("own").alias("own"), F.collect_list(F.struct("depth", "word", "n")).alias("found"))
    return found.mapInPandas(decide, "token string, meant string")


def _tested(plain: DataFrame) -> DataFrame:
    """(token) that may be misread in texts without lines to put together; once a batch, then once in all."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs: set[str] = set()  # no token goes beyond white space
            for t in batch["text"]:
                runs.update(visible(t).split())
            yield pd.DataFrame({"token": sorted({x.lower() for token in set(_TOKEN.findall(" ".join(runs))) for x in (token, token.rstrip("!|+")) if doubtful(x)})}, dtype=object)

    return plain.select("text").mapInPandas(tokens, "token string").distinct()


def _picked(plain: DataFrame, fixed: DataFrame, model, bits: int, damaged: bool) -> DataFrame:
    """The texts without lines to put together that hold a misread word or are furniture, labelled; or (not ``damaged``) the others.

    Fixed bits of the misread tokens decide: what they let through in vain is found whole later, none is lost.
    """
    misread = plain.sparkSession.sparkContext.broadcast(Filter(fixed.select(F.col("token").alias("word")), bits))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, lines = misread.value, model.value
        for batch in batches:
            for at in range(0, len(batch), 2000):
                piece = batch.iloc[at : at + 2000]
                clean = [visible(t) for t in piece["text"]]
                runs = [t.split() for t in clean]
                hit = {run for run in set().union(*runs) if any(x.lower() in known or x.rstrip("!|+").lower() in known for x in _TOKEN.findall(run))}
                states = [str(OTHER) * (t.count("\n") + 1) if table else states_of(t, lines) if len(t) < LONG_LINE else str(BODY) for t, table in zip(clean, piece["cells"])]
                take = [not hit.isdisjoint(r) or s in (str(RUNNING), str(PAGE)) for r, s in zip(runs, states)]
                if not damaged:
                    yield pd.DataFrame([(i, [], t.strip()) for i, t, x in zip(piece["chunk_id"], piece["text"], take) if not x], columns=["chunk_id", "kinds", "text"])
                    continue
                asked = [(i, t, s, *(sorted(x) for x in questions(t, s)), "\n" if table else "\n\n") for i, t, s, table, x in zip(piece["chunk_id"], clean, states, piece["cells"], take) if x]
                yield pd.DataFrame(asked, columns=["chunk_id", "text", "states", "tokens", "words", "apart"])

    return plain.mapInPandas(pick, _LABELLED if damaged else "chunk_id long, kinds array<string>, text string")


_LABELLED = "chunk_id long, text string, states string, tokens array<string>, words array<string>, apart string"


def repaired(chunks: DataFrame, *, whole: bool = False, untouched: bool = True, sample: int = SAMPLE, bucket_chars: int = BUCKET_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """(chunk_id, kinds, text) of the chunks of several lines that are no tables: kinds of damage and the clean paragraphs,
    parted by an empty line. ``whole``: of all chunks with any text.

    A text of one line and a table have no lines to put together, but their words may be misread and a short line may be a page number
    or running line: they are tested where they lie, and only what has damage is moved; the lines of a table stay lines. The others come
    out as they are, or not at all (not ``untouched``). A text that is null or empty is left out; its state is 'not scanned'.

    Texts are dealt by a hash of their id to buckets of about ``bucket_chars`` characters; a bucket meets the corrections and counts of its
    own tokens only, so what a task holds does not grow with the corpus.
    """
    cells = F.coalesce(F.col("content_type") == "table", F.lit(False))
    candidates = chunks.where(F.col("text").contains("\n") & ~cells).select("chunk_id", "text")
    counts = cut(word_counts(chunks))
    sent = chunks.sparkSession.sparkContext.broadcast(fitted(candidates, sample))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            done: dict[str, tuple] = {}
            for t in batch["text"]:
                if t not in done:
                    states = states_of(t, model)
                    done[t] = (states, *(sorted(x) for x in questions(t, states)))
            yield batch.assign(states=[done[t][0] for t in batch["text"]], tokens=[done[t][1] for t in batch["text"]], words=[done[t][2] for t in batch["text"]], apart="\n\n")

    labelled = cut(candidates.mapInPandas(label, _LABELLED))
    tokens = labelled.select(F.explode("tokens").alias("token")).distinct()
    if whole:
        plain = chunks.where((F.col("text") != "") & (~F.col("text").contains("\n") | cells)).select("chunk_id", "text", cells.alias("cells"))
        tokens = tokens.union(_tested(plain)).distinct()
    fixed = corrections(tokens, counts, bits)
    if whole:
        fixed = cut(fixed)
        labelled = labelled.unionByName(cut(_picked(plain, fixed, sent, bits, True)))
    size = labelled.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // bucket_chars))
    labelled = labelled.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int"))
    asked = labelled.select("bucket", F.explode("tokens").alias("token")).distinct()
    words = labelled.select("bucket", F.explode("words").alias("word")).distinct().join(counts, "word").select("bucket", "word", "n", F.lit(None).cast("string").alias("meant"))
    told = asked.join(fixed, "token").select("bucket", F.col("token").alias("word"), F.lit(None).cast("long").alias("n"), "meant").unionByName(words)

    def run(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        counted, corrected = told[told["meant"].isna()], told[told["meant"].notna()]
        known = Words(dict(zip(counted["word"], counted["n"].astype("int64"))), dict(zip(corrected["word"], corrected["meant"])))
        done: dict[tuple, tuple] = {}
        for key in zip(texts["text"], texts["states"], texts["apart"]):
            if key not in done:
                kinds, paragraphs = analyse(key[0], key[1], known)
                done[key] = kinds, key[2].join(paragraphs)
        found = [done[key] for key in zip(texts["text"], texts["states"], texts["apart"])]
        return pd.DataFrame({"chunk_id": texts["chunk_id"], "kinds": [k for k, _ in found], "text": [t for _, t in found]})

    texts = labelled.select("bucket", "chunk_id", "text", "states", "apart")
    told = told.toDF("at", "word", "n", "meant")  # names of its own, as both sides come from one table
    done = texts.groupBy("bucket").cogroup(told.groupBy("at")).applyInPandas(run, "chunk_id long, kinds array<string>, text string")
    return done.unionByName(_picked(plain, fixed, sent, bits, False)) if whole and untouched else done


def damage(chunks: DataFrame, **bounds) -> DataFrame:
    """(chunk_id, kind), one row per chunk and kind of damage, whatever the chunk holds."""
    return repaired(chunks, whole=True, untouched=False, **bounds).select("chunk_id", F.explode("kinds").alias("kind"))
