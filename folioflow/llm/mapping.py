"""Problem 3: freely typed values mapped to the closest entry of a reference list.

Method: one multi-pattern automaton over names, labels and keywords with their inflections finds embedded mentions; the
longest non-overlapping match wins where only function words and adverbs remain around it. Remaining values go to
token-set similarity: the share of letters of the value and of a phrase that stand in tokens both have, in any order, where tokens compare
by restricted edit distance. Values whose spaces have moved are compared as one token. A value that opens with another letter than
the phrase is taken for a misspelling only where the table shows it: it must be ten times rarer than the phrase it stands for.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Largest part of the reference list that is sent out at once.
MAX_ENTRIES = 5000
#: Distinct values that a Python worker remembers.
MEMO = 200_000
#: How many times a phrase must occur beside a value that differs from it in the first letter ("reaches", "breaches").
RARER = 10

# Words that may stand around a mention without changing it, and wordings no inflection rule yields.
FILLERS = {"is", "was", "are", "were", "be", "been", "being", "has", "have", "had", "a", "an", "the", "it", "to", "can", "will", "does", "do", "makes", "make", "made"}
ADVERBS = {"also", "often", "mainly", "directly", "mostly", "partly", "usually", "always", "sometimes", "again", "now", "then", "still", "just", "thus", "only", "even", "well", "very", "further", "generally", "clearly"}
PARTICLES = {"on", "of", "by", "with", "from", "to", "in", "than", "as", "for", "into", "at", "via", "forward", "up", "down", "out"}
IRREGULAR = {
    "beat": ("beats", "beat", "beaten", "beating"), "put": ("puts", "put", "putting"), "build": ("builds", "built", "building"), "cut": ("cuts", "cut", "cutting"),
    "be": ("is", "was", "being", "been"), "ship": ("ships", "shipped", "shipping"), "tag": ("tags", "tagged", "tagging"), "look": ("looks", "looked", "looking"),
    "label": ("labels", "labelled", "labeled", "labelling", "labeling"), "embed": ("embeds", "embedded", "embedding"), "emit": ("emits", "emitted", "emitting"), "output": ("outputs", "output", "outputted", "outputting"),
    "forecast": ("forecasts", "forecast", "forecasted", "forecasting"), "fine-tune": ("fine-tunes", "fine-tuned", "fine-tuning", "finetune", "finetunes", "finetuned", "finetuning"),
    "pretrain": ("pretrains", "pretrained", "pretraining", "pre-train", "pre-trains", "pre-trained", "pre-training"), "component": ("component", "components"), "kind": ("kind", "kinds"), "instance": ("instance", "instances"),
    "type": ("type", "types"), "part": ("part", "parts"), "versus": ("versus", "vs"), "employ": ("employs", "employed", "employing"), "anticipate": ("anticipates", "anticipated", "anticipating"),
}
WORDINGS = {"use": ("make use of", "makes use of", "made use of", "making use of"), "depend": ("dependent", "dependence"), "measure": ("measured via",), "embed": ("embedding of",), "cut": ("cut down", "cutting down"), "beat": ("has beaten",)}


def plain(value: str) -> str:
    """Lower-cased words of ``value`` with single spaces: wrappers dropped, camel case and separators split."""
    text = unicodedata.normalize("NFKC", value)
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def inflections(word: str) -> set[str]:
    """The word itself and its regular or listed forms, in British and American spelling."""
    forms = {word, *IRREGULAR.get(word, ())}
    if len(forms) == 1:
        stem = word[:-1] if word.endswith("e") else word
        forms |= {word + ("es" if re.search(r"(s|x|z|ch|sh)$", word) else "s"), stem + "ed", stem + "ing"}
        if re.search(r"[^aeiou]y$", word):
            forms |= {word[:-1] + "ies", word[:-1] + "ied"}
    for form in list(forms):
        if re.search(r"iz(e|es|ed|ing)$", form):
            forms.add(re.sub(r"iz(?=(e|es|ed|ing)$)", "is", form))
    return forms


def base_of(word: str) -> str:
    """A base for the head of a canonical name, e.g. proposes -> propose, trained -> train."""
    if word.endswith("ies"):
        return word[:-3] + "y"
    for known, forms in IRREGULAR.items():
        if word in forms:
            return known
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and word != "is" else word


def phrases(name: str, label: str | None, keywords: list[str] | None) -> set[str]:
    """All phrases that stand for one entry."""
    found = {plain(label)} if label else set()
    for phrase in [name.replace("_", " "), *(k for k in keywords or () if k)]:
        head, _, rest = phrase.strip().lower().partition(" ")
        heads = inflections(base_of(head)) | {head}
        if head.endswith("ed"):  # a participle as a name: compared -> compare, trained -> train
            heads |= inflections(head[:-1]) | inflections(head[:-2])
        for form in heads:
            found.add(plain(f"{form} {rest}"))
        if head == "be" and rest:
            found.add(plain(rest))
        for form in WORDINGS.get(base_of(head), ()):
            found.add(plain(form if form.split()[-1] in ("of", "via", "down") or not rest else f"{form} {rest}"))
    return {x for x in found if x}


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most`` + 1 as soon as it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _letters(text: str) -> int:
    """The set of characters as bits, to rule out most pairs before their distance is computed."""
    bits = 0
    for c in text:
        bits |= 1 << (ord(c) & 31)
    return bits


def tolerated(size: int) -> int:
    """Edits that a text of ``size`` letters may have: none under three, where any would make another word."""
    return 0 if size < 3 else 1 if size <= 7 else 2 if size <= 13 else 3


def _opens_alike(a: str, b: str) -> bool:
    return a[:1] == b[:1] or a[:2] == b[1::-1]


class Mapper:
    """Values -> entry id, 0 where none fits. ``entries``: (id, name, label, keywords); ``extra``: squeezed values known to be
    misspellings -> id."""

    def __init__(self, entries: list[tuple[int, str, str | None, list[str] | None]], extra: dict[str, int] | None = None):
        self.phrase_of: dict[str, int] = {}
        self.extra = extra or {}
        for id_, name, label, keywords in entries:
            for p in phrases(name, label, keywords):
                self.phrase_of.setdefault(p, id_)
        self.automaton = ahocorasick.Automaton()
        for p, id_ in self.phrase_of.items():
            self.automaton.add_word(f" {p} ", (len(p), id_))
        if self.phrase_of:
            self.automaton.make_automaton()
        # tokens of all phrases by length, and the phrases of each token
        self.phrases_with: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for p, id_ in self.phrase_of.items():
            tokens = tuple(p.split())
            for t in dict.fromkeys(tokens):
                self.phrases_with.setdefault(t, []).append((tokens, id_))
        self.tokens = _by_length(self.phrases_with)
        # squeezed forms for values whose spaces have moved, with the openings that inflected wordings take
        self.squeezed: dict[str, int] = {}
        for p, id_ in self.phrase_of.items():
            last = p.rpartition(" ")[2]
            openings = ("", "is", "was", "a", "an", "isa", "isan") if last == "of" else ("", "is", "was") if " " in p and last in PARTICLES else ("",)
            for opening in openings:
                self.squeezed.setdefault(opening + p.replace(" ", ""), id_)
        self.by_length = _by_length(self.squeezed)
        self.near = lru_cache(MEMO)(self._near)
        self.map = lru_cache(MEMO)(self._map)

    def _mention(self, words: list[str]) -> tuple[int, int, int] | None:
        """(-letters, place, entry) of the longest mention with nothing but fillers and adverbs around it."""
        text = " " + " ".join(words) + " "
        found = sorted(((size, end - size, id_) for end, (size, id_) in self.automaton.iter(text)), key=lambda x: (-x[0], x[1]))
        for size, start, id_ in found:
            rest = (text[:start] + " " + text[start + size :]).split()
            if all(w in FILLERS or is_adverb(w) for w in rest):
                return -size, start, id_
        return None

    def _near(self, token: str) -> dict[str, int]:
        """Tokens of phrases within the tolerated edits of ``token`` -> number of edits."""
        return dict(_within(token, self.tokens, tolerated(len(token))))

    def _token_set(self, words: list[str]) -> tuple[int, int, int] | None:
        """(letters that differ, fillers left, entry) of the most similar phrase as sets of tokens; fillers of the value count in ties only."""
        words = list(dict.fromkeys(words))
        near = {w: self.near(w) for w in words}
        size = sum(map(len, words))
        best = None
        for phrase, id_ in dict.fromkeys(x for w in words for t in near[w] for x in self.phrases_with[t]):
            cost, free = 0, list(words)
            for t in phrase:
                d, w = min(((near[w][t], w) for w in free if t in near[w]), default=(len(t), None))
                cost += d
                if w is not None:
                    free.remove(w)
            cost += sum(len(w) for w in free if w not in FILLERS)
            if cost <= tolerated(size):
                best = min(best or (cost, len(free), id_), (cost, len(free), id_))
        return best

    def _closest(self, text: str) -> tuple[int, int, int] | None:
        """(edits, 0, entry) of the nearest squeezed phrase."""
        if (hit := self.squeezed.get(text)) is not None:
            return 0, 0, hit
        return min(((d, 0, self.squeezed[s]) for s, d in _within(text, self.by_length, tolerated(len(text)))), default=None)

    def ranked(self, value: str) -> tuple[int, int, int, int] | None:
        """(tier, ..., entry), the smaller the better, so that results over parts of a reference list can be put together: a mention,
        near-equal tokens, a phrase behind an adverb without space, other similarity, a first letter that the table corrects."""
        words = plain(value).split()
        if not words or not self.phrase_of:
            return None
        if (hit := self._mention(words)) is not None:
            return 0, *hit
        words = [w for w in words if not is_adverb(w)] or words
        text = "".join(words)
        apart = self._token_set(words)
        if apart is not None and apart[0] <= 1:
            return 1, *apart
        behind = [x for a in ADVERBS if text.startswith(a) and len(text) > len(a) + 2 and (x := self._closest(text[len(a) :]))]
        if behind:
            return 2, *min(behind)
        similar = [x for x in (apart, self._closest(text)) if x is not None]
        if similar:
            return 3, *min(similar)
        return (4, 0, 0, self.extra[text]) if text in self.extra else None

    def _map(self, value: str) -> int:
        hit = self.ranked(value)
        return hit[-1] if hit else 0


def is_adverb(word: str) -> bool:
    return word in ADVERBS or word.endswith("ly") and len(word) > 4


def _by_length(texts) -> dict[int, list[tuple[str, int]]]:
    out: dict[int, list[tuple[str, int]]] = {}
    for s in texts:
        out.setdefault(len(s), []).append((s, _letters(s)))
    return out


def _within(text: str, known: dict[int, list[tuple[str, int]]], most: int):
    """(known text, edits) of those within ``most`` edits that open alike."""
    own = _letters(text)
    for length in range(len(text) - most, len(text) + most + 1):
        for s, letters in known.get(length, ()):
            if (own & ~letters).bit_count() > most or (letters & ~own).bit_count() > most or not _opens_alike(s, text):
                continue
            d = edit_distance(text, s, most)
            if d <= most:
                yield s, d


def other_openings(squeezed: dict[str, int]) -> dict[str, str]:
    """Values that differ from a phrase (of five letters or more) in the first letter only, dropped, changed or put in front of it -> the phrase."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    out: dict[str, str] = {}
    for s in sorted(squeezed):
        if len(s) >= 5 and s.isascii():
            for v in (s[1:], *(c + s[1:] for c in letters), *(c + s for c in letters)):
                if v not in squeezed:
                    out.setdefault(v, s)
    return out


def misspelt_openings(df: DataFrame, value: str, entries: list[tuple]) -> dict[str, int]:
    """The values of ``df`` that differ from a phrase in the first letter and are ``RARER`` times rarer -> entry. Counted by one
    aggregation over all rows; what comes back is at most 53 rows a phrase of the (bounded) reference list."""
    mapper = Mapper(entries)
    doubtful = other_openings(mapper.squeezed)
    if not doubtful:
        return {}
    wanted = df.sparkSession.createDataFrame([(x,) for x in {*doubtful, *doubtful.values()}], "s string")
    squeezed = df.select(F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", "")).alias("s"))
    counts = {r["s"]: r["n"] for r in squeezed.join(F.broadcast(wanted), "s", "left_semi").groupBy("s").agg(F.count("*").alias("n")).collect()}
    return {v: mapper.squeezed[s] for v, s in doubtful.items() if v in counts and counts[v] * RARER <= counts.get(s, 0)}


def reference_blocks(relation_types: DataFrame, size: int = MAX_ENTRIES) -> list[list[tuple]]:
    """The reference list in blocks of ``size`` entries by id, each small enough to be sent out."""
    named = relation_types.where("relation_id is not null and std_relation is not null").select("relation_id", "std_relation", "label_zh", "keywords")
    blocks: list[list[tuple]] = [[]]
    for r in named.orderBy("relation_id").toLocalIterator():
        if len(blocks[-1]) == size:
            blocks.append([])
        blocks[-1].append((r[0], r[1], r[2], r[3]))
    return blocks


_MAPPERS: dict[tuple, Mapper] = {}


def _mapper(key: tuple, extra: tuple) -> Mapper:
    if (key, extra) not in _MAPPERS:
        _MAPPERS.clear()
        _MAPPERS[key, extra] = Mapper([(a, b, c, list(d)) for a, b, c, d in key], dict(extra))
    return _MAPPERS[key, extra]


def _mapping(entries: list[tuple], extra: dict[str, int], whole: bool):
    """The mapping of one block of entries as a column function: the entry, or (not ``whole``) the rank that ends with it."""
    key, also = tuple((a, b, c, tuple(d or ())) for a, b, c, d in entries), tuple(sorted(extra.items()))

    @F.pandas_udf("int")
    def mapped(values: pd.Series) -> pd.Series:
        mapper = _mapper(key, also)
        codes, distinct = pd.factorize(values)
        done = [mapper.map(x) for x in distinct] + [None]
        return pd.Series([done[i] for i in codes], dtype="Int32")

    @F.pandas_udf("array<int>")
    def ranked(values: pd.Series) -> pd.Series:
        mapper = _mapper(key, also)
        codes, distinct = pd.factorize(values)
        done = [mapper.ranked(x) for x in distinct] + [None]
        return pd.Series([done[i] for i in codes], dtype=object)

    return mapped if whole else ranked


def map_values(df: DataFrame, value: str, blocks: list[list[tuple]], output: str = "entry_id", extra: list[dict[str, int]] | None = None) -> DataFrame:
    """``df`` plus ``output``: the entry of ``value``, 0 where none fits, null where the value is null or blank.

    There is no shuffle: each Arrow batch maps its distinct values, and a worker remembers what it mapped. A list of several
    blocks is met block by block, and the best rank over all of them decides, as one list would.
    """
    extra = extra or [{} for _ in blocks]
    given = F.when(F.col(value).rlike(r"[^\s\p{Z}]"), F.col(value))
    if len(blocks) == 1:
        return df.withColumn(output, _mapping(blocks[0], extra[0], True)(given))
    best = F.array_min(F.filter(F.array(*(_mapping(b, e, False)(given) for b, e in zip(blocks, extra))), lambda r: r.isNotNull()))
    return df.withColumn(output, F.when(given.isNotNull(), F.coalesce(F.element_at(best, -1), F.lit(0))))


def map_relations(triples: DataFrame, relation_types: DataFrame, size: int = MAX_ENTRIES) -> DataFrame:
    """(triple_id, relation, relation_id) of the triples whose relation is not blank and not already canonical."""
    blocks = reference_blocks(relation_types, size)
    free = triples.select("triple_id", "relation").where(F.col("relation").rlike(r"[^\s\p{Z}]"))
    if len(blocks) == 1:
        free = free.where(~F.col("relation").isin([e[1] for e in blocks[0]]))
    else:
        free = free.join(relation_types.where("relation_id is not null").select(F.col("std_relation").alias("relation")).distinct(), "relation", "left_anti").select("triple_id", "relation")
    return map_values(free, "relation", blocks, "relation_id", [misspelt_openings(triples, "relation", b) for b in blocks])
