"""Problem 9: passages of held-out evaluation items inside corpus documents.

Method: one Aho-Corasick automaton over the normalised word windows of all items; each text is normalised once, scanned
once, and hits are mapped back to character offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Consecutive words that count as a leak, and the largest part of the evaluation set that is sent out at once.
WINDOW, MAX_ITEMS = 10, 100_000
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Windows:
    """All windows of ``size`` words of the items. An item shorter than that cannot leak by definition."""

    def __init__(self, items: list[tuple[int, str]], size: int = WINDOW):
        self.size = size
        owners: dict[str, set[int]] = {}
        for id_, text in items:
            w = words(text or "")
            for i in range(len(w) - size + 1):
                owners.setdefault(" " + " ".join(w[i : i + size]) + " ", set()).add(id_)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word(window, (len(window), tuple(sorted(ids))))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (start, end, words): span from the first to the last leaked word in ``text`` and leaked windows' words."""
        if self.empty:
            return {}
        flat = f" {' '.join(words(text))} "
        hits = [(end - size + 1, end, ids) for end, (size, ids) in self.automaton.iter(flat)]
        if not hits:
            return {}
        # word number by position in the flat text, then the character span of that word in the original
        spans = [m.span() for m in WORD.finditer(text.lower())] if len(text.lower()) == len(text) else None
        found: dict[int, list] = {}
        for a, b, ids in hits:
            first = flat.count(" ", 0, a)
            for id_ in ids:
                found.setdefault(id_, set()).update(range(first, first + self.size))
        return {id_: (spans[min(at)][0] if spans else None, spans[max(at)][1] if spans else None, len(at)) for id_, at in found.items()}


_CACHE: dict[tuple, Windows] = {}


def item_blocks(items: DataFrame, size: int) -> Iterator[tuple]:
    """The items in blocks of at most ``size``, in the order of their ids."""
    block: list[tuple[int, str]] = []
    for r in items.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        if len(block) == size:
            yield tuple(block)
            block = []
        block.append((r[0], r[1]))
    yield tuple(block)


def leaks(documents: DataFrame, items: DataFrame, *, window: int = WINDOW, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, leaked_words), one row per document and item of which ``window``
    consecutive words stand in the document.

    Null texts, and items with fewer words than the window, give no rows. Repeated documents count each. The corpus is
    scanned in place, without a shuffle, once for each ``max_items`` items; the result is that of one automaton over all (an item
    id that stands in several rows is found once for each). Offsets are characters of the original text, null in the rare text
    whose lower-cased form has another length.
    """
    found = [_scan(documents, block, window) for block in item_blocks(items, max_items)]
    return reduce(DataFrame.unionByName, found)


def _scan(documents: DataFrame, key: tuple, window: int) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast((window, key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, known = sent.value
        mark = (size, len(known), hash(known))
        if mark not in _CACHE:
            _CACHE.clear()
            _CACHE[mark] = Windows(list(known), size)
        windows = _CACHE[mark]
        for batch in batches:
            out, memo = [], {}
            for id_, text in zip(batch["doc_id"], batch["text"]):
                if text not in memo:
                    memo[text] = windows.scan(text)
                out += [(id_, item, *at) for item, at in memo[text].items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "start_char", "end_char", "leaked_words"]).astype({"start_char": "Int64", "end_char": "Int64"})

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, "doc_id long, item_id long, start_char long, end_char long, leaked_words int")
