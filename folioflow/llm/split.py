"""Problem 7: items over a size limit, cut into pieces under the limit at natural boundaries, with overlap.

Method: the least number of pieces that can hold the text sets equally spaced targets; each target snaps to the
strongest boundary near it (ties: the nearest); if a piece breaks the limit, one more piece is planned.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

TEXT_LIMIT, TEXT_OVERLAP, SECTION_LIMIT = 500, 50, 80

#: Natural boundaries of a text: after a line break, after a full-width stop, after . ! or ? before white space.
NATURAL = re.compile(r"\n|[。！？；]|[.!?](?=\s)")
LEVEL = re.compile(r" > ")
_PARAGRAPH, _SENTENCE_END, _CLAUSE, _SPACE = re.compile(r"\n\s*\n"), re.compile(r"[。！？]|[.!?](?=\s)"), re.compile(r"[；;,，:：]"), re.compile(r"\s")


def stretches(text: str, natural: re.Pattern = NATURAL) -> list[str]:
    ends = [m.end() for m in natural.finditer(text)]
    return [text[a:b].strip() for a, b in zip([0, *ends], [*ends, len(text)])]


def levels(section: str) -> list[str]:
    return [x.strip() for x in section.split(" > ")]


def kind_of(parts: list[str], limit: int) -> str:
    """'hard' where one stretch alone is over the limit, so that a cut inside it is unavoidable."""
    return "hard" if any(len(x) > limit for x in parts) else "soft"


def boundaries(text: str) -> dict[int, int]:
    """Cut position -> strength: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 space. Any other position has 0."""
    found: dict[int, int] = {}
    for strength, pattern in ((1, _SPACE), (2, _CLAUSE), (3, _SENTENCE_END), (4, re.compile(r"\n")), (5, _PARAGRAPH)):
        for m in pattern.finditer(text):
            found[m.end()] = strength
    found.pop(len(text), None)
    return found


def level_boundaries(section: str) -> dict[int, int]:
    found = {m.end(): 1 for m in _SPACE.finditer(section)}
    for m in LEVEL.finditer(section):
        found[m.end()] = 5
    found.pop(len(section), None)
    return found


def cut_points(n: int, at: dict[int, int], limit: int, overlap: int) -> list[int]:
    """Cut positions in a text of ``n`` characters so that each piece, with its overlap in front, is within ``limit``."""
    if n <= limit:
        return []
    room = limit - overlap  # what each piece after the first adds
    count = max(2, math.ceil((n - limit) / room) + 1)
    while True:
        step, reach = n / count, max(1, n // count // 2)
        cuts: list[int] = []
        for k in range(1, count):
            target, before = round(k * step), cuts[-1] if cuts else 0
            latest = min(n - 1, before + (limit if not cuts else room))
            low, high = max(before + 1, target - reach), min(latest, target + reach)
            if low > high:
                low = high = max(before + 1, latest)
            near = [p for p in range(low, high + 1) if p in at]
            cuts.append(max(near, key=lambda p: (at[p], -abs(p - target), -p)) if near else min(max(target, low), high))
        edges = [0, *cuts, n]
        if all(0 < b - a <= (limit if a == 0 else room) for a, b in zip(edges, edges[1:])):
            return cuts
        count += 1


def split_text(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each piece but the first starts ``overlap`` characters before the last one's end."""
    cuts = cut_points(len(text), boundaries(text), limit, overlap)
    edges = [0, *cuts, len(text)]
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(edges, edges[1:])]


def split_section(section: str, limit: int = SECTION_LIMIT) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a section path: whole levels where they fit, else words; no overlap."""
    edges = [0, *cut_points(len(section), level_boundaries(section), limit, 0), len(section)]
    return list(zip(edges, edges[1:]))


_PIECES = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("pieces", T.ArrayType(T.StringType())),
])


def _splitter(is_text: bool, limit: int, overlap: int):
    @F.pandas_udf(_PIECES)
    def run(values: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(values)
        done = []
        for x in distinct:
            spans = split_text(x, limit, overlap) if is_text else split_section(x, limit)
            done.append((kind_of(stretches(x) if is_text else levels(x), limit), [a for a, _ in spans], [x[a:b] for a, b in spans]))
        done.append((None, None, None))
        return pd.DataFrame([done[i] for i in codes], columns=["kind", "starts", "pieces"])

    return run


def oversized(chunks: DataFrame, *, text_limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP, section_limit: int = SECTION_LIMIT) -> DataFrame:
    """One row per oversized field: (chunk_id, field, section, kind, starts, pieces).

    Null and short values are no cases. A text without any boundary is cut at the balanced targets. Repeated chunks
    count each; extra columns are ignored. Only values over the limit reach Python.
    """
    texts = chunks.where(F.length("text") > text_limit).select("chunk_id", F.lit("text").alias("field"), "section", _splitter(True, text_limit, overlap)("text").alias("r"))
    sections = chunks.where(F.length("section") > section_limit).select("chunk_id", F.lit("section").alias("field"), "section", _splitter(False, section_limit, 0)("section").alias("r"))
    return texts.unionByName(sections).select("chunk_id", "field", "section", "r.kind", "r.starts", "r.pieces")


def pieces(chunks: DataFrame, **limits: int) -> DataFrame:
    """The pieces themselves: (chunk_id, field, piece, start, text, section); text pieces keep their chunk's section."""
    each = oversized(chunks, **limits).select("chunk_id", "field", "section", F.posexplode(F.arrays_zip("starts", "pieces")).alias("piece", "p"))
    return each.select("chunk_id", "field", "piece", F.col("p.starts").alias("start"), F.col("p.pieces").alias("text"), F.when(F.col("field") == "text", F.col("section")).alias("section"))
