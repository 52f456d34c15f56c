"""Problem 1: groups of texts that are nearly the same, without comparing all pairs.

Method: covering locality-sensitive hashing. A text is the bit vector of its words. Structured masks of two bits each, both
in one of ``g`` blocks of the vocabulary, are applied to the rarest words of a text; every pair within the radius that
the similarity threshold implies is guaranteed to collide under one mask:

* two sets with at least ``o`` common words share at least ``m`` words among the ``size - o + m`` rarest of each (in one
  global order), whatever ``m`` is;
* with ``m = g + 1`` common words in ``g`` blocks, one block holds two of them, and that pair of bits is a mask.

The classic family (2^(r+1) - 1 dense masks) needs hundreds of tables at the radius of 14 to 20 bits that 0.7 means here; this one
needs about 0.8 masks a word and keeps the guarantee. With ``m = 2 g + 1`` one block holds three common words: masks of three bits, for
collections so large that pairs of words meet too often. Buckets over a fixed size get two more bits by the same argument; what
stays large, as a group of near copies does, is cut into cells. So no bucket grows with the collection. Masks are made, shuffled and
joined in rounds, a part of the blocks at a time, so that disk holds no more than a fixed multiple of the texts. A parity sketch of 256 bits,
whose Hamming distance never exceeds the true one, refuses most chance collisions inside the join; what is left is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.operators.components import connected_components
from folioflow.runtime import cut, release, small_side

#: Similarity as a fraction, least number of distinct words, slots of the frequency table (4 bytes each are broadcast,
#: whatever the corpus holds), and the bucket size above which a mask gets two more bits.
NUM, DEN, LEAST_WORDS, SLOTS, HOT = 7, 10, 20, 1 << 18, 2048
#: How often bits are added (each time a row becomes about twenty, which pays once), and most keys of large buckets that are sent
#: out (8 bytes each; where there are more, the largest are, and the others stay as they are).
DEPTH, HOT_KEYS = 1, 1 << 21
#: Sizes at which a new level begins, and its blocks: by the bits of a mask. Blocks of all levels are multiples of the first.
WIDTHS = {2: ((20, 8), (64, 16), (205, 32), (656, 64), (2100, 128), (6720, 256), (21504, 512)), 3: ((20, 6), (64, 18), (205, 54), (656, 162), (2100, 486), (6720, 1458), (21504, 4374))}
LEVELS = WIDTHS[2]
#: Texts from which the cost of each width is estimated and, at least, hot masks are counted (neither decides what is found); how many
#: comparisons cost as much as a row; bytes of a shuffled row; and bytes that a round may shuffle where the texts have fewer.
TRIED, COUNTED, ROW_COST, ROW_BYTES, ROUND_BYTES = 6_000, 500_000, 300, 48, 256 << 20


def word_sets(texts: DataFrame, id_column: str, text_column: str, least: int = LEAST_WORDS) -> DataFrame:
    """(id, words): the distinct words of each text, longest runs of letters and digits in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return texts.select(F.col(id_column).cast("long").alias("id"), words.alias("words")).where((F.size("words") >= least) & F.col("id").isNotNull())


def classes_of_equal_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): (id, rep) of every text, and (id, words) of the least id of each class of equal sets.

    Words are kept as one string a text and only once; what finds the classes is hashes.
    """
    key = F.array_join(F.array_sort("words"), " ")
    keyed = cut(sets.select("id", F.xxhash64(key).alias("k1"), F.md5(key).alias("k2")))
    reps = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    members = cut(keyed.join(reps, ["k1", "k2"]).select("id", "rep"))
    kept = cut(sets.join(small_side(members.where("id <> rep").select("id")), "id", "left_anti").select("id", F.array_join("words", " ").alias("text")))
    release(sets.sparkSession)
    return members, kept.select("id", F.split("text", " ").alias("words"))


def slot_counts(reps: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Number of texts by slot of a word's hash: a frequency order of fixed size that is the same for every text."""
    each = reps.select(F.explode("words").alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(slots)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    found = each.toPandas()  # at most ``slots`` rows, whatever the corpus holds
    table = np.zeros(slots, np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def _ceil(a: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-a * num // den)


def _mix(a: np.ndarray, b: np.ndarray, c: int | np.ndarray = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (np.left_shift(b, np.uint64(31)) | np.right_shift(b, np.uint64(33)))
        x = (x + np.uint64(c) if np.isscalar(c) else x + c.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))


class Masks:
    """The mask family for one threshold; all methods work on flat arrays of many texts."""

    def __init__(self, counts: np.ndarray, num: int = NUM, den: int = DEN, width: int = 2):
        self.counts, self.num, self.den, self.width, self.levels = counts, num, den, width, WIDTHS[width]

    def ordered(self, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text from rare to frequent: (hash, text number, position)."""
        text = np.repeat(np.arange(len(size)), size)
        slot = np.mod(hashes.view(np.int64), len(self.counts))
        order = np.lexsort((hashes, self.counts[slot], text))
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        return hashes[order], text, np.arange(len(text)) - begin[text]

    def prefix(self, size: np.ndarray, common: int | np.ndarray, small: bool) -> np.ndarray:
        """How many of the rarest words surely hold ``common`` of the shared ones: for any partner, or (``small``) for one
        that is no smaller."""
        shared = _ceil(size, 2 * self.num, self.num + self.den) if small else _ceil(size, self.num, self.den)
        return np.minimum(size, size - shared + common)

    @staticmethod
    def _pairs(w: np.ndarray, t: np.ndarray, p: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of words of a text that fall in one block: arrays w, t, p sorted so, and the two index arrays."""
        block = ((w >> np.uint64(40)) % blocks.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((p, block, t))
        w, t, p, run = w[order], t[order], p[order], (t * (1 << 20) + block)[order]
        for lag in range(1, len(run)):
            i = np.flatnonzero(run[lag:] == run[:-lag])
            if not len(i):
                break
            yield w, t, p, i, i + lag

    def keys(self, hashes: np.ndarray, size: np.ndarray, part: tuple[int, int] = (0, 1)) -> "Rows":
        """All masks of all texts; or those of round ``part[0]`` of ``part[1]``, by the block and, beyond the least number of blocks, the key."""
        word, text, pos = self.ordered(hashes, size)
        base = min(part[1], self.levels[0][1])
        shares = -(-part[1] // base)
        block = (word >> np.uint64(40)) % np.uint64(self.levels[0][1]) % np.uint64(base) == np.uint64(part[0] % base)
        out = []
        for level, (low, g) in enumerate(self.levels):
            high = self.levels[level + 1][0] if level + 1 < len(self.levels) else np.iinfo(np.int64).max
            own = (size >= low) & (size < high)
            below = (size < low) & (size * self.den >= low * self.num) if level else np.zeros(len(size), bool)
            common = (self.width - 1) * g + 1
            small_prefix = self.prefix(size, common, True)
            length = np.where(own, self.prefix(size, common, False), np.where(below, small_prefix, 0))
            take = (pos < length[text]) & block
            for w, t, p, *at in self._bits(word[take], text[take], pos[take], np.full(take.sum(), g)):
                key = _mix(w[at[0]], w[at[1]], level + 1)
                for k in at[2:]:
                    key = _mix(key, w[k])
                mine = np.flatnonzero((key >> np.uint64(9)) % np.uint64(shares) == np.uint64(part[0] // base)) if shares > 1 else slice(None)
                key, at = key[mine], [k[mine] for k in at]
                i = at[0]
                small = np.logical_and.reduce([p[k] < small_prefix[t[i]] for k in at])
                out.append(Rows(key, t[i], small, np.full(len(i), level), np.minimum.reduce([self.seen(w[k]) for k in at]), np.stack([p[k] for k in at], 1)))
        return Rows.joined(out, self.width)

    def _bits(self, w: np.ndarray, t: np.ndarray, p: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """All pairs or threes of words of a text that fall in one block: arrays w, t, p sorted so, and the index arrays."""
        for w, t, p, i, j in self._pairs(w, t, p, blocks):
            if self.width == 2:
                yield w, t, p, i, j
            elif len(i):
                for lag in range(1, int(j[0] - i[0])):  # a text's words of a block stand together, so what is between is of it too
                    yield w, t, p, i, i + lag, j

    def seen(self, words: np.ndarray) -> np.ndarray:
        """In how many texts each word can be at most: no bucket of a mask is larger than the rarest of its words allows."""
        return self.counts[np.mod(words.view(np.int64), len(self.counts))]

    def finer(self, hashes: np.ndarray, size: np.ndarray, rows: "Rows") -> tuple["Rows", "Rows"]:
        """(rows with two more bits, rows that can have none) of rows in hot buckets.

        With ``b`` bits in use, ``g + 1 + b`` of the shared words are among the rarest ``size - shared + g + 1 + b``; without
        those of the mask, ``g + 1`` are left in ``g`` blocks. That takes as many shared words, which few bits of a short text have.
        """
        bits = rows.used.shape[1]
        lows, blocks = (np.array([x[k] for x in self.levels])[rows.level] for k in (0, 1))
        can = _ceil(lows, self.num, self.den) >= blocks + 1 + bits
        stay, rows, blocks = rows.where(~can), rows.where(can), blocks[can]
        word, text, pos = self.ordered(hashes, size)
        begin, own = np.concatenate([[0], np.cumsum(size)[:-1]]), size[rows.text]
        line = np.repeat(np.arange(len(own)), own)  # every row with all words of its text
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        w = word[begin[rows.text][line] + at] if len(line) else word[:0]
        common = blocks + 1 + bits
        small_prefix = self.prefix(own, common, True)
        take = (at < self.prefix(own, common, False)[line]) & ~(at[:, None] == rows.used[line]).any(1)
        out = []
        for w, r, p, i, j in self._pairs(w[take], line[take], at[take], blocks[line[take]]):
            k = r[i]
            small = rows.small[k] & (p[i] < small_prefix[k]) & (p[j] < small_prefix[k])
            bound = np.minimum(rows.bound[k], np.minimum(self.seen(w[i]), self.seen(w[j])))
            out.append(Rows(_mix(rows.key[k], _mix(w[i], w[j])), rows.text[k], small, rows.level[k], bound, np.column_stack([rows.used[k], p[i], p[j]])))
        return Rows.joined(out, bits + 2), stay

    def all_keys(self, hashes: np.ndarray, size: np.ndarray, hot: list[np.ndarray], part: tuple[int, int] = (0, 1)) -> list["Rows"]:
        """The masks of all texts, with bits added ``len(hot)`` times for the keys that are hot then: those of the last step first."""
        rows, settled = self.keys(hashes, size, part), []
        for keys in hot:
            large = _in(rows.key, keys)
            settled.append(rows.where(~large))
            rows, stay = self.finer(hashes, size, rows.where(large))
            settled.append(stay)
        return [rows, *settled]


class Rows:
    """Masks of texts as arrays: key, text number, whether it serves the smaller text of a pair, level, greatest possible size of
    its bucket, and the positions in use."""

    def __init__(self, key, text, small, level, bound, used):
        self.key, self.text, self.small, self.level, self.bound, self.used = key, text, small, level, bound, used

    def where(self, mask: np.ndarray) -> "Rows":
        return Rows(*(x[mask] for x in (self.key, self.text, self.small, self.level, self.bound, self.used)))

    @staticmethod
    def joined(parts: list["Rows"], bits: int) -> "Rows":
        if not parts:
            return Rows(np.zeros(0, np.uint64), *(np.zeros(0, d) for d in (np.int64, bool, np.int64, np.int32)), np.zeros((0, bits), np.int64))
        return Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "text", "small", "level", "bound", "used")))


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys stand in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def cells(rows: Rows, ids: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row number, role) of rows in buckets that no more bits divide: a bucket in ``n`` parts becomes ``n`` x ``n`` cells, in which
    each smaller text of one part meets each text of another. Roles: 1 the smaller text, 2 the other, 3 both."""
    n = parts[np.searchsorted(keys, rows.key)]
    own = (_mix(ids.view(np.uint64), rows.key) % n.astype(np.uint64)).astype(np.int64)
    line = np.repeat(np.arange(len(n)), n)
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cell = lambda a, b: _mix(rows.key[line], a.astype(np.uint64), b + 1)
    out = []
    for role, key, take in ((1, cell(own[line], other), rows.small[line]), (2, cell(other, own[line]), np.ones(len(line), bool))):
        out.append((key[take], line[take], np.full(take.sum(), role)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets)


def parity_sketch(hashes: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit parts; a bit is the parity of the words that fall on it, so two sketches differ in no more bits than the
    sets in words."""
    bit = (hashes >> np.uint64(17)) & np.uint64(255)
    value = np.left_shift(np.uint64(1), bit & np.uint64(63))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    if not len(hashes):
        return [np.zeros(0, np.int64)] * 4
    return [np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == part, value, np.uint64(0)), begin).view(np.int64) for part in range(4)]


_SKETCH = ["s1", "s2", "s3", "s4"]
_ROW = "key long, id long, meta long, s1 long, s2 long, s3 long, s4 long"
_NAMES = ["key", "id", "meta", *_SKETCH]


def _size(meta: str) -> Column:
    return F.shiftrightunsigned(meta, 2)


def _close(num: int, den: int) -> Column:
    """Join condition of a collision: the first text is the smaller, and neither sizes nor sketches rule the pair out."""
    a, b = _size("meta"), _size("y_meta")
    shared = F.floor((num * (a + b) + num + den - 1) / F.lit(num + den))
    differ = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"y_{s}"))) for s in _SKETCH), F.lit(0))
    ordered = (a < b) | ((a == b) & (F.col("id") < F.col("y_id")))
    return ordered & (a * den >= b * num) & (differ <= a + b - 2 * shared)


def _collide(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Renamed columns keep the two sides one subplan, so that masks are made and shuffled once."""
    role = lambda bit: F.col("meta").bitwiseAND(bit) != 0
    x, y = rows.where(role(1)), rows.where(role(2)).select(*(F.col(c).alias(f"y_{c}") for c in _NAMES))
    return x.join(y, (F.col("key") == F.col("y_key")) & _close(num, den)).select(F.col("id").alias("a"), F.col("y_id").alias("b"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, sizes) of at most 2,000 texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            piece = batch.slice(at, 2000)
            yield piece.column("id").to_numpy(), *_flat(piece.column("h"))


def hot_keys(hashed: DataFrame, sent, hot: int, depth: int, most: int = HOT_KEYS, share: float = 1.0) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(keys of buckets over ``hot`` rows after 0, 1, ... times of adding bits, keys and sizes of those left after the last).

    Counted by aggregation with map-side sums, and only over masks all of whose words are in more than ``hot`` texts: others cannot be.
    Of many texts a ``share`` is counted; a key that it misses only leaves its bucket larger.
    """
    found: list[np.ndarray] = []
    if share < 1:
        hashed = hashed.where(F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    for _ in range(depth + 1):
        known = hashed.sparkSession.sparkContext.broadcast(found)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            masks = Masks(*sent.value)
            for _, h, size in _pieces(batches):
                parts = masks.all_keys(h, size, known.value)
                rows = parts[0] if len(known.value) < depth else Rows.joined([Rows(p.key, p.text, p.small, p.level, p.bound, p.used[:, :0]) for p in parts], 0)
                yield pa.RecordBatch.from_arrays([pa.array(rows.key[rows.bound > hot].view(np.int64))], names=["key"])

        counts = hashed.mapInArrow(emit, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot * share)
        large = counts.orderBy(F.desc("n"), "key").limit(most).toPandas()
        keys = large["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        if len(found) == depth or not len(keys):
            break
        found.append(keys[order])
    return found, (keys[order], (large["n"].to_numpy(np.int64) / share).astype(np.int64)[order])


def _cost(masks: Masks, h: np.ndarray, size: np.ndarray, share: float) -> float:
    """Estimated rows and comparisons of the whole collection, from the masks of a ``share`` of its texts."""
    n = np.unique(masks.keys(h, size).key, return_counts=True)[1].astype(float)
    return ROW_COST * n.sum() / share + (n * (n - 1)).sum() / 2 / share**2


def _rounds(hashed: DataFrame, sent, known, texts: int, size: int, round_bytes: int) -> int:
    """In how many rounds the rows of all masks, estimated from a part of the texts, take no more bytes than the texts, or ``round_bytes``."""
    share = min(1.0, TRIED / max(1, texts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = Masks(*sent.value)
        finer, last, parts = known.value
        for _, h, size in _pieces(batches):
            n = 0
            for rows in masks.all_keys(h, size, finer):
                large = _in(rows.key, last)
                n += (~large).sum() + 2 * parts[np.searchsorted(last, rows.key[large])].sum()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    tried = hashed.where(F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = (tried.mapInArrow(emit, "n long").agg(F.sum("n")).first()[0] or 0) / share
    return max(1, -(-int(rows * ROW_BYTES) // max(round_bytes, size)))


def candidate_pairs(reps: DataFrame, num: int = NUM, den: int = DEN, slots: int = SLOTS, hot: int = HOT, depth: int = DEPTH, width: int | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(a, b), distinct, ``a`` the text with no more words: every pair at or above the threshold, and few others.

    ``width`` None: masks of two bits or three, whichever cost less on a part of the texts; three bits are enough without more of them.
    """
    context = reps.sparkSession.sparkContext
    texts, size = reps.agg(F.count("*"), F.sum(F.length(F.array_join("words", " ")))).first()
    counts = slot_counts(reps, slots)
    hashed = reps.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    if width is None:
        share = min(1.0, TRIED / max(1, texts))
        tried = hashed.where(F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.lit(1 << 20)) < int(share * (1 << 20))).toPandas()["h"]
        h = np.concatenate([np.asarray(x, np.int64).view(np.uint64) for x in tried]) if len(tried) else np.zeros(0, np.uint64)
        sizes = np.array([len(x) for x in tried], np.int64)
        width = min(WIDTHS, key=lambda w: _cost(Masks(counts, num, den, w), h, sizes, share))
    if width > 2:
        depth = 0
    sent = context.broadcast((counts, num, den, width))
    found, (left, sizes) = hot_keys(hashed, sent, hot, depth, share=max(min(1.0, COUNTED / max(1, texts)), min(1.0, 16 / hot)))
    known = context.broadcast((found, left, -(-sizes // hot)))
    rounds = _rounds(hashed, sent, known, texts, size or 0, round_bytes)
    if rounds == 1:
        return _round(hashed, sent, known, num, den, (0, 1))
    base = WIDTHS[width][0][1]
    rounds = rounds if rounds <= base else -(-rounds // base) * base
    pairs = []
    for k in range(rounds):
        pairs.append(cut(_round(hashed, sent, known, num, den, (k, rounds))))
        release(reps.sparkSession)
    while len(pairs) > 1:
        pairs = [x[0].unionByName(x[1]) if len(x) > 1 else x[0] for x in (pairs[i : i + 2] for i in range(0, len(pairs), 2))]
    return pairs[0].distinct()


def _round(hashed: DataFrame, sent, known, num: int, den: int, part: tuple[int, int]) -> DataFrame:
    """(a, b), distinct, of the pairs that meet in the masks of one round."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = Masks(*sent.value)
        finer, last, parts = known.value
        for ids, h, size in _pieces(batches):
            sketch = parity_sketch(h, size)
            for rows in masks.all_keys(h, size, finer, part):
                large = _in(rows.key, last)
                plain, cut_up = rows.where(~large), rows.where(large)
                key, line, role = cells(cut_up, ids[cut_up.text], last, parts)
                for k, text, r in ((plain.key, plain.text, np.where(plain.small, 3, 2)), (key, cut_up.text[line], role)):
                    columns = [k.view(np.int64), ids[text], (size[text].astype(np.int64) << 2) | r, *(x[text] for x in sketch)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)

    # the filter that joins on the key would add; stated here, both sides share one exchange. No bucket is over ``hot`` rows
    # (a cell: twice that), so the window, which leaves out texts that meet no other, holds little
    rows = hashed.mapInArrow(emit, _ROW).where("key is not null")
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    return _collide(counted, num, den).distinct()


def similar_pairs(reps: DataFrame, num: int = NUM, den: int = DEN, **bounds: int) -> DataFrame:
    """(a, b, shared, total) of the pairs whose exact Jaccard similarity is at least ``num``/``den``."""
    found = candidate_pairs(reps, num, den, **bounds)
    text = F.array_join("words", " ")  # a string takes a fraction of the bytes of an array in a shuffle
    left, right = (reps.select(F.col("id").alias(x), text.alias(f"w{x}")) for x in "ab")
    wa, wb = F.split("wa", " "), F.split("wb", " ")
    shared = F.size(F.array_intersect(wa, wb))
    checked = found.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size(wa) + F.size(wb) - shared).alias("total"))
    return checked.where(F.col("shared") * den >= F.col("total") * num)


def text_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("content_type = 'text'")


def near_duplicate_pairs(texts: DataFrame, id_column: str = "chunk_id", text_column: str = "text", num: int = NUM, den: int = DEN, least: int = LEAST_WORDS) -> DataFrame:
    """(chunk_a, chunk_b), ``chunk_a`` < ``chunk_b``: all pairs of rows at or above the threshold, copies included.

    Null texts and texts under ``least`` distinct words have no pairs. Equal word sets are compared once, as one
    representative, and only the result lists the pairs of their members.
    """
    members, reps = classes_of_equal_sets(word_sets(texts, id_column, text_column, least))
    pairs = similar_pairs(reps, num, den)
    ma, mb = members.select(F.col("id").alias("ia"), F.col("rep").alias("a")), members.select(F.col("id").alias("ib"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(ma, "a").join(mb, "b").select(F.least("ia", "ib").alias("chunk_a"), F.greatest("ia", "ib").alias("chunk_b"))
    within = ma.join(mb, (F.col("a") == F.col("b")) & (F.col("ia") < F.col("ib"))).select(F.col("ia").alias("chunk_a"), F.col("ib").alias("chunk_b"))
    return across.unionByName(within)


def near_duplicate_groups(texts: DataFrame, id_column: str = "chunk_id", text_column: str = "text", num: int = NUM, den: int = DEN, least: int = LEAST_WORDS) -> DataFrame:
    """(chunk_id, group_id, links): one row per text with enough words; ``group_id`` is the least id it is linked to,
    directly or through others, and ``links`` counts the similar classes of other texts. Linear in rows, whatever the
    size of a class of copies."""
    members, reps = classes_of_equal_sets(word_sets(texts, id_column, text_column, least))
    pairs = cut(similar_pairs(reps, num, den).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = connected_components(pairs, "a", "b").select(F.col("node").alias("rep"), "component")
    return members.join(groups, "rep", "left").join(links, "rep", "left").select(F.col("id").alias(id_column), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
