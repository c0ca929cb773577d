"""Near duplicates by Order MinHash.

The k-mers are five-word shingles, each labelled with its occurrence number in the text. Each of the sketch's rows
orders them by a hash of its own, takes the six least and keeps them in text order; two texts are candidates when a
row of both holds two of the same labelled k-mers in the same order. A row has a key for each of its 15 ordered pairs, so
four hashes of a text do what sixty rows of two minima would. Candidates are verified by a banded alignment of their
words: linked when 1 - edits / words of the longer text is at least 0.8, and by nothing else. Classes are the connected
components of the links. At 20 % random edits, where a fifth of the shingles are shared, 0.9 of the pairs become
candidates, and nearly all at fewer edits (the recall test measures this).

Equal texts are one node; only one row of each is sketched. In a bucket (equal key) all members are first held against
one pivot; then, round by round, against more pivots each, but only members whose components still
differ. At the end every pair of a bucket was verified, is in one class, or can't be linked: lengths and the parities of the
words' counts in slots, of whole texts and of their beginnings and ends, bound a pair's edits from below, as do, where members
meet, bags of words in slots that grow with the text; a pair goes unverified only if a bound is beyond the edits that a link allows. No link depends on a bucket's size. A group of thousands of copies costs one comparison a
member, a passage that many unlinked texts share one comparison of parities a pair, inside the join. No bucket is gathered
in a task: members stay where they are and pivots come to them, or they are met by joins, whose hot keys are split, where
pivots are too many to be sent; buckets are counted by partial sums.

Null texts count as empty; empty texts are equal to each other. A text of under five words is one shingle, and a text of
one shingle has it for its only key. Nulls in other columns don't matter; null ids never name a class unless all of its
ids are null. Repeated rows are copies; of rows with equal text and id the least by all columns stays. Columns of any
names are carried in a struct. An empty table gives an empty result."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, mix, packed, pieces_of, seeds, small, text_buffer, word_bounds, word_hashes
from .graph_cc import components

U64 = np.uint64
WORDS, ROWS, MINIMA, SIMILARITY = 5, 4, 6, 0.8
#: Growth of the number of pivots from round to round.
PIVOT_GROWTH = 64
#: Tables of up to so many rows (at most 40 bytes each) are broadcast, and joined by a shuffle beyond.
BROADCAST_NODES = 200_000
#: A round's pivots are broadcast in up to so many parts of up to so many rows (some 400 bytes each), and joined by a shuffle
#: where they are more.
PIVOT_PARTS, PIVOT_ROWS = 8, 60_000
#: Where no bucket has more members than this, the third round takes all that are left as pivots.
LAST_PIVOTS = 1 << 14
#: Pairs that a task aligns at least, where their number is known.
_TASK_PAIRS = 1000
_SPREAD = 32
#: Words of 64 parities each of the whole text, of its beginning and of its end.
WHOLE, ENDS = 8, 4
BIT_WORDS = WHOLE + 2 * ENDS
#: Slots of a text's bag for each word, at least; texts whose bag would have no more slots than the whole's parities have none.
BAG_SLOTS = 4
#: Texts of more words are aligned one by one; cells of a batch's row; a distance beyond any other.
_WIDE, _CELLS, _FAR = 3000, 200_000, np.int16(16_000)
#: Edits that most near copies have at most.
_NARROW = 12
#: Bytes of texts that are taken into Python objects at a time.
_BYTES = 8 << 20


class Sketches:
    """Of each text: its words, its keys (values and offsets), the parities of its words' counts, its bag (values and offsets),
    and a letter a word."""

    def __init__(self, column: pa.Array, k: int = WORDS, rows: int = ROWS, minima: int = MINIMA, seed: int = 3) -> None:
        data, offsets = text_buffer(column)
        row_seeds = seeds(rows, seed)
        ends, bags, bag_sizes = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        words, keys, sizes, bits, letters = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros((0, BIT_WORDS), U64)], [np.zeros(0, np.uint8)]
        for _, _, part, off in pieces_of(data, offsets):
            begins, stops, first = word_bounds(part, off)
            hashes, n = word_hashes(part, begins, stops), np.diff(first)
            grams, text_of = _shingles(hashes, n, k)
            own_keys, own_sizes = _keys(_labelled(grams, text_of), text_of, len(n), row_seeds, minima)
            words.append(n)
            keys.append(own_keys)
            sizes.append(own_sizes)
            own_bits, own_ends = _parities(hashes, n)
            bits.append(own_bits)
            ends.append(own_ends)
            own_bags, own_sizes = _bags(hashes, n)
            bags.append(own_bags)
            bag_sizes.append(own_sizes)
            letters.append((hashes >> U64(56)).astype(np.uint8))
        self.words, self.keys, self.bits = np.concatenate(words), np.concatenate(keys).view(np.int64), np.concatenate(bits).view(np.int64)
        self.letters, self.ends = np.concatenate(letters), np.concatenate(ends)
        self.offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.bags, self.bag_offsets = np.concatenate(bags).view(np.int64), np.concatenate([[0], np.cumsum(np.concatenate(bag_sizes))])

    def of(self, i: int) -> set[int]:
        return set(self.keys[self.offsets[i] : self.offsets[i + 1]].tolist())


def _parities(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the counts of a text's words in slots: of all words, of the first and of the last `ends` words; and `ends`,
    the largest power of two that is half of the words at most.

    An edit changes two parities of all words at most. Of the first words it changes two as well: an insertion or
    deletion also moves one word over the border. Edits that change the first words are others than those that change the
    last, as these don't overlap. So no sum of differing bits, of the whole or of both ends, is more than twice the edits."""
    bits, text_of = np.zeros(len(words) * BIT_WORDS, U64), np.repeat(np.arange(len(words)), words)
    ends = np.where(words > 1, 1 << np.floor(np.log2(np.maximum(words // 2, 1))).astype(np.int64), 0)
    begin = np.concatenate([[0], np.cumsum(words)])[:-1]
    place = np.arange(len(hashes)) - begin[text_of]
    for first, size, mask in ((0, WHOLE, slice(None)), (WHOLE, ENDS, place < ends[text_of]), (WHOLE + ENDS, ENDS, place >= (words - ends)[text_of])):
        slot = (hashes[mask] % U64(64 * size)).astype(np.int64)
        np.bitwise_xor.at(bits, text_of[mask] * BIT_WORDS + first + slot // 64, U64(1) << (slot % 64).astype(U64))
    return bits.reshape(-1, BIT_WORDS), ends


def _bags(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of slots that hold a text's words, each labelled with its occurrence number, and how many words of 64 slots
    each text has: a power of two, for BAG_SLOTS slots a word; none for short texts.

    Two texts' labelled words differ in as many as their words' counts do, twice the edits at most, less the difference of
    lengths; a slot that differs holds one of these. Slots in proportion to the words keep few of them from cancelling out,
    and the halves of a bag, held against each other, are the bag of half as many slots."""
    need = -(-words * BAG_SLOTS // 64)
    sizes = np.where(need > WHOLE, 1 << np.ceil(np.log2(np.maximum(need, 1))).astype(np.int64), 0)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text_of = np.repeat(np.arange(len(words)), words)
    mask = sizes[text_of] > 0
    own, at = hashes[mask], text_of[mask]
    slot = (_labelled(own, at) & (64 * sizes[at] - 1).astype(U64)).astype(np.int64)
    bits = np.zeros(begin[-1], U64)
    np.bitwise_xor.at(bits, begin[at] + slot // 64, U64(1) << (slot % 64).astype(U64))
    return bits, sizes


def _shingles(h: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order, and the text of each; a shorter text is one shingle."""
    text_of = np.repeat(np.arange(len(words)), words)
    grams, at = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(h) >= k:
        whole = text_of[k - 1 :] == text_of[: len(h) - k + 1]
        total = np.zeros(len(h) - k + 1, U64)
        for i in reversed(range(k)):
            total = mix(h[i : len(h) - k + 1 + i] + total)
        grams, at = total[whole], text_of[: len(h) - k + 1][whole]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(words)])
        own = []
        for t in short:
            x = np.full(1, words[t], U64)
            for i in range(begin[t], begin[t + 1]):
                x = mix(h[i : i + 1] + x)
            own.append(x[0])
        grams, at = np.append(grams, np.array(own, U64)), np.append(at, short)
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
    return grams, at


def _labelled(grams: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of earlier equal ones of their text mixed in."""
    own = mix(grams + mix(text_of.astype(U64) + U64(1)))
    ordered = np.sort(own)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return grams
    at = np.flatnonzero(np.isin(own, again))
    order = at[np.argsort(own[at], kind="stable")]
    begins = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
    label = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    out = grams.copy()
    later = label > 0
    out[order[later]] = mix(grams[order[later]] + label[later].astype(U64) * U64(0x9E3779B97F4A7C15))
    return out


def _least(x: np.ndarray, text_of: np.ndarray, count: np.ndarray, begin: np.ndarray, limits: np.ndarray, minima: int) -> np.ndarray:
    """Places of the least values of each text that has any, in text order; -1, first, where it has fewer."""
    have, need = np.flatnonzero(count), np.minimum(count, minima)
    under = np.flatnonzero(x <= limits)
    found = np.bincount(text_of[under], minlength=len(count))
    order = under[np.lexsort((x[under], text_of[under]))]
    first = np.concatenate([[0], np.cumsum(found)])
    lacking = found < need
    chosen = np.full((len(have), minima), -1, np.int64)
    for i in range(minima):
        ok = (need[have] > i) & ~lacking[have]
        chosen[ok, i] = order[first[have[ok]] + i]
    for t in np.flatnonzero(lacking):
        chosen[np.searchsorted(have, t), : need[t]] = begin[t] + np.argsort(x[begin[t] : begin[t + 1]], kind="stable")[: need[t]]
    chosen.sort(axis=1)
    return chosen


def _keys(grams: np.ndarray, text_of: np.ndarray, texts: int, row_seeds: np.ndarray, minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts in their order, and how many each has."""
    count = np.bincount(text_of, minlength=texts)
    have = np.flatnonzero(count)
    if not len(have):
        return np.zeros(0, U64), count
    begin = np.concatenate([[0], np.cumsum(count)])
    # about _SPREAD values of each text lie under its threshold, so few have to be sorted
    share = np.minimum(1.0, _SPREAD / np.maximum(count, 1))
    limit = np.where(share < 1, share * 2.0**64, 0).astype(U64) - U64(1)
    limit[count <= _SPREAD] = U64(0xFFFFFFFFFFFFFFFF)
    limits = limit[text_of]
    columns, there = [], []
    for seed in row_seeds:
        chosen = _least(mix(grams ^ seed), text_of, count, begin, limits, minima)
        value = np.where(chosen >= 0, grams[chosen], U64(0))
        for i, j in combinations(range(minima), 2):
            columns.append(mix(mix(value[:, i] + seed) + value[:, j]))
            there.append(chosen[:, i] >= 0)
    # a text of one shingle
    columns.append(mix(grams[begin[have]] ^ U64(0x5851F42D4C957F2D)))
    there.append(count[have] == 1)
    mask = np.stack(there, axis=1)
    sizes = np.zeros(texts, np.int64)
    sizes[have] = mask.sum(axis=1)
    return np.stack(columns, axis=1)[mask], sizes


def edits_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences, or None if it is over `most`; a bit-parallel alignment in the band of
    diagonals that `most` edits can reach."""
    n, m = len(a), len(b)
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    a, b = a[i : n - j], b[i : m - j]
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    ahead = m - n
    if ahead > most:
        return None
    if n == 0:
        return m
    low = (most - ahead) // 2
    high = ahead + low
    width = high + low + 1
    full, top, tracked = (1 << width) - 1, 1 << (width - 1), 1 << (ahead + low)
    seen: dict = {}
    for row in range(1, min(high, m) + 1):
        seen[b[row - 1]] = (seen[b[row - 1]][0] if b[row - 1] in seen else 0) | (1 << (row + low)), 0
    up, down, edits = full & ~((1 << low) - 1), 0, ahead
    for column in range(1, n + 1):
        row = column + high
        if row <= m:
            bits, last = seen.get(b[row - 1], (0, column))
            seen[b[row - 1]] = (bits >> (column - last)) | top, column
        bits, last = seen.get(a[column - 1], (0, column))
        equal = (bits >> (column - last)) & full
        zero = ((((equal & up) + up) ^ up) | equal | down) & full
        right = (down | ~(zero | up)) & full
        left = zero & up
        if not zero & tracked:
            edits += 1
            if edits > most:
                return None
        zero >>= 1
        up, down = (left | ~(zero | right)) & full, zero & right
    return edits


def _most(a: int, b: int, similarity: float) -> int:
    """Edits that a link of texts of so many words may have."""
    return int(max(a, b) * (1 - similarity) + 1e-9)


def linked(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    """Whether two word lists are near copies; texts without words have no links."""
    return max(len(a), len(b)) > 0 and edits_within(a, b, _most(len(a), len(b), similarity)) is not None


def _inner(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the beginning and the end that they share, the shorter one first."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    i = int(other[0]) if len(other) else n
    other = np.flatnonzero(a[len(a) - n + i :][::-1] != b[len(b) - n + i :][::-1])
    j = int(other[0]) if len(other) else n - i
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    return (a, b) if len(a) <= len(b) else (b, a)


def all_linked(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether each pair of integer sequences is linked. Pairs of like lengths are aligned together, row by row, in the band
    of a few edits first and then of all that a link may have; the few whose band is very wide one by one."""
    out = np.zeros(len(pairs), bool)
    most = np.array([_most(len(a), len(b), similarity) for a, b in pairs], np.int64)
    inner, todo = {}, []
    for i, (a, b) in enumerate(pairs):
        if not max(len(a), len(b)) or abs(len(a) - len(b)) > most[i]:
            continue
        inner[i] = short, long = _inner(a, b)
        # as many edits as the longer one has words are always enough
        if len(long) <= most[i]:
            out[i] = True
        elif len(long) > _WIDE:
            own = short.tolist(), long.tolist()
            out[i] = any(edits_within(*own, min(edits, int(most[i]))) is not None for edits in (_NARROW, 20 * _NARROW, int(most[i])))
        else:
            todo.append(i)
    todo.sort(key=lambda i: len(inner[i][1]))
    for edits in (_NARROW, 5 * _NARROW, None):
        at, left = 0, []
        while at < len(todo):
            size = max(1, min(256, _CELLS // (len(inner[todo[min(len(todo), at + 256) - 1]][1]) + 1)))
            chunk = todo[at : at + size]
            allowed = most[chunk] if edits is None else np.minimum(most[chunk], edits)
            fit = np.array([len(inner[i][1]) - len(inner[i][0]) for i in chunk]) <= allowed
            own = [i for i, x in zip(chunk, fit, strict=True) if x]
            if own:
                out[own] = _aligned([inner[i] for i in own], allowed[fit])
            left += [i for i, x in zip(chunk, allowed, strict=True) if not out[i] and x < most[i]]
            at += size
        todo = left
    return out


def _aligned(pairs: list, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair, the shorter sequence first, is `most` at most. A row holds the cells of
    all pairs in the band of diagonals that the edits can reach; cells past a sequence's end never reach back."""
    n, m = np.array([[len(x), len(y)] for x, y in pairs]).T
    ahead = m - n
    low = int(((most - ahead) // 2).max())
    width = low + int((ahead + (most - ahead) // 2).max()) + 1
    short = np.full((len(pairs), n.max()), -1, np.int32)
    long = np.full((len(pairs), max(m.max(), n.max()) + width + low), -2, np.int32)
    for i, (x, y) in enumerate(pairs):
        short[i, : len(x)] = x
        long[i, low : low + len(y)] = y
    place = np.arange(width, dtype=np.int16)
    cells = np.broadcast_to(np.where(place >= low, place - low, _FAR), (len(pairs), width)).astype(np.int16)
    rest = np.abs((ahead + low)[:, None] - place).astype(np.int16)
    out, live = n == 0, np.flatnonzero(n > 0)
    if len(live) < len(pairs):
        short, long, cells, rest = short[live], long[live], cells[live], rest[live]
    for row in range(1, n.max() + 1):
        new = cells + (long[:, row - 1 : row - 1 + width] != short[:, row - 1 : row])
        np.minimum(new[:, :-1], cells[:, 1:] + np.int16(1), out=new[:, :-1])
        # insertions: the least of all cells to the left, plus their distance
        cells = np.minimum(np.minimum.accumulate(new - place, axis=1) + place, _FAR).astype(np.int16)
        done = n[live] == row
        if done.any():
            at = np.flatnonzero(done)
            out[live[at]] = cells[at, (ahead + low)[live[at]]] <= most[live[at]]
        if done.any() or row % 8 == 0:
            stay = ~done & ((cells + rest).min(axis=1) <= most[live])
            if not stay.all():
                live, short, long, cells, rest = live[stay], short[stay], long[stay], cells[stay], rest[stay]
                if not len(live):
                    break
    return out


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _may_link(similarity: float, whole: str | None = None) -> Column:
    """What every linked pair fulfils, from lengths n and parities of both. whole: the name before the numbers of columns that
    hold the whole's parities, which are read faster than arrays are."""
    most = F.floor(F.greatest("n_a", "n_b") * (1 - similarity) + 1e-9)
    apart = F.abs(F.col("n_a") - F.col("n_b"))
    different = lambda *words: sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for r in words for i in r), F.lit(0))
    if whole:
        apart_in = [F.bit_count(F.col(f"{whole}{i}_a").bitwiseXOR(F.col(f"{whole}{i}_b"))) for i in range(WHOLE)]
        half, full = sum(apart_in[: WHOLE // 2], F.lit(0)), sum(apart_in, F.lit(0))
        within = (half + apart <= 2 * most) & (full + apart <= 2 * most)
    else:
        within = different(range(WHOLE)) + apart <= 2 * most
    ends = (F.col("ends_a") != F.col("ends_b")) | (different(range(WHOLE, BIT_WORDS)) <= 2 * most)
    return (apart <= most) & within & ends


def _bags_may_link(similarity: float) -> Column:
    """What every linked pair fulfils, from lengths n and bags of both; the larger bag is folded to the smaller one's size."""
    most = F.floor(F.greatest("n_a", "n_b") * (1 - similarity) + 1e-9)
    size = F.least(F.size("bag_a"), F.size("bag_b"))
    fold = lambda c: F.when(F.size(c) == size, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y)))
    differ = F.aggregate(F.zip_with(fold("bag_a"), fold("bag_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (size == 0) | (F.greatest(F.size("bag_a"), F.size("bag_b")) > 2 * size) | (differ + F.abs(F.col("n_a") - F.col("n_b")) <= 2 * most)


def _aligned_pairs(pairs: DataFrame, sides: DataFrame, codes, similarity: float) -> DataFrame:
    """The pairs (a, b) that are linked by the integers that `codes` gives for column x of sides (nid, x)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def align(batches):
        for batch in batches:
            sizes = np.cumsum(pc.add(pc.binary_length(batch.column("ax")), pc.binary_length(batch.column("bx"))).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + _BYTES, "right")))
                part = batch.slice(first, end - first)
                own = codes(part.column("ax").to_pylist(), part.column("bx").to_pylist())
                mask = pa.array(all_linked(own, similarity), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], schema=schema)
                first = end

    left, right = (sides.select(F.col("nid").alias(x), F.col("x").alias(f"{x}x")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ax", "bx")
    return packed(both, pairs.count(), _TASK_PAIRS).mapInArrow(lean(align), "a long, b long")


def _letters(a: list[bytes], b: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(a, b, strict=True)]


def _words(a: list[bytes], b: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    numbers: dict[bytes, int] = {}
    number = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in text.split()], np.int32)
    return [(number(x), number(y)) for x, y in zip(a, b, strict=True)]


def _verified(work: Workspace, pairs: DataFrame, sketched: DataFrame, firsts: DataFrame, similarity: float, by_letters: bool = True) -> DataFrame:
    """The pairs (a, b) of a written table whose alignment reaches the similarity. by_letters: they are aligned by one letter
    a word first, which can only make texts more alike, so that few whole texts move in vain where few pairs link."""
    alike = pairs
    if by_letters:
        alike = work.written(_aligned_pairs(pairs, sketched.select("nid", F.col("letters").alias("x")), _letters, similarity))
    # only texts of candidates move
    ids = alike.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    wanted = work.written(packed(ids.join(sketched.select("nid", "node"), "nid"), 2 * alike.count()))
    texts = firsts.join(small(wanted, BROADCAST_NODES), "node").select("nid", F.col("text").alias("x"), "again")
    if not sketched.where("again").isEmpty():
        texts = texts.dropDuplicates(["nid"])
    return work.written(_aligned_pairs(alike, texts.drop("again"), _words, similarity))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, first_id (least id), rows, and again (whether an id may repeat) of every distinct text."""
    own = docs.select(docs[id_col].cast("long").alias("id"), _node(docs[text_col]).alias("node")).groupBy("node", "id").agg(F.count("*").alias("n"))
    return own.groupBy("node").agg(F.min("id").alias("first_id"), F.sum("n").alias("rows"), (F.max("n") > 1).alias("again"))


def _firsts(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, again and text of the first row of each distinct text; all rows that repeat it, where it does."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), _node(docs[text_col]).alias("node"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("text"))
    several = small(groups.where("rows > 1").select("node", "first_id", "again"), BROADCAST_NODES)
    return plain.join(several, "node", "left").where(F.col("again").isNull() | F.col("id").eqNullSafe(F.col("first_id"))).select("node", F.coalesce("again", F.lit(False)).alias("again"), "text")


def _sketched(firsts: DataFrame, rows: int, minima: int) -> DataFrame:
    """nid (a number), node, again, n (words), keys, bits, ends, bag and letters of one row for each distinct text; of a text whose
    first row repeats, one for each task that reads it, which link like copies."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("node", pa.binary()), ("again", pa.bool_()), ("n", pa.int64()), ("keys", longs), ("bits", longs), ("ends", pa.int64()), ("bag", longs), ("letters", pa.binary())])

    def sketch(batches):
        seen: set[bytes] = set()
        for batch in batches:
            if batch.column("again").true_count:
                keep = []
                for node, again in zip(batch.column("node").to_pylist(), batch.column("again").to_pylist(), strict=True):
                    keep.append(not (again and node in seen))
                    if again:
                        seen.add(node)
                batch = batch.filter(pa.array(keep, pa.bool_()))
            s = Sketches(batch.column("text"), WORDS, rows, minima)
            keys = pa.ListArray.from_arrays(s.offsets.astype(np.int32), pa.array(s.keys))
            bits = pa.ListArray.from_arrays(np.arange(0, s.bits.size + 1, BIT_WORDS, dtype=np.int32), pa.array(s.bits.reshape(-1)))
            bags = pa.ListArray.from_arrays(s.bag_offsets.astype(np.int32), pa.array(s.bags))
            stops = np.concatenate([[0], np.cumsum(s.words)]).astype(np.int32)
            letters = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(s.letters.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("again"), pa.array(s.words), keys, bits, pa.array(s.ends), bags, letters], schema=schema)

    out = firsts.mapInArrow(lean(sketch), "node binary, again boolean, n long, keys array<long>, bits array<long>, ends long, bag array<long>, letters binary")
    # numbers are settled when the table is written: a task that runs again writes all of its rows again
    return out.withColumn("nid", F.monotonically_increasing_id())


def _merged(work: Workspace, labels: DataFrame, links: DataFrame) -> DataFrame:
    """(nid, component) after more links."""
    n, more = labels.count(), links.count()
    known = F.broadcast(labels) if n <= BROADCAST_NODES else labels
    a, b = (known.select(F.col("nid").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = work.written(links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    new = small(work.written(components(between, work)), BROADCAST_NODES).select(F.col("node").alias("old"), F.col("component").alias("new"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(known, "nid", "left_anti").select("nid", F.col("nid").alias("old"))
    old = labels.select("nid", F.col("component").alias("old")).union(fresh)
    return work.written(packed(old.join(new, "old", "left").select("nid", F.coalesce("new", "old").alias("component")), n + 2 * more))


def _met(work: Workspace, nodes: DataFrame, low: int, high: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of different components, one a member of a bucket with a rank from low up to high and the other of no
    lesser rank, that no bound rules out. A pair that shares several keys meets in the least of them only. nodes: nid,
    component, n, bits, ends, bag, and key, size and rank of all of a node's buckets."""
    rest = nodes.select("nid", "component", "n", "bits", "ends", "bag", F.col("at.key").alias("common"), F.inline("at"))
    chosen = rest.where((F.col("rank") >= low) & (F.col("rank") < high))
    own_side = lambda df, x: df.select("key", F.col("nid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "ends", "bag", "rank", "common")], *[F.get("bits", F.lit(i)).alias(f"word{i}_{x}") for i in range(WHOLE)], F.col("component").alias(f"c_{x}"))
    before = (F.col("rank_a") < F.col("rank_b")) | ((F.col("rank_a") == F.col("rank_b")) & (F.col("a") < F.col("b")))
    first = F.col("key") == F.array_min(F.array_intersect("common_a", "common_b"))
    parts = -(-chosen.count() // PIVOT_ROWS)
    # pivots that come to the members, part by part, leave no hot key to be split on both sides
    few = 0 < parts <= PIVOT_PARTS
    found = []
    for i in range(parts if few else 1):
        own = F.broadcast(chosen.where(F.pmod(F.xxhash64("key", "nid"), F.lit(parts)) == i)) if few else chosen
        met = own_side(rest, "b").join(own_side(own, "a"), "key").where(before & (F.col("c_a") != F.col("c_b")) & _may_link(similarity, "word") & first & _bags_may_link(similarity))
        found.append(work.written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _labels(work: Workspace, sketched: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """(nid, component) of every node with a link."""
    keyed = sketched.where("n > 0").select("nid", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("nid").alias("pivot")).where("size > 1")
    members = work.written(keyed.join(buckets, "key"))
    facts = sketched.select("nid", "n", "bits", "ends")
    side = lambda x: facts.select(F.col("nid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "ends")])
    met = members.where("nid <> pivot").select(F.col("pivot").alias("a"), F.col("nid").alias("b")).distinct()
    rows, largest = members.agg(F.count("*"), F.max("size")).first()
    pairs = work.written(packed(met.join(side("a"), "a").join(side("b"), "b").where(_may_link(similarity)).select("a", "b"), rows))
    labels = work.written(components(_verified(work, pairs, sketched, firsts, similarity, False), work).withColumnRenamed("node", "nid"))
    pivots, largest = 1, largest or 0
    # a scramble of the number as a fraction times the bucket's size is about a member's rank; the first pivot has had
    # its turn
    rank = F.floor((F.xxhash64("nid") / F.lit(2.0**64) + 0.5) * F.col("size"))
    pool = members.where("size > 2 AND nid <> pivot").select("key", "size", "nid", rank.alias("rank"))
    while pivots < largest:
        # from round to round only buckets go on that held several components
        own = pool.where(F.col("size") > pivots).join(small(labels, BROADCAST_NODES), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
        mixed = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        # a node is met with its facts once, whatever the number of its keys, which are few
        nodes = own.join(mixed, "key").groupBy("nid").agg(F.first("component").alias("component"), F.collect_list(F.struct("key", "size", "rank")).alias("at"))
        nodes = work.written(nodes.join(sketched.select("nid", "n", "bits", "ends", "bag"), "nid"))
        pool = nodes.select("nid", F.inline("at"))
        if nodes.isEmpty():
            break
        largest = pool.agg(F.max("size")).first()[0]
        after = largest + 1 if pivots > 1 and largest <= LAST_PIVOTS else pivots * PIVOT_GROWTH
        pairs = _met(work, nodes, 0 if pivots == 1 else pivots, after, similarity)
        links = _verified(work, pairs, sketched, firsts, similarity)
        if not links.isEmpty():
            labels = _merged(work, labels, links)
        pivots = after
    return labels


def near_classes(work: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, minima: int = MINIMA, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each distinct text: node, first_id, rows, again, n_words, class_id (least id), class_size and head,
    whether its row stays for the class."""
    groups = work.written(_groups(docs, id_col, text_col))
    firsts = _firsts(docs, groups, id_col, text_col)
    sketched = work.written(_sketched(firsts, rows, minima))
    labels = _labels(work, sketched, firsts, similarity)
    sizes = sketched.groupBy("node").agg(F.min("nid").alias("nid"), F.first("n").alias("n_words"))
    linked_nodes = work.written(sketched.select("nid", "node").join(small(labels, BROADCAST_NODES), "nid").groupBy("node").agg(F.min("component").alias("component")).join(groups, "node"))
    order = F.struct(F.col("first_id").isNull().alias("null"), F.col("first_id"), F.col("node"))
    classes = work.written(linked_nodes.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("rows").alias("class_size"), F.min(order).alias("best")))
    # written tables on both sides, so that the join may split the component of a large class
    named = work.written(linked_nodes.join(small(classes, BROADCAST_NODES), "component").select("node", "class_id", "class_size", (F.col("best.node") == F.col("node")).alias("head")))
    every = groups.join(sizes.drop("nid"), "node").join(small(named, BROADCAST_NODES), "node", "left")
    alone = F.col("head").isNull()
    return every.select("node", "first_id", "rows", "again", "n_words", F.when(alone, F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", "rows").alias("class_size"), F.coalesce("head", F.lit(True)).alias("head"))


def near_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size, kept, n_words of every row."""
    with Workspace(docs.sparkSession) as work:
        classes = work.kept(near_classes(work, docs, id_col, text_col, **parameters).select("node", "class_id", "class_size", "n_words"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), _node(docs[text_col]).alias("node"))
    return rows.join(classes, "node").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_words")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with one row of each class: that of its least id; rows with equal texts count as one."""
    with Workspace(docs.sparkSession) as work:
        classes = work.written(near_classes(work, docs, id_col, text_col, **parameters))
        # most texts stay and stand alone, so only the others are joined
        odd = work.kept(classes.where("NOT head OR rows > 1").select("node", "first_id", "again", "head"))
        again = not odd.where("again AND head").isEmpty()
    record = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(record.alias("record"), docs[id_col].cast("long").alias("id"), _node(docs[text_col]).alias("node"))
    left = rows.join(small(odd, BROADCAST_NODES), "node", "left").where(F.col("head").isNull() | (F.col("head") & F.col("id").eqNullSafe(F.col("first_id"))))
    columns = [F.col("record")[c].alias(c) for c in docs.columns]
    if not again:
        return left.select(*columns)
    repeats = F.coalesce("again", F.lit(False))
    least = left.where(repeats).groupBy("node").agg(F.min_by("record", F.to_json("record")).alias("record"))
    return left.where(~repeats).select(*columns).union(least.select(*columns))
