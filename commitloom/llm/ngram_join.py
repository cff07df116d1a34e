"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, without losing one.

1. Equal sets are one: every set has a digest, and the smallest doc_id stands for it.
2. Candidates meet in tiles. A band holds sets of sizes from 2**k to 2**(k+1), and larger ones that can still be
   alike to one of them. In a band, shingles have one order for all sets: those that many sets hold come last,
   the others by their hash. Two alike sets share so much that the first shingle they share stands among the
   first few of both, so a set stands in a tile (band, shingle) for each of these. The order decides only how
   many sets meet: which shingles come last is counted over all texts, and a tile found crowded joins them.
   A tile is cut where sizes leave a gap that no two alike sets can have, so most chance meetings end there.
   In tiles of few sets, pairs are counted: a set stands in some tiles more than it must, so that two alike sets
   meet several times, which sets that share a shingle by chance seldom do.
3. Of sets that meet often enough, or in a tile of many sets, sizes and hashed bitmap signatures bound the
   overlap from above: the bits that differ are no more than the shingles that do. Sets that stay joined become
   groups.
4. In a group, blocks of bounded size are compared by exact intersection of sorted arrays, once more behind
   the bitmaps. Groups of more than one block are joined first inside the blocks; what isn't yet in a
   group's largest cluster then meets every block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.llm import common
from commitloom.llm.urlfilter import BITS_PER_KEY, Level, build_level
from commitloom.operators.graph import components

#: Bits of a bitmap signature: the band's upper end, within these bounds.
LEAST_BITS, MOST_BITS = 64, 8_192
#: Sets of a tile that one row holds.
CHUNK = 256
#: Sets, and shingles of sets, that one block holds, about.
BLOCK, BLOCK_SHINGLES = 2_048, 2_000_000
#: Bytes of a Bloom filter in a plan, at most.
MOST_FILTER_BYTES = 8 << 20
#: Bits of the filter of shingles that come last; of all blocks' counts of shingles that a block holds twice at least, the sum that makes one come last.
LAST_BITS, LAST_COUNT = 1 << 26, 64
#: Tiles are made so often at most, each time with the shingles of crowded ones last.
ROUNDS = 3
#: Members of crowded tiles that one task puts together, about.
MET_IN_A_TASK = 1_000_000
#: Sets of a tile up to which its pairs are counted.
FEW = 4
#: How often two alike sets meet at least, if the smaller one's size has so many bits at least (bits, meetings).
MEETINGS = ((8, 4), (6, 3), (2, 2))
#: Rows with bitmaps for each set, in tiles of more than FEW sets that hardly two tiles have alike, from which on tiles are made anew.
MET_BY_CHANCE = 2
#: Keys that come last because of what tiles hold, at most.
MOST_LAST = LAST_BITS // 8
#: Size classes of sets: so many for each doubling, in so many of a name's uppermost bits below the sign.
CLASSES, CLASS_BITS = 64, 11
#: A tile's key has its band in so many of its uppermost bits.
BAND_BITS = 6
#: Bytes of a word up to which words are hashed together.
LONG_WORD = 64


class Similar:
    """100 * intersection >= percent * union, in whole numbers, and what follows from it."""

    def __init__(self, percent: int):
        self.percent = percent

    def alike(self, a, b, shared):
        return 100 * shared >= self.percent * (a + b - shared)

    def may(self, a, b, differing):
        """Whether sets of sizes a and b can be alike if at least so many shingles differ."""
        return 2 * self.percent * (a + b) <= (100 + self.percent) * (a + b - differing)

    def first(self, n):
        """So many of a set's n shingles, in an order that all sets have, hold one that an alike set has among its own first."""
        return n - (self.percent * n + 99) // 100 + 1

    def largest(self, n: int) -> int:
        """Of the sets alike to one of n shingles, the largest size."""
        return 100 * n // self.percent

    def meetings(self, band: int) -> int:
        """So many shingles that come first two alike sets share at least, if the smaller one's size is of this band."""
        return min(next((m for bits, m in MEETINGS if band + 1 >= bits), 1), max(1, (self.percent * (1 << band) + 99) // 100))

    @property
    def classes(self) -> int:
        """Sets whose size classes differ by more are not alike."""
        return int(CLASSES * np.log2(100 / self.percent)) + 1


@dataclass
class Sets:
    """Many sets of 64-bit numbers in one array: the numbers of each, sorted, one set after the other."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]

    def __len__(self) -> int:
        return len(self.sizes)

    def taken(self, rows: np.ndarray) -> Sets:
        """The sets of these rows, in their order; rows may repeat."""
        sizes = self.sizes[rows]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - starts, sizes)
        return Sets(self.flat[at], starts, sizes)

    def reduced(self, by: np.ufunc, numbers: np.ndarray) -> np.ndarray:
        """One number for each set, of one for each of its elements; 0 for empty sets."""
        out = np.zeros(len(self.sizes), np.uint64)
        full = self.sizes > 0
        if full.any():
            out[full] = by.reduceat(numbers, self.starts[full])
        return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's bytes: eight bytes of all words at a time, or each by itself if it is very long."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    length = np.diff(offsets)
    h = common.mix64(length.astype(np.uint64))
    at = np.flatnonzero(length <= LONG_WORD)
    done = 0
    while len(at):
        left = np.minimum(length[at] - done, 8).astype(np.uint64)
        part = eight[offsets[at] + done] & (np.uint64(2**64 - 1) >> ((np.uint64(8) - left) * np.uint64(8)))
        h[at] = common.mix64(h[at] ^ part)
        done += 8
        at = at[length[at] > done]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]])
    return h


def shingles(texts: pa.Array, width: int) -> Sets:
    """Each text's different shingles by their hashes; of all its words if they are fewer than ``width``; none without words.

    A-Z are lower-cased and words lie between the six white-space characters of ASCII. Shingles are told
    apart by 64-bit hashes. Null texts have no words.
    """
    # a copy, as ascii_lower misreads slices
    whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    words, ends = cut.flatten(), np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    # white space at an end of a text gives an empty word
    real = pc.not_equal(pc.binary_length(words), 0)
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends]
    codes = word_hashes(words)[real.to_numpy(zero_copy_only=False)]
    begins = np.r_[0, ends[:-1]].astype(np.int64)
    n = ends - begins
    k = np.minimum(n, width)
    count = np.where(n > 0, n - k + 1, 0)
    starts = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(begins - starts, count)
    widths = np.repeat(k, count)
    factor = np.uint64(0x9E3779B97F4A7C15)
    h = codes[at]
    codes = np.r_[codes, np.zeros(width, np.uint64)]
    for i in range(1, width):
        # fewer words than width go without the rest, and are another kind of shingle by their number
        h = (h ^ (h >> np.uint64(29))) * factor + np.where(widths > i, codes[at + i], widths.astype(np.uint64))
    h = common.mix64(h, width)
    for a, b in zip(starts.tolist(), (starts + count).tolist(), strict=True):
        h[a:b].sort()
    fresh = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    fresh[starts[count > 0]] = True
    sizes = np.diff(np.r_[0, np.cumsum(fresh)][np.r_[starts, len(h)]])
    return Sets(h[fresh], np.cumsum(sizes) - sizes, sizes)


def set_digests(sets: Sets, salt: int) -> np.ndarray:
    return sets.reduced(np.bitwise_xor, common.mix64(sets.flat, salt)) + sets.sizes.astype(np.uint64)


def size_names(sets: Sets) -> np.ndarray:
    """A digest of each set that begins with the class of its size: in their order, sets of like sizes stand together."""
    size = np.minimum(CLASSES * np.log2(np.maximum(sets.sizes, 1)), 2**CLASS_BITS - 1).astype(np.uint64)
    rest = np.uint64(63 - CLASS_BITS)
    return (size << rest) | (set_digests(sets, 1) >> (np.uint64(64) - rest))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def band_of(n: int) -> int:
    return n.bit_length() - 1


def bits_of(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 2 << band_of(n))) if n else LEAST_BITS


def bitmaps(sets: Sets, bits: np.ndarray) -> list[np.ndarray]:
    """Bytes of the parities of how many shingles of each set fall on each of its bits (so many as ``bits`` says)."""
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(sets)
    for size in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == size)
        for part in np.array_split(rows, -(-len(rows) * size // (1 << 22))):
            some = sets.taken(part)
            at = (some.flat & np.uint64(size - 1)).astype(np.int64) + np.repeat(np.arange(len(part)) * size, some.sizes)
            on = (np.bincount(at, minlength=len(part) * size) & 1).astype(np.uint8)
            for i, row in zip(part.tolist(), np.packbits(on.reshape(len(part), size), axis=1, bitorder="little"), strict=True):
                out[i] = row
    return out


def folded(b: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bytes: halves laid over each other."""
    while len(b) > size:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def in_bands(sets: Sets, like: Similar) -> tuple[Sets, np.ndarray, np.ndarray]:
    """(sets, their rows before, keys): each set that isn't empty once for each band it stands in; keys of (band, shingle), the band uppermost."""
    rows, bands = [], []
    for i, n in enumerate(sets.sizes.tolist()):
        band = band_of(n)
        while band >= 0 and n <= like.largest((2 << band) - 1):
            rows.append(i)
            bands.append(band)
            band -= 1
    rows = np.array(rows, np.int64)
    standing = sets.taken(rows)
    bands, below = np.array(bands, np.uint64), np.uint64(64 - BAND_BITS)
    salt = common.mix64(bands, 8)
    mixed = common.mix64(standing.flat ^ np.repeat(salt, standing.sizes), 7)
    return standing, rows, (mixed & np.uint64((1 << (64 - BAND_BITS)) - 1)) | np.repeat(bands << below, standing.sizes)


def tile_keys(sets: Sets, like: Similar, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows of the sets) of the tiles that each set stands in; ``last``: a filter of the keys that come last.

    Two alike sets whose smaller one is of a band have as many tiles of that band in common as ``Similar.meetings`` says.
    """
    standing, rows, keys = in_bands(sets, like)
    late = np.zeros(len(keys), bool) if last is None else holds(last, keys)
    # the place of each shingle: first the ones that don't come last, in their order, then the others
    late_before = np.cumsum(late) - late
    of = np.repeat(np.arange(len(standing)), standing.sizes)
    late_before -= late_before[standing.starts][of] if len(standing) else 0
    late_in_all = np.bincount(of, late, len(standing)).astype(np.int64)
    place = np.arange(len(keys)) - standing.starts[of] - late_before
    place = np.where(late, (standing.sizes - late_in_all)[of] + late_before, place)
    # two sets that share s shingles both have the m-th of them among all but the last s - m
    more = np.array([like.meetings(b) - 1 for b in range(1 << BAND_BITS)])
    chosen = place < (like.first(standing.sizes)[of] + more[(keys >> np.uint64(64 - BAND_BITS)).astype(np.int64)])
    return keys[chosen], rows[of[chosen]]


def holds(last: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter (bytes of a power of two of bits) lets each key through."""
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & np.uint64(8 * len(last) - 1)
        out &= (last[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class Forest:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


    def stars(self, names: list[int]) -> list[tuple[int, int]]:
        """(name, smallest name of its tree) of all rows that have another one."""
        low: dict[int, int] = {}
        roots = [self.find(i) for i in range(len(names))]
        for r, n in zip(roots, names, strict=True):
            low[r] = min(low.get(r, n), n)
        return [(n, low[r]) for r, n in zip(roots, names, strict=True) if n != low[r]]


def bitmap_links(sizes: np.ndarray, maps: np.ndarray, like: Similar, left: np.ndarray | None = None):
    """For each row i the later rows (or, of ``left`` rows, the others) whose sizes and bitmaps allow a link."""
    words = maps.view(np.uint64) if maps.shape[1] % 8 == 0 else maps
    for i in range(len(sizes)) if left is None else left:
        others = slice(i + 1, None) if left is None else slice(None)
        n = sizes[others]
        ok = (100 * np.minimum(n, sizes[i]) >= like.percent * np.maximum(n, sizes[i]))
        at = np.flatnonzero(ok)
        if len(at):
            base = i + 1 if left is None else 0
            differing = np.bitwise_count(words[others][at] ^ words[i]).sum(axis=1, dtype=np.int64)
            at = at[like.may(n[at], sizes[i], differing)] + base
            yield i, at


def groups(batches, keys: list[str], columns: list[str]):
    """(key, columns as lists) for each run of equal keys in sorted batches."""
    now, held = None, [[] for _ in columns]
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        data = [batch.column(c).to_pylist() for c in columns]
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if (name := tuple(key[a].tolist())) != now:
                if now is not None:
                    yield now, held
                now, held = name, [[] for _ in columns]
            for h, d in zip(held, data, strict=True):
                h.extend(d[a:b])
    if now is not None:
        yield now, held


SETS = [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("map", pa.binary()), ("often", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]


def sets_of(docs: DataFrame, width: int, like: Similar) -> DataFrame:
    """doc_id, n, s1, s2 (digest of the set), map (bitmap) of every document.

    A block's first row has in ``often`` the (band, shingle) keys that several different sets of the block
    hold, and in ``times`` how many do.
    """

    def make():
        def work(block):
            sets = shingles(block.column("text"), width)
            digests = [signed(size_names(sets)), signed(set_digests(sets, 2))]
            maps = bitmaps(sets, np.array([bits_of(n) for n in sets.sizes.tolist()]))
            _, different = np.unique(digests[0], return_index=True)
            keys, times = np.unique(in_bands(sets.taken(different), like)[2], return_counts=True)
            keys, times = keys[times > 1], times[times > 1]
            rest = [None] * (len(sets) - 1)
            return common.record(SETS, block.column("doc_id"), sets.sizes, *digests, [m.tobytes() if n else b"" for m, n in zip(maps, sets.sizes, strict=True)], [signed(keys), *rest], [times, *rest])

        return work

    return docs.mapInArrow(common.by_block(make), "doc_id long, n long, s1 long, s2 long, map binary, often array<long>, times array<int>")


def last_filter(keys: DataFrame, before: bytes | None = None) -> bytes:
    """A filter of LAST_BITS of the column ``key``, and of what the filter ``before`` holds; its words are OR-ed on the executors."""
    at = F.explode(F.array(*[F.shiftright("key", k).bitwiseAND(LAST_BITS - 1) for k in (0, 32)]))
    words = (
        keys.select(at.alias("at"))
        .select(F.shiftright("at", 5).alias("word"), F.expr("shiftleft(1L, cast(at % 32 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
    )
    out = np.frombuffer(before, "<u4").copy() if before else np.zeros(LAST_BITS // 32, "<u4")
    for word, bit in words.toLocalIterator():
        out[word] |= np.uint32(bit)
    return out.tobytes()


def tiles_of(docs: DataFrame, width: int, like: Similar, last: bytes | None) -> DataFrame:
    """key, s1 of every tile that each set stands in; a task gives a set that it has just seen only once."""
    schema = [("key", pa.int64()), ("s1", pa.int64())]
    sent = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        filled = np.frombuffer(sent.value, np.uint8) if sent.value else None
        seen: set[int] = set()
        for batch in batches:
            for block in common.blocks(batch):
                sets = shingles(block.column("text"), width)
                names = size_names(sets)
                if len(seen) > common.CACHE_WORDS:
                    seen.clear()
                fresh = []
                for i, name in enumerate(names.tolist()):
                    if sets.sizes[i] and name not in seen:
                        seen.add(name)
                        fresh.append(i)
                if fresh:
                    fresh = np.array(fresh)
                    keys, rows = tile_keys(sets.taken(fresh), like, filled)
                    yield common.record(schema, signed(keys), signed(names[fresh][rows]))

    return docs.mapInArrow(run, "key long, s1 long")


def crowded(tiles: DataFrame, parts: int, last: bytes | None, like: Similar) -> DataFrame:
    """tile, chunk, members, late, times of the tiles that two sets at least stand in, from rows (key, s1).

    A tile's sets come by size, and where no set before can be alike to one after, one row ends and another begins.
    late: the filter ``last`` holds the key. Rows of at most FEW sets have in times how many tiles of the band a task
    has seen with just these, and one such tile; times is null in other rows.
    """
    schema = [("tile", pa.int64()), ("chunk", pa.int32()), ("members", pa.list_(pa.int64())), ("late", pa.bool_()), ("times", pa.int32())]
    sent = tiles.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        few: dict[tuple[int, ...], list[int]] = {}
        filled = np.frombuffer(sent.value, np.uint8) if sent.value else np.zeros(8, np.uint8)
        key, chunk, held = None, 0, []
        size = lambda ids: ids >> (63 - CLASS_BITS)
        out: list[tuple[int, int, list[int]]] = []

        def written():
            keys, *rest = zip(*out, strict=True)
            return common.record(schema, keys, *rest, holds(filled, np.array(keys, np.int64).view(np.uint64)), [None] * len(out))

        def counted():
            keys, times = zip(*few.values(), strict=True)
            return common.record(schema, keys, [0] * len(few), [x[1:] for x in few], [None] * len(few), times)

        def close():
            if not chunk and 1 < len(held) <= FEW:
                few.setdefault((key >> (64 - BAND_BITS), *held), [key, 0])[1] += 1
            elif chunk or len(held) > FEW:
                out.append((key, chunk, held))

        for batch in batches:
            keys, ids = batch.column("key").to_numpy(), batch.column("s1").to_numpy()
            fresh = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
            keys, ids = keys[fresh], ids[fresh]
            apart = (keys[1:] != keys[:-1]) | (np.diff(size(ids)) > like.classes)
            cuts = np.r_[0, np.flatnonzero(apart) + 1, len(keys)] if len(keys) else np.zeros(1, int)
            # runs of one row that no batch border touches are nobody's tile
            sizes = np.diff(cuts)
            work = np.flatnonzero(sizes > 1)
            edge = {0, len(sizes) - 1}
            for r in sorted(edge | set(work.tolist())) if len(sizes) else ():
                a, b = int(cuts[r]), int(cuts[r + 1])
                if keys[a] != key or (held and size(int(ids[a])) - size(held[-1]) > like.classes):
                    close()
                    key, chunk, held = int(keys[a]), 0, []
                members = ids[a:b].tolist()
                if held and members and held[-1] == members[0]:
                    members = members[1:]
                for m in members:
                    if len(held) == CHUNK:
                        out.append((key, chunk, held))
                        # neighbouring chunks share a set, so alike sets of both come together
                        chunk, held = chunk + 1, held[-1:]
                    held.append(m)
                if len(few) > common.CACHE_WORDS:
                    yield counted()
                    few.clear()
            if len(out) > 2_000:
                yield written()
                out = []
        close()
        if out:
            yield written()
        if few:
            yield counted()

    return tiles.repartition(parts, "key").sortWithinPartitions("key", "s1").mapInArrow(run, "tile long, chunk int, members array<long>, late boolean, times int")


def candidates(docs: DataFrame, width: int, like: Similar, sets: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """What ``crowded`` makes of the tiles of ``docs``, written, and where.

    Keys that come last are those that blocks of texts hold again and again. If tiles of others are crowded by
    more pairs than CHUNK times the sets there are, or hold more sets than MET_BY_CHANCE times as many without
    being near copies, which meet in the same company again and again, their keys come last as well, those of
    the largest first. A key of so many sets is found though few of them have it among their first shingles.
    """
    seen = sets.where("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    keys = seen.groupBy(F.col("x.often").alias("key")).agg(F.sum("x.times").alias("c")).where(F.col("c") >= LAST_COUNT)
    last = last_filter(keys)
    for left in reversed(range(ROUNDS)):
        # only sets of a tile's own band have to meet there, and larger ones to meet those
        met_there = (F.col("chunk") > 0) | (band_of_set(F.col("members")[0]) <= F.shiftrightunsigned("tile", 64 - BAND_BITS))
        blocks, path = scratch.keep(crowded(tiles_of(docs, width, like, last), parts, last, like).where(met_there))
        if not left:
            break
        fresh = blocks.where("times is null and not late").select("tile", "chunk", F.size("members").alias("m"), F.xxhash64("members").alias("name"))
        tiles = fresh.groupBy("tile").agg(F.max("chunk").alias("last"), F.sum("m").alias("m")).where("last > 0")
        pairs = tiles.agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0] or 0
        once = fresh.groupBy("name").agg(F.count("*").alias("c"), F.max("m").alias("m"), F.array(F.min("tile"), F.max("tile")).alias("keys")).where("c <= 2")
        many = sets.count()
        if pairs <= 2 * CHUNK * many and (once.agg(F.sum("m")).first()[0] or 0) <= MET_BY_CHANCE * many:
            break
        room, least = MOST_LAST, CHUNK
        for m, n in once.groupBy("m").agg(F.count("*")).orderBy(F.desc("m")).collect():  # a row for each size up to CHUNK
            room -= 2 * n
            if room < 0:
                break
            least = m
        last = last_filter(once.where(F.col("m") >= least).select(F.explode("keys").alias("key")), last)
        scratch.drop(docs.sparkSession, path)
    return blocks, path


def possible_links(blocks: DataFrame, kinds: DataFrame, like: Similar, parts: int) -> DataFrame:
    """s1, g: sets that bitmaps allow to be linked, in groups.

    Pairs that met as often as alike sets do are compared, the smaller set of each with all of its others. Tiles
    of one chunk are compared inside. Sets that meet in tiles of several chunks, where near copies meet
    again and again, are first put together without regard to the tile, each once, and dealt into blocks
    twice: alike sets of different blocks come together in the second dealing. What isn't in the largest
    group by then meets every block, so near copies cost as much as there are of them.
    """
    spark = blocks.sparkSession
    few, blocks = blocks.where("times is not null"), blocks.where("times is null")
    whole = blocks.groupBy("tile").agg(F.max("chunk").alias("last"))
    one = blocks.join(whole.where("last = 0").select("tile"), "tile", "left_semi").select("members").distinct()
    hot = blocks.join(whole.where("last > 0").select("tile"), "tile", "left_semi").select("members")
    meeting = components(met(hot)).select(F.col("node").alias("s1"), F.col("component").alias("tile"))
    last = meeting.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("chunks")).select("tile", (F.col("chunks") - 1).alias("last"))
    chunk = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "s1"), F.col("last") + 1)
    many, many_at = scratch.keep(meeting.join(last, "tile").select("tile", chunk(2).alias("chunk"), "last", "s1"))
    zero, yes, no = F.lit(0).cast("long"), F.lit(1), F.lit(0)
    signatures = kinds.select("s1", "n", "map")
    inside = one.select(F.xxhash64("members").alias("tile"), zero.alias("a"), zero.alias("b"), F.explode("members").alias("s1"), yes.alias("side"))
    inside = inside.union(many.select("tile", "chunk", zero + 1, "s1", yes)).union(many.where("last > 0").select("tile", chunk(3), zero + 2, "s1", yes))
    inside = inside.union(often_met(few, like, parts).select(F.col("u").alias("tile"), zero.alias("a"), (zero + 3).alias("b"), "s1", F.when(F.col("s1") == F.col("u"), yes).otherwise(no)))
    first, first_at = scratch.keep(components(bitmap_stars(inside.withColumn("label", F.col("s1")).join(signatures, "s1"), like, parts)))

    known = many.where("last > 0").join(first.select(F.col("node").alias("s1"), F.col("component").alias("label")), "s1", "left").withColumn("label", F.coalesce("label", "s1"))
    counts = known.groupBy("tile", "label").agg(F.count("*").alias("c"))
    largest = counts.groupBy("tile").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.max("c").alias("c")).where("c < all")
    known = known.join(largest.select("tile", "most", F.ceil((F.col("all") - F.col("c")) / BLOCK).cast("long").alias("others")), "tile")
    own = F.pmod(F.xxhash64(F.lit(1), "s1"), F.col("others"))
    wanted = known.where("label != most").select("tile", own.alias("a"), F.explode(F.sequence(zero, F.col("last"))).alias("b"), "s1", yes.alias("side"), "label")
    every = known.select("tile", F.explode(F.sequence(zero, F.col("others") - 1)).alias("a"), F.col("chunk").alias("b"), "s1", no.alias("side"), "label")
    across = bitmap_stars(wanted.union(every).join(signatures, "s1"), like, parts)
    stars = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    found, _ = scratch.keep(components(stars.union(across)).select(F.col("node").alias("s1"), F.col("component").alias("g")))
    for path in (many_at, first_at):
        scratch.drop(spark, path)
    return found


def band_of_set(name):
    """The band of a set's size, from a column of names."""
    return F.shiftright(name, 63 - CLASS_BITS + CLASSES.bit_length() - 1)


def size_class(name):
    return F.shiftright(name, 63 - CLASS_BITS)


def often_met(few: DataFrame, like: Similar, parts: int) -> DataFrame:
    """u, s1: for each set u itself and the larger ones that it meets as often as alike sets do, in ``few`` (tile, members, times)."""
    band = F.shiftrightunsigned("tile", 64 - BAND_BITS)
    each = few.select(band.alias("band"), "times", "members", F.posexplode("members").alias("i", "u")).where(band_of_set(F.col("u")) <= F.col("band"))
    each = each.select("u", "times", F.explode(F.slice("members", F.col("i") + 2, F.lit(FEW))).alias("v")).where(size_class(F.col("v")) - size_class(F.col("u")) <= like.classes)
    enough = F.array(*[F.lit(like.meetings(b)) for b in range(1 << BAND_BITS)])[band_of_set(F.col("u")).cast("int")]
    pairs = each.repartition(parts, "u").groupBy("u", "v").agg(F.sum("times").alias("c")).where(F.col("c") >= enough)
    return pairs.groupBy("u").agg(F.collect_list("v").alias("v")).select("u", F.explode(F.concat(F.array("u"), "v")).alias("s1"))


def met(hot: DataFrame) -> DataFrame:
    """u, v: members of the same array, joined as far as each task sees: no more rows from a task than it has seen sets."""
    schema = [("u", pa.int64()), ("v", pa.int64())]

    def run(batches):
        at: dict[int, int] = {}
        forest = Forest(0)
        for batch in batches:
            for members in batch.column("members").to_pylist():
                for m in members:
                    if m not in at:
                        at[m] = len(forest.up)
                        forest.up.append(at[m])
                    forest.join(at[members[0]], at[m])
        out = forest.stars(list(at))
        for i in range(0, len(out), 20_000):
            yield common.record(schema, *zip(*out[i : i + 20_000], strict=True))

    arrays, _ = scratch.keep(hot)
    return arrays.coalesce(max(4, arrays.count() * CHUNK // MET_IN_A_TASK)).mapInArrow(run, "u long, v long")


def bitmap_stars(rows: DataFrame, like: Similar, parts: int) -> DataFrame:
    """u, v: sets that sizes and bitmaps join, in each block (tile, a, b), to the smallest one that they reach there.

    Rows have s1, n, map, label and side: those of side 1 are compared with all of another label.
    """
    schema = [("u", pa.int64()), ("v", pa.int64())]

    def run(batches):
        out: list[tuple[int, int]] = []
        for _, (ids, sizes, maps, sides, labels) in groups(batches, ["tile", "a", "b"], ["s1", "n", "map", "side", "label"]):
            width = min(map(len, maps))
            together = np.stack([folded(np.frombuffer(m, np.uint8), width) for m in maps])
            forest, first = Forest(len(ids)), {}
            for i, label in enumerate(labels):
                forest.join(i, first.setdefault(label, i))
            left = np.flatnonzero(np.array(sides) == 1)
            for i, at in bitmap_links(np.array(sizes), together, like, None if len(left) == len(ids) else left):
                for j in at.tolist():
                    forest.join(i, j)
            out += forest.stars(ids)
            if len(out) > 20_000:
                yield common.record(schema, *zip(*out, strict=True))
                out = []
        if out:
            yield common.record(schema, *zip(*out, strict=True))

    return rows.repartition(parts, "tile", "a", "b").sortWithinPartitions("tile", "a", "b").mapInArrow(run, "u long, v long")


def exact_links(members: DataFrame, width: int, like: Similar, parts: int) -> DataFrame:
    """u, v, blocks: doc_ids that links in a block join to the smallest one they reach there.

    ``members`` has task (three longs: g, a, b), doc_id, text, side, label and blocks (of the group). Rows of
    side 1 are compared with all rows of another label; if there is none of side 0, this is every pair.
    """
    schema = [("u", pa.int64()), ("v", pa.int64()), ("blocks", pa.int64())]
    rows = members.repartition(parts, "g", "a", "b").sortWithinPartitions("g", "a", "b")

    def run(batches):
        out: list[tuple[int, int, int]] = []
        for _, (ids, texts, sides, labels, blocks) in groups(batches, ["g", "a", "b"], ["doc_id", "text", "side", "label", "blocks"]):
            sets = shingles(pa.array(texts, pa.string()), width)
            sizes = sets.sizes
            maps = np.stack(bitmaps(sets, np.full(len(sizes), min(map(bits_of, sizes.tolist())))))
            forest, first = Forest(len(ids)), {}
            for i, label in enumerate(labels):
                forest.join(i, first.setdefault(label, i))
            left = np.flatnonzero(np.array(sides) == 1)
            for i, at in bitmap_links(sizes, maps, like, None if len(left) == len(ids) else left):
                for j in at.tolist():
                    if forest.find(i) != forest.find(j):
                        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if like.alike(len(sets[i]), len(sets[j]), shared):
                            forest.join(i, j)
            out += [(u, v, blocks[0]) for u, v in forest.stars(ids)]
            if len(out) > 20_000:
                yield common.record(schema, *zip(*out, strict=True))
                out = []
        if out:
            yield common.record(schema, *zip(*out, strict=True))

    return rows.mapInArrow(run, "u long, v long, blocks long")


def filter_of(ids: DataFrame, column: str) -> Level:
    """A Bloom filter of a column of longs, of MOST_FILTER_BYTES at most: with very many ids it lets more through."""
    keys = ids.select(F.col(column).cast("string").alias("key"))
    return build_level(keys, min(keys.count(), MOST_FILTER_BYTES * 8 // BITS_PER_KEY), 0)


def maybe_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column may be among ``ids``: a bounded filter that spares others the shuffle of an exact join."""
    return rows.where(filter_of(ids, column).holds(F.col(column).cast("string"), 0))


def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is not among ``ids``; only rows that the filter lets through are joined with them."""
    through = filter_of(ids, column).holds(F.col(column).cast("string"), 0)
    maybe = F.coalesce(through, F.lit(False))
    return rows.where(~maybe).union(rows.where(maybe).join(ids.select(column), column, "left_anti").select(*rows.columns))


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest doc_id reachable by links, itself included.

    ``docs`` needs doc_id and text; other columns are ignored. Two documents link when 100 * |intersection| >=
    percent * |union| of their sets of ``width``-word shingles; with fewer words the whole sequence is the one
    shingle. Null and empty texts, and ones without words, have no shingles and link with nothing. Rows of
    equal doc_id count as one node with several texts; rows without doc_id come out alone, with a null
    component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    like = Similar(percent)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    plain = docs.select("doc_id", "text")
    sets, _ = scratch.keep(sets_of(plain, width, like))
    ident = ["s1", "s2", "n"]
    kinds, kinds_at = scratch.keep(sets.where("n > 0").groupBy(*ident).agg(F.min("doc_id").alias("rep"), F.first("map").alias("map")).where("rep is not null"))

    blocks, blocks_at = candidates(plain, width, like, sets, parts)
    maybe = possible_links(blocks, kinds, like, parts)
    scratch.drop(spark, blocks_at)

    # documents of the groups, one for each set, with how many blocks their group has
    chosen, chosen_at = scratch.keep(maybe.join(kinds, "s1").select("g", "n", F.col("rep").alias("doc_id")))
    blocks_of = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("long")
    counts = chosen.groupBy("g").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    members = chosen.join(counts, "g").select("doc_id", "g", "blocks")
    some, some_at = scratch.keep(maybe_in(plain, "doc_id", chosen).join(members, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    zero = F.lit(0).cast("long")
    first = some.select("g", F.col("block").alias("a"), zero.alias("b"), "doc_id", "text", F.lit(1).alias("side"), F.col("doc_id").alias("label"), "blocks")
    # large groups are dealt twice, so that alike documents of different blocks come together
    again = some.where("blocks > 1").select("g", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("blocks")).alias("a"), (zero + 1).alias("b"), "doc_id", "text", F.lit(1).alias("side"), F.col("doc_id").alias("label"), "blocks")
    inside, inside_at = scratch.keep(exact_links(first.union(again), width, like, parts))
    near = components(inside.where("blocks > 1")).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))

    # of groups with several blocks: what is outside the largest cluster meets all blocks
    large = some.where("blocks > 1").join(near, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    clusters = large.groupBy("g", "label").agg(F.count("*").alias("c"))
    largest = clusters.groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.max("c").alias("c"))
    largest = largest.where("c < all").select("g", "most", F.ceil((F.col("all") - F.col("c")) / BLOCK).cast("long").alias("others"))
    large = large.join(largest, "g").withColumn("minor", F.col("label") != F.col("most"))
    own = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("others"))
    wanted = large.where("minor").select("g", own.alias("a"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("b"), "doc_id", "text", F.lit(1).alias("side"), "label", "blocks")
    every = large.select("g", F.explode(F.sequence(zero, F.col("others") - 1)).alias("a"), F.col("block").alias("b"), "doc_id", "text", F.lit(0).alias("side"), "label", "blocks")
    across = exact_links(wanted.union(every), width, like, parts)

    # the same text under several ids, and several texts under one id, are links as well
    same = sets.where("n > 0").join(kinds, ident).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u is not null")
    reach = components(inside.union(across).select("u", "v").union(same)).select(F.col("node").alias("doc_id"), "component")
    for path in (kinds_at, chosen_at, some_at, inside_at):
        scratch.drop(spark, path)
    return sets.join(reach, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
