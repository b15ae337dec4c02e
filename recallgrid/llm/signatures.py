"""Jaccard join of word n-gram sets by signature trees.

A set's signature is a bitmap of its tokens (hashed n-grams). Sets that can
meet at all are brought together by the rarest tokens of each (at a Jaccard
similarity of s, two sets share one of the first n - ceil(s n) + 1 tokens of
either in any common order). What meets is packed into trees whose nodes hold
the OR of the bitmaps below and the range of their sizes; two trees are
walked together, and a pair of nodes is left as soon as no pair of sets below
it can overlap enough. Groups larger than one tree's are cut into chunks,
whose roots are compared first, as one more level of the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches, pieces, texts
from recallgrid.llm.graph import components
from recallgrid.sources.storage import stored

WORDS = 5
#: Sets link when 100 times the intersection is at least LEAST times the union.
LEAST = 80
#: 64-bit words of a bitmap.
BITMAP = 64
#: Nodes below a node.
FAN = 8
#: Sets and tokens that one tree holds, about.
CHUNK, CHUNK_TOKENS = 512, 1_000_000
#: Pairs of nodes that are compared at once.
FRONT = 1 << 14
#: Tokens that a task gathers before it counts which of them many of its sets hold.
GATHERED = 3_000_000
#: Of these, the ones in so many sets are told; the FREQUENT most frequent of all tasks go to the end of every set's order.
OFTEN, FREQUENT = 3, 300_000
#: Bits of a filter for each key, and log2 of the 64-bit words that it has at most: 16 MB, whatever the input.
KEY_BITS, FILTER = 32, 21

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_2 = np.uint64(0xFF51AFD7ED558CCD)
_HALF = np.uint64(32)


# Bytes of words: white space counts nothing, A-Z as a-z.
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_BLANK] = 0
#: Powers of an odd factor and of its inverse, as many as the longest piece has needed.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if n > len(_POWERS[0]):
        factor = int(_MIX)
        for i, x in enumerate((factor, pow(factor, -1, 1 << 64))):
            out = np.full(max(n, 1 << 16), x, np.uint64)
            out[0] = 1
            _POWERS[i] = np.cumprod(out, dtype=np.uint64)
    return _POWERS


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word: its bytes, lower-cased, as the digits of a number."""
    if not data:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    codes = np.frombuffer(data, np.uint8)
    blank = _BLANK[codes]
    sums = np.cumsum(_BYTE[codes] * power[: len(codes)], dtype=np.uint64)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = np.concatenate([[0] * (not blank[0]), edges, [len(codes)] * (not blank[-1])]).astype(np.int64)
    start, end = edges[::2], edges[1::2]
    return (sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))) * inverse[start]


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Ascending, without repeats."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


def tokens(data: bytes, words: int = WORDS) -> np.ndarray:
    """The different n-grams of a text as ascending 64-bit hashes; of a shorter text one for all its words."""
    parts, carried = [], np.zeros(0, np.uint64)
    for piece in pieces(data):
        hashes = np.concatenate([carried, word_hashes(piece)])
        n = len(hashes) - words + 1
        if n > 0:
            parts.append(_distinct(_combined([hashes[i : i + n] for i in range(words)])))
        carried = hashes[max(0, n) :]
    if not parts:
        return _combined([carried[i : i + 1] for i in range(len(carried))]) if len(carried) else carried
    return _distinct(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def _combined(hashes: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(hashes[0]), len(hashes), np.uint64)
    for h in hashes:
        out = (out ^ h) * _MIX
        out = (out ^ (out >> _HALF)) * _MIX_2
    return out ^ (out >> _HALF)


def set_id(found: np.ndarray) -> int:
    """One number for a set: equal sets have equal ones."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def enough(common, size_a, size_b, least: int = LEAST):
    """Is this overlap enough? 100 i >= L (a + b - i), in whole numbers."""
    return (100 + least) * common >= least * (size_a + size_b)


def prefix_length(n: int, least: int = LEAST, shared: int = 1) -> int:
    """How many tokens of a set of n, in any common order, hold `shared` of every set that links with it.

    Such a set has at least `least` percent of the n; with fewer in common
    than `shared`, all of them.
    """
    return min(n, n - -(-least * n // 100) + shared)


def asked(n: int, least: int = LEAST) -> int:
    """How many shared tokens a set of n is asked for in its prefix; more for larger sets."""
    return 1 + n * (100 - least) // 400


# -- first passes over the texts ----------------------------------------------------------------

_SEEN = "kind int, doc_id long, node long, size int"
_SET, _TOKEN = 0, 1


def _outlines(words: int):
    """Kind 0: doc_id, set and its size. Kind 1: a token that many sets of a task hold, and in how many."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])

    def told(gathered: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(gathered), return_counts=True)
        token, n = token[n >= OFTEN], n[n >= OFTEN]
        return batch_of(schema, [np.full(len(n), _TOKEN, np.int32), pa.nulls(len(n), pa.int64()), token.view(np.int64), n.astype(np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import signatures

        gathered, held, known = [], 0, set()
        for batch in batches:
            nodes, sizes = [], []
            for data in texts(batch):
                found = signatures.tokens(data, words)
                nodes.append(signatures.set_id(found))
                sizes.append(len(found))
                if nodes[-1] not in known:
                    known.add(nodes[-1])
                    gathered.append(found)
                    held += len(found)
                if held > signatures.GATHERED:
                    yield told(gathered)
                    gathered, held, known = [], 0, set()
            yield batch_of(schema, [np.full(len(nodes), _SET, np.int32), batch.column(0), nodes, np.array(sizes, np.int32)])
        if gathered:
            yield told(gathered)

    return run


def _prefixes(sent, words: int, least: int):
    """token, node and mark for the first tokens of each set, frequent ones last.

    The mark's lowest bit tells whether the token is in the prefix for one
    shared token; the rest is the size of the set.
    """
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("mark", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import signatures

        frequent, counts = sent.value
        known: set[int] = set()
        for batch in batches:
            token, node, mark = [], [], []
            for data in texts(batch):
                found = signatures.tokens(data, words)
                of, n = signatures.set_id(found), len(found)
                if not n or of in known:
                    continue
                if len(known) >= 100_000:
                    known.clear()
                known.add(of)
                first = signatures.prefix(found, frequent, counts, signatures.prefix_length(n, least, signatures.asked(n, least)))
                token.append(first)
                node.append(np.full(len(first), of, np.int64))
                mark.append(2 * n + (np.arange(len(first)) < signatures.prefix_length(n, least)))
            if token:
                yield batch_of(schema, [np.concatenate(token).view(np.int64), np.concatenate(node), np.concatenate(mark).astype(np.int32)])

    return run


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The first k tokens of a set by (frequency, hash); tokens that are not frequent count as 0."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        often = np.where(frequent[at] == found, counts[at], 0)
        if often.any():
            return found[np.argsort(often, kind="stable")[:k]]
    return found[:k]


def _filter_of(values: DataFrame, name: str) -> np.ndarray:
    """A bitmap that holds the keys, KEY_BITS for each up to 2 ** FILTER words; it may let others through."""
    words = max(6, min(FILTER, (values.count() * KEY_BITS // 64).bit_length()))
    place = F.shiftrightunsigned(name, 64 - words).cast("int")
    bit = F.expr(f"shiftleft(1L, cast({name} & 63 as int))")
    rows = values.select(place.alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << words, np.int64)
    out[rows.column("place").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64)
    return (held[keys >> np.uint64(65 - len(held).bit_length())] >> (keys & np.uint64(63))) & np.uint64(1) != 0


def _let_through(sent, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import signatures

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(column)).to_numpy()
            yield batch.filter(pa.array(signatures.passes(sent.value, keys)))

    return run


def _sets(sent, words: int):
    """Signatures and tokens of the sets that pass a filter on (node, doc_id), each about once in a task."""
    schema = pa.schema(
        [("node", pa.int64()), ("size", pa.int64()), ("first", pa.int64()), ("bitmap", pa.binary()), ("tokens", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import signatures

        ids, pairs = sent.value
        known: set[int] = set()
        for batch in batches:
            doc = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            rows = []
            for i in np.flatnonzero(signatures.passes(ids, signatures.scattered(doc))).tolist():
                data = texts(batch.slice(i, 1))[0]
                found = signatures.tokens(data, words)
                node = signatures.set_id(found)
                if node in known or not signatures.passes(pairs, signatures.scattered(doc[i : i + 1]) ^ node).any():
                    continue
                if len(known) >= 100_000:
                    known.clear()
                known.add(node)
                rows.append((node, len(found), int(found[:1].view(np.int64)[0]), signatures.bitmap(found).tobytes(), found.tobytes()))
            if rows:
                yield batch_of(schema, zip(*rows, strict=True))

    return run


#: An id is spread over 64 bits by these rotations of its bits.
_TURNS = (11, 24, 37, 50)


def scattered(ids: np.ndarray) -> np.ndarray:
    """Ids with their low bits spread out, as keys of a filter; _scattered is the same for columns."""
    x = ids.view(np.uint64)
    out = x
    for turn in _TURNS:
        out = out ^ ((x << np.uint64(turn)) | (x >> np.uint64(64 - turn)))
    return out.view(np.int64)


def _scattered(ids: Column) -> Column:
    out = ids
    for turn in _TURNS:
        out = out.bitwiseXOR(F.shiftleft(ids, turn).bitwiseOR(F.shiftrightunsigned(ids, 64 - turn)))
    return out


# -- trees --------------------------------------------------------------------------------------


class Level:
    """Nodes of one level: OR of the bitmaps below, range of sizes, most tokens beyond one for each bit, one class or none."""

    def __init__(self, bitmaps, low, high, beyond, kind):
        self.bitmaps, self.low, self.high, self.beyond, self.kind = bitmaps, low, high, beyond, kind

    def above(self) -> Level:
        at = np.arange(0, len(self.low), FAN)
        kind = np.minimum.reduceat(self.kind, at)
        kind = np.where(kind == np.maximum.reduceat(self.kind, at), kind, -1)
        return Level(
            np.bitwise_or.reduceat(self.bitmaps, at, axis=0),
            np.minimum.reduceat(self.low, at),
            np.maximum.reduceat(self.high, at),
            np.maximum.reduceat(self.beyond, at),
            kind,
        )


def bitmap(found: np.ndarray) -> np.ndarray:
    bits = (found * _MIX) >> np.uint64(64 - 6 - BITMAP.bit_length() + 1)
    out = np.zeros(BITMAP, np.uint64)
    np.bitwise_or.at(out, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    return out


class Tree:
    """Signatures in leaves of neighbours by size and least token; levels from the sets (0) to the root.

    Without the sets themselves, two sets count as linked when their
    signatures allow it.
    """

    def __init__(self, size: np.ndarray, first: np.ndarray, bitmaps: np.ndarray, kinds: np.ndarray, sets: list[np.ndarray] | None = None):
        self.order = np.lexsort((size, first, np.floor(np.log(size) / np.log(1.1))))
        size, bitmaps = size[self.order], bitmaps[self.order]
        self.sets = [sets[i] for i in self.order] if sets is not None else None
        # Tokens beyond one for each bit.
        beyond = size - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [Level(bitmaps, size, size, beyond, kinds[self.order])]
        while len(self.levels[-1].low) > 1:
            self.levels.append(self.levels[-1].above())

    @classmethod
    def of(cls, sets: list[np.ndarray], kinds: np.ndarray) -> Tree:
        size = np.array([len(x) for x in sets], np.int64)
        first = np.array([x[0] for x in sets], np.uint64).view(np.int64)
        return cls(size, first, np.array([bitmap(x) for x in sets]), kinds, sets)

    def raised(self, height: int) -> Tree:
        while len(self.levels) < height:
            self.levels.append(self.levels[-1].above())
        return self


def possible(a: Level, i: np.ndarray, b: Level, j: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of nodes can hold a pair of sets that link and are not yet of one class."""
    ok = (100 * a.high[i] >= least * b.low[j]) & (100 * b.high[j] >= least * a.low[i])
    ok &= ~((a.kind[i] == b.kind[j]) & (a.kind[i] >= 0))
    at = np.flatnonzero(ok)
    common = np.bitwise_count(a.bitmaps[i[at]] & b.bitmaps[j[at]]).sum(1, dtype=np.int64)
    # Each common token sets a common bit; those beyond one for each bit are in both sets.
    most = np.minimum(common + np.minimum(a.beyond[i[at]], b.beyond[j[at]]), np.minimum(a.high[i[at]], b.high[j[at]]))
    ok[at] = enough(most, a.low[i[at]], b.low[j[at]], least)
    return ok


def walk(a: Tree, b: Tree, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that may link, by walking two trees (or one with itself) from the roots down."""
    same = a is b
    height = max(len(a.levels), len(b.levels))
    a.raised(height), b.raised(height)
    waiting = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        depth, i, j = waiting.pop()
        if len(i) > FRONT:
            waiting += [(depth, i[FRONT:], j[FRONT:])]
            i, j = i[:FRONT], j[:FRONT]
        if same and depth == 0:
            i, j = i[i < j], j[i < j]
        ok = possible(a.levels[depth], i, b.levels[depth], j, least)
        i, j = i[ok], j[ok]
        if depth == 0:
            if len(i):
                yield i, j
            continue
        child = np.arange(FAN)
        below_i = np.repeat(i[:, None] * FAN + child, FAN, axis=1).ravel()
        below_j = np.tile(j[:, None] * FAN + child, (1, FAN)).ravel()
        there = (below_i < len(a.levels[depth - 1].low)) & (below_j < len(b.levels[depth - 1].low))
        if same:
            there &= below_i <= below_j
        if there.any():
            waiting.append((depth - 1, below_i[there], below_j[there]))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two ascending arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def linked(a: Tree, b: Tree, classes_a: np.ndarray, classes_b: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Links (places in a and b) that join the classes exactly as all links would."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for i, j in walk(a, b, least):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            u, v = root(int(classes_a[p])), root(int(classes_b[q]))
            if u != v:
                if a.sets is None or enough(overlap(a.sets[p], b.sets[q]), len(a.sets[p]), len(b.sets[q]), least):
                    parent[u] = v
                    yield p, q


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tree(rows: pa.Table, places: np.ndarray, kinds: np.ndarray) -> Tree:
    size, first = (rows.column(c).to_numpy()[places] for c in ("size", "first"))
    bitmaps = np.frombuffer(b"".join(rows.column("bitmap").take(pa.array(places)).to_pylist()), np.uint64).reshape(-1, BITMAP)
    sets = None
    if "tokens" in rows.column_names:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("tokens").take(pa.array(places))]
    return Tree(size, first, bitmaps, kinds[places], sets)


def _once(rows: pa.Table, keys: list[str]) -> pa.Table:
    keyed = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in keys], 1)
    return rows.take(np.sort(np.unique(keyed, axis=0, return_index=True)[1]))


def _cell(least: int):
    """Links within side 0, or between sides 0 and 1, of the rows of a cell."""

    def run(rows: pa.Table) -> pa.Table:
        from recallgrid.llm import signatures as own

        # A set may come more than once, from rows of different tasks.
        rows = own._once(rows, ["side", "node"])
        node, side, label = (rows.column(c).to_numpy() for c in ("node", "side", "label"))
        kinds = np.unique(label, return_inverse=True)[1]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a = own._tree(rows, first, kinds)
        b = own._tree(rows, second, kinds) if len(second) else a
        of_a = first[a.order]
        of_b = second[b.order] if len(second) else of_a
        found = [(int(node[of_a[p]]), int(node[of_b[q]])) for p, q in own.linked(a, b, kinds[of_a], kinds[of_b], least)]
        return pa.Table.from_batches([batch_of(own._LINKS, zip(*found, strict=True) if found else ([], []))])

    return run


def _root(rows: pa.Table) -> pa.Table:
    from recallgrid.llm import signatures as own

    rows = own._once(rows, ["node"])
    top = own._tree(rows, np.arange(len(rows)), np.zeros(len(rows), np.int64)).levels[-1]
    schema = pa.schema([("chunk", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("beyond", pa.int64()), ("bitmap", pa.list_(pa.int64()))])
    columns = [rows.column("chunk").to_pylist()[:1], top.low, top.high, top.beyond, [top.bitmaps[0].view(np.int64)]]
    return pa.Table.from_batches([batch_of(schema, columns)])


# -- cells --------------------------------------------------------------------------------------


def _parts(rows: Column, size: Column) -> Column:
    """Into how many chunks of CHUNK sets and CHUNK_TOKENS tokens a group goes."""
    return F.greatest(F.ceil(rows / CHUNK), F.ceil(size / CHUNK_TOKENS), F.lit(1)).cast("long")


def _cells(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links of the cells: members has cell, side, node and label."""
    rows = members.join(sets, "node")
    return rows.groupBy("cell").applyInArrow(_cell(least), "a long, b long")


def _across(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links between the chunks of groups that are larger than one; members has hub, node, size, label.

    Sets of one class (label) need not be compared again: a class with many
    members in a group has chunks of its own, and two chunks of one class
    never meet. Chunks hold sets of one class of sizes, and meet those of the
    same and the next one, if their roots can overlap enough.
    """
    # Sizes of two sets that link differ by a factor of 100 / least at most.
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(1.01 * 100 / least))).cast("long")
    members = members.withColumn("band", band)
    one = members.groupBy("hub", "band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("of"))
    one = one.withColumn("own", F.col("n") > CHUNK // 4)
    mixed = one.filter("not own").groupBy("hub", "band").agg(F.sum("n").alias("mixed_n"), F.sum("of").alias("mixed_of"))
    one = stored(
        one.join(mixed, ["hub", "band"], "left").select(
            "hub", "band", "label", "own", _parts(F.when(F.col("own"), F.col("n")).otherwise(F.col("mixed_n")), F.when(F.col("own"), F.col("of")).otherwise(F.col("mixed_of"))).alias("parts")
        ),
        "classes",
    )
    placed = members.join(one, ["hub", "band", "label"])
    pure = F.when(F.col("own"), F.col("label"))
    part = F.when(F.col("own"), F.pmod(F.xxhash64("node"), "parts")).otherwise(F.pmod(F.xxhash64("label"), "parts"))
    chunk = F.xxhash64("hub", "band", F.coalesce(pure, F.lit(0)), F.col("own").cast("int"), part)
    placed = stored(placed.select("hub", "band", pure.alias("pure"), chunk.alias("chunk"), "node", "label"), "chunks")
    roots = placed.select("chunk", "node").join(sets.select("node", "size", "first", "bitmap"), "node")
    roots = roots.groupBy("chunk").applyInArrow(_root, "chunk long, low long, high long, beyond long, bitmap array<long>")
    tops = stored(placed.select("hub", "band", "pure", "chunk").distinct().join(roots, "chunk"), "roots")
    a = tops.select("hub", *(F.col(c).alias(f"{c}_a") for c in ("band", "pure", "chunk", "low", "high", "beyond", "bitmap")))
    a = a.withColumn("band", F.explode(F.array("band_a", F.col("band_a") + 1)))
    b = tops.select("hub", "band", *(F.col(c).alias(f"{c}_b") for c in ("pure", "chunk", "low", "high", "beyond", "bitmap")))
    once = (F.col("band") > F.col("band_a")) | (F.col("chunk_a") <= F.col("chunk_b"))
    apart = F.col("pure_a").isNull() | F.col("pure_b").isNull() | (F.col("pure_a") != F.col("pure_b"))
    sized = (100 * F.col("high_a") >= least * F.col("low_b")) & (100 * F.col("high_b") >= least * F.col("low_a"))
    bits = F.aggregate(F.zip_with("bitmap_a", "bitmap_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    most = F.least(bits + F.least("beyond_a", "beyond_b"), F.col("high_a"), F.col("high_b"))
    pairs = a.join(b, ["hub", "band"]).filter(once & apart & sized).filter(enough(most, F.col("low_a"), F.col("low_b"), least))
    pairs = stored(pairs.select(F.xxhash64("chunk_a", "chunk_b").alias("cell"), "chunk_a", "chunk_b"), "chunk-pairs")
    sides = pairs.select("cell", F.lit(0).alias("side"), F.col("chunk_a").alias("chunk")).union(
        pairs.filter("chunk_a <> chunk_b").select("cell", F.lit(1), "chunk_b")
    )
    return _cells(sides.join(placed.select("chunk", "node", "label"), "chunk").select("cell", "side", "node", "label"), sets, least)


_SHARED = "hub long, node long, mark int"


def _needed(size: Column, least: int) -> Column:
    """Shared tokens that a set needs for any partner: what its smallest partner is asked for; see asked()."""
    smallest = F.floor((size * least + 99) / 100)
    return 1 + F.floor(smallest * (100 - least) / 400)


def _members(shared: DataFrame, least: int) -> DataFrame:
    """hub, node, size: the groups in which sets can meet; shared has the prefix rows of tokens in several sets.

    A set with fewer shared tokens than its partners ask for has none, nor
    has a set in a group without another of a size that could link.
    """
    size = F.shiftright("mark", 1).cast("long")
    counts = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    alive = stored(counts.filter(F.col("n") >= _needed(F.col("size"), least)).select("node"), "alive")
    sent = shared.sparkSession.sparkContext.broadcast(_filter_of(alive, "node"))
    first = shared.filter(F.col("mark").bitwiseAND(F.lit(1)) == 1).mapInArrow(_let_through(sent, "node"), _SHARED)
    # Sizes of sets that link lie within four of these bands.
    band = F.floor(F.log(size.cast("double")) / float(np.log(1.003 * (100 / least) ** 0.25))).cast("long")
    met = stored(first.select("hub", "node", size.alias("size"), band.alias("band")).distinct(), "met")
    sent.destroy()
    near = met.groupBy("hub", "band").agg(F.count(F.lit(1)).alias("n"))
    near = near.select("hub", F.explode(F.sequence(F.col("band") - 4, F.col("band") + 4)).alias("band"), "n")
    near = near.groupBy("hub", "band").agg(F.sum("n").alias("n")).filter("n > 1").select("hub", "band")
    return stored(met.join(near, ["hub", "band"]).select("hub", "node", "size"), "members")


def _classes(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """node and component of the sets that links within the groups join; members has hub, node and size.

    sets: node, size, first, bitmap and, to verify the links, tokens.
    """
    groups = members.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("of"), F.min("node").alias("least"))
    groups = stored(groups.select("hub", "least", _parts(F.col("rows"), F.col("of")).alias("parts")), "groups")
    # The smallest set of a group is in each of its parts and ties them together.
    own = F.array(F.pmod(F.xxhash64("node"), "parts"))
    parts = F.when(F.col("node") == F.col("least"), F.expr("sequence(0L, parts - 1)")).otherwise(own)
    in_parts = members.join(groups, "hub").select("hub", "node", F.explode(parts).alias("part"))
    cells = in_parts.select(F.xxhash64("hub", "part").alias("cell"), F.lit(0).alias("side"), F.col("node").alias("label"), "node")
    classes = components(_cells(cells, sets, least))
    large = groups.filter("parts > 1").select("hub")
    if large.isEmpty():
        return classes
    rest = members.join(large, "hub").join(classes, "node", "left")
    rest = rest.select("hub", "node", "size", F.coalesce("component", "node").alias("label"))
    open_ = rest.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("hub")
    rest = stored(rest.join(open_, "hub"), "open")
    if rest.isEmpty():
        return classes
    few = members.sparkSession.sparkContext.broadcast(_filter_of(rest, "node"))
    sets = stored(sets.mapInArrow(_let_through(few, "node"), sets.schema), "open-sets")
    few.destroy()
    # What is joined already counts as its stars.
    return components(classes.toDF("a", "b").union(_across(rest, sets, least)))


def similar_sets(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """Groups of documents whose sets of word n-grams link.

    docs: doc_id long, text string; other columns are not read. Two documents
    link when 100 times the intersection of their sets is at least `least`
    times the union; a text of fewer words has one element, all its words.
    Returns doc_id, n_shingles (size of the set) and component_id (smallest
    doc_id reachable over links, its own included).

    Every link counts. Equal sets are one node. The first tokens of a set,
    rare ones first, name the groups in which it can meet a partner (the
    smallest set with the token stands for it); frequent tokens, told by
    counts over all documents, come last in the order, so common passages
    name no group unless a text is little else. Sets that share too few of
    these tokens with any other set have no partner and go no further. A group's sets go into
    signature trees of about CHUNK sets. Links that join what is joined
    already are not verified, so a dense group costs no pair for each pair.

    Null, empty or wordless text: n_shingles 0, linked with nothing, its own
    doc_id as component_id. Very long texts are hashed piece by piece; a tree
    is bounded by tokens as well. Ties cannot matter. Repeated rows: one row
    each, linked. Null doc_id: its row is kept and in the group of its links,
    never the smallest; null if nothing else is in it. Empty table: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    read = docs.select("doc_id", "text")
    seen = stored(read.mapInArrow(_outlines(words), _SEEN), "outlines")
    outlines = seen.filter(F.col("kind") == _SET).select("doc_id", "node", "size")
    often = seen.filter(F.col("kind") == _TOKEN).groupBy(F.col("node").alias("token")).agg(F.sum("size").alias("n"))
    often = often.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, n = often.column("token").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(token)
    sent = spark.sparkContext.broadcast((token[order], n[order]))
    first = read.select("text").mapInArrow(_prefixes(sent, words, least), "token long, node long, mark int")
    first = stored(first, "prefixes")
    sent.destroy()
    hubs = first.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top").select("token", "hub")
    hubs = stored(hubs, "hubs")
    held = spark.sparkContext.broadcast(_filter_of(hubs, "token"))
    shared = first.mapInArrow(_let_through(held, "token"), "token long, node long, mark int")
    # The distinct rows need no shuffle of their own: the join has dealt them by token.
    shared = shared.join(hubs, "token").select("token", "hub", "node", "mark").distinct()
    shared = stored(shared.select("hub", "node", "mark"), "shared")
    held.destroy()
    members = _members(shared, least)
    keepers = outlines.join(members.select("node").distinct(), "node").groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("id"))
    keepers = stored(keepers.select("node", _scattered(F.col("id")).alias("id")), "keepers")
    pair = keepers.select(F.col("node").bitwiseXOR(F.col("id")).alias("pair"))
    wanted = spark.sparkContext.broadcast((_filter_of(keepers, "id"), _filter_of(pair, "pair")))
    sets = stored(read.mapInArrow(_sets(wanted, words), "node long, size long, first long, bitmap binary, tokens binary"), "sets")
    wanted.destroy()
    signatures = sets.select("node", "size", "first", "bitmap")
    # What the signatures let through falls into clusters; each set is then shipped once, to the others of its cluster.
    clusters = _classes(members, signatures, least)
    members = clusters.join(members.select("node", "size").distinct(), "node").select(F.col("component").alias("hub"), "node", "size")
    classes = _classes(stored(members, "clustered"), sets, least)
    least_of = outlines.groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = stored(
        least_of.join(classes, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "labelled"
    )
    lowest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = labelled.join(lowest, "component").select("node", "component_id")
    linked_to = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return outlines.join(ids, "node").select("doc_id", F.col("size").cast("long").alias("n_shingles"), linked_to.alias("component_id"))
