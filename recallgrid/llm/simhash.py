"""SimHash fingerprints, and near-duplicates found through pivot distance tables."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches, give_back, pieces, texts
from recallgrid.llm.graph import components
from recallgrid.sources.storage import stored

SEED = 42
SHINGLE = 3
#: Fingerprints link at this many differing bits or fewer.
MOST_BITS = 2
#: The bits are cut into so many blocks; a pair within MOST_BITS agrees on BLOCKS - MOST_BITS of them.
BLOCKS = 5
#: Reference fingerprints of the distance tables.
PIVOTS = 12
#: A key with more fingerprints is linked through midpoints, not pair by pair.
FEW = 32

def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, most significant first."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return out


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, piece by piece; one for the whole of a shorter text."""
    digest, found, carried = xxhash.xxh64_intdigest, False, []
    for piece in pieces(data.lower()):
        words = carried + piece.split()
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
        if hashes:
            found = True
            yield np.array(hashes, np.uint64)
        carried = words[-(shingle - 1) :] if shingle > 1 else []
    if not found and carried:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def _packed(total: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number."""
    n, total = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(data, shingle):
        n += len(hashes)
        total += _bit_counts(hashes)
    return _packed(total, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("bits", pa.int64())])
    for batch in batches:
        bits = np.array([fingerprint(x) for x in texts(batch)], np.uint64).view(np.int64)
        yield batch_of(schema, [batch.column(0), batch.column(1), bits])
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, xxhash64 of the text, and the 64 fingerprint bits as a long; texts without a word have 0."""
    bounded_batches(docs.sparkSession)
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return read.mapInArrow(_fingerprints, "doc_id long, text_hash long, bits long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    """The bits of each block."""
    edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def pivots() -> list[int]:
    """Reference fingerprints; seeded, so every run and machine has the same."""
    rng = random.Random(SEED)
    return [rng.getrandbits(64) for _ in range(PIVOTS)]


def _distance(bits: Column, pivot: int, mask: int) -> Column:
    """Differing bits of a fingerprint and a reference within a block."""
    return F.bit_count(bits.bitwiseXOR(F.lit(_signed(pivot))).bitwiseAND(F.lit(_signed(mask))))


def distance_tables(prints: DataFrame) -> DataFrame:
    """bits, `blocks`: for each block the packed distances to the pivots, and `far`: the distances over all bits."""
    tables = [[_distance(F.col("bits"), p, m) for p in pivots()] for m in _masks()]

    def packed(row: list[Column]) -> Column:
        # A distance within a block is at most 13 and takes 4 bits.
        out = row[0].cast("long")
        for d in row[1:]:
            out = F.shiftleft(out, 4).bitwiseOR(d.cast("long"))
        return out

    far = [sum((t[i] for t in tables[1:]), tables[0][i]) for i in range(PIVOTS)]
    return prints.select(
        "bits",
        F.array(*[packed(t) for t in tables]).alias("blocks"),
        F.array(*[x.cast("tinyint") for x in far]).alias("far"),
    )


def links(prints: DataFrame) -> DataFrame:
    """Links a, b between distinct fingerprints (column bits) whose groups are those at MOST_BITS or fewer.

    Each fingerprint has a table of distances to the pivots, within each block
    and over all bits. By the triangle inequality a pair at d bits has no
    coordinate that differs by more than d; over blocks the differences add
    up, so BLOCKS - MOST_BITS blocks have none, and the coordinates of those
    blocks are the join key. Pairs that meet there are discarded by their
    largest coordinate difference, and the survivors are verified bit by bit.

    A key that more than FEW fingerprints share would make all pairs of a
    dense group. Its fingerprints are instead tied to their midpoints (itself
    and each fingerprint one bit away): two are within two bits exactly when
    they share one. A midpoint's fingerprints all link to the smallest, so
    their groups are the same as those of all pairs, from 65 rows each.
    """
    tables = stored(distance_tables(prints), "distances")
    chosen = list(combinations(range(BLOCKS), BLOCKS - MOST_BITS))
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("blocks")[b] for b in c]) for i, c in enumerate(chosen)])
    keyed = tables.select("bits", "far", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = stored(keyed.join(shared, "key"), "keys")
    few = keyed.filter(F.col("n") <= FEW)
    a = few.select("key", F.col("bits").alias("a"), F.col("far").alias("far_a"))
    b = few.select("key", F.col("bits").alias("b"), F.col("far").alias("far_b"))
    largest = F.array_max(F.zip_with("far_a", "far_b", lambda x, y: F.abs(x - y)))
    pairs = (
        a.join(b, "key")
        .filter((F.col("a") < F.col("b")) & (largest <= MOST_BITS))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
        .select("a", "b")
    )
    dense = keyed.filter(F.col("n") > FEW).select("bits").distinct()
    near = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    midpoints = dense.select(F.col("bits").alias("b"), F.explode(near).alias("midpoint"))
    least = midpoints.groupBy("midpoint").agg(F.min("b").alias("a"), F.max("b").alias("top")).filter("a < top")
    ties = midpoints.join(least, "midpoint").filter("a < b").select("a", "b")
    return pairs.union(ties).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each document; see grouped."""
    return grouped(docs).select("doc_id", "fingerprint", "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """Fingerprint and group of each document.

    docs: doc_id long, text string; other columns are not read. Exact copies
    and other equal fingerprints collapse to one row before any pair is
    looked for. component_id: smallest doc_id that is reachable over links,
    its own included. group: one of the fingerprints of the group, as a long;
    text_hash: xxhash64 of the text, which tells rows of one doc_id apart.

    Null, empty or wordless text: fingerprint zero, which links like any
    other. One or two words: the fingerprint of the whole sequence. Repeated
    rows: one row each. Null doc_id: its row is kept, and it is in the group
    of its fingerprint; it is never the smallest. Empty table: no rows.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(links(distinct.select("bits")))
    labelled = distinct.join(groups, distinct.bits == groups.node, "left").select(
        "bits", "least", F.coalesce("component", "bits").alias("component")
    )
    labelled = stored(labelled, "labelled")
    lowest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = labelled.join(lowest, "component").select("bits", "component_id", F.col("component").alias("group"))
    return prints.join(ids, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "group", "text_hash"
    )
