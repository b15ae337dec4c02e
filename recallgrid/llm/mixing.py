"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import WORD
from recallgrid.sources.storage import stored

#: Weights dealt to the sources in order, and the share of all words that the mix holds.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: Most uses of a document, and the cost of each further use of a word.
USES = 2
USE_COSTS = (1, 3)
#: Parts of the hash range by which a selection is cut, in two steps.
PARTS = 4096


def targets(sizes: dict, weights: dict, total: float, uses: int = USES) -> dict:
    """Target of each source: `total` words by weight, none above `uses` times its words.

    What a source cannot hold goes to the others by weight, until none is above.
    """
    weight, out = float(sum(weights[s] for s in sizes)), {}
    # In this order a source is full only if all before it are.
    for s in sorted(sizes, key=lambda s: (sizes[s] / weights[s], repr(s))):
        if weights[s] * total > uses * sizes[s] * weight:
            out[s] = float(uses * sizes[s])
            total -= uses * sizes[s]
        else:
            out[s] = weights[s] * total / weight
            total -= out[s]
        weight -= weights[s]
    return out


def routed(patterns: dict[tuple, int], quotas: dict) -> dict[tuple, dict]:
    """The flow of all patterns. A source that shares no document with another needs none: its words all go to it."""
    shared = {s for p in patterns if len(p) > 1 for s in p}
    out = {p: {p[0]: min(USES * words, quotas[p[0]])} for p, words in patterns.items() if len(p) == 1 and p[0] not in shared}
    rest = {p: words for p, words in patterns.items() if p not in out}
    return out | (flow(rest, {s: q for s, q in quotas.items() if s in shared}) if rest else {})


def flow(patterns: dict[tuple, int], quotas: dict, costs: tuple = USE_COSTS) -> dict[tuple, dict]:
    """Min-cost flow of words from membership patterns to source quotas.

    patterns: words by sorted tuple of sources. Each use of a pattern's words
    is an arc of that capacity whose cost rises with the use (convex), so a
    word is repeated only where no unused one can serve. quotas: words by
    source. Returns words by pattern and source; successive shortest paths,
    so the result is exact for whole words. A quota beyond what its patterns
    hold is filled as far as they reach.
    """
    names = ["from", *sorted(patterns, key=repr), *(("to", s) for s in sorted(quotas, key=repr)), "sink"]
    node = {x: i for i, x in enumerate(names)}
    arcs: list[list] = []  # to, capacity left, cost
    at: list[list[int]] = [[] for _ in names]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            at[x].append(len(arcs))
            arcs.append([y, c, k])
        return len(arcs) - 2

    kept = {}
    for p, words in patterns.items():
        for cost in costs:
            arc(0, node[p], words, cost)
        for s in p:
            kept[p, s] = arc(node[p], node["to", s], len(costs) * words, 0)
    for s, words in quotas.items():
        arc(node["to", s], node["sink"], words, 0)
    sink, price = node["sink"], [0] * len(names)
    while True:
        far, via, heap = [None] * len(names), [-1] * len(names), [(0, 0)]
        far[0] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in at[a]:
                b, left, cost = arcs[k]
                if left > 0:
                    new = d + cost + price[a] - price[b]
                    if far[b] is None or new < far[b]:
                        far[b], via[b] = new, k
                        heapq.heappush(heap, (new, b))
        if far[sink] is None:
            break
        price = [p + (f if f is not None else far[sink]) for p, f in zip(price, far, strict=True)]
        way, b = [], sink
        while b:
            way.append(via[b])
            b = arcs[via[b] ^ 1][0]
        push = min(arcs[k][1] for k in way)
        for k in way:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    out: dict = {p: {} for p in patterns}
    for (p, s), k in kept.items():
        if arcs[k ^ 1][1]:
            out[p][s] = arcs[k ^ 1][1]
    return out


def _nearest(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulated size before and after each part of a pattern, in order of the parts."""
    order = Window.partitionBy("pattern").orderBy(*keys)
    after = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("after", after).withColumn("before", F.col("after") - F.col("size"))


def _border(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the seeded order of each pattern is cut so that its `rest` words are reached.

    Returns the plan with the border's part and sub-part of each pattern, and
    the rows of that sub-part with whether each is taken.

    Only sums of 4,096 hash ranges of a pattern, then those of the range in
    which its border lies, and last the documents of one part of 4,096 * 4,096
    are ordered; no step gathers a pattern's documents. The document on the
    border is taken when that comes nearer.
    """
    cut = docs.join(wanted, "pattern")
    first = cut.groupBy("pattern", "part", "rest").agg(F.sum("size").alias("size"))
    first = _nearest(first, ["part"]).filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("after")))
    first = stored(first.select("pattern", F.col("part").alias("edge"), (F.col("rest") - F.col("before")).alias("rest_2")), "edges")
    second = docs.join(first, (docs.pattern == first.pattern) & (docs.part == first.edge)).drop(first.pattern)
    second = second.groupBy("pattern", "part_2", "rest_2").agg(F.sum("size").alias("size"))
    second = _nearest(second, ["part_2"]).filter((F.col("before") < F.col("rest_2")) & (F.col("rest_2") <= F.col("after")))
    second = second.select("pattern", F.col("part_2").alias("edge_2"), (F.col("rest_2") - F.col("before")).alias("rest_3"))
    edges = stored(wanted.join(first, "pattern", "left").join(second, "pattern", "left"), "edges")
    on_edge = (F.col("part") == F.col("edge")) & (F.col("part_2") == F.col("edge_2"))
    last = _nearest(docs.join(edges, "pattern").filter(on_edge), ["hash", "doc_id", "row"]).select(
        "row", "hash", (2 * F.col("before") + F.col("size") <= 2 * F.col("rest_3")).alias("near")
    )
    # At most one part of 4,096 * 4,096 of each pattern.
    return edges, stored(last, "border")


def _uses(near: Column) -> Column:
    """How often a row is used: `whole` times, and once more if it lies before the border or is taken on it."""
    inside = (
        F.when(F.col("rest") <= 0, False)
        .when(F.col("edge").isNull(), True)
        .when(F.col("part") != F.col("edge"), F.col("part") < F.col("edge"))
        .otherwise(F.col("part_2") < F.col("edge_2"))
    )
    return F.col("whole") + F.coalesce(near, inside).cast("long")


def mix(docs: DataFrame, seed: int = 7, share: float = SHARE, weights: tuple = WEIGHTS, members: str | None = None) -> DataFrame:
    """Words that a mix of sources takes from each document.

    docs: doc_id long, text string, and source string or, if `members` names
    one, a column array<string> (a document may belong to several sources);
    other columns are not read, whatever their names. Size: words of the text. Sources in code point order, null last,
    weigh `weights`, repeating; their targets share `share` times all words
    and stop at twice the words of their documents. Documents are summed by
    membership pattern, a min-cost flow routes each pattern's words to the
    quotas, first uses before second ones, and each pattern's documents are
    then chosen whole, in a seeded order: all once or twice as the flow needs,
    and the rest up to the nearest document. What goes through the driver is
    one row per pattern and per source, not per document.

    Null text: size 0, nothing taken. Ties of the seeded order go by doc_id.
    Repeated rows: each is a document. Empty array: as a null source. Empty
    table: no rows.
    """
    sized, edges, border = _planned(docs, seed, share, weights, members)
    near = border.select("row", "near")
    return sized.join(edges, "pattern").join(near, "row", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _uses(F.col("near"))).alias("taken")
    )


def mixed(docs: DataFrame, seed: int = 7, share: float = SHARE, weights: tuple = WEIGHTS, members: str | None = None) -> DataFrame:
    """The documents, all columns kept, as many rows of each as the mix uses it.

    The same plan as mix(), applied to each document where it lies: a row's
    place in the seeded order follows from itself, and only the plan (a row
    per pattern) and the documents on the borders are joined, so texts are not
    shuffled. Documents on a border are told by doc_id and text, so only rows
    that repeat both are used alike there. Documents without a word are not
    used.
    """
    _, edges, border = _planned(docs, seed, share, weights, members)
    near = border.groupBy("hash").agg(F.max("near").alias("_near"))
    placed = docs.select(F.struct(*docs.columns).alias("_row"), *_placed(docs, seed, members))
    used = placed.join(edges.drop("source_size", "target"), "pattern").join(near, "hash", "left")
    used = used.filter("size > 0").withColumn("_uses", _uses(F.col("_near"))).filter("_uses > 0")
    return used.withColumn("_use", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_uses")))).select("_row.*")


def _placed(docs: DataFrame, seed: int, members: str | None) -> list[Column]:
    """doc_id, pattern, size, and the place in the seeded order, from a document's own columns."""
    of = (
        F.array_sort(F.array_distinct(F.when(F.size(members) > 0, F.col(members)).otherwise(F.array(F.lit(None).cast("string")))))
        if members
        else F.array(F.col("source").cast("string"))
    )
    named = F.transform(of, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("null")))
    # With the text, so that rows without an id or with a repeated one are spread as well.
    place = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    return [
        F.col("doc_id"),
        F.to_json(F.struct(named.alias("s"))).alias("pattern"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        place.alias("hash"),
        F.shiftrightunsigned(place, 52).alias("part"),
        F.shiftrightunsigned(place, 40).bitwiseAND(PARTS - 1).alias("part_2"),
    ]


def _planned(docs: DataFrame, seed: int, share: float, weights: tuple, members: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents (without their texts), the plan by pattern, and the rows on its borders."""
    spark = docs.sparkSession
    sized = stored(docs.select(*_placed(docs, seed, members), F.monotonically_increasing_id().alias("row")), "sizes")
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()
    patterns = {r["pattern"]: (tuple(json.loads(r["pattern"])["s"]), r["size"]) for r in rows}
    sizes: dict = {}
    for sources, words in patterns.values():
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    order = sorted(sizes, key=lambda s: (s == "null", s))
    total = share * sum(w for _, w in patterns.values())
    target = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, total)
    quota = routed({p: w for p, w in patterns.values()}, {s: round(t) for s, t in target.items()})
    wanted = []
    for key, (sources, words) in patterns.items():
        need = sum(quota[sources].values())
        whole = min(USES, need // words) if words else 0
        wanted.append((key, int(whole), int(need - whole * words), sizes[sources[0]], float(target[sources[0]])))
    schema = "pattern string, whole long, rest long, source_size long, target double"
    plan = stored(spark.createDataFrame(wanted, schema), "patterns")
    return sized, *_border(sized, plan)
