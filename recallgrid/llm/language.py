"""Language identification by fusing text, declared markup and host evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches, give_back, texts
from recallgrid.sources.storage import stored

#: Hash slots of byte trigrams.
TRIGRAMS = 1 << 15
#: Trigrams for each slot that a language takes from a uniform share, and as many from all labelled documents.
SMOOTHED = 0.25
#: Trigrams of a text are no independent evidence: they weigh as much as so many.
WEIGHED = 60
#: Pseudo-documents that each level of the address hierarchy takes from the one above it.
STRENGTH = 20.0
UNKNOWN = "und"

# Bytes: ASCII letters in lower case, other letters as they are, a blank for the rest.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_slots(data: bytes) -> np.ndarray:
    """Hash slots of the byte trigrams of a text that hold at most one blank."""
    b = np.frombuffer(b" " + data.translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    blank = b == 32
    few = (blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:]) <= 1
    return ((codes[few] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)


def _counted(index: dict[str, int]):
    schema = pa.schema([("language", pa.int32()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), TRIGRAMS), np.int64)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if name in index:
                    for at in range(0, len(data), 1 << 22):
                        total[index[name]] += np.bincount(trigram_slots(data[at : at + (1 << 22)]), minlength=TRIGRAMS)
        for i, row in enumerate(total):
            seen = np.flatnonzero(row)
            yield batch_of(schema, [np.full(len(seen), i, np.int32), seen.astype(np.int32), row[seen]])

    return run


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probability of each trigram slot in each (last row: none of them).

    Counts cover every labelled document's whole text, and every label is a
    candidate, however few its documents; what reaches the driver is bounded
    by languages x TRIGRAMS.
    """
    bounded_batches(docs.sparkSession)
    seen = docs.filter("lang is not null").select("lang").distinct().collect()
    names = sorted(r.lang for r in seen)
    total = np.zeros((len(names) + 1, TRIGRAMS))
    if names:
        index = {n: i for i, n in enumerate(names)}
        rows = docs.select("lang", "text").mapInArrow(_counted(index), "language int, slot int, n long")
        rows = rows.groupBy("language", "slot").agg(F.sum("n").alias("n")).toArrow()
        total[rows.column("language").to_numpy(), rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    shared = total.sum(0)
    total += SMOOTHED + SMOOTHED * TRIGRAMS * shared / max(shared.sum(), 1.0)
    total[-1] = 1.0
    return [*names, UNKNOWN], np.log(total / total.sum(1, keepdims=True))


def _scored(tables):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("text_hash", pa.int64()), ("n_trigrams", pa.int64()), ("text_scores", pa.list_(pa.float64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        for batch in batches:
            counts, scores = [], []
            for data in texts(batch, "text"):
                total, n = np.zeros(len(held)), 0
                for at in range(0, len(data), 1 << 22):
                    s = trigram_slots(data[at : at + (1 << 22)])
                    total += [row[s].sum() for row in held]
                    n += len(s)
                counts.append(n)
                scores.append((total / max(n, 1) * min(n, WEIGHED)).tolist())
            yield batch_of(schema, [batch.column(0), batch.column(1), batch.column(2), counts, scores])
        give_back()

    return run


def page_evidence(pages: DataFrame) -> DataFrame:
    """Declared language, host, domain and suffix of the pages of each document that their paths name.

    pages: page_id, url, html. The document number stands behind the language
    folder of the path. A page without one gives no evidence. One row for
    each document, host and declaration, with the number of its pages.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    document = F.regexp_extract("url", r"^[^:]+://[^/]+/[^/?#]+/([0-9]{1,18})(?:[^0-9].*)?$", 1)
    declared = F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]+)""", 1))
    rows = pages.select(
        F.when(document != "", document.cast("long")).alias("doc_id"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(declared, F.lit("")).alias("declared"),
    ).filter("doc_id is not null")
    rows = rows.groupBy("doc_id", "host", "declared").agg(F.count(F.lit(1)).alias("n_pages"))
    return rows.select(
        "doc_id",
        "declared",
        "host",
        F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        "n_pages",
    )


def _votes(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """How many documents of each key have each language by their text alone; one on several hosts counts by share."""
    counts = [F.sum(F.when(F.col("text_language") == i, F.col("share")).otherwise(0.0)) for i in range(n)]
    return rows.groupBy(*keys).agg(F.array(*counts).alias("votes"))


def _smoothed(votes: Column, above: Column) -> Column:
    """Share of each language at a level, with STRENGTH documents of the level above."""
    total = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(votes, above, lambda v, p: (v + STRENGTH * p) / (total + STRENGTH))


def identify(docs: DataFrame, evidence: DataFrame | None = None, least_posterior: float = 0.5) -> DataFrame:
    """Language of each document and whether it is kept.

    docs: doc_id long, text, lang (label, may be null), source; evidence (see
    page_evidence): doc_id, declared, host, domain, suffix, n_pages, any
    number of rows for a document, each of which counts by its share of the
    document's pages. Naive Bayes over
    byte trigrams gives the text likelihood of each language and of "und", a
    uniform stand-in for none of them. Grouped aggregation of the text-only
    answers gives the share of languages over all documents, by suffix,
    domain and host, each level smoothed by the one above (a document's own
    vote is left out); documents without an address take their source as
    host. What a page declares counts by how often documents of a language
    declare it. The posterior is the product, normalised. kept: it is not
    "und" and reaches least_posterior; without any labelled document nothing
    can be told, and every text with letters is kept as "und".

    Null or empty text, or one without letters: text says nothing, language
    "und" unless address and markup decide; never kept. Null lang: no
    training. Repeated rows: one row each. Empty table: no rows. Repeated
    evidence rows of a document count one by one. A very long text is scored
    in pieces. text_hash (xxhash64 of the text) tells rows of one doc_id
    apart; host and declared are those of most pages (then the smallest).
    """
    spark = docs.sparkSession
    names, tables = text_model(docs)
    sent, n = spark.sparkContext.broadcast(tables.astype(np.float32)), len(names)
    read = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), "text")
    scored = read.mapInArrow(_scored(sent), "doc_id long, source string, text_hash long, n_trigrams long, text_scores array<double>")
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    best = F.array_position("text_scores", F.array_max("text_scores")) - 1
    scored = stored(scored.withColumn("text_language", F.when(F.col("n_trigrams") > 0, best).cast("int")), "scores")
    sent.destroy()
    of_row = scored.select("row", "doc_id", "source", "text_language")
    if evidence is None:
        found = of_row.withColumns({c: F.lit(None).cast("string") for c in ("declared", "host", "domain", "suffix")})
        found = found.withColumns({"n_pages": F.lit(1), "share": F.lit(1.0)})
    else:
        told = evidence.select("doc_id", "declared", "host", "domain", "suffix", "n_pages")
        pages = told.groupBy("doc_id").agg(F.sum("n_pages").alias("all_pages"))
        told = stored(told.join(pages, "doc_id").withColumn("share", F.col("n_pages") / F.col("all_pages")).drop("all_pages"), "evidence")
        found = of_row.join(told, "doc_id", "left").na.fill(1.0, ["share"]).na.fill(1, ["n_pages"])
    own = F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))
    found = found.withColumns(
        {"host": F.coalesce("host", own), "domain": F.coalesce("domain", F.lit("")), "suffix": F.coalesce("suffix", F.lit(""))}
    )
    # Levels: all documents, suffix, domain, host.
    hosts = stored(_votes(found, ["host", "domain", "suffix"], n), "hosts")
    add = F.array(*[F.sum(F.col("votes")[i]).alias(str(i)) for i in range(n)])
    top = hosts.agg(add.alias("v")).first()
    counts = np.array([x or 0.0 for x in top.v], float) + 1.0
    counts[-1] = 0.01 * counts.sum()
    whole = F.array(*[F.lit(float(x)) for x in counts / counts.sum()])
    suffixes = hosts.groupBy("suffix").agg(add.alias("v")).select("suffix", _smoothed(F.col("v"), whole).alias("suffix_prior"))
    domains = hosts.groupBy("domain", "suffix").agg(add.alias("v")).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", _smoothed(F.col("v"), F.col("suffix_prior")).alias("domain_prior"))
    hosts = stored(hosts.join(domains, ["domain", "suffix"]), "hosts")
    # What pages declare, by the language of their text: at most languages x (languages + 2) rows.
    known = F.array(*[F.lit(x) for x in names[:-1]]) if n > 1 else F.array().cast("array<string>")
    said = F.when(F.array_contains(known, F.col("declared")), F.col("declared")).when(F.col("declared").isNotNull(), "other")
    confusion = found.filter("text_language is not null and declared is not null")
    confusion = confusion.groupBy("text_language", said.alias("said")).agg(F.sum("share").alias("count")).collect()
    words = [*names[:-1], "other"]
    table = np.full((n, len(words)), 0.5)
    for r in confusion:
        table[r.text_language, words.index(r.said)] += r["count"]
    table = np.log(table / table.sum(1, keepdims=True))
    declared = F.lit(None).cast("array<double>")
    for i, w in enumerate(words):
        declared = F.when(said == w, F.array(*[F.lit(float(x)) for x in table[:, i]])).otherwise(declared)
    nothing = F.array(*[F.lit(0.0)] * n)
    joined = found.join(hosts, ["host", "domain", "suffix"])
    others = F.transform("votes", lambda v, i: F.greatest(v - F.when(F.col("text_language") == i, F.col("share")).otherwise(0.0), F.lit(0.0)))
    joined = joined.withColumn("prior", _smoothed(others, F.col("domain_prior"))).withColumn(
        "told", F.zip_with(F.coalesce(declared, nothing), F.col("prior"), lambda a, p: a + F.log(p))
    )
    # A document's pages are no independent evidence: their terms are averaged.
    of_pages = F.struct(-F.col("n_pages"), "host", "declared")
    terms = joined.groupBy("row").agg(
        F.array(*[F.sum(F.col("share") * F.col("told")[i]) for i in range(n)]).alias("told"),
        F.min_by("host", of_pages).alias("host"),
        F.min_by("declared", of_pages).alias("declared"),
    )
    scores = scored.join(terms, "row").withColumn("sum", F.zip_with("text_scores", "told", lambda a, b: a + b))
    odds = scores.withColumn("odds", F.transform("sum", lambda x: F.exp(x - F.array_max("sum"))))
    at = F.array_position("sum", F.array_max("sum")).cast("int")
    posterior = 1.0 / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    name = F.element_at(F.array(*[F.lit(x) for x in names]), at)
    return odds.select(
        "doc_id",
        name.alias("language"),
        posterior.alias("posterior"),
        ((F.col("n_trigrams") > 0) & ((name != UNKNOWN) & (posterior >= least_posterior) if n > 1 else F.lit(True))).alias("kept"),
        F.when(F.col("text_language").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in names]), F.col("text_language") + 1)).alias("text_language"),
        "declared",
        "host",
        "text_hash",
    )
