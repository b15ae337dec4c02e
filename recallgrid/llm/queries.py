"""The queries of this subpackage: name, function of (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers

from recallgrid.llm import (
    infill,
    language,
    lines,
    mixing,
    neighbours,
    pieces,
    pii,
    rules,
    signatures,
    simhash,
    token_counts,
    toxicity,
    whitening,
)
from recallgrid.llm.common import table


def op1_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeated_units(spark, sf_dir):
    return lines.repeated_units(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_piece_segmentation(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_counts(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path)


def op8_language(spark, sf_dir):
    evidence = language.page_evidence(table(spark, sf_dir, "pages"))
    return language.identify(table(spark, sf_dir, "documents"), evidence)


def op9_quality_votes(spark, sf_dir):
    return rules.quality(table(spark, sf_dir, "documents"))


def op10_nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.filter("vec_id % 100 = 0"), vectors)


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_ngram_jaccard(spark, sf_dir):
    return signatures.similar_sets(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    return infill.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_personal_data,
        op2_source_mix,
        op3_simhash_groups,
        op4_repeated_units,
        op5_toxicity,
        op6_piece_segmentation,
        op7_token_counts,
        op8_language,
        op9_quality_votes,
        op10_nearest_vectors,
        op11_embedding_whitening,
        op12_ngram_jaccard,
        op13_fill_in_middle,
    )
}
#: The other operators are not expressible in SQL as a whole; tests hold them against brute force.
ORACLES: dict[str, str] = {"op13_fill_in_middle": infill.ORACLE}
