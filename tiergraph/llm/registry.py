"""The queries of the corpus operators and their SQL."""

from tiergraph.llm import (
    decontaminate,
    line_dedup,
    lm_scoring,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_nbest,
    substring_dedup,
    toxicity,
)

_MODULES = [
    quality_rules,
    ngram_jaccard,
    quality_classifier,
    lm_scoring,
    substring_dedup,
    toxicity,
    sentencepiece_nbest,
    secret_scan,
    line_dedup,
    decontaminate,
]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
