"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from codelore.plans.registry import collect

QUERIES, ORACLES = collect(
    [
        "codelore.llm.toxicity",
        "codelore.llm.byte_bpe",
        "codelore.llm.chat",
        "codelore.llm.decontaminate",
        "codelore.llm.language_id",
        "codelore.llm.licenses",
        "codelore.llm.pii",
        "codelore.llm.simhash",
        "codelore.llm.token_counts",
        "codelore.llm.topk",
    ]
)
