"""The subpackage's queries and their SQL, by name."""

from corpusflow.llm import chat, exact_dedup, jaccard, licenses, neighbours, packing, segmentation, sharding, token_counts, toxicity

_MODULES = (chat, neighbours, jaccard, licenses, sharding, segmentation, packing, token_counts, toxicity, exact_dedup)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
