"""The queries of this subpackage and their SQL, by name."""

from tessera.llm import bpe, fixity, line_dedup, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, resampling, secrets, topk_search, url_filter, vector_codes

_MODULES = (url_filter, near_dedup, topk_search, quality_rules, line_dedup, quality_classifier, bpe, packing, fixity, secrets, resampling, lm_scoring, vector_codes)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
