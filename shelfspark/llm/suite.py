"""The registered queries of this subpackage."""

from shelfspark.llm import bpe, exact_dedup, jaccard_join, line_dedup, packing, perplexity, prefix_trie, quality_rules, secrets, substring_dedup, toxicity, warc, whitening  # noqa: F401
from shelfspark.llm.common import ORACLES, QUERIES  # noqa: F401
