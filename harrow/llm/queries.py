"""All registered queries of the corpus operators."""

from harrow.llm import (  # noqa: F401  (register)
    chosen_path, curriculum, decontaminate, language, nn_descent, periodic, pieces_bpe, quality, sharding,
    token_counts, toxicity, url_lists, whitening)
from harrow.llm.registry import ORACLES, QUERIES  # noqa: F401
