"""Every query of this folder."""

import corpus_pipeline

from . import (  # noqa: F401
    q_alignment, q_bpe, q_collocations, q_decontaminate, q_lines, q_minhash, q_mixing, q_pii, q_quality, q_secrets, q_substrings, q_topk, q_toxicity,
)
from .registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
