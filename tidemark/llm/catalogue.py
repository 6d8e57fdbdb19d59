"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.ann import op4_ann
from tidemark.llm.bpe import op6_bpe
from tidemark.llm.media import op7_media
from tidemark.llm.mixing import op1_mixing
from tidemark.llm.ngram_join import ORACLE_OP5, op5_ngram_join
from tidemark.llm.pii import op2_pii
from tidemark.llm.shards import op10_shards
from tidemark.llm.substrings import ORACLE_OP3, op3_substrings
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.urls import op9_urls

QUERIES: dict = {f.__name__: f for f in (op1_mixing, op2_pii, op3_substrings, op4_ann, op5_ngram_join, op6_bpe, op7_media, op8_toxicity, op9_urls, op10_shards)}
ORACLES: dict = {"op3_substrings": ORACLE_OP3, "op5_ngram_join": ORACLE_OP5}
