"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import embedding_join, hard_negatives, lexical_search
from .embedding_join import op2_embedding_near_dedup
from .hard_negatives import op13_hard_negatives
from .language_id import op4_language_id
from .lexical_search import op11_lexical_search
from .licenses import op3_license_scans
from .packing import op8_packing
from .pii import op5_pii
from .quality_crf import op10_quality_classifier
from .quality_rules import op1_quality_rules
from .secrets import op6_secret_scans
from .sharding import op12_sharding
from .simhash import op7_simhash
from .word_bpe import op9_word_bpe

QUERIES: dict = {
    "op1_quality_rules": op1_quality_rules,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_license_scans": op3_license_scans,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_secret_scans": op6_secret_scans,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_word_bpe": op9_word_bpe,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_lexical_search": op11_lexical_search,
    "op12_sharding": op12_sharding,
    "op13_hard_negatives": op13_hard_negatives,
}
#: The other operators learn models, tokenise or sketch, which SQL does not express; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": embedding_join.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
