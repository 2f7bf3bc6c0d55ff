"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from factloom.llm.bpe_transducer import op6_bpe_transducer
from factloom.llm.cap_filters import op8_cap_filters
from factloom.llm.imatch import op7_imatch
from factloom.llm.language_id import op4_language_id
from factloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from factloom.llm.packing import op10_packing
from factloom.llm.pii import op3_pii
from factloom.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from factloom.llm.shingle_join import op1_shingle_join
from factloom.llm.site_style import op2_site_style
from factloom.llm.source_audit import OP11_SQL, op11_source_audit
from factloom.llm.substring_dedup import OP13_SQL, op13_substring_dedup
from factloom.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_shingle_join, op2_site_style, op3_pii, op4_language_id, op5_toxicity, op6_bpe_transducer, op7_imatch, op8_cap_filters,
        op9_line_dedup, op10_packing, op11_source_audit, op12_prefix_trie, op13_substring_dedup,
    )
}
#: Models, tokenizers and similarity joins are beyond SQL; their tests hold them against brute force.
ORACLE_SQL = {"op9_line_dedup": OP9_SQL, "op11_source_audit": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_substring_dedup": OP13_SQL}
