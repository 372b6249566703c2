"""The queries of this subpackage by name, and their SQL twins where SQL can express them."""

from __future__ import annotations

from werkbank.llm.divergence import OP13_SQL, op13_source_divergence
from werkbank.llm.licenses import op9_licenses
from werkbank.llm.lines import op12_quality_rules
from werkbank.llm.mixing import op4_mixing
from werkbank.llm.neighbours import OP3_SQL, op3_embeddings
from werkbank.llm.quality import op10_quality
from werkbank.llm.ranked import OP11_SQL, op11_ranked_search
from werkbank.llm.repeats import OP1_SQL, op1_suffix_array
from werkbank.llm.sentencepieces import op7_sentencepiece
from werkbank.llm.simhash import op6_simhash
from werkbank.llm.tokens import op2_tokens
from werkbank.llm.urls import op5_urls
from werkbank.llm.winnowing import op8_fingerprints

QUERIES = {"op1_suffix_array": op1_suffix_array, "op2_tokens": op2_tokens, "op3_embeddings": op3_embeddings,
           "op4_mixing": op4_mixing, "op5_urls": op5_urls, "op6_simhash": op6_simhash, "op7_sentencepiece": op7_sentencepiece, "op8_fingerprints": op8_fingerprints,
           "op9_licenses": op9_licenses, "op10_quality": op10_quality,
           "op11_ranked_search": op11_ranked_search, "op12_quality_rules": op12_quality_rules,
           "op13_source_divergence": op13_source_divergence}

ORACLE: dict[str, str] = {"op1_suffix_array": OP1_SQL, "op3_embeddings": OP3_SQL, "op11_ranked_search": OP11_SQL,
                          "op13_source_divergence": OP13_SQL}
