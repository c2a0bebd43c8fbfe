"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from turnlake.llm.bpe_codec import op9_bpe_codec
from turnlake.llm.chain_dedup import op6_chain_dedup
from turnlake.llm.hnsw_dedup import OP10_SQL, op10_hnsw_dedup
from turnlake.llm.nn_descent import op2_nn_descent
from turnlake.llm.phrase_mine import OP12_SQL, op12_phrase_mine
from turnlake.llm.pii_transducer import op8_pii_transducer
from turnlake.llm.quality_crf import op3_quality_crf
from turnlake.llm.secret_scan import op4_secret_scan
from turnlake.llm.simhash_dedup import op1_simhash_dedup
from turnlake.llm.source_mix import op5_source_mix
from turnlake.llm.token_align import op11_token_align
from turnlake.llm.url_templates import op7_url_templates
from turnlake.llm.warc_zip import OP13_SQL, op13_warc_zip

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_nn_descent": op2_nn_descent,
    "op3_quality_crf": op3_quality_crf,
    "op4_secret_scan": op4_secret_scan,
    "op5_source_mix": op5_source_mix,
    "op6_chain_dedup": op6_chain_dedup,
    "op7_url_templates": op7_url_templates,
    "op8_pii_transducer": op8_pii_transducer,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_hnsw_dedup": op10_hnsw_dedup,
    "op11_token_align": op11_token_align,
    "op12_phrase_mine": op12_phrase_mine,
    "op13_warc_zip": op13_warc_zip,
}

#: The others hash by XXH64, scan with look-around, permute, train or search approximately; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op10_hnsw_dedup": OP10_SQL, "op12_phrase_mine": OP12_SQL, "op13_warc_zip": OP13_SQL}
