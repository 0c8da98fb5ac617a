"""The registered queries of the subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from wavestrata.llm.chat import OP4_SQL, op4_chat_formatting
from wavestrata.llm.fingerprint import op1_quartile_digest
from wavestrata.llm.jaccard_join import OP2_SQL, op2_ngram_jaccard
from wavestrata.llm.knn import OP10_SQL, op10_voronoi_top_k
from wavestrata.llm.license_scan import op8_license_scan
from wavestrata.llm.mixing import mixing_sql, op9_poisson_mixing
from wavestrata.llm.packing import op6_best_fit_packing
from wavestrata.llm.quality import op5_quality_classifier
from wavestrata.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from wavestrata.llm.url_filter import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_quartile_digest": op1_quartile_digest,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_url_filters": op3_url_filters,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_poisson_mixing": op9_poisson_mixing,
    "op10_voronoi_top_k": op10_voronoi_top_k,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_ngram_jaccard": OP2_SQL,
    "op3_url_filters": OP3_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_poisson_mixing": mixing_sql(),
    "op10_voronoi_top_k": OP10_SQL,
}
