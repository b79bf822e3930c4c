"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from tidelog.llm.boosted_quality import op10_quality_classifier
from tidelog.llm.language_id import op7_language_id
from tidelog.llm.mixing import op6_source_mixing
from tidelog.llm.ngram_join import op9_ngram_join
from tidelog.llm.oracles import ORACLE_SQL  # noqa: F401
from tidelog.llm.packing import op2_best_fit_packing
from tidelog.llm.quality_rules import op3_quality_rules
from tidelog.llm.substring_dedup import op1_substring_dedup
from tidelog.llm.url_filters import op4_url_filters
from tidelog.llm.vector_dedup import op5_vector_dedup
from tidelog.llm.warc import op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_best_fit_packing, op3_quality_rules, op4_url_filters, op5_vector_dedup, op6_source_mixing, op7_language_id, op8_warc, op9_ngram_join, op10_quality_classifier)
}
