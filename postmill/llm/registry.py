"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from postmill.llm import op1_pii_pseudonyms as op1
from postmill.llm import op2_kneser_ney as op2
from postmill.llm import op3_minhash_dedup as op3
from postmill.llm import op4_lm_scoring as op4
from postmill.llm import op5_quality_rules as op5
from postmill.llm import op6_byte_bpe as op6
from postmill.llm import op7_suffix_dedup as op7
from postmill.llm import op8_decontamination as op8
from postmill.llm import op9_training_order as op9
from postmill.llm import op10_secret_scan as op10
from postmill.llm import op11_fill_in_middle as op11
from postmill.llm import op12_source_divergence as op12
from postmill.llm import op13_url_filter as op13

QUERIES = {
    "op1_pii_pseudonyms": op1.query,
    "op2_kneser_ney": op2.query,
    "op3_minhash_dedup": op3.query,
    "op4_lm_scoring": op4.query,
    "op5_quality_rules": op5.query,
    "op6_byte_bpe": op6.query,
    "op7_suffix_dedup": op7.query,
    "op8_decontamination": op8.query,
    "op9_training_order": op9.query,
    "op10_secret_scan": op10.query,
    "op11_fill_in_middle": op11.query,
    "op12_source_divergence": op12.query,
    "op13_url_filter": op13.query,
}

#: Where SQL can express a whole query; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_minhash_dedup": op3.SQL,
    "op5_quality_rules": op5.SQL,
    "op11_fill_in_middle": op11.SQL,
    "op12_source_divergence": op12.SQL,
    "op13_url_filter": op13.SQL,
}
