"""The queries of this subpackage, by name."""

from __future__ import annotations

from tallyforge.llm import chatformat, crosstokens, decontam, exactdedup, langid, linededup, mixing, pipeline, quality_model, quality_rules, simhash, suffixdedup, tokencount, vectorcodes
from tallyforge.plans.registry import Registry

REGISTRY = Registry()
REGISTRY.query("op1_decontamination", decontam.ORACLE)(decontam.op1_decontamination)
REGISTRY.query("op2_language_id")(langid.op2_language_id)
REGISTRY.query("op3_chat_format", chatformat.ORACLE)(chatformat.op3_chat_format)
REGISTRY.query("op4_line_dedup", linededup.ORACLE)(linededup.op4_line_dedup)
REGISTRY.query("op5_suffix_dedup")(suffixdedup.op5_suffix_dedup)
REGISTRY.query("op6_simhash")(simhash.op6_simhash)
REGISTRY.query("op7_quality_model")(quality_model.op7_quality_model)
REGISTRY.query("op8_mixing")(mixing.op8_mixing)
REGISTRY.query("op9_token_counts")(tokencount.op9_token_counts)
REGISTRY.query("op10_quality_rules", quality_rules.ORACLE)(quality_rules.op10_quality_rules)
REGISTRY.query("op11_vector_codes")(vectorcodes.op11_vector_codes)
REGISTRY.query("op12_token_alignment")(crosstokens.op12_token_alignment)
REGISTRY.query("op13_exact_dedup", exactdedup.ORACLE)(exactdedup.op13_exact_dedup)
REGISTRY.query("pipeline", pipeline.ORACLE_SQL)(pipeline.run)
