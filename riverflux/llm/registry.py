"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from riverflux.llm import decontaminate, extract, language, lm_score, mixing, quality, quotes, repair, simhash, toxicity, url_cascade, vector_codes, vector_graph

QUERIES = {
    "op1_vector_graph": vector_graph.op1_vector_graph,
    "op2_winnowing": decontaminate.op2_winnowing,
    "op3_quote_links": quotes.op3_quote_links,
    "op4_rank_profiles": language.op4_rank_profiles,
    "op5_pareto_mix": mixing.op5_pareto_mix,
    "op6_min_cut": extract.op6_min_cut,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_gru_score": lm_score.op9_gru_score,
    "op10_url_cascade": url_cascade.op10_url_cascade,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_quality_cascade": quality.op12_quality_cascade,
    "op13_min_plus_repair": repair.op13_min_plus_repair,
}

ORACLE_SQL = {
    "op1_vector_graph": vector_graph.OP1_SQL,
    "op2_winnowing": decontaminate.OP2_SQL,
    "op5_pareto_mix": mixing.OP5_SQL,
    "op10_url_cascade": url_cascade.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_quality_cascade": quality.OP12_SQL,
    "op13_min_plus_repair": repair.OP13_SQL,
}
