"""The queries of this subpackage and their DuckDB forms, by name."""

from . import chat, decontamination, exact_dedup, importance, line_rules, mixing, near_dedup, packing, sharding, spelling, suffix_dedup, token_counts, toxicity

_MODULES = {
    "op1_exact_dedup": exact_dedup,
    "op2_near_dedup": near_dedup,
    "op3_mixing": mixing,
    "op4_line_rules": line_rules,
    "op5_chat": chat,
    "op6_toxicity": toxicity,
    "op7_sharding": sharding,
    "op8_token_counts": token_counts,
    "op9_packing": packing,
    "op10_suffix_dedup": suffix_dedup,
    "op11_decontamination": decontamination,
    "op12_importance": importance,
    "op13_spelling": spelling,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
