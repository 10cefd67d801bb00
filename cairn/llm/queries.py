"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that holds it.
NAMES = {
    "op1_segment_edit_join": "line_dedup",
    "op2_candidate_boosting": "pii",
    "op3_bpe_codec": "bpe",
    "op4_nn_descent": "nn_descent",
    "op5_lexicon_automata": "toxicity",
    "op6_min_bin_slack": "packing",
    "op7_page_differencing": "html_extract",
    "op8_cover_suffix_dedup": "suffix_dedup",
    "op9_token_group_join": "ngram_join",
    "op10_quality_rules": "quality",
}


def queries() -> dict:
    found = {}
    for name, module in NAMES.items():
        found[name] = getattr(import_module(f"{__package__}.{module}"), name)
    return found


#: Queries whose module holds their SQL.
WITH_SQL = ("op4_nn_descent", "op8_cover_suffix_dedup", "op9_token_group_join")


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{NAMES[name]}").ORACLE for name in WITH_SQL}
