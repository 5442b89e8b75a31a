"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: the module that defines a function of that name.
MODULES = {
    "op1_best_fit_packing": "packing",
    "op10_secret_scan": "secrets",
    "op11_embedding_near_dedup": "vector_dedup",
    "op12_source_divergence": "divergence",
    "op13_conversation_repair": "conversations",
    "op2_license_scan": "licenses",
    "op3_benchmark_decontamination": "decontamination",
    "op4_sharding": "sharding",
    "op5_quality_rules": "quality_rules",
    "op6_hmm_scores": "hmm",
    "op7_token_files": "token_files",
    "op8_quality_classifier": "quality_classifier",
    "op9_simhash_near_dedup": "simhash",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Only where DuckDB has the functions: crc32, XXH64, tokenizers, compression and training are beyond it."""
    return {"op12_source_divergence": import_module(f"{__package__}.divergence").ORACLE_SQL}
