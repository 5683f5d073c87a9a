"""The queries of this subpackage for the driver, with SQL where SQL can express them."""

from __future__ import annotations

import importlib

from ..session import ship
from . import oracles

#: query name -> module with query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_suffix_dedup": "suffixdedup",
    "op2_fingerprints": "fingerprint",
    "op3_url_filter": "urlfilter",
    "op4_decontaminate": "decontaminate",
    "op5_license_scan": "licensescan",
    "op6_minhash_neardup": "neardup",
    "op7_toxicity": "toxicity",
    "op8_hilbert_sharding": "sharding",
    "op9_token_counts": "tokencount",
    "op10_packing": "packing",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def _query(name: str):
    def run(spark, sf_dir: str):
        ship(spark)
        return _module(name).query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
