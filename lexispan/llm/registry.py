"""The queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from . import dartminhash, divergence, fmindex, imatch, mixing, packing, secrets, sstable, transducer, warc

QUERIES = {
    "op1_sorted_string_table": sstable.query,
    "op2_revisit_resolution": warc.query,
    "op3_imatch": imatch.query,
    "op4_dartminhash": dartminhash.query,
    "op5_distribution_divergence": divergence.query,
    "op6_fm_index": fmindex.query,
    "op7_minimum_bin_slack": packing.query,
    "op8_hierarchical_budgets": mixing.query,
    "op9_secret_structures": secrets.query,
    "op10_transducer_counts": transducer.query,
}

ORACLE_SQL = {
    "op2_revisit_resolution": warc.ORACLE,
    "op5_distribution_divergence": divergence.ORACLE,
    "op8_hierarchical_budgets": mixing.ORACLE,
}
