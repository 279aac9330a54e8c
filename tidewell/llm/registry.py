"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe_tree, exact_dedup, jaccard_join, langid, lattice, licenses, line_dedup, packing, pieces, resampling, token_files, warc, whitening

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_language_id": langid.op2_language_id,
    "op3_token_files": token_files.op3_token_files,
    "op4_warc": warc.op4_warc,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_byte_bpe": bpe_tree.op6_byte_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_lattice_near_dedup": lattice.op9_lattice_near_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_sentence_pieces": pieces.op13_sentence_pieces,
    "lattice_near_documents": lattice.near_documents,
}
ORACLE_SQL = {
    "op4_warc": warc.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_lattice_near_dedup": lattice.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "lattice_near_documents": lattice.NEAR_DOCUMENTS,
}
