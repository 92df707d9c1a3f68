"""The dealt operators' queries, one per operator, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from riskflow.llm.cross_polytope import OP2_SQL, op2_cross_polytope
from riskflow.llm.iblt import op1_paragraph_iblt
from riskflow.llm.langid import op3_language_id
from riskflow.llm.licenses import op6_license_diagonals
from riskflow.llm.lexical import OP13_SQL, op13_block_max
from riskflow.llm.line_rules import OP11_SQL, op11_line_rules
from riskflow.llm.merkle import OP12_SQL, op12_bitmap_rank
from riskflow.llm.minhash import OP10_SQL, op10_minhash_near_dedup
from riskflow.llm.packing import op7_best_fit_packing
from riskflow.llm.pii import op5_pii_boosting
from riskflow.llm.piece_scan import op9_piece_scan
from riskflow.llm.record_files import op4_record_files
from riskflow.llm.toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (
    op1_paragraph_iblt, op2_cross_polytope, op3_language_id, op4_record_files, op5_pii_boosting, op6_license_diagonals, op7_best_fit_packing, op10_minhash_near_dedup, op8_toxicity, op9_piece_scan,
    op11_line_rules, op12_bitmap_rank, op13_block_max,
)}

ORACLE_SQL: dict[str, str] = {"op2_cross_polytope": OP2_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_line_rules": OP11_SQL, "op12_bitmap_rank": OP12_SQL, "op13_block_max": OP13_SQL}
