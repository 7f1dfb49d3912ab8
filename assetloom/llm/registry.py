"""Queries of the training-data operators."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe_transducer import op10_transducer_bpe
from .class_lm import op2_class_lm
from .fm_dedup import OP6_SQL, op6_fm_dedup
from .jpeg_media import op8_baseline_jpeg
from .language_id import op5_language_fusion, pages_language
from .merkle import OP13_SQL, op13_merkle
from .packing import op9_best_fit
from .partenum import op3_partenum
from .quality import op12_quality_trees
from .simhash import op7_simhash
from .token_attribution import op1_token_attribution
from .url_trust import op4_url_trust


def queries():
    return {
        "op1_token_attribution": op1_token_attribution,
        "op2_class_lm": op2_class_lm,
        "op3_partenum": op3_partenum,
        "op4_url_trust": op4_url_trust,
        "op5_language_fusion": op5_language_fusion,
        "op6_fm_dedup": op6_fm_dedup,
        "op7_simhash": op7_simhash,
        "op8_baseline_jpeg": op8_baseline_jpeg,
        "op9_best_fit": op9_best_fit,
        "op10_transducer_bpe": op10_transducer_bpe,
        "op11_alignment": op11_alignment,
        "op12_quality_trees": op12_quality_trees,
        "op13_merkle": op13_merkle,
        "pages_language": pages_language,
    }


def oracle_sql():
    return {"op6_fm_dedup": OP6_SQL, "op13_merkle": OP13_SQL}
