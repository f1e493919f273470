"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quirefold.llm import alignment, ann, binout, fingerprint, langid, mixing, ngramjoin, packing, periodic, pii, quality, tokencount, urlfilter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_pii": pii.op2_pii,
    "op3_ann": ann.op3_ann,
    "op4_quality": quality.op4_quality,
    "op5_tokencount": tokencount.op5_tokencount,
    "op6_langid": langid.op6_langid,
    "op7_packing": packing.op7_packing,
    "op8_binout": binout.op8_binout,
    "op9_ngramjoin": ngramjoin.op9_ngramjoin,
    "op10_fingerprint": fingerprint.op10_fingerprint,
    "op11_alignment": alignment.op11_alignment,
    "op12_periodic": periodic.op12_periodic,
    "op13_urlfilter": urlfilter.op13_urlfilter,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op9_ngramjoin": ngramjoin.OP9_SQL,
    "op13_urlfilter": urlfilter.OP13_SQL,
}
