"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from gneiss.llm import alignment, jaccard, langid, licences, lines, maintext, media, mixing, packing, repeats, spelling, surrogates, topk
from gneiss.llm.common import few_files


def tidy(query):
    return lambda spark, sf_dir: few_files(query(spark, sf_dir))


QUERIES = {
    name: tidy(query)
    for name, query in {
        "op1_langid": langid.op1_langid,
        "op2_surrogates": surrogates.op2_surrogates,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_media": media.op4_media,
        "op5_packing": packing.op5_packing,
        "op6_repeats": repeats.op6_repeats,
        "op7_topk": topk.op7_topk,
        "op8_mixing": mixing.op8_mixing,
        "op9_licences": licences.op9_licences,
        "op10_lines": lines.op10_lines,
        "op11_spelling": spelling.op11_spelling,
        "op12_maintext": maintext.op12_maintext,
        "op13_alignment": alignment.op13_alignment,
    }.items()
}

ORACLES = {
    "op3_jaccard": jaccard.ORACLE,
    "op6_repeats": repeats.ORACLE,
    "op7_topk": topk.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_lines": lines.ORACLE,
    "op11_spelling": spelling.ORACLE,
}
