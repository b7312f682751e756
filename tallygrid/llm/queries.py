"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallygrid.llm import decontam, linededup, minhash, topk, trie
from tallygrid.llm.bpe import op5_bpe
from tallygrid.llm.cws import op10_weighted_sampling
from tallygrid.llm.decontam import op8_decontamination
from tallygrid.llm.html import op1_html
from tallygrid.llm.langid import op2_language
from tallygrid.llm.linededup import op6_line_dedup
from tallygrid.llm.lm import op7_language_model
from tallygrid.llm.minhash import op3_minhash
from tallygrid.llm.quality import op4_quality
from tallygrid.llm.topk import op12_topk
from tallygrid.llm.toxicity import op9_toxicity
from tallygrid.llm.trie import op11_prefix_trie
from tallygrid.llm.whitening import op13_whitening

QUERIES = {
    "op1_html": op1_html,
    "op2_language": op2_language,
    "op3_minhash": op3_minhash,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_model": op7_language_model,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_weighted_sampling": op10_weighted_sampling,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_topk": op12_topk,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op3_minhash": minhash.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_topk": topk.ORACLE,
}
