"""Registered queries of the subpackage: name → (query(spark, sf_dir), SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from postloom.llm import chat, exact_dedup, jaccard, language, lattice, lm, mixing, pieces, repair, repeats, search, secrets, toxicity

QUERIES = {
    "op1_language": (language.op1_language, None),
    "op2_embeddings": (lattice.op2_embeddings, lattice.ORACLE),
    "op3_secrets": (secrets.op3_secrets, None),
    "op4_jaccard": (jaccard.op4_jaccard, jaccard.ORACLE),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_pieces": (pieces.op6_pieces, None),
    "op7_exact_dedup": (exact_dedup.op7_exact_dedup, exact_dedup.ORACLE),
    "op8_lm": (lm.op8_lm, None),
    "op9_mixing": (mixing.op9_mixing, mixing.ORACLE),
    "op10_chat": (chat.op10_chat, chat.ORACLE),
    "op11_repair": (repair.op11_repair, repair.ORACLE),
    "op12_search": (search.op12_search, search.ORACLE),
    "op13_repeats": (repeats.op13_repeats, repeats.ORACLE),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
