"""The operators' queries and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import bpe, chat, linededup, lm, media, mixing, quality, sharding, simhash, warc


def queries() -> dict:
    return {"op1_lm": lm.op1_lm, "op2_chat": chat.op2_chat, "op3_media": media.op3_media, "op5_bpe": bpe.op5_bpe, "op7_warc": warc.op7_warc, "op4_sharding": sharding.op4_sharding, "op6_mixing": mixing.op6_mixing, "op8_simhash": simhash.op8_simhash, "op9_quality": quality.op9_quality, "op10_linededup": linededup.op10_linededup, "pipeline": corpus_pipeline.run}


def oracles() -> dict:
    return {"op2_chat": chat.ORACLE, "op4_sharding": sharding.ORACLE, "op7_warc": warc.ORACLE, "op10_linededup": linededup.ORACLE}
