"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from winnower.llm import embdedup, jpeg, langid, linededup, minhash, mixing, packing, pii, urlfilter, warc

QUERIES = {
    "op1_url_filter": urlfilter.op1_url_filter,
    "op2_pii": pii.op2_pii,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_minhash_dedup": minhash.op5_minhash_dedup,
    "op6_embedding_dedup": embdedup.op6_embedding_dedup,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_media": jpeg.op9_media,
    "op10_langid": langid.op10_langid,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": linededup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_embedding_dedup": embdedup.ORACLE,
    "op7_warc": warc.ORACLE,
}
