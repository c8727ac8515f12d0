"""Queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidelog.llm import decontamination, language_id, licenses, line_dedup, minhash, neighbours, pieces, toxicity, url_filter, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_language_id": language_id.op2_language_id,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_pieces": pieces.op4_pieces,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_neighbours": neighbours.op10_neighbours,
}

SQL = {
    "op1_minhash": minhash.OP1_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_warc_revisits": warc.OP7_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
}
