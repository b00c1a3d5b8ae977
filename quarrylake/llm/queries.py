"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from . import embeddings, filteraudit, fingerprint, langid, linededup, minhash, packing, pieces, secrets, spelling, substring, tokenshards, urlfilter

_MODULES = {
    "op1_packing": packing,
    "op2_language": langid,
    "op3_minhash": minhash,
    "op4_line_dedup": linededup,
    "op5_url_filter": urlfilter,
    "op6_substring_dedup": substring,
    "op7_fingerprint": fingerprint,
    "op8_token_shards": tokenshards,
    "op9_sentence_pieces": pieces,
    "op10_embedding_dedup": embeddings,
    "op11_secret_scan": secrets,
    "op12_spelling_variants": spelling,
    "op13_filter_audit": filteraudit,
}
QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLES = {name: m.ORACLE for name, m in _MODULES.items() if m.ORACLE}
