"""The queries of this package and their SQL."""

from __future__ import annotations

from . import alignment, brown, chat, decontamination, fingerprints, languages, lexical, licenses, ngram_join, pieces, pii, suffixes, urls

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_licenses": licenses.op4_licenses,
    "op5_urls": urls.op5_urls,
    "op6_chat": chat.op6_chat,
    "op7_pieces": pieces.op7_pieces,
    "op8_brown": brown.op8_brown,
    "op9_pii": pii.op9_pii,
    "op10_languages": languages.op10_languages,
    "op11_suffix_dedup": suffixes.op11_suffix_dedup,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_alignment": alignment.op13_alignment,
}
SQL = {"op6_chat": chat.OP6_SQL, "op12_lexical_search": lexical.OP12_SQL}
