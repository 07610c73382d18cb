"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bestfit, bpe, fingerprints, langid, media, packing, periodic, secrets, simhash, tokenfiles, toxicity, trie, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_secrets": secrets.query,
    "op3_warc": warc.query,
    "op4_byte_bpe": bpe.query,
    "op5_simhash": simhash.query,
    "op6_packing": packing.query,
    "op7_token_files": tokenfiles.query,
    "op8_language_id": langid.query,
    "op9_media": media.query,
    "op10_fingerprints": fingerprints.query,
    "op11_best_fit": bestfit.query,
    "op12_prefix_trie": trie.query,
    "op13_periodic_runs": periodic.query,
}

ORACLE_SQL: dict[str, str] = {"op2_secrets": secrets.oracle_sql(), "op3_warc": warc.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_periodic_runs": periodic.ORACLE}
