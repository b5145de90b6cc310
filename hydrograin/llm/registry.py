"""The queries of this subpackage and their SQL."""

from . import bpe, decontaminate, langid, phrases, pii, prefixtrie, quality, repeats, secrets, simhash, tokenbin, toxicity, warc

_MODULES = (bpe, decontaminate, langid, phrases, pii, prefixtrie, quality, repeats, secrets, simhash, tokenbin, toxicity, warc)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
