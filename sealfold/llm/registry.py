"""Queries over whole tables, one for each operator, and DuckDB SQL where it can express them."""

from sealfold.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from sealfold.llm.fingerprints import op7_fingerprints
from sealfold.llm.minhash import op10_minhash
from sealfold.llm.nbest import op4_nbest
from sealfold.llm.packing import op3_packing
from sealfold.llm.perplexity import op5_quality
from sealfold.llm.pii import op1_pii
from sealfold.llm.token_counts import op2_token_counts
from sealfold.llm.toxicity import op6_toxicity

from sealfold.llm.warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_token_counts, op3_packing, op4_nbest, op5_quality, op6_toxicity, op7_fingerprints, op8_exact_dedup, op9_warc, op10_minhash)}
SQL = {"op8_exact_dedup": OP8_SQL, "op9_warc": OP9_SQL}
