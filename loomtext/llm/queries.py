"""The training-data queries and their SQL."""

from __future__ import annotations

from loomtext.llm.bpe import op4_bpe
from loomtext.llm.embedding_dedup import OP8_SQL, op8_embedding_dedup
from loomtext.llm.html_extract import op10_html_extraction
from loomtext.llm.language_id import op3_language_id
from loomtext.llm.minhash import OP5_SQL, op5_minhash
from loomtext.llm.packing import op2_packing
from loomtext.llm.pii import op6_pii
from loomtext.llm.sharding import OP9_SQL, op9_rendezvous_sharding
from loomtext.llm.topk import OP1_SQL, op1_topk
from loomtext.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_topk, op2_packing, op3_language_id, op4_bpe, op5_minhash, op6_pii, op7_toxicity, op8_embedding_dedup, op9_rendezvous_sharding, op10_html_extraction)}
ORACLE_SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op5_minhash": OP5_SQL, "op8_embedding_dedup": OP8_SQL, "op9_rendezvous_sharding": OP9_SQL}
