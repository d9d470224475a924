"""The query of each corpus operator, and its SQL where SQL can express it."""

from tidemark.llm.bpe import op2_bpe_round_trip
from tidemark.llm.embeddings import OP7_SQL, op7_embedding_near_dedup
from tidemark.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from tidemark.llm.jaccard import OP10_SQL, op10_ngram_jaccard_join
from tidemark.llm.packing import op6_packing
from tidemark.llm.pii import op4_pii
from tidemark.llm.search import OP13_SQL, op13_ranked_search
from tidemark.llm.sharding import op12_hilbert_sharding
from tidemark.llm.substrings import OP8_SQL, op8_substring_dedup
from tidemark.llm.token_counts import op5_token_counts
from tidemark.llm.token_output import op3_token_output
from tidemark.llm.toxicity import op1_toxicity
from tidemark.llm.turns import op11_conversation_repair

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_token_output": op3_token_output,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hilbert_sharding": op12_hilbert_sharding,
    "op13_ranked_search": op13_ranked_search,
}
SQL = {
    "op7_embedding_near_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_ngram_jaccard_join": OP10_SQL,
    "op13_ranked_search": OP13_SQL,
}
