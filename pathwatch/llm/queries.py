"""Queries of the training-data operators, with their SQL twins where SQL can express them."""

from pathwatch.llm import pii, secrets
from pathwatch.llm.bpe import op9_bpe_encode_decode
from pathwatch.llm.clusters import OP12_SQL, op12_centroid_clusters
from pathwatch.llm.decontaminate import OP10_SQL, op10_decontamination
from pathwatch.llm.language import op2_language_id
from pathwatch.llm.neighbours import op5_nearest_neighbours
from pathwatch.llm.pii import op1_pii
from pathwatch.llm.prefixes import OP11_SQL, op11_conversation_prefixes
from pathwatch.llm.secrets import op4_secret_scan
from pathwatch.llm.simhash import op3_simhash_near_dedup
from pathwatch.llm.suffixes import op7_suffix_dedup
from pathwatch.llm.token_counts import op8_token_counts
from pathwatch.llm.toxicity import op6_toxicity
from pathwatch.llm.urls import OP13_SQL, op13_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_encode_decode": op9_bpe_encode_decode,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_prefixes": op11_conversation_prefixes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_url_filter": op13_url_filter,
    # the columns of op1 and op4 that SQL can express
    "pii_base_columns": pii.base_columns,
    "secret_base_columns": secrets.base_columns,
}
ORACLES: dict[str, str] = {"op10_decontamination": OP10_SQL, "op11_conversation_prefixes": OP11_SQL, "op12_centroid_clusters": OP12_SQL, "op13_url_filter": OP13_SQL, "pii_base_columns": pii.BASE_SQL, "secret_base_columns": secrets.BASE_SQL}
