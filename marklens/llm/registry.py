"""The operators' registered queries, and the SQL of those that SQL can express."""

from .decontaminate import op7_decontaminate
from .feistel import op5_feistel
from .html_text import op1_main_text
from .pair_bitmaps import op13_pair_bitmaps
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_cascade import OP6_SQL, op6_quality
from .radix import OP12_SQL, op12_radix
from .rlz import OP10_SQL, op10_rlz
from .secrets import op3_secrets
from .sentencepiece_bpe import op4_sentencepiece
from .simhash import op2_simhash
from .site_quality import op8_site_quality
from .token_counts import op9_token_counts

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_feistel": op5_feistel,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_site_quality": op8_site_quality,
    "op9_token_counts": op9_token_counts,
    "op10_rlz": op10_rlz,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_radix": op12_radix,
    "op13_pair_bitmaps": op13_pair_bitmaps,
}

ORACLES: dict[str, str] = {
    "op6_quality": OP6_SQL,
    "op10_rlz": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_radix": OP12_SQL,
}
