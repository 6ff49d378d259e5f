"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from sondera.llm.collocations import OP12_SQL, op12_collocations
from sondera.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from sondera.llm.html_text import op9_html_text
from sondera.llm.language_id import op10_language_id
from sondera.llm.lexical import OP11_SQL, op11_lexical_search
from sondera.llm.media import op5_media_copies
from sondera.llm.mixing import op6_mixing
from sondera.llm.secret_scan import op1_secret_scan
from sondera.llm.sentencepiece_codec import op7_sentencepiece
from sondera.llm.sharding import op13_sharding
from sondera.llm.simhash import op8_simhash
from sondera.llm.toxicity import op2_toxicity
from sondera.llm.url_filter import op4_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_media_copies": op5_media_copies,
    "op6_mixing": op6_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_sharding": op13_sharding,
}
SQL = {"op3_exact_dedup": OP3_SQL, "op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL}
