"""The queries of this package and, where SQL can state them, their SQL."""

from .decontaminate import op6_decontaminate
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .langid import op10_language_id
from .lm import op4_lm_score
from .secrets import OP9_SQL, op9_secret_scan
from .sentencepieces import op8_sentencepiece
from .simhash import op5_simhash_groups
from .substrings import OP3_SQL, op3_substring_dedup
from .tokencounts import op7_token_counts
from .warc import OP1_SQL, op1_warc_convert

QUERIES = {"op6_decontaminate": op6_decontaminate, "op7_token_counts": op7_token_counts, "op8_sentencepiece": op8_sentencepiece, "op3_substring_dedup": op3_substring_dedup, "op4_lm_score": op4_lm_score, "op10_language_id": op10_language_id, "op1_warc_convert": op1_warc_convert, "op2_exact_dedup": op2_exact_dedup, "op5_simhash_groups": op5_simhash_groups, "op9_secret_scan": op9_secret_scan}
SQL = {"op3_substring_dedup": OP3_SQL, "op1_warc_convert": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op9_secret_scan": OP9_SQL}
