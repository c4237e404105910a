"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe_round_trip
from .language_id import op6_language_id
from .lexical import ORACLE_SQL as LEXICAL_SQL
from .lexical import op13_norm_bucket_search
from .mixing import op1_entropy_mixing
from .mtree import ORACLE_SQL as MTREE_SQL
from .mtree import op5_mtree_top_k
from .quality_crf import op8_quality_crf
from .quality_rules import op3_quality_rules
from .setsketch import ORACLE_SQL as SETSKETCH_SQL
from .setsketch import op11_setsketch_components
from .simhash import op10_simhash_components
from .spelling import ORACLE_SQL as SPELLING_SQL
from .spelling import op12_pivotal_variants
from .token_counts import op9_token_counts
from .token_planes import op4_token_planes
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op7_warc_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_entropy_mixing,
        op2_bpe_round_trip,
        op3_quality_rules,
        op4_token_planes,
        op5_mtree_top_k,
        op6_language_id,
        op7_warc_chunks,
        op8_quality_crf,
        op9_token_counts,
        op10_simhash_components,
        op11_setsketch_components,
        op12_pivotal_variants,
        op13_norm_bucket_search,
    )
}
ORACLE: dict[str, str] = {
    "op5_mtree_top_k": MTREE_SQL,
    "op7_warc_chunks": WARC_SQL,
    "op11_setsketch_components": SETSKETCH_SQL,
    "op12_pivotal_variants": SPELLING_SQL,
    "op13_norm_bucket_search": LEXICAL_SQL,
}
