"""The queries of this subpackage and their SQL, by the names under which __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import read_table
from rivulet.llm.chat import OP2_SQL, op2_query
from rivulet.llm.decontaminate import OP7_SQL, op7_query
from rivulet.llm.embed_dedup import OP6_SQL, op6_query
from rivulet.llm.html_extract import op5_query
from rivulet.llm.lang_id import op3_query
from rivulet.llm.near_dedup import OP4_SQL, op4_query
from rivulet.llm.packing import op1_query
from rivulet.llm.pii import op10_query
from rivulet.llm.substring_dedup import OP8_SQL, op8_query
from rivulet.llm.url_filter import OP9_SQL, op9_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_curve_packing": lambda spark, d: op1_query(read_table(spark, d, "documents")),
        "op2_reply_trees": lambda spark, d: op2_query(read_table(spark, d, "conversations")),
        "op3_language_id": lambda spark, d: op3_query(read_table(spark, d, "documents")),
        "op4_minhash_dedup": lambda spark, d: op4_query(read_table(spark, d, "documents")),
        "op5_html_text": lambda spark, d: op5_query(read_table(spark, d, "pages")),
        "op6_pstable_vectors": lambda spark, d: op6_query(read_table(spark, d, "embeddings")),
        "op7_template_leaks": lambda spark, d: op7_query(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")),
        "op8_anchor_repeats": lambda spark, d: op8_query(read_table(spark, d, "documents")),
        "op9_url_filter": lambda spark, d: op9_query(read_table(spark, d, "pages")),
        "op10_pii_votes": lambda spark, d: op10_query(read_table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_reply_trees": OP2_SQL, "op4_minhash_dedup": OP4_SQL, "op6_pstable_vectors": OP6_SQL, "op7_template_leaks": OP7_SQL, "op8_anchor_repeats": OP8_SQL, "op9_url_filter": OP9_SQL}
