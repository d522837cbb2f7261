"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import read
from sparkloom.llm.compression import op12_compression
from sparkloom.llm.disclosure import op2_disclosure
from sparkloom.llm.fertility import op1_fertility
from sparkloom.llm.layout import op8_layout
from sparkloom.llm.merkle import op13_merkle
from sparkloom.llm.minmax import op4_minmax
from sparkloom.llm.naive_bayes import op9_language
from sparkloom.llm.packing import op10_packing
from sparkloom.llm.secrets import op6_secrets
from sparkloom.llm.spelling import op11_spelling
from sparkloom.llm.templates import op5_templates
from sparkloom.llm.urls import op3_urls
from sparkloom.llm.viterbi import op7_viterbi

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_fertility": lambda spark, d: op1_fertility(read(spark, d, "documents")),
    "op2_disclosure": lambda spark, d: op2_disclosure(read(spark, d, "documents")),
    "op3_urls": lambda spark, d: op3_urls(read(spark, d, "pages")),
    "op4_minmax": lambda spark, d: op4_minmax(read(spark, d, "documents")),
    "op5_templates": lambda spark, d: op5_templates(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op6_secrets": lambda spark, d: op6_secrets(read(spark, d, "documents")),
    "op7_viterbi": lambda spark, d: op7_viterbi(read(spark, d, "documents")),
    "op8_layout": lambda spark, d: op8_layout(read(spark, d, "pages")),
    "op9_language": lambda spark, d: op9_language(read(spark, d, "documents")),
    "op10_packing": lambda spark, d: op10_packing(read(spark, d, "documents")),
    "op11_spelling": lambda spark, d: op11_spelling(read(spark, d, "documents")),
    "op12_compression": lambda spark, d: op12_compression(read(spark, d, "documents"), read(spark, d, "labels")),
    "op13_merkle": lambda spark, d: op13_merkle(read(spark, d, "documents")),
}

#: Operators whose whole result SQL can express: none; each is tested against brute force.
ORACLES: dict[str, str] = {}
