"""The subpackage's queries, one an operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_decontaminate import op1_decontaminate
from .op2_toxicity import op2_toxicity
from .op3_chat import ORACLE_SQL as OP3_SQL
from .op3_chat import op3_chat
from .op4_simhash import op4_simhash
from .op5_pii import op5_pii
from .op6_secrets import op6_secrets
from .op7_mixing import ORACLE_SQL as OP7_SQL
from .op7_mixing import op7_mixing
from .op8_suffixes import op8_suffixes
from .op9_urls import op9_urls
from .op10_quality import op10_quality
from .op11_sharding import ORACLE_SQL as OP11_SQL
from .op11_sharding import op11_sharding
from .op12_audit import ORACLE_SQL as OP12_SQL
from .op12_audit import op12_audit
from .op13_fim import ORACLE_SQL as OP13_SQL
from .op13_fim import op13_fim

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_chat": op3_chat,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_suffixes": op8_suffixes,
    "op9_urls": op9_urls,
    "op10_quality": op10_quality,
    "op11_sharding": op11_sharding,
    "op12_audit": op12_audit,
    "op13_fim": op13_fim,
}

ORACLES: dict[str, str] = {
    "op3_chat": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op11_sharding": OP11_SQL,
    "op12_audit": OP12_SQL,
    "op13_fim": OP13_SQL,
}
