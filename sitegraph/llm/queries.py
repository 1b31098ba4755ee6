"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm.ann import op8_nearest_neighbours
from sitegraph.llm.chatrepair import op11_conversation_repair
from sitegraph.llm.decontaminate import op1_decontamination
from sitegraph.llm.licenses import OP5_SQL, op5_license_scan
from sitegraph.llm.linededup import OP12_SQL, op12_line_dedup
from sitegraph.llm.mixing import OP6_SQL, op6_mixing
from sitegraph.llm.ngram_join import op2_ngram_jaccard_join
from sitegraph.llm.sharding import op4_sharding
from sitegraph.llm.token_files import op7_token_ids
from sitegraph.llm.toolchat import op9_tool_chat
from sitegraph.llm.toxicity import op3_toxicity
from sitegraph.llm.warc import OP10_SQL, op10_warc_derivatives
from sitegraph.llm.whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_token_ids": op7_token_ids,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_tool_chat": op9_tool_chat,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op5_license_scan": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op10_warc_derivatives": OP10_SQL,
    "op12_line_dedup": OP12_SQL,
}
