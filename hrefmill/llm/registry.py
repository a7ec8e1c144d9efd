"""Registered queries of the training-data operators, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hrefmill.llm import (
    bpe,
    decontaminate,
    fill_in_middle,
    html_text,
    language,
    line_crf,
    near_dedup,
    quality,
    resample,
    sharding,
    suffix_dedup,
    surrogates,
    tool_calls,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_tool_calls": tool_calls.op2_tool_calls,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_html": html_text.op4_html,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_bpe": bpe.op7_bpe,
    "op8_language": language.op8_language,
    "op9_shards": sharding.op9_shards,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_quality_lines": line_crf.op11_quality_lines,
    "op12_resample": resample.op12_resample,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLE: dict[str, str] = {
    "op2_tool_calls": tool_calls.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op12_resample": resample.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
