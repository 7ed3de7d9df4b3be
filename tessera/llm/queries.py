"""Queries and SQL of the training-data operators, one query for each."""

from __future__ import annotations

import public_tokenizers

from .common import table


def op1_pstable_embeddings(spark, sf_dir):
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_shuffle_shards(spark, sf_dir):
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op3_counterfactual_toxicity(spark, sf_dir):
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark, sf_dir):
    from .byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_difference_cover(spark, sf_dir):
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op7_bootstrapped_pii(spark, sf_dir):
    from .pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark, sf_dir):
    from .chat_tools import link_tool_calls, turns_as_calls

    return link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")))


def op9_positional_index(spark, sf_dir):
    from .decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark, sf_dir):
    from .token_counts import count_documents

    return count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_pstable_embeddings, op2_shuffle_shards, op3_counterfactual_toxicity, op4_byte_bpe, op5_simhash, op6_difference_cover, op7_bootstrapped_pii, op8_tool_calls, op9_positional_index, op10_token_counts)}

ORACLE_SQL: dict[str, str] = {
    "op8_tool_calls": """
WITH calls AS (
    SELECT coalesce(conv_id::VARCHAR, '') AS conv_id, turn, role, text,
        coalesce(conv_id::VARCHAR, '') || ':' || coalesce(turn::VARCHAR, '') AS call_id,
        CASE role WHEN 'user' THEN 'respond' ELSE 'configure' END AS tool
    FROM conversations WHERE role IN ('user', 'system')
), one AS (
    SELECT conv_id, call_id, min(turn) AS turn, arg_min(role, (tool, text)) AS role, arg_min(text, (tool, text)) AS text,
        arg_min(tool, (tool, text)) AS tool, count(*) AS copies
    FROM calls GROUP BY ALL
), answers AS (
    SELECT coalesce(conv_id::VARCHAR, '') AS conv_id,
        coalesce(conv_id::VARCHAR, '') || ':' || coalesce((turn - 1)::VARCHAR, '') AS call_id,
        min(turn) AS result_turn, min(text) AS content, count(*) AS answers
    FROM conversations WHERE role = 'assistant' GROUP BY ALL
), linked AS (
    SELECT coalesce(o.conv_id, a.conv_id) AS conv_id, coalesce(o.call_id, a.call_id) AS call_id, o.turn, o.tool, o.role, o.text,
        o.copies, a.result_turn, a.content, a.answers,
        CASE WHEN o.copies IS NULL THEN NULL
             WHEN o.text = '' THEN 'too short ' || CASE o.role WHEN 'user' THEN 'prompt' ELSE 'policy' END
             ELSE '' END AS errors
    FROM one o FULL JOIN answers a ON o.conv_id = a.conv_id AND o.call_id = a.call_id
), islands AS (
    SELECT call_id AS own, conv_id AS conv, turn AS t, role = 'user' AND turn >= 2 AND EXISTS (SELECT 1 FROM one b WHERE b.conv_id = o.conv_id AND b.turn = o.turn - 2) AS chained FROM one o
), marked AS (
    SELECT *, sum(CASE WHEN chained THEN 0 ELSE 1 END) OVER (PARTITION BY conv, t % 2 ORDER BY t) AS island FROM islands
), levels AS (
    SELECT own, conv, row_number() OVER (PARTITION BY conv, t % 2, island ORDER BY t) - 1 AS level FROM marked
)
SELECT conv_id, coalesce(turn, result_turn) AS turn, call_id, tool,
    CASE WHEN copies IS NULL THEN 'orphan' WHEN errors <> '' THEN 'invalid' WHEN answers IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
    CASE WHEN copies IS NOT NULL THEN level END::INTEGER AS level,
    coalesce(copies, answers) AS copies, coalesce(errors, '') AS errors,
    '{"arguments":' || CASE WHEN copies IS NULL THEN 'null'
        WHEN role = 'user' THEN '{' || CASE WHEN turn >= 2 THEN '"context":{"$result":' || to_json(conv_id || ':' || (turn - 2)::VARCHAR)::VARCHAR || '},' ELSE '' END || '"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR || '}'
        ELSE '{"policy":' || to_json(text)::VARCHAR || '}' END
    || ',"id":' || to_json(call_id)::VARCHAR || ',"level":' || CASE WHEN copies IS NULL THEN 'null' ELSE level::VARCHAR END
    || ',"name":' || coalesce(to_json(tool)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS message
FROM linked LEFT JOIN levels ON own = call_id AND conv = conv_id AND copies IS NOT NULL
""",
}
