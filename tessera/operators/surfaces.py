"""Model calls as pluggable table functions, and what surrounds them: prompts, replies, budgets, costs."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import order_statistics
from ..functions.text import TOKEN, cap_words, json_body

REPLY = "map<string,struct<found:boolean,value_as_stated:double,scale:string,confidence:double,citation:string,quote:string>>"


#: Texts that are encoded at a time.
ENCODE_ROWS = 256


def shape_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in encoder that any engine can repeat: unit vectors of token counts by the token's shape.

    A token's place is (31 * first character + 7 * last character + length) modulo dim.
    """
    token = re.compile(TOKEN)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            places = [(31 * ord(t[0]) + 7 * ord(t[-1]) + len(t)) % dim for t in token.findall((text or "").lower())]
            row += np.bincount(places, minlength=dim) if places else 0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def encoded(text: Column, encode: Callable[[list[str]], np.ndarray], prefix: str = "") -> Column:
    """Unit vectors of the prefixed texts."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, ENCODE_ROWS).to_pylist() for at in range(0, len(texts), ENCODE_ROWS))
        kind = pa.list_(pa.float64())
        return pa.concat_arrays([pa.array([], kind), *(pa.array(list(encode([prefix + (t or "") for t in part])), kind) for part in parts)])

    return vectors(text)


def encoded_or_error(text: Column, encode: Callable[[list[str]], np.ndarray], prefix: str = "") -> Column:
    """Struct of vector and error: where the encoder raises, its batch has the error instead of vectors."""
    kind = pa.struct([("vector", pa.list_(pa.float64())), ("error", pa.string())])

    @F.arrow_udf("struct<vector:array<double>,error:string>")
    def vectors(texts: pa.Array) -> pa.Array:
        try:
            return pa.array([{"vector": v, "error": None} for v in encode([prefix + (t or "") for t in texts.to_pylist()])], kind)
        except Exception as e:  # noqa: BLE001  whatever a model raises is data here
            return pa.array([{"vector": None, "error": f"{type(e).__name__}: {e}"}] * len(texts), kind)

    return vectors(text)


def overlap_scorer(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's words that the text holds."""
    asked = F.array_distinct(F.filter(F.split(F.lower(question), r"\W+"), lambda w: w != ""))
    held = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, held)).cast("double"), F.size(asked)), F.lit(0.0))


def complete(prompts: DataFrame, model: Callable[[str], str], retry: Callable[[str], bool] | None = None) -> DataFrame:
    """prompts (prompt_id, prompt) with reply and error: a failed call is a row with an error, never an exception.

    A reply that `retry` refuses is asked for once more.
    """

    def run(batches):
        for batch in batches:
            replies, errors = [], []
            for prompt in batch.column(1).to_pylist():
                reply = error = None
                try:
                    reply = model(prompt)
                    if retry and retry(reply):
                        reply = model(prompt + "\n\nReturn only one JSON object with exactly the required fields.")
                except Exception as e:  # noqa: BLE001  whatever a model raises is data here
                    error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["prompt_id", "reply", "error"])

    kind = prompts.schema["prompt_id"].dataType.simpleString()
    return prompts.select("prompt_id", "prompt").mapInArrow(run, f"prompt_id {kind}, reply string, error string")


def parsed_replies(replies: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a reply and asked metric; a metric the reply leaves out is an abstention, a failed call is errored."""
    body = F.from_json(json_body(F.col("reply")), REPLY, {"mode": "PERMISSIVE"})
    asked = replies.withColumn("body", body).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    x = F.try_element_at("body", F.col("metric"))
    return asked.select("prompt_id", "metric", F.coalesce(x["found"], F.lit(False)).alias("found"), x["value_as_stated"].alias("value_as_stated"), F.coalesce(x["scale"], F.lit("units")).alias("scale"), F.when(x["confidence"].isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["confidence"]))).alias("confidence"), x["citation"].alias("citation"), cap_words(x["quote"]).alias("quote"), (F.col("error").isNotNull() if "error" in replies.columns else F.lit(False)).alias("errored"), x.isNull().alias("abstained"))


def shown_figure(value: Column) -> Column:
    size = F.abs(value)
    exact = F.concat(F.lit(" (exactly "), F.format_number(value, 0), F.lit(")"))
    return F.when(size >= 1e9, F.concat(F.format_number(value / 1e9, 1), F.lit(" billion"), exact)).when(size >= 1e6, F.concat(F.format_number(value / 1e6, 1), F.lit(" million"), exact)).otherwise(F.format_number(value, 2))


def figure_lines(figures: Column) -> Column:
    """Lines of a map of metric to value, by metric; nulls left out."""
    held = F.array_sort(F.filter(F.map_entries(figures), lambda e: e["value"].isNotNull()))
    lines = F.array_join(F.transform(held, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), shown_figure(e["value"]))), "\n")
    return F.when(F.coalesce(F.size(held), F.lit(0)) > 0, lines).otherwise(F.lit("  (none available)"))


def may_write(spent: Column, budget: Column, n_figures: Column) -> Column:
    """Whether the memo step runs: within budget and with figures to speak of."""
    return F.coalesce((spent < budget) & (n_figures > 0), F.lit(False))


def merged(a: Column, b: Column) -> Column:
    """List-valued state of two steps, one behind the other."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(a, empty), F.coalesce(b, empty))


def first_available(preferred: Column, available: Column, is_chat) -> Column:
    """The first preferred model that is available, else the first chat model by name, else null."""
    return F.coalesce(F.get(F.filter(preferred, lambda p: F.array_contains(available, p)), F.lit(0)), F.get(F.array_sort(F.filter(available, is_chat)), F.lit(0)))


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1e6)


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """n, tokens, cost and latency percentiles. calls: tokens_in, tokens_out, cost, latency."""
    own = calls.groupBy(*by).agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))
    mid = order_statistics(calls, "latency", {"p50": 0.5, "p95": 0.95}, *by)
    return own.join(mid, list(by), "left") if by else own.join(F.broadcast(mid), how="left")


NEW_RISKS, RISK_CHARS = 4, 600


def memo_prompt(ticker: Column, fiscal_year: Column, figures: Column, diff: Column, themes: Column, new_risks: Column, has_baseline: Column | None = None) -> Column:
    """The request for a note: figures by name, counts of the diff, themes, and the first new risks cut to RISK_CHARS.

    figures: map of metric to value; diff: struct of new, modified, unchanged and
    drift_score; themes, new_risks: arrays. Without a score the drift is undefined, and
    without a baseline the note is told not to speak of change.
    """
    some = lambda x, otherwise: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, F.array_join(x, ", ")).otherwise(F.lit(otherwise))
    risks = F.array_join(F.transform(F.slice(new_risks, 1, NEW_RISKS), lambda t: F.concat(F.lit("- "), F.substring(t, 1, RISK_CHARS))), "\n\n")
    count = lambda name: F.coalesce(diff[name].cast("string"), F.lit("0"))
    warning = F.when(F.coalesce(has_baseline, F.lit(True)), F.lit("")).otherwise(F.lit("\nThe year before is not at hand: say so, and call nothing a change.")) if has_baseline is not None else F.lit("")
    return F.concat(
        F.lit("Company: "), ticker, F.lit("\nFiscal year: "), fiscal_year.cast("string"), F.lit("\nCompared with: "), (fiscal_year - 1).cast("string"), warning,
        F.lit("\n\nVerified figures:\n"), figure_lines(figures),
        F.lit("\n\nRisk factors: "), count("new"), F.lit(" new, "), count("modified"), F.lit(" modified, "), count("unchanged"), F.lit(" unchanged; drift "),
        F.coalesce(diff["drift_score"].cast("string"), F.lit("undefined")), F.lit("\nThemes: "), some(themes, "none"),
        F.lit("\n\nNew risk factors:\n"), F.when(F.coalesce(F.size(new_risks), F.lit(0)) > 0, risks).otherwise(F.lit("  (none)")),
    )


def grouped_extraction(filings: DataFrame, groups: dict[str, list[str]], metrics: list[str], model: Callable[[str], str], prompt: Callable[[Column, list[str]], Column], retry: Callable[[str], bool] | None = None) -> DataFrame:
    """accession, metric, the fields of parsed_replies(), and way: `group` or `single`.

    One call for each filing and group of wanted metrics; metrics of no group are asked for
    alone, and so are those of a group whose reply could not be read. A metric that a
    readable reply leaves out is an abstention and is not asked for again.
    """
    wanted = {g: own for g, names in groups.items() if (own := [m for m in names if m in metrics])}
    alone = [m for m in metrics if not any(m in own for own in wanted.values())]

    def asked(rows: DataFrame, names: list[str]) -> DataFrame:
        return complete(rows.select(F.col("accession").alias("prompt_id"), prompt(F.col("accession"), names).alias("prompt")), model, retry)

    parts, lost = [], filings.select("accession", F.explode(F.array(*[F.lit(m) for m in alone])).alias("metric")) if alone else None
    for names in wanted.values():
        replies = asked(filings, names)
        readable = F.from_json(json_body(F.col("reply")), REPLY, {"mode": "PERMISSIVE"}).isNotNull()
        parts.append(parsed_replies(replies.where(readable), names).withColumn("way", F.lit("group")))
        unread = replies.where(~F.coalesce(readable, F.lit(False))).select(F.col("prompt_id").alias("accession"), F.explode(F.array(*[F.lit(m) for m in names])).alias("metric"))
        lost = unread if lost is None else lost.unionByName(unread)
    for m in metrics:
        if lost is not None:
            parts.append(parsed_replies(asked(lost.where(F.col("metric") == m), [m]), [m]).withColumn("way", F.lit("single")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("prompt_id", "accession")


def gate_averages(measured: DataFrame, config: str = "config") -> DataFrame:
    """config, n_memos, means a memo of claims and of unsupported ones before and after the gate, memos with any, stops removed, words kept (percent).

    measured: claims.measured() of the memos, and n_unsupported_shown, counted again in what is shown.
    """
    n = F.count("*")
    return measured.groupBy(config).agg(
        n.alias("n_memos"), F.round(F.sum("n_checked") / n, 2).alias("claims_per_memo"), F.round(F.sum("n_unsupported") / n, 3).alias("unsupported_generated"),
        F.round(F.sum("n_unsupported_shown") / n, 3).alias("unsupported_shown"), F.count_if(F.col("n_unsupported") > 0).alias("memos_with_any"),
        F.sum("sentences_removed").alias("sentences_removed"), F.round(F.try_divide(100.0 * F.sum("words_after"), F.sum("words_before")), 1).alias("words_retained_pct"),
    )
