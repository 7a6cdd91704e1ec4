"""Messages for a language model, conversations, and the answers that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col

SPEAKERS = ["user", "assistant"]
TURNS_PER_CHUNK = 4096

# The fields of an answer.
TEXT_FIELDS = ["executive_summary", "dataset_overview", "key_findings_and_patterns", "potential_issues_and_warnings"]
ADVICE_FIELDS = ["preprocessing_steps", "feature_engineering_ideas", "modeling_suggestions", "pitfall_warnings"]
ADVICE = "array<struct<category:string,description:string,priority:int>>"
ANSWER = ", ".join([f"{f} string" for f in TEXT_FIELDS]
                   + ["recommendations struct<" + ",".join(f"{f}:{ADVICE}" for f in ADVICE_FIELDS) + ">", "_broken string"])

INSTRUCTIONS = (
    "You explain the results of a data analysis to its owner. Answer with one JSON object and nothing else. Its text fields are "
    + ", ".join(TEXT_FIELDS) + ". Its field recommendations holds the lists " + ", ".join(ADVICE_FIELDS)
    + "; every entry has category, description and priority from 1 (urgent) to 3.")
SAMPLE_NOTE = ("The figures below come from part of the table; the field original_row_count says how many rows it really has. "
               "Word findings as tendencies.\n")
REPAIR = "The next message should be one JSON object but does not parse. Send it back as valid JSON with the same content and no other text."


def _messages(system: Column, user: Column, cached: bool) -> Column:
    def message(position: int, role: str, content: Column, cache: bool) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(role).alias("role"), content.alias("content"), F.lit(cache).alias("cache"))
    return F.inline(F.array(message(0, "system", system, cached), message(1, "user", user, False)))


def prompt_messages(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """Two message rows (system, user) for every row with `context`, `task` and `mode`."""
    user = F.concat(F.lit("The analysis task is "), F.col("task"), F.lit(".\n"),
                    F.when(F.col("mode") == "fast", SAMPLE_NOTE).otherwise(""), F.lit("Results as JSON:\n"), F.col("context"))
    return contexts.select(*[col(k) for k in keys], _messages(F.lit(INSTRUCTIONS), user, True))


def merge_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, role, first_turn, turns, content): neighbours of one role become one turn.

    Only users and assistants speak. A conversation is cut into chunks of
    consecutive turn numbers, so that even one holding most of the rows is
    spread over tasks; per conversation only one row a chunk is ordered, to
    learn where a chunk's first run continues the chunk before.
    """
    said = turns.where(col(role).isin(SPEAKERS)).select(
        col(conv).alias("conv_id"), col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text"),
        F.floor(col(turn) / TURNS_PER_CHUNK).alias("chunk"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    changes = ~F.col("role").eqNullSafe(F.lag("role").over(inside))
    runs = said.withColumn("starts", changes.cast("int")).withColumn("run", F.sum("starts").over(inside))
    pieces = (runs.groupBy("conv_id", "chunk", "run", "role")
              .agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"),
                   F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("content")))
    ends = (pieces.groupBy("conv_id", "chunk")
            .agg(F.max("run").alias("runs"), F.min_by("role", "run").alias("opens"), F.max_by("role", "run").alias("closes")))
    along = Window.partitionBy("conv_id").orderBy("chunk")
    joined = ends.withColumn("continues", F.coalesce((F.lag("closes").over(along) == F.col("opens")).cast("int"), F.lit(0)))
    before = F.sum(F.col("runs") - F.col("continues")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs")
    starts = joined.select("conv_id", "chunk", before.alias("before"))
    return (pieces.join(starts, ["conv_id", "chunk"])
            .groupBy("conv_id", (F.col("run") + F.col("before") - 1).alias("position"), "role")
            .agg(F.min("first_turn").alias("first_turn"), F.sum("turns").alias("turns"),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_turn", "content"))), lambda x: x["content"]), "\n\n").alias("content")))


def extract_json(raw: Column) -> Column:
    """From the first opening to the last closing brace; without them the text less its code fences."""
    text = F.trim(raw, F.lit(" \n\r\t\f"))
    opens, tail = F.locate("{", text), F.locate("}", F.reverse(text))
    closes = F.length(text) - tail + 1
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\A```json", ""), r"\A```", ""), r"```\z", "")
    return F.when((opens > 0) & (tail > 0) & (closes > opens), F.substring(text, opens, closes - opens + 1)).otherwise(F.trim(bare, F.lit(" \n\r\t\f")))


def parse_responses(responses: DataFrame, column: str) -> DataFrame:
    """Adds `json`, `answer` (a struct) and `is_valid`; what does not parse stays with is_valid false."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}
    with_json = responses.withColumn("json", extract_json(col(column)))
    parsed = with_json.withColumn("answer", F.from_json("json", ANSWER, options))
    valid = F.col("json").startswith("{") & F.col("answer").isNotNull() & F.col("answer._broken").isNull()
    return parsed.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def normalise_response(parsed: DataFrame) -> DataFrame:
    """Valid answers with missing texts as '' and missing lists as empty."""
    texts = [F.coalesce(F.col(f"answer.{f}"), F.lit("")).alias(f) for f in TEXT_FIELDS]
    lists = [F.coalesce(F.col(f"answer.recommendations.{f}"), F.array().cast(ADVICE)).alias(f) for f in ADVICE_FIELDS]
    kept = [c for c in parsed.columns if c not in ("answer", "is_valid", "json")]
    return parsed.where("is_valid").select(*kept, *texts, F.struct(*lists).alias("recommendations"))


def recommendations(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, list, category, description, priority): one row per piece of advice."""
    def entries(name: str) -> Column:
        return F.transform(F.col(f"recommendations.{name}"), lambda x: F.struct(
            F.lit(name).alias("list"), x["category"].alias("category"), x["description"].alias("description"), x["priority"].alias("priority")))

    return answers.select(*[col(k) for k in keys], F.inline(F.concat(*[entries(f) for f in ADVICE_FIELDS])))


def retry_queue(parsed: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Correction messages for every answer that did not parse."""
    user = F.concat(F.lit("Broken JSON:\n\n"), col(column))
    return parsed.where(~F.col("is_valid")).select(*[col(k) for k in keys], _messages(F.lit(REPAIR), user, False))
