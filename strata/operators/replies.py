"""What model replies, plans and environment files say, read as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import truncate

#: Names of a decision, the decisions, places of a reply's text, and what a plan may declare.
DECISION_KEYS = ("decision", "verdict", "judgement", "judgment", "status")
DECISIONS = ("APPROVE", "REVISE", "REJECT")
TEXT_PATHS = ("$.choices[0].message.content", "$.data.choices[0].message.content", "$.data.response", "$.response", "$.result.content", "$.data.content", "$.text")
DECLARED = ("will_modify", "will_add", "will_remove")
#: The forms of a fenced json block, a bare decision, a line of a register, and a line of an environment file.
JSON_BLOCK = r"```json\s*\n([\s\S]*?)```"
BARE = r"(?i)^(?:(?:decision|verdict)\s*[:=]\s*)?(APPROVE|REVISE|REJECT)\b[\s.!。]*$"
REGISTER_LINE = r"^\s*(?:[-*•]|\d+[.)])?\s*`?(reg[-_][A-Za-z0-9_-]+)`?\s*(?::|—|–|\s-\s)\s*(.+?)\s*$"
ENV_LINE = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"


def text_at(value: Column, path: str) -> Column:
    """The string at a path of a variant; null where there is none or another kind of value."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def assistant_text(payload: Column) -> Column:
    """The first string among the usual places of an answer (JSON text); null if there is none or the JSON is broken."""
    value = F.try_parse_json(payload)
    return F.coalesce(*(text_at(value, p) for p in TEXT_PATHS))


def verdicts(replies: DataFrame, most: int = 50, length: int = 2000) -> DataFrame:
    """``reply, decision, concerns, rationale`` of ``reply, json, text``; without a decision in the JSON, a bare one in the text counts.

    Concerns beyond ``most`` are counted in the rationale, and each is cut to ``length``. A suggestion in prose is one more
    concern. REVISE without a concern is APPROVE. Where nothing decides, all three are null.
    """
    value = F.try_parse_json("json")
    said = F.upper(F.trim(F.coalesce(*(text_at(value, f"$.{k}") for k in DECISION_KEYS))))
    given = F.coalesce(F.try_variant_get(value, "$.concerns", "array<string>"), F.array().cast("array<string>"))
    prose = F.trim(F.coalesce(text_at(value, "$.suggested_revision"), text_at(value, "$.suggestedRevision"), F.lit("")))
    word = F.upper(F.regexp_extract(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\*+", "")), BARE, 1))
    rows = replies.select("reply", F.when(said.isin(*DECISIONS), said).alias("said"), F.when(word != "", word).alias("word"), given.alias("given"), prose.alias("prose"), F.coalesce(text_at(value, "$.rationale"), F.lit("")).alias("why"))
    cut = F.transform(F.slice("given", 1, most), lambda c: truncate(c, length))
    rows = rows.withColumn("concerns", F.when(F.col("prose") != "", F.concat(cut, F.array(truncate(F.col("prose"), length)))).otherwise(cut))
    over = F.size("given") - most
    why = F.when(over > 0, F.concat(F.lit("[dropped "), over.cast("string"), F.lit(" concern(s) over the cap] "), "why")).otherwise(F.col("why"))
    empty = (F.col("said") == "REVISE") & (F.size("concerns") == 0)
    bare = F.when(F.col("word") == "REVISE", "[bare REVISE with no concerns]").when(F.col("word").isNotNull(), "[decision read from a plain-text reply]")
    return rows.select(
        "reply",
        F.when(empty | (F.col("said").isNull() & (F.col("word") == "REVISE")), "APPROVE").otherwise(F.coalesce("said", "word")).alias("decision"),
        F.when(F.col("said").isNotNull(), F.col("concerns")).when(F.col("word").isNotNull(), F.array().cast("array<string>")).alias("concerns"),
        F.when(empty, F.concat(F.lit("[normalized vacuous REVISE] "), why)).when(F.col("said").isNotNull(), why).otherwise(bare).alias("rationale"),
    )


def declarations(plans: DataFrame, last_only: bool = False) -> DataFrame:
    """``plan, will_modify, will_add, will_remove`` of ``plan, text``: the last fenced json block that declares any of them.

    With ``last_only`` no earlier block stands in for the last. Plans that declare nothing have no row; what is no list is empty.
    """
    blocks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(JSON_BLOCK), F.lit(1))
    blocks = F.slice(blocks, -1, 1) if last_only else blocks
    tells = lambda b: F.try_parse_json(b).isNotNull() & F.coalesce(F.arrays_overlap(F.json_object_keys(b), F.array(*map(F.lit, DECLARED))), F.lit(False))
    rows = plans.select("plan", F.filter(F.when(F.size(blocks) > 0, blocks), tells).alias("blocks")).where(F.size("blocks") > 0)
    told = F.try_parse_json(F.element_at("blocks", -1))
    return rows.select("plan", *(F.coalesce(F.try_variant_get(told, f"$.{k}", "array<string>"), F.array().cast("array<string>")).alias(k) for k in DECLARED))


def register_lines(replies: DataFrame) -> DataFrame:
    """``reply, id, semantics`` of ``reply, text``: an id's first line counts, and semantics have four characters at least."""
    lines = replies.select("reply", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    found = lines.select("reply", "line", F.regexp_extract("raw", REGISTER_LINE, 1).alias("id"), F.regexp_extract("raw", REGISTER_LINE, 2).alias("semantics")).where("id != ''")
    clean = found.select("reply", "line", F.lower(F.replace("id", F.lit("_"), F.lit("-"))).alias("id"), F.trim(F.regexp_replace("semantics", r"^\*\*|\*\*$", "")).alias("semantics"))
    return clean.where(F.length("semantics") >= 4).groupBy("reply", "id").agg(F.min_by("semantics", "line").alias("semantics"))


def env_values(files: DataFrame) -> DataFrame:
    """``file, key, value`` of ``file, text``: a key's last line counts; comments, blank and malformed lines don't."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "raw")).select("file", "line", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"))
    pairs = lines.select("file", "line", F.regexp_extract("raw", ENV_LINE, 1).alias("key"), F.regexp_extract("raw", ENV_LINE, 2).alias("raw")).where("key != ''")
    tight = F.regexp_replace("raw", r"^[ \t]+", "")
    quote = F.substring(tight, 1, 1)
    quoted = quote.isin('"', "'")
    close = F.locate('"', tight, 2)
    close = F.when(quote == "'", F.locate("'", tight, 2)).otherwise(close)
    tail = F.regexp_replace(F.substring(tight, close + 1, F.length(tight)), r"^\s+", "")
    plain = F.regexp_replace(F.regexp_replace("raw", r"[ \t]#.*$", ""), r"^\s+|\s+$", "")
    value = (
        F.when(quoted & (F.length(tight) >= 2) & tight.endswith(quote), F.substring(tight, F.lit(2), F.length(tight) - 2))
        .when(quoted & (close > 0) & ((tail == "") | tail.startswith("#")), F.substring(tight, F.lit(2), close - 2))
        .otherwise(plain)
    )
    return pairs.select("file", "line", "key", value.alias("value")).groupBy("file", "key").agg(F.max_by("value", "line").alias("value"))

