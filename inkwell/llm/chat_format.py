"""Operator 1: chat formatting with Spark expressions only.

Template: each message is `<|turn|>ROLE\nTEXT<|end|>\n`; adjacent turns of one role are merged into one message, their
texts parted by `<|more|>`, so the rows can be read back. Control strings inside roles and texts are broken by a backslash
after their first character, backslashes are doubled and line breaks in roles follow a backslash, which `unescape` undoes. The result holds the formatted string and
the spans (code points) of assistant texts, the loss mask.

Defined cases: null text or role is empty; turns sort by (turn, role, text), null turn first, so ties and repeated rows have
one order; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.tables import table

TURN, MORE, END = "<|turn|>", "<|more|>", "<|end|>"
#: Strings that mark turns here or in common chat templates, as a pattern of (first character)(rest).
CONTROL = r"(<)(\||/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3$5\\$2$4$6")


def escape_role(c: Column) -> Column:
    """Line breaks too, since one ends the role."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\\n"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<at,len>> (1-based, code points), n_messages."""
    t = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # merge adjacent turns of one role: keep what opens a message, and what follows it inside
    opens = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]))
    t = t.withColumn("opens", opens)
    upto = lambda k: F.coalesce(F.try_element_at("opens", (k + 2).cast("int")) - 1, F.size("ts"))
    t = t.withColumn("ms", F.transform("opens", lambda i, k: F.struct(escape_role(F.element_at("ts", i)["role"]).alias("role"), F.transform(F.slice("ts", i, upto(k) - i + 1), lambda x: escape(x["text"])).alias("parts"))))
    # alternate marked-up pieces and texts; texts sit at known places, so spans come from running lengths
    t = t.withColumn("pieces", F.flatten(F.transform("ms", lambda m: F.transform(m["parts"], lambda p, j: F.struct(
        F.when(j == 0, F.concat(F.lit(TURN), m["role"], F.lit("\n"))).otherwise(F.lit(MORE)).alias("head"), p.alias("text"),
        F.when(j == F.size(m["parts"]) - 1, F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"), (m["role"] == "assistant").alias("loss"))))))
    t = t.withColumn("spans", F.aggregate("pieces", F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,len:int>>").alias("out")), lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"])).alias("at"),
        F.when(p["loss"], F.array_append(a["out"], F.struct((a["at"] + F.length(p["head"])).alias("at"), F.length(p["text"]).alias("len")))).otherwise(a["out"]).alias("out")))["out"])
    return t.select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "").alias("formatted"), F.col("spans").alias("loss_spans"), F.size("ms").cast("long").alias("n_messages"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>>: the rows that a formatted string holds."""
    messages = F.filter(F.split(formatted, r"<\|turn\|>"), lambda m: m != "")
    head = lambda m: F.regexp_extract(m, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
    read = lambda m, role: F.transform(F.split(F.substring(m, F.length(role) + 2, F.length(m) - F.length(role) - len(END) - 2), r"<\|more\|>"), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))
    return F.flatten(F.transform(messages, lambda m: read(m, head(m))))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    f = format_chats(real.unionByName(probe)).withColumn("back", read_back(F.col("formatted")))
    lost = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["at"], s["len"]))), "")
    f = f.withColumn("lost", lost)
    return f.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_messages",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, coalesce(role != lag(role) OVER w, true) AS opens,
        length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)', '\1\3\5\\\2\4\6', 'g')) AS chars,
        length(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)', '\1\3\5\\\2\4\6', 'g')) AS role_chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN opens THEN 8 + role_chars + 1 + 8 ELSE 8 END)::BIGINT AS formatted_chars,
  sum(opens::INT)::BIGINT AS n_messages
FROM e GROUP BY conv_id
"""

QUERIES = {"op1_chat_format": op1}
ORACLES = {"op1_chat_format": SQL}
