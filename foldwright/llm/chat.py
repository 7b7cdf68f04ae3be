"""Prefix-target expansion of conversations into training examples (native).

Every assistant turn becomes an example of its own: all preceding turns as
context, and only that reply trainable.  A conversation that does not end with
an assistant turn also gives one context-only example (empty loss span), so the
output always holds every turn.

Template of a turn: ``<s>[INST]role[/INST]text</s>``.  Inside roles and texts a
backslash is doubled and a control string gets a backslash after its first
character, so no control string survives in content, and unescaping is exact.

Defined cases: null role or text is empty; rows of equal turn follow role, then
text; repeated rows are turns of their own; null conv_id is one conversation;
an empty table gives no examples; other columns are ignored, whatever their
names.  An example holds its whole context as one string, so a conversation of
k turns gives text of order k squared: that is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TRAINABLE = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\sI/])", "$1")


def expand(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, example, formatted, loss_start, loss_end); the loss span
    counts code points of formatted, end exclusive."""
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), body, F.lit(CLOSE)).alias("seg"), F.length(body).cast("long").alias("body")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    ends = F.expr(f"filter(sequence(0, size(turns) - 1), i -> turns[i].role = '{TRAINABLE}' or i = size(turns) - 1)")
    each = convs.select("conv_id", "turns", F.posexplode(ends).alias("example", "i"))
    formatted = F.expr("array_join(transform(slice(turns, 1, i + 1), t -> t.seg), '')")
    each = each.select("conv_id", F.col("example").cast("long").alias("example"), formatted.alias("formatted"), F.expr(f"if(turns[i].role = '{TRAINABLE}', turns[i].body, -1L)").alias("body"))
    end = F.length("formatted").cast("long") - F.when(F.col("body") >= 0, len(CLOSE)).otherwise(0)
    return each.select("conv_id", "example", "formatted", (end - F.greatest("body", F.lit(0))).alias("loss_start"), end.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: the turns parsed from its longest example, and the
    unescaped text under the loss mask of all its examples."""
    loss = unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))
    g = examples.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("full"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    parts = F.transform(F.expr(f"slice(split(full, '{CLOSE}', -1), 1, size(split(full, '{CLOSE}', -1)) - 1)"), lambda s: F.split(F.substring(s, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]", 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    return g.select("conv_id", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -7L AS conv_id, * FROM VALUES (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)")
    back = read_back(expand(given.unionByName(tricky)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESC = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, sum(20 + length({_ESC.format('role')}) + length({_ESC.format('text')})) OVER w AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
