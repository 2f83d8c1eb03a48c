"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a list of parts (text, image, audio, document). A visitor flattens the parts
of a message into one ordered string: text is escaped, every other part becomes a numbered
placeholder; what it refers to and how many tokens it expands to go into the conversation's
list of attachments. Messages become

    <|turn|>role<|text|>...<|end|>

and `&` and `<` inside roles, texts and references are written `&a` and `&l`, so no text
can hold a control string and every text reads back as it was. The loss mask is a list of
spans (start, length in code points of the formatted string) over assistant texts.

A long conversation is formatted in blocks of ``BLOCK`` turns in parallel; only finished
blocks meet in one row, as the formatted conversation is one string by its nature.

Defined results: null role or text counts as empty; messages of one conversation are
ordered by turn (null first), then role, then text, repeated rows are kept; a null conv_id
is a conversation of its own; unknown part types become placeholders with 0 tokens; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import table

BLOCK = 256
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256  # pixels a side, tokens a second, tokens a page

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&a")), F.lit("<"), F.lit("&l"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&l"), F.lit("<")), F.lit("&a"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"),
                            none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def part_tokens(p: Column) -> Column:
    """Tokens that a part other than text expands to."""
    return (F.when(p["type"] == "image", F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH))
            .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
            .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
            .otherwise(0).cast("long"))


def flattened(parts: Column) -> Column:
    """Text parts and placeholders of one message in order."""
    def visit(p, i):
        mark = F.concat(F.lit("<|"), escaped(F.coalesce(p["type"], F.lit("unknown"))), F.lit(":"), escaped(p["ref"]), F.lit(":"), part_tokens(p).cast("string"), F.lit("|>"))
        return F.when(F.coalesce(p["type"], F.lit("unknown")) == "text", escaped(p["text"])).otherwise(mark)
    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """What the parts of one message refer to, in order."""
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return F.filter(numbered, lambda a: F.coalesce(a["type"], F.lit("unknown")) != "text")


def formatted(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans, attachments of every conversation.

    ``messages``: conv_id, turn, role, and parts (array of ``PART``) or text."""
    parts = F.coalesce(F.col("parts"), text_part(F.col("text")) if "text" in messages.columns else F.array().cast(f"array<{PART}>")) if "parts" in messages.columns else text_part(F.col("text"))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("p"))
    rows = rows.select("conv_id", "turn", "role", flattened(F.col("p")).alias("body"), attachments(F.col("p")).alias("refs"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    message = F.struct(
        "turn", "role", "body", F.concat(head, F.col("body"), F.lit(END)).alias("whole"), F.length(head).alias("lead"),
        F.transform("refs", lambda a: F.struct(F.col("turn").alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("refs"))
    block = F.floor(F.col("turn") / BLOCK)
    blocks = (rows.select("conv_id", block.alias("block"), message.alias("m"))
              .groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("m")).alias("ms")))
    # where each message of the block begins, counted from the block's start
    sizes = F.transform("ms", lambda m: F.length(m["whole"]).cast("long"))
    begins = F.transform("ms", lambda m, i: F.aggregate(F.slice(F.col("sizes"), F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    blocks = blocks.withColumn("sizes", sizes).withColumn("begins", begins)
    spans = F.transform(
        F.filter(F.arrays_zip("ms", "begins"), lambda z: (z["ms"]["role"] == loss_role)),
        lambda z: F.struct((z["begins"] + z["ms"]["lead"]).alias("start"), F.length(z["ms"]["body"]).cast("long").alias("length")))
    block = F.struct("block", F.size("ms").cast("long").alias("n"), F.array_join(F.transform("ms", lambda m: m["whole"]), "").alias("text"),
                     spans.alias("spans"), F.flatten(F.transform("ms", lambda m: m["refs"])).alias("refs"))
    whole = blocks.select("conv_id", block.alias("b")).groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    lengths = F.transform("bs", lambda b: F.length(b["text"]).cast("long"))
    whole = whole.withColumn("lengths", lengths)
    moved = F.flatten(F.transform("bs", lambda b, i: F.transform(b["spans"], lambda s: F.struct(
        (s["start"] + F.aggregate(F.slice(F.col("lengths"), F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)).alias("start"), s["length"].alias("length")))))
    return whole.select(
        "conv_id", F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_turns"),
        F.array_join(F.transform("bs", lambda b: b["text"]), "").alias("formatted"), moved.alias("loss_spans"),
        F.flatten(F.transform("bs", lambda b: b["refs"])).alias("attachments"))


def read_back(text: Column) -> Column:
    """Array of (role, text) from a formatted string; placeholders stay as they are written."""
    bodies = F.filter(F.split(text, r"<\|end\|>"), lambda m: m != "")
    return F.transform(bodies, lambda m: F.struct(
        unescaped(F.replace(F.split_part(m, F.lit(TEXT), F.lit(1)), F.lit(TURN), F.lit(""))).alias("role"),
        unescaped(F.split_part(m, F.lit(TEXT), F.lit(2))).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold another template's control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.range(1).select(F.lit(-7).alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = given.unionByName(made.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    out = formatted(rows).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: The digests follow from the table; formatted_chars from the template and its escapes.
OP6_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(23 + length(replace(replace(role, '&', '&a'), '<', '&l')) + length(replace(replace(text, '&', '&a'), '<', '&l'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
