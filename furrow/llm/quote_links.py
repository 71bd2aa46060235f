"""Chat formatting by linking quotations to the messages that they come from.

A message's lines are parsed for nested quote levels (`>` marks). A passage is a run of lines of one level. Passages
and the unquoted passages of all messages (whole bodies, paragraphs, single lines and sentences) are normalised and
hashed, and joined on the hash. A quotation of several sentences or lines also matches a message that holds each of
them, one after the other: of its pieces the one that the fewest messages hold finds the candidates. A quotation links
to the earliest message that says the passage: an earlier turn of its own conversation if there is one, else a message
of another conversation. A message replies to the origin of its first
passage of level 1 that has one, and belongs to the thread of that message if it is of the same conversation. Texts
are returned without quotes; by (conversation, thread, turn) a conversation reads in reply order.

Common passages are reduced to their earliest message before the join, so that one of them can't multiply rows. Null
texts are empty, have no quotes and originate none; rows with a null conversation or turn are kept, with no links.
Repeated rows repeat. Of several origins the least (conversation, turn) is taken. Quoted passages without a letter or
digit link to nothing. Each message is parsed once, in time linear in its length. Other columns are not read, so their
names cannot clash. An empty table gives an empty result. Spark jobs run while the result is being built.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.graph import cut, stored

_MARKS = re.compile(r"(?:[ \t]*>)+")
_BREAK = re.compile(r"\r?\n")
_SENTENCE_ENDS = r"\n|(?<=[.!?])\s+|(?<=[。！？])"


def parsed(text: str) -> tuple[str, list[dict]]:
    """What a message says itself, and its quoted passages (level, text): runs of lines of one level."""
    own, quotes, before = [], [], 0
    for line in _BREAK.split(text) if ">" in text else [text.replace("\r\n", "\n")]:
        m = _MARKS.match(line)
        level = m[0].count(">") if m else 0
        body = (line[m.end() :] if m else line).strip(" ")
        if not level:
            own.append(body)
        elif level == before:
            quotes[-1]["lines"].append(body)
        else:
            quotes.append({"level": level, "lines": [body]})
        before = level
    if ">" not in text:
        own = [x.strip(" ") for x in own[0].split("\n")]
    return "\n".join(own).strip(" \t\r\n"), [{"level": q["level"], "text": "\n".join(q["lines"])} for q in quotes]


def parsed_messages(rows: DataFrame) -> DataFrame:
    """`rows` with said and quotes array<struct<level, text>> in place of text."""
    kinds = rows.drop("text").schema
    place = rows.columns.index("text")
    schema = T.StructType([*kinds.fields, *T.StructType.fromDDL("said string, quotes array<struct<level:int,text:string>>").fields])
    quotes_kind = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            made = [parsed(t or "") for t in batch.column(place).to_pylist()]
            same = [c for k, c in enumerate(batch.columns) if k != place]
            yield pa.RecordBatch.from_arrays([*same, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], quotes_kind)], schema.names)

    return rows.mapInArrow(run, schema)


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def pieces_of(text: Column) -> Column:
    """The distinct normalised lines and sentences of a text that aren't empty."""
    return F.array_distinct(F.filter(F.transform(F.split(text, _SENTENCE_ENDS), normalised), lambda x: x != ""))


def held(parts: DataFrame, keyed: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of the messages that hold all pieces of a quotation in its order.

    A quotation with a piece that nobody says is settled by that: only the others look for messages, by their rarest piece.

    keyed: (conv_id, turn, hash) of what messages say; quoted: (hash, piece, units) of distinct quotations.
    """
    several = quoted.where("size(units) > 1")
    units = several.select(F.col("hash").alias("quote"), F.explode("units").alias("unit")).select("quote", F.sha2("unit", 256).alias("hash"))
    common = keyed.groupBy("hash").agg(F.count("*").alias("n"))
    counted = units.join(common, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("quote").agg(F.min(F.struct("n", "hash")).alias("r")).where("r.n > 0").select("quote", "r.hash")
    found = keyed.join(rarest, "hash").select("conv_id", "turn", F.col("quote").alias("hash"))
    found = found.join(several, "hash").join(parts.select("conv_id", "turn", "said"), ["conv_id", "turn"])
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = F.contains(padded(normalised(F.col("said"))), padded(F.col("piece")))
    return found.where(inside & (F.size(F.array_except("units", pieces_of(F.col("said")))) == 0)).select("conv_id", "turn", "hash")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, reply_conv, reply_turn, thread_turn), one row a message."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    parts = stored(parsed_messages(rows))

    # what messages say themselves, by hash, reduced to the earliest message
    pieces = F.array_distinct(F.transform(F.concat(F.array("said"), F.split("said", r"\n\s*\n"), F.split("said", "\n"), F.split("said", _SENTENCE_ENDS)), normalised))
    keyed = parts.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(pieces).alias("piece")).where("piece <> ''")
    keyed = keyed.select("conv_id", "turn", F.sha2("piece", 256).alias("hash"))
    wanted = parts.where("conv_id is not null and turn is not null and size(quotes) > 0").select("conv_id", "turn", F.posexplode("quotes").alias("n", "q"))
    wanted = wanted.select("conv_id", "turn", "n", F.col("q.level").alias("level"), normalised(F.col("q.text")).alias("piece"), pieces_of(F.col("q.text")).alias("units")).where("piece <> ''")
    wanted = cut(wanted.withColumn("hash", F.sha2(F.concat_ws("\n", "piece", "units"), 256)).withColumn("whole", F.sha2("piece", 256)).distinct())
    if wanted.isEmpty():
        return parts.select("conv_id", "turn", "role", "said", F.size("quotes").cast("long"), F.lit(0).cast("long"), F.lit(None).cast(rows.schema["conv_id"].dataType), F.lit(None).cast(rows.schema["turn"].dataType), "turn").toDF(*_COLUMNS)
    quoted = wanted.select("hash", "whole", "piece", "units").distinct()
    sought = quoted.select(F.explode(F.concat(F.array("whole"), F.transform("units", lambda x: F.sha2(x, 256)))).alias("hash")).distinct()
    keyed = cut(keyed.join(sought, "hash", "left_semi").distinct())
    whole = keyed.withColumnRenamed("hash", "whole").join(quoted.select("hash", "whole"), "whole").select("conv_id", "turn", "hash")
    here = cut(whole.unionByName(held(parts, keyed, quoted)).groupBy("conv_id", "hash").agg(F.min("turn").alias("own_turn")))
    # the two least conversations, so that one other than the own is at hand
    message = F.min(F.struct("conv_id", F.col("own_turn").alias("turn")))
    anywhere = here.groupBy("hash").agg(message.alias("origin"))
    other = here.join(anywhere, "hash").where("conv_id <> origin.conv_id").groupBy("hash").agg(message.alias("other"))
    found = wanted.join(here, ["conv_id", "hash"], "left").join(anywhere, "hash", "left").join(other, "hash", "left")
    found = found.withColumn("origin", F.when(F.col("origin.conv_id") == F.col("conv_id"), F.col("other")).otherwise(F.col("origin")))
    inside = F.col("own_turn").isNotNull() & (F.col("own_turn") < F.col("turn"))
    found = found.select("conv_id", "turn", "n", "level", F.when(inside, F.struct("conv_id", F.col("own_turn").alias("turn"))).otherwise(F.col("origin")).alias("origin")).where("origin is not null")
    links = found.groupBy("conv_id", "turn").agg(F.countDistinct("n").alias("n_linked"), F.min(F.when(F.col("level") == 1, F.struct("n", "origin"))).alias("first"))
    links = cut(links.select("conv_id", "turn", "n_linked", F.col("first.origin.conv_id").alias("reply_conv"), F.col("first.origin.turn").alias("reply_turn")))

    # threads: replies inside a conversation, followed to their first message by doubling
    up = links.where("reply_conv = conv_id").select("conv_id", "turn", F.col("reply_turn").alias("thread_turn"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("higher"))
        step = cut(up.join(above, ["conv_id", "thread_turn"], "left").select("conv_id", "turn", F.coalesce("higher", "thread_turn").alias("thread_turn"), F.col("higher").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    out = parts.join(links, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "said", F.size("quotes").cast("long"), F.coalesce("n_linked", F.lit(0)).cast("long"), "reply_conv", "reply_turn", F.coalesce("thread_turn", "turn")).toDF(*_COLUMNS)


_COLUMNS = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_conv", "reply_turn", "thread_turn"]
