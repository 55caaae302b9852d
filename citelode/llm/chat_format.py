"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

A conversation is written as ``<s>`` and its turns, each a mark, the escaped text and ``</s>``.
An example is the conversation up to one assistant turn; only that reply is trainable, given as
an offset and a length in code points. Since turns are simply set one after the other, an example
is a prefix of the whole formatted conversation: offsets are running sums, texts are cut from one
string, and everything happens on one exchange by conversation. DataFrame operations only.

What a row of the result holds is what the method asks for: with ``n`` replies a conversation's
text is written up to ``n`` times. A conversation has to fit into one row (2 GB), as its last
example does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks of the template.
BEGIN, END, OTHER = "<s>", "</s>", "[ROLE]"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
#: A control string, perhaps escaped already: an opening, any number of backslashes, the rest.
CONTROL = r"([<\[]/?)(\\*)(s>|INST\]|SYS\]|ROLE\])"
ESCAPED = r"([<\[]/?)\\(\\*)(s>|INST\]|SYS\]|ROLE\])"


def escaped(text: Column) -> Column:
    """The text with one more backslash inside every control string, so that it holds none.

    One backslash more for any number of them: no two texts have the same escaped form.
    """
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` made this from."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _mark(role: Column) -> Column:
    out = F.concat(F.lit(OTHER), F.hex(role), F.lit("\n"))
    for name, mark in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def parsed(text: Column) -> Column:
    """Turns of a formatted conversation or example: an array of ``role, text``."""
    pieces = F.split(F.substr(text, F.lit(len(BEGIN) + 1)), END)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.decode(F.unhex(F.substr(head, F.lit(len(OTHER) + 1))), "UTF-8")
        rest = F.substr(piece, F.length(head) + 2)
        for name, mark in MARKS.items():
            own = piece.startswith(mark)
            role, rest = F.when(own, F.lit(name)).otherwise(role), F.when(own, F.substr(piece, F.lit(len(mark) + 1))).otherwise(rest)
        return F.struct(role.alias("role"), unescaped(rest).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each assistant turn: ``conv_id, example, n_turns, text, loss_start, loss_chars, last``.

    ``example`` counts from 0; ``n_turns`` are the turns in ``text``; the trainable part begins
    ``loss_start`` code points into it. A conversation whose last turn is no reply gives one more
    row with nothing trainable (``loss_chars`` 0, ``loss_start`` at its end), so every turn is in
    the row marked ``last``. Turns stand by number, nulls first, then by role and text; repeated
    rows are turns like others. A null role or text counts as empty, rows without a conversation's
    id form one without id. An empty table gives no rows; further columns are left out.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    body = escaped(F.col("text"))
    rows = rows.withColumn("mark", _mark(F.col("role"))).withColumn("body", body)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = F.sum(F.length("mark") + F.length("body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("stop", (upto + len(BEGIN)).cast("int"))
    span = F.struct("pos", "stop", F.length("body").alias("chars"))
    part = F.struct("pos", F.concat("mark", "body", F.lit(END)).alias("part"))
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("replies"),
        F.max(F.struct("pos", "stop")).alias("end"),
    )
    replied = F.coalesce(F.try_element_at("replies", F.lit(-1))["pos"], F.lit(0)) == F.col("end.pos")
    rest = F.array(F.struct(F.col("end.pos").alias("pos"), F.col("end.stop").alias("stop"), F.lit(None).cast("int").alias("chars")))
    whole = whole.select(
        "conv_id",
        F.col("end.pos").alias("turns"),
        F.concat(F.lit(BEGIN), F.array_join("parts.part", "")).alias("whole"),
        F.when(replied, F.col("replies")).otherwise(F.concat("replies", rest)).alias("spans"),
    )
    one = whole.select("conv_id", "turns", "whole", F.posexplode("spans").alias("example", "span"))
    chars, stop = F.col("span.chars"), F.col("span.stop")
    return one.select(
        "conv_id",
        "example",
        F.col("span.pos").cast("long").alias("n_turns"),
        F.substr("whole", F.lit(1), stop).alias("text"),
        F.when(chars.isNull(), stop).otherwise(stop - len(END) - chars).alias("loss_start"),
        F.coalesce(chars, F.lit(0)).alias("loss_chars"),
        (F.col("span.pos") == F.col("turns")).alias("last"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """What ``examples`` wrote, read back: turns, trainable text and length of each conversation."""
    loss = unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_chars")))
    # the rows of a conversation still lie together: no further exchange
    back = rows.select("conv_id", "example", F.when(F.col("last"), F.col("text")).alias("whole"), loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    back = back.groupBy("conv_id").agg(
        F.array_join(F.collect_list("whole"), "").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars")
    )
    back = back.select("conv_id", parsed(F.col("whole")).alias("turns"), F.array_join("losses.loss", "").alias("loss"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same from the turns themselves: escaping only changes the length.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
p AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    3 + sum(4 + length(regexp_replace(text, '([<\[]/?)(\\*)(s>|INST\]|SYS\]|ROLE\])', '\1|\2\3', 'g'))
      + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 5 ELSE 7 + length(hex(role)) END) OVER w AS stop
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(stop) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
