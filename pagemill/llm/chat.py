r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only
that reply is trainable. What follows the last reply becomes a closing example without a target, so
a conversation can be read back from its examples whole.

A turn is written as `### role: text</turn>\n`. In texts and roles a backslash is put before every
`\` and `#`, and before a `/` that follows `<`, so no text holds `###` or `</turn>`; in roles also
before `:`. Dropping the backslash of each pair restores the text. The trainable span of an example
is its `target` text, written in full with its end mark after it.

Null texts and roles are empty ones. Turns of equal number stand in the order of role and text; a
null turn number comes first. Repeated rows are turns of their own. The work for a conversation is
the size of its examples, which is the square of its turns; conversations are spread by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#]|(?<=<)/", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\#:]|(?<=<)/", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame) -> DataFrame:
    """Rows conv_id, example (1, 2, ... in a conversation), context, target: strings as formatted.
    target is null in a closing example. context + target is the whole example."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    talk = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "))
    talk = talk.select("conv_id", F.transform("ts", lambda t: F.struct((t["role"] == TARGET_ROLE).alias("own"), head(t).alias("head"), F.concat(escape(t["text"]), F.lit(END)).alias("body"))).alias("ts"))
    last = F.size("ts") - 1
    stops = F.filter(F.transform("ts", lambda t, i: F.when(t["own"], i).when(i == last, i + 1)), lambda i: i.isNotNull())
    at = F.col("at")
    each = talk.select("conv_id", "ts", F.posexplode(stops).alias("example", "at"))
    whole = F.array_join(F.transform(F.slice("ts", F.lit(1), at), lambda t: F.concat(t["head"], t["body"])), "")
    own = F.get("ts", at)
    return each.select("conv_id", (F.col("example") + 1).alias("example"), F.concat(whole, F.coalesce(own["head"], F.lit(""))).alias("context"), own["body"].alias("target"))


def parse(formatted: Column) -> Column:
    """An array of (role, text) from turns as formatted."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    # Possessive, and without an alternation: Java matches it by a loop, however long the role is.
    head = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): "
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output of
    expand() alone: the last example of a conversation holds all its turns."""
    target = F.coalesce("target", F.lit(""))
    # A target's own text ends before its end mark.
    loss = unescape(F.expr(f"substr(target, 1, length(target) - {len(END)})"))
    by = examples.select("conv_id", "example", F.concat("context", target).alias("whole"), loss.alias("loss"))
    got = by.groupBy("conv_id").agg(
        F.max_by("whole", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("whole")).alias("formatted_chars"),
    )
    turns = F.col("turns")
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    got = got.withColumn("turns", parse(F.col("whole")))
    return got.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
