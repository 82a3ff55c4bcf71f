"""Relational chat formatting (operator 6), with Spark expressions only.

Turn structs are collected per conversation and sorted; adjacent turns of one role
share a header, their texts being aggregated into one array; arrays are joined to the
formatted string. ``&``, ``<`` and ``[`` are escaped inside roles and texts (and the line
end inside roles), so no control string can come from a text and escaping is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
HEAD, NEXT, END = "<|start|>", "<|next|>", "<|end|>\n"
LEARNT = "assistant"


def escaped(text: Column, line: bool = False) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), *([("\n", "&NewLine;")] if line else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for a, b in (("&NewLine;", "\n"), ("&lsqb;", "["), ("&lt;", "<"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, segments, mask.

    ``segments`` are the string's parts in order, ``loss`` true on exactly the texts of assistant
    turns; ``mask`` is the loss mask by itself, a flag for each text that stands in the string between
    control strings, in order. Turns are ordered by turn, then role, then
    text, nulls first; repeated rows stay. Null text and null role are empty; rows with a null conv_id
    form one conversation. Further columns are ignored, whatever their names; no rows give no
    conversations. A conversation is one row of the result, so it is in one task.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    per = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    last = F.size("t") - 1
    new = lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", F.greatest(i - 1, F.lit(0)))["role"])
    per = per.withColumn("starts", F.filter(F.sequence(F.lit(0), last), new))
    runs = F.transform(F.arrays_zip(F.col("starts").alias("lo"), F.concat(F.slice("starts", 2, 1 << 30), F.array(last + 1)).alias("hi")), lambda r: F.struct(F.get("t", r["lo"])["role"].alias("role"), F.transform(F.slice("t", r["lo"] + 1, r["hi"] - r["lo"]), lambda x: x["text"]).alias("texts")))
    per = per.select("conv_id", runs.alias("runs"))
    plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))

    def parts(r: Column) -> Column:
        before = lambda i: F.when(i == 0, F.concat(F.lit(HEAD), escaped(r["role"], True), F.lit("\n"))).otherwise(F.lit(NEXT))
        texts = F.transform(r["texts"], lambda x, i: F.array(plain(before(i)), F.struct(escaped(x).alias("text"), (r["role"] == LEARNT).alias("loss"))))
        return F.concat(F.flatten(texts), F.array(plain(F.lit(END))))

    mask = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda _: r["role"] == LEARNT)))
    per = per.select("conv_id", F.flatten(F.transform("runs", parts)).alias("segments"), mask.alias("mask"))
    return per.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "mask")


def read_turns(text: Column) -> Column:
    """Formatted string -> array of (role, text), the turns before merging."""
    runs = F.filter(F.split(text, r"<\|end\|>\n", -1), lambda x: x != "")
    role = lambda r: unescaped(F.substring_index(F.substr(r, F.lit(len(HEAD) + 1)), "\n", 1))
    body = lambda r: F.substr(r, F.instr(r, "\n") + 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.split(body(r), r"<\|next\|>", -1), lambda x: F.struct(role(r).alias("role"), unescaped(x).alias("text")))))


def read_loss(text: Column, mask: Column) -> Column:
    """The texts of a formatted string under its mask, cut out between control strings and unescaped, in order."""
    between = F.split(text, r"(?:<\|end\|>\n)?<\|start\|>[^\n]*\n|<\|next\|>|<\|end\|>\n", -1)
    inside = F.slice(between, F.lit(2), F.size(between) - 2)
    return F.transform(F.filter(F.arrays_zip(inside.alias("text"), mask.alias("loss")), lambda x: x["loss"]), lambda x: unescaped(x["text"]))


def digests(chats: DataFrame) -> DataFrame:
    """Output of :func:`formatted` -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the string and its mask.

    An empty text counts nothing; conversations with one id each have a row; no rows give no rows.
    """
    out = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("mask")).alias("learnt"))
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"), F.array_join("learnt", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
