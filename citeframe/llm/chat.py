"""Chat formatting checked by a grammar round trip.

A turn is written ``OPEN role CLOSE text END``. The same grammar, read by a deterministic parser, must give back the turns
it was written from. Where it does not, because a text holds control strings or something that looks like their escaped
form, that turn is written again with those places escaped, and the whole conversation is parsed once more; a difference
that is left stops the job.

Escaping puts a backslash behind the first character of a control string, or one more where there are some, so it can be
undone and leaves no control string in a text. Control strings start with ``<`` or ``[``, hold neither elsewhere, and no
backslash or line feed; none can arise where a text meets the template.

DataFrame functions only. Null roles and texts count as empty, equal turn numbers are ordered by role and text, repeated
rows stay, null conversations form one conversation, extra columns are ignored. A conversation is one output row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the further control strings that no text may hold."""

    open_turn: str = "<|start_header_id|>"
    close_role: str = "<|end_header_id|>"
    end_turn: str = "<|eot_id|>"
    others: tuple[str, ...] = (
        "<s>", "</s>", "[INST]", "[/INST]", "<|begin_of_text|>", "<|end_of_text|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    )

    def __post_init__(self):
        for x in self.controls:
            if len(x) < 2 or x[0] not in "<[" or re.search(r"[<\[\\\n]", x[1:]):
                raise ValueError(f"unfit control string: {x}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open_turn, self.close_role, self.end_turn, *self.others)

    @property
    def family(self) -> str:
        """Control strings, plain or escaped any number of times."""
        rest = "|".join(sorted({re.sub(r"([^\w])", r"\\\1", x[1:]) for x in self.controls}))
        return rf"([<\[])(\\*)({rest})"


LLAMA_STYLE = Template()
#: Line feeds between the role mark and the text.
GAP = "\n\n"


def escape(text: Column, template: Template = LLAMA_STYLE) -> Column:
    return F.regexp_replace(text, F.lit(template.family), F.lit(r"$1\\$2$3"))


def unescape(text: Column, template: Template = LLAMA_STYLE) -> Column:
    return F.regexp_replace(text, F.lit(template.family.replace(r"(\\*)", r"\\(\\*)")), F.lit("$1$2$3"))


def write_turn(role: Column, text: Column, template: Template = LLAMA_STYLE) -> Column:
    return F.concat(F.lit(template.open_turn), role, F.lit(template.close_role + GAP), text, F.lit(template.end_turn))


def parse(formatted: Column, template: Template = LLAMA_STYLE) -> Column:
    """Turns of a formatted text as array of (role, text); a null turn where the text breaks the grammar.

    A text is a run of turns; a role or text holds no control string in its plain form."""
    ends = F.split(formatted, re.sub(r"([^\w])", r"\\\1", template.end_turn))
    opening, closing = len(template.open_turn), len(template.close_role + GAP)
    plain = "|".join(re.sub(r"([^\w])", r"\\\1", x) for x in template.controls)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(opening + 1))
        at = F.instr(body, template.close_role + GAP)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + closing)
        sound = F.startswith(piece, F.lit(template.open_turn)) & (at > 0) & ~role.rlike(plain) & ~text.rlike(plain)
        read = F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))
        return F.when(sound, read)

    whole = F.when(F.element_at(ends, -1) == "", F.slice(ends, F.lit(1), F.size(ends) - 1))
    return F.transform(F.coalesce(whole, F.array(F.lit(""))), turn)


def format_conversations(
    turns: DataFrame, template: Template = LLAMA_STYLE, learn_from: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``formatted``, its ``loss_spans`` (first code point from 1, and length, of every text
    the model learns from, as written) and ``n_escaped`` turns."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    source = F.array(F.struct(F.col("role"), F.col("text")))
    rows = rows.withColumn("same", parse(write_turn(F.col("role"), F.col("text"), template), template) == source)
    clean = F.coalesce("same", F.lit(False))
    rows = rows.select(
        "conv_id", "turn", "role", "text", clean.alias("clean"),
        F.when(clean, F.col("role")).otherwise(escape(F.col("role"), template)).alias("w_role"),
        F.when(clean, F.col("text")).otherwise(escape(F.col("text"), template)).alias("w_text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    frame = len(template.open_turn + template.close_role + GAP)
    length = F.char_length("w_role") + F.char_length("w_text") + frame + len(template.end_turn)
    earlier = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn(
        "start", earlier + F.char_length("w_role") + frame + 1
    )
    learnt = F.when(
        F.col("role").isin(*learn_from), F.struct("nth", F.col("start"), F.char_length("w_text").cast("bigint").alias("length"))
    )
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "role", "text", write_turn(F.col("w_role"), F.col("w_text"), template).alias("w")))).alias("t"),
        F.array_sort(F.collect_list(learnt)).alias("l"),
        F.count_if(~F.col("clean")).alias("n_escaped"),
    )
    whole = whole.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["w"]), "").alias("formatted"),
        F.transform("l", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        "n_escaped", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    broken = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    checked = F.when(parse(F.col("formatted"), template) == F.col("source"), F.col("formatted")).otherwise(broken.cast("string"))
    return whole.select("conv_id", checked.alias("formatted"), "loss_spans", "n_escaped")


def read_back(formatted: DataFrame, template: Template = LLAMA_STYLE) -> DataFrame:
    """Turns and learnt text of formatted conversations, from the output alone."""
    learnt = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")), template)
    )
    return formatted.select(
        "conv_id", "formatted", "n_escaped", parse(F.col("formatted"), template).alias("turns"), F.array_join(learnt, "").alias("learnt")
    )
