"""Chat formatting by a declarative template, with a state machine over roles. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import needed

CHUNK_TURNS = 256


@dataclass(frozen=True)
class Template:
    """A turn is written as start, role, after_role, text, end; text of roles in `learned` counts for the loss.

    `moves` maps a state to the roles that may follow, and each role names the next state. `final` are the
    states in which a conversation may stop. Every control string begins with `opener`, which never occurs
    in an escaped text.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    opener: str = "<|"
    learned: tuple[str, ...] = ("assistant",)
    moves: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "begin": ("system", "user"), "system": ("user",), "user": ("assistant",),
            "assistant": ("user", "tool"), "tool": ("assistant", "tool"),
        }
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    """Reversible: a backslash becomes `\\s`, a newline `\\n` only where asked, the opener gets `\\p` inside."""
    opener = template.opener
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(out, F.lit(opener), F.lit(opener[0] + "\\p"))


def unescape(text: Column, template: Template = CHATML) -> Column:
    """After escaping, each backslash stands before s, n or p only, so plain replacements in this order undo it."""
    opener = template.opener
    out = F.replace(text, F.lit(opener[0] + "\\p"), F.lit(opener))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column, template: Template = CHATML) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column, template: Template = CHATML) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")), template)


def end_state(roles: Column, template: Template = CHATML) -> Column:
    """The state that the machine reaches over an array of roles, or `error`."""

    def move(state: Column, role: Column) -> Column:
        ahead = F.lit("error")
        for at, allowed in template.moves.items():
            ahead = F.when((state == at) & role.isin(*allowed), role).otherwise(ahead)
        return ahead

    return F.aggregate(roles, F.lit("begin"), move)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments, valid.

    segments: array of (text, loss); joined they are `formatted`. Only the text of a learned role has
    loss = true. valid: the roles follow the template's moves and stop in a final state; others are
    formatted all the same.

    Rows go by turn (nulls last), equal turns by role, then text. Null role or text count as empty. A null
    conv_id makes one conversation of its own. Repeated rows are repeated turns. Other columns are not read.
    Turns are first put together in stretches of 256 turn numbers, so that a very long conversation is
    formatted by several tasks; only the finished stretches meet in one row.
    """
    rows = needed(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").isNull().alias("no_turn"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("stretch", F.floor(F.coalesce("turn", F.lit(0)) / CHUNK_TURNS))

    def written(t: Column) -> Column:
        is_learned = t["role"].isin(*template.learned)
        head = F.concat(F.lit(template.start), escape_role(t["role"], template), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), is_learned.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    stretches = rows.groupBy("conv_id", "no_turn", "stretch").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    ).select(
        "conv_id", "no_turn", "stretch",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.flatten(F.transform("turns", written)).alias("segments"),
    )
    chats = stretches.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("no_turn", "stretch", "roles", "segments"))).alias("parts")
    ).select(
        "conv_id",
        F.flatten(F.transform("parts", lambda p: p["roles"])).alias("roles"),
        F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"),
    )
    return chats.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        end_state(F.col("roles"), template).isin(*template.final).alias("valid"),
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns, array of (role, text), that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, r"\Q" + template.end + r"\E"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, len(template.start) + 1, 2147483647)
        role = F.substring_index(body, template.after_role, 1)
        text = F.substring(body, F.length(role) + len(template.after_role) + 1, F.lit(2147483647))
        return F.struct(unescape_role(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"], template)), "")


def digest_chats(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, read from the output."""
    turns = read_back(F.col("formatted"), template)
    loss = loss_text(F.col("segments"), template)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid"
    ).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "valid",
    )
