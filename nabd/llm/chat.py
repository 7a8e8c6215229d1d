"""Chat formatting: a role machine and a declarative template.

A finite-state machine over roles decides whether the turns of a conversation follow each other as
they may. Each turn becomes three segments: its mark, its text, and its end; a loss flag tells which
segments count for training. Texts are escaped so that no control string of the template can occur
inside one, and the escape is reversed exactly when the output is read back.

Turns are ordered by turn number, equal numbers by role and text, nulls first; repeated rows are
repeated turns. A null text or role is empty. Rows without a conversation id form one conversation.
A role the machine doesn't know makes the conversation invalid; it is formatted all the same.
Extra columns are ignored. Empty tables give empty results. A conversation is one output row, so it
is gathered in one place; nothing larger is.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. Control strings must begin with `<|`, which escaped texts never hold."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "start"
    #: state -> the roles that may follow; a role is the state it leads to.
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("control strings begin with <|")


CHAT = Template()


def escape(text: Column) -> Column:
    """Backslashes are doubled, so the single ones put after a `<` can be told from them."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends with its line, so line breaks inside one are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def _valid(roles: Column, template: Template) -> Column:
    """Run the machine; a move that isn't listed leads to null for good."""

    def step(state: Column, role: Column) -> Column:
        after = F.lit(None).cast("string")
        for source, targets in template.moves.items():
            after = F.when((state == source) & role.isin(*targets), role).otherwise(after)
        return after

    last = F.aggregate(roles, F.lit(template.first), step)
    return F.coalesce(last.isin(*template.final), F.lit(False))


def format_conversations(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, valid, segments, formatted): segments are (text, loss), formatted is their text."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        mark = F.concat(F.lit(template.start), escape_role(t["role"]), F.lit("\n"))
        parts = (
            (mark, F.lit(False)),
            (escape(t["text"]), t["role"].isin(*template.loss_roles)),
            (F.lit(template.end + "\n"), F.lit(False)),
        )
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    cut = turns.select(
        "conv_id",
        _valid(F.transform("turns", lambda t: t["role"]), template).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation, read back from its text alone."""
    parts = F.split(formatted, r"\Q" + template.start + r"\E", -1)
    tail = len(template.end) + 1

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        body = F.substr(part, line + 1, F.length(part) - line - tail)
        return F.struct(
            unescape_role(F.substr(part, F.lit(1), line - 1)).alias("role"),
            unescape(body).alias("text"),
        )

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def digest(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the output says, read back from it: turns, text under the loss mask, and lengths."""
    done = format_conversations(conversations, template)
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = done.select(
        "conv_id",
        "valid",
        parse(F.col("formatted"), template).alias("turns"),
        F.array_join(masked, "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
