"""Chat formatting: turns to training text by a declarative template, with loss flags.

``TEMPLATE`` names for each role what opens and closes a turn and whether its text counts for the
loss; ``TURNS`` is the finite-state machine of allowed role orders. Both are data: the operator
folds a conversation's roles through the machine and emits text segments, all in DataFrame
functions. Control strings inside texts are broken by a backslash after their first character, and
backslashes are doubled, so texts can be read back and no text can forge a marker.

Defined results: null text and null role are empty, a role that the template doesn't know gets the
general marker with its name. Turns are ordered by turn (nulls first), ties by role and text, and a
row that comes twice is two turns. A turn that the machine doesn't allow is still formatted, counted
as a violation, and the machine goes on from its role. A null conv_id is a conversation of its own.
Texts of any length are formatted whole; a conversation is one row, so its turns are gathered in one task.
An empty table gives an empty result. Columns other than the four named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (opening marker, closing marker, whether the text is learnt from)
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s> ", " </s>\n", True),
}
#: Any other role; its name stands between the two parts of the opening marker.
GENERAL = (("<<ROLE>>", "<</ROLE>>\n"), "\n<<END>>\n")
#: state -> roles that may come next; a role is the next state.
TURNS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Control strings by their first character and the rest.
_CONTROL = r"([<\[])(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|<END>>)"
_TURN = r"(?s)(<<SYS>>\n|\[INST\] |<s> |<<ROLE>>.*?<</ROLE>>\n)(.*?)(?:\n<</SYS>>\n\n| \[/INST\]| </s>\n|\n<<END>>\n)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, known, other: Column) -> Column:
    out = other
    for name, row in TEMPLATE.items():
        out = F.when(role == name, F.lit(known(row))).otherwise(out)
    return out


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, segments (array of text, loss), formatted (their texts joined), n_violations."""
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    d = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = F.create_map(*[F.lit(x) for s, roles in TURNS.items() for r in roles for x in (f"{s}\n{r}", True)])
    start = F.struct(F.lit("").alias("state"), F.lit(0).cast("long").alias("bad"))
    fold = F.aggregate(
        "turns",
        start,
        lambda a, t: F.struct(
            t["role"].alias("state"),
            (a["bad"] + F.when(F.element_at(allowed, F.concat(a["state"], F.lit("\n"), t["role"])).isNull(), 1).otherwise(0)).alias("bad"),
        ),
        lambda a: a["bad"],
    )

    def segments(t: Column) -> Column:
        role, text = t["role"], escaped(t["text"])
        opening = _by_role(role, lambda r: r[0], F.concat(F.lit(GENERAL[0][0]), escaped(role), F.lit(GENERAL[0][1])))
        closing = _by_role(role, lambda r: r[1], F.lit(GENERAL[1]))
        part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(text, _by_role(role, lambda r: r[2], F.lit(False))), part(closing, F.lit(False)))

    d = d.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), fold.alias("n_violations"))
    return d.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "n_violations")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role, text), as its formatted text alone tells them."""
    marks, texts = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1)), F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2))

    def turn(mark: Column, text: Column) -> Column:
        a, b = GENERAL[0]
        role = unescaped(F.substring(mark, F.lit(len(a) + 1), F.length(mark) - (len(a) + len(b))))
        for name, row in TEMPLATE.items():
            role = F.when(mark == row[0], F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return formatted.withColumn("turns", F.zip_with(marks, texts, turn))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
