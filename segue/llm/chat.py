"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### role: text`` and closed by ``</turn>`` on its own line::

    ### user: hello
    </turn>

The parser is deterministic: every ``### `` and ``</turn>`` that no backslash precedes is
a control string, whatever stands around it; a run of backslashes before one in a text
loses one backslash.  Each rendered turn is parsed again and compared with its source.  A
turn that does not come back is rendered at the next level of escaping: first as it is,
then with its turn ends escaped, then with every control string escaped.  The last level
always comes back, since adding one backslash to each run before a control string is
undone exactly by taking one away, and the template's own control strings follow a line
break or the start.

Defined results: null texts and roles are empty; rows are ordered by (turn, role, text)
with nulls first, so ties and repeated rows have one order and all stay; rows whose
conv_id is null form one conversation; an empty table gives no rows; columns other than
the four named are ignored.  A conversation is one training text, so its turns meet in
one row, which is the unit the output is made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>"
HEADER = "### "
_ANY = f"(?:{TURN_END}|{HEADER})"
_FREE = rf"(?<!\\){_ANY}"  # a control string in force
# fixed values: how a role writes the four characters that could end or fake its header
_ROLE_CODES = [("\\", "\\b"), (":", "\\c"), ("<", "\\l"), ("#", "\\h")]
LOSS_ROLE = "assistant"


def _role_written(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_read(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _escaped(text: Column, control: str) -> Column:
    # possessive and anchored at the start of a run: linear however long the run is
    return F.regexp_replace(text, rf"(?<!\\)(\\*+{control})", r"\\$1")


def unescape(text: Column) -> Column:
    """Undo the escaping of any level."""
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+{_ANY})", "$1")


def content_at(level: Column, text: Column) -> Column:
    """A text as level 0, 1 or 2 writes it."""
    return F.when(level == 0, text).when(level == 1, _escaped(text, TURN_END)).otherwise(_escaped(text, _ANY))


def render_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(HEADER), _role_written(role), F.lit(": "), content, F.lit(f"\n{TURN_END}\n"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text, as array<struct<role, text>>.

    Between control strings stand in turn nothing or a line break, and a turn.
    """

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ": ", 1)
        text = F.substr(piece, F.length(role) + 3, F.length(piece) - F.length(role) - 3)
        return F.struct(_role_read(role).alias("role"), unescape(text).alias("text"))

    pieces = F.split(formatted, _FREE, -1)
    return F.transform(F.filter(pieces, lambda _, i: i % 2 == 1), turn)


def escape_level(role: Column, text: Column) -> Column:
    """Smallest level at which the rendered turn is read back identical."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))

    def same(level: int) -> Column:
        return parse(render_turn(role, content_at(F.lit(level), text))) == source

    lost = F.raise_error(F.lit("a turn does not survive the round trip")).cast("int")
    return F.when(same(0), 0).when(same(1), 1).when(same(2), 2).otherwise(lost)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, segments, formatted): one row per conversation.

    ``segments`` are pieces of text with a flag; joined they give ``formatted``, and the
    flagged ones are under the loss mask: the assistant's texts as written there.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("level", escape_level(F.col("role"), F.col("text")))
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "level"))).alias("turns")
    )

    def pieces(t: Column) -> Column:
        def piece(text, loss):
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            piece(F.concat(F.lit(HEADER), _role_written(t["role"]), F.lit(": ")), F.lit(False)),
            piece(content_at(t["level"], t["text"]), t["role"] == LOSS_ROLE),
            piece(F.lit(f"\n{TURN_END}\n"), F.lit(False)),
        )

    return (
        grouped.select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.flatten(F.transform("turns", pieces)).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader recovers from ``formatted`` and its mask."""
    read = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "loss",
        F.array_join(
            F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
        ),
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
