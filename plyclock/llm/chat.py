"""Chat formatting with spans found by rendering ever longer prefixes.

A template is a black box: a function from a list of (role, text) to a string.  The
conversation is rendered turn by turn.  Where an output starts with the one before,
the rest is the span of the new turn; where it does not, the template rewrites its
history, which is reported.  The text inside a turn is found by rendering the turn
with two other texts: outputs differ only where the text goes.  With a template that
rewrites history the last rendering, in full, is what is compared.

Texts are escaped before they are rendered, so no text can pass for a mark.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F

#: Strings that structure the default template's output.
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|\[/?ROLE")
ESCAPED = re.compile(r"\\(\\|</?s>|\[/?INST\]|\[/?ROLE|\])")
LOSS_ROLES = ("assistant",)


def escape(text):
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text):
    return ESCAPED.sub(r"\1", text)


def inst_template(turns):
    """The default: user turns in [INST], answers closed by </s>, other roles named."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s>[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
        else:
            name = escape(role).replace("]", "\\]")
            out.append(f"<s>[ROLE {name}] {text} [/ROLE]")
    return "".join(out)


ROLE_NAME = re.compile(r"(?:\\.|[^\\\]])*", re.DOTALL)


def read_inst(formatted):
    """The turns of an output of the default template: ``(role, text, start, end)``.

    Every mark inside a text has a backslash before it, so a mark after a blank is the
    template's own.
    """
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("<s>[INST] ", at):
            role, start, close = "user", at + 10, " [/INST]"
        elif formatted.startswith("<s>[ROLE ", at):
            name = ROLE_NAME.match(formatted, at + 9)
            role, start, close = unescape(name[0]), name.end() + 2, " [/ROLE]"
        elif formatted.startswith(" ", at):
            role, start, close = "assistant", at + 1, " </s>"
        else:
            raise ValueError(f"no turn begins at {at}")
        end = formatted.find(close, start)
        if end < 0:
            raise ValueError(f"the turn at {at} has no end")
        turns.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(close)
    return turns


def common_prefix(a, b):
    """The length of what two strings begin with alike, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def inner_span(template, turns, i, rendered):
    """Where turn ``i``'s text lies in ``rendered``, the output of ``turns``."""
    one, other = (template([*turns[:i], (turns[i][0], probe), *turns[i + 1:]]) for probe in "AB")
    start = common_prefix(one, other)
    tail = len(one) - start - 1
    if len(one) != len(other) or one[start + 1:] != other[start + 1:]:
        return None
    return start, len(rendered) - tail


def format_conversation(turns, template=inst_template, loss_roles=LOSS_ROLES):
    """``(formatted, spans, loss, rewrites)`` of a list of escaped turns.

    ``spans`` has a (start, end) per turn, or none at all where history is rewritten;
    ``loss`` has one per turn of a loss role, in order; ``rewrites`` is the number of
    the first turn that changes what came before, or None.
    """
    before, spans, loss, rewrites = "", [], [], None
    for i in range(len(turns)):
        now = template(turns[:i + 1])
        if rewrites is None and not now.startswith(before):
            rewrites = i
        spans.append((len(before), len(now)))
        if rewrites is None and turns[i][0] in loss_roles:
            loss.append(inner_span(template, turns[:i + 1], i, now))
        before = now
    if rewrites is not None:
        spans = []
        loss = [inner_span(template, turns, i, before)
                for i in range(len(turns)) if turns[i][0] in loss_roles]
    return before, spans, loss, rewrites


def format_conversations(rows, template=inst_template, loss_roles=LOSS_ROLES):
    """One row per conversation of ``rows`` (conv_id, turn, role, text).

    ``conv_id, n_turns, formatted, turn_starts, turn_ends, loss_starts, loss_ends,
    rewrites_at``.  Turns go by number, then role and text; a null number comes first.
    A null text or role counts as empty; rows with a null conv_id are one conversation;
    repeated rows are repeated turns; an empty table gives no rows; other columns are
    not looked at.  A turn whose text the template does not show as it is gets the
    loss span null.  One conversation is held in one task at a time, as its output is.
    """
    ordered = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    places = pa.list_(pa.int32())
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("turn_starts", places), ("turn_ends", places), ("loss_starts", places),
        ("loss_ends", places), ("rewrites_at", pa.int32())])

    def row(name, turns):
        text, spans, loss, rewrites = format_conversation(turns, template, loss_roles)
        loss = [s or (None, None) for s in loss]
        return {
            "conv_id": name, "n_turns": len(turns), "formatted": text,
            "turn_starts": [a for a, _ in spans], "turn_ends": [b for _, b in spans],
            "loss_starts": [a for a, _ in loss], "loss_ends": [b for _, b in loss],
            "rewrites_at": rewrites}

    def run(batches):
        name, turns, out = None, [], []
        for batch in batches:
            for conv, role, text in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True,
            ):
                if turns and conv != name:
                    out.append(row(name, turns))
                    turns = []
                name = conv
                turns.append((role, escape(text)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if turns:
            yield pa.RecordBatch.from_pylist([row(name, turns)], schema)

    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, formatted string, turn_starts array<int>, turn_ends array<int>, "
             "loss_starts array<int>, loss_ends array<int>, rewrites_at int")
