"""Chat formatting from event logs, in DataFrame operations only.

``reconstruct`` folds an event log into final messages: events are partitioned by conversation and sorted by
sequence; a ``message`` event opens a message at its turn, ``delta`` appends to it, ``edit`` replaces its
text, and ``regenerate`` drops the text so far, after which deltas build it anew. ``render`` writes each
conversation with turn marks and a loss mask over assistant texts; ``parse`` reads the rendered string back.

Edge cases: null role or text is empty; a delta without a message opens one; repeated (conversation, turn)
``message`` rows are separate messages, ordered by role and text; ties in seq fold in the order message,
regenerate, edit, delta, then text; a null conversation id is a conversation of its own; an empty log gives
no rows; columns beyond the six named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
EVENTS = ("conv_id", "turn", "seq", "kind", "role", "text")


def escape(text: Column) -> Column:
    """No ``<|`` is left: each ``<\\\\...|`` gains one backslash, which :func:`unescape` takes away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def as_events(messages: DataFrame) -> DataFrame:
    """Finished (conv_id, turn, role, text) rows as a log of ``message`` events."""
    return messages.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, part (of repeated turns, from 0), role, text.

    One exchange, by conversation; the windows and the aggregation reuse it.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for x in ("message", 0, "regenerate", 1, "edit", 2, "delta", 3))), F.col("kind"))
    log = events.select(*EVENTS[:4], F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), rank.alias("_rank"))
    log = log.repartition("conv_id")
    turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "_rank", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("_n", F.count(F.lit(1)).over(turn)).withColumn("part", F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(turn))
    part = Window.partitionBy("conv_id", "turn", "part")
    log = log.withColumn("role", F.coalesce(F.min(F.when(F.col("role") != "", F.struct("_n", "role"))).over(part)["role"], F.lit("")))
    log = log.withColumn("_from", F.max(F.when(F.col("kind") != "delta", F.col("_n"))).over(part))
    live = log.where("_from IS NULL OR _n >= _from")
    events_of = F.sort_array(F.collect_list(F.struct("_n", "text")))
    folded = live.groupBy("conv_id", "turn", "part").agg(F.first("role").alias("role"), events_of.alias("_e"))
    return folded.select("conv_id", "turn", "part", "role", F.array_join(F.transform("_e", lambda e: e.text), "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (code-point start and end of each text to learn)."""
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = messages.withColumn("_head", head).withColumn("_body", escape(F.col("text")))
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n"))).withColumn("_len", F.length("_piece").cast("long"))
    before = Window.partitionBy("conv_id").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.sum("_len").over(before) - F.col("_len") + F.length("_head"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("_at").alias("start"), (F.col("_at") + F.length("_body")).alias("end")))
    gathered = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "part", "_piece", span.alias("_span")))).alias("_p"))
    spans = F.filter(F.transform("_p", lambda p: p["_span"]), lambda s: s.isNotNull())
    return gathered.select("conv_id", "n_turns", F.array_join(F.transform("_p", lambda p: p["_piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered conversation."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        text = F.substring(piece, at + 1, F.length(piece) - at - F.lit(len(END) + 1))
        return F.struct(_unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def digest(rendered: DataFrame) -> DataFrame:
    """What the rendered conversations say, read back from them."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
    out = rendered.select("conv_id", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
