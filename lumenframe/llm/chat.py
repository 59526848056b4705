"""Conversations as training text: budgeted, turn-aligned windows with a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

# The template. Angle and square brackets and the ampersand are escaped inside roles and texts, so no text
# can hold a control string, whichever it is.
OPEN, CLOSE = "<s>", "</s>"
NEW, PAST = "TURN", "PAST"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;"))
_PIECE = rf"\[({NEW}|{PAST}) ([^\[\]<>]*)\]([^\[\]<>]*)\[/\1\]"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _prefix_sums(turns: DataFrame, chunk: int) -> DataFrame:
    """Adds idx (0-based) and upto (tokens up to and with the turn), in two levels.

    Turns are first totalled by runs of ``chunk`` turn numbers; only the totals meet by conversation, so a very
    long conversation is not sorted by one task.
    """
    # never null, so that the join and the window below share one shuffle of the texts
    turns = turns.withColumn("run", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 63))))
    keys = ["cid", "cnull", "run"]
    totals = turns.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    earlier = W.partitionBy("cid", "cnull").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    placed = turns.join(totals, keys)
    inside = W.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    return placed.select(
        "cid", "cnull", "role", "text", "tokens",
        (F.col("n0") + F.row_number().over(W.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1).alias("idx"),
        (F.col("s0") + F.sum("tokens").over(inside)).alias("upto"),
    )


def format_chats(
    conversations: DataFrame,
    budget: int = 1024,
    history_turns: int = 4,
    history_tokens: int = 256,
    chunk: int = 512,
) -> DataFrame:
    """Rows (conv_id, window, formatted, loss_spans, tokens) of ``conversations`` (conv_id, turn, role, text).

    A turn counts a token for every four code points begun, and four for its marks. Prefix sums of these
    cut a conversation into windows of whole turns: a window's room is the budget less the system turn and
    the history allowance (a quarter of the budget at least). A turn that straddles two rooms and
    would overfill the later one is a window of its own; a turn longer than the room is too, over budget and whole.
    Each window opens with the conversation's system turn (a first turn of role ``system``), then repeats
    up to ``history_turns`` turns within ``history_tokens`` before it. Repeated turns are marked as past
    and are never trained on again: ``loss_spans`` are [start, end) code points in ``formatted`` of the new assistant
    texts, so each assistant text is under the mask exactly once.

    Turns are ordered by turn, then role, then text; repeated rows are turns of their own. Null role or text
    is empty; null turn comes first; null conv_id is a conversation of its own. An empty table gives
    an empty result. Windows are put together by (conversation, window), never by conversation.
    """
    cid, text = F.col("conv_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.coalesce(cid, F.lit(0).cast("long")).alias("cid"), cid.isNull().alias("cnull"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"),
        (F.ceil(F.char_length(text) / 4) + 4).cast("long").alias("tokens"),
    )
    conv = ["cid", "cnull"]
    placed = materialize(_prefix_sums(turns, chunk), "turns")
    leads = (F.col("idx") == 0) & (F.col("role") == "system")
    # windows are laid out over the turns' sizes; texts join them once, at the end
    system = placed.filter(leads).select(*conv, F.col("tokens").alias("s_tokens"))
    body = (
        placed.filter(~leads).select(*conv, "idx", "tokens", "upto").join(system, conv, "left")
        .withColumn("s_tokens", F.coalesce("s_tokens", F.lit(0)))
        .withColumn("room", F.greatest(F.lit(budget) - F.lit(history_tokens) - F.col("s_tokens"), F.lit(max(budget // 4, 1))))
        .withColumn("end", F.col("upto") - F.col("s_tokens"))
        .withColumn("start", F.col("end") - F.col("tokens"))
        .withColumn("slot", F.floor((F.col("end") - 1) / F.col("room")))
    )
    in_slot = W.partitionBy(*conv, "slot")
    straddles = F.col("start") < F.col("slot") * F.col("room")
    body = body.withColumn("window", 2 * F.col("slot") + F.when(F.sum("tokens").over(in_slot) > F.col("room"), (~straddles).cast("long")).otherwise(1))
    body = materialize(body.select(*conv, "idx", "window", "start"), "layout")
    windows = body.groupBy(*conv, "window").agg(F.min("idx").alias("first"), F.min("start").alias("at"))

    parts = body.select(*conv, "window", "idx", F.lit(True).alias("fresh"))
    if history_turns > 0:
        past_idx = F.explode(F.sequence(F.greatest(F.col("first") - history_turns, F.lit(0)), F.col("first") - 1))
        wanted = windows.filter("first > 0").select(*conv, F.col("window").alias("into"), "at", past_idx.alias("idx"))
        past = body.join(wanted, [*conv, "idx"]).filter(F.col("at") - F.col("start") <= history_tokens)
        parts = parts.unionByName(past.select(*conv, F.col("into").alias("window"), "idx", F.lit(False).alias("fresh")))
    led = system.join(windows, conv, "left").select(
        *conv, F.coalesce("window", F.lit(0).cast("long")).alias("window"), F.lit(0).cast("long").alias("idx"), (F.coalesce("first", F.lit(1)) == 1).alias("fresh")
    )
    parts = parts.unionByName(led).join(placed.select(*conv, "idx", "role", "text", "tokens"), [*conv, "idx"])

    tag = F.when(F.col("fresh"), NEW).otherwise(PAST)
    parts = (
        parts.withColumn("body", escape(F.col("text")))
        .withColumn("head", F.concat(F.lit("["), tag, F.lit(" "), escape(F.col("role")), F.lit("]")))
        .withColumn("piece", F.concat("head", "body", F.lit("[/"), tag, F.lit("]")))
    )
    before = W.partitionBy(*conv, "window").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + len(OPEN) + F.char_length("head")
    parts = parts.withColumn("begin", begin)
    span = F.when(F.col("fresh") & (F.col("role") == "assistant"), F.struct(F.col("begin").alias("start"), (F.col("begin") + F.char_length("body")).alias("end")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "piece"))), lambda p: p["piece"]), "")
    return (
        parts.groupBy(*conv, "window")
        .agg(F.concat(F.lit(OPEN), joined, F.lit(CLOSE)).alias("formatted"), F.sort_array(F.collect_list(span)).alias("loss_spans"), F.sum("tokens").alias("tokens"))
        .select(F.when(~F.col("cnull"), F.col("cid")).alias("conv_id"), "window", "formatted", "loss_spans", "tokens")
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, window, turns, loss_texts, formatted_chars): the new turns of each window, unescaped.

    ``turns`` are (role, text) in order; ``loss_texts`` are what stands under the mask.
    """
    pattern = F.lit(_PIECE)
    pieces = F.arrays_zip(
        F.regexp_extract_all("formatted", pattern, F.lit(1)).alias("tag"),
        F.regexp_extract_all("formatted", pattern, F.lit(2)).alias("role"),
        F.regexp_extract_all("formatted", pattern, F.lit(3)).alias("text"),
    )
    fresh = F.filter(pieces, lambda p: p["tag"] == NEW)
    return formatted.select(
        "conv_id",
        "window",
        F.transform(fresh, lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["text"]).alias("text"))).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ).alias("loss_texts"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_digests(read: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is over a conversation's whole text, so that text has to meet in one row here; windows are
    already joined strings by then. The formatting itself has no such step.
    """
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    each = read.select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), "formatted_chars",
        F.array_join(F.transform("turns", line), "").alias("said"), F.array_join("loss_texts", "").alias("lost"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "said", "lost"))).alias("w")
    )
    digest = lambda field: F.sha2(F.encode(F.array_join(F.transform("w", lambda x: x[field]), ""), "utf-8"), 256)
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["lost"]))
    return whole.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), chars.alias("loss_chars"), digest("lost").alias("loss_sha256"), "formatted_chars")
