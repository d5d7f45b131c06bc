"""Conversations as training texts: windows of whole turns under a token budget, with a loss mask.

A turn is written ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed. Control strings inside
texts and roles are escaped so that they can be read back: ``<`` and ``|`` with any number of backslashes between them
get one more; in a role ``|``, line feeds and backslashes have names. So a marker in the output is always the template's.

Prefix sums of the turns' tokens choose the spans: a window takes new turns while the sum since its first one fits the
budget less the room for the system turn and for history. Each window repeats the conversation's first system turn and
the last turns before its own, up to ``history`` tokens. The loss mask covers the texts of new turns of one role only,
so that a target counts once however often it is repeated.

Everything is native expressions. A conversation is cut into blocks of ``BLOCK`` turn numbers, so that no group holds a
long one; a block also gets the last ``REACH`` turns before it as possible history. Its first new turn starts a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers of a block, and how many of the last before it are at hand as history.
BLOCK, REACH = 256, 64


def escaped(text: Column) -> Column:
    """Reversible text without ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """Reversible role on one line without ``|``."""
    for a, b in (("\\", "\\b"), ("\n", "\\n"), ("|", "\\p")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescaped_role(role: Column) -> Column:
    for a, b in (("\\p", "|"), ("\\n", "\n"), ("\\b", "\\")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def written(turns: Column) -> Column:
    """Turns in template form, one after the other."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")


def estimated_tokens(role: Column, text: Column) -> Column:
    """A quarter of the bytes of an escaped turn, rounded up, and four for the template."""
    return F.ceil((F.octet_length(role) + F.octet_length(text)) / F.lit(4)).cast("bigint") + 4


def format_windows(
    df: DataFrame, budget: int = 2048, history: int = 512, target: str = "assistant", count_col: str | None = None,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``conv_id, block, window, text, new_at, spans, n_turns, n_tokens``: one row per window.

    ``new_at`` is the place (in code points, from 0) at which the window's new turns begin; ``spans`` are the
    ``start, length`` of the masked texts within ``text``, in order; ``n_turns`` counts new turns and ``n_tokens`` all
    tokens. ``count_col`` names exact token counts of the turns (null: 0); without it they are estimated.

    Turns go by number, then role, then text (as escaped); repeated rows are turns each. Null texts and roles are empty, null and
    negative numbers come first, a null id is a conversation of its own. No turn is cut: one that is longer than the
    room has a window for itself, above the budget. The room for new turns is never below a quarter of the budget, so
    a very long system turn also exceeds it. An empty table gives no rows.
    """
    c = lambda name: F.col(f"`{name}`")
    role, text = escaped_role(F.coalesce(c(role_col), F.lit(""))), escaped(F.coalesce(c(text_col), F.lit("")))
    rows = df.select(
        c(id_col).isNotNull().alias("known"), F.coalesce(c(id_col), F.lit(0).cast(df.schema[id_col].dataType)).alias("conv"),
        c(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), *([c(count_col).alias("given")] if count_col else []),
    )
    n = F.coalesce(F.col("given").cast("bigint"), F.lit(0).cast("bigint")) if count_col else estimated_tokens(F.col("role"), F.col("text"))
    rows = rows.withColumn("n", n).withColumn("home", F.greatest(F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(0)), F.lit(0)).cast("bigint"))
    turn = F.struct("turn", "role", "text", "n")
    system = F.min(F.when(F.col("role") == "system", turn))
    keys = ["known", "conv"]

    first = rows.filter("home = 0").groupBy(*keys).agg(F.collect_list(F.struct("turn", "role", "text", "n", F.lit(True).alias("own"))).alias("turns"), system.alias("system"))
    first = first.withColumn("block", F.lit(0).cast("bigint"))
    shown = F.when(F.pmod("turn", F.lit(BLOCK)) >= BLOCK - REACH, F.array("home", F.col("home") + 1)).otherwise(F.array("home"))
    later = rows.filter(f"turn >= {BLOCK - REACH}").withColumn("block", F.explode(shown)).filter("block > 0")
    entry = F.struct("turn", "role", "text", "n", (F.col("block") == F.col("home")).alias("own"))
    later = later.groupBy(*keys, "block").agg(F.collect_list(entry).alias("turns")).filter(F.exists("turns", lambda t: t["own"]))
    spoken = rows.filter("role = 'system'").groupBy(*keys).agg(system.alias("system"))
    later = later.join(spoken, keys, "left")
    units = first.unionByName(later).withColumn("turns", F.sort_array("turns"))

    ends = F.aggregate("turns", F.array(F.lit(0).cast("bigint")), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t["n"])))
    units = units.select("*", ends.alias("ends"), F.size(F.filter("turns", lambda t: ~t["own"])).alias("old"), F.size("turns").alias("m"))
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.n"), F.lit(0)), F.lit(budget // 4))
    units = units.withColumn("room", room)
    full = lambda s, i: (i > F.element_at(s, -1)) & (F.get("ends", i + 1) - F.get("ends", F.element_at(s, -1)) > F.col("room"))
    cuts = F.aggregate(F.sequence("old", F.col("m") - 1), F.array("old"), lambda s, i: F.when(full(s, i), F.concat(s, F.array(i))).otherwise(s))
    units = units.withColumn("cuts", F.concat(cuts, F.array("m")))
    back = lambda at: F.size(F.filter(F.sequence(F.lit(0), at), lambda j: F.get("ends", at) - F.get("ends", j) > history))
    bounds = F.transform(
        F.sequence(F.lit(0), F.size("cuts") - 2),
        lambda k: F.struct(k.alias("k"), back(F.get("cuts", k)).alias("since"), F.get("cuts", k).alias("a"), F.get("cuts", k + 1).alias("b")),
    )
    w = units.select("*", F.explode(bounds).alias("w"))
    past = F.slice("turns", F.col("w.since") + 1, F.col("w.a") - F.col("w.since"))
    new = F.slice("turns", F.col("w.a") + 1, F.col("w.b") - F.col("w.a"))
    shown_first = F.get("turns", F.col("w.since"))
    same = lambda t: F.struct(t["turn"], t["role"], t["text"])
    missing = F.col("system").isNotNull() & (same(F.col("system")) < same(shown_first))
    kept = F.when(missing, F.array("system")).otherwise(F.array().cast("array<struct<turn:bigint,role:string,text:string,n:bigint>>"))
    before = F.concat(written(kept), written(past))
    w = w.select(*keys, "block", F.col("w.k").alias("window"), before.alias("before"), new.alias("new"),
                 (F.get("ends", F.col("w.b")) - F.get("ends", F.col("w.since")) + F.when(missing, F.col("system.n")).otherwise(0)).alias("n_tokens"))
    w = w.withColumn("new_at", F.length("before"))
    begin = F.struct(F.col("new_at").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(s: Column, t: Column) -> Column:
        at = s["at"] + F.length(head(t))
        span = F.when(t["role"] == target, F.array(F.struct(at.alias("start"), F.length(t["text"]).alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((at + F.length(t["text"]) + len(END)).alias("at"), F.concat(s["spans"], span).alias("spans"))

    spans = F.aggregate("new", begin, place)["spans"]
    return w.select(
        F.when(F.col("known"), F.col("conv")).alias(id_col), "block", "window", F.concat("before", written(F.col("new"))).alias("text"),
        "new_at", spans.alias("spans"), F.size("new").cast("bigint").alias("n_turns"), "n_tokens",
    )


def new_turns(text: Column) -> Column:
    """``role, text`` of each turn of a template text, read back."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")
    line = lambda p: F.instr(p, F.lit("\n"))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(F.substring(p, F.lit(len(START) + 1), line(p) - len(START) - 1)).alias("role"),
            unescaped(F.substring(p, line(p) + 1, F.length(p))).alias("text"),
        ),
    )


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the mask, read back, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``n_turns, turns, loss, formatted_chars`` of each conversation, from its windows alone.

    ``turns`` has role, line feed, text, line feed for each turn; ``loss`` all text under the mask. Both hold a whole
    conversation. Only the new part of a window moves, once.
    """
    part = F.struct(
        "block", "window", F.substring(F.col("text"), F.col("new_at") + 1, F.length("text")).alias("text"),
        F.transform("spans", lambda s: F.struct((s["start"] - F.col("new_at")).alias("start"), s["length"].alias("length"))).alias("spans"),
    )
    own = windows.select(id_col, part.alias("part"), F.length("text").cast("bigint").alias("chars"))
    whole = own.groupBy(id_col).agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("parts", lambda p: new_turns(p["text"])))
    whole = whole.withColumn("read", turns)
    return whole.select(
        id_col, F.size("read").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(F.transform("parts", lambda p: masked_text(p["text"], p["spans"])), "").alias("loss"), "formatted_chars",
    )
