"""Chat windows of a token budget, and their reader, by DataFrame functions only.

Prefix sums of turn tokens lay the turns of a conversation (but for a leading
system turn) on one line, which is cut into cells of equal length.  A window
holds the turns that start in a cell; a turn that would run over the cell's end
by more than the history's share stands alone in a window behind it.  Every
window begins with the system turn and with as many whole turns before it as fit
the history's share and what the budget leaves.  Only turns that a window is the
first to hold are targets: repeated ones are masked.

Sums run inside blocks of turn numbers and over the blocks' totals, and windows
are put together by (conversation, cell), so a conversation of any length is
spread; what one task must hold is a block or a cell.

A text is ``<|im_start|>role<|im_sep|>text<|im_end|>`` a turn.  Inside roles and
texts a backslash goes before each backslash and each ``|`` behind ``<``, so no
mark can be written there, and is taken away again when read.

Defined results: null texts and roles are empty; turns go by (turn, role, text),
null turns last; repeated rows are turns of their own; rows of a null
conversation are one conversation; a turn longer than the budget is never cut
and has a window of its own that exceeds it; only the role ``assistant`` is a
target, only a first turn of the role ``system`` is retained.  An empty table
gives an empty table; extra columns are ignored, whatever their names.  Rows of
a conversation whose turn numbers lie in one block of 1024 meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, settle, words_column

# fixed values of the template
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens that the marks of a turn count.
MARKS = 4
#: Turn numbers whose sums run together.
BLOCK = 1024
#: Stands for a number that is missing; sorts behind all others.
LAST = (1 << 63) - 1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|(?<=<)\|", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _placed(conversations: DataFrame, budget: int, history: int, tokens: str | None) -> DataFrame:
    """Turns with their place on the conversation's line: (none, conv, system, start, tokens, size, cell, alone, sys)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text", *([tokens] if tokens else []))
    text, conv, turn = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("conv_id").cast("long"), F.col("turn").cast("long")
    count = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else words_column(text).cast("long")
    rows = rows.select(
        conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.coalesce(F.floor(turn / BLOCK), F.lit(LAST)).alias("block"), turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), (F.greatest(count, F.lit(0)) + MARKS).alias("tokens"),
    )
    key, order = ["none", "conv", "block"], [F.asc_nulls_last("turn"), "role", "text"]
    # what lies before each block, from one row a block; its first turn may be the conversation's system turn
    first = F.min(F.struct(F.col("turn").isNull().alias("unnumbered"), "turn", "role", "text", "tokens"))
    blocks = rows.groupBy(*key).agg(F.sum("tokens").alias("held"), first.alias("first"))
    over = Window.partitionBy("none", "conv").orderBy("block")
    lead = F.first(F.when(F.col("first.role") == "system", F.struct("first.text", "first.tokens"))).over(over)
    before = F.coalesce(F.sum("held").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = blocks.select(*key, before.alias("before"), lead.alias("sys"), (F.row_number().over(over) == 1).alias("opens"))

    inside = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumns({"upto": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(inside)})
    rows = rows.join(bases, key)
    size = F.greatest(F.lit(budget - history) - F.coalesce(F.col("sys.tokens"), F.lit(0)), F.lit(budget // 4))
    rows = rows.withColumn("system", F.col("opens") & (F.col("n") == 1) & F.col("sys").isNotNull()).withColumn("size", size)
    start = F.when(F.col("system"), -1).otherwise(F.col("before") + F.col("upto") - F.col("tokens") - F.coalesce(F.col("sys.tokens"), F.lit(0)))
    rows = rows.withColumn("start", start)
    cell = F.greatest(F.floor(F.col("start") / F.col("size")), F.lit(0))
    rows = rows.withColumn("cell", cell)
    alone = ~F.col("system") & (F.col("start") + F.col("tokens") > (F.col("cell") + 1) * F.col("size") + history)
    # one turn of a cell and block carries the system turn to it
    carried = (F.col("n") == 1) | (F.lag("cell").over(inside) != F.col("cell"))
    return rows.withColumns({"alone": alone, "sys_tokens": F.coalesce(F.col("sys.tokens"), F.lit(0)), "sys": F.when(carried, F.col("sys.text"))}).drop(
        "block", "turn", "upto", "n", "before", "opens"
    )


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END))


def format_windows(conversations: DataFrame, budget: int = 4096, history: int = 512, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, text, n_turns, n_repeated, loss, tokens) of (conv_id, turn, role, text).

    ``window`` orders the windows of a conversation, not without gaps; the first
    ``n_repeated`` of its turns are the system turn or history; ``loss`` lists
    (start, length) in code points of the texts to be learned.  ``tokens`` names a
    column with the turns' token counts; without it words count, and marks four a
    turn.  ``history`` is a quarter of ``budget`` at most."""
    if not 0 <= 4 * history <= budget:
        raise ValueError("history is a quarter of the budget at most")
    placed = _placed(conversations, budget, history, tokens)
    # turns near a cell's end are sent to the next one as well
    near = ~F.col("system") & (F.col("start") >= (F.col("cell") + 1) * F.col("size") - history)
    places = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = placed.withColumn("later", F.explode(places)).withColumn("cell", F.col("cell") + F.col("later"))
    # only the cell that a turn starts in holds it as new
    turn = F.struct("start", "tokens", (F.col("later") == 1).alias("old"), "alone", "system", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    own_sys = F.when(F.col("later") == 0, F.col("sys"))
    cells = dealt.groupBy("none", "conv", "cell").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("sys_tokens").alias("sys_tokens"), F.max(own_sys).alias("sys"))
    new = lambda alone: F.filter("turns", lambda t: ~t["old"] & (t["alone"] == F.lit(alone)))
    both = cells.withColumn("own", F.explode(F.array(F.struct(F.lit(0).alias("alone"), new(False).alias("turns")), F.struct(F.lit(1).alias("alone"), new(True).alias("turns"))))).filter(F.size("own.turns") > 0)

    has_sys = F.exists("own.turns", lambda t: t["system"])
    first = F.aggregate("own.turns", F.lit(LAST), lambda least, t: F.when(t["system"], least).otherwise(F.least(least, t["start"])))
    held = F.aggregate("own.turns", F.lit(0).cast("long"), lambda n, t: F.when(t["system"], n).otherwise(n + t["tokens"]))
    both = both.withColumns({"has_sys": has_sys, "first": first, "held": held})
    room = F.greatest(F.least(F.lit(history), F.lit(budget) - F.col("sys_tokens") - F.col("held")), F.lit(0))
    both = both.withColumn("past", F.filter("turns", lambda t: ~t["system"] & (t["start"] < F.col("first")) & (t["start"] >= F.col("first") - room)))
    plain = lambda ts, target: F.transform(ts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (F.lit(target) & (t["role"] == "assistant")).alias("target")))
    kept = F.when(F.col("sys").isNotNull() & ~F.col("has_sys"), F.array(F.struct(F.lit("system").alias("role"), escape(F.col("sys")).alias("text"), F.lit(False).alias("target"))))
    kept = kept.otherwise(F.array().cast("array<struct<role:string,text:string,target:boolean>>"))
    both = both.withColumn("repeated", F.concat(kept, plain(F.col("past"), False)))
    both = both.withColumn("all", F.concat("repeated", plain(F.col("own.turns"), True)))
    ahead = lambda t: F.lit(len(START) + len(SEP)) + F.length(t["role"])

    def add(acc: Column, t: Column) -> Column:
        at = acc["at"] + ahead(t)
        span = F.array(F.struct(at.alias("start"), F.length(t["text"]).alias("length")))
        return F.struct((at + F.length(t["text"]) + len(END)).alias("at"), F.when(t["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")), add)
    past = F.aggregate("past", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    return both.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), (2 * F.col("cell") + F.col("own.alone")).alias("window"),
        F.array_join(F.transform("all", lambda t: _rendered(t["role"], t["text"])), "").alias("text"), F.size("all").alias("n_turns"), F.size("repeated").alias("n_repeated"),
        spans["spans"].alias("loss"), (F.col("held") + past + F.when(F.col("sys").isNotNull(), F.col("sys_tokens")).otherwise(0)).alias("tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, learned): the turns (role, text) that a window is the first to hold, and the texts under its loss mask, both from its text."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), F.col("n_repeated") + 2, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))
    role = lambda p: unescape(F.substring_index(p, SEP, 1))
    told = lambda p: unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1))
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), told(p).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), learned.alias("learned"), F.length("text").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from its windows.

    A digest is over a conversation's whole text: that text must fit one cell (2 GB)."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_windows(windows).select("conv_id", F.struct("window", told.alias("told"), F.array_join("learned", "").alias("learned")).alias("w"), F.size("turns").alias("n"), "chars")
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("told"), 256).alias("turns_sha256"), F.length(joined("learned")).cast("long").alias("loss_chars"), F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars")


def write_windows(conversations: DataFrame, budget: int = 4096, history: int = 512, tokens: str | None = None) -> DataFrame:
    """The windows as a table of the scratch folder."""
    return settle(format_windows(conversations, budget, history, tokens), "chat-windows")
