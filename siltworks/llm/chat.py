"""Chat formatting (native): budgeted, turn-aligned windows over conversations.

Tokens of a turn are those of its formatted piece, template included: a quarter of its characters and one. The budget
holds whole windows: the system turn and the repeated history (at most HISTORY_TOKENS, and at most a quarter of what the
system turn leaves) are taken off first, and half of the rest is a conversation's stride. Prefix sums of turn tokens choose
the spans: a turn belongs to the stride that holds its last token, and a turn longer than a stride stands alone. So own
turns that share a window fit, no turn is cut, and no loop is needed. Every later window repeats the system turn and up to
HISTORY turns before it, as far as they fit; what is repeated is context, and its targets are masked. Only a single turn
that does not fit beside the system turn exceeds the budget; it stands with that turn alone.

Template: an assistant's turn is <s>role\\ntext</s>, any other [INST]role\\ntext[/INST]; these strings inside texts or
roles are escaped with & entities, and newlines in roles too, so that reading back is exact.

Defined results: null text or role is empty; turns order by number (nulls first), role, text, so ties are settled by these
and equal rows are turns of their own; the first system turn is the one repeated, later ones are turns as others; a null conv_id is a conversation of its own; empty tables give empty results; other columns are not read.
The contract's digest makes each conversation one string, so a conversation is bounded by a string's 2 GB; its turns
meet in one task by streaming, spillable windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TOKENS = 1024, 2, 256
TARGET, SYSTEM = "assistant", "system"
TURN = r"(?s)(\[INST\]|<s>)([^\n]*)\n(.*?)(\[/INST\]|</s>)"


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.regexp_replace(F.regexp_replace(t, r"<(/?s>)", "&lt;$1"), r"\[(/?INST\])", "&#91;$1")


def unescape(text: Column) -> Column:
    t = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("["))
    return F.replace(F.replace(t, F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window_id, formatted, n_context, loss_spans): spans are 0-based (start, length) in code points of formatted."""
    t = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    target = F.col("role") == TARGET
    head = F.concat(F.when(target, "<s>").otherwise("[INST]"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    t = t.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"), F.when(target, "</s>").otherwise("[/INST]").alias("tail"))
    t = t.select("conv_id", "turn", "role", "text", F.concat("head", "body", "tail").alias("piece"), F.length("head").alias("at"), F.length("body").alias("len"))
    t = t.withColumn("tok", F.expr("length(piece) div 4 + 1"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    system = F.when(F.col("role") == SYSTEM, F.struct("piece", "tok"))
    t = t.select("*", F.row_number().over(w).alias("i"), F.sum("tok").over(sofar).alias("cum"), F.first(system, True).over(sofar).alias("sys"), F.sum(F.when(F.col("role") == SYSTEM, 1).otherwise(0)).over(sofar).alias("nsys"), F.coalesce(F.first(system["tok"], True).over(whole), F.lit(0)).alias("systok"))
    t = t.withColumn("room", F.greatest(F.lit(budget) - F.col("systok"), F.lit(0)))
    t = t.withColumn("past", F.least(F.lit(history_tokens), F.expr("room div 4"))).withColumn("stride", F.expr("greatest(1, (room - past) div 2)"))
    t = t.withColumn("win", F.expr("((cum - 1) div stride) * 2 + if(tok > stride, 0, 1)"))
    t = t.withColumn("is_sys", (F.col("role") == SYSTEM) & (F.col("nsys") == 1))
    t = t.withColumn("starts", F.coalesce(F.lag("win").over(w) != F.col("win"), F.lit(True)))
    # a window starts h turns ahead: its number, the tokens before it from this turn on, and what its own turns leave to history
    left = F.when(F.col("tok") > F.col("stride"), F.col("room") - F.col("tok")).otherwise(F.col("past"))
    ahead = [(F.lead("starts", h).over(w), F.lead("win", h).over(w), F.lead(F.col("cum") - F.col("tok"), h).over(w), F.lead(left, h).over(w)) for h in range(1, history + 1)]
    t = t.select("*", *[c.alias(f"{k}{h}") for h, cs in enumerate(ahead, 1) for k, c in zip(("s", "w", "c", "l"), cs, strict=True)])
    part = lambda win, i, fresh, loss, piece, at, n: F.struct(win.cast("long").alias("win"), i.cast("long").alias("i"), fresh.alias("fresh"), loss.alias("loss"), piece.alias("piece"), at.alias("at"), n.alias("len"))
    no, zero = F.lit(False), F.lit(0)
    parts = [part(F.col("win"), F.col("i"), F.lit(True), F.col("role") == TARGET, F.col("piece"), F.col("at"), F.col("len"))]
    parts.append(F.when(F.col("starts") & F.col("sys").isNotNull() & ~F.col("is_sys"), part(F.col("win"), zero, no, no, F.col("sys.piece"), zero, zero)))
    for h in range(1, history + 1):
        near = F.col(f"s{h}") & ~F.col("is_sys") & (F.col(f"c{h}") - (F.col("cum") - F.col("tok")) <= F.least("past", f"l{h}"))
        parts.append(F.when(near, part(F.col(f"w{h}"), F.col("i"), no, no, F.col("piece"), zero, zero)))
    rows = t.select("conv_id", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select("conv_id", "x.*")
    g = rows.groupBy("conv_id", "win").agg(F.sort_array(F.collect_list(F.struct("i", "fresh", "loss", "piece", "at", "len"))).alias("xs"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, x: F.struct((a["pos"] + F.length(x["piece"])).alias("pos"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["pos"] + x["at"]).alias("start"), x["len"].alias("length"))))).otherwise(a["spans"]).alias("spans"))
    return g.select("conv_id", F.col("win").alias("window_id"), F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("formatted"), F.size(F.filter("xs", lambda x: ~x["fresh"])).alias("n_context"), F.aggregate("xs", start, step)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from windows() alone: turns and loss text as they were before formatting, digested."""
    t = formatted.select("conv_id", "window_id", "formatted", "n_context", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2)).alias("roles"), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(3)).alias("texts"), "loss_spans")
    rest = lambda c: F.slice(c, F.col("n_context") + 1, F.size(c))
    turn = F.zip_with(rest("roles"), rest("texts"), lambda r, x: F.concat(unescape(r), F.lit("\n"), unescape(x), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    t = t.select("conv_id", "window_id", F.size(rest("roles")).alias("n"), F.array_join(turn, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    g = t.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window_id", "turns", "loss"))).alias("xs"), F.sum("chars").cast("long").alias("formatted_chars"))
    whole = lambda k: F.array_join(F.transform("xs", lambda x: x[k]), "")
    g = g.select("conv_id", "n_turns", whole("turns").alias("turns"), whole("loss").alias("loss"), "formatted_chars")
    return g.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
