"""Chat formatting in budgeted windows, in column expressions only.

A conversation's turns, in order, are cut into turn-aligned spans by running sums of their formatted lengths. A window is the
system turn if there is one, up to two turns of history, and a span of new turns, within the budget; only a span of a
single turn may exceed it. The loss mask covers the texts of new assistant turns; what is repeated is masked out.

A turn reads <|im_start|>role, a line end, text, <|im_end|>, a line end. Inside roles and texts a backslash is doubled
and <| gets a backslash between, so no text can end a turn; a role's line ends get a backslash before. Both are undone by
dropping the backslash.

Null texts and roles count as empty. Turns with one number are ordered by role, then text; null numbers come first.
A null conv_id is a conversation. Other columns are ignored; empty tables give empty results. A conversation is one row
while it is formatted: it is the unit that is trained on, and its digest needs all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\\n"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def format_windows(df: DataFrame, budget: int = 2048, history: int = 512, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, window, n_repeated (turns at its start that are not new), formatted, loss (spans of characters).

    budget and history are in characters of the formatted text.
    """
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(df[id_col].cast("long").alias("conv_id"), F.struct(df[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("x"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("raw"))
    cost = lambda r, t: F.length(r) + F.length(t) + (len(START) + len(END) + 2)
    escaped = F.transform("raw", lambda x: F.struct(escape_role(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    conv = conv.withColumn("t", escaped)
    conv = conv.withColumn("sys", F.when(F.element_at("raw", 1)["role"] == "system", 1).otherwise(0))
    first = F.element_at("t", 1)
    conv = conv.withColumn("sys_cost", F.when(F.col("sys") == 1, cost(first["role"], first["text"])).otherwise(0))
    conv = conv.withColumn("cost", F.transform("t", lambda x: cost(x["role"], x["text"])))
    room = F.greatest(F.lit(budget - history) - F.col("sys_cost"), F.lit(1))
    # running sums: a span ends before the turn that would take its sum over the room
    begin = F.struct(F.lit(0).cast("long").alias("sum"), F.col("sys").alias("at"), F.array(F.col("sys") + 1).alias("starts"))

    def step(s: Column, c: Column) -> Column:
        over = (s["sum"] > 0) & (s["sum"] + c > room)
        at = s["at"] + 1
        return F.struct((F.when(over, F.lit(0)).otherwise(s["sum"]) + c).cast("long").alias("sum"), at.alias("at"), F.when(over, F.concat(s["starts"], F.array(at))).otherwise(s["starts"]).alias("starts"))

    conv = conv.withColumn("starts", F.aggregate(F.slice("cost", F.col("sys") + 1, F.size("cost")), begin, step, lambda s: s["starts"]))
    conv = conv.withColumn("span", F.arrays_zip(F.col("starts").alias("a"), F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("t") + 1)).alias("b")))
    one = conv.select("conv_id", "t", "sys", "sys_cost", "cost", F.posexplode("span").alias("window", "s"))
    a, b = F.col("s")["a"], F.col("s")["b"]
    before = lambda k: F.coalesce(F.try_element_at("cost", F.greatest(a - k, F.lit(1))), F.lit(0))
    left = F.least(F.lit(history), F.greatest(F.lit(0), F.lit(budget) - F.col("sys_cost") - F.aggregate(F.slice("cost", a, b - a), F.lit(0), lambda x, y: x + y)))
    can = a - 1 - F.col("sys")
    back = F.when((can >= 2) & (before(1) + before(2) <= left), 2).when((can >= 1) & (before(1) <= left), 1).otherwise(0)
    one = one.withColumn("back", back)
    again = F.when(F.col("window") > 0, F.col("sys")).otherwise(0) + F.col("back")
    lead = F.when(F.col("sys") == 1, F.slice("t", 1, 1)).otherwise(F.slice("t", 1, 0))
    one = one.select("conv_id", "window", again.cast("int").alias("n_repeated"), F.concat(lead, F.slice("t", a - F.col("back"), b - a + F.col("back"))).alias("turns"))
    texts = F.transform("turns", lambda x: F.concat(_head(x["role"]), x["text"], F.lit(END + "\n")))
    sizes = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def mark(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(_head(x["role"]))
        end = start + F.length(x["text"])
        learn = x["new"] & (x["role"] == "assistant")
        return F.struct((end + len(END) + 1).alias("at"), F.when(learn, F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["out"]).alias("out"))

    known = F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), x["text"].alias("text"), (i >= F.col("n_repeated")).alias("new")))
    return one.select("conv_id", F.col("window").cast("long").alias("window"), "n_repeated", F.array_join(texts, "").alias("formatted"), F.aggregate(known, sizes, mark, lambda s: s["out"]).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """windows with their new turns (role, text) and the text under the loss mask, parsed from the formatted text alone."""
    turn = r"(?s)<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*?)<\|im_end\|>\n"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(turn), F.lit(k)) for k in (1, 2))
    found = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    under = F.transform("loss", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    out = windows.withColumn("found", found)
    return out.select("conv_id", "window", F.slice("found", F.col("n_repeated") + 1, F.size("found")).alias("turns"), F.array_join(under, "").alias("learned"), F.length("formatted").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    each = read_back(windows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    each = each.select("conv_id", turns.alias("turns"), F.array_join(F.transform("w", lambda x: x["learned"]), "").alias("learned"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return each.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
