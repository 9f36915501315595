r"""Chat formatting in budgeted windows, as DataFrame expressions alone.

A conversation's turns, in order, are cut into spans by the prefix sums of their tokens: a span ends
before the turn that would lift it over the budget, so every span is made of whole turns. Each span is a
window, formatted with the system turn and a limited history before it; those repeated turns are marked
and stay out of the loss, so that each assistant text is a target exactly once.

Template: `<|im_start|>role`, a line feed, the text, `<|im_end|>`, a line feed; a repeated turn begins
with `<|im_again|>`. Control strings of this and other usual templates inside texts get one backslash
more behind their first character; reading takes it away again.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, of its repeated history, and those that a turn's marks count as.
BUDGET, HISTORY, MARKS = 512, 128, 4
PART = 256
START, AGAIN, END = "<|im_start|>", "<|im_again|>", "<|im_end|>"
#: What follows `<` or `[` in control strings.
CONTROL = r"\||/?s>|</?SYS>>|/?INST\]"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escaped(x: str) -> str:
    """SQL for a text in which every control string has one backslash more."""
    return f"regexp_replace({x}, {_sql(rf'([<\[])(\\*)(?={CONTROL})')}, {_sql('$1$2' + chr(92) * 2)})"


def unescaped(x: str) -> str:
    return f"regexp_replace({x}, {_sql(rf'([<\[])(\\*)\\(?={CONTROL})')}, '$1$2')"


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, tokens and loss (ranges: start from 0 and length, in characters of formatted).

    Turns are ordered by turn, equal ones by role and text; a null turn comes first, a null role or text
    is empty, and rows of a null conv_id are one conversation. A turn longer than the budget is a window
    of its own, whole. Repeated rows are turns of their own; an empty table has no windows. The turns of
    one conversation are put together in one row.
    """
    count = rf"CAST({MARKS} + regexp_count(text, {_sql(r'[^\x20\x09-\x0D]+')}) AS BIGINT)"
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tokens", F.expr(count))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"k": F.row_number().over(order) - 1, "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    turn = F.struct("k", "role", "text", "tokens", (F.col("upto") - F.col("tokens")).alias("before"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.withColumn("system", F.expr("IF(turns[0].role = 'system', turns[0].tokens, 0L)"))
    room = f"greatest({budget - history} - system, 1)"
    over = f"t.before > b.base AND t.before + t.tokens - b.base > {room}"
    # in parts of PART turns, as each array_append copies what it appends to
    rows = rows.withColumn("starts", F.expr(f"""aggregate(
        transform(sequence(0, (size(turns) - 1) DIV {PART}), p -> slice(turns, p * {PART} + 1, {PART})),
        named_struct('done', CAST(array() AS ARRAY<ARRAY<INT>>), 'now', named_struct('starts', array(0), 'base', 0L)),
        (a, part) -> named_struct('done', array_append(a.done, a.now.starts), 'now', aggregate(part, named_struct('starts', CAST(array() AS ARRAY<INT>), 'base', a.now.base),
          (b, t) -> named_struct('starts', IF({over}, array_append(b.starts, t.k), b.starts), 'base', IF({over}, t.before, b.base)))),
        a -> flatten(array_append(a.done, a.now.starts)))"""))
    back = history // MARKS  # turns that the history can have at most
    first = f"greatest(lo - {back}, IF(turns[0].role = 'system', 1, 0))"
    near = f"IF({first} < lo, slice(turns, {first} + 1, lo - {first}), slice(turns, 1, 0))"
    head = "IF(lo > 0 AND turns[0].role = 'system', slice(turns, 1, 1), slice(turns, 1, 0))"
    own = "slice(turns, lo + 1, IF(w + 1 < size(starts), starts[w + 1], size(turns)) - lo)"
    # cut before they are made rows, so that no row but the first has all turns
    spans = f"transform(starts, (lo, w) -> named_struct('window', w, 'own', {own}, 'again', concat({head}, filter({near}, t -> turns[lo].before - t.before <= {history}))))"
    rows = rows.withColumn("spans", F.expr(spans)).select("conv_id", F.inline("spans"))
    shown = lambda mark: f"concat({_sql(mark)}, url_encode(t.role), char(10), {escaped('t.text')}, {_sql(END)}, char(10))"
    rows = rows.withColumns({"a": F.expr(f"array_join(transform(again, t -> {shown(AGAIN)}), '')"), "o": F.expr(f"transform(own, t -> {shown(START)})")})
    loss = f"""aggregate(sequence(0, size(own) - 1), named_struct('at', CAST(length(a) AS BIGINT), 'out', CAST(array() AS ARRAY<STRUCT<start: BIGINT, length: BIGINT>>)),
        (s, i) -> named_struct('at', s.at + length(o[i]), 'out', IF(own[i].role = 'assistant', array_append(s.out, named_struct(
          'start', s.at + {len(START)} + length(url_encode(own[i].role)) + 1,
          'length', CAST(length(o[i]) - {len(START) + 1 + len(END) + 1} - length(url_encode(own[i].role)) AS BIGINT))), s.out))).out"""
    tokens = "aggregate(concat(again, own), 0L, (s, t) -> s + t.tokens)"
    return rows.select("conv_id", "window", F.expr("concat(a, array_join(o, ''))").alias("formatted"), F.expr(tokens).alias("tokens"), F.expr(loss).alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, window, place, again, role and text of all turns in formatted windows."""
    parts = formatted.select("conv_id", "window", F.posexplode(F.split("formatted", r"<\|im_end\|>\n")).alias("place", "t")).where("t <> ''")
    pick = lambda k: F.regexp_extract("t", r"(?s)^<\|im_(start|again)\|>([^\n]*)\n(.*)$", k)
    parts = parts.select("conv_id", "window", "place", (pick(1) == "again").alias("again"), F.url_decode(pick(2)).alias("role"), pick(3).alias("x"))
    return parts.select("conv_id", "window", "place", "again", "role", F.expr(unescaped("x")).alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from formatted windows, a row for each conversation.

    n_turns and turns_sha256 (role, line feed, text, line feed of each turn that isn't a repetition),
    loss_chars and loss_sha256 (the texts under the loss mask), formatted_chars and n_windows.
    """
    turns = read_turns(formatted).where(~F.col("again")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "place", "role", "text"))).alias("t"))
    turns = turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(F.expr("array_join(transform(t, x -> concat(x.role, char(10), x.text, char(10))), '')"), 256).alias("turns_sha256"))
    target = F.expr(f"array_join(transform(loss, r -> {unescaped('substring(formatted, CAST(r.start + 1 AS INT), CAST(r.length AS INT))')}), '')")
    loss = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", target.alias("x")))).alias("l"), F.sum(F.length("formatted")).alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = loss.withColumn("x", F.expr("array_join(transform(l, y -> y.x), '')"))
    loss = loss.select(F.col("conv_id").alias("c"), F.length("x").cast("long").alias("loss_chars"), F.sha2("x", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
    return turns.join(loss, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
