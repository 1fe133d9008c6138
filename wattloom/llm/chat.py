r"""Chat formatting by relational means: Spark expressions only, no Python on the executors.

A conversation is its rows, collected as structs and sorted by turn. The template::

    ### role: text</turn>\n

puts adjacent turns of one role into one block, their texts parted by ``</part>``. Inside roles
and texts, a backslash and the control strings are escaped, each by a backslash and a letter,
so no control string is left in them and reading back is exact::

    \ -> \\    </turn> -> \e    </part> -> \p    ### -> \h    (in roles also : -> \c)

The loss mask is kept as runs (chars, loss) over the formatted text, with loss on the texts
of assistant turns only.

Defined results: null text or role counts as empty; a null turn sorts first; turns that tie sort by
role, then text; repeated rows are turns of their own; rows with null conv_id are one conversation;
an empty table gives no rows; other columns are ignored. A conversation's rows come together
in one task, as its formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import load

#: Control strings and the letters that escape them.
ESCAPES = [("</turn>", "e"), ("</part>", "p"), ("###", "h")]
END, PART = "</turn>\n", "</part>"
#: Runs of a mask whose spans are gathered together, so that appending does not copy long arrays.
TOGETHER = 512


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in [*ESCAPES, *([(":", "c")] if role else [])]:
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    def single(part: Column) -> Column:
        for control, letter in [*ESCAPES, *([(":", "c")] if role else [])]:
            part = F.replace(part, F.lit("\\" + letter), F.lit(control))
        return part

    # pairs of backslashes are found from the left, as they were written
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), single), "\\")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_runs array<struct<chars, loss>>) from rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        first = i == 0
        opens = first | (F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"] != x["role"])
        head = F.concat(F.when(first, "").otherwise(END), F.lit("### "), escape(x["role"], role=True), F.lit(": "))
        return F.struct(F.when(opens, head).otherwise(PART).alias("before"), escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("loss"))

    pieces = whole.select("conv_id", F.transform("turns", piece).alias("pieces"))
    runs = F.flatten(F.transform("pieces", lambda p: F.array(F.struct(F.length(p["before"]).alias("chars"), F.lit(False).alias("loss")), F.struct(F.length(p["text"]).alias("chars"), p["loss"].alias("loss")))))
    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.concat(runs, F.array(F.struct(F.lit(len(END)).alias("chars"), F.lit(False).alias("loss")))).alias("loss_runs"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substr(block, F.lit(5)), ":", 1), role=True)
        body = F.substr(block, F.locate(":", block) + 2)
        return F.transform(F.split(body, PART, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, END, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def loss_spans(runs: Column) -> Column:
    """array<struct<at, chars>> of the runs with loss, at counted from 0."""
    none = F.array().cast("array<struct<at: int, chars: int>>")

    def step(done: Column, run: Column) -> Column:
        span = F.array(F.struct(done["at"].alias("at"), run["chars"].alias("chars")))
        return F.struct((done["at"] + run["chars"]).alias("at"), F.when(run["loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    def gather(done: Column, block: Column) -> Column:
        part = F.aggregate(block, F.struct(done["at"].alias("at"), none.alias("spans")), step)
        return F.struct(part["at"].alias("at"), F.concat(done["spans"], F.array(part["spans"])).alias("spans"))

    first = F.sequence(F.lit(1), F.greatest(F.size(runs), F.lit(1)), F.lit(TOGETHER))
    blocks = F.transform(first, lambda i: F.slice(runs, i, TOGETHER))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<at: int, chars: int>>>").alias("spans"))
    return F.flatten(F.aggregate(blocks, start, gather)["spans"])


def under_mask(formatted: Column, runs: Column) -> Column:
    """The text under the loss mask, unescaped. Sliced in UTF-32, where a character's place is known."""
    bom = F.unhex(F.lit("0000FEFF"))  # the decoder takes one; a text may begin with its own

    def slices(raw: Column) -> Column:
        return F.transform(loss_spans(runs), lambda s: unescape(F.decode(F.concat(bom, F.substr(raw, s["at"] * 4 + 1, s["chars"] * 4)), "UTF-32")))

    # raw is bound to a variable, as a column of a row would be copied for each slice
    return F.array_join(F.flatten(F.transform(F.array(F.encode(formatted, "UTF-32")), slices)), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds when read back, and what its loss mask leaves of it."""
    said = under_mask(F.col("formatted"), F.col("loss_runs"))
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), said.alias("said"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PLANTED = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(planted)))


_ESC = "replace(replace(replace(replace({0}, '\\', '\\\\'), '</turn>', '\\e'), '</part>', '\\p'), '###', '\\h')"
OP7_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PLANTED}' union all select -7, 1, 'assistant', '{PLANTED}'
), o as (
  select *, row_number() over w as k, lag(role) over w as before from t window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_ESC.format('text')}) + case when before is null or before <> role then 14 + length(replace({_ESC.format('role')}, ':', '\\c')) else 7 end) as bigint) as formatted_chars
from o group by conv_id
"""
