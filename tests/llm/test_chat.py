import hashlib

from pyspark.sql import functions as F
from wattloom.llm.chat import PLANTED, digests, format_conversations, op7_chat_format, read_turns
from wattloom.llm.common import load

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(escaped):
    """Escapes undone one character at a time."""
    out, at = [], 0
    while at < len(escaped):
        if escaped[at] == "\\":
            out.append({"\\": "\\", "e": "</turn>", "p": "</part>", "h": "###"}[escaped[at + 1]])
            at += 2
        else:
            out.append(escaped[at])
            at += 1
    return "".join(out)


def test_any_text_is_read_back(spark):
    odd = ["", None, "\\", "\\\\", "\\e", "\\\\e", "</turn>\n### user: x", "#####", "</part>", "\\</turn>\\", "é中\n", PLANTED, "x" * 100_000, "\\h\\p###\\"]
    roles = ["user", "assistant", "assistant", None, "a:b", "### user: "]
    rows = [(c, i, roles[(c + i) % len(roles)], odd[(c * 3 + i) % len(odd)], "f", 1) for c in range(12) for i in range(9)]
    rows += [(50, None, "user", "first", "f", 1), (50, 2, "assistant", "tie b", "f", 1), (50, 2, "assistant", "tie a", "f", 1), (50, 2, "assistant", "tie a", "f", 1), (None, 0, "user", None, "f", 1)]
    done = format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", "loss_runs", read_turns(done.formatted).alias("turns")).collect()}
    sums = {r.conv_id: r for r in digests(done).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((r[1] if r[1] is not None else -1), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [w[1:] for w in want]
        said = "".join(t for _, r, t in want if r == "assistant")
        at, masked = 0, ""
        for run in got[conv].loss_runs:
            masked += got[conv].formatted[at : at + run.chars] if run.loss else ""
            at += run.chars
        assert at == len(got[conv].formatted)
        d = sums[conv]
        assert (d.n_turns, d.turns_sha256) == (len(want), sha("".join(f"{r}\n{t}\n" for _, r, t in want)))
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(said), sha(said), at)
        assert plain(masked) == said


def test_adjacent_turns_share_a_block(spark):
    rows = [(1, 0, "user", "a", "", 0), (1, 1, "assistant", "b", "", 0), (1, 2, "assistant", "c", "", 0)]
    [r] = format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.formatted == "### user: a</turn>\n### assistant: b</part>c</turn>\n"


def test_query_runs_on_the_jvm_alone_and_empty_tables(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    plan = op7_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    n = load(spark, "/root/testdata/sf0.001", "conversations").select("conv_id").distinct().count()
    assert op7_chat_format(spark, "/root/testdata/sf0.001").count() == n + 1


def test_digests_read_the_mask(spark):
    said = ["\ufeffé😀\\e", "", "</turn>###", "plain"]
    rows = [(1, i, "assistant" if i % 2 else "user", said[i // 2 % 4] if i % 2 else f"u{i}", "", 0) for i in range(1500)]
    done = format_conversations(spark.createDataFrame(rows, SCHEMA)).withColumn("other", F.transform("loss_runs", lambda r: F.struct(r["chars"].alias("chars"), F.lit(False).alias("loss"))))
    [right] = digests(done).collect()
    want = "".join(r[3] for r in rows if r[2] == "assistant")
    assert (right.loss_chars, right.loss_sha256) == (len(want), sha(want))
    [wrong] = digests(done.withColumn("loss_runs", F.col("other"))).collect()
    assert (wrong.loss_chars, wrong.loss_sha256, wrong.turns_sha256) == (0, sha(""), right.turns_sha256)
