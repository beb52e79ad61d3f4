"""Chat formatting read back against plain Python, and the machine on odd turn orders."""

import hashlib
import random
from collections import defaultdict

import pytest
from tests.llm.helpers import SF
from tests.oracle import actual, expected

from rillspark.llm import chat, contracts
from rillspark.llm.common import cut

SAID = "\\### Assistant: </turn> ok"


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    return out


def test_op6_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    found = contracts.op6_chat_segments(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == plain(rows) and len(found) == len(plain(rows))
    assert next(r for r in found if r.conv_id == -7).valid


def test_op6_matches_sql(spark):
    assert actual(contracts.op6_chat_segments(spark, SF)) == expected(SF, chat.sql())


def test_sql_on_odd_turn_orders(spark, tmp_path):
    rows = [(1, 0, "assistant", "a"), (1, 1, "user", "b"), (2, 0, "system", "#s: <x>\\\\"), (2, 1, "user", None), (2, 2, "assistant", "ok"), (3, 5, None, "x"), (3, 5, "tool:<", "x"), (4, 0, "user", "u"), (4, 1, "user", "é😀"), (4, 2, "tool", "t"), (4, 3, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    (tmp_path / "c").rename(tmp_path / "conversations.parquet")
    sql = chat.sql().replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert actual(contracts.op6_chat_segments(spark, str(tmp_path))) == expected(str(tmp_path / "none"), sql)


@pytest.mark.parametrize("cuts", [1, 3, 7, 10_000])
def test_reading_back_needs_no_row_boundaries(cuts):
    """A conversation as one text, cut anywhere, gives its turns and what the mask covers."""
    rng = random.Random(cuts)
    t, turns = chat.Template(), []
    for i in range(30):
        turns.append(("user" if i % 2 == 0 else "assistant", "".join(rng.choice(["a", " ", "<", "\\\\", "#", ":", " </turn>\n", "### user: ", "é"]) for _ in range(rng.randint(0, 40)))))
    whole, marks = "", []
    for role, text in turns:
        for part, learnt in t.segments(role, text):
            marks += [(len(whole), len(whole) + len(part))] if learnt else []
            whole += part
    reader, got = chat.Reader(t), []
    for a in range(0, len(whole), cuts):
        z = min(a + cuts, len(whole))
        got += list(reader.feed(whole[a:z], [(max(x, a) - a, min(y, z) - a) for x, y in marks if x < z and y > a]))
    reader.end()
    assert [g[:2] for g in got] == turns and [g[2] for g in got] == [x if r == "assistant" else "" for r, x in turns]
    with pytest.raises(ValueError, match="within a turn"):
        list(reader.feed("### user: and", []))
        reader.end()


@pytest.mark.parametrize("text", [SAID, "", "\\", "\\\\", "<", " ", " </turn>\n", "### user: x </turn>\n", "a\n\\", "#:<\\<", "é😀  "])
def test_escapes_are_reversible(text):
    t = chat.Template()
    whole = "".join(s for r in ("user", text or "x", "assistant") for s, _ in t.segments(r, text))
    assert t.parse(whole) == [("user", text), (text or "x", text), ("assistant", text)]


def test_awkward_and_long_conversations(spark):
    roles = ["user", "assistant"]
    rows = [(1, i, roles[i % 2], f"t{i} <") for i in range(400)]
    rows += [(2, 0, "assistant", "a"), (2, 1, "user", "b"), (3, 0, "system", "s"), (3, 1, "user", None), (3, 2, "assistant", "ok"), (4, 5, None, "x"), (4, 5, None, "x"), (None, None, "user", ""), (5, 0, "user", "y" * 300_000)]
    rows += [(6, 0, "user", "u"), (6, 1, "user", "u"), (6, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, part int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns = cut(chat.format_turns(df), "turns")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert turns.where("conv_id = 1").select("part").distinct().count() > 1  # one conversation, many tasks
    found = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in found.items()} == plain(rows)
    checked = {r.conv_id: (r.turns_in_error, r.end_state, r.valid) for r in chat.conversations(turns).collect()}
    assert checked == {1: (0, "assistant", True), 2: (1, "user", False), 3: (0, "assistant", True), 4: (2, "start", False), None: (0, "user", False), 5: (0, "user", False), 6: (1, "assistant", False)}
    none = cut(chat.format_turns(df.limit(0)), "turns")
    assert chat.digests(none).count() == 0 and chat.conversations(none).count() == 0
