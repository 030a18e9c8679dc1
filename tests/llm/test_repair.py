import hashlib
import itertools
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeledger.llm import repair
from codeledger.llm.sql import ORACLES

SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
ROLES = [None, "user", "user", "assistant", "assistant", "system", "tool", ""]
TEXTS = [None, "", "a.", "b!", "c", "d? \n", "e", " . ", "é. ", "two\nlines."]


def awkward(seed: int) -> list[tuple]:
    """Null ids, turns, roles and texts, equal turns, repeated rows; the rows without an id are many."""
    pick = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for k in range(pick.randrange(1, 60 if conv is None else 14)):
            rows.append((conv, pick.choice([None, 1, 2, 3, 5, 8, k, k, k]), pick.choice(ROLES), pick.choice(TEXTS)))
    return rows + rows[:5]


def by_sql(path: str) -> list[tuple]:
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS FROM '{path}'")
    return sorted(connection.sql(ORACLES["op13_conversation_repair"]).fetchall(), key=str)


@pytest.fixture(scope="module")
def conversations(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations") / "rows.parquet")
    rows = awkward(5)
    # One conversation of many rows, so that its tie-breaks span segments.
    pick = random.Random(6)
    rows += [(1000, k, pick.choice(["user", "assistant", "system"]), f"{k}{pick.choice('.x')}") for k in range(400)]
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in rows], SCHEMA), path)
    return path


@pytest.mark.parametrize("segment_rows", [1, 7, 4096])
def test_sql_and_operator_agree_however_conversations_are_cut(spark, conversations, segment_rows):
    rows = spark.read.parquet(conversations).withColumns({"mark": F.lit("clash"), "dropped": F.lit("clash"), "part": F.lit(1)}).repartition(3)
    found = repair.repair(repair.damaged(rows), segment_rows)
    names = [field.split()[0] for field in repair.RESULT.split(", ")]
    assert sorted(map(tuple, found.select(names).collect()), key=str) == by_sql(conversations)


def test_repair_of_the_given_table(spark, duck, sf_dir):
    found = repair.repair(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    assert sorted(map(tuple, found.collect()), key=str) == by_sql(f"{sf_dir}/conversations.parquet")


def all_edits(rows, inserts=2):
    """Every edit sequence with up to two inserts in each gap, as (cost, audit) of the legal ones."""
    per_row = ("K", "Ru", "Ra", "D")
    gaps = ("", "u", "a", "ua", "au")
    for choice in itertools.product(per_row, repeat=len(rows)):
        if any(edit != "D" and gone for edit, (_, gone, _) in zip(choice, rows, strict=True)):
            continue
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            out, cost, audit = put[0], 2 * len(put[0]), "I" * len(put[0])
            for edit, (initial, _, cut), more in zip(choice, rows, put[1:], strict=True):
                cost += {"K": 0, "R": 2, "D": 3}[edit[0]] + (edit != "D" and cut) + 2 * len(more)
                out += ("" if edit == "D" else initial or "?" if edit == "K" else edit[1]) + more
                audit += edit[0] + "I" * len(more)
            body = out[1:] if out[:1] == "s" else out
            if (out == "" or body) and body == "ua" * (len(body) // 2):
                yield cost, audit


@pytest.mark.parametrize("seed", range(12))
def test_audits_against_all_edit_sequences(seed):
    pick = random.Random(seed)
    rows = [(pick.choice(["s", "u", "a", "a", "t", ""]), pick.random() < 0.2, pick.random() < 0.3) for _ in range(pick.randrange(4))]
    rows = [(initial, gone, cut and not gone) for initial, gone, cut in rows]
    assert repair.cheapest(repair.walk(rows, repair.START, True)) == min(all_edits(rows))


@pytest.mark.parametrize("modulus", [repair.MODULUS, 5, 2])
def test_order_of_audits_is_that_of_their_texts_even_where_hashes_collide(monkeypatch, modulus):
    monkeypatch.setattr(repair, "MODULUS", modulus)
    pick, audits = random.Random(1), repair.Audits()
    nodes = [0]
    for _ in range(300):
        nodes.append(audits.add(pick.choice(nodes[-40:]), pick.choice("DK")))
    for _ in range(2000):
        a, b = pick.choice(nodes), pick.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_ancestors():
    audits, node, chain = repair.Audits(), 0, [0]
    for k in range(70):
        node = audits.add(node, "KD"[k % 2])
        chain.append(node)
    assert [audits.ancestor(node, depth) for depth in range(71)] == chain


def test_all_rows_dropped_and_no_rows(spark):
    rows = spark.createDataFrame([(7, 1, "user", "a.", True), (None, None, None, None, True)], "conv_id long, turn long, role string, text string, dropped boolean")
    nothing = hashlib.sha256(b"").hexdigest()
    found = {row.conv_id: tuple(row)[1:] for row in repair.repair(rows).collect()}
    assert found == {7: (0,) * 6 + ("", nothing), None: (0,) * 6 + ("", nothing)}
    assert repair.repair(rows.limit(0)).collect() == []
    assert repair.repair(repair.damaged(rows.drop("dropped").limit(0))).collect() == []
