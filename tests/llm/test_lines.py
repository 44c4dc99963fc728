import random
import re

import duckdb
import pytest

from stockroom.llm import lines
from stockroom.llm.queries import ORACLE, op3_line_dedup

LONG = "one two Three four five six seven eight nine"


def brute(rows, sentence_words):
    """Documents by id; each unit of either level stays where it is met first."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept, spans, at = [], [], 0
        for line in (text or "").split("\n"):
            norm = " ".join(re.findall("[^ \t\x0b\x0c\r]+", line.translate(str.maketrans(lines.UPPER, lines.LOWER))))
            again = bool(norm) and ("line", norm) in seen
            seen |= {("line", norm)} if norm else set()
            begin, left = at, ""
            for part in re.split("(?<=[.!?] )", line):
                words = re.findall("[^ \t\x0b\x0c\r]+", part.translate(str.maketrans(lines.UPPER, lines.LOWER)))
                unit = ("sentence", " ".join(words))
                drop = len(words) >= sentence_words and unit in seen
                seen |= {unit} if len(words) >= sentence_words else set()
                if drop and not again:
                    spans.append((begin, begin + len(part)))
                left += "" if drop else part
                begin += len(part)
            if again:
                spans.append((at, at + len(line)))
            else:
                kept.append(left)
            at += len(line) + 1
        out[doc] = ("\n".join(kept), spans)
    return out


def test_edge_rows(spark):
    rows = [(5, f"short\n{LONG}\nend", "a"), (2, f"é\n  {LONG.upper()}\t", "b"), (None, LONG, "c"), (3, None, "d"), (2, "", "e"),
            (7, f"{LONG}\n{LONG}\n" + "w " * 90_000, "f"), (5, f"short\n{LONG}\nend", "g"), (8, "\n \n\nend\nnew", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = {r.row.digest: (r.kept, r.n_units, [tuple(s) for s in r.removed]) for r in lines.drop_repeated_units(df).collect()}
    size = len(LONG)
    assert got["a"] == got["g"] == ("short\nend", 4, [(6, 6 + size)])
    assert got["b"] == (rows[1][1], 3, []) and got["d"] == got["e"] == ("", 0, [])
    assert got["c"] == ("", 2, [(0, size)])
    assert got["f"][1:] == (6, [(0, size), (size + 1, 2 * size + 1)])
    assert got["h"] == ("\n \n\nnew", 2, [(4, 7)])
    assert lines.drop_repeated_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("frequent, sentence_words", [(1e-4, 3), (0.2, 3), (2.0, 1)])
def test_against_brute_force(spark, monkeypatch, frequent, sentence_words):
    monkeypatch.setattr(lines, "FREQUENT", frequent)
    rng = random.Random(sentence_words)
    parts = ["one two three. ", "One  Two three. ", "four five! ", "six seven eight nine? ", "ten", "é\tè ê ë. ", "a.b c d", "\n", "\n", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(200, None), (201, "x. " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.row.doc_id: (r.kept, [tuple(s) for s in r.removed]) for r in lines.drop_repeated_units(df, sentence_words=sentence_words).collect()}
    assert got == brute(rows, sentence_words)


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, f"{LONG}\n{LONG}\n\nx"), (2, f"y\n\n{LONG}\n{LONG}"), (3, LONG)], "doc_id long, text string")
    kept = {r.row.doc_id: r.kept for r in lines.drop_repeated_units(df, separator="\n\n").collect()}
    assert kept == {1: f"{LONG}\n{LONG}\n\nx", 2: "y", 3: LONG}


def test_whole_table_by_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert {tuple(r) for r in op3_line_dedup(spark, sf_dir).collect()} == set(duckdb.sql(ORACLE["op3_line_dedup"]).fetchall())


def test_each_text_moves_once_and_is_cut_in_tasks(spark):
    """Cutting in expressions and a second copy of each text beside its row cost more than the budget."""
    df = spark.createDataFrame([(1, f"{LONG}. x"), (2, f"É\x0b{LONG.upper()}\t \x0cz\n{LONG}. y")], "doc_id long, text string")
    done = lines.drop_repeated_units(df)
    assert "coalesce(text" not in done._jdf.queryExecution().optimizedPlan().toString()
    docs = df.selectExpr("struct(*) AS row", "doc_id AS doc", "xxhash64(text) AS mark")
    places = lines._places(docs, "\n", 8)
    assert "MapInArrow" in places._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.place.doc, r.place.line, r.place.sentence) for r in places.collect()) == [
        (1, 0, -1), (1, 0, 0), (2, 0, -1), (2, 0, 0), (2, 1, -1), (2, 1, 0)]
    assert {r.row.doc_id: (r.kept, [tuple(s) for s in r.removed]) for r in done.collect()} == {
        1: (f"{LONG}. x", []), 2: (f"É\x0b{LONG.upper()}\t \x0cz\ny", [(len(LONG) + 7, 2 * len(LONG) + 9)])}
