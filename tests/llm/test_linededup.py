import collections
import random

from tesserine.llm import linededup, queries
from tests.llm.conftest import ALL, SF, keys

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, limit=linededup.WEIGHT):
    """The numbers of the lines that go, by document."""
    weight = lambda x: 1 + x.count(" ")
    docs = {i: [(n, x.strip(BLANK)) for n, x in enumerate((t or "").split("\n")) if x.strip(BLANK)] for i, t in rows}
    first, gone = {}, collections.defaultdict(set)
    for i in sorted(docs):
        own = docs[i]
        for j in range(len(own)):
            total, e = 0, j
            while e < len(own):
                total += weight(own[e][1])
                if total >= limit:
                    break
                e += 1
            if total < limit:
                continue
            window = tuple(x for _, x in own[j : e + 1])
            if window not in first:
                first[window] = i, j, e
                continue
            fi, fj, fe = first[window]
            other = docs[fi]
            a, fa, run = j, fj, 0
            while a and fa and own[a - 1][1] == other[fa - 1][1] and run + weight(own[a - 1][1]) <= limit:
                run += weight(own[a - 1][1])
                a, fa = a - 1, fa - 1
            b, fb = e, fe
            while b + 1 < len(own) and fb + 1 < len(other) and own[b + 1][1] == other[fb + 1][1] and sum(weight(x) for _, x in own[j : b + 1]) < 2 * limit:
                b, fb = b + 1, fb + 1
            begin = max(own[a][0], other[fe][0] + 1) if fi == i else own[a][0]
            gone[i].update(range(begin, own[b][0] + 1))
    return gone


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, texts = brute(rows), dict(rows)
    for r in linededup.dedup_lines(df).collect():
        was = (texts[r["doc_id"]] or "").split("\n")
        assert (r["text"] or "") == "\n".join(x for n, x in enumerate(was) if n not in want[r["doc_id"]]), r["doc_id"]
        assert r["n_removed"] == len(want[r["doc_id"]])
    return want


def test_query_over_the_table(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, texts = brute(rows), dict(rows)
    got = queries.op9_line_dedup(spark, SF).collect()
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) == sum(map(len, want.values())) > 0
    assert all(r["text"] == "\n".join(x for n, x in enumerate(texts[r["doc_id"]].split("\n")) if n not in want[r["doc_id"]]) for r in got)


def test_random_documents(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 12, 45]))) for _ in range(30)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(8)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            lines += rng.choice(runs) if rng.random() < 0.6 else [f"own {i} {rng.randrange(99)}", " " * rng.randrange(3)]
        rows.append((i, "\n".join(lines)))
    assert sum(map(len, check(spark, rows).values())) > 50


def test_long_passages_go_and_short_lines_stay(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"one\nAll rights reserved.\n{passage}"), (2, f"{passage}\ntwo\nAll rights reserved."), (3, f"x\n{passage}\n{passage}\ny")]
    check(spark, rows)
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "two\nAll rights reserved.", 3: "x\ny"}


def test_no_line_is_lost_everywhere(spark, docs):
    out = queries.op9_line_dedup(spark, SF).collect()
    left = {x.strip(BLANK) for r in out for x in (r["text"] or "").split("\n")}
    assert {x.strip(BLANK) for r in docs.collect() for x in (r["text"] or "").split("\n")} - {""} <= left


def test_odd_rows(odd, none):
    out = linededup.dedup_lines(odd)
    rows = out.collect()
    assert keys(rows) == ALL and out.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert [r["text"] for r in rows if r["doc_id"] == 3] == [None] and [r["text"] for r in rows if r["doc_id"] == 4] == [""]
    twice = [r["text"] for r in rows if r["doc_id"] == 2]
    assert len(twice) == 2 and len(set(twice)) == 1
    assert linededup.dedup_lines(none).collect() == []


def test_no_python_in_the_plan(docs):
    plan = linededup.windows(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
