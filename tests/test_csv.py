"""CSV of any shape, in one split or many, against a sequential parser."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from oreflow.functions import rng
from oreflow.sources import files


def plain(text, delimiter):
    """One sign at a time."""
    text, rows, row, own, inside, i = text.removeprefix("﻿"), [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                own += '"'
                i += 1
            elif c == '"':
                inside = False
            else:
                own += c
        elif c == '"':
            inside = True
        elif c == delimiter:
            row.append(own)
            own = ""
        elif c in "\r\n":
            i += c == "\r" and text[i + 1 : i + 2] == "\n"
            rows.append([*row, own])
            row, own = [], ""
        else:
            own += c
        i += 1
    if row or own:
        rows.append([*row, own])
    return [r for r in rows if len(r) > 1 or r[0].strip()]


def written(tmp_path, text, name="x.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def texts_of(spark, path, **more):
    rows = files.read_csv(spark, path, place="__at", **more).orderBy("__at")
    return [tuple(r)[:-1] for r in rows.collect()]


def as_read(cell):
    return None if cell is None or not cell.strip(" ") else cell


@pytest.mark.parametrize("text", [
    'a,b,c\nab"c,d"e,5,x\n"q""q",,y\n', 'a;b;c\r\n1;"x\r\ny";z\r\n\r\n  \r\n2;;w', "a,b,c\r1,x,y\r2,z\r", '﻿a|b|c\nx|"y\n\nz"|w\nv', 'k,k,\nx,y,z,extra\nw\n',
    'a,b,c\n"open, to the end\nof, the file', 'a,b,c\n"x""",""""y,"""z"""\n"","",w\n', 'a,b,c\n"x"y"z",1 2,"\r"\n', 'a,b,c\nx,"y"\r\nz,w,v\rq,r,s\n',
])
def test_shapes(spark, tmp_path, text):
    path = written(tmp_path, text)
    head, *rows = plain(text, files.sniff(text.removeprefix("﻿").split("\n")[0].split("\r")[0]))
    want = [tuple(as_read(r[i]) if i < len(r) else None for i in range(len(head))) for r in rows]
    got = [tuple(str(int(v)) if isinstance(v, float) else v for v in r) for r in texts_of(spark, path)]
    assert got == want
    assert files.read_csv(spark, path).columns == files.header_names(head)


def test_many_splits_keep_every_record(spark, tmp_path):
    r = random.Random(5)
    cells = ["x", "", "a b", 'say "hi"', "l1\nl2", "c,d", "\n\n", "e\r\nf", "é💥", "7"]
    show = lambda c: '"' + c.replace('"', '""') + '"' if any(s in c for s in '",\n\r') else c
    rows = [[f"r{i}", *[r.choice(cells) for _ in range(3)]] for i in range(3000)]
    rows[1500][2] = "long\n" * 4000  # over several splits
    rows[2200][1] = ('"' + "z" * 9 + "\n") * 900
    path = written(tmp_path, "id,a,b,c\n" + "".join(",".join(map(show, x)) + "\n" for x in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = files.read_csv(spark, path, place="at")
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        got = [tuple(q) for q in df.orderBy("at").collect()]
        assert [q[-1] for q in got] == list(range(3000))
        assert [q[:-1] for q in got] == [tuple(as_read(c) for c in x) for x in rows]
        first = files.read_csv(spark, path, ["id"], max_rows=7, place="at").orderBy("at").collect()
        assert [q["id"] for q in first] == [f"r{i}" for i in range(7)]
        # The reservoir is that of one pass over the rows in file order.
        kept = list(range(50))
        for i, u in enumerate(rng.draws(42, 2950)):
            if (j := int(u * (i + 51))) < 50:
                kept[j] = i + 50
        sample = files.read_csv(spark, path, ["id"], max_rows=50, mode="sample", seed=42)
        assert sorted(q["id"] for q in sample.collect()) == sorted(f"r{i}" for i in kept)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_reservoir_projection_and_quotes(spark, tmp_path):
    path = written(tmp_path, 'id,text\n1,"a,b"\n2,"say ""hi"""\n3,last')
    out = files.read_csv(spark, path, ["text"], max_rows=2, mode="sample", seed=42)
    u = rng.draws(42, 1)[0]
    kept = ["a,b", 'say "hi"']
    if int(u * 3) < 2:
        kept[int(u * 3)] = "last"
    assert out.columns == ["text"] and sorted(r["text"] for r in out.collect()) == sorted(kept)


def test_two_hundred_thousand_lines(spark, tmp_path):
    path = written(tmp_path, "x\n" + "".join(f"{i}\n" for i in range(200_000)))
    assert files.read_csv(spark, path).agg(F.count("*"), F.sum("x")).first()[:] == (200_000, 199_999 * 100_000)


def test_folders_and_errors(spark, tmp_path):
    written(tmp_path, "a,b\n1,x\n", "p1.csv")
    written(tmp_path, "a,b\n2,y\n3,\n", "p2.csv")
    assert texts_of(spark, str(tmp_path)) == [(1.0, "x"), (2.0, "y"), (3.0, None)]
    for text in ("", "\n \n"):
        with pytest.raises(ValueError, match="no header"):
            files.read_csv(spark, written(tmp_path, text, "e.txt"))
    with pytest.raises(ValueError, match="lacks nope"):
        files.read_csv(spark, str(tmp_path / "p1.csv"), ["nope"])
    assert files.read_csv(spark, written(tmp_path, "only,names", "h.txt")).count() == 0
