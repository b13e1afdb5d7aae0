import random

from pyspark.sql import functions as F

from weftline.llm import spam as S

R = random.Random(6)
NOUNS = [a + b for a in "ba ke li mo nu ra so ti".split() for b in "dor lix mun pel rag sot van zim".split()]


def sentence():
    return f"The {R.choice(NOUNS)} must hold each {R.choice(NOUNS)} before it is sent to the {R.choice(NOUNS)}."


def ham(i):
    kind = i % 7
    if kind == 4:
        return "\n".join(f"# {sentence()}\n{R.choice(NOUNS)} = {R.choice(NOUNS)} + load(x, {k})\nreturn {R.choice(NOUNS)}" for k in range(R.randrange(4, 12)))
    if kind == 5:
        return f"# {R.choice(NOUNS)} {R.choice(NOUNS)}\n\n{sentence()} {sentence()}\n\n" + "\n".join(f"- {R.choice(NOUNS)} of the {R.choice(NOUNS)} is `{R.choice(NOUNS)}()`" for _ in range(R.randrange(3, 9)))
    if kind == 6:
        return "\n".join(f"SELECT {R.choice(NOUNS)}_id, COUNT({R.choice(NOUNS)})\nFROM {R.choice(NOUNS)}\nWHERE {R.choice(NOUNS)} > {R.randrange(99)};" for _ in range(R.randrange(2, 7)))
    if kind == 0:
        return " ".join(sentence() for _ in range(R.randrange(4, 12)))
    if kind == 1:
        return "\n".join(f"def {R.choice(NOUNS)}_{k}(x):\n    return x[{k}] + {R.choice(NOUNS)}(x)" for k in range(R.randrange(4, 12)))
    if kind == 2:
        return "\n".join(f"{R.choice(NOUNS)}:\n  {R.choice(NOUNS)}: {R.randrange(900)}\n  on: true" for _ in range(R.randrange(5, 15)))
    return "a,b,c\n" + "\n".join(f"{k},{R.random():.3f},{R.choice(NOUNS)}" for k in range(R.randrange(10, 30)))


def spam(i):
    few = R.sample(NOUNS, 4)
    kind = i % 4
    if kind == 0:
        return " ".join(f"buy {R.choice(few)} {R.choice(few)} near me" for _ in range(R.randrange(20, 50)))
    if kind == 1:
        return "\n".join(f"http://www.{R.choice(NOUNS)}{R.choice(NOUNS)}.example/{R.randrange(99)}" for _ in range(R.randrange(15, 50)))
    if kind == 2:
        return sentence() + " " + " ".join(f"#{R.choice(few)}{R.randrange(20)}" for _ in range(R.randrange(30, 60)))
    return "<html>" + "".join(f'<a href="http://{R.choice(NOUNS)}.test/{k}">{R.choice(few)} {R.choice(few)}</a> ' for k in range(R.randrange(20, 50))) + "</html>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "d bigint, t string, h string, id int, f string")


def corpus():
    rows = [(i, spam(i // 6) if i % 6 == 0 else ham(i), f"host{i % 9}" if i % 10 else None, 0, "") for i in range(1200)]
    rows += [(2000, None, "h", 0, ""), (2001, "", "h", 0, ""), (2002, "\n", None, 0, ""), (2003, ham(0) * 3000, "h", 0, "")]
    return rows, {i for i in range(0, 1200, 6)}


def test_pages_without_a_label(spark):
    rows, want = corpus()
    got = S.scores(frame(spark, rows), "d", "t", "h").collect()
    open_ = {r["id"] for r in got if r["weak"] is None}
    found = {r["id"] for r in got if r["score"] >= S.THRESHOLD}
    assert len(open_ & want) > 30 and len(open_ - want) > 150
    assert len(found & want & open_) >= 0.9 * len(want & open_) and len((found - want) & open_) <= 0.1 * len(found & open_)
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)
    wrong = [r["id"] for r in got if r["weak"] is not None and (r["weak"] == 1.0) != (r["id"] in want)]
    assert len(wrong) <= 0.01 * len(got)
    assert not {2000, 2001, 2002} & {r["id"] for r in got}


def test_hosts_settle_doubtful_pages(spark, monkeypatch):
    """The same doubtful page on a host of spam and on a clean one."""
    monkeypatch.setattr(S, "extract", lambda docs, *_: docs.select("id", "host", F.array(F.lit(0.0)).alias("f"), "weak"))
    monkeypatch.setattr(S, "_trees", lambda *_, **__: None)
    monkeypatch.setattr(S, "_scored", lambda _, t: t.withColumn("own", F.coalesce("weak", F.lit(0.35))))
    rows = [(i, "bad", 1.0) for i in range(60)] + [(100 + i, "good", 0.0) for i in range(600)] + [(900, "bad", None), (901, "good", None), (902, None, None), (903, "tiny", 1.0), (904, "tiny", None)]
    got = {r["id"]: r for r in S.scores(spark.createDataFrame(rows, "id bigint, host string, weak double"), "id", "id", "host").withColumn("by", S.decided_by()).collect()}
    assert got[900]["score"] >= S.THRESHOLD > got[901]["score"] and got[902]["score"] == got[900]["own"]
    assert got[900]["by"] == "host" and got[901]["by"] == "trees" and got[0]["by"] == "label"
    assert abs(got[904]["score"] - got[904]["own"]) < got[900]["score"] - got[900]["own"]  # one page says little of a host


def test_one_class_and_empty(spark):
    assert S.spam_pages(frame(spark, []), "d", "t", "h").count() == 0
    rows = [(i, spam(1), "h", 0, "") for i in range(8)]
    assert S.spam_pages(frame(spark, rows), "d", "t", "h").count() == 8


def test_licence_header_is_left_out_however_long():
    head = "// Copyright 2020 the authors.\n// Licensed for any purpose.\n\n"
    body = "\n".join(f"int a{k} = {k};" for k in range(5))
    assert S.body_of(head + body).strip() == body and S.body_of(body) == body
    long = "\n".join(["/* Copyright the authors"] + [" * Permission is given to use this for any purpose and without a fee" for _ in range(60)] + ["*/"])
    assert S.body_of(long + "\n" + body).strip() == body
    prose = "Copyright 2020 of the authors. All rights are with them.\n\nPermission is granted to anyone who has a copy of this, and no warranty is given.\n\n"
    assert S.body_of(prose + body).strip() == body
    words = "/* crack licence download crack licence full crack licence */"
    assert S.body_of(words) == words  # no sentences: not a header


def test_short_pages_and_other_scripts_have_features():
    assert S.look("") is None and S.look(" \n 12 ;") is None
    assert S.look("four words are here")[0][S.FEATURES.index("unique")] == 1.0
    eleven = "\n".join(f"http://a{k}.test/{k}" for k in range(11))
    assert S.look(eleven)[1] == 1.0
    cyrillic = S.look(" ".join(["купить дешево", "заказать дешево"] * 40))
    assert cyrillic[0][S.FEATURES.index("top10")] == 1.0 and cyrillic[1] == 1.0
    long = S.look("buy " * 3_000_000)  # whole texts, in time that grows with them
    assert long[0][S.FEATURES.index("top10")] == 1.0
