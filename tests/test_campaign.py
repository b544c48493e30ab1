"""Campaign plans against a step-by-step replay."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators import campaign as camp


def replay(rows, variants, cap, stops):
    out, sent, fallback, stop = {}, 0, 0, False
    for seq, outcome, own, valid, media_ok in rows:
        if not valid:
            out[seq] = ("invalid_input", None)
            continue
        if stop:
            out[seq] = ("skipped", None)
            continue
        message = own or (variants[fallback % len(variants)] if variants else None)
        if not message:
            out[seq] = ("no_message", None)
            continue
        if not media_ok:
            out[seq] = ("media_invalid", message)
            continue
        out[seq] = (outcome, message)
        if outcome == "sent":
            sent += 1
            fallback += not own
        if outcome in stops or (cap and sent >= cap):
            stop = True
    return out


@pytest.mark.parametrize("variants", [[], ["a"], ["a", "b", "c"]])
@pytest.mark.parametrize("cap", [0, 5])
def test_plan_equals_replay(spark, variants, cap):
    rnd = random.Random(cap + len(variants))
    rows = [(c, i, rnd.choice(["sent", "sent", "error", "rate_limited" if rnd.random() < 0.2 else "error"]), rnd.choice(["", None, f"m{i}"]),
             rnd.random() < 0.9, rnd.random() < 0.9) for c in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "campaign int, seq bigint, outcome string, row_message string, valid boolean, media_ok boolean")
    plan = camp.plan_campaigns(df.repartition(5), variants, cap=cap, stop_on=["rate_limited"], blocks=7)
    got = {}
    for r in plan.collect():
        got.setdefault(r["campaign"], {})[r["seq"]] = (r["status"], r["message"])
    for c in range(4):
        assert got[c] == replay([r[1:] for r in rows if r[0] == c], variants, cap, {"rate_limited"})
        if cap:
            assert sum(s == "sent" for s, _ in got[c].values()) <= cap


def test_titles(spark):
    long = "word " * 80
    cases = [("", ("Hello", "")), ("Short note", ("Short note", "")), ("Head  line\n\n body ", ("Head line", "body")),
             ("One. Two.\nThree", ("One.", "One. Two.\nThree")), (long.strip(), (long[:298].rstrip() + "…", long.strip())), (None, ("Hello", ""))]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, m string")
    got = [(r["t"]["title"], r["t"]["body"]) for r in df.select("i", camp.title_body(F.col("m")).alias("t")).orderBy("i").collect()]
    assert got == [c[1] for c in cases]


def test_addresses(spark):
    df = spark.createDataFrame([("https://x.com/IN/Ann-1/?a", None), (None, "/in/bob"), ("carl/", None), ("https://x.com/company/1", None), (None, None)], "url string, link string")
    site = "https://www.linkedin.com/in/"
    assert [r["canonical_url"] for r in camp.canonical_profile_url(df).collect()] == [site + "Ann-1/", site + "bob/", site + "carl/", "", ""]
    names = ["r/python", "https://www.reddit.com/r/Ask_Me/about?x", "python", "u/me", "/user/me", "ab", "two words", "xr/python"]
    df = spark.createDataFrame([(n,) for n in names], "subreddit string")
    assert [r["canonical_community"] for r in camp.canonical_community(df).collect()] == ["python", "Ask_Me", "python", "", "", "", "", ""]


def test_variants_and_media(spark):
    df = spark.createDataFrame([(' a || b\nc ||', ), ('["x", " ", "y||z"]', ), ("[broken || b", ), (None, )], "m string")
    assert [r["v"] for r in df.select(camp.parse_variants(F.col("m"), collapse=True).alias("v")).collect()] == [["a", "b c"], ["x", "y||z"], ["[broken", "b"], []]
    image, video, pdf = ("i", "image/PNG", 5), ("v", "video/mp4", 5), ("p", "application/pdf", 5)
    cases = [([], "", "", ""), ([image], "images", "", "files"), ([video], "video", "", "files"), ([video] * 2, "", "too many videos", "files"), ([image, video], "", "images and video mixed", "files"),
             ([image] * 21, "", "too many images", ""), ([pdf], "", "unsupported type", "files"), ([("e", "image/gif", 0)], "", "empty file", ""), ([("n", "image/gif", None)], "", "missing file", ""), ([image] * 11, "images", "", "")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, f array<struct<name:string,mime:string,size:bigint>>")
    rows = df.select("i", camp.validate_media(F.col("f"), "gallery").alias("g"), camp.validate_media(F.col("f"), "message").alias("m")).orderBy("i").collect()
    for r, (_, kind, detail, message) in zip(rows, cases):
        assert (r["g"]["kind"], r["g"]["detail"], r["m"]["kind"]) == (kind, detail, message)
