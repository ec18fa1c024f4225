"""The Unicode forms against the interpreter's: every code point, and sequences of what joins and what is joined."""

import random
import sys
import unicodedata

from stmtflow.functions import text, unicode

EVERY = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]


def normed(t):
    return " ".join(unicodedata.normalize("NFKC", t).split()).upper()


def check(spark, texts):
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.norm("t"), text.casefold("t")).collect()
    assert [r[0] for r in out] == texts
    for t, n, f in out:
        assert (n, f) == (normed(t), t.casefold()), [hex(ord(c)) for c in t]


def test_every_code_point(spark):
    joining = unicode._tables()[1].joining
    changing = [c for c in EVERY if normed(c) != c or c.casefold() != c or c in joining]
    check(spark, changing)
    known = set(changing)
    rest = [c for c in EVERY if c not in known]
    # what stands for itself does so beside its like
    check(spark, ["".join(rest[i : i + 500]) for i in range(0, len(rest), 500)])


def test_sequences(spark):
    joins = unicode._tables()[1]
    rng = random.Random(3)
    marks = sorted(joins.joining)
    bases = [*joins.pair_values, *unicode.SYLLABLES[:3000:7], *unicode.LEADS, *unicode.VOWELS, *unicode.TAILS, *"aeiouAEn ½ﬁ㎏¨ \t¼ßŉ"]
    texts = ["".join(rng.choice(marks if rng.random() < 0.5 else bases) for _ in range(rng.randrange(1, 12))) for _ in range(8000)]
    check(spark, texts)


def test_long_texts_and_no_workers(spark):
    check(spark, ["Zażółć gęślą jaźń ｶﾞ½ " * 3000, "e" + "̣́" * 200, "가" * 5000 + "ᄀ" + "ᅡ" + "ᆨ"])
    plan = spark.range(1).selectExpr("cast(id as string) t").select(text.norm("t"), text.loose_key("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_key_fields_together(spark):
    rng = random.Random(4)
    parts = ["Shop", "  two  blanks ", "Zürich", "ﬁn ①", "é", "", None, " ", "a\x1fb", "tab\there", "ＡＢ", "plain text"]
    rows = [tuple(rng.choice(parts) for _ in range(3)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    out = frame.select("*", text.norm_joined([frame.a, frame.b, frame.c], "\x1f").alias("n")).collect()
    assert all(r.n == "\x1f".join(normed(t or "") for t in r[:3]) for r in out)
