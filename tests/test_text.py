"""Per-row rules against hand-worked values, and against Python's own text functions."""

import html
import re
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions import text as tx
from nabd.functions.dates import iso_day, post_day
from nabd.functions.unicode import with_display_text, with_nfc, with_search_text, with_unescaped
from nabd.functions.values import format_fixed, round_exact, safe_int_number, safe_int_text
from nabd.operators.clean import with_clean_text
from nabd.operators.sentiment import dominant_sentiment, sentiment_class, with_lexicon_sentiment


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v")).alias("r")).first()[0]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, v string")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("i").select(name).collect()]


@pytest.mark.parametrize(
    "given_text, light, full",
    [
        ("أَحْمَد", "احمد", "احمد"),
        ("كتـاب", "كتـاب", "كتاب"),
        ("مسؤول", "مسؤول", "مسوول"),
        ("٢٠٢٤ ۲۰۲۴", "٢٠٢٤ ۲۰۲۴", "2024 2024"),
        ("  المدرسة\u00a0\u2003إلى ", "  المدرسه\u00a0\u2003الي ", "المدرسه الي"),
        (None, "", ""),
    ],
)
def test_search_forms(spark, given_text, light, full):
    assert one(spark, given_text, tx.search_key) == light
    df = with_search_text(texts(spark, [given_text]), F.col("v"), "n")
    assert column(df, "n") == [full]


def test_names(spark):
    assert set(one(spark, "RT @Ali: x@mail5.example.com @ali", tx.mentions)) == {"ali", "mail5"}
    assert one(spark, "#Big_Data #ab #a #big_data", tx.hashtags) == ["big_data", "ab"]
    assert one(spark, None, tx.mentions) == []
    for text, expected in [
        ("RT @Ali: x", True),
        ("rt\u00a0@محمد: x", True),
        ("x RT @ali: y", False),
        ("RT @a-b: c", False),
        ("RT ali: c", False),
    ]:
        assert one(spark, text, tx.is_retweet) is expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("RT @bob: WOW!!!! #Big_Data https://t.co/x \U0001f600", "WOW! Big Data"),
        ("A &amp; B", "A B"),
        ("a &lt;b&gt; &#1587; &eacute;", "a b س"),
        ("#ab_cd_##x_y#zz_z! _q #a", "ab cd #x yzz z! _q #a"),
        ("؟؟؟؟ ... ?? !!!", "؟ . ?? !"),
        ("see WWW.x.com/a and HTTP://y", "see and"),
        ("ش" + "\u064e\u0651" + " آ", unicodedata.normalize("NFC", "ش\u064e\u0651 آ")),
        ("", ""),
        (None, ""),
    ],
)
def test_clean(spark, text, expected):
    assert column(with_clean_text(texts(spark, [text]), "v", "c"), "c") == [expected]


def test_clean_options(spark):
    df = texts(spark, ["hi @bob_x #tag_a \U0001f600"])
    kept = with_clean_text(df, "v", "c", keep_mention_text=True, keep_hashtag_text=False)
    assert column(kept, "c") == ["hi bob_x"]


def test_hashtag_rule_against_a_replacement_function(spark):
    pattern = re.compile(r"#([A-Za-z0-9_\u0621-\u064A]{2,50})")
    cases = [
        "#a_b", "#_", "#__", "#_a", "##a_b_c", "x#y_z#", "#" + "a_" * 40, "#س_ش_ a_b", "#a-_b",
        "\ue000a_b #c_d",
    ]
    want = [pattern.sub(lambda m: m.group(1).replace("_", " "), c).replace("\ue000", "\ue001") for c in cases]
    got = column(texts(spark, cases).withColumn("v", tx._open_hashtags(F.col("v"))))
    assert got == want


def test_valid(spark):
    for text, expected in [("مرحبا", False), ("abcdefgh", False), ("سلام abcd", True), ("  سلا abcd ", True)]:
        assert one(spark, text, tx.is_valid_text) is expected


def test_topic_document(spark):
    df = texts(spark, ["The DATA على أنا، data-set x"])
    df = with_search_text(df, F.col("v"), "n")
    # The listed form of this stop word is not the normalized one, so it stays unless asked for.
    assert column(df.withColumn("v", tx.topic_document(F.col("n")))) == ["data علي انا، data set"]
    fixed = df.withColumn("v", tx.topic_document(F.col("n"), normalize_stopwords=True))
    assert column(fixed) == ["data انا، data set"]


def test_terms(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>")
    rows = df.select(
        tx.one_and_two_grams(F.col("w")).alias("g"), tx.term_occurrences(F.col("w")).alias("o")
    ).collect()
    assert rows[0].g == ["b", "a", "b", "b a", "a b"]
    assert [tuple(x) for x in rows[0].o] == [("a", True), ("b", False), ("b", True)]
    assert rows[1].g == [] and rows[1].o == []


def test_nfc_and_entities_touch_only_what_they_must(spark):
    samples = ["e\u0301", "plain", "ا\u0654", "\u212b", "가", "a&nbsp;b", "&bad", "AT&T", "&#x41;", "& x"]
    df = texts(spark, samples)
    assert column(with_nfc(df, "v")) == [unicodedata.normalize("NFC", s) for s in samples]
    assert column(with_unescaped(df, "v")) == [html.unescape(s) for s in samples]
    shown = with_display_text(df, F.col("v"), "v")
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFC", s)).strip() for s in samples]
    assert column(shown) == want


def test_nfc_safe_characters_never_change():
    """No character of the safe list changes, combines, or composes with one before it."""
    second = set()
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    for low, high in re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", fv.NFC_SAFE):
        for c in range(int(low, 16), int(high, 16) + 1):
            assert unicodedata.normalize("NFC", chr(c)) == chr(c)
            assert unicodedata.combining(chr(c)) == 0 and c not in second


def test_kept_characters_match_the_rule(spark):
    """The listed class equals: not Arabic, Arabic Supplement, ASCII letters and digits, \\s, marks."""
    rule = re.compile(r"[^\u0600-\u06FF\u0750-\u077Fa-zA-Z0-9\s@#_.,!?؟،؛:'\"\-]")
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "i int, v string")
    got = {r.i for r in df.filter(F.col("v").rlike(fv.OUTSIDE_KEPT_CHARS)).collect()}
    assert got == {c for c in points if rule.search(chr(c))}
    space = {r.i for r in df.filter(F.col("v").rlike(f"[{fv.WHITESPACE}]")).collect()}
    assert space == {c for c in points if chr(c).isspace()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab_#@ !؟سـَّآ\u0654\u0653٣é&;\n\u00a0", max_size=25), min_size=8, max_size=8))
def test_normalization_equals_python(spark, values):
    def full(s):
        s = unicodedata.normalize("NFC", s)
        s = re.sub("[\u064b-\u065f\u0670\u0640]", "", s)
        s = "".join(fv.FULL_LETTERS.get(c, c) for c in s)
        s = s.translate(str.maketrans(fv.ARABIC_DIGITS, fv.ASCII_DIGITS))
        return re.sub(r"\s+", " ", s).strip().lower()

    df = with_search_text(texts(spark, values), F.col("v"), "n")
    assert column(df, "n") == [full(v) for v in values]


def test_rounding_is_pythons(spark):
    values = [2.675, 0.125, 12.25, 12.35, 0.5, 1.5, 2.5, 0.0005, 0.0025, 99.995, 100.0, 66.67, 1e9 + 0.35]
    values += [i / 700 for i in range(700)] + [round(i / 7, 2) for i in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cols = [round_exact(F.col("v"), d).alias(f"r{d}") for d in range(5)]
    cols += [format_fixed(F.col("v"), d).alias(f"f{d}") for d in (1, 2)]
    for row in df.select("v", *cols).collect():
        for d in range(5):
            assert row[f"r{d}"] == float(round(row.v, d)), (row.v, d)
        for d in (1, 2):
            assert row[f"f{d}"] == f"{row.v:.{d}f}"
    assert one(spark, -2.5, round_exact, "double") == -2.0


def test_safe_integers(spark):
    for text, expected in [("12", 12), (" -3 ", -3), ("5.7", 0), ("x", 0), (None, 0), ("9" * 30, 0)]:
        assert one(spark, text, safe_int_text) == expected
    assert one(spark, 5.7, safe_int_number, "double") == 5
    assert one(spark, None, safe_int_number, "double") == 0


def test_days(spark):
    def lenient(c):
        return iso_day(post_day(c))

    def strict(c):
        return iso_day(post_day(c, strict=True))

    cases = [
        ("2024-01-01T10:00:00", "2024-01-01", "2024-01-01"),
        ("2024-01-01T10:00:00Z", "2024-01-01", None),
        ("2024-01-01", "2024-01-01", "2024-01-01"),
        ("Mon Jan 01 10:00:00 +0000 2024", None, None),
        ("n/a", None, None),
        (None, None, None),
    ]
    for text, day, strict_day in cases:
        assert one(spark, text, lenient) == day
        assert one(spark, text, strict) == strict_day


def test_sentiment_rules(spark):
    for label, expected in [
        ("LABEL_2", "positive"), ("LABEL_1", "neutral"), ("Negative", "negative"), ("", "neutral"),
        (None, "neutral"), (" POS ", "positive"), ("0", "negative"), ("positive-negative", "positive"),
    ]:
        assert one(spark, label, sentiment_class) == expected
    df = texts(spark, ["great badge", "I love it", "great love good", "", "BAD hate terrible سيء زفت فظيع مقرف"])
    rows = with_lexicon_sentiment(df, F.col("v")).orderBy("i").collect()
    got = [(r.sentiment, r.score) for r in rows]
    assert got == [
        ("neutral", 0.55), ("positive", 0.6), ("positive", 0.8), ("neutral", 0.55), ("negative", 0.95),
    ]


def test_dominant_sentiment_ties(spark):
    shares = spark.createDataFrame(
        [(40.0, 40.0, 20.0), (20.0, 40.0, 40.0), (10.0, 20.0, 70.0)], "p double, u double, n double"
    )
    tones = shares.select(dominant_sentiment(F.col("p"), F.col("u"), F.col("n"))).collect()
    assert [t[0] for t in tones] == ["positive", "neutral", "negative"]


@pytest.mark.parametrize("least", [0, 1, 2, 8])
def test_valid_text_counts_what_strip_leaves(spark, least):
    values = ["", " ", "ابت", "  ابت  ", " ابت defg ", "\u3000ابتdefgh\n", "ابت\n\n\n\n\nd", "ابتdef\U0001f600", "ا" + " " * 9]
    df = texts(spark, values)
    got = {r.i for r in df.filter(tx.is_valid_text(F.col("v"), least, 0)).collect()}
    assert got == {i for i, v in enumerate(values) if len(v.strip()) >= least}


def test_classes_by_table_match_as_their_ranges_do_and_faster(spark):
    """Every character but surrogates; then 4 MB of Latin text, which the ranges walked one by one."""
    kinds = {
        "space": fv.WHITESPACE,
        "other_space": fv.WHITESPACE_NOT_SPACE,
        "emoji": fv.EMOJI.removeprefix("[").removesuffix("]+"),
        "outside": fv.OUTSIDE_KEPT_CHARS[1:-1],
    }
    codes = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text = spark.createDataFrame([("".join(map(chr, codes)),)], "v string")
    for members in kinds.values():
        plain, quick = (F.sha2(F.regexp_replace("v", c, "\x00"), 256) for c in (f"[{members}]", tx.one_of(members)))
        assert text.select(plain == quick).first()[0]
    wanted = {"NFC_MAYBE": rf"[^{fv.NFC_SAFE}]", "NFC_MAYBE_FOR_SEARCH": rf"[^{fv.NFC_SAFE}\x{{64B}}-\x{{65F}}\x{{670}}]"}
    single = spark.createDataFrame([(chr(i),) for i in codes[:0x30000]], "v string")
    for name, plain in wanted.items():
        assert single.filter(F.col("v").rlike(plain) != F.col("v").rlike(getattr(fv, name))).isEmpty()

    def took(pattern):
        latin = spark.range(400).select(F.repeat(F.concat(F.lit("plain words "), "id"), 700).alias("v"))
        start = time.perf_counter()
        latin.select(F.sum(F.length(F.regexp_replace("v", pattern, " ")))).collect()
        return time.perf_counter() - start

    plain, quick = (min(took(c) for _ in range(3)) for c in (fv.OUTSIDE_KEPT_CHARS, tx.one_of(kinds["outside"])))
    assert quick < plain


def test_texts_without_signs_skip_their_patterns(spark):
    """The pattern of a sign is tried only where the sign is; the same texts come out."""
    df = spark.createDataFrame([("plain text",)], "v string").select(tx.remove_markup(F.col("v")).alias("r"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert all(sign in plan for sign in ("://)", "!!!)", "RT)", ", @)"))
    texts = ["rT @x: a", "a RT @xy: b", "hTTps://q w", "WwW.a b", "wWw.", "@ab c", "a!!!! b", "؟؟؟؟", "...", "..", "x http:/y"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    got = [r.r for r in rows.select(tx.remove_markup(F.col("v")).alias("r")).collect()]
    assert got == ["a", "a RT  : b", "  w", "  b", "wWw.", "  c", "a! b", "؟", ".", "..", "x http: y"]
