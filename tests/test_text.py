from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidesift.functions import fixed_values as fixed
from tidesift.functions import text as tx
from tidesift.operators import clean, labels
from tidesift.operators.profile import bag_of_ngrams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SOLAR = (
    "Bizarre side effect of solar panels causes rainstorms in the driest place on Earthhhhhhhh!!!! "
    "@postandcourier 😢!!!!!!!! https://www.uniladtech.com/science/news/solar-540247?fbclid=IwY2_9g…"
)


def test_normalize_plain(spark):
    expected = (
        "Bizarre side effect of solar panels causes rainstorms in the driest place on Earthhh ! ! ! "
        "@USER 😢 ! ! ! HTTPURL ..."
    )
    assert one(spark, tx.normalize_text(F.lit(SOLAR))) == expected


def test_normalize_bertweet(spark):
    text = one(spark, tx.normalize_text(F.lit("<3 >:[ " + SOLAR), "bertweet"))
    assert text.startswith(":red_heart: :enraged_face: Bizarre")
    assert ":crying_face: ! ! ! HTTPURL" in text


@pytest.mark.parametrize(
    "text, expected",
    [
        ("I cannot go", "I can not go"),
        ("he didn't go", "he did n't go"),
        ("he didn 't go", "he didn 't go"),
        ("I ca n't", "I can't"),
        ("it ai n't", "it ain't"),
        ("I'm here", "I 'm here"),
        ("we're here", "we 're here"),
        ("it's here", "it 's here"),
        ("he'll go", "he 'll go"),
        ("he'd go", "he 'd go"),
        ("we've gone", "we 've gone"),
        ("at 5 p . m .", "at 5  p.m."),
        ("at 5 p . m now", "at 5 p.m now"),
        ("at 5 a . m .", "at 5 a.m."),
        ("at 5 a . m now", "at 5 a.m now"),
    ],
)
def test_contractions(spark, text, expected):
    by_hand = text
    for old, new in fixed.CONTRACTION_RULES:
        by_hand = by_hand.replace(old, new)
    assert one(spark, tx.split_contractions(F.lit(text))) == by_hand
    if "didn 't" not in text:
        assert by_hand == expected


def test_emoticons_longest_first(spark):
    assert one(spark, tx.emoticons_to_emoji(F.lit(">:-) and :-)"))) == "😈 and 🙂"
    # the reversed entry has the shortest key, so it comes last and its result stays
    assert one(spark, tx.emoticons_to_emoji(F.lit("😜"))) == ";-P"


def test_abbreviations(spark):
    assert one(spark, tx.expand_abbreviations(F.lit("from here"))) == "for realom here"
    assert one(spark, tx.expand_abbreviations(F.lit("from fr lol"), "token")) == "from for real laughing out loud"
    with pytest.raises(ValueError):
        tx.expand_abbreviations(F.lit("x"), "words")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("abc", ["abc"]),
        ("abcde", ["abcde"]),
        ("abcdef", ["abcde", "bcdef"]),
        ("aaaaaaa", ["aaaaa"]),
        ("ab😢defg", ["ab😢de", "b😢def", "😢defg"]),
        ("a\nbcdef", ["a\nbcd", "\nbcde", "bcdef"]),
    ],
)
def test_shingles(spark, text, expected):
    assert one(spark, tx.char_shingles(F.lit(text))) == expected


def test_norm_ws(spark):
    assert one(spark, tx.norm_ws(F.lit("  A \t b\n"))) == "a b"
    assert one(spark, tx.norm_ws(F.lit(None).cast("string"))) == ""


def test_one_two_grams(spark):
    assert one(spark, tx.one_two_grams(F.lit("The cat, a Cat_1 é"))) == ["the", "cat", "cat_1", "the cat", "cat cat_1"]
    assert one(spark, tx.one_two_grams(F.lit("a b"))) == []
    assert one(spark, tx.one_two_grams(F.lit("word"))) == ["word"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("see http://a.b/c?d=1, ok", ["see", "http://a.b/c?d=1", ",", "ok"]),
        ("www.x.com now", ["www.x.com", "now"]),
        ("@Some_1 said #tag-a!", ["@Some_1", "said", "#tag-a", "!"]),
        ("well-known don't 3.5 7", ["well-known", "don't", "3.5", "7"]),
        ("so :-) <3 >:[ :D", ["so", ":-)", "<3", ">:[", ":D"]),
        ("waaaaait.... what", ["waaait", "...", "what"]),
        ("Größe über", ["Größe", "über"]),
        ("mail a.b@c.org x", ["mail", "a.b@c.org", "x"]),
    ],
)
def test_social_tokenize(spark, text, tokens):
    assert one(spark, tx.social_tokenize(F.lit(text))) == tokens


def test_masks(spark):
    assert one(spark, tx.mask_token(F.lit("@me"))) == "@USER"
    assert one(spark, tx.mask_token(F.lit("HTTPS://x"))) == "HTTPURL"
    assert one(spark, clean.mask_names(F.lit("hi @Google and @apple"), ["google", "apple"])) == "hi @USER and @USER"
    assert one(spark, clean.mask_author(F.lit("@12 and @123"), F.lit(12))) == "@USER and @USER3"


def test_ids_and_years(spark):
    assert one(spark, clean.clean_id(F.lit("'99999999999999999999'"))) == "99999999999999999999"
    assert one(spark, clean.digits_of(F.lit("ID: 0042x7"))) == "0042"
    assert one(spark, clean.digits_of(F.lit("none"))) is None
    assert one(spark, clean.year_from_tail(F.lit("Sat Apr 25 07:00:00 +0000 2015"))) == 2015


def test_null_labels(spark):
    null = F.lit(None).cast("string")
    assert one(spark, labels.binarize(null, negative=["off-topic"])) is True
    assert one(spark, labels.binarize(null, positive=["relevant"])) is False
    assert one(spark, labels.binarize(F.lit("off-topic"), negative=["off-topic"])) is False
    with pytest.raises(ValueError):
        labels.binarize(null)


def test_label_maps(spark):
    df = spark.createDataFrame([("caution_and_advice",), ("Unknown",), (None,)], "label string")
    mapped = [r[0] for r in df.select(labels.map_labels(F.col("label"), fixed.HUMANITARIAN_LABELS)).collect()]
    assert mapped == [None, "unknown_or_unclassified", None]
    report = labels.unmapped_report(df, "label", fixed.HUMANITARIAN_LABELS).collect()
    assert [tuple(r) for r in report] == [("caution_and_advice", 1)]
    kept = df.select(labels.map_labels(F.lit("Some Event"), fixed.EVENT_NAMES, "keep").alias("x")).first()["x"]
    assert kept == "Some Event"


def test_lookup_event_fail(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    events = spark.createDataFrame([("a", "Event A")], "k string, event_name string")
    assert labels.lookup_event(rows, events, "k").count() == 1
    with pytest.raises(Exception, match="unknown event: b"):
        labels.lookup_event(rows, events, "k", "fail").collect()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_min_words(spark, n):
    texts = ["", "  ", "one", " one two ", "one two three", "a\u00a0b\nc\td", None]
    df = spark.createDataFrame([(t,) for t in texts], "tweet_text string")
    kept = [r[0] for r in clean.min_words(df, n=n).collect()]
    assert kept == [t for t in texts if t is not None and len(t.split()) >= n]


def test_any_of_finds_every_key(spark):
    for table in (fixed.EMOTICONS, fixed.ABBREVIATIONS, fixed.EMOJI_NAMES, dict(fixed.CONTRACTION_RULES), {"^]": "a", "[-": "b", "&&é": "c", "😀x": "d"}):
        keys = list(table)
        texts = [f"zz{key}zz" for key in keys] + ["", "zz", "é😺漢".replace("😺", "") + "!"]
        found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(tx._any_of(keys))).collect()
        assert [r[0] for r in found] == [any(k in t for k in keys) for t in texts]


def test_replace_all_is_key_after_key(spark):
    def plain(text, table):
        for key in sorted(table, key=len, reverse=True):
            text = text.replace(key, table[key])
        return text

    texts = ["a:-) >:-)😜 :P", "xDXD -_-' </3<3", "lol tl;dr from dm imo", "漢字 ❤️ 😺", "nothing", ""]
    for table in (fixed.EMOTICONS, fixed.ABBREVIATIONS, {"ab": "cc", "cc": "ab", "": "x", "a": "b", "b": "ab", "c": "d"}):
        used = {k: v for k, v in table.items() if k}
        for text in [*texts, "abccab"]:
            assert one(spark, tx.replace_all(F.lit(text), table)) == plain(text, used)


def test_collapse_ws_of_every_blank(spark):
    for blank in ["  ", "\t", "\n \n", " ", "  ", " 　", "\x1c", "\x85", "    "]:
        assert one(spark, tx.collapse_ws(F.lit(f" a{blank}b c{blank}"))).rstrip() == "a b c"


def test_styles_tokenize_once(spark):
    text = "can't :-) @me http://a.b/c lol  x . . . y"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    both = df.select(F.inline(F.array(tx.normalize_styles(F.col("t")))))
    assert [tuple(r) for r in both.collect()] == [tuple(one(spark, tx.normalize_text(F.lit(text), s)) for s in ("plain", "bertweet")), (None, None)]
    with pytest.raises(ValueError):
        tx.normalize_styles(F.col("t"), ("other",))


def test_bag_of_ngrams_moves_only_repeated_ids(spark):
    rows = [(1, "a cat the cat the cat"), (2, "x"), (3, None), (4, "one two"), (4, "two one two"), (None, "dog"), (None, "dog dog")]
    df = spark.createDataFrame(rows, "uid long, tweet_text string").coalesce(2)
    found = {r["uid"]: tuple(r)[1:] for r in bag_of_ngrams(df).collect()}
    assert found == {
        1: (4, 9, 3, "cat"),
        4: (4, 8, 3, "one"),
        None: (2, 4, 3, "dog"),
    }


def test_bag_of_ngrams_shuffles_no_grams_of_single_rows(spark):
    df = spark.createDataFrame([(i, f"word{i} other") for i in range(5)], "uid long, tweet_text string")
    plan = bag_of_ngrams(df)._jdf.queryExecution().optimizedPlan().toString()
    single = plan.split("Union")[1].split("Aggregate")[0]
    assert "LeftAnti" in single and "Generate inline" in single and "explode" not in single
