from __future__ import annotations


from pyspark.sql import functions as F

import pytest

from tidesift.sources import corpora, delimited, pools, stored


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_bad_and_short_lines(spark, tmp_path):
    put(tmp_path / "a.txt", "1\tone\tx\n2\ttwo\n3\tthree\ty\tz\n4\tNA\tw\n")
    df = delimited.read_table(spark, str(tmp_path / "a.txt"), columns=["id", "t", "u"], sep="\t", quoting=False)
    assert rows(df) == [("1", "one", "x"), ("2", "two", None), ("4", None, "w")]


def test_quotes_newlines_and_header_blanks(spark, tmp_path):
    put(tmp_path / "a.csv", 'id , lable\n1,"say ""hi"",\nnow"\n2,plain\n')
    df = delimited.read_table(spark, str(tmp_path / "a.csv"), variants={"lable": "label"}, types={"id": "long"}, multi_line=True)
    assert df.columns == ["id", "label"]
    assert rows(df) == [(1, 'say "hi",\nnow'), (2, "plain")]


def test_encodings(spark, tmp_path):
    for name in ("latin1", "cp437"):
        put(tmp_path / name / "a.csv", "t\ncafé\n", name)
        assert rows(delimited.read_table(spark, str(tmp_path / name), encoding=name)) == [("café",)]


def test_fraction_is_exact_with_copies(spark, tmp_path):
    put(tmp_path / "a.csv", "t\n" + "same\n" * 30 + "".join(f"row{i}\n" for i in range(11)))
    df = delimited.read_table(spark, str(tmp_path / "a.csv"), frac="0.5")
    assert df.count() == 20  # round half to even of 20.5


def test_write_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' pad "q", \n x '), (2, None)], "id long, t string")
    delimited.write_csv(df, str(tmp_path / "out"))
    assert rows(delimited.read_table(spark, str(tmp_path / "out"), types={"id": "long"}, multi_line=True)) == rows(df)


def test_two_event_corpus(spark, tmp_path):
    header = "tweet_id\ttext\tlabel\n"
    put(tmp_path / "nepal" / "2015_x_train.tsv", header + "'1'\ta b c\trelevant\n2\tdé\tnot_relevant\n", "latin1")
    put(tmp_path / "nepal" / "2015_x_dev.tsv", header + "3\ta b c\trelevant\n", "latin1")
    put(tmp_path / "elsewhere" / "2015_y_dev.tsv", header + "9\tskip me\trelevant\n", "latin1")
    df = corpora.read_corpus(spark, "ACL_ICWSM_2018", str(tmp_path))
    got = rows(df.select("tweet_id", "tweet_text", "informative", "event_name", "year"))
    assert got == [("1", "a b c", True, "2015 Nepal Earthquake", 2015), ("2", "dé", False, "2015 Nepal Earthquake", 2015)]
    assert '"file_name":"2015_x_train.tsv"' in df.filter("tweet_id = '1'").first()["meta"]


def test_multi_event_corpus(spark, tmp_path):
    path = tmp_path / "2013_Manila_floods" / "2013_Manila_floods-tweets_labeled.csv"
    put(
        path,
        "Tweet ID, Tweet Text, Information Source, Information Type, Informativeness\n"
        "1,water here,Media,Caution and advice,Related and informative\n"
        "2,hello,Media,Not applicable,Not related\n"
        "3,gone,Media,Not applicable,Not applicable\n",
    )
    df = corpora.read_corpus(spark, "CrisisLexT26", str(tmp_path))
    got = rows(df.select("tweet_id", "informative", "original_humanitarian_label"))
    assert got == [("1", True, "Caution and advice"), ("2", False, "Not applicable")]


def test_null_label_of_negative_rule(spark, tmp_path):
    path = tmp_path / "2013_Alberta_Floods" / "2013_Alberta_Floods-ontopic_offtopic.csv"
    put(path, "tweet id, tweet, label\n'11',one,off-topic\n'12',two,\n'13',three,on-topic\n")
    df = corpora.read_corpus(spark, "CrisisLexT6", str(tmp_path))
    assert rows(df.select("tweet_id", "informative")) == [("11", False), ("12", True), ("13", True)]


def test_multimodal(spark, tmp_path):
    header = "event_name\ttweet_id\timage_id\ttweet_text\timage\tlabel\tlabel_text\tlabel_image\tlabel_text_image\n"
    line = "hurricane_irma\t{}\ti\t{}\tp\t{}\ta\tb\tc\n"
    put(tmp_path / "task_informative.tsv", header + line.format(1, "one", "informative") + line.format(2, "two", "informative") + line.format(3, "three", "not_informative"))
    put(tmp_path / "task_humanitarian.tsv", header + line.format(1, "one", "affected_individuals") + line.format(3, "three", "not_humanitarian"))
    df = corpora.read_multimodal(spark, str(tmp_path))
    assert rows(df.select("tweet_id", "informative", "humanitarian_label")) == [
        ("1", True, "affected_individuals"),
        ("2", True, "unclassified"),
        ("3", False, "not_humanitarian"),
    ]


def test_two_crowds(spark, tmp_path):
    event = "2015_Nepal_Earthquake_en"
    put(tmp_path / "cf" / event / "a.tsv", "tweet_id\ttweet_text\tlabel\n'1'\tone\tinjured_or_dead_people\n'2'\ttwo\tnot_related_or_irrelevant\n'5'\tsame\tx\n'6'\tsame\tx\n")
    head = "tweet_id,tweet_text,label,tweet_time,tweet_author,tweet_author_id,tweet_language,tweet_lon,tweet_lat,tweet_url\n"
    put(tmp_path / "vo" / event / "b.csv", head + "'2',two,Money,t,a,1,en,,,u\n'3',three,Not relevant,t,a,1,en,,,u\n'4',vier,Money,t,a,1,de,,,u\n", "cp437")
    df = corpora.read_two_crowds(spark, str(tmp_path / "cf"), str(tmp_path / "vo"))
    assert rows(df.select("tweet_id", "informative", "country")) == [("1", True, "Nepal"), ("3", False, "Nepal")]


def test_eyewitness(spark, tmp_path):
    put(tmp_path / "a" / "floods_eyewitness_annotations_2000.tsv", "text\tlable\tlang\tcreated_at\none\tdont_know\ten\tMon Jan 01 2016\nzwei\tdont_know\tde\tMon Jan 01 2016\n")
    put(tmp_path / "c" / "hurricanes_eyewitness_crowdflower_2000.tsv", "id_str\ttext\tcreated_at\tplease_choose_a_category\t_golden\nid77\ttwo\tMon Jan 01 2017\tdirect-eyewitness\tFALSE\nid78\tgold\tMon Jan 01 2017\tdirect-eyewitness\tTRUE\n")
    df = corpora.read_eyewitness(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    got = rows(df.select("tweet_text", "informative", "event_type", "year", "original_informative_label"))
    assert got == [("one", False, "flood", 2016, "dont_know"), ("two", True, "storm", 2017, "direct_eyewitness")]
    assert df.filter("tweet_text = 'two'").first()["tweet_id"] == "77"


def test_unify(spark):
    schema = "tweet_id string, tweet_text string, informative boolean, humanitarian_label string, event_name string, dataset string"
    a = spark.createDataFrame([("1", "x", True, "Unknown", "Cyclone Idai", "A"), ("2", "y", True, None, "z", "A")], schema)
    b = spark.createDataFrame([("1", "other", False, None, "z", "B"), ("3", "y", False, "odd", "z", "B")], schema)
    extra = ["event_type", "original_informative_label", "original_humanitarian_label", "meta"]
    a, b = (df.withColumns({c: F.lit(None).cast("string") for c in extra} | {"year": F.lit(1)}) for df in (a, b))
    df = corpora.unify([a, b])
    got = rows(df.select("tweet_id", "humanitarian_label", "event_name"))
    assert got == [("1", "unknown_or_unclassified", "2019 Cyclone Idai"), ("2", None, "z")]
    assert sorted(r["uid"] for r in df.collect()) == [1, 2]


def test_experiment_partitions_are_pruned(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    for n in (0, 5):
        stored.write_experiment(df, str(tmp_path / "e"), "isolated", n, n)
    part = stored.read_experiment(spark, str(tmp_path / "e"), "isolated", 5, 5, "test")
    assert part.count() == 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(strategy" in plan and "PushedFilters: []" in plan


def test_noise_pools(spark, tmp_path):
    put(tmp_path / "Sanders Analytics Sentiment-labelled tweets" / "full-corpus.csv", "Topic,TweetText\napple,hey @Apple do it\n")
    put(tmp_path / "Customer Support on Twitter" / "twcs" / "twcs.csv", "author_id,text\n" + "12,please help @12 now\n" * 10)
    put(tmp_path / "twitter_cikm_2010" / "test_set_tweets.txt", "1\t2\tone two three\t2010\n1\t2\tone two\t2010\n")
    put(tmp_path / "Sentiment of Climate Change" / "1377884570_tweet_global_warming.csv", "tweet\nit is warm\nit is warm\n")
    with pytest.raises(FileNotFoundError, match="Twitter_Data.csv"):
        pools.read_noise_pools(spark, str(tmp_path), offset=100)
    absent = {s.file for s in pools.SOURCES} - {"full-corpus.csv", "twcs/twcs.csv", "test_set_tweets.txt", "1377884570_tweet_global_warming.csv"}
    weather, out_topic = pools.read_noise_pools(spark, str(tmp_path), 100, absent)
    assert rows(weather.select("uid", "tweet_text", "informative", "subset")) == [(101, "it is warm", False, "weather")]
    assert sorted(r["uid"] for r in out_topic.collect()) == [102, 103, 104]
    texts = {r["tweet_text"] for r in out_topic.collect()}
    assert texts == {"hey @USER do it", "please help @USER now", "one two three"}


def test_every_file_has_its_own_header(spark, tmp_path):
    put(tmp_path / "t" / "1.csv", "a,b\n1,x\n2,y,bad\n")
    put(tmp_path / "t" / "2.csv", "b,a\nz,3\n")
    put(tmp_path / "t" / "3.csv", " a ,bb,c\n4,w,more\n")
    put(tmp_path / "t" / "4.csv", "")
    df = delimited.read_table(spark, str(tmp_path / "t"), variants={"bb": "b"})
    assert sorted(map(tuple, df.select("a", "b", "c").collect())) == [("1", "x", None), ("3", "z", None), ("4", "w", "more")]
    with pytest.raises(Exception, match="more fields"):
        delimited.read_table(spark, str(tmp_path / "t"), variants={"bb": "b"}, bad_lines="error").collect()


def test_large_files_are_split(spark, tmp_path):
    put(tmp_path / "big.csv", "id,t\n" + "".join(f"{i},some text of line {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = delimited.read_table(spark, str(tmp_path / "big.csv"), types={"id": "long"})
        assert df.rdd.getNumPartitions() > 4
        assert df.agg({"id": "sum"}).first()[0] == 19_999 * 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nonnumeric_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 'say "x", y', None)], "i int, d double, t string, n string")
    delimited.write_csv(df.coalesce(1), str(tmp_path / "q"), quote="nonnumeric")
    text = "".join(f.read_text() for f in (tmp_path / "q").glob("part-*"))
    assert text.splitlines()[:2] == ['"i","d","t","n"', '1,2.5,"say ""x"", y",""']
