"""Queries for sources, cleaning, labels, sets, exact dedup and text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.functions import fixed_values as fixed
from tidesift.functions import text as tx
from tidesift.operators import clean, dedup, labels, sets, splits
from tidesift.operators.greedy import Unfinished
from tidesift.operators.neardup import near_dedup_minhash
from tidesift.operators.profile import bag_of_ngrams, token_length_profile
from tidesift.operators.vector_search import embed_text, near_dedup_radius
from tidesift.plans.registry import place, query, split_sql
from tidesift.plans.similarity_sql import MINHASH_DEDUP_SQL, RADIUS_DEDUP_SQL
from tidesift.plans.views import CORPUS_SQL, corpus, scratch, table, texts, vectors
from tidesift.sources import delimited, stored

WITH_CORPUS = f"WITH {CORPUS_SQL}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_sql(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {quote(old)}, {quote(new)})"
    return expr


def longest_first(mapping) -> list:
    return [(k, mapping[k]) for k in sorted(mapping, key=len, reverse=True)]


def mapping_sql(mapping) -> str:
    return ", ".join(f"({quote(k)}, {quote(v)})" for k, v in mapping.items())


def norm_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expr}, '')), '{tx.WS}+', ' ', 'g'))"


def words_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '{tx.WS}+'), lambda w: w <> '')"


# ---- sources and sinks -------------------------------------------------------


@query("A1_read_table", "SELECT doc_id AS uid, text AS tweet_text, lang FROM documents")
def _(spark, sf):
    path = scratch(spark, "csv")
    delimited.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    return delimited.read_table(
        spark, path, rename={"doc_id": "uid", "text": "tweet_text", "lang": "lang"}, types={"uid": "long"}, multi_line=True
    )


@query(
    "A2_read_event_files",
    """SELECT doc_id AS uid, text AS tweet_text, 'event ' || substr(source, 4) AS event_name FROM documents
       WHERE CAST(substr(source, 4) AS INTEGER) < 15""",
)
def _(spark, sf):
    root = scratch(spark, "events")
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    options = {"header": True, "quoteAll": True, "escape": '"'}
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # three files per event: other orders, a misspelt name, a further column
    shapes = [
        docs.select("doc_id", "text", "source"),
        docs.select("text", "doc_id", "source"),
        docs.select(F.col("doc_id").alias(" doc_id"), F.lit("x").alias("more"), F.col("text").alias("txt "), "source"),
    ]
    for i, shape in enumerate(shapes):
        third = shape.filter(F.col("doc_id" if i < 2 else "` doc_id`") % 3 == i)
        third.write.mode("append").partitionBy("source").options(**options, **blanks).csv(root)
    known = docs.select("source").distinct().filter(F.substring("source", 4, 10).cast("int") < 15)
    events = known.select(
        F.concat(F.lit("source="), "source").alias("event_key"),
        F.concat(F.lit("event "), F.substring("source", 4, 10)).alias("event_name"),
    )
    rows = delimited.read_event_files(spark, root, "*.csv", events, variants={"txt": "text"}, multi_line=True)
    return rows.select(F.col("doc_id").cast("long").alias("uid"), F.col("text").alias("tweet_text"), "event_name")


@query("A3_clean_header", "SELECT item_id AS tweet_id, text AS label FROM benchmark")
def _(spark, sf):
    odd = table(spark, sf, "benchmark").toDF(" tweet_id ", "lable ")
    return delimited.clean_header(odd, {"lable": "label", "Lable": "label"})


@query(
    "A4_union_by_name",
    """SELECT text AS tweet_text, lang, NULL::VARCHAR AS role, doc_id AS uid FROM documents
       UNION ALL SELECT text, NULL, role, NULL FROM conversations
       UNION ALL SELECT text, NULL, NULL, item_id FROM benchmark""",
)
def _(spark, sf):
    return sets.union_by_name(
        table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("tweet_text"), "lang"),
        table(spark, sf, "conversations").select(F.col("text").alias("tweet_text"), "role"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("uid"), F.col("text").alias("tweet_text")),
    )


@query("A5_write_csv", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    path = scratch(spark, "csv")
    delimited.write_csv(table(spark, sf, "conversations"), path, quote="nonnumeric")
    return delimited.read_table(spark, path, types={"conv_id": "long", "turn": "long"}, multi_line=True)


@query(
    "A6_experiment_sets",
    f"{WITH_CORPUS}, {split_sql('corpus', 'informative', '0.1', '0.1', 'parts')} "
    "SELECT uid, informative, split FROM parts WHERE split = 'validation'",
)
def _(spark, sf):
    root = scratch(spark, "experiments")
    parts = splits.stratified_split(corpus(spark, sf), "informative")
    for n in (0, 20):
        stored.write_experiment(parts.select("uid", "informative", "split"), root, "crossed", n, n)
    part = stored.read_experiment(spark, root, "crossed", 20, 20, "validation")
    return part.select("uid", "informative", F.col("split").cast("string").alias("split"))


@query(
    "A7_export_views",
    f"""{WITH_CORPUS} SELECT 'full' AS view, uid, tweet_text, informative, humanitarian_label FROM corpus
    UNION ALL SELECT 'informative', uid, tweet_text, informative, NULL FROM corpus
    UNION ALL SELECT 'humanitarian', uid, NULL, NULL, humanitarian_label FROM corpus WHERE humanitarian_label IS NOT NULL""",
)
def _(spark, sf):
    root = scratch(spark, "views")
    views = {
        "full": (["uid", "tweet_text", "informative", "humanitarian_label"], None),
        "informative": (["uid", "tweet_text", "informative"], None),
        "humanitarian": (["uid", "humanitarian_label"], F.col("humanitarian_label").isNotNull()),
    }
    stored.export_views(corpus(spark, sf), {f"{root}/{name}": view for name, view in views.items()})
    read = [spark.read.parquet(f"{root}/{name}").withColumn("view", F.lit(name)) for name in views]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def _resumed(run) -> DataFrame:
    """Stop ``run`` after its first turn, then go on with it."""
    try:
        run(stop_after=1)
    except Unfinished:
        pass
    return run()


@query("A8_resumable_dedup", MINHASH_DEDUP_SQL)
def _(spark, sf):
    texts, folder = corpus(spark, sf).select("uid", "tweet_text"), scratch(spark, "turns")
    return _resumed(lambda **stop: near_dedup_minhash(texts, resume=folder, first_block=1, **stop)).select("uid")


@query("A8_resumable_dedup_radius", RADIUS_DEDUP_SQL)
def _(spark, sf):
    rows, folder = vectors(spark, sf), scratch(spark, "turns")
    return _resumed(
        lambda **stop: near_dedup_radius(rows, 0.35, train="hash", resume=folder, first_block=8, **stop)
    ).select("uid")


@query(
    "A9_stored_embeddings",
    """SELECT vec_id AS uid, CAST(len(embedding) AS INTEGER) AS dim,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, 'given' AS model_name
       FROM embeddings""",
)
def _(spark, sf):
    path = scratch(spark, "embeddings")
    stored.write_embeddings(vectors(spark, sf), path, "given")
    rows = stored.read_embeddings(spark, path, "given")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select("uid", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"), "model_name")


# ---- projections, filters, ids ----------------------------------------------


@query(
    "B1_to_canonical",
    """SELECT CAST(doc_id AS VARCHAR) AS tweet_id, text AS tweet_text, CAST(NULL AS BOOLEAN) AS informative,
              source AS event_name, CAST(NULL AS INTEGER) AS year FROM documents""",
)
def _(spark, sf):
    schema = T.StructType(
        [
            T.StructField("tweet_id", T.StringType()),
            T.StructField("tweet_text", T.StringType()),
            T.StructField("informative", T.BooleanType()),
            T.StructField("event_name", T.StringType()),
            T.StructField("year", T.IntegerType()),
        ]
    )
    names = {"doc_id": "tweet_id", "text": "tweet_text", "source": "event_name"}
    return clean.to_canonical(table(spark, sf, "documents"), names, schema)


@query(
    "B2_with_constants",
    "SELECT doc_id AS uid, 'web' AS dataset, CAST(2013 AS INTEGER) AS year, 'storm' AS event_type FROM documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    return clean.with_constants(docs, {"dataset": "web", "year": 2013, "event_type": "storm"})


@query(
    "B3_meta",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events""",
)
def _(spark, sf):
    packed = clean.pack_meta(table(spark, sf, "events"), ["props", "event_type"])
    return packed.select(
        "event_id",
        clean.meta_get(clean.meta_get(F.col("meta"), "props"), "k").alias("k"),
        clean.meta_get(F.col("meta"), "event_type").alias("kind"),
    )


@query(
    "B4_clean_id",
    """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS stripped,
              nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS digits FROM customer""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer")
    quoted = F.concat(F.lit("'"), F.col("c_custkey").cast("string"), F.lit("'"))
    return rows.select("c_custkey", clean.clean_id(quoted).alias("stripped"), clean.digits_of(F.col("c_name")).alias("digits"))


@query(
    "B5_synthetic_id",
    f"""WITH g AS (SELECT doc_id AS uid, source, text, md5(source || '|' || text) AS k FROM documents)
        SELECT uid, md5(source || '|' || text || '|' || CAST({place('k')} AS VARCHAR)) AS tweet_id FROM g""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "uid")
    return clean.synthetic_id(docs, ["source", "text"], order="uid").select("uid", "tweet_id")


@query("B6_assign_uid", f"SELECT doc_id, 1000 + {place(key='doc_id')} AS uid FROM documents")
def _(spark, sf):
    return clean.assign_uid(table(spark, sf, "documents"), "doc_id", offset=1000).select("doc_id", "uid")


@query("B7_year_from_tail", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def _(spark, sf):
    text = F.date_format("o_orderdate", "E MMM dd HH:mm:ss yyyy")
    return table(spark, sf, "orders").select("o_orderkey", clean.year_from_tail(text).alias("year"))


@query(
    "B8_mask_handles",
    """SELECT doc_id AS uid, replace('to @USER and @' || doc_id || ' ' || text, '@' || doc_id, '@USER') AS author_masked,
              regexp_replace('@en @EN ' || text, '@en', '@USER', 'gi') AS name_masked FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    own = F.concat(F.lit("to @USER and @"), F.col("doc_id").cast("string"), F.lit(" "), "text")
    return docs.select(
        F.col("doc_id").alias("uid"),
        clean.mask_author(own, F.col("doc_id")).alias("author_masked"),
        clean.mask_names(F.concat(F.lit("@en @EN "), "text"), ["en"]).alias("name_masked"),
    )


@query("B9_drop_nulls", f"{WITH_CORPUS} SELECT uid, quality, toxic FROM corpus WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, sf):
    return clean.drop_nulls(corpus(spark, sf).select("uid", "quality", "toxic"))


@query("B10_min_words", f"SELECT doc_id AS uid FROM documents WHERE len({words_sql('text')}) >= 3")
def _(spark, sf):
    return clean.min_words(texts(spark, sf)).select("uid")


@query(
    "B11_has_or_lacks_label",
    f"{WITH_CORPUS} SELECT uid, CASE WHEN humanitarian_label IS NULL THEN 'B' ELSE 'H' END AS population FROM corpus",
)
def _(spark, sf):
    rows = corpus(spark, sf).select("uid", "humanitarian_label")
    with_label = clean.has_label(rows).select("uid", F.lit("H").alias("population"))
    return with_label.unionByName(clean.lacks_label(rows).select("uid", F.lit("B").alias("population")))


@query("B12_drop_golden", f"{WITH_CORPUS} SELECT uid, toxic FROM corpus WHERE toxic = 0")
def _(spark, sf):
    rows = corpus(spark, sf).withColumn("_golden", F.col("toxic") == 1)
    return clean.drop_golden(rows).select("uid", "toxic")


@query("B13_only_language", "SELECT doc_id AS uid, lang FROM documents WHERE lang = 'en'")
def _(spark, sf):
    return clean.only_language(table(spark, sf, "documents")).select(F.col("doc_id").alias("uid"), "lang")


@query(
    "B14_list_predicates",
    f"""{WITH_CORPUS} SELECT uid, event_type, humanitarian_label FROM corpus
        WHERE event_type IN ('en', 'fr') AND humanitarian_label IS DISTINCT FROM '1'""",
)
def _(spark, sf):
    rows = clean.include_values(corpus(spark, sf), "event_type", ["en", "fr"])
    return clean.exclude_values(rows, "humanitarian_label", ["1"]).select("uid", "event_type", "humanitarian_label")


@query("B15_tag_subset", "SELECT conv_id, turn, 'out_topic' AS subset, false AS informative FROM conversations")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return clean.tag_subset(rows, "out_topic", noise=True)


# ---- labels -------------------------------------------------------------------


@query(
    "C1_binarize",
    f"""{WITH_CORPUS} SELECT uid, coalesce(humanitarian_label IN ('1'), false) AS by_positive,
        NOT coalesce(humanitarian_label IN ('1'), false) AS by_negative FROM corpus""",
)
def _(spark, sf):
    label = F.col("humanitarian_label")
    return corpus(spark, sf).select(
        "uid",
        labels.binarize(label, positive=["1"]).alias("by_positive"),
        labels.binarize(label, negative=["1"]).alias("by_negative"),
    )


# Part types as stand-in labels: some are in the mapping, others are not.
PART_LABELS = {"STANDARD": "common", "SMALL": "common", "ECONOMY": "cheap"}
PART_LABEL_SQL = f"""WITH m(src, dst) AS (VALUES {mapping_sql(PART_LABELS)}),
p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS label FROM part)"""


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("label"))


@query("C2a_map_labels_null", f"{PART_LABEL_SQL} SELECT p_partkey, dst AS mapped FROM p LEFT JOIN m ON label = src")
def _(spark, sf):
    return _parts(spark, sf).select("p_partkey", labels.map_labels(F.col("label"), PART_LABELS).alias("mapped"))


@query(
    "C2b_map_labels_keep",
    f"{PART_LABEL_SQL} SELECT p_partkey, coalesce(dst, label) AS mapped FROM p LEFT JOIN m ON label = src",
)
def _(spark, sf):
    mapped = labels.map_labels(F.col("label"), PART_LABELS, missing="keep")
    return _parts(spark, sf).select("p_partkey", mapped.alias("mapped"))


@query(
    "C2c_unmapped_report",
    f"""{PART_LABEL_SQL} SELECT label, count(*) AS n_rows FROM p WHERE label NOT IN (SELECT src FROM m)
        AND label IS NOT NULL GROUP BY label""",
)
def _(spark, sf):
    return labels.unmapped_report(_parts(spark, sf), "label", PART_LABELS)


@query(
    "C3_lookup_event",
    """SELECT c_custkey, n_name AS event_name, r_name AS event_type FROM customer
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""",
)
def _(spark, sf):
    events = (
        table(spark, sf, "nation")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .filter(F.col("r_name") != "ASIA")
        .select(
            F.col("n_nationkey").alias("event_key"), F.col("n_name").alias("event_name"), F.col("r_name").alias("event_type")
        )
    )
    rows = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "event_key")
    return labels.lookup_event(rows, events, "event_key").select("c_custkey", "event_name", "event_type")


TASKS_SQL = """tasks AS (
  SELECT uid AS tweet_id, CASE WHEN informative THEN 'informative' ELSE 'not_informative' END AS label FROM corpus
  UNION ALL
  SELECT uid, CASE WHEN NOT informative THEN 'not_humanitarian' ELSE 'kind_' || humanitarian_label END
  FROM corpus WHERE humanitarian_label IS NOT NULL)"""


def _tasks(spark, sf):
    rows = corpus(spark, sf)
    first = rows.select(
        F.col("uid").alias("tweet_id"),
        F.when(F.col("informative"), "informative").otherwise("not_informative").alias("label"),
    )
    second = rows.filter(F.col("humanitarian_label").isNotNull()).select(
        F.col("uid").alias("tweet_id"),
        F.when(~F.col("informative"), "not_humanitarian")
        .otherwise(F.concat(F.lit("kind_"), "humanitarian_label"))
        .alias("label"),
    )
    return first.unionByName(second)


@query(
    "C4_resolve_task_overlap",
    f"""{WITH_CORPUS}, {TASKS_SQL},
    kept AS (SELECT * FROM tasks WHERE label <> 'not_humanitarian')
    SELECT tweet_id, label FROM kept WHERE NOT (label = 'informative' AND tweet_id IN (
      SELECT tweet_id FROM kept WHERE label NOT IN ('informative', 'not_informative')))""",
)
def _(spark, sf):
    return labels.resolve_task_overlap(_tasks(spark, sf))


@query(
    "C5_derive_label",
    f"""{WITH_CORPUS}, {TASKS_SQL} SELECT tweet_id, CASE label WHEN 'not_informative' THEN 'not_humanitarian'
        WHEN 'informative' THEN 'unclassified' ELSE label END AS label FROM tasks""",
)
def _(spark, sf):
    return _tasks(spark, sf).select("tweet_id", labels.derive_label(F.col("label")).alias("label"))


@query(
    "C6_relabel_safety_net",
    f"""{WITH_CORPUS} SELECT uid, 'not_humanitarian' AS humanitarian_label FROM corpus
        WHERE NOT informative AND probability >= 0.5""",
)
def _(spark, sf):
    rows = corpus(spark, sf).withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    return labels.relabel_safety_net(rows).select("uid", "humanitarian_label")


# ---- joins and sets -----------------------------------------------------------


@query("D1_keep_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    good = table(spark, sf, "labels").filter(F.col("quality") == 1)
    return sets.keep_ids(table(spark, sf, "documents"), good, "doc_id").select("doc_id", "lang")


@query("D2_drop_ids", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return sets.drop_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "lang")


@query(
    "D3_merge_left",
    """SELECT d.doc_id AS uid, coalesce(l.quality, CAST(d.n_chars % 2 AS INTEGER)) AS final_prediction
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").withColumn("stage_1", (F.col("n_chars") % 2).cast("int"))
    merged = sets.merge_left(rows, table(spark, sf, "labels"), "quality", "stage_1", "final_prediction", key="doc_id")
    return merged.select(F.col("doc_id").alias("uid"), "final_prediction")


@query(
    "D4_attach_labels",
    """WITH one AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY ALL)
       SELECT c_custkey, label FROM customer LEFT JOIN one ON c_custkey = o_custkey""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey")
    other = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"), "o_orderkey"
    )
    return sets.attach_labels(rows, other, "label", key="c_custkey", order="o_orderkey")


@query(
    "D5_key_difference",
    """SELECT c_custkey, 'buyer' AS kind FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders)
       UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(spark, sf):
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    everyone = table(spark, sf, "customer").select("c_custkey", F.lit("idle").alias("kind"))
    return sets.append_missing(buyers.withColumn("kind", F.lit("buyer")), everyone, "c_custkey")


@query(
    "D6_set_relation",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders),
       n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
                    (SELECT count(*) FROM a JOIN b USING (k)) AS n_both)
       SELECT *, n_both = n_a AS is_subset, n_both = n_b AS is_superset, n_both = n_a AND n_both = n_b AS is_equal FROM n""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return sets.set_relation(a, b, "k")


@query(
    "D7_split_value_overlap",
    f"""{WITH_CORPUS}, {split_sql('corpus', 'informative', '0.1', '0.1', 'parts')}
    SELECT md5({norm_sql('tweet_text')}) AS digest, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits
    FROM parts GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def _(spark, sf):
    parts = splits.stratified_split(corpus(spark, sf), "informative")
    hashed = parts.select("split", F.md5(tx.norm_ws(F.col("tweet_text"))).alias("digest"))
    return sets.split_value_overlap(hashed, "digest")


# ---- exact dedup --------------------------------------------------------------


@query(
    "E1_dedup_first",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang, source, n_chars ORDER BY doc_id) AS i FROM documents),
       b AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS j FROM a WHERE i = 1)
       SELECT doc_id, lang FROM b WHERE j = 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents")
    return dedup.dedup_chain(rows, [["lang", "source", "n_chars"], ["text"]], "doc_id").select("doc_id", "lang")


@query(
    "E2_dedup_last",
    """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS i FROM documents)
       WHERE i = 1""",
)
def _(spark, sf):
    return dedup.dedup(table(spark, sf, "documents"), ["text"], "doc_id", keep="last").select("doc_id", "lang")


@query(
    "E3_dedup_none",
    "SELECT doc_id, lang FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1",
)
def _(spark, sf):
    return dedup.dedup(table(spark, sf, "documents"), ["text"], "doc_id", keep="none").select("doc_id", "lang")


@query("E4_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, sf):
    return dedup.distinct_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query(
    "E5_duplicate_report",
    """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
       SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_members,
              CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_extra, coalesce(max(n), 0) AS largest_group FROM g""",
)
def _(spark, sf):
    return dedup.duplicate_report(table(spark, sf, "documents"), ["text"])


@query("E6_exact_prepass", f"SELECT min(doc_id) AS uid FROM documents GROUP BY {norm_sql('text')}")
def _(spark, sf):
    return dedup.exact_prepass(texts(spark, sf)).select("uid")


@query(
    "E7_drop_cross_source",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (
         SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT
         SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders")
    return dedup.drop_cross_source(rows, "F", "P", key="o_custkey", source="o_orderstatus").select("o_orderkey", "o_custkey")


# ---- text ----------------------------------------------------------------------


@query("F1_norm_ws", f"SELECT doc_id AS uid, {norm_sql('text')} AS norm FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("uid", tx.norm_ws(F.col("tweet_text")).alias("norm"))


@query(
    "F2_char_shingles",
    f"""WITH t AS (SELECT doc_id AS uid, {norm_sql('text')} AS s FROM documents),
    g AS (SELECT uid, list_distinct(CASE WHEN s = '' THEN [] WHEN length(s) <= 5 THEN [s]
      ELSE list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5)) END) AS grams FROM t)
    SELECT uid, len(grams) AS n_shingles, list_min(grams) AS lowest, list_max(grams) AS highest FROM g""",
)
def _(spark, sf):
    grams = texts(spark, sf).select("uid", tx.char_shingles(tx.norm_ws(F.col("tweet_text"))).alias("grams"))
    return grams.select(
        "uid",
        F.size("grams").cast("long").alias("n_shingles"),
        F.array_min("grams").alias("lowest"),
        F.array_max("grams").alias("highest"),
    )


@query(
    "F3_bag_of_ngrams",
    f"""WITH t AS (SELECT doc_id AS uid, regexp_extract_all(lower(text), '{tx.WORD}{{2,}}') AS w FROM documents),
    g AS (SELECT uid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM t),
    c AS (SELECT uid, gram, count(*) AS n FROM g GROUP BY ALL)
    SELECT uid, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_grams, max(n) AS most, min(gram) AS lowest
    FROM c GROUP BY uid""",
)
def _(spark, sf):
    return bag_of_ngrams(texts(spark, sf))


TYPOGRAPHY_SQL = "replace(replace({}, '’', ''''), '…', '...')"


@query("F4_fix_typography", f"SELECT doc_id AS uid, {TYPOGRAPHY_SQL.format('text')} AS fixed FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("uid", tx.fix_typography(F.col("tweet_text")).alias("fixed"))


@query(
    "F5_mask_tokens",
    f"""WITH t AS (SELECT page_id, {words_sql("'by @' || page_id || ' ' || url || ' ' || html")} AS w FROM pages)
    SELECT page_id, array_to_string(list_transform(w, lambda x: CASE WHEN starts_with(x, '@') THEN '@USER'
      WHEN starts_with(lower(x), 'http') OR starts_with(lower(x), 'www') THEN 'HTTPURL' ELSE x END), ' ') AS masked FROM t""",
)
def _(spark, sf):
    text = F.concat(F.lit("by @"), F.col("page_id").cast("string"), F.lit(" "), "url", F.lit(" "), "html")
    tokens = tx.mask_tokens(tx.words(text))
    return table(spark, sf, "pages").select("page_id", F.array_join(tokens, " ").alias("masked"))


@query(
    "F6_social_tokenize",
    # tokens leave out blanks and nothing else; runs of a character are cut at three
    f"""WITH c AS (SELECT doc_id AS uid, string_split(coalesce(text, ''), '') AS c FROM documents),
    k AS (SELECT uid, list_filter(c, lambda x, i: i < 4 OR NOT (x = c[i - 1] AND x = c[i - 2] AND x = c[i - 3])) AS c FROM c)
    SELECT uid, regexp_replace(array_to_string(c, ''), '{tx.WS}+', '', 'g') AS joined FROM k""",
)
def _(spark, sf):
    tokens = tx.social_tokenize(F.col("tweet_text"))
    return texts(spark, sf).select("uid", F.array_join(tokens, "").alias("joined"))


@query(
    "F7_split_contractions",
    f"SELECT doc_id AS uid, {replace_sql('text', fixed.CONTRACTION_RULES)} AS split_text FROM documents",
)
def _(spark, sf):
    return texts(spark, sf).select("uid", tx.split_contractions(F.col("tweet_text")).alias("split_text"))


@query(
    "F8_emoticons_to_emoji",
    f"SELECT doc_id AS uid, {replace_sql('text', longest_first(fixed.EMOTICONS))} AS emoji_text FROM documents",
)
def _(spark, sf):
    return texts(spark, sf).select("uid", tx.emoticons_to_emoji(F.col("tweet_text")).alias("emoji_text"))


@query(
    "F9_expand_abbreviations",
    f"SELECT doc_id AS uid, {replace_sql('text', longest_first(fixed.ABBREVIATIONS))} AS expanded FROM documents",
)
def _(spark, sf):
    return texts(spark, sf).select("uid", tx.expand_abbreviations(F.col("tweet_text")).alias("expanded"))


EMOJI_PAIRS = longest_first({k: f":{v}:" for k, v in fixed.EMOJI_NAMES.items()})
EMOJI_TEXT_SQL = replace_sql("text", longest_first(fixed.EMOTICONS))


@query("F10_demojize", f"SELECT doc_id AS uid, {replace_sql(EMOJI_TEXT_SQL, EMOJI_PAIRS)} AS named FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("uid", tx.demojize(tx.emoticons_to_emoji(F.col("tweet_text"))).alias("named"))


@query("F11_normalize_text")
def _(spark, sf):
    both = tx.normalize_styles(F.col("tweet_text"), ("plain", "bertweet"))
    return texts(spark, sf).select("uid", F.inline(F.array(both)))


@query(
    "F12_token_length_profile",
    f"""{WITH_CORPUS}, r AS (SELECT len({words_sql('tweet_text')}) AS n, {place()} AS i FROM corpus),
    s AS (SELECT n FROM r WHERE i <= (SELECT round_even(count(*) * 0.1, 0) FROM corpus))
    SELECT quantile_cont(n, 0.90) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS longest FROM s""",
)
def _(spark, sf):
    return token_length_profile(corpus(spark, sf), tokenize=tx.words)


@query(
    "G4_embed_text",
    f"""SELECT doc_id AS uid, CAST(256 AS INTEGER) AS dim,
      CASE WHEN regexp_matches(lower(coalesce(text, '')), '{tx.WORD}{{2}}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length,
      'hashed-1-2-grams' AS model_name FROM documents""",
)
def _(spark, sf):
    rows = embed_text(texts(spark, sf))
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return rows.select("uid", F.size("embedding").alias("dim"), F.round(F.sqrt(squares), 4).alias("length"), "model_name")
