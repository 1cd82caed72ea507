"""Recipes for the public crisis-tweet corpora: files in, canonical rows out.

A recipe says how files are parsed, where the event comes from and how labels
become ``informative`` and ``humanitarian_label``. Reading, labeling and
cleaning are the general operators; a recipe only names their arguments.
Within a corpus, copies of a text keep the row with the lowest id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.functions import fixed_values as fixed
from tidesift.operators import clean, labels
from tidesift.operators.dedup import dedup, dedup_chain, drop_cross_source
from tidesift.operators.sets import append_missing, attach_labels, keep_ids
from tidesift.schema import LABELED_TEXT, UNIFIED_COLUMNS
from tidesift.sources.delimited import has_files, read_event_files, read_table

EVENT_SCHEMA = "event_key string, country string, event_type string, event_name string, year int"

# Directory (or event column value), country, type, name, year.
EVENTS: dict[str, list[tuple]] = {
    "ACL_ICWSM_2018": [
        ("nepal", "Nepal", "earthquake", "2015 Nepal Earthquake", 2015),
        ("queensland", "Australia", "flood", "2013 Queensland Floods", 2013),
    ],
    "CrisisLexT26": [
        ("2012_Colorado_wildfires", "US", "wildfire", "2012 Colorado Wildfires", 2012),
        ("2012_Costa_Rica_earthquake", "Costa Rica", "earthquake", "2012 Costa Rica Earthquake", 2012),
        ("2012_Guatemala_earthquake", "Guatemala", "earthquake", "2012 Guatemala Earthquake", 2012),
        ("2012_Italy_earthquakes", "Italy", "earthquake", "2012 Italy Earthquakes", 2012),
        ("2012_Philipinnes_floods", "Philippines", "flood", "2012 Philippines Floods", 2012),
        ("2012_Typhoon_Pablo", "Philippines", "storm", "2012 Typhoon Pablo", 2012),
        ("2013_Alberta_floods", "Canada", "flood", "2013 Alberta Floods", 2013),
        ("2013_Australia_bushfire", "Australia", "wildfire", "2013 Australia Bushfire", 2013),
        ("2013_Bohol_earthquake", "Philippines", "earthquake", "2013 Bohol Earthquake", 2013),
        ("2013_Colorado_floods", "US", "flood", "2013 Colorado Floods", 2013),
        ("2013_Manila_floods", "Philippines", "flood", "2013 Manila Floods", 2013),
        ("2013_Queensland_floods", "Australia", "flood", "2013 Queensland Floods", 2013),
        ("2013_Russia_meteor", "US", "meteor", "2013 Russia Meteor", 2013),
        ("2013_Sardinia_floods", "US", "flood", "2013 Sardinia Floods", 2013),
        ("2013_Typhoon_Yolanda", "US", "storm", "2013 Typhoon Yolanda", 2013),
    ],
    "CrisisLexT6": [
        ("2012_Sandy_Hurricane", "US", "storm", "2012 Sandy Hurricane", 2012),
        ("2013_Alberta_Floods", "Canada", "flood", "2013 Alberta Floods", 2013),
        ("2013_Oklahoma_Tornado", "US", "tornado", "2013 Oklahoma Tornado", 2013),
        ("2013_Queensland_Floods", "Australia", "flood", "2013 Queensland Floods", 2013),
    ],
    "CrisisMMD_v2": [
        ("hurricane_maria", "US", "storm", "hurricane_maria", 2017),
        ("hurricane_harvey", "US", "storm", "hurricane_harvey", 2017),
        ("hurricane_irma", "US", "storm", "hurricane_irma", 2017),
        ("california_wildfires", "US", "wildfire", "california_wildfires", 2017),
        ("mexico_earthquake", "Mexico", "earthquake", "mexico_earthquake", 2017),
        ("srilanka_floods", "Sri Lanka", "flood", "srilanka_floods", 2017),
        ("iraq_iran_earthquake", "Iraq/Iran", "earthquake", "iraq_iran_earthquake", 2017),
    ],
    "CrisisNLP-CF": [
        ("2013_Pakistan_eq", "Pakistan", "earthquake", "2013 Pakistan Earthquake", 2013),
        ("2014_California_Earthquake", "US", "earthquake", "2014 California Earthquake", 2014),
        ("2014_Chile_Earthquake_en", "Chile", "earthquake", "2014 Chile Earthquake", 2014),
        ("2014_Hurricane_Odile_Mexico_en", "Mexico", "storm", "2014 Hurricane Odile Mexico", 2014),
        ("2014_India_floods", "India", "flood", "2014 India Floods", 2014),
        ("2014_Pakistan_floods", "Pakistan", "flood", "2014 Pakistan Floods", 2014),
        ("2014_Philippines_Typhoon_Hagupit_en", "Philippines", "storm", "2014 Philippines Typhoon Hagupit", 2014),
        ("2015_Cyclone_Pam_en", "Vanuatu", "storm", "2015 Cyclone Pam", 2015),
        ("2015_Nepal_Earthquake_en", "Nepal", "earthquake", "2015 Nepal Earthquake", 2015),
    ],
    "CrisisNLP-volunteers": [
        ("2014_California_Earthquake", "US", "earthquake", "2014 California Earthquake", 2014),
        ("2014_Chile_Earthquake_en", "Chile", "earthquake", "2014 Chile Earthquake", 2014),
        ("2014_Hurricane_Odile_Mexico_en", "Mexico", "storm", "2014 Hurricane Odile Mexico", 2014),
        ("2014_Iceland_Volcano_en", "Iceland", "volcano", "2014 Iceland Volcano", 2014),
        ("2014_Philippines_Typhoon_Hagupit_en", "Philippines", "storm", "2014 Philippines Typhoon Hagupit", 2014),
        ("2015_Cyclone_Pam_en", "Vanuatu", "storm", "2015 Cyclone Pam", 2015),
        ("2015_Nepal_Earthquake_en", "Nepal", "earthquake", "2015 Nepal Earthquake", 2015),
        ("Landslides_Worldwide_en", "Worldwide", "landslide", "Landslides Worldwide", None),
    ],
    "HumAID": [
        ("canada_wildfires_2016", None, "wildfire", "2016 Canada Wildfires", 2016),
        ("california_wildfires_2018", None, "wildfire", "2018 California Wildfires", 2018),
        ("cyclone_idai_2019", None, "storm", "Cyclone Idai", 2019),
        ("ecuador_earthquake_2016", None, "earthquake", "2016 Ecuador Earthquake", 2016),
        ("greece_wildfires_2018", None, "wildfire", "2018 Greece Wildfires", 2018),
        ("hurricane_dorian_2019", None, "storm", "Hurricane Dorian", 2019),
        ("hurricane_florence_2018", None, "storm", "Hurricane Florence", 2018),
        ("hurricane_harvey_2017", None, "storm", "Hurricane Harvey", 2017),
        ("hurricane_irma_2017", None, "storm", "Hurricane Irma", 2017),
        ("hurricane_maria_2017", None, "storm", "Hurricane Maria", 2017),
        ("hurricane_matthew_2016", None, "storm", "Hurricane Matthew", 2016),
        ("maryland_floods_2018", None, "flood", "2018 Maryland Floods", 2018),
        ("midwestern_us_floods_2019", None, "flood", "Midwestern US Floods", 2019),
        ("italy_earthquake_aug_2016", None, "earthquake", "2016 Italy Earthquake", 2016),
        ("kaikoura_earthquake_2016", None, "earthquake", "2016 Kaikoura Earthquake", 2016),
        ("kerala_floods_2018", None, "flood", "2018 Kerala Floods", 2018),
        ("pakistan_earthquake_2019", None, "earthquake", "2019 Pakistan Earthquake", 2019),
        ("puebla_mexico_earthquake_2017", None, "earthquake", "2017 Puebla Mexico Earthquake", 2017),
        ("srilanka_floods_2017", None, "flood", "2017 Sri Lanka Floods", 2017),
    ],
}

# Labels of the volunteer files -> labels of the crowd files.
VOLUNTEER_LABELS = {
    "Other Relevant Information": "other_useful_information",
    "Other relevant information": "other_useful_information",
    "Other useful information": "other_useful_information",
    "Informative": "other_useful_information",
    "Personal updates": "other_useful_information",
    "Other relevant": "other_useful_information",
    "Animal management": "other_useful_information",
    "Non-government": "other_useful_information",
    "Traditional media": "other_useful_information",
    "Physical landslide": "other_useful_information",
    "Volunteer or professional services": "donation_needs_or_offers_or_volunteering_services",
    "Money": "donation_needs_or_offers_or_volunteering_services",
    "Humanitarian Aid Provided": "donation_needs_or_offers_or_volunteering_services",
    "Shelter and supplies": "donation_needs_or_offers_or_volunteering_services",
    "Donations of money": "donation_needs_or_offers_or_volunteering_services",
    "Needs of those affected": "donation_needs_or_offers_or_volunteering_services",
    "Injured or dead people": "injured_or_dead_people",
    "Urgent Needs": "injured_or_dead_people",
    "Requests for Help/Needs": "injured_or_dead_people",
    "Injured and dead": "injured_or_dead_people",
    "Sympathy and emotional support": "sympathy_and_emotional_support",
    "Personal updates, sympathy, support": "sympathy_and_emotional_support",
    "Infrastructure Damage": "infrastructure_and_utilities_damage",
    "Infrastructure and utilities": "infrastructure_and_utilities_damage",
    "Infrastructure": "infrastructure_and_utilities_damage",
    "Infrastructure damage": "infrastructure_and_utilities_damage",
    "Caution and advice": "caution_and_advice",
    "Response Efforts": "displaced_people_and_evacuations",
    "Displaced people": "displaced_people_and_evacuations",
    "Response efforts": "displaced_people_and_evacuations",
    "Missing, trapped, or found people": "missing_trapped_or_found_people",
    "Not related or irrelevant": "not_related_or_irrelevant",
    "Not Informative": "not_related_or_irrelevant",
    "Not Relevant": "not_related_or_irrelevant",
    "Not related to crisis": "not_related_or_irrelevant",
    "Not informative": "not_related_or_irrelevant",
    "Not relevant": "not_related_or_irrelevant",
    "Not physical landslide": "not_related_or_irrelevant",
}

# Eyewitness label spellings.
EYEWITNESS_LABELS = {
    "dont_know": "dont_know",
    "don't know": "dont_know",
    "direct_eyewitness": "direct_eyewitness",
    "direct-eyewitness": "direct_eyewitness",
    "noneyewitness": "non_eyewitness",
    "non-eyewitness": "non_eyewitness",
    "vulnerable-direct witness": "vulnerable_direct_eyewitness",
    "vulnerable direct-eyewitness": "vulnerable_direct_eyewitness",
    "indirect-eyewitness": "indirect_eyewitness",
}

# Words in an eyewitness file name -> event type.
EYEWITNESS_TYPES = {"earthquakes": "earthquake", "floods": "flood", "forestfires": "wildfire", "hurricanes": "storm"}

# Labels of the combined corpus that are out of scope, and its
# sources that no other corpus holds.
COMBINED_EXCLUDED = ["disease_related", "physical_landslide", "personal_update", "terrorism_related"]
COMBINED_SOURCES = {"drd-figureeight-multimedia": "DRD-FigureEight-Multimedia", "aidr_system": "AIDR_system"}


@dataclass(frozen=True)
class Recipe:
    """``label`` is the source label column; ``informative`` and ``humanitarian``
    build the unified labels from it."""

    dataset: str
    pattern: str
    tweet_id: str | None
    tweet_text: str
    label: str
    informative: Callable[[Column], Column]
    humanitarian: Callable[[Column], Column] | None = None
    label_is: str = "informative"
    read: Mapping = field(default_factory=dict)
    events: str | None = None
    constants: Mapping = field(default_factory=dict)
    meta: Sequence[str] = ("file_name",)
    where: Callable[[DataFrame], DataFrame] = lambda df: df
    extra: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    country: bool = False
    dedup_text: bool = True


def _null(_: Column) -> Column:
    return F.lit(None).cast("string")


def _same(label: Column) -> Column:
    return label


def _not(*names: str) -> Callable[[Column], Column]:
    return lambda label: labels.binarize(label, negative=names)


def _is(*names: str) -> Callable[[Column], Column]:
    return lambda label: labels.binarize(label, positive=names)


RECIPES = {
    r.dataset: r
    for r in [
        Recipe(
            "ACL_ICWSM_2018", "*_*.tsv", "tweet_id", "text", "label", _is("relevant"),
            read={"sep": "\t", "encoding": "latin1"}, events="ACL_ICWSM_2018",
        ),
        Recipe(
            "CrisisLexT26", "*-tweets_labeled.csv", "Tweet ID", "Tweet Text", "Informativeness",
            _not("Not applicable", "Not related"), events="CrisisLexT26",
            meta=("file_name", "Information Source", "Information Type", "Informativeness"),
            where=lambda df: clean.exclude_values(df, "Informativeness", ["Not applicable"]),
            extra={"original_humanitarian_label": lambda: F.col("`Information Type`")},
        ),
        Recipe(
            "CrisisLexT6", "*-ontopic_offtopic.csv", "tweet id", "tweet", "label", _not("off-topic"), events="CrisisLexT6",
        ),
        Recipe(
            "CrisisNLP-CF", "*.tsv", "tweet_id", "tweet_text", "label", _not("not_related_or_irrelevant"), _same,
            label_is="humanitarian", read={"sep": "\t"}, events="CrisisNLP-CF", country=True, dedup_text=False,
        ),
        Recipe(
            "CrisisNLP-volunteers", "*.csv", "tweet_id", "tweet_text", "label",
            lambda label: labels.binarize(
                labels.map_labels(label, VOLUNTEER_LABELS), negative=["not_related_or_irrelevant"]
            ),
            lambda label: labels.map_labels(label, VOLUNTEER_LABELS),
            label_is="humanitarian", read={"encoding": "cp437"}, events="CrisisNLP-volunteers", country=True,
            meta=(
                "file_name", "tweet_time", "tweet_author", "tweet_author_id", "tweet_language",
                "tweet_lon", "tweet_lat", "tweet_url",
            ),
            where=lambda df: clean.only_language(df, "en", "tweet_language"), dedup_text=False,
        ),
        Recipe(
            "disasters_on_social_media", "socialmedia-*-DFE.csv", None, "text", "choose_one",
            _is("Relevant"), read={"encoding": "latin1"}, constants={"event_type": "disaster"},
            where=lambda df: clean.drop_golden(df, strict=False),
        ),
        Recipe(
            "Ecuador_Earthquake_2016", "2016_ecuador_eq_en.csv", "id", "text", "crisis_related", _is("yes"),
            lambda _: F.col("choose_one_category"),
            constants={"event_type": "earthquake", "event_name": "Ecuador Earthquake 2016", "year": 2016},
            meta=("file_name", "url"), where=lambda df: clean.drop_nulls(df, ["text"]), dedup_text=False,
        ),
        Recipe(
            "HumAID", "*.tsv", "tweet_id", "tweet_text", "class_label", _not("not_humanitarian"), _same,
            label_is="humanitarian", read={"sep": "\t"}, events="HumAID",
        ),
        Recipe(
            "ISCRAM13-task1", "a131709.csv", None, "tweet", "choose_one", _not("Other", "Personal only"),
            constants={"event_type": "tornado", "event_name": "2011 Joplin tornado", "year": 2011},
            where=clean.drop_golden, dedup_text=False,
        ),
        Recipe(
            "ISCRAM13-task2", "a121571.csv", "id", "text", "choose_one", _not("Unknown"), _same, label_is="humanitarian",
            constants={"event_type": "tornado", "event_name": "2011 Joplin tornado", "year": 2011},
            where=clean.drop_golden, dedup_text=False,
        ),
        Recipe(
            "SWDM13", "a143145.csv", None, "tweet", "choose_one", _not("Other"),
            constants={"event_type": "tornado", "event_name": "2011 Joplin tornado", "year": 2011},
            where=clean.drop_golden, dedup_text=False,
        ),
    ]
}


def event_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(EVENTS[name], EVENT_SCHEMA)


def _read(spark: SparkSession, recipe: Recipe, root: str) -> DataFrame:
    options = {"multi_line": True, **recipe.read}  # posts may hold line breaks
    if recipe.events:
        return read_event_files(spark, root, recipe.pattern, event_table(spark, recipe.events), **options)
    rows = read_table(spark, root, pattern=recipe.pattern, recursive=True, file_column="_file", **options)
    return rows.withColumn("file_name", F.regexp_extract("_file", r"([^/]+)$", 1))


def _finish(df: DataFrame, dataset: str, country: bool = False) -> DataFrame:
    """Project onto the canonical columns, ids as text."""
    rows = df.withColumn("dataset", F.lit(dataset))
    schema = T.StructType([*LABELED_TEXT, T.StructField("country", T.StringType())]) if country else LABELED_TEXT
    return clean.to_canonical(rows, {}, schema)


def read_corpus(spark: SparkSession, dataset: str, root: str) -> DataFrame:
    """Canonical rows of one corpus below ``root``."""
    recipe = RECIPES[dataset]
    rows = recipe.where(_read(spark, recipe, root))
    label = F.col(f"`{recipe.label}`")
    name = dataset.removesuffix("-task1").removesuffix("-task2")
    rows = clean.with_constants(rows, recipe.constants)
    rows = rows.withColumns(
        {
            "informative": recipe.informative(label),
            "humanitarian_label": (recipe.humanitarian or _null)(label),
            f"original_{recipe.label_is}_label": label,
            **{column: make() for column, make in recipe.extra.items()},
            "meta": F.to_json(F.struct(*[F.col(f"`{c}`") for c in recipe.meta]), {"ignoreNullFields": "false"}),
            "tweet_text": F.col(f"`{recipe.tweet_text}`"),
        }
    )
    if recipe.tweet_id:
        rows = rows.withColumn("tweet_id", clean.clean_id(F.col(f"`{recipe.tweet_id}`")))
    else:
        rows = clean.synthetic_id(rows.withColumn("_corpus", F.lit(name)), ["_corpus", "tweet_text"])
    rows = _finish(rows, name, recipe.country)
    return dedup(rows, ["tweet_text"], "tweet_id") if recipe.dedup_text else rows.distinct()


def read_multimodal(spark: SparkSession, root: str) -> DataFrame:
    """The corpus with two label tasks on the same tweets."""
    rows = read_table(spark, root, sep="\t", pattern="*.tsv", recursive=True, file_column="_file", multi_line=True)
    rows = rows.withColumn("file_name", F.regexp_extract("_file", r"([^/]+)$", 1))
    tagged = labels.lookup_event(
        rows.withColumn("event_key", F.col("event_name")).drop("event_name"),
        event_table(spark, "CrisisMMD_v2"),
        "event_key",
        on_missing="fail",
    )
    single = dedup(labels.resolve_task_overlap(tagged), ["tweet_text"], "tweet_id")
    label = F.col("label")
    labeled = single.withColumns(
        {
            "informative": labels.binarize(label, negative=["not_informative"]),
            "humanitarian_label": labels.derive_label(label),
            "original_humanitarian_label": label,
            "meta": F.to_json(F.struct("event_name", "file_name")),
        }
    )
    return _finish(labeled, "CrisisMMD_v2")


def read_two_crowds(spark: SparkSession, crowd_root: str, volunteer_root: str) -> DataFrame:
    """Paid-crowd and volunteer labels of one collection.

    Ids labeled by both go; of repeated ids the last row stays (volunteers come
    first); of repeated texts none does.
    """
    volunteers = read_corpus(spark, "CrisisNLP-volunteers", volunteer_root)
    crowd = read_corpus(spark, "CrisisNLP-CF", crowd_root)
    both = drop_cross_source(volunteers.unionByName(crowd), "CrisisNLP-CF", "CrisisNLP-volunteers")
    order = F.struct(F.col("dataset") == "CrisisNLP-CF", "informative", "tweet_text")
    ordered = both.withColumn("_order", order)
    last = dedup(ordered, ["tweet_id"], "_order", keep="last")
    return dedup(last, ["tweet_text"], "_order", keep="none").drop("_order")


def read_eyewitness(spark: SparkSession, authors_root: str, crowd_root: str) -> DataFrame:
    """Eyewitness labels from the authors and from paid workers."""
    kind = reduce(
        lambda col, item: F.when(F.contains(F.col("_file"), F.lit(f"/{item[0]}_")), item[1]).otherwise(col),
        EYEWITNESS_TYPES.items(),
        F.lit(None).cast("string"),
    )

    def part(root: str, prefix: str) -> DataFrame:
        rows = None
        for word in EYEWITNESS_TYPES:
            pattern = f"{word}_{prefix}*.tsv"
            if not has_files(spark, root, pattern):
                continue
            one = read_table(
                spark, root, sep="\t", pattern=pattern, recursive=True, file_column="_file", multi_line=True,
                variants={"lable": "label", "Lable": "label"},
            )
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        return rows.withColumns({"event_type": kind, "file_name": F.regexp_extract("_file", r"([^/]+)$", 1)})

    authors = clean.only_language(part(authors_root, "eyewitness_annotations"))
    authors = clean.synthetic_id(authors.withColumn("_corpus", F.lit("authors")), ["_corpus", "text"])
    crowd = clean.drop_golden(part(crowd_root, "eyewitness_crowdflower"))
    crowd = crowd.withColumn("tweet_id", clean.digits_of(F.col("id_str")))
    columns = ["tweet_id", "text", "event_type", "created_at", "label", "file_name"]
    rows = authors.select(*columns).unionByName(
        crowd.withColumn("label", F.col("please_choose_a_category")).select(*columns)
    )
    label = labels.map_labels(F.col("label"), EYEWITNESS_LABELS)
    labeled = rows.withColumns(
        {
            "original_informative_label": label,
            "informative": labels.binarize(label, negative=["dont_know"]),
            "year": clean.year_from_tail(F.col("created_at")),
            "meta": F.to_json(F.struct("file_name")),
            "tweet_text": F.col("text"),
        }
    )
    kept = clean.drop_nulls(_finish(labeled, "eyewitness_messages"), ["tweet_text"])
    return dedup_chain(kept, [["tweet_id"], ["tweet_text"]], "tweet_id")


def read_combined(
    spark: SparkSession,
    informative: tuple[str, str],
    humanitarian: tuple[str, str],
    events: DataFrame,
) -> DataFrame:
    """The combined corpus: (filtered files, label-mapped file) per task.

    ``events`` (event_key, event_name, event_type) lists the wanted events.
    Labels of the second task are attached by id.
    """

    def task(paths: tuple[str, str], keep_quotes: bool) -> DataFrame:
        filtered = read_table(spark, paths[0], sep="\t", quoting=not keep_quotes, multi_line=not keep_quotes)
        mapped = read_table(spark, paths[1], sep="\t", multi_line=True)
        return append_missing(mapped, filtered, "id")

    inf = task(informative, keep_quotes=True)
    hum = clean.exclude_values(task(humanitarian, keep_quotes=False), "class_label", COMBINED_EXCLUDED)
    second = hum.select("id", F.col("class_label").alias("humanitarian_label"))
    rows = labels.lookup_event(inf.withColumnRenamed("event", "event_key"), events, "event_key")
    rows = attach_labels(rows, second, "humanitarian_label", key="id")
    label = F.col("class_label")
    labeled = rows.withColumns(
        {
            "tweet_id": clean.clean_id(F.col("id")),
            "tweet_text": F.col("text"),
            "original_informative_label": label,
            "informative": F.when(label == "informative", True).when(label == "not_informative", False),
            "original_humanitarian_label": F.col("humanitarian_label"),
            "dataset": labels.map_labels(F.col("source"), COMBINED_SOURCES, "keep"),
            "meta": F.lit('{"dataset": "CrisisBench"}'),
        }
    )
    return dedup_chain(clean.to_canonical(labeled, {}, LABELED_TEXT), [["tweet_id"], ["tweet_text"]], "tweet_id")


def unify(corpora: Sequence[DataFrame], combined: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Merge corpora: id and text dedup, event and label maps, shuffled dense uids.

    Of the combined corpus only its own sources are taken.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), corpora)
    if combined is not None:
        own = combined.filter(F.col("dataset").isin(list(COMBINED_SOURCES.values()))).select("tweet_id").distinct()
        rows = rows.unionByName(keep_ids(combined, own, "tweet_id"), allowMissingColumns=True)
    for name in ("country", "url"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    ordered = rows.withColumn("_order", F.struct("dataset", "tweet_id", "tweet_text"))
    unique = dedup_chain(ordered, [["tweet_id"], ["tweet_text"]], "_order").drop("_order")
    mapped = unique.withColumns(
        {
            "event_name": labels.map_labels(F.col("event_name"), fixed.EVENT_NAMES, "keep"),
            "humanitarian_label": labels.map_labels(F.col("humanitarian_label"), fixed.HUMANITARIAN_LABELS),
        }
    )
    keyed = mapped.withColumn("_key", F.md5(F.coalesce("tweet_id", F.lit(""))))
    return clean.assign_uid(keyed, "_key", seed=seed).select("uid", *UNIFIED_COLUMNS)
