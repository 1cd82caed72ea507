"""Delimited files: one reader for all label and noise files, one writer."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.operators.sampling import SEED, sample_frac
from tidesift.sources.quoted import QuotedFiles, can_split

# Cell texts that mean "missing" in the files' usual reader.
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
_ALIASES = {"latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "utf_8": "UTF-8", "utf8": "UTF-8", "cp437": "IBM437"}
_MISSING, _EXTRA = "\u0001", "_extra_field"


def clean_names(names: Sequence[str], variants: Mapping[str, str] | None = None) -> list[str]:
    """Header names without outer blanks and with spelling variants fixed."""
    return [(variants or {}).get(n.strip(), n.strip()) for n in names]


def clean_header(df: DataFrame, variants: Mapping[str, str] | None = None) -> DataFrame:
    return df.toDF(*clean_names(df.columns, variants))


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    sep: str = ",",
    encoding: str = "utf-8",
    quoting: bool = True,
    bad_lines: str = "skip",
    rename: Mapping[str, str] | None = None,
    variants: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
    frac=None,
    seed: int = SEED,
    multi_line: bool | None = None,
    pattern: str | None = None,
    recursive: bool = False,
    file_column: str | None = None,
) -> DataFrame:
    """Read delimited text with every column declared as text, then cast.

    ``columns`` names the fields of files without header. Otherwise every file is
    read by its own header line: files are grouped by header, each group gets
    its names (blanks cut, ``variants`` fixed), and the groups are united by
    name, columns a file lacks being null. A line with more fields than its
    file's header is bad: dropped (``skip``), or the job stops (``error``). A
    short line is filled with nulls. ``rename`` also selects.

    ``multi_line`` lets quoted fields hold line breaks. Large files are many
    tasks then, too (``quoted``), but each file is read twice; only files in
    charsets of wide characters are one task each. Charsets beyond
    Spark's own need ``spark.sql.legacy.javaCharsets`` in the session, as
    ``build_session`` sets it.
    """
    charset = _ALIASES.get(encoding.lower(), encoding)
    paths = [path] if isinstance(path, str) else list(path)
    options = {
        "sep": sep,
        "encoding": charset,
        "quote": '"' if quoting else "",
        "escape": '"' if quoting else "\\",
        "nullValue": _MISSING,
        "emptyValue": "",
        "multiLine": str(bool(multi_line)).lower(),
        "mode": "PERMISSIVE",
    }
    if bad_lines not in ("skip", "error"):
        raise ValueError("bad_lines must be 'skip' or 'error'")
    split = bool(multi_line) and quoting and can_split(encoding)
    if split:
        quoted = QuotedFiles(spark, paths, sep, encoding, pattern, recursive)
        if columns is None:
            heads = {head: tuple(_names(head, sep, quoting, variants)) for head in quoted.heads()}
            if not heads:
                raise FileNotFoundError("no file with a header line")
            groups = {names: [i] for i, names in enumerate(dict.fromkeys(heads.values()))}
            records = quoted.space.keep(quoted.records({head: groups[names][0] for head, names in heads.items()}))
        else:
            groups, records = {tuple(columns): [0]}, quoted.records()
    elif columns is None:
        groups = _by_header(spark, list_files(spark, paths, pattern, recursive), charset, sep, quoting, variants)
        options["recursiveFileLookup"] = "true"  # folder names are no columns
    else:
        groups = {tuple(columns): paths}
        options["recursiveFileLookup"] = str(recursive).lower()
        if pattern:
            options["pathGlobFilter"] = pattern

    def read(names: tuple[str, ...], files: list) -> DataFrame:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
        if split:
            shape = ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
            parsed = F.from_csv("record", F.lit(shape), {k: v for k, v in options.items() if k not in ("encoding", "recursiveFileLookup", "pathGlobFilter")})
            path = [F.url_decode("path").alias(file_column)] if file_column else []
            one = records.filter(F.col("grp") == files[0]).select(parsed.alias("_row"), *path).select("_row.*", *path and [file_column])
        else:
            one = spark.read.options(**options).schema(schema).option("header", columns is None).csv(files)
            if file_column:
                one = one.withColumn(file_column, F.url_decode(F.col("_metadata.file_path")))
        if bad_lines == "skip":
            one = one.filter(F.col(_EXTRA).isNull())
        else:
            stop = F.raise_error(F.lit("a line has more fields than the header")).cast("string")
            first = F.col(f"`{names[0]}`")
            one = one.withColumn(names[0], F.when(F.col(_EXTRA).isNull(), first).otherwise(stop))
        return one.drop(_EXTRA)

    parts = [read(names, files) for names, files in groups.items()]
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    names = [c for c in df.columns if c != file_column]
    missing = F.array(*[F.lit(v) for v in NA_VALUES])
    df = df.withColumns({n: F.when(~F.array_contains(missing, F.col(f"`{n}`")), F.col(f"`{n}`")) for n in names})
    if rename:
        extra = [file_column] if file_column else []
        df = df.select(*[F.col(f"`{old}`").alias(new) for old, new in rename.items()], *extra)
    for name, kind in (types or {}).items():
        df = df.withColumn(name, F.col(name).try_cast(kind))
    return df if frac is None else sample_rows(df, frac, seed)


def _names(line: str, sep: str, quoting: bool, variants: Mapping[str, str] | None) -> list[str]:
    """The column names of a header line."""
    quotes = {"quotechar": '"'} if quoting else {"quoting": csv.QUOTE_NONE}
    return clean_names(next(csv.reader([line.lstrip("\ufeff")], delimiter=sep, **quotes)), variants)


def list_files(spark: SparkSession, paths: Sequence[str], pattern: str | None, recursive: bool) -> list[str]:
    """Files below the paths, sorted; names only, no content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        listed = listed.option("pathGlobFilter", pattern)
    return sorted(r[0] for r in listed.load(list(paths)).select("path").collect())


def _by_header(
    spark: SparkSession,
    files: Sequence[str],
    charset: str,
    sep: str,
    quoting: bool,
    variants: Mapping[str, str] | None,
) -> dict[tuple[str, ...], list[str]]:
    """{names: files with this header}; the driver reads the first line of each file."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        target = jvm.org.apache.hadoop.fs.Path(file)
        stream = target.getFileSystem(conf).open(target)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, charset))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line is None:
            continue  # an empty file has no rows
        groups.setdefault(tuple(_names(line, sep, quoting, variants)), []).append(file)
    if not groups:
        raise FileNotFoundError("no file with a header line")
    return groups


def has_files(spark: SparkSession, root: str, pattern: str) -> bool:
    """Whether any file below ``root`` matches; lists names only."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return not listed.load(root).select("path").isEmpty()


def has_path(spark: SparkSession, path: str) -> bool:
    """Whether this very path exists."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def sample_rows(df: DataFrame, frac, seed: int = SEED) -> DataFrame:
    """An exact-size sample of rows without a key.

    The content is the key; equal rows are told apart by a copy number, which
    only decides how many of them are drawn.
    """
    content = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    steps = 1 << 16  # copies come out in runs of bounded length
    runs = counted.withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {steps}L")))
    )
    size = F.least(F.lit(steps).cast("long"), F.col("_copies") - F.col("_run") * steps)
    numbered = runs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    keyed = numbered.withColumn("_key", F.md5(F.concat_ws("|", content, F.col("_run"), F.col("_copy"))))
    return sample_frac(keyed, frac, "_key", seed).select(*df.columns)


def read_event_files(
    spark: SparkSession,
    root: str,
    pattern: str,
    events: DataFrame,
    event_key: str = "event_key",
    on_missing: str = "skip",
    **options,
) -> DataFrame:
    """All matching files below ``root``, tagged with the event of their directory.

    One scan for all files; directories without an entry are skipped by the
    inner join, or stop the job.
    """
    from tidesift.operators.labels import lookup_event

    rows = read_table(spark, root, pattern=pattern, recursive=True, file_column="_file", **options)
    tagged = rows.withColumns(
        {
            event_key: F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1),
            "file_name": F.regexp_extract("_file", r"([^/]+)$", 1),
        }
    )
    return lookup_event(tagged.drop("_file"), events, event_key, on_missing)


def write_csv(df: DataFrame, path: str, quote: str = "all", mode: str = "errorifexists") -> None:
    """CSV with a header in every file: ``all`` fields quoted, or all but numbers (``nonnumeric``).

    A missing value is an empty quoted field.
    """
    if quote == "all":
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.mode(mode).options(header=True, quoteAll=True, escape='"', **blanks).csv(path)
        return
    if quote != "nonnumeric":
        raise ValueError("quote must be 'all' or 'nonnumeric'")

    def field(name: str, kind: T.DataType) -> Column:
        value = F.col(f"`{name}`").cast("string")
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            value = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(value, F.lit('""'))

    header = ",".join('"' + name.replace('"', '""') + '"' for name in df.columns)
    line = F.concat_ws(",", *[field(f.name, f.dataType) for f in df.schema.fields])

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    df.select(line.alias("value")).mapInArrow(headed, "value string").write.mode(mode).text(path)
