"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned, too: words and word beginnings that stand in toxic
documents far more often than chance. Everything is fitted on a bounded sample
of labelled rows (``SAMPLE_ROWS``, drawn by hash; all rows if there are fewer).
A training row sees the lexicon without its own vote. Scoring is one pass over
all texts; nothing but the sample's ids, its features and the lexicon is moved.

Defined results
    null text      an empty text, scored like any other
    null doc_id    not held out, has no label
    equal ids      scored row by row; of a document's labels the largest counts
    long texts     whole
    no labels, or one label only: the label's share (0 without any) for all rows
    empty table    an empty result
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.boosting import Calibrated, fit_calibrated
from tidesift.llm.common import fold_of, id_of, share, shared_value, text_of

SAMPLE_ROWS = 40_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
LEXICON_SIZE = 4_000
LEAST_DOCS = 3
CACHED = 400_000
NEAR = 5

# Second-person forms of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deinem ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# Characters that stand in for letters.
LOOKALIKES = str.maketrans("013457@$!|+", "oieastasiit")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|~-_/\\…«»“”„’"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
PUNCTUATION = b".,;:?\"'()-"
MARKS = b"!"
SYMBOLS = b"#*$%&|<>@~^_+="
HIGH = bytes(range(128, 256))
DIGITS = b"0123456789"


def units_of(token: str) -> tuple[str, ...]:
    """Lexicon entries a token may hit: the word, and its first five and four letters."""
    word = token.lower().strip(EDGES)
    if not word:
        return ()
    if len(word) > 5:
        return f"w {word[:40]}", f"5 {word[:5]}", f"4 {word[:4]}"
    return (f"w {word}", f"4 {word[:4]}") if len(word) > 4 else (f"w {word}",)


def plain(token: str) -> str:
    """The token without stand-in characters and inner marks."""
    word = token.lower().strip(EDGES).translate(LOOKALIKES)
    return "".join(c for c in word if c.isalpha())


class Lexicon:
    """Entries with their toxic and all documents."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, total: int):
        self.counts, self.toxic, self.total = counts, toxic, total
        self.weights = {unit: self.weight(unit) for unit in counts}

    def weight(self, unit: str, own: int | None = None) -> float:
        """Log ratio of the entry's toxic share to the overall share; 0 if it is not clearly larger.

        ``own``: the label of the document asking, whose vote is left out.
        """
        t, n = self.counts[unit]
        toxic, total = self.toxic, self.total
        if own is not None:
            t, n, toxic, total = t - own, n - 1, toxic - own, total - 1
        if t < LEAST_DOCS or not 0 < toxic < total:
            return 0.0
        share = toxic / total
        if (t - n * share) / sqrt(n * share * (1 - share)) < 4:
            return 0.0
        return max(0.0, log((t + share) / (n + 1) / share))


class _Tokens(dict):
    """Token -> 0, or a number in ``special``: (entries, entries of its plain form, second person, caps, odd)."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.special: list[tuple] = [()]

    def trim(self) -> None:
        """Start anew if full; between documents only, as numbers change."""
        if len(self) >= CACHED:
            self.clear()
            self.special = [()]

    def __missing__(self, token: str) -> int:
        known = self.lexicon.weights
        units = tuple(u for u in units_of(token) if u in known)
        bare = token.lower().strip(EDGES)
        odd = not bare.isalpha() and sum(map(str.isalpha, bare)) >= 2
        hidden = tuple(u for u in units_of(plain(token)) if u in known) if odd else ()
        you = bare in SECOND_PERSON
        caps = len(bare) > 2 and token.isupper()
        code = 0
        if units or hidden or you or caps or odd:
            code = len(self.special)
            self.special.append((units, hidden, you, caps, odd))
        self[token] = code
        return code


N_FEATURES = 20


def features(text: str, tokens: _Tokens, own: int | None = None) -> list[float]:
    tokens.trim()
    lexicon = tokens.lexicon
    words = text.split()
    n = max(len(words), 1)
    codes = list(map(tokens.__getitem__, words))
    special = [(i, tokens.special[c]) for i, c in enumerate(codes) if c]
    word_sum = start_sum = top = hidden_top = 0.0
    word_hits = start_hits = hidden_hits = caps = odd = strong = 0
    at, yous = [], []
    kinds = set()
    for i, (units, hidden, you, upper, strange) in special:
        best = 0.0
        for unit in units:
            w = lexicon.weights[unit] if own is None else lexicon.weight(unit, own)
            if w > 0:
                best = max(best, w)
                kinds.add(unit)
                if unit[0] == "w":
                    word_sum += w
                    word_hits += 1
                else:
                    start_sum += w
                    start_hits += 1
        for unit in hidden:
            w = lexicon.weights[unit] if own is None else lexicon.weight(unit, own)
            if w > 0:
                hidden_hits += 1
                hidden_top = max(hidden_top, w)
        top = max(top, best)
        strong += best > 1.5
        if best > 0:
            at.append(i)
        if you:
            yous.append(i)
        caps += upper
        odd += strange
    close = 0
    if at and yous:
        place = np.searchsorted(yous, at)
        low = np.array(yous)[np.maximum(place - 1, 0)]
        high = np.array(yous)[np.minimum(place, len(yous) - 1)]
        close = int((np.minimum(np.abs(low - at), np.abs(high - at)) <= NEAR).sum())
    raw = text.encode()
    size = max(len(raw), 1)

    def rate(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    return [
        log(n),
        size / n,
        word_hits,
        word_sum / n,
        start_hits,
        start_sum / n,
        top,
        strong,
        strong / n,
        len(kinds),
        hidden_hits,
        hidden_top,
        close,
        len(yous) / n,
        caps / n,
        odd / n,
        rate(UPPER),
        rate(PUNCTUATION + MARKS),
        rate(SYMBOLS + DIGITS),
        rate(HIGH),
    ]


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and all documents of every entry, summed over what the task has read so far."""

    def rows(toxic: Counter, total: Counter) -> pa.RecordBatch:
        units = list(total)
        columns = [pa.array(units, pa.string()), pa.array([toxic[u] for u in units], pa.int64()), pa.array(list(total.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["unit", "t", "n"])

    toxic, total = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            units = {u for token in set(text.as_py().split()) for u in units_of(token)}
            total.update(units)
            if label:
                toxic.update(units)
            if len(total) > CACHED:
                yield rows(toxic, total)
                toxic, total = Counter(), Counter()
    yield rows(toxic, total)


def _train_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    tokens = _Tokens(shared_value(shared))
    for batch in batches:
        labels = batch.column(1).to_pylist()
        rows = [features(t.as_py(), tokens, y) for t, y in zip(batch.column(0), labels, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32()), batch.column(2)], names=["x", "y", "draw"]
        )


def _scored(texts, tokens: _Tokens, model: Calibrated | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    return model.score(np.array([features(t.as_py() or "", tokens) for t in texts]).reshape(-1, N_FEATURES))


def _scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    lexicon, model = shared_value(shared)
    tokens = _Tokens(lexicon)
    for batch in batches:
        score = _scored(batch.column(1), tokens, model)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], names=["doc_id", "held_out", "score"])


def _clean_rows(batches: Iterator[pa.RecordBatch], shared, text_column: str) -> Iterator[pa.RecordBatch]:
    lexicon, model = shared_value(shared)
    tokens = _Tokens(lexicon)
    for batch in batches:
        yield batch.filter(pa.array(_scored(batch.column(text_column), tokens, model) < THRESHOLD))


class ToxicityModel:
    """Lexicon and calibrated trees, or a constant if there was nothing to learn."""

    def __init__(self, lexicon: Lexicon, model: Calibrated | float):
        self.lexicon, self.model = lexicon, model

    def score(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """doc_id, held_out, score, predicted of every row."""
        shared = share(docs.sparkSession, (self.lexicon, self.model))
        narrow = docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            text_of(text_column).alias("text"),
            (fold_of(id_column, FOLDS) == HELD_OUT).alias("held_out"),
        )
        scored = narrow.mapInArrow(lambda b: _scores(b, shared), "doc_id long, held_out boolean, score double")
        predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
        return scored.select(F.col("doc_id").alias(id_column), "held_out", "score", predicted)

    def keep_clean(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        """The rows that are not predicted toxic, with all their columns."""
        shared = share(docs.sparkSession, (self.lexicon, self.model))
        return docs.mapInArrow(lambda b: _clean_rows(b, shared, text_column), docs.schema)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    usable = (
        labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & (fold_of(id_column, FOLDS) != HELD_OUT))
        .groupBy(id_of(id_column).alias("l_id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("y"))
        .withColumn("draw", F.pmod(F.xxhash64(F.lit("toxicity"), F.col("l_id")), F.lit(1_000_000)).cast("long"))
    )
    n, toxic = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        return ToxicityModel(Lexicon({}, 0, 0), float(toxic / n) if n else 0.0)
    # at most about ``sample_rows`` pairs of numbers: small enough for every executor at any input size
    sample = F.broadcast(usable.filter(F.col("draw") < int(1_000_000 * min(1.0, sample_rows / n))))
    texts = docs.select(id_of(id_column).alias("l_id"), text_of(text_column).alias("text"))
    rows = texts.join(sample, "l_id").select("text", "y", "draw")

    counted = rows.select("text", "y").mapInArrow(_unit_counts, "unit string, t long, n long")
    counted = counted.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).filter(F.col("t") >= LEAST_DOCS)
    p = F.lit(toxic / n)
    spread = F.sqrt(F.col("n") * p * (1 - p))
    z = (F.col("t") - F.col("n") * p) / spread
    found = counted.filter(z >= 3).orderBy(z.desc(), "unit").limit(LEXICON_SIZE).collect()
    n_rows, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    lexicon = Lexicon({r["unit"]: (r["t"], r["n"]) for r in found}, n_toxic, n_rows)

    shared = share(spark, lexicon)
    drawn = rows.mapInArrow(lambda b: _train_rows(b, shared), "x array<double>, y int, draw long")
    table = drawn.toPandas().sort_values("draw", kind="stable")
    x = np.stack(table["x"].to_numpy()) if len(table) else np.zeros((0, N_FEATURES))
    y = table["y"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(lexicon, float(y.mean()) if len(y) else 0.0)
    order = np.lexsort((*x.T, y, table["draw"].to_numpy()))  # the same model whatever the order of tasks
    return ToxicityModel(lexicon, fit_calibrated(x[order], y[order], np.arange(len(y))))
