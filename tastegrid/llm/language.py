"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tastegrid.llm.common import bounded_sample, keep, lean, logistic, slices, text_bytes

#: Families of closely related languages, by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl nn no sv".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters become small, other ASCII becomes blank; bytes of other letters stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class LanguageConfig:
    #: The classifiers are fitted on so many rows at most, shared evenly by the languages, chosen by a hash of id and text.
    fit_rows: int = 4_000
    most_languages: int = 200
    dimensions: int = 4096
    penalty: float = 1e-4
    steps: int = 400


def family_of(language: str) -> str:
    return _FAMILY.get(language, language)


def features(column: pa.Array, dimensions: int) -> np.ndarray:
    """For each text the square roots of its byte 1-, 2- and 3-gram counts, as a vector of length one.

    Single bytes have places of their own, longer grams are hashed over the others.
    """
    data, offsets = text_bytes(column)
    texts = len(offsets) - 1
    data = _FOLD[data].astype(np.uint64)
    text = np.repeat(np.arange(texts), np.diff(offsets))
    counts = np.bincount(text * dimensions + data.astype(np.int64), minlength=texts * dimensions).astype(np.float32)
    gram = data
    for order in (2, 3):
        if len(data) < order:
            break
        gram = gram[:-1] * np.uint64(256) + data[order - 1 :]
        inside = text[: len(gram)] == text[order - 1 :]
        # Multiplicative hashing of the gram and its order.
        place = ((gram + np.uint64(order << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        place = 256 + (place % np.uint64(dimensions - 256)).astype(np.int64)
        counts += np.bincount((text[: len(gram)] * dimensions + place)[inside], minlength=texts * dimensions)
    rows = np.sqrt(counts.reshape(texts, dimensions))
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Separator:
    """A linear SVM between two groups with the logistic curve that turns its margin into a probability."""

    weights: np.ndarray
    offset: float
    curve: tuple[float, float]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = rows @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * margin, -30, 30)))


def separate(rows: np.ndarray, positive: np.ndarray, config: LanguageConfig) -> Separator:
    """Fit by accelerated gradient descent on the squared hinge loss; both groups weigh the same."""
    x = np.hstack([rows, np.ones((len(rows), 1), dtype=rows.dtype)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    w = ahead = np.zeros(x.shape[1])
    pace, rate = 1.0, 1 / (4.0 + config.penalty)
    for _ in range(config.steps):
        slack = np.maximum(0.0, 1 - y * (x @ ahead))
        following = ahead - rate * (config.penalty * ahead - 2 * x.T @ (share * y * slack))
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = following + (pace - 1) / next_pace * (following - w)
        w, pace = following, next_pace
    margin = x @ w
    curve = logistic(np.stack([np.ones(len(y)), margin], axis=1), (y > 0).astype(float), share * 200, np.array([0.0, 3.0]), np.array([1.0, 2.0]))
    return Separator(w[:-1].astype(np.float32), float(w[-1]), (float(curve[0]), float(curve[1])))


@dataclass
class LanguageModel:
    dimensions: int
    #: Languages of each family; a separator of each family from the others; one for each pair within a family.
    families: dict[str, list[str]] = field(default_factory=dict)
    family_separators: dict[str, Separator] = field(default_factory=dict)
    pairs: dict[tuple[str, str], Separator] = field(default_factory=dict)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        rows = features(column, self.dimensions)
        names = list(self.families)
        language, score = np.full(len(rows), UNKNOWN, dtype=object), np.zeros(len(rows))
        if not names or not len(rows):
            return list(language), score
        ones = np.ones((len(rows), 1))
        by_family = np.stack([self.family_separators[f].probability(rows) for f in names], axis=1) if len(names) > 1 else ones
        best = by_family.argmax(axis=1)
        for f, family in enumerate(names):
            here = np.flatnonzero(best == f)
            members = self.families[family]
            if not len(here):
                continue
            # Each pair votes with its probability; the language preferred most in its weakest duel wins.
            duel = np.ones((len(here), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                p = self.pairs[a, b].probability(rows[here])
                duel[:, i], duel[:, j] = np.minimum(duel[:, i], p), np.minimum(duel[:, j], 1 - p)
            winner = duel.argmax(axis=1)
            language[here] = np.array(members, dtype=object)[winner]
            score[here] = by_family[here, f] * duel[np.arange(len(here)), winner]
        return list(language), score


def held_out(id_: str):
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Learn from text and language of documents that are not held out; rows without text, letter or language are not used.

    The sample is drawn by a hash of id and text together, rows equal in both counting once: null ids, repeated ids and
    copies neither fill it nor empty it. Each language has its share of ``fit_rows``, which is a hard bound.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id"))
    usable = usable.select("lang", "text", F.xxhash64(F.lit("language"), "doc_id", "text").alias("h"))
    places = keep(usable.select("lang", "h").distinct(), "language-places")
    known = [r["lang"] for r in places.select("lang").distinct().limit(config.most_languages + 1).collect()]
    if len(known) > config.most_languages:
        raise ValueError(f"more than {config.most_languages} languages")
    model = LanguageModel(config.dimensions)
    if not known:
        return model
    each = max(1, config.fit_rows // len(known))
    # At most fit_rows rows of a name and a number, and as many texts.
    chosen = bounded_sample(places, ["lang"], {(lang,): each for lang in known})
    chosen = usable.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    dimensions = config.dimensions

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most_rows=256):
            rows = features(batch.column("text"), dimensions).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "x": [r.tobytes() for r in rows]})

    # At most fit_rows vectors of 8 kB.
    found = chosen.select("lang", "text").mapInArrow(lean(described), "lang string, x binary").toPandas()
    found = found.sort_values(["lang", "x"], kind="stable")
    if not len(found):
        return model
    rows = np.stack([np.frombuffer(x, dtype=np.float16) for x in found["x"]]).astype(np.float32)
    langs = found["lang"].to_numpy()
    for lang in sorted(set(langs)):
        model.families.setdefault(family_of(lang), []).append(lang)
    family = np.array([family_of(lang) for lang in langs], dtype=object)
    if len(model.families) > 1:
        model.family_separators = {f: separate(rows, family == f, config) for f in model.families}
    for members in model.families.values():
        for a, b in combinations(members, 2):
            either = (langs == a) | (langs == b)
            model.pairs[a, b] = separate(rows[either], langs[either] == a, config)
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    Texts are read whole; no other column is read. Null texts and texts without a letter are ``und`` with score 0, and so
    is every text if no language was learned. Repeated rows are judged alike. Columns of the input named like the results
    are replaced. An empty table gives no rows. The model, a few vectors per language, travels with the tasks.
    """
    docs = docs.drop("lang_pred", "score")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most_rows=256):
            language, score = model.predict(batch.column(text))
            for i, t in enumerate(batch.column(text).to_pylist()):
                if not t or not _LETTER.search(t):
                    language[i], score[i] = UNKNOWN, 0.0
            new = [pa.array(language, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score"])

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(lean(rows), StructType([*docs.schema.fields, *fields]))


def language_digest(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, by a model of the rows that are not held out."""
    model = fit(docs, config)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
