"""Toxicity: Levenshtein automata over a lexicon trie find abusive terms, also misspelled; their context is weighed."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tastegrid.llm.common import bounded_sample, keep, lean, logistic, slices


@dataclass(frozen=True)
class ToxicityConfig:
    threshold: float = 0.7
    #: So many labelled rows at most, chosen by a hash of id and text, fit the lexicon and the weights.
    fit_rows: int = 20_000
    #: A term needs so many toxic texts and must be so many times as frequent in toxic texts as in clean ones.
    least_support: int = 3
    least_ratio: float = 8.0
    #: A toxic text is explained once the log ratios of its terms add up to this much.
    explained: float = 40.0
    #: Terms considered, strongest first: a few megabytes that travel with every task of the fit. The model has the chosen ones only.
    most_terms: int = 100_000
    #: Stems stand for all words that begin with them.
    stem_letters: tuple[int, int] = (3, 8)
    #: Words on either side of a hit that are searched for quotation.
    window: int = 8


#: Words that report what others said.
REPORTING = frozenset(
    "said says called quoted quote quotes wrote word words term terms titled dit disait écrit mot mots sagte schrieb wort "
    "wörter begriff dijo escribió palabra palabras término".split()
)
#: Kinds of hits with what is believed of their weight before labels are seen.
KINDS = {"word": 4.0, "word_quoted": 1.0, "misspelled": 3.5, "misspelled_quoted": 0.75, "stem": 4.0, "stem_quoted": 1.0}
BASE = -5.0
#: The same term counts so often in one text; a text's sum of log ratios ends at MOST and is scaled by UNIT.
REPEATS, MOST, UNIT = 5, 20.0, 4.0
_LETTERS = regex.compile(r"\p{L}+")
_QUOTES = frozenset("\"“”„«»‹›‘’'")


def edits_allowed(term: str) -> int:
    """Misspellings looked for: none below four letters, one edit from four on, two from nine on."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


#: Trie nodes in all states that an automaton holds, about 40 MB with their tables, and tokens that a matcher remembers.
MOST_HELD, MOST_TOKENS = 200_000, 100_000


class LexiconAutomaton:
    """The intersection of a lexicon's trie with the Levenshtein automata of its terms, made deterministic as it is used.

    A state is the set of trie nodes that the letters read so far reach, each with its fewest edits; a step extends all
    of them by one letter. States are numbered when first met and their steps kept in a table, so a word costs one table
    look-up per letter, and most words end in the dead state after a few.
    """

    def __init__(self, terms: dict[str, int], stems: set[str]):
        self.child: list[dict[str, int]] = [{}]
        self.most = [0]  # edits allowed below a node
        self.final: list[tuple[str, int] | None] = [None]
        self.stem: list[str | None] = [None]
        for term, edits in terms.items():
            node = self._insert(term, edits)
            self.final[node] = (term, edits)
        for stem in stems:
            self.stem[self._insert(stem, 0)] = stem
        self.restart()

    def restart(self) -> None:
        """Forget all states: they are made again as words need them."""
        self.table: list[dict[str, int]] = []
        self.hits: list[tuple[int, str] | None] = []
        self.stems_hit: list[str | None] = []
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.held = 0
        self.start = self._state({0: 0})

    def _insert(self, term: str, edits: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], edits)
        for letter in term:
            if letter not in self.child[node]:
                self.child[node][letter] = len(self.child)
                self.child.append({})
                self.most.append(0)
                self.final.append(None)
                self.stem.append(None)
            node = self.child[node][letter]
            self.most[node] = max(self.most[node], edits)
        return node

    def _state(self, reached: dict[int, int]) -> int:
        """Close over letters left out, and number the set."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            for below in self.child[node].values():
                edits = reached[node] + 1
                if edits <= self.most[below] and edits < reached.get(below, 9):
                    reached[below] = edits
                    todo.append(below)
        key = frozenset(reached.items())
        known = self.number.get(key)
        if known is None:
            known = self.number[key] = len(self.sets)
            self.sets.append(key)
            self.held += len(key)
            self.table.append({})
            ends = [(e, self.final[n][0]) for n, e in key if self.final[n] and e <= self.final[n][1]]
            self.hits.append(min(ends, default=None))
            self.stems_hit.append(next((self.stem[n] for n, e in key if e == 0 and self.stem[n]), None))
        return known

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.sets[state]:
            if edits < self.most[node] and edits + 1 < reached.get(node, 9):
                reached[node] = edits + 1  # a letter too many
            for other, below in self.child[node].items():
                cost = edits + (other != letter)
                if cost <= self.most[below] and cost < reached.get(below, 9):
                    reached[below] = cost
        found = self.table[state][letter] = self._state(reached) if reached else -1
        return found

    def match(self, word: str) -> tuple[str, str] | None:
        """The kind of term that ``word`` is (word, misspelled or stem) and the term; None if it is none."""
        if self.held > MOST_HELD:
            self.restart()
        state, stem = self.start, None
        for letter in word:
            following = self.table[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state < 0:
                return ("stem", stem) if stem else None
            stem = self.stems_hit[state] or stem
        hit = self.hits[state]
        if hit and hit[0] == 0:
            return "word", hit[1]
        return ("stem", stem) if stem else ("misspelled", hit[1]) if hit else None


@dataclass
class ToxicityModel:
    #: Log ratio of each term's frequency in toxic and clean texts; stems end in an asterisk.
    terms: dict[str, float] = field(default_factory=dict)
    #: Words near a term that clean texts use.
    harmless: set[str] = field(default_factory=set)
    weights: dict[str, float] = field(default_factory=lambda: {"base": BASE, **KINDS, "length": 0.0})


class Matcher:
    """Hits of a text: terms it has, and whether they stand in quotation."""

    def __init__(self, model: ToxicityModel, window: int, remembered: int = MOST_TOKENS):
        words = {t: edits_allowed(t) for t in model.terms if t[-1] != "*"}
        self.automaton = LexiconAutomaton(words, {t[:-1] for t in model.terms if t[-1] == "*"})
        self.model, self.window, self.remembered = model, window, remembered
        self.seen: dict[str, tuple[str, str, str] | None] = {}

    def token(self, token: str) -> tuple[str, str, str] | None:
        """The strongest hit among the letter runs of a token, or of all its letters together: kind, term and surface."""
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) >= self.remembered:
            self.seen.clear()
        runs = _LETTERS.findall(token)
        found = None
        for run in dict.fromkeys([*runs, "".join(runs)]):
            hit = self.automaton.match(run)
            if hit and not (hit[0] == "misspelled" and run in self.model.harmless):
                if found is None or KINDS[hit[0]] > KINDS[found[0]]:
                    found = (*hit, run)
        self.seen[token] = found
        return found

    def hits(self, text: str) -> list[tuple[str, str, str]]:
        """Kind (with quotation), term and surface of each hit, in order."""
        words = text.lower().split()
        bad = {w for w in set(words) if self.token(w)}
        out = []
        for i, word in enumerate(words) if bad else ():
            if word in bad and (hit := self.token(word)):
                out.append((hit[0] + "_quoted" * self._quoted(words, i), hit[1], hit[2]))
        return out

    def features(self, text: str | None) -> list[float]:
        """One, the scaled sum of log ratios for each kind of hit, and the text's length where it has a hit."""
        hits = self.hits(text) if text else []
        if not hits:
            return [1.0, *[0.0] * (len(KINDS) + 1)]
        value = dict.fromkeys(KINDS, 0.0)
        for (kind, term), n in Counter((k, t) for k, t, _ in hits).items():
            ratio = self.model.terms[term + "*" * kind.startswith("stem")]
            value[kind] += ratio * min(n, REPEATS)
        return [1.0, *(min(v, MOST) / UNIT for v in value.values()), math.log10(len(text) / 600)]

    def _quoted(self, words: list[str], i: int) -> bool:
        """Whether quotation marks open before and close after the hit, or a reporting word stands in its window."""
        before, after = words[max(0, i - self.window) : i + 1], words[i : i + self.window + 1]
        opens = any(w[0] in _QUOTES for w in before)
        closes = any(w.rstrip(".,;:!?)")[-1:] in _QUOTES for w in after)
        near = (w.strip(".,;:!?\"'()") for w in (*before[-4:-1], *after[1:4]))
        return (opens and closes) or any(w in REPORTING for w in near)


def _counts(text: str, config: ToxicityConfig) -> Counter:
    """How often a text has each word, and each beginning of a word as a stem, up to ``REPEATS``."""
    words = Counter(w for w in _LETTERS.findall(text.lower()) if 3 <= len(w) <= 40)
    low, high = config.stem_letters
    out = Counter(words)
    for word, n in words.items():
        for k in range(low, min(high, len(word) - 1) + 1):
            out[word[:k] + "*"] += n
    return Counter({t: min(n, REPEATS) for t, n in out.items()})


def training_rows(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """``text, toxic`` of ``fit_rows`` labelled documents outside the held-out third, or of all if there are fewer.

    Drawn by a hash of id and text together, rows equal in both counting once, so that neither repeated ids nor copies
    fill the sample; only ids and hashes meet the labels.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out("doc_id"))
    marked = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64(F.lit("toxicity"), "doc_id", "text").alias("h"))
    places = keep(texts.select("doc_id", "h").distinct().join(marked, "doc_id"), "toxicity-places")
    chosen = bounded_sample(places.withColumn("all", F.lit(0)), ["all"], {(0,): config.fit_rows})
    # At most fit_rows rows of three numbers, and as many texts.
    rows = texts.join(F.broadcast(chosen.select("doc_id", "h", "toxic")), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    return keep(rows.select("text", "toxic"), "toxicity-sample")


def held_out(id_: str):
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learn lexicon, harmless neighbours and weights from labelled texts.

    Executors count how often each word and stem occurs in toxic and in clean texts. Of the candidates that are much
    more frequent in toxic ones, the driver, which holds for each toxic training text the candidates it has, takes the
    one that explains most of what is not explained yet, until a term explains too little. Labels of one document that
    contradict each other count as toxic; labels without a document, a text or a value are not used.
    """
    rows = training_rows(docs, labels, config)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, times = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = _counts(text, config)
                found[""] = 1
                times[label].update(found)
                texts[label].update(found.keys())
        names = list(times[1].keys() | times[0].keys())
        for a in range(0, len(names), 50_000):
            part = names[a : a + 50_000]
            yield pa.RecordBatch.from_pydict(
                {"term": part, "texts": [texts[1][t] for t in part], "toxic": [times[1][t] for t in part], "clean": [times[0][t] for t in part]}
            )

    counts = rows.mapInArrow(lean(count), "term string, texts long, toxic long, clean long").groupBy("term")
    counts = counts.agg(*(F.sum(c).alias(c) for c in ("texts", "toxic", "clean")))
    counts = keep(counts.filter(F.col("texts") >= config.least_support), "toxicity-counts")
    total = counts.filter("term = ''").head()
    if total is None:
        return ToxicityModel()
    totals = (total["toxic"], total["clean"])
    # As in _log_ratio.
    ratio = F.log(F.col("toxic") / totals[0] / ((F.col("clean") + 2) / max(1, totals[1])))
    strong = counts.filter("term <> ''").withColumn("ratio", ratio).filter(F.col("ratio") >= math.log(config.least_ratio))
    best_first = strong.orderBy(F.desc(F.col("ratio") * F.col("toxic")), "term").limit(config.most_terms)
    found_counts = {r["term"]: (r["toxic"], r["clean"]) for r in best_first.collect()}

    def candidates_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()) if y]
            found = [[(t, n) for t, n in _counts(t, config).items() if t in found_counts] for t in texts]
            yield pa.RecordBatch.from_pydict({"terms": [[t for t, _ in f] for f in found], "times": [[n for _, n in f] for f in found]}, _COVER)

    covers = [list(zip(r["terms"], r["times"])) for r in rows.mapInArrow(lean(candidates_of), "terms array<string>, times array<long>").collect()]
    model = ToxicityModel(_cover(covers, found_counts, totals, config))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model, config.window)
        for batch in batches:
            found = [sorted({w for k, _, w in matcher.hits(t) if k.startswith("misspelled")}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.list_(pa.string())), "toxic": batch.column("toxic")})

    words = rows.mapInArrow(lean(near), "word array<string>, toxic int").select(F.explode("word").alias("word"), "toxic")
    use = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    harmless = use.filter("clean >= 2 AND clean > toxic").orderBy(F.desc("clean"), "word").limit(50_000).collect()
    model.harmless = {r["word"] for r in harmless}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model, config.window)
        for batch in batches:
            found = [[round(v, 2) for v in matcher.features(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    # At most a row for each training text; texts without hits share one.
    seen = rows.mapInArrow(lean(described), "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    seen.sort()
    prior = np.array([BASE, *KINDS.values(), 0.0])
    spread = np.array([0.5, *[1.5] * len(KINDS), 1.0])
    fitted = logistic(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen]), np.array([float(r["count"]) for r in seen]), prior, spread)
    model.weights = dict(zip(["base", *KINDS, "length"], map(float, fitted)))
    return model


_COVER = pa.schema([("terms", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


def _log_ratio(toxic: float, clean: float, totals: tuple[int, int]) -> float:
    """Log ratio of the rates per text; two clean occurrences more keep rare terms from looking certain."""
    return math.log(toxic / totals[0] / ((clean + 2) / max(1, totals[1]))) if toxic > 0 else -math.inf


def _cover(covers: list[list[tuple[str, int]]], counts: dict[str, tuple[int, int]], totals: tuple[int, int], config: ToxicityConfig) -> dict[str, float]:
    """Terms that explain the toxic texts, greedily; of equals a whole word, then the longest.

    ``counts`` has each candidate's occurrences in toxic and clean texts, ``totals`` the texts. A chosen stem stands for
    its continuations, which are dropped. What a chosen term hits is taken from the stems that begin it, as a word has
    one hit, and they stay with the ratio of the rest if it is enough; every other form keeps what it explains itself.
    Gains only shrink, so that a heap whose entries are brought up to date when they come first gives the best term.
    """
    counts = dict(counts)
    ratios = {t: _log_ratio(*n, totals) for t, n in counts.items()}
    need = [config.explained] * len(covers)
    times = [dict(cover) for cover in covers]
    gain: Counter = Counter()
    places: dict[str, list[int]] = {}
    for i, cover in enumerate(times):
        for term, n in cover.items():
            places.setdefault(term, []).append(i)
            gain[term] += min(ratios[term] * min(n, 3), need[i])
    rank = {t: k for k, t in enumerate(sorted(gain, key=lambda t: (t[-1] != "*", len(t), t), reverse=True))}
    heap = [(-round(g, 6), rank[t], t) for t, g in gain.items()]
    heapq.heapify(heap)
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    while heap:
        was, _, best = heapq.heappop(heap)
        name = best.rstrip("*")
        if best not in gain:
            continue
        if any(name[:k] in stems for k in range(1, len(name) + 1)):
            del gain[best]
            continue
        if round(gain[best], 6) < -was:
            heapq.heappush(heap, (-round(gain[best], 6), rank[best], best))
            continue
        if gain[best] < config.least_support * math.log(config.least_ratio):
            break
        chosen[best] = ratios[best]
        del gain[best]
        if best[-1] == "*":
            stems.add(name)
        beginnings = {name[:k] + "*" for k in range(1, len(name) + (best[-1] != "*"))} & gain.keys()
        before = {t: ratios[t] for t in beginnings}
        for term in beginnings:
            counts[term] = tuple(max(0, a - b) for a, b in zip(counts[term], counts[best]))
            ratios[term] = min(ratios[term], _log_ratio(*counts[term], totals))
            if ratios[term] < math.log(config.least_ratio):
                del gain[term]
        touched = {i for t in (best, *(beginnings & gain.keys())) for i in places[t]}
        for i in sorted(touched):
            hit = times[i].get(best, 0)
            left = max(0.0, need[i] - chosen[best] * min(hit, 3))
            for term, n in times[i].items():
                if term in gain:
                    rest = max(0, n - hit) if term in beginnings else n
                    gain[term] += min(ratios[term] * min(rest, 3), left) - min(before.get(term, ratios[term]) * min(n, 3), need[i])
                    times[i][term] = rest
            need[i] = left
    return chosen


def score(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted``.

    A text's log-odds are the base plus, for each kind of hit, a weight times the terms' log ratios; terms in quotation
    weigh less, and chance hits of a long text less than those of a short one as the labels show. Null
    and empty texts have no hits and the base's score. Texts are read whole, labels and other columns are not read.
    Repeated rows score alike. Columns named like the results are replaced. An empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model, config.window)
        for batch in slices(batches, text):
            odds = np.array([matcher.features(t) for t in batch.column(text).to_pylist()]) @ np.array(list(model.weights.values()))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            new = [pa.array(p, pa.float64()), pa.array((p >= config.threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "score", "predicted"])

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return docs.mapInArrow(lean(rows), StructType([*docs.schema.fields, *fields]))


def toxicity_digest(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, by a model of the rows that are not held out."""
    model = fit(docs, labels, config)
    return score(docs.select("doc_id", "text"), model, config).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
