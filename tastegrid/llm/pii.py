"""Personal data: base patterns seed a bootstrapped, contextual extraction of further identifiers; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import fresh, keep


@dataclass(frozen=True)
class PiiConfig:
    #: A pattern speaks for a kind if it has seen so many known instances, and they are this share of all its instances.
    least_support: int = 3
    pattern_confidence: float = 0.6
    #: Instances known to be of a kind from this confidence on.
    instance_confidence: float = 0.9


# The base patterns, in the order of kinds. Quantifiers are possessive where giving back letters cannot
# help, and a match starts at the beginning of a run of its letters or where the last match ended: both keep the time in
# proportion to the text and leave the matches as they are.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word that holds a digit, an at sign or a written-out one: what an unseen identifier may consist of.
MARKED = r"(?<!\S)(?:[^\s0-9@(\[]++|[(\[](?!at[)\]]))*+(?:[0-9@]|[(\[]at[)\]])\S*+"
#: Words of the longest written form of a kind: a card's 19 digits, each alone.
LONGEST = 19
#: Characters of a text that are cut at a time.
CHUNK = 4096


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""
    digits = F.split(F.reverse(_digits(match)), "")

    def worth(d: Column, i: Column) -> Column:
        n = F.coalesce(d.cast("int"), F.lit(0))
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(match)).between(14, 19), _luhn(match)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: in a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start, end, match>>``, in code points, in order.

    Spark gives the matches and the stretches between them; their lengths add up to the places. The sums run over parts
    of 512 matches, so that a text with very many costs little more than its length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("match"), F.length(gap).cast("long").alias("gap")))
    return bound(F.filter(pairs, lambda p: p["match"].isNotNull()), _placed)


def _placed(pairs: Column) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / 512).cast("int")), lambda b: F.slice(pairs, b * 512 + 1, 512))

    def width(p: Column) -> Column:
        return p["gap"] + F.length(p["match"])

    def place(part: Column) -> Column:
        """Places of a part's matches, counted from its beginning; its whole length."""
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,match:string>>").alias("rows"))
        return F.aggregate(
            part,
            start,
            lambda acc, p: F.struct(
                (acc["at"] + width(p)).alias("at"),
                F.concat(acc["rows"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["match"].alias("match")))).alias("rows"),
            ),
        )

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["rows"], lambda r: F.struct((r["start"] + acc["at"]).alias("start"), r["match"].alias("match")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["rows"], F.array(moved)).alias("rows"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,match:string>>>").alias("rows"))
    joined = F.aggregate(F.transform(parts, place), empty, join, lambda acc: F.flatten(acc["rows"]))
    ends = F.transform(joined, lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(r["match"])).alias("end"), r["match"].alias("match")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(F.size(pairs) > 0, ends).otherwise(nothing)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of a base pattern; failing ones are dropped and not tried again."""
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    sign = text.contains("@") if kind == "email" else text.rlike(SIGNS[kind])
    return F.when(sign, F.filter(matches(text, BASE[kind]), lambda m: _valid(kind, m["match"]))).otherwise(nothing)


def _merged(arrays: dict[str, Column]) -> Column:
    """Spans of all kinds as ``array<struct<start, kind number, end>>`` by start, then kind."""

    def tagged(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[tagged(k, a) for k, a in enumerate(arrays.values())]))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in BASE])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


# Bootstrapping -------------------------------------------------------------------------------------------------------


def _core(run: Column) -> Column:
    """A stretch without the punctuation around it."""
    return F.regexp_replace(run, r"^[\"'\[{<,;:]+|[\"'\]}>.,;:!?]+$", "")


def _looks_like(kind: str, core: Column) -> Column:
    digits = F.length(_digits(core))
    if kind == "email":
        return core.rlike(r"^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+$")
    if kind == "ip":
        return core.rlike(r"^[0-9]{1,3}(?:[.,:][0-9]{1,3}){3}$")
    if kind == "card":
        return core.rlike(r"^[0-9][0-9 .-]*[0-9]$") & digits.between(14, 19)
    return core.rlike(r"^[+(]?[0-9][0-9 ().-]*[0-9]$") & digits.between(10, 15)


def occurrences(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """Stretches of marked words that look like identifiers, with their place, their kind if they are a base span, and
    their context. Stretches that share letters with a base span but are none are no instances."""
    # A number of its own for each row, so that repeated rows are no common group.
    has = docs.filter(F.col(text).rlike(r"[0-9@]|[(\[]at[)\]]")).withColumn("row", F.monotonically_increasing_id())
    spans = _merged({k: base_spans(F.col(text), k) for k in BASE})
    found = has.select("row", *key, spans.alias("base"), F.split(F.col(text), MARKED, -1).alias("gaps"), matches(F.col(text), MARKED).alias("words"))
    # Of the gaps the words beside them, and whether it is a single blank.
    gap = lambda g: F.struct((g == " ").alias("blank"), F.regexp_extract(g, r"(?<!\S)(\S++)\s*+$", 1).alias("left"), F.regexp_extract(g, r"^\s*+(\S++)", 1).alias("right"))
    found = found.select("row", *key, "base", "words", F.transform("gaps", gap).alias("gaps"))
    # Only words of digits and their punctuation go on: no kind has a blank beside a letter.
    goes_on = lambda w: w["match"].rlike(r"^[\"'\[{<,;:]*+[0-9 ().+-]++$")

    def reach(w: Column, i: Column) -> Column:
        """The word and those that may follow it in a stretch, each with the gap after it and the marked word beyond."""
        size = F.when(goes_on(w) & F.get(F.col("gaps"), i + 1)["blank"], F.lit(LONGEST + 1)).otherwise(F.lit(2))
        before = F.when(i > 0, F.get(F.col("words"), i - 1)["match"])
        left = F.get(F.col("gaps"), i)["left"]
        return F.struct(
            w["start"].alias("start"),
            F.when(left != "", left).otherwise(F.regexp_replace(F.coalesce(before, F.lit("")), r"^.*\s", "")).alias("left"),
            F.slice("words", i + 1, size)["match"].alias("words"),
            F.slice("gaps", i + 2, size).alias("gaps"),
        )

    # Base spans and words become rows of their own: neither carries the other, however many there are.
    event = "struct<kind:int,start:bigint,end:bigint,left:string,words:array<string>,gaps:array<struct<blank:boolean,left:string,right:string>>>"
    none = lambda name: F.lit(None).alias(name)
    as_base = lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), none("left"), none("words"), none("gaps")).cast(event)

    def as_word(w: Column, i: Column) -> Column:
        r = reach(w, i)
        return F.struct(none("kind"), r["start"].alias("start"), none("end"), r["left"].alias("left"), r["words"].alias("words"), r["gaps"].alias("gaps")).cast(event)

    rows = found.select("row", *key, F.explode(F.concat(F.transform("base", as_base), F.transform("words", as_word))).alias("e")).select("row", *key, "e.*")

    def stretch(n: Column) -> Column:
        beyond = F.coalesce(F.get(F.col("words"), n), F.lit(""))
        right = F.get(F.col("gaps"), n - 1)["right"]
        joined = (n == 1) | F.forall(F.slice("gaps", 1, n - 1), lambda g: g["blank"])
        run = F.array_join(F.slice("words", 1, n), " ")
        return F.when(joined, F.struct(run.alias("run"), F.when(right != "", right).otherwise(beyond).alias("right")))

    lengths = F.sequence(F.lit(1), F.when(F.size("words") > 2, F.least(F.size("words"), F.lit(LONGEST))).otherwise(F.when((F.size("words") == 2) & F.get(F.col("gaps"), F.lit(0))["blank"], 2).otherwise(1)))
    stretches = F.when(F.col("kind").isNull(), F.filter(F.transform(lengths, stretch), lambda s: s.isNotNull())).otherwise(F.array(F.lit(None).cast("struct<run:string,right:string>")))
    rows = rows.select("row", *key, "kind", "start", "end", "left", F.explode(stretches).alias("s"))
    rows = rows.select("row", *key, "kind", "start", "end", "left", F.col("s.run").alias("run"), F.col("s.right").alias("right"))
    rows = rows.withColumn("core", _core(F.col("run"))).filter("kind IS NOT NULL OR core <> ''")
    begin = F.coalesce(F.col("start") + F.instr("run", F.col("core")) - 1, F.col("start"))
    rows = rows.withColumn("start", begin).withColumn("end", F.coalesce("end", F.col("start") + F.length("core")))
    # Of the stretches only what looks like a kind goes on, and an address with more zeros than look like one. A generator
    # of one row: no filter is pushed below it, so that each is looked at once.
    like = F.filter(F.array(*[F.when(_looks_like(k, F.col("core")), F.lit(k)) for k in BASE]), lambda k: k.isNotNull())
    wanted = F.col("kind").isNotNull() | (F.size("like") > 0) | F.col("core").rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    rows = rows.select("row", *key, "kind", "left", "right", F.explode(F.array(F.struct("core", "start", "end", like.alias("like")))).alias("p"))
    rows = rows.select("row", *key, "kind", "left", "right", "p.*").filter(wanted)
    # Base spans in order of their start, and stretches where they end: the furthest end of the spans that start before a
    # stretch ends tells whether one touches it.
    order = [F.when(F.col("kind").isNull(), F.col("end")).otherwise(F.col("start")), F.col("kind").isNotNull()]
    earlier = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    furthest = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(earlier)
    same = F.min("kind").over(Window.partitionBy("row", "start", "end"))
    kinds = F.array(*[F.lit(k) for k in BASE])
    rows = rows.withColumn("touched", F.coalesce(furthest > F.col("start"), F.lit(False))).withColumn("known", F.get(kinds, same))
    rows = rows.filter("kind IS NULL").withColumn("like", F.when(~F.col("touched"), F.col("like"))).filter("known IS NOT NULL OR size(like) > 0")
    # Lexical patterns: the word before, the word after, and the written form of the stretch's last two words.
    form = F.regexp_replace(F.regexp_extract("core", r"(\S+\s)?\S+$", 0), "[0-9]", "0")
    form = F.regexp_replace(form, "[A-Za-z]+", "a")
    patterns = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("l:"), F.lower("left"))),
        F.when(F.col("right") != "", F.concat(F.lit("r:"), F.lower("right"))),
        F.concat(F.lit("f:"), form),
    )
    return rows.select(*key, "start", "end", F.lower("core").alias("core"), "known", "like", F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))


def bootstrap(seen: DataFrame, config: PiiConfig) -> DataFrame:
    """Unseen instances ``(core, kind)`` that the contexts of known ones give away.

    Patterns and instances are the two sides of a graph. Each round scores a pattern for a kind by the share of its
    instances known to be of the kind, then an instance by the chance that not all of its good patterns are wrong;
    instances of high confidence are known from the next round on, and the rounds end with one that finds none. Links are distinct and counted before they are shuffled;
    a frequent pattern is one key of an aggregate, and only good patterns are joined.
    """
    links = keep(seen.select(F.explode("patterns").alias("pattern"), "core", "known", "like").distinct(), "pii-links")
    sizes = links.groupBy("pattern").agg(F.count_distinct("core").alias("n"))
    seeds = links.filter("known IS NOT NULL").select("core", F.col("known").alias("kind")).distinct()
    candidates = links.filter("known IS NULL").select("pattern", "core", F.explode("like").alias("kind"))
    found = links.filter("1 = 0").select("core", F.lit("").alias("kind"))
    turn = 0
    while True:
        known = seeds.union(found)
        support = links.select("pattern", "core").distinct().join(known, "core").groupBy("pattern", "kind").agg(F.count("*").alias("s"))
        good = support.join(sizes, "pattern").withColumn("confidence", F.col("s") / (F.col("n") + 1))
        good = good.filter((F.col("s") >= config.least_support) & (F.col("confidence") >= config.pattern_confidence))
        scored = candidates.join(found, "core", "left_anti").join(good.select("pattern", "kind", "confidence"), ["pattern", "kind"])
        scored = scored.groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("c"))
        best = scored.filter(F.col("c") >= config.instance_confidence).groupBy("core").agg(F.max_by("kind", F.struct("c", "kind")).alias("kind"))
        new = keep(best, f"pii-found-{turn}")
        if new.isEmpty():
            return found
        found = new if not turn else found.unionByName(new)
        turn += 1


def find(docs: DataFrame, config: PiiConfig = PiiConfig(), text: str = "text", id_: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``pii``: ``array<struct<start, kind, end>>`` of all spans by start, then kind
    (a number, the place in ``BASE``), and ``base_pii``, those of the base patterns.

    Places are code points, ends exclusive. Base spans always stay; a discovered one is added where no base span overlaps
    it. Null and empty texts have none. Rows equal in id and text get the same spans, null ids included. Columns named
    like the results are replaced. An empty table gives no rows.
    """
    docs = docs.drop("pii", "base_pii")
    hash_, extra = (fresh(docs.columns, c) for c in ("text_hash", "extra"))
    keyed = docs.withColumn(hash_, F.xxhash64(text))
    seen = keep(occurrences(keyed.select(F.col(id_).alias("id"), F.col(hash_).alias("h"), text), ["id", "h"], text), "pii-seen")
    found = bootstrap(seen, config)
    kinds = F.array(*[F.lit(k) for k in BASE])
    number = (F.array_position(kinds, F.col("kind")) - 1).cast("int")
    spans = seen.filter("known IS NULL").join(found, "core").select("id", "h", F.struct("start", number.alias("kind"), "end").alias("span")).distinct()
    # Of stretches of a kind that lie in each other the longest: one that an earlier one reaches beyond is left out.
    wider = Window.partitionBy("id", "h", "span.kind").orderBy("span.start", F.desc("span.end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("span.end").over(wider)).filter("reached IS NULL OR reached < span.end")
    per_text = spans.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list("span").alias(extra))
    per_text = per_text.withColumnsRenamed({"_id": fresh(docs.columns, "extra_id"), "_h": fresh(docs.columns, "extra_h")})
    key, key_hash = per_text.columns[:2]
    value = F.coalesce(F.col(text), F.lit(""))
    base = _merged({k: base_spans(value, k) for k in BASE})
    rows = keyed.withColumn("base_pii", base).join(per_text, F.col(id_).eqNullSafe(F.col(key)) & (F.col(hash_) == F.col(key_hash)), "left")
    # A stretch that a base span touches has not become an instance.
    added = F.coalesce(F.col(extra), F.array())
    return rows.withColumn("pii", F.array_sort(F.concat("base_pii", added))).select(*docs.columns, "base_pii", "pii")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of :func:`find` with each span's text replaced by its kind in brackets; overlapping spans become one, named
    after the first. The spans' columns are gone."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in BASE])
    chunks, spans = (fresh(found.columns, n) for n in ("chunks", "spans"))
    # The text in stretches of equal length, so that a piece is cut from those that it lies in and not from the beginning.
    cut_up = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    few = F.when(F.size("pii") > 0, F.struct(cut_up.alias("chunks"), _with_reach(F.col("pii")).alias("spans")))
    # A generator of one row: both are computed once.
    rows = found.select("*", F.explode(F.array(few)).alias(spans)).withColumn(chunks, F.col(f"{spans}.chunks")).withColumn(spans, F.col(f"{spans}.spans"))

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK)
        lies_in = F.slice(chunks, (first + 1).cast("int"), (F.floor((end - 1) / CHUNK) - first + 1).cast("int"))
        whole = F.substring(F.array_join(lies_in, ""), (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))
        return F.when(end > start, whole).otherwise(F.lit(""))

    kept = F.filter(spans, lambda s: s["start"] >= s["before"])
    pieces = F.flatten(F.transform(kept, lambda s: F.array(piece(s["before"], s["start"]), F.element_at(names, s["kind"] + 1))))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = piece(last, F.length(F.col(text)).cast("long"))
    redacted = F.when(F.size("pii") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))
    return rows.withColumn(text, redacted).drop("pii", "base_pii", chunks, spans)


def _with_reach(spans: Column) -> Column:
    """Spans with ``before``, the furthest end of all spans before them; in parts, as in :func:`matches`."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / 512).cast("int")), lambda b: F.slice(spans, b * 512 + 1, 512))
    kind = "struct<start:bigint,kind:int,end:bigint,before:bigint>"

    def run(part: Column, reached: Column) -> Column:
        start = F.struct(reached.alias("at"), F.array().cast(f"array<{kind}>").alias("rows"))
        return F.aggregate(
            part,
            start,
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.concat(acc["rows"], F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), acc["at"].alias("before")))).alias("rows"),
            ),
        )

    def join(acc: Column, part: Column) -> Column:
        done = run(part, acc["at"])
        return F.struct(done["at"].alias("at"), F.concat(acc["rows"], F.array(done["rows"])).alias("rows"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("rows"))
    return F.aggregate(parts, empty, join, lambda acc: F.flatten(acc["rows"]))


def pii_digest(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256`` and all ``spans`` of every document."""
    found = find(docs.select("doc_id", "text"), config)

    def count(i: int) -> Column:
        return F.size(F.filter("base_pii", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base_pii")), 256).alias("base_sha256"), _written(F.col("pii")).alias("spans"))
