"""Secrets in every version of every text: a ledger of scanned blobs, kept by content; DataFrame functions only."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import fresh, keep
from tastegrid.llm.pii import matches
from tastegrid.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` finds it, where its group ``group`` has ``least`` characters; ``sign`` is a pattern
    that a text must contain for the rule to be tried. A rule that differs in anything is another version."""

    kind: str
    pattern: str
    sign: str
    least: int = 1
    group: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256("\0".join([self.kind, self.pattern, str(self.least), str(self.group)]).encode()).hexdigest()[:16]


# The base rules, in the order of kinds. Quantifiers are possessive where giving back letters cannot help, and
# a stretch too short for its kind is passed over at once; both leave the matches as they are.
_KEY = r"(?i:password|passwd|secret|token|api_?key)"
BASE_RULES = (
    Rule("assign", rf"({_KEY})[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", rf"{_KEY}[\"']?\x20*+[:=]", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", "AKIA[A-Z0-9]{16}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", r"(?<![0-9a-f])[0-9a-f]{24}"),
)
# Published formats of keys and tokens.
FURTHER_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----", "-----BEGIN "),
    Rule("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_"),
    Rule("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", "xox[abprs]-"),
    Rule("google", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", "AIza"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", "eyJ"),
    Rule("url_login", r"://[^\s/:@]++:[^\s/:@]++@", "://[^\\s/:@]++:"),
)
RULES = (*BASE_RULES, *FURTHER_RULES)

_SPANS = "array<struct<rule:string,start:bigint,end:bigint>>"
_RUN = f"blob string, rules array<string>, found {_SPANS}"


def blob_id(text: Column) -> Column:
    """A text's address: the SHA-256 of its UTF-8 bytes; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    """The rule's matches, from the left, not overlapping; those that are too short are dropped and not tried again."""
    hits = matches(text, rule.pattern)
    value = lambda m: m["match"] if not rule.group else F.regexp_extract(m["match"], rule.pattern, rule.group)
    hits = F.filter(hits, lambda m: F.length(value(m)) >= rule.least)
    written = F.transform(hits, lambda m: F.struct(F.lit(rule.version).alias("rule"), m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(rule.sign), written).otherwise(F.array().cast(_SPANS))


# The ledger ----------------------------------------------------------------------------------------------------------


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """``blob, rules, found`` of all committed runs: which rule versions a run tried on a blob, and what they found.

    A run is a folder of its own and counts from the moment that its name is committed; what a failed run has left is
    not read. The names are one row per run."""
    try:
        runs = [r.run for r in spark.read.schema("run string").parquet(f"{ledger}/commits").collect()]
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        runs = []
    if not runs:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (("blob", "string"), ("rules", "array<string>"), ("found", _SPANS))])
    return spark.read.schema(_RUN).parquet(*[f"{ledger}/runs/{run}" for run in sorted(set(runs))])


def unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``blob, todo``: every blob of ``versions`` that some rule version has not been tried on, with those."""
    blobs = versions.select(blob_id(F.col(text)).alias("blob")).distinct()
    tried = ledger_rows(versions.sparkSession, ledger).select("blob", F.explode("rules").alias("rule")).distinct()
    tried = tried.groupBy("blob").agg(F.collect_list("rule").alias("tried"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    todo = F.array_except(wanted, F.coalesce("tried", F.array().cast("array<string>")))
    return blobs.join(tried, "blob", "left").select("blob", todo.alias("todo")).filter("size(todo) > 0")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text", most_broadcast: int = 50_000) -> str | None:
    """Try the rules on all blobs of ``versions`` that they have not been tried on, and commit what they found to the
    ledger. Gives the run's name, None where nothing is new.

    ``versions`` may hold any number of versions of any number of paths; each content is scanned once, however many
    rows have it. Up to ``most_broadcast`` new blobs (200 bytes each) go to every task, so that only their texts are
    shuffled; more are joined by address, after copies have been merged. The ledger is the same either way.
    """
    todo = keep(unseen(versions, ledger, rules, text), "secrets-todo")
    new = todo.count()
    if not new:
        return None
    texts = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Copies are merged before the shuffle, so a blob that is in a third of all rows is one row per task.
    if new <= most_broadcast:
        texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    texts = texts.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    found = [F.when(F.array_contains("todo", r.version), rule_spans(F.col("text"), r)).otherwise(F.array().cast(_SPANS)) for r in rules]
    run = f"run-{uuid.uuid4().hex}"
    texts.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("found")).write.parquet(f"{ledger}/runs/{run}")
    versions.sparkSession.range(1).select(F.lit(run).alias("run")).coalesce(1).write.mode("append").parquet(f"{ledger}/commits")
    return run


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, secrets`` of every blob with findings of the given rule versions: ``array<struct<start, kind, end>>`` by
    start, then kind (its place in ``rules``)."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))])
    rows = ledger_rows(spark, ledger).filter("size(found) > 0").select("blob", F.explode("found").alias("f"))
    rows = rows.select("blob", F.struct(F.col("f.start").alias("start"), place[F.col("f.rule")].alias("kind"), F.col("f.end").alias("end")).alias("span"))
    # Runs at the same time may have tried the same pair.
    return rows.filter("span.kind IS NOT NULL").groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("secrets"))


def with_secrets(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All rows and columns of ``versions`` with ``blob`` and the ``secrets`` in it, empty where there are none: findings
    go back to every path and version that has the content. Columns of these names are replaced."""
    columns = [c for c in versions.columns if c.lower() not in ("blob", "secrets")]
    found = findings(versions.sparkSession, ledger, rules)
    key, spans = (fresh(columns, n) for n in ("found_blob", "found_secrets"))
    found = found.select(F.col("blob").alias(key), F.col("secrets").alias(spans))
    rows = versions.select(*columns, blob_id(F.col(text)).alias("blob")).join(found, F.col("blob") == F.col(key), "left")
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select(*columns, "blob", F.coalesce(spans, nothing).alias("secrets"))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256`` and all ``spans`` of every document.

    Documents are scanned into ``ledger`` (a fresh one in the shared folder by default). Null and empty texts have no
    secrets; repeated rows get the same spans each; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    ledger = ledger or scratch_path(docs.sparkSession, "secret-ledger")
    scan(docs, ledger)
    rows = with_secrets(docs, ledger)

    def count(i: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == i)).cast("long")

    base = F.filter("secrets", lambda s: s["kind"] < len(BASE_RULES))
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return rows.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
