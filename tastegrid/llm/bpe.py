"""BPE encoding and decoding by a tokenization automaton compiled from the merges of an existing vocabulary."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tastegrid.llm.common import lean, slices

NEVER = 1 << 60
#: Words, beginnings of words and arcs that a coder remembers: about 35 MB together. The result does not depend on it.
MOST_WORDS, MOST_PATHS, MOST_ARCS = 100_000, 40_000, 100_000
#: The vocabulary's own rule for splitting, white space being Unicode's.
_BLANK = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _BLANK + r"\p{L}\p{N}]+"


@functools.cache
def unsure_letters() -> tuple[str, str]:
    """Sets of code points on which Unicode versions differ: letters, numbers, marks that the regex library knows and Python
    does not, and those of them that the vocabulary's own library, which is asked, does not know either."""
    loose = regex.compile(r"[\p{L}\p{N}\p{M}]")
    unsure = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and loose.match(chr(c))]
    others = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed")
    late = [ord(c) for part, _ in others.pre_tokenize_str("".join(map(chr, unsure))) for c in part]
    return _ranges(unsure), _ranges(late)


def _ranges(points: list[int]) -> str:
    breaks = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    spans = [(points[a], points[b - 1]) for a, b in zip([0, *breaks], [*breaks, len(points)])] if points else []
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Automaton:
    """A deterministic automaton over the vocabulary: its paths over a word's symbols are exactly the word's BPE tokens.

    It starts as one state per symbol, any symbol following any other. Each merge ``(u, v)``, in order of priority, is a
    gadget: it adds the token ``uv`` with a state of its own, takes the arc ``v`` away from states that end in ``u``
    from then on, and gives ``uv`` the arcs into ``u`` and out of ``v`` that exist at that moment. What a state has kept
    and lost is recorded by the time spans of the tokens at its right and left edge, so a merge adds one state and two
    short lists. An arc from ``q`` to ``x`` is left at the end if no merge came between the two, that is if no pair of
    their edge tokens was ever mergeable while both stood at the edge. Arcs are looked up once and kept in a table.
    """

    def __init__(self, symbols: Iterable[str], merges: Iterable[tuple[str, str]]):
        self.rank: dict[tuple[str, str], int] = {}
        self.right: dict[str, tuple] = {s: ((s, NEVER),) for s in symbols}
        self.left: dict[str, tuple] = dict(self.right)
        for time, (u, v) in enumerate(merges):
            token = u + v
            # Without an arc from u to v at this moment no path has the pair, and the merge adds nothing.
            if token not in self.right and u in self.right and v in self.right and self._arc(u, v):
                # The edge token below the new one stands at the edge until this moment.
                self.right[token] = ((token, NEVER), (v, time), *self.right[v][1:])
                self.left[token] = ((token, NEVER), (u, time), *self.left[u][1:])
            self.rank.setdefault((u, v), time)
        self.longest = max(map(len, self.right), default=0)
        self.arcs: dict[str, dict[str, bool]] = {}
        self.n_arcs = 0
        self.paths: dict[str, list[str]] = {}

    def arc(self, q: str, x: str) -> bool:
        row = self.arcs.get(q)
        if row is None:
            row = self.arcs[q] = {}
        known = row.get(x)
        if known is None:
            if self.n_arcs >= MOST_ARCS:
                self.arcs.clear()
                self.n_arcs, row = 0, self.arcs.setdefault(q, {})
            self.n_arcs += 1
            known = row[x] = self._arc(q, x)
        return known

    def _arc(self, q: str, x: str) -> bool:
        rank = self.rank
        for a, a_ends in self.right[q]:
            for b, b_ends in self.left[x]:
                time = rank.get((a, b))
                # Of merges at one moment the leftmost comes first: one inside q wins, one inside x does not.
                if time is not None and time < a_ends and time <= b_ends:
                    return False
        return True

    def path(self, word: str, suffix: str = "") -> list[str]:
        """Tokens of ``word``, a string of symbols of which the last carries ``suffix``; a word's tokens in order.

        Every beginning of a word has one path, so exactly one arc leads to the word's end: the longest token is tried
        first. Paths of beginnings are shared by words and kept. The walk back is as deep as the word has tokens; of a
        very long word, the beginnings are entered from the front, and only their last arcs are kept.
        """
        if len(word) > 200:
            return self._long_path(word, suffix)
        for j in range(max(0, len(word) + len(suffix) - self.longest), len(word)):
            token = word[j:] + suffix
            if token in self.right:
                if not j:
                    return [token]
                before = self.paths.get(word[:j])
                if before is None:
                    if len(self.paths) >= MOST_PATHS:
                        self.paths.clear()
                    before = self.paths[word[:j]] = self.path(word[:j])
                if self.arc(before[-1], token):
                    return [*before, token]
        raise ValueError(f"no token for a symbol of {word!r}")

    def _long_path(self, word: str, suffix: str) -> list[str]:
        n = len(word)
        last, back = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            end = suffix if i == n else ""
            for j in range(max(0, i - self.longest), i):
                token = word[j:i] + end
                if token in self.right and (not j or self.arc(last[j], token)):
                    last[i], back[i] = token, j
                    break
        path, i = [], n
        while i:
            path.append(last[i])
            i = back[i]
        return path[::-1]


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends: ids as the file's own library gives them."""

    def __init__(self, file: dict, unsure: tuple[str, str] = ("", ""), remembered: int = MOST_WORDS):
        model = file["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.labels = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.letters = byte_letters()
        symbols = [c + end for c in self.letters for end in {"", self.suffix}]
        self.automaton = Automaton(symbols, (tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]))
        self.split = self.careful = regex.compile(_SPLIT)
        points, late = unsure
        self.unsure = regex.compile(f"[{points}]") if points else None
        # Latin, Greek and Cyrillic texts need no look at the large set.
        self.beyond = re.compile("[^\0-\u052f]")
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        if late:
            other = "[[^" + _BLANK + r"\p{L}\p{N}]||[" + late + "]]+"
            self.careful = regex.compile(r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[" + late + r"]]+|[\p{N}--[" + late + "]]|" + other)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.remembered = remembered
        self.seen: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= self.remembered:
                self.seen.clear()
            letters = "".join([self.letters[b] for b in word.encode()])
            found = self.seen[word] = tuple([self.ids[t] for t in self.automaton.path(letters, self.suffix)])
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            split = self.split
            if part.isascii():
                part = part.lower()
            elif self.unsure and self.beyond.search(part) and self.unsure.search(part):
                part, split = self.normalizer.normalize_str(part), self.careful
            else:
                # Letters are lowered one by one: a capital sigma at a word's end is no special case.
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()
            for word in split.findall(part):
                out += self.seen.get(word) or self.word(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs that the ids name, with blanks between, as the file states no decoder."""
        return " ".join([self.labels[i] for i in ids])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """All rows and columns of ``docs`` with the token ids of the whole text and their decoding.

    ``path`` names a vocabulary file of the tokenizers library (default: the public word BPE of 49,408 tokens); the
    driver reads it, and it travels to the executors as a broadcast of the file's size. Null and empty texts have no
    tokens and decode to the empty text. Columns named like the two results are replaced. An empty table gives no rows.
    Work is per row; repeated rows are encoded alike. One long text is the most a task holds besides a batch.
    """
    docs = docs.drop(ids, decoded)
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    unsure = unsure_letters()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe(json.loads(vocabulary.value), unsure)
        for batch in slices(batches, text):
            tokens = [coder.encode(t) if t else [] for t in batch.column(text).to_pylist()]
            columns = [*batch.columns, pa.array(tokens, pa.list_(pa.int32())), pa.array([coder.decode(t) for t in tokens], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, ids, decoded])

    schema = docs.withColumns({ids: F.lit(None).cast("array<int>"), decoded: F.lit(None).cast("string")}).schema
    return docs.mapInArrow(lean(rows), schema)


def token_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    coded = encode(docs.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
