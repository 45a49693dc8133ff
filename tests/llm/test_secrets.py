import hashlib
import random
import re

from pyspark.sql import functions as F

from tastegrid.llm import secrets
from tastegrid.llm.secrets import BASE_RULES, RULES, Rule, findings, ledger_rows, scan, secret_digest, unseen, with_secrets
from tests.helpers import plan, tuples

#: The contract's patterns, as they stand there.
CONTRACT = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(CONTRACT.items()):
        group, least = LEAST[kind]
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def written(spans):
    return ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans)


PIECES = ["token", "ToKeN", "api_key", "APIKEY", "secret", "passwd", "password", "=", ":", " ", "  ", "'", '"', "abc", "abcdef", "0123456789abcdef", "AKIA", "AKIAABCDEFGH", "ABCDEFGH1234", "é", "😀", "\n", "==", "x.y/z", "_", "deadbeef", "g"]


def test_base_spans_against_the_contract(docs):
    rng = random.Random(11)
    texts = [None, "", "token: ab token: abcdefg", "secret: token: abcdefgh", "secret=token=abcdefgh", "a" * 23, "a" * 24 + "G" + "0" * 30, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 12, "😀 password = 'hunter22'"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(900)]
    rows = {r.doc_id: r for r in secret_digest(docs(*enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert rows[i].base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), text
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert set(filter(None, written(want).split(","))) <= set(rows[i].spans.split(","))


def test_further_kinds_and_clean_texts(docs):
    jwt = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4"
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-123456789012-abc", "AIza" + "x" * 35, jwt, "postgres://me:pw@host/db", "the token of a keyboard: fine, see https://host:80/a@b"]
    spans = [r.spans for r in secret_digest(docs(*enumerate(texts))).orderBy("doc_id").collect()]
    assert spans == ["private_key:0:31", "github:0:40", "slack:0:21", "google:0:39", f"jwt:0:{len(jwt)}", "url_login:8:17", ""]


def test_odd_rows(oddities):
    got = secret_digest(oddities)
    assert got.count() == oddities.count()
    assert tuples(got.select("spans").distinct()) == [("",)]
    assert secret_digest(oddities.limit(0)).collect() == []


def test_long_text_with_many_secrets(docs):
    text = " ".join(f"token={k:06d}" for k in range(3000)) + " " + "ab" * 50_000
    row = secret_digest(docs((1, text))).collect()[0]
    assert row.base_sha256 == hashlib.sha256(written(brute(text)).encode()).hexdigest()


def test_only_unseen_pairs_are_scanned(docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = docs((1, "token = abcdef"), (2, "token = abcdef"), (3, "nothing"))
    assert scan(first, ledger, BASE_RULES)
    assert scan(first, ledger, BASE_RULES) is None
    # A second version of path 1, a path with a known blob, and a new blob.
    second = first.union(docs((1, "token = ghijkl"), (4, "nothing"), (5, "deadbeef" * 3)))
    assert {r.todo == [x.version for x in BASE_RULES] for r in unseen(second, ledger, BASE_RULES).collect()} == {True}
    assert unseen(second, ledger, BASE_RULES).count() == 2
    scan(second, ledger, BASE_RULES)
    # A changed rule and a new one: every blob, but only these two versions.
    changed = (BASE_RULES[0], Rule("access", "AKIA[A-Z]{4}", "AKIA", 8), BASE_RULES[2], Rule("word", "nothing", "nothing"))
    todo = unseen(second, ledger, changed).collect()
    assert len(todo) == 4 and {tuple(r.todo) for r in todo} == {(changed[1].version, changed[3].version)}
    scan(second, ledger, changed)
    pairs = ledger_rows(second.sparkSession, ledger).select("blob", F.explode("rules").alias("rule"))
    assert pairs.count() == pairs.distinct().count() == 4 * 5
    got = tuples(with_secrets(second, ledger, changed).select("doc_id", "secrets"))
    assert [(i, [tuple(s) for s in spans]) for i, spans in got] == [
        (1, [(0, 0, 14)]),
        (1, [(0, 0, 14)]),
        (2, [(0, 0, 14)]),
        (3, [(0, 3, 7)]),
        (4, [(0, 3, 7)]),
        (5, [(0, 2, 24)]),
    ]
    # The rules of before still have their findings.
    assert findings(second.sparkSession, ledger, BASE_RULES).count() == 3


def test_a_failed_run_counts_for_nothing(docs, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    df = docs((1, "token = abcdef"), (2, "x"))
    rows = df.sparkSession.createDataFrame([("b", ["r"], [("r", 0, 1)])], secrets._RUN)
    rows.write.parquet(f"{ledger}/runs/run-broken")
    assert ledger_rows(df.sparkSession, ledger).count() == 0
    scan(df, ledger)
    assert [r.spans for r in secret_digest(df, ledger).orderBy("doc_id").collect()] == ["assign:0:14", ""]


def test_both_ways_to_the_texts_agree(docs, tmp_path):
    df = docs(*[(k, f"token = abcdef{k % 7}") for k in range(60)], (60, None))
    scan(df, str(tmp_path / "a"))
    scan(df, str(tmp_path / "b"), most_broadcast=0)
    a, b = (ledger_rows(df.sparkSession, str(tmp_path / x)) for x in "ab")
    assert a.count() == 8 and tuples(a) == tuples(b)


def test_no_python_in_the_plan(docs):
    text = plan(secret_digest(docs((1, "token = abcdef"))))
    assert "Python" not in text and "Arrow" not in text and "Scan ExistingRDD" not in text.replace("Scan ExistingRDD[doc_id", "")
