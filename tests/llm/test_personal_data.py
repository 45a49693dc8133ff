import hashlib
import random
import re

from tastegrid.llm.pii import BASE, find, pii_digest, redact

#: The contract's patterns, as they stand there.
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(CONTRACT.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_against_the_contract(docs):
    rng = random.Random(7)
    texts = ["a@b.c_d@e.f", "x@y..z@w.v", "1.2.3.4.5.6.7.8", "1.2..3.4.5.6", "é😀 a.b@c.de 😀 +1 (212) 555-0100.", "4111 1111 1111 1111", "+12", "256.1.1.1 0255.01.1.1", None, ""]
    for _ in range(700):
        texts.append("".join(rng.choice(["a", "b.", "@", ".", "_", "1", "22", "4", " ", "-", "+", "(", ")", "é", "\n", "c.d", "a@b.c"]) for _ in range(rng.randrange(60))))
    for _ in range(150):
        texts.append("".join(rng.choice("0123456789 -") for _ in range(rng.randrange(40))))
    rows = {r.doc_id: r for r in pii_digest(docs(*enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert rows[i].base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), text
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(filter(None, written(want).split(","))) <= set(rows[i].spans.split(","))


def test_many_matches_and_long_words(docs):
    many = " ".join(f"u{k}@host{k}.example" for k in range(2000)) + " " + "a" * 8_000 + " " + "1" * 4_000 + ".2.3.4 x@" + ".b" * 9_000 + "y@" + "z.a" * 20_000
    row = pii_digest(docs((1, many))).collect()[0]
    assert row.base_sha256 == hashlib.sha256(written(brute(many)).encode()).hexdigest()


def test_contexts_give_unseen_identifiers_away(docs):
    rng = random.Random(9)
    rows = [(i, f"please call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} soon, thing {i}") for i in range(12)]
    rows += [(100, "please call (415) 555-2671 soon, thing"), (101, "version 2.0 of 12 things"), (102, "please call maybe 7 soon,")]
    spans = {r.doc_id: r.spans for r in pii_digest(docs(*rows)).collect()}
    assert spans[100] == "phone:12:26" and spans[101] == "" and spans[102] == ""


def test_written_out_addresses_and_stretches_of_a_run(docs):
    rng = random.Random(4)
    rows = [(i, f"write to user{chr(97 + i)}@host.example today, thing {i}") for i in range(12)]
    rows += [(20 + i, f"please call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} soon, thing {i}") for i in range(12)]
    rows += [(100, "write to jane.doe(at)example.com today, thing"), (101, "please call 12b (415) 555-2671 soon, thing"), (102, "see (at) 12 3456 of 7")]
    spans = {r.doc_id: r.spans for r in pii_digest(docs(*rows)).collect()}
    assert spans[100] == "email:9:32" and spans[101] == "phone:16:30" and spans[102] == ""


def test_redaction(docs):
    table = docs((1, "é mail a.b@c.example, ip 10.0.0.1; card 4111 1111 1111 1111 or +1 212 555 0100!"), (2, "nothing here 12"), (3, None))
    texts = {r.doc_id: r.text for r in redact(find(table)).collect()}
    assert texts == {1: "é mail [EMAIL], ip [IP]; card [CARD] or [PHONE]!", 2: "nothing here 12", 3: None}


def test_odd_rows_and_none(oddities, docs):
    found = find(oddities)
    assert found.count() == oddities.count() and redact(found).columns == [c for c in oddities.columns if c not in ("pii", "base_pii")]
    mailed = [r for r in found.collect() if r.pii]
    assert [len(r.pii) for r in mailed] == [2]
    assert redact(find(docs().limit(0))).count() == 0


def test_only_dataframe_functions(docs):
    plan = find(docs((1, "a@b.c")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_very_long_words_take_no_longer_than_their_length(docs):
    row = pii_digest(docs((1, "a" * 400_000 + " " + "1" * 200_000 + " " + "a.b@c.de" + ".x" * 100_000))).collect()[0]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 0, 0) and row.spans == "email:600002:800010"


def test_many_addresses_in_one_text(docs):
    text = " ".join(f"u{k}@host{k}.example" if k % 2 else f"10.{k % 256}.{k // 256 % 256}.7" for k in range(30_000))
    found = find(docs((1, text), (2, "x")))
    rows = {r.doc_id: r for r in found.select("doc_id", "base_pii", "pii").collect()}
    assert [tuple(s) for s in rows[1].base_pii] == brute(text) == [tuple(s) for s in rows[1].pii] and rows[2].pii == []
    out = {r.doc_id: r.text for r in redact(found).collect()}
    assert out[1] == " ".join("[EMAIL]" if k % 2 else "[IP]" for k in range(30_000)) and out[2] == "x"


def test_rounds_go_on_until_one_finds_nothing(docs):
    # Four generations: each is given away by the context that it shares with the one before, and has a form of its own.
    rows = [f"dial0 +1 (212) 55{k // 100}-10{k % 100:02d} end0" for k in range(512)]
    for g, (form, size) in enumerate([("(415) 555-{:04d}", 128), ("415-555-{:04d}", 32), ("415.555.{:04d}", 8), ("(415)555-{:04d}", 2)]):
        rows += [f"dial{c} {form.format(k)} end{c}" for k in range(size) for c in (g, g + 1)]
    rows += ["nothing 12 here", "dialz 415/5550000 endz"]
    spans = {r.doc_id: r.spans for r in pii_digest(docs(*enumerate(rows))).collect()}
    assert [text for i, text in enumerate(rows) if not spans[i]] == rows[-2:]


def test_redaction_against_a_brute_force_version(docs):
    rng = random.Random(12)
    pieces = ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-0100", " ", "x", "é😀", "\n", "1.2.3.4@e.fg"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) + "z" * rng.choice([0, 5000]) for _ in range(150)]
    texts += ["ab " * 3000 + "1.2.3.4" + " é" * 3000 + "a@b.cd", None, ""]
    found = find(docs(*enumerate(texts)))
    spans = {r.doc_id: [tuple(s) for s in r.pii] for r in found.collect()}
    got = {r.doc_id: r.text for r in redact(found).collect()}
    names = [f"[{k.upper()}]" for k in BASE]
    for i, text in enumerate(texts):
        out, at = "", 0
        for start, kind, end in spans[i]:
            if start >= at:
                out += text[at:start] + names[kind]
            at = max(at, end)
        assert got[i] == (text if text is None else out + text[at:]), text
