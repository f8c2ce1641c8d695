from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quaymark.llm import pii

from llm_rows import make

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=d: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TEXTS = [
    "a@b.com_x@y.zz a@b..c 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "x" * 20_000 + "@" + "y.z",
    "+1 (499) 555-6503 +123 4111 1111 1111 1111 4111-1111-1111-1111é @é😀 4111111111111111", "1" * 30_000, "1 " * 20_000,
    "+" * 1000 + "1 2 3 4 5 6 7 8 9 0", "aab@cc.dd aab@cc.dd b@cc.dd cc.dd 😀 b@cc.dd", "", None,
]


def test_base_spans(spark):
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    for r in pii.find_pii(docs).collect():
        want = base(TEXTS[r["doc_id"]])
        assert r["spans"] == want
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [kinds[k] for k in pii.KINDS[:4]]


def corpus():
    rows = []
    for i in range(6):
        rows.append((i, f"Mail jo@x.org about falcon number{i} the report.\nPlain line {i} the end", "en", "s"))
    for i in range(6, 60):
        rows.append((i, f"the report of day {i}\nother words about nothing", "en", "s"))
    rows += [(60, rows[0][1], "en", "s"), (61, "Mail solo@y.org about badger", "en", "s")]
    return rows


def brute(rows, support=pii.SUPPORT, least=pii.DISCLOSURE):
    lines = [line for _, t, _, _ in rows for line in t.split("\n")]
    words = lambda line: {x.lower() for x in re.findall(r"[^\W\d_]{3,}", line)}
    seen = Counter(x for line in lines for x in words(line))
    contexts = defaultdict(set)
    for line in lines:
        for m in EMAIL.finditer(line):
            contexts[m[0].lower()].add(line)
    out = set()
    for e, held in contexts.items():
        both = Counter(x for line in held for x in words(line))
        for t, n in both.items():
            if len(held) >= support and n >= support and len(lines) > len(held):
                pmi = math.log2(n * len(lines) / (len(held) * seen[t]))
                if pmi / math.log2(len(lines) / len(held)) >= least:
                    out.add((e, t))
    return out


def test_disclosing_terms_equal_brute_force(spark):
    docs = make(spark, corpus())
    found = pii.disclosing_terms(docs, pii.base_spans(docs)).collect()
    assert {(r["entity"].split(":", 1)[1], r["term"]) for r in found} == brute(corpus())
    assert ("jo@x.org", "falcon") in brute(corpus()) and ("jo@x.org", "the") not in brute(corpus())


def test_terms_join_the_spans_and_are_removed(spark):
    docs = make(spark, corpus())
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    text = corpus()[0][1]
    at = text.index("falcon")
    assert f"term:{at}:{at + 6}" in found[0]["spans"] and found[0]["spans"] == found[60]["spans"]
    assert found[61]["n_term"] == 0 and found[10]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "falcon" not in clean[0] and clean[10] == corpus()[10][1]
    assert len(clean) == len(corpus())


def test_entities_on_one_line_are_scored(spark):
    docs = make(spark, [(0, "Mail solo@y.org about badger", "en", "s")] + [(i, f"the report about day {i}", "en", "s") for i in range(1, 4000)])
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert found[0]["spans"] == "term:0:4,email:5:15,term:22:28"
    assert not any(found[i]["n_term"] for i in range(1, 4000))


@pytest.mark.parametrize("copies", [1, 50])
def test_copies_of_texts_change_no_disclosure(spark, copies):
    rows = [(i, f"Mail jo@x.org about falcon number{i}", "en", "s") for i in range(3)] * copies
    docs = make(spark, rows + [(i, f"the report about day {i}", "en", "s") for i in range(3, 300)])
    found = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(docs, pii.base_spans(docs)).collect()}
    assert found["falcon"] == pytest.approx(1) and "about" not in found


def test_terms_are_found_on_other_lines_of_the_document(spark):
    text = "Of falcons a\n\nno Falcon 😀 falcon\n" + corpus()[0][1] + "\nfalcon"
    docs = make(spark, [(99, text, "en", "s"), *corpus()[1:]] + [(i, f"the report of day {i}", "en", "s") for i in range(100, 2100)])
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    at = [m.start() for m in re.finditer(r"(?i)\bfalcon\b", text)]
    assert len(at) == 4 and {f"term:{a}:{a + 6}" for a in at} <= set(found[99]["spans"].split(","))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert re.findall(r"(?i)falcons?", clean[99]) == ["falcons"]


def test_odd_rows(spark, odd_docs, no_docs):
    found = pii.find_pii(odd_docs).collect()
    assert sorted(r["base_sha256"] for r in found) == sorted(hashlib.sha256(base(r["text"]).encode()).hexdigest() for r in odd_docs.collect())
    assert pii.sanitise(odd_docs).count() == odd_docs.count()
    assert pii.find_pii(no_docs).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = pii.find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("number, ok", [("4111111111111111", True), ("4111111111111112", False), ("411111111116", None)])
def test_luhn(spark, number, ok):
    got = base(number)
    assert ok is None or bool(got) == ok


def test_a_long_line_with_many_values(spark):
    line = " ".join(f"user{i}@host{i}.org 10.0.{i % 250}.{i % 200} word{'abcdefghij'[i % 10]}" for i in range(1500))
    found = pii.find_pii(make(spark, [(1, line, "en", "s"), (2, "x" * 500_000, "en", "s")])).collect()
    assert {r["doc_id"]: (r["n_email"], r["n_ip"]) for r in found} == {1: (1500, 1500), 2: (0, 0)}


def test_a_very_long_line_with_an_entity_is_read_once(spark):
    """Terms on one line of very many words: their places are right, and ten times the words cost about ten times the work."""
    import time

    rng = random.Random(6)

    def run(n):
        stock = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n // 8)]
        line = " ".join(rng.choice(stock) for _ in range(n)) + " zz zebracorn mail.me@example.org 12 zebracorn"
        rows = [(1, line, "en", "s"), *[(i, f"other words {i} stand here", "en", "s") for i in range(2, 3000)]]
        began = time.perf_counter()
        found = {r["doc_id"]: r["spans"] for r in pii.find_pii(make(spark, rows)).where("n_email > 0").collect()}
        return line, found[1], time.perf_counter() - began

    run(1000)
    line, spans, small = run(16_000)
    terms = [tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x.startswith("term")]
    assert [line[a:b] for a, b in terms].count("zebracorn") == 2
    assert all((a == 0 or not line[a - 1].isalpha()) and line[a:b].isalpha() and (b == len(line) or not line[b].isalpha()) for a, b in terms)
    _, _, large = run(160_000)
    assert large < 25 * max(small, 2.0)
