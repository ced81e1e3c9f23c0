import random
import re

import pytest
from pyspark.sql import functions as F

from docdelta.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda n: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(n[::-1])) % 10 == 0
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0])]


@pytest.mark.parametrize("seed", range(300))
def test_base_spans_equal_the_plain_patterns(seed):
    r = random.Random(seed)
    parts = ["@", ".", "-", " ", "+", "(", ")", "a", "Z9", "é", "1", "12", "255", "256", "0255", "4111111111111111", "4111 1111 1111 1111", "+49 30 1234567", "x.y@z.com", "_", "%", "\n", "1.2.3.4"]
    text = "".join(r.choice(parts) for _ in range(60))
    assert pii.base_spans(text) == brute(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88370400440532013000")


def test_scored_kinds_are_added_and_need_their_context():
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.spans(t)]
    assert kinds("IBAN DE89370400440532013000.") == [("iban", "DE89370400440532013000")]
    assert kinds("code DE88370400440532013000.") == []
    assert kinds("SSN: 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []


def test_ibans_end_before_the_words_behind_them():
    ibans = lambda t: [t[a:b] for k, a, b, _ in pii.spans(t) if k == "iban"]
    assert ibans("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF") == ["DE89 3704 0044 0532 0130 00"]
    assert ibans("IBAN GB82 WEST 1234 5698 7654 32 I paid") == ["GB82 WEST 1234 5698 7654 32"]
    assert ibans("NO93 8601 1117 947 DE89 3704 0044 0532 0130 00 UND SO") == ["NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00"]
    assert ibans("AB12 CD34 BE68 5390 0754 7034 OK") == ["BE68 5390 0754 7034"]
    assert ibans("IBAN DE89370400440532013000BIC") == ibans("xDE89370400440532013000") == []
    assert pii.spans("AB12" * 50_000) == pii.spans("AB12 " * 20_000) == []


def test_long_runs_are_linear():
    assert pii.spans("1" * 200_000) == [] and pii.spans("a" * 200_000) == [] and pii.spans("a@" * 50_000) == []


def test_odd_rows(odd_docs, no_docs):
    assert odd_docs.count() == pii.find_pii(odd_docs).where(F.size("found") == 0).count()
    assert pii.find_pii(no_docs).count() == 0


def test_secrets_need_a_context_word():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [(k, a, b) for k, a, b, _ in pii.spans(f'token = "{key}" x')] == [("secret", 9, 49)]
    assert pii.spans(f"commit {key}") == [] and pii.spans("the token donaudampfschifffahrtsgesellschaft") == []
    assert [k for k, *_ in pii.spans("Password: Zx9-kk28_LLq0pP12abc==")] == ["secret"]


def test_registered_columns_equal_the_plain_patterns(spark):
    import hashlib

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.BASE]
        line = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        every = [(k, a, b) for k, a, b, _ in pii.spans(texts[r.doc_id])]
        assert r.spans == line(every) and [x for x in every if x[0] in pii.BASE] == want
