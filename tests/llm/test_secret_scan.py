import hashlib
import random
import re

import pytest

from tallyloom.llm import secret_scan
from tests.oracle import compare

DOCS = "doc_id long, text string, secrets string, key string, trigram string"
HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "Q7" * 8
ODD = [
    None, "", "   \n", "word", 'api_key="short"', 'API_KEY = "longenough1"', "passwd=abcdefgh password:abcdefgh", "token==abcdefgh", "tokens: abcdefgh", "paſsword=abcdefgh", HEX, HEX[:-1], HEX * 3 + "g" + HEX,
    KEY, KEY[:15], KEY.lower(), "é\U0001f600 " + KEY + " secret=" + HEX, "ghp_" + "a1" * 18, "xoxb-1234567890-abc", "https://user:pass@host", "-----BEGIN RSA PRIVATE KEY-----", "secret=\nabcdefgh",
    "x" * 50_000 + " secret=abcdefgh " + "y" * 50_000, "secret=abcdefgh " * 5_000, "deadbeef" * 20_000,
]


def brute(text):
    """All spans by plain Python, every rule over the whole text; letters in either case are A-Z only."""
    spans = []
    for place, r in enumerate(secret_scan.BASE + secret_scan.MORE):
        spans += [(m.start(), place, m.end(), r.kind) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least]
    return [(k, s, e) for s, _, e, k in sorted(spans)]


def test_scan_matches_brute_force(spark):
    rng = random.Random(13)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "api-key", ":", "=", " ", '"', "'", "AKIA", "akia", "ABCDEFGHIJKLMNOP", "abcdef0123", "x", "\n", "gho_", "a" * 40, "://", "@", "eyJabcdefgh.", "é", "\U0001f511"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "old", "k", "t") for i, t in enumerate(texts)], DOCS)
    out = secret_scan.scan_secrets(rows)
    assert out.columns == ["doc_id", "text", "key", "trigram", "secrets"]
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in out.collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(None, "token=abcdefgh", "", "", ""), (None, "token=abcdefgh", "", "", ""), (None, "clean", "", "", ""), (1, "token=abcdefgh", "", "", ""), (1, "clean", "", "", ""), (1, "clean", "", "", "")]
    out = secret_scan.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.text, len(r.secrets)) for r in out) == [(-1, "clean", 0), (-1, "token=abcdefgh", 1), (-1, "token=abcdefgh", 1), (1, "clean", 0), (1, "clean", 0), (1, "token=abcdefgh", 1)]
    assert secret_scan.scan_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_that_hold_all_trigrams_of_a_clause_are_candidates(spark):
    texts = spark.createDataFrame([(1, "my PASSWORD here"), (2, "pass the sword"), (3, "apikey"), (4, "akiz kia")], "key long, text string")
    queries = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.BASE if r.kind != "hex"}
    index = secret_scan.postings(texts, {t for q in queries.values() for c in q for t in c})
    assert {(r.trigram, r.key) for r in index.filter("key > 2").collect()} >= {("api", 3), ("kia", 4)}
    assert {r.key: sorted(r.kinds) for r in secret_scan.candidates(index, queries).collect()} == {1: ["assign"], 3: ["assign"], 4: ["access"]}


@pytest.mark.parametrize("pattern,want", [
    ("abc", [["abc"]]), ("ABCD", [["abc", "bcd"]]), ("ab", [[]]), ("a.c", [[]]), ("abc|def", [["abc"], ["def"]]), ("abc|d", [[]]), ("(abc)?def", [["def"]]), ("(?:abc)+x", [["abc"]]), ("ab[cd]e", [["abc", "bce"], ["abd", "bde"]]),
    ("[0-9a-f]{32,}+", [[]]), ("xyz.*abc", [["abc", "xyz"]]), ("^foo(?=bar)baz$", [["baz", "foo", "oba", "oob"]]), ("a{3}", [["aaa"]]), ("(ab){2}", [["aba", "bab"]]), ("éabc", [["abc"]]),
])
def test_trigram_queries(pattern, want):
    assert sorted(sorted(c) for c in secret_scan.trigram_query(pattern)) == sorted(want)


def test_each_match_meets_its_query():
    """Random strings over a small alphabet: no match may be missed by the query of its pattern."""
    rng = random.Random(4)
    patterns = [r"a[bc]?d(?:ab|c+)a", r"(?:abc|bcd|[a-d]{2})a{2,}b", r"ab(?:c|(?:da)*)bca", r"(?i:ABCa|d?abd)+c", r"a(?:b|c)(?:a|d)(?:b|c)(?:a|d)(?:b|c)(?:a|d)(?:b|c)d", r"(?:ab|cd)?+(?:a|bc){2}d"]
    hits = 0
    for p in patterns:
        query = secret_scan.trigram_query(p)
        for _ in range(6000):
            m = re.search(p, "".join(rng.choice("abcdABCD") if rng.random() < 0.1 else rng.choice("abcd") for _ in range(14)))
            if m:
                hits += 1
                low = m[0].lower()
                assert any(all(t in low for t in c) for c in query), (p, m[0], query)
    assert hits > 500


def test_query_digests_and_sql_twin(spark, data):
    compare(spark, data, secret_scan.op13_secrets, secret_scan.OP13_SQL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for row in secret_scan.op13_secrets(spark, data).collect():
        base = [s for s in brute(texts[row.doc_id]) if s[0] in ("assign", "access", "hex")]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
