"""Secret scans: the patterns against brute force, the lexer on planted syntax, odd rows."""

import hashlib
import re
import time

import pytest

from tidemark.llm.secret_scan import KINDS, op13_secret_scan, scan_secrets, scan_text

BASE = {
    "assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def brute(text):
    out = []
    for kind, (pattern, group, least) in BASE.items():
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        if kind == "assign":  # case is free in the word alone
            pattern = pattern.replace("(password", "((?i:password").replace("key)", "key))", 1)
            flags = re.ASCII
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


TEXTS = [
    None, "", "token = abc", 'API_KEY: "abcdefgh"', "secret: token: abcdefghij", "TOKEN==abcdefg", "x" * 100_000,
    "AKIA" + "A" * 12, "AKIA" + "A" * 11, "AKIAAKIA0000000Z", "f" * 31, "f" * 32 + "g" + "0" * 40, "apikey='ABCD+/_.=-'",
    "passwd" + " " * 5000 + "= 12345678", "tokentoken:tokentoken", 'Password"= "aaaaaaaa"é' * 3, "ſecret=abcdefghijk",
]


@pytest.mark.parametrize("text", TEXTS[1:])
def test_base_spans_equal_brute_force(text):
    got = [(s["start"], s["end"], s["kind"]) for s in scan_text(text) if s["kind"] != "literal"]
    assert got == brute(text)


@pytest.mark.parametrize(
    "source, secrets",
    [
        ("a = 'Zq81-kkLp'\nb = a + \"xx9\"\ndb_pwd = b", ["Zq81-kkLp", "xx9"]),
        ('const dbPass: string = "pa$$w0rd!x"', ["pa$$w0rd!x"]),
        ('<add key="DbPassword" value="s3cr3t!!x"/>', ["s3cr3t!!x"]),
        ("<passphrase>correct horse 99 Battery</passphrase>", ["correct horse 99 Battery"]),
        ("run --auth-token Xy12!zz99q now", ["Xy12!zz99q"]),
        ("http://u:p4ss!word@host/", ["p4ss!word"]),
        ("pwd: ${LATER}\nLATER=Qw3rty!uiop", ["Qw3rty!uiop"]),
        ('cfg["db_credential"] = "Ab3$xyzw"', ["Ab3$xyzw"]),
        ("x = y\ny = x\nmy_pwd = x", []),
        ("pwd_length = 12345678", []),
        ('pwd = get("abcdef123456")', []),
        ('pwd = "your_password_1"', []),
        ("credential: please", []),
        ("The token was late: nobody = came.", []),
    ],
)
def test_literals_by_target_names(source, secrets):
    assert [source[s["start"] : s["end"]] for s in scan_text(source) if s["kind"] == "literal"] == secrets


@pytest.mark.parametrize(
    "unit", ['"', "a", "a = ", "a = a + a\n", "://a:", "<a>", "'''", '\\"', "${", "--", "a:", "a=", "password", "token ", 'k="a" + ', "a:=", "(", "k='v'\n"]
)
def test_repeated_text_is_read_in_linear_time(unit):
    scan_text(unit * 100)
    start = time.perf_counter()
    scan_text(unit * 10_000)
    assert time.perf_counter() - start < 3


def test_rows(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x"), (3, TEXTS[3], "x")]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for row, (doc, text, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        assert row.doc_id == doc
        base = [(s.start, s.end, s.kind) for s in row.spans if s.kind != "literal"]
        assert base == brute(text or "")
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, "db_pwd = 'Zq81-kkLp'"])]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: t or "" for i, t, _ in rows}
    got = op13_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.n_hex for r in got) == 2
    for row in got:
        want = brute(texts[row.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == x for *_, k in want) for x in KINDS[:3]]
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))
