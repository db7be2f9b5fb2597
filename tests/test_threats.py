import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from maskwell.functions.threats import malicious_content
from maskwell.operators import threat_scan as T
from oracles.queries import THREATS

PIECES = [
    "DROP TABLE", "drop\x1cdatabase", "truncate  table", "delete from tä where 1 = 1", "INSERT INTO",
    "SELECT *", "select\n*", "UNION SELECT", "FROM", "xp_cmdshell", "exec (", "execute(", "; alter",
    ";\n drop", "<script", "<script a>", "</script>", "<ſcript>x</script>", "javascript :", "onload =", "onerror=", "onclıck=",
    "<iframe", "<iframe x>", ">", "document.cookie", "window.location", "rm -rf", "rmdir /s", "wget http://",
    "curl  https://", "bash -c", "ſh -c", "powershell -c", "__import__('os')", "__import__ ( \"os\"", "subprocess.call",
    "os.system", "eval (", "/etc/passwd", "/ETC/shadow", "../../", "..\\", "%2e%2e%2f", "%2E%2e%2F", "K", "\n", "a", "é",
]


def brute(text, kept):
    details = {}
    for name, patterns in THREATS.items():
        hits = []
        for pattern, _ in patterns:
            hits += re.findall(pattern, text, re.IGNORECASE | re.DOTALL)[:kept]
        if hits:
            details[name] = hits
    return details


@pytest.mark.parametrize("kept", [None, 3])
def test_random_texts(spark, kept):
    rng = random.Random(1)
    texts = [
        "".join(rng.choice(PIECES) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 25)))
        for _ in range(3000)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    fired = set()
    for r in df.select("text", malicious_content(F.col("text"), F.lit("txt"), kept).alias("m")).collect():
        want = brute(r.text, kept)
        fired |= set(want)
        assert r.m.details == want, repr(r.text)
        assert r.m.threats == list(want) and r.m.safe == (not want)
    assert fired == set(THREATS)


def test_security_scan(spark):
    bad = b"\xff<script>x</script>\xc3"
    files = [("a.txt", b"clean"), ("b.PNG", bad), ("c", bad), ("d.html", b"")]
    df = spark.createDataFrame(files, "filename string, content binary")
    as_of = F.lit("2024-01-31T00:00:00Z")
    got = {r.filename: r.security for r in T.security_scan(df, as_of).collect()}
    for name, content in files:
        s = got[name]
        assert s.file_size == len(content)
        assert s.hashes.md5 == hashlib.md5(content).hexdigest()
        assert s.hashes.sha1 == hashlib.sha1(content).hexdigest()
        assert s.hashes.sha256 == hashlib.sha256(content).hexdigest()
        assert s.scanned_at == "2024-01-31T00:00:00Z"
    assert [got[n].safe for n, _ in files] == [True, True, False, True]
    assert got["c"].malicious_content.details == {"xss": ["<script>x</script>"]}
    safe, blocked = T.split_by_verdict(T.security_scan(df, as_of))
    assert (safe.count(), blocked.count()) == (3, 1)
