"""All spans of the secret scan against a plain version, and texts that consist of matches alone."""

import hashlib
import re
import time

import numpy as np
from test_llm import base_spans, entropy

from lumenlake.llm import secrets


def all_spans(text):
    order = {k: n for n, k in enumerate(secrets.KINDS)}
    found = [(int(s), order[k], int(e), k) for k, s, e in (x.split(":") for x in base_spans(text).split(",") if x)]
    for m in re.finditer(secrets.CANDIDATE, text):
        run = m[0]
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or re.search(secrets.ALLOWED, run):
            continue
        kind = "entropy_hex" if re.fullmatch("[0-9A-Fa-f]+", run) else "entropy_mixed"
        if entropy(run.lower() if kind == "entropy_hex" else run) >= secrets.ENTROPY[kind] - 1e-12:
            found.append((m.start(), order[kind], m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_spans_of_a_plain_version(spark, sf_dir):
    random = np.random.default_rng(6)
    parts = ["9Zq8Kx7Wm3Vb2NpL0tRy5", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "DEADBEEF0123", "aaaaaaaaaa1", "/", "+", "-", " ", "é", "token=", "AKIA", "ABCDEFGHIJKL12345", "example", "x7", "\U0001f600", "_", "."]
    made = [(n, "".join(random.choice(parts, random.integers(0, 9)))) for n in range(600)]
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (made, given):
        got = {r["doc_id"]: r["spans"] for r in secrets.findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: all_spans(t or "") for i, t in rows}


def test_a_long_text_of_matches_alone(spark):
    took = {}
    for n in (500, 8000):
        text = " ".join(hashlib.sha1(str(k).encode()).hexdigest() for k in range(n))
        found = secrets.findings(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        began = time.perf_counter()
        row = found.first()
        took[n] = time.perf_counter() - began
        assert row["n_hex"] == n
        assert [int(x.split(":")[1]) for x in row["spans"].split(",") if x.startswith("hex")] == [41 * k for k in range(n)]
    assert took[8000] < 24 * max(took[500], 1)
