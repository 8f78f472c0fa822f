"""Spec extraction (X1) in its default Unicode-boundary mode against an independent
Python ``re`` implementation of the same rules, over every sf0.001 document (the DuckDB
oracle covers the ASCII-boundary mode)."""

import os
import re

import pytest

from tessera.functions.text import BARRIER_WORDS, SPEC_PREFIXES
from tessera.operators.textjobs import extract_spec_column

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def brute(text):
    if not isinstance(text, str) or not text.strip():
        return ""
    guarded = re.sub(r"\b(" + "|".join(BARRIER_WORDS) + r")\b", lambda m: "___" + m.group(1) + "___", text)
    hits = [m.group(0) for m in re.finditer(r"\bP\d{4,6}\b", guarded, re.I)]
    fam = r"\b(?:" + "|".join(SPEC_PREFIXES) + r")\b[-\s]*[A-Za-z0-9-]*"
    hits += [m.group(0) for m in re.finditer(fam, guarded, re.I) if not m.group(0).endswith(("-", "_"))]
    out = []
    for h in hits:
        c = re.sub(r"\s+", "", h.upper())
        if c not in out:
            out.append(c)
    return ",".join(out)


def test_matches_python_regex(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["specs"] for r in extract_spec_column(docs, "text", "specs").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {k: brute(v) for k, v in texts.items()}
    diff = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not diff, list(diff.items())[:3]
    assert sum(1 for v in want.values() if v) > 0
