"""The pipeline and the entry with and without it."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


def test_run(spark, data):
    """On the given tables; ``test_queries`` holds every stage against brute force."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P
    from corvid.llm.common import table

    ids = {r["doc_id"] for r in table(spark, data, "documents").select("doc_id").collect()}
    got = [r["doc_id"] for r in P.run(spark, data).collect()]
    assert got and set(got) <= ids and [name for name, _ in P.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]


def test_the_entry_does_without(tmp_path):
    """Everything else imports where these folders and the pipeline are gone."""
    import shutil

    for name in ("corvid", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k[:2] == 'op' and k[2].isdigit() for k in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    n, ops, pipeline = out.stdout.split()
    assert int(n) > 80 and (ops, pipeline) == ("False", "False")
