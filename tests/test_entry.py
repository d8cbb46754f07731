"""The entry point without its optional part."""

import subprocess
import sys

import pytest
from conftest import ROOT

HIDE = """
import sys
for name in {hidden}:
    sys.modules[name] = None
import __spark_entry__ as entry
print(len(entry.queries()), sorted(n for n in entry.queries() if n == "pipeline" or n.startswith("op")))
"""


@pytest.mark.parametrize("hidden", [
    ["turnledger.llm", "turnledger.llm.queries", "corpus_pipeline"],
    # With the corpus folders gone the pipeline file may still be there.
    ["turnledger.llm", "turnledger.llm.queries"],
])
def test_entry_without_the_corpus_operators(hidden):
    code = HIDE.format(hidden=hidden)
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    count, names = run.stdout.split(maxsplit=1)
    assert int(count) > 100 and names.strip() == "[]"
