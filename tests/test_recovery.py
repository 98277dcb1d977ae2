"""Lost tasks are recomputed from lineage with identical results (every first attempt of the
k-NN and lexical block tasks fails; the retried attempts must give the failure-free answer)."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF01


def test_failed_attempts_recompute_identically():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tests", "recovery_job.py"), ROOT, SF01],
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    res = json.loads(out.stdout.strip().splitlines()[-1])
    for name, (rows, same) in res.items():
        assert rows > 0 and same, (name, res)
