"""Findings of round 4."""

import os
import subprocess
import sys

from conftest import ROOT


def test_all_test_files_are_collected_in_one_run():
    """Files of one name in two folders; the second had not been collected."""
    ran = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=ROOT, env=os.environ | {"PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True, timeout=90)
    assert ran.returncode == 0, ran.stdout[-2000:]
    assert "tests/llm/test_findings_r03.py::" in ran.stdout and "tests/test_findings_r03.py::" in ran.stdout
