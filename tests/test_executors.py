"""Tasks must not depend on the folder in which the job was started."""

import os
import pathlib
import subprocess
import sys

from workbook_files import workbook_bytes

ROOT = str(pathlib.Path(__file__).parent.parent)
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from gateflow.session import local_session
from gateflow.sources.workbooks import NEW_EXPORT, ingest_workbooks
spark = local_session("2", "elsewhere")
print("rows", ingest_workbooks(spark, {folder!r}, NEW_EXPORT).count())
"""


def test_workbooks_are_decoded_without_the_package_on_the_workers(tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes([["Name", "When"], ["g", 1], ["h", 2]]))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, folder=str(tmp_path))],
        cwd=tmp_path,
        env=environment,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "rows 2" in done.stdout, done.stderr[-2000:]
