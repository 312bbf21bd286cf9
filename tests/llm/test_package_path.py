"""Workers of a local session find the package, also for frames that the caller made, wherever the driver runs."""

import os
import subprocess
import sys

import pytest

IMPORT = "from normslice.llm import warc"
SESSION = "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate()"


@pytest.mark.parametrize("lines", [[IMPORT, SESSION], [SESSION, IMPORT]], ids=["import first", "session first"])
def test_own_frames_in_a_fresh_session(lines, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    body = ["import sys", f"sys.path.insert(0, {root!r})", "from pyspark.sql import SparkSession", *lines]
    body += ["pages = spark.createDataFrame([(1, 'http://a.b/c', '<p>'), (2, None, None)], 'page_id long, url string, html string')", "print('rows', warc.archive_and_index(pages).count())"]
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", "\n".join(body)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180, check=False)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
