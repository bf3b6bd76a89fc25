"""The operators on workers that have no copy of the package: the functions travel with their tasks."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
from caseloom.llm import bpe, kn_quality, langid, simhash, suffix_dedup, warc
def missing(batches):
    try:
        import caseloom
        raise AssertionError("the worker has the package")
    except ModuleNotFoundError:
        yield from batches
text = "the river and the stone of the night " * 30
docs = spark.createDataFrame([(i, text if i < 3 else text[i:] + str(i), "en") for i in range(12)], "doc_id long, text string, lang string")
assert docs.mapInArrow(missing, docs.schema).count() == 12
labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
pages = spark.createDataFrame([(1, "http://a", "x"), (1, "http://a", "x"), (2, "http://b", "x")], "page_id long, url string, html string")
assert suffix_dedup.suffix_dedup(docs, 400).filter("n_removed > 0").count() > 0
assert kn_quality.classify(docs, labels).count() == 12
assert langid.identify(docs, langid.dictionaries(docs)).count() == 12
assert simhash.keep_one(docs).count() < 12
assert bpe.digests(docs).count() == 12
assert warc.round_trip(pages).count() == 3
print("all done")
"""


def test_operators_need_no_package_on_workers(tmp_path):
    (tmp_path / "job.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_SUBMIT_ARGS",)}
    env["PYTHONPATH"] = os.pathsep.join(p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != REPO)
    done = subprocess.run([sys.executable, "job.py", REPO, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in done.stdout, done.stderr[-3000:]
