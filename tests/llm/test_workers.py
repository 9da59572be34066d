"""Tasks on workers that do not have the package: what is sent to them must name none of its modules."""

import importlib
import pkgutil
import subprocess
import sys
import textwrap

import pytest

import gavelwork.llm
from tests.conftest import ROOT, SF

NAMES = ["op3_quality", "op5_near_vectors", "op7_exact_dedup", "op8_language", "op9_simhash", "op11_merkle", "op12_centroids"]


@pytest.mark.parametrize("name", [m.name for m in pkgutil.iter_modules(gavelwork.llm.__path__)])
def test_modules_travel_by_value(name):
    from pyspark import cloudpickle

    module = importlib.import_module(f"gavelwork.llm.{name}")
    for value in vars(module).values():
        if getattr(value, "__module__", None) == module.__name__ and callable(value):
            assert f"gavelwork.llm.{name}\n".encode() not in cloudpickle.dumps(value)


def test_queries_run_where_only_the_driver_has_the_package():
    """The driver finds the package through its own path alone; workers start without it."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from gavelwork.session import get_session
        spark = get_session("bare", "local[4]", **{{"spark.sql.shuffle.partitions": "4"}})
        spark.sparkContext.setLogLevel("OFF")
        def absent(_):
            import importlib.util
            return [importlib.util.find_spec("gavelwork") is None]
        assert all(spark.sparkContext.parallelize(range(4), 4).mapPartitions(absent).collect())
        import __spark_entry__ as contract
        for name in {NAMES!r}:
            assert contract.queries()[name](spark, {SF!r}).count() > 0, name
        print("all", "ran")
    """)
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900, cwd="/tmp", env=env)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_scratch_tables_go_with_their_own_block(spark):
    import os

    from gavelwork.llm import common

    with common.scratch(spark):
        outer = common.saved(spark.range(3), "outer")
        with common.scratch(spark):
            inner, kept = common.saved(spark.range(4), "inner"), common.saved(spark.range(5), "kept", stays=True)
        gone, there = inner.inputFiles(), outer.inputFiles() + kept.inputFiles()
        assert not any(os.path.exists(f.removeprefix("file://")) for f in gone)
        assert all(os.path.exists(f.removeprefix("file://")) for f in there)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in outer.inputFiles())
    assert kept.count() == 5


def test_worker_keeps_nothing_of_what_a_task_freed():
    """Anonymous memory of a process after a task that held 300 MB of Arrow arrays and of text, and freed them."""
    code = textwrap.dedent(f"""
        import re, sys
        sys.path.insert(0, {ROOT!r})
        import pyarrow as pa
        from gavelwork.llm.common import freeing
        def anon():
            return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
        def work(batches):
            for n in batches:
                arrays = [pa.array([str(i) * 100] * 2000) for i in range(n)]
                texts = [bytes([i % 250]) * 50_000 + b"x" * i for i in range(20 * n)]
                most.append(anon())
                keep.append(texts[-1])  # stands at the end of what is freed
                yield sum(map(len, arrays))
        most, keep = [], []
        start = anon()
        assert list(freeing(work)([300])) == [600_000]
        print("held", most[0] - start, "kept", anon() - start)
    """)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    _, held, _, kept = done.stdout.split() if done.stdout else pytest.fail(done.stderr[-2000:])
    assert int(held) > 200 and int(kept) < 30


def test_packing_cuts_in_small_batches(spark, monkeypatch):
    from gavelwork.llm import packing
    from tests.llm.helpers import TOKENIZER, hard

    name, saved, seen = "spark.sql.execution.arrow.maxBytesPerBatch", packing.saved, []
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "saved", lambda rows, *args: seen.append(spark.conf.get(name)) or saved(rows, *args))
    assert packing.packed_digest(hard(spark), TOKENIZER).count() > 0
    assert seen == [str(packing.BATCH_BYTES)] and packing.BATCH_BYTES <= packing.words.STEP_BYTES and spark.conf.get(name) == before
