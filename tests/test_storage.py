from pathlib import Path
from types import SimpleNamespace

import pytest

from graphloom import storage


def test_steps_leave_only_their_result(spark):
    def make():
        inner = storage.materialise(spark.range(10), "on-the-way-in")
        return storage.materialise(inner.filter("id > 4"), "on-the-way-in")

    before = len(storage._written)
    out = storage.materialise_step(make, "outer")
    assert out.count() == 5 and len(storage._written) == before + 1
    folder = Path(storage.shared_dir(spark).removeprefix("file://")) / "tables"
    assert {p.name for p in folder.iterdir()} >= {list(storage._written)[-1].rsplit("/", 1)[1]}
    assert not any(p.name.startswith("on-the-way-in") for p in folder.iterdir())


def test_the_folder_that_the_session_names():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "file:///shared/named/" if key == storage.KEY else default))
    assert storage.fresh_path(session, "x").startswith("file:///shared/named/tables/x-")
    storage._written.popitem()


def test_a_cluster_without_a_named_folder_is_an_error():
    nothing = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, applicationId="none", master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(session)


def test_an_iteration_keeps_its_last_table(spark):
    rolling, df = storage.Rolling("roll"), spark.range(5)
    for _ in range(3):
        df = rolling.keep(df.selectExpr("id + 1 AS id"))
    df = rolling.step(lambda: storage.materialise(df.selectExpr("id * 2 AS id"), "on-the-way"))
    assert sorted(r.id for r in df.collect()) == [6, 8, 10, 12, 14]
    assert sum("/roll-" in p for p in storage._written) == 1 and not any("/on-the-way" in p for p in storage._written)


def test_a_step_leaves_the_tables_of_other_threads_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as pool:
        out = storage.materialise_step(lambda: (pool.submit(storage.materialise, spark.range(3), "elsewhere").result(), spark.range(4))[1], "mine")
    assert out.count() == 4 and any("/elsewhere-" in p for p in storage._written)
