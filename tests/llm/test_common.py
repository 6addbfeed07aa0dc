"""Where tables between steps are kept."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tallygrove.llm.common import discard_stored, shared_dir, stored


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def _session(master, **conf):
    return SimpleNamespace(conf=_Conf(conf), sparkContext=SimpleNamespace(master=master, applicationId="app-of-this-test"))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session("spark://host:7077"))
    assert shared_dir(_session("spark://host:7077", **{"spark.checkpoint.dir": "/shared"})) == "/shared"
    assert shared_dir(_session("local[2]")) == shared_dir(_session("local[2]"))


def test_tables_are_kept_until_they_are_discarded(spark, tmp_path, monkeypatch):
    import tallygrove.llm.common as C

    monkeypatch.setattr(C, "shared_dir", lambda _: str(tmp_path))
    table = stored(spark.range(5), "five")
    assert sorted(r[0] for r in table.collect()) == list(range(5))
    assert len(list(tmp_path.glob("tables-*/five-*"))) == 1
    discard_stored(spark)
    assert not list(tmp_path.iterdir())
