"""Saved models are whole or not there."""

import os

import pytest

from topictone.operators.hashed import fit_hashed
from topictone.operators.nb import NBModel, fit_nb
from topictone.plans.training import load_model, save_model
from topictone.streaming.versions import VersionedTable

ROWS = [("good fine day", 1), ("bad poor night", 0)] * 5


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(ROWS, "text string, label int")


def _stop(*_, **__):
    raise OSError("stopped")


@pytest.mark.parametrize("kind", ["nb", "hashed"])
def test_a_save_that_stops_leaves_no_model_or_the_one_before(spark, train, tmp_dir, monkeypatch, kind):
    first = fit_nb(train, "text", "label")
    second = first if kind == "nb" else fit_hashed(train, train, "text", "label", num_features=64, reg_grid=(0.1,), max_iter=3).model
    path = f"{tmp_dir}/m"
    with pytest.raises(FileNotFoundError, match="no whole model"):
        load_model(spark, path)
    with monkeypatch.context() as m:   # between the files and the mark
        m.setattr(VersionedTable, "commit", _stop)
        with pytest.raises(OSError, match="stopped"):
            save_model(second, path)
    assert os.path.isdir(f"{path}/version-0")
    with pytest.raises(FileNotFoundError, match="no whole model"):
        load_model(spark, path)
    save_model(first, path)   # nothing is saved there, so nothing is overwritten
    want = first.score(train, "text").distinct().collect()
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", _stop)
        with pytest.raises(OSError, match="stopped"):
            save_model(second, path, overwrite=True)
    assert sorted(load_model(spark, path).score(train, "text").distinct().collect()) == sorted(want)
    with pytest.raises(FileExistsError):
        save_model(second, path)
    save_model(second, path, overwrite=True)
    back = load_model(spark, path)
    assert type(back) is type(second) and isinstance(back, NBModel) == (kind == "nb")
    assert VersionedTable(spark, path).versions() == [1] and not os.path.exists(f"{path}/version-0")
    if kind == "hashed":   # the first model's files, which "nb" scores from, are gone
        assert sorted(back.score(train, "text").distinct().collect()) == sorted(second.score(train, "text").distinct().collect())
