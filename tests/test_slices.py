"""Pairs of cases summed up slice by slice: the same rows as in one piece, and nothing but the result stays on disk."""

import os

import pytest

from mailspark.operators import links
from mailspark.plans import registry
from mailspark.sources import shared
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["relate_cases", "case_clusters", "artefact_intersect"])
def test_slices_equal_the_twin(spark, monkeypatch, name):
    monkeypatch.setattr(links, "SLICE_LINKS", 1000)
    counts, keep, paths, place = [], links.by_slice, [], shared.new_path
    monkeypatch.setattr(links, "by_slice", lambda df, label, slices, work: counts.append(slices) or keep(df, label, slices, work))
    monkeypatch.setattr(shared, "new_path", lambda s, label: paths.append(place(s, label)) or paths[-1])
    same(spark, registry.queries()[name], registry.oracle_sql()[name], FOLDER)
    assert counts[0] > 1
    assert sum(f.endswith(".parquet") for p in paths[:-1] for _, _, names in os.walk(p.removeprefix("file://")) for f in names) == 0
