"""Archives by member and arrays by rows, several files at once."""

import zipfile

import numpy as np
import pytest

from cohortspark.sources import archives, tables


def test_members_are_partitions(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(5):
                z.writestr(f"d/m{m}.CSV", "k,v\n" + "".join(f"{a * 100 + m},{'x' if i else ''}\n" for i in range(3)))
            z.writestr("note.txt", "k,v\n1,2\n")
    found = archives.members(spark, f"{tmp_path}/*.zip", ".csv")
    assert found.count() == 10 and found.rdd.getNumPartitions() == 10
    rows = tables.zipped_csv(spark, str(tmp_path), "k int, v string, gone double").collect()
    assert sorted((r.k, r.v or "") for r in rows) == sorted((a * 100 + m, x) for a in range(2) for m in range(5) for x in ("", "x", "x"))
    assert all(r.gone is None for r in rows)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("order", ["C", "F"])
def test_arrays_by_rows(spark, tmp_path, save, order):
    """Stored or compressed, rows or columns first: ranges of rows give what the whole arrays give."""
    rng = np.random.default_rng(1)
    a = {"x": rng.integers(0, 2, (23, 3, 4)).astype(float), **{k: rng.normal(size=(23, 4)) for k in ("yf", "mu0", "mu1")}, "t": rng.integers(0, 2, (23, 4))}
    path = str(tmp_path / "s.npz")
    save(path, **{k: np.asarray(v, order=order) for k, v in a.items()})
    with archives.Arrays(path) as file:
        assert file.shape("x") == (23, 3, 4)
        assert all(np.array_equal(file.rows(k, lo, hi), v[lo:hi]) for k, v in a.items() for lo, hi in ((0, 23), (5, 6), (20, 23), (7, 7)))
    key = lambda df: sorted(map(tuple, df.collect()))
    for replication in (None, 2):
        whole = tables.tensors(spark, {"all": a}, ("p", "q"), ("b",), replication)
        assert key(tables.npz(spark, {"all": path}, ("p", "q"), ("b",), replication, rows=7)) == key(whole)
