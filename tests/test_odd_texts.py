"""Queries over texts that the test tables lack, against their SQL."""

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e
from tests.oracle import FOLDER, differences

PARTS = (
    "the and with with\xa0the in for edly that if not no is of was to on re but BUT yet however , . ; ! ? 1.2.3 4,5,6 12.5 3.4,5 7. 8 5mg 5ccx 3cc İ ı ß ſ whereaſ K Σ é é nõ ́ ٣٫٥ ٤ 😀 THE The ² \x85 _ 1and".split(" ")
    + [" ", "\n", "with the", "is the", " edly", " on ", "5 kg", "Xyz-zol"]
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("odd"), random.Random(5)
    for path in Path(FOLDER).glob("*.parquet"):
        if path.stem != "documents":
            (out / path.name).symlink_to(path)
    texts = [rng.choice(["", " ", " "]).join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(400)]
    texts += ["in 1.2.3 edly. the", "İİ a, b edly c.", "the whereaſ edly", "5ccx ٣٫٥", None, "", "  "]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t or "") for t in texts]}), out / "documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["str_08", "ext_03", "ext_04", "ext_10"])
def test_odd_texts(spark, folder, name):
    assert not differences(spark, name, e.queries()[name], e.oracle_sql()[name], folder)


def test_guard_on_odd_texts(spark, folder):
    assert not differences(spark, "grd_01", e.queries()["grd_01"], e.oracle_sql()["grd_01"], folder)
