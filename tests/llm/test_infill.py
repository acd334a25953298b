import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartloom.llm import infill
from cartloom.llm.queries import op13_fill_in_middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc, text):
    """The rearrangement of one row, written out."""
    text = text or ""
    parts = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(parts), "plain", None, None, text
    if h4 % 100 < 80:
        return len(parts), "spm", prefix, middle, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(parts), "psm", prefix, middle, f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts(rng):
    letters = ["a", "bc", " ", "  ", "\n", "\t", "é", "日本", " ", " ", "😀", "<", "<P", "P>", "<S>", ">", "\x00", "\x0b", "\x85"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(600)]
    return [None, "", " ", "\n\n", "word", " word ", *made, "x " * 200_000, "y" * 300_000, made[5], made[5]]


def test_rows_as_written_out(spark):
    texts = odd_texts(random.Random(7))
    rows = [(None if i == 3 else i, t, "b", -1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    made = infill.restore(infill.rearrange(docs))
    got = {r.doc_id: r for r in made.collect()}
    assert len(got) == len(rows)
    forms = set()
    for doc, text, *_ in rows:
        n, form, prefix, middle, output = plainly(doc, text)
        row = got[doc]
        assert (row.n, row.form, row.prefix, row.middle, row.output, row.restored) == (n, form, prefix, middle, output, text or "")
        assert row.suffix is None if form == "plain" else len(row.prefix + row.middle + row.suffix) == len(text)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_markers_across_pieces_are_told_apart():
    for left in ("x<", "x<S", "<P", "a"):
        for right in ("P>", "S>y", ">", "b"):
            text = f"{left} {right} <M {left}"
            texts = pa.array([text.encode()] * 64, pa.binary())
            draws = [pa.array([i % 8 for i in range(64)], pa.int64()), pa.array([i // 8 for i in range(64)], pa.int64()),
                     pa.array([0] * 64, pa.int64()), pa.array([79 + i % 2 for i in range(64)], pa.int64())]
            made = infill.rearranged(texts, draws)
            assert set(made.column("form").to_pylist()) == {"psm", "spm"}
            assert set(infill.restored(made.column("output"), made.column("form")).to_pylist()) == {text}


@pytest.mark.parametrize("sizes", [[], [0], [5, 5, 5], [100, 1, 1, 100], [0, 0, 9, 0]])
def test_batches_cover_all_rows_within_the_bound(sizes):
    import numpy as np

    cuts = list(infill.slices(np.array(sizes, dtype=np.int64), 9))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 9 or b == a + 1 for a, b in cuts)


def test_empty_table_and_query(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restore(infill.rearrange(docs)).collect() == []
    rows = [(i, t) for i, t in enumerate(odd_texts(random.Random(8))[:300])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in op13_fill_in_middle(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        n, form, prefix, middle, output = plainly(doc, text)
        expected = (doc, n, form, None if prefix is None else len(prefix), None if middle is None else len(middle), sha(output), sha(text or ""))
        assert tuple(got[doc]) == expected
    assert op13_fill_in_middle(spark, str(tmp_path)).where(F.col("n").isNull()).count() == 0
