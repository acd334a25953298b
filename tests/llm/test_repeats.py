import os
import random

import numpy as np
import pytest

from cartloom.llm import anchors, fm_dedup, suffix_dedup
from cartloom.llm.tables import WORD


def brute(rows, symbols, window):
    """Per row: its symbols, and which are covered by windows that start in a smaller id."""
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out, at = set(), {}, 0
    while at < len(ranked):
        group = [r for r in ranked if r[0] == ranked[at][0]]
        fresh = set()
        for n, r in enumerate(group):
            s = symbols(r[1] or "")
            mark = np.zeros(len(s), dtype=bool)
            for i in range(len(s) - window + 1):
                key = tuple(s[i:i + window])
                if key in seen:
                    mark[i:i + window] = True
                fresh.add(key)
            out[r[0], n] = (s, mark)
        seen |= fresh
        at += len(group)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 6)))
    passages = [[word() for _ in range(rng.randrange(14, 40))] for _ in range(6)]
    out = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[rng.randrange(3):]
        out.append((i * 3 % 61, " ".join(words)))
    out += [(100, out[3][1]), (101, out[3][1]), (102, None), (103, ""), (104, "a" * 400), (105, "a" * 300), (106, "x y " * 100)]
    out += [(None, out[3][1]), (None, out[3][1]), (107, out[5][1]), (107, out[5][1])]
    return out


@pytest.mark.parametrize("pack_bytes", [300, 10_000_000])
def test_words_and_bytes_equal_brute_force(spark, rows, monkeypatch, pack_bytes):
    monkeypatch.setattr(anchors.pack, "__defaults__", ("doc_id", "text", pack_bytes))
    monkeypatch.setattr(anchors, "SLICE_BYTES", 2000)
    monkeypatch.setattr(anchors, "SHARD_BYTES", 2000)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, pack string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in fm_dedup.remove_repeats(df).collect())
    want = sorted((i is None, i or 0, len(s), int(m.sum()), " ".join(np.array(s, dtype=object)[~m]))
                  for (i, _), (s, m) in brute(rows, WORD.findall, 13).items())
    assert got == want
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                 for r in suffix_dedup.remove_repeats(df).collect())
    want = []
    for (i, _), (s, m) in brute(rows, lambda t: t.encode(), 50).items():
        spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        want.append((i is None, i or 0, len(s), int(m.sum()), spans, bytes(np.array(list(s), dtype=np.uint8)[~m])))
    assert got == sorted(want)


def test_keys_cost_their_slices_only():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    for slices in (1, 7, 1 << 40):
        order, used, cuts = anchors.by_slice(keys, slices)
        assert len(used) == len(cuts) <= len(keys) and sorted(order.tolist()) == list(range(len(keys)))
        place = anchors.slice_of(keys, slices)[order]
        assert all((place[a:b] == s).all() and a < b for s, (a, b) in zip(used, cuts, strict=True)) and cuts[-1][1] == len(keys)
    assert anchors.by_slice(keys[:0], 5)[1:] == ([], [])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fm_dedup.remove_repeats(none).count() == suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_induced_sort_orders_suffixes(tmp_path, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "HELD", block // 2)
    rng = random.Random(block)
    for turn in range(40):
        text = bytes(rng.randrange(1, rng.choice([2, 3, 7, 200])) for _ in range(rng.randrange(1, 300)))
        text += text[:rng.randrange(len(text) + 1)]
        folder = tmp_path / f"{block}-{turn}"
        folder.mkdir()
        (folder / "text").write_bytes(text)
        found = list(suffix_dedup.InducedSort(os.fspath(folder / "text"), len(text), os.fspath(folder)).blocks())
        at = np.concatenate([f[0] for f in found])[::-1]
        down = np.concatenate([f[1] for f in found])[::-1]
        keys = [text[i:i + suffix_dedup.DEPTH] for i in at]
        assert sorted(at.tolist()) == list(range(len(text))) and keys == sorted(keys)
        common = [len(os.path.commonprefix([a, b])) for a, b in zip(keys, keys[1:], strict=False)]
        assert down.tolist() == [0, *common]


def test_queues_share_three_files(tmp_path, monkeypatch):
    """However many bytes occur, a sort opens one file for each pass and not one for each queue."""
    monkeypatch.setattr(suffix_dedup, "HELD", 4)
    text = bytes(random.Random(1).randrange(1, 250) for _ in range(20_000))
    (tmp_path / "text").write_bytes(text)
    found = list(suffix_dedup.InducedSort(os.fspath(tmp_path / "text"), len(text), os.fspath(tmp_path)).blocks())
    assert sum(len(at) for at, _ in found) == len(text)
    assert sorted(os.listdir(tmp_path)) == ["kept", "large", "small", "text"]


def test_fm_index_counts():
    rng = random.Random(5)
    sequence = np.array([rng.randrange(1, 5) for _ in range(400)])
    index = fm_dedup.FMIndex(sequence, 4, 6)
    ends = np.arange(5, 400)
    length, low, high = index.matches(sequence, ends, 6)
    text = sequence.tolist()
    for n, end in enumerate(ends):
        times = sum(text[i:i + length[n]] == text[end + 1 - length[n]:end + 1] for i in range(400))
        assert times == high[n] - low[n] and (length[n] == 6 or times == 1)
