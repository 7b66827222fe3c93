import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioloom.llm import suffixes


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("length,gram,hot", [(60, 8, 4096), (60, 8, 2), (17, 5, 3)])
def test_against_brute_force(nasty, length, gram, hot):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    assert result(suffixes.dedup(nasty, length, gram, hot=hot)) == brute(rows, length)


@pytest.mark.parametrize("letters", ["ab", "abcé\0"])
def test_small_alphabets(spark, letters):
    rng = random.Random(len(letters))
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))) for i in range(60)] + [(70, letters[0] * 200), (71, "b" * 21)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length, gram, hot in ((12, 3, 4096), (12, 3, 2), (9, 9, 5), (14, 1, 3)):
        assert result(suffixes.dedup(df, length, gram, hot=hot)) == brute(rows, length)


def test_passage_in_many_documents_and_repeats_of_a_row(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30))) for i in range(300)]
    rows += [(1000, rows[0][1])] * 700 + [(None, rows[1][1][:399])] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, 400)
    assert result(suffixes.dedup(df)) == want
    assert result(suffixes.dedup(df, hot=20)) == want


def test_pieces_do_not_matter(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    want = suffixes.anchors(text, 100, 16)
    windows = [text[i : i + 100] for i in range(len(text) - 99)]
    at = dict(zip(want[0].tolist(), want[1].tolist()))
    assert all(any(i <= a <= i + 84 for a in range(i, i + 85) if a in at) for i in range(len(windows)))
    monkeypatch.setattr(suffixes, "PIECE", 333)
    got = suffixes.anchors(text, 100, 16)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_sorted_as_plain_strings_are():
    rng = random.Random(4)
    for letters in (b"ab", b"ab\0", bytes(range(256))):
        stems = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(10)]
        strings = [(rng.choice(stems) + rng.choice(stems))[:100] for _ in range(400)]
        group = np.sort(np.array([rng.randint(0, 40) for _ in strings]))
        order, common = suffixes.deep_shallow(strings, group)
        assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings))
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            assert common[k] == (-1 if group[a] != group[b] else suffixes.common_prefix(strings[a], strings[b]))
    assert suffixes.blind_trie([]) == ([], [])


def test_removed_spans_and_kept_bytes(spark):
    rows = [(1, "x" * 10 + "é" * 250 + "y" * 10), (2, "é" * 250)]
    got = {r.doc_id: r for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert [tuple(s) for s in got[1].removed] == [(10, 500)] and bytes(got[1].kept) == b"x" * 10 + b"y" * 10 and got[2].n_spans == 1


def test_empty_table(nothing):
    assert suffixes.dedup(nothing).collect() == []
