import hashlib
from collections import Counter

from folioloom.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, least_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    docs = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        keep = []
        for p in parts:
            s = docs[key(p)]
            hot = len(key(p)) >= 40 and len(s) >= least_docs
            keep.append(not hot or d == max((x for x in s if x is not None), default=None))
        out.append((d, len(parts), len(parts) - sum(keep), hashlib.sha256("\n".join(p for p, k in zip(parts, keep) if k).encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_against_brute_force(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    assert result(lines.dedup_digest(nasty)) == brute(rows)


def test_runs_over_the_edges_of_partitions(spark):
    long = ["É" * 20 + f" a line number {i} that is shared by many of them" for i in range(6)]
    rows = [(d, "\n".join([long[d % 6], f"own line of document {d} which nobody else has at all", "  " + long[0].upper().replace("É", "É") + "\t", "short"])) for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert result(lines.dedup_digest(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_forty_code_points_in_four_or_five_documents(spark):
    at = ["é" * 39, "é" * 40, "x" * 39 + " ", " " + "y" * 40]
    rows = [(d, "\n".join(at[: 4 if d < 5 else 2])) for d in range(8)] + [(90 + d, "z" * 50) for d in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(lines.dedup_digest(df)) == brute(rows)


def test_empty_table(nothing):
    assert lines.dedup_digest(nothing).collect() == []


def test_bitmaps_round_trip():
    for dropped in ([0], [7], [8], [0, 3, 200]):
        keep = lines.unpack(lines.pack(dropped), 300)
        assert [i for i, k in enumerate(keep) if not k] == dropped
    assert lines.unpack(None, 3).all()


def test_ten_thousand_repeats_of_a_row_and_rows_without_an_id(spark, monkeypatch):
    shared = "this line is in very many of the rows here, " * 2
    rows = [(None, f"{shared}\nown line of a row without an id, number {i % 700}, which is long")  for i in range(3000)]
    rows += [(7, shared + "\nand more of it")] * 10_000 + [(d, shared) for d in range(20, 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(lines.dedup_digest(df)) == brute(rows)
    assert lines.keep_bitmaps(df).count() == 703  # one for each different row, but the largest document's
    monkeypatch.setattr(lines, "MOST_WAITING", 50)
    assert result(lines.dedup_digest(df)) == brute(rows)
