"""Runs by the command line as a whole, the stored index, and what happens when either breaks off."""

import json

import pytest
from pyspark.sql import functions as F

from folioloom import __main__ as cli
from folioloom.operators import index
from folioloom.plans.model import Stub
from folioloom.sources import store

PARA = "A wheel is part of a car and each {0} car has four wheels, so we call that whole a vehicle of the {0} kind."
CLASSES = """@@@ other @@@
nothing
@@@ relation_categories @@@
$$ Mereology $$
[definition]
Of parts
and wholes.
[example]
wheel | part of | car
[narrative]
A part is in its whole.
$$ Causality $$
[definition]
Of causes.
[example]
rain | causes | flood
[narrative]
What brings about what.
"""


def read(spark, path):
    return spark.read.parquet(store.literal(str(path)))


def corpus(tmp_path, **files):
    root = tmp_path / "corpora"
    for name, text in files.items():
        at = root / name.replace("__", "/").replace("_txt", ".txt")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return root


def counting(path):
    """An encoder that tells a file which texts it was asked for."""

    def encode(texts):
        with open(path, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return index.hashed_ngrams(texts)

    return encode


def test_an_index_is_kept_and_only_changed_files_are_encoded(spark, tmp_path, monkeypatch):
    from folioloom.sources.documents import corpus_files

    asked = tmp_path / "asked"

    def seen():
        found = asked.read_text().splitlines() if asked.exists() else []
        asked.unlink(missing_ok=True)
        return sorted(t[-3:] for t in found)

    long = "This is a sentence of some length that is said about the thing called {0}, number {0}. And one more sentence that is long enough to be kept, of {0}"
    root = corpus(tmp_path, a__x_txt=long.format("ax1"), a__y_txt=long.format("ay1"), b__z_txt=long.format("bz1"))
    kept = index.Stored(spark, str(tmp_path / "index"), "m", counting(str(asked)))
    assert kept.refresh(corpus_files(spark, str(root))) == {"encoded": 3, "removed": 0, "kept": 0, "rebuilt": []}
    assert len(seen()) == 6 and kept.read().count() == 6
    assert kept.refresh(corpus_files(spark, str(root)))["encoded"] == 0 and seen() == []
    (root / "a/x.txt").write_text(long.format("ax2"))
    # A refresh that breaks off before the new version is named leaves the old one, and is made again.
    whole = store.write_json
    monkeypatch.setattr(index.store, "write_json", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        kept.refresh(corpus_files(spark, str(root)))
    assert {r.text[-3:] for r in kept.read().collect() if r.corpus == "a"} >= {"ax1", "ay1"}
    monkeypatch.setattr(index.store, "write_json", whole)
    seen()
    assert kept.refresh(corpus_files(spark, str(root))) == {"encoded": 1, "removed": 0, "kept": 2, "rebuilt": []}
    assert [s for s in seen() if s != "ax2"] == ["ax2."] or kept.read().count() == 6
    assert {(r.source_file, r.chunk_index) for r in kept.read().collect()} == {(f, i) for f in ("x.txt", "y.txt", "z.txt") for i in (0, 1)}
    # Another model makes all anew; a removed file's passages go; a corpus that lost passages is made again.
    other = index.Stored(spark, str(tmp_path / "index"), "n", counting(str(asked)))
    (root / "b/z.txt").unlink()
    assert other.refresh(corpus_files(spark, str(root))) == {"encoded": 2, "removed": 0, "kept": 0, "rebuilt": []}
    assert {r.corpus for r in other.read().select("corpus").distinct().collect()} == {"a"}
    version = json.loads((tmp_path / "index/current.json").read_text())["version"]
    assert [p.name for p in (tmp_path / "index/passages").iterdir()] == [f"version={version}"]
    at = str(tmp_path / f"index/passages/version={version}")
    few = [r for r in spark.read.parquet(at).collect()][1:]
    spark.createDataFrame(few, "source_file string, chunk_index int, text string, vector array<float>, corpus string").write.mode("overwrite").partitionBy("corpus").parquet(at)
    assert other.refresh(corpus_files(spark, str(root)))["rebuilt"] == ["a"] and other.read().count() == 4


def test_a_pdf_of_a_corpus_is_not_read_as_text(spark):
    files = spark.createDataFrame([("c", "p.pdf", b"%PDF-1.4 1 0 obj " * 20), ("c", "t.txt", (PARA.format("red") + "\n\nshort").encode())], "corpus string, source_file string, content binary")
    assert [r.source_file for r in index.chunks(files).collect()] == ["t.txt"]


def test_a_run_that_breaks_off_goes_on(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "BATCH", 2)
    papers, out, asked = tmp_path / "papers", tmp_path / "out", tmp_path / "asked"
    papers.mkdir()
    assert cli.main(["--papers", str(papers), "--out", str(out), "--model", "m"], lambda: Stub(str)) == 1  # nothing to read
    for i in range(4):
        (papers / f"p{i}.txt").write_text("\n\n".join([PARA.format(f"w{i}"), "too short", "17", PARA.format(f"v{i}")]))
    root = corpus(tmp_path, lib__x_txt=PARA.format("far") + " " + PARA.format("near"))
    classes = tmp_path / "classes.txt"
    classes.write_text(CLASSES)
    good = {"name": "part_of", "description": "Links a part to its whole.", "definition": "A relation of parts.", "relation_type": "Mereology", "usage_example": "wheel | part of | car"}

    def answer(prompt):
        if prompt.startswith("Read the passage"):
            return "Verbs: is\nReading: a wheel\nLinks: wheel | part of | car"
        if prompt.startswith("Find"):
            with open(asked, "a") as f:
                f.write(prompt.replace("\n", " ") + "\n")
            if "vehicle of the v2 kind" in prompt.split("Passage:")[-1] and not (tmp_path / "mended").exists():
                raise SystemExit("killed")  # no failure that is tried again: the worker is gone
            return json.dumps({"relations": [good]}) if "Mereology in" in prompt else "no idea {"
        if prompt.startswith("Do both"):
            return json.dumps({"same_meaning": True})
        return json.dumps({"groups": [{"members": list(range(1, prompt.count("Relation ") + 1)), **good}]})

    args = ["--papers", str(papers), "--out", str(out), "--corpora", str(root), "--classes", str(classes), "--model", "m"]
    with pytest.raises(Exception) as broke:
        cli.main(args, lambda: Stub(answer))
    assert asked.exists(), broke.value
    first = {p.rsplit("Passage:", 1)[1].split("vehicle of the ")[1][:2] for p in asked.read_text().splitlines()}
    done = {tuple(r) for r in read(spark, out / "m/log").select("source_pdf", "paragraph_index").collect()}
    assert 0 < len(done) < 8 and "v2" in first
    (tmp_path / "mended").touch()
    asked.unlink()
    capsys.readouterr()
    assert cli.main(args, lambda: Stub(answer)) == 0
    told = dict(line.split(": ", 1) for line in capsys.readouterr().out.splitlines() if ": " in line)
    again = asked.read_text().splitlines()
    raw = read(spark, out / "m/raw")
    assert {tuple(r) for r in raw.select("source_pdf", "paragraph_index").collect()} == {(f"p{i}.txt", n) for i in range(4) for n in (1, 2)}
    assert raw.count() == 8 and len(again) == 2 * (8 - len(done))  # each of the others once for each class
    assert all("Of parts and wholes." in p or "Of causes." in p for p in again) and all("Background:" in p for p in again)
    assert told["requests"] == str(8 * 3) and told["unreadable"] == "8" and told["relations"] == "8"
    assert told["merged by name"] == "1" and "merged by name, folded" in told and "elapsed" in told
    saved = out / "snapshots" / "m"
    assert {p.name for p in saved.iterdir()} >= {"raw", "merged", "clusters", "reduced", "relations", "run_meta"}
    assert read(spark, saved / "relations").count() == 1
    asked.unlink()
    assert cli.main(["extract", *args], lambda: Stub(answer)) == 0 and not asked.exists()  # finished


def test_a_stage_without_input_is_refused(spark, tmp_path):
    for stage in ("merge", "cluster", "disambiguate", "merge_global"):
        assert cli.main([stage, "--papers", "none", "--out", str(tmp_path / "o"), "--model", "m"]) == 1
    assert not (tmp_path / "o/snapshots").exists()


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = store.numbered(df, "x").collect()
    assert sorted((r.seq, r.x) for r in got) == [(i + 1, i) for i in range(1000)]


def test_a_references_heading_is_the_first_line(spark):
    from folioloom.functions.headings import is_references_heading, starts_with_references

    texts = {"A paragraph.\nReferences\nmore text": False, "References\nmore text": True, "5. References": True, "  Bibliografia:  ": True, "Preferences": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.h for r in df.select("t", is_references_heading(F.col("t")).alias("h")).collect()} == texts
    assert df.where(starts_with_references(F.col("t"))).count() == 3


def test_prompt_files_replace_templates_and_classes(spark, tmp_path):
    papers, asked = tmp_path / "papers", tmp_path / "asked"
    papers.mkdir()
    (papers / "p.txt").write_text(PARA.format("red"))
    (tmp_path / "a.txt").write_text("@@@ extract @@@\nMINE $relation_type / $relation_definition, $$5: $chunk_text\n@@@ analyse_snippet @@@\nREAD $chunk_text")
    (tmp_path / "b.txt").write_text(CLASSES)

    def answer(prompt):
        with open(asked, "a") as f:
            f.write(prompt.split(":")[0].split(" A wheel")[0] + "\n")
        return '{"relations": []}'

    args = ["extract", "--papers", str(papers), "--out", str(tmp_path / "out"), "--model", "m", "--no-rag"]
    files = [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]
    assert cli.main([*args, "--prompts", *files], lambda: Stub(answer)) == 0
    want = ["MINE Causality / Of causes., $5", "MINE Mereology / Of parts and wholes., $5", "READ"]
    assert sorted(asked.read_text().splitlines()) == want
    asked.unlink()
    assert cli.main([*args, "--prompts", *files], lambda: Stub(answer)) == 0 and not asked.exists()  # finished
    (tmp_path / "a.txt").write_text("@@@ extract @@@\nOTHER $relation_type: $chunk_text")
    assert cli.main([*args, "--prompts", *files], lambda: Stub(answer)) == 0  # other prompts are another run
    assert sorted(x.split("\n")[0] for x in asked.read_text().splitlines() if x.startswith("OTHER")) == ["OTHER Causality", "OTHER Mereology"]
    with pytest.raises(ValueError, match="two files"):
        cli.main([*args, "--prompts", files[1], files[1]], lambda: Stub(answer))


def test_templates_are_checked_before_any_request(spark):
    from folioloom.plans import prompts

    for body, why in (("", "blank"), ("$chunk_text $other", "unknown variables"), ("costs 5 $", "without a name"), ("${chunk_text} $chunk", "unknown variables")):
        with pytest.raises(ValueError, match=why):
            prompts.Templates.of({"extract_open": body})
    own = prompts.Templates.of({"merge": "$count of ${relation_type}é$$: $listed", "other": "$anything"})
    assert own.extract == prompts.EXTRACT
    rows = [{"name": "$count", "description": "d", "definition": "e", "relation_type": "T", "usage_example": "u"}]
    df = spark.createDataFrame(rows).select(F.array(F.struct("name", "description", "definition", "relation_type", "usage_example")).alias("r"))
    assert df.select(prompts.merge_prompt(F.col("r"), True, own)).head()[0] == prompts.merge_text(rows, True, own) == "1 of Té$: " + prompts.relations_text(rows)
    both = prompts.Templates.of({"disambiguate": "$name1 $definition2"})
    assert df.select(prompts.same_prompt(F.col("r")[0], F.col("r")[0], both)).head()[0] == prompts.same_text(rows[0], rows[0], both) == "$count e"
