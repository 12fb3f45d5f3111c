"""Repository evidence and readme texts against plain versions of them."""

import os
import posixpath
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from loomspark.functions import paths as P
from loomspark.functions import text as X
from loomspark.functions.snippets import clip
from loomspark.operators import cochange, harvest, history, readme
from loomspark.sources import repository


def test_paths_normalize_like_posix(spark):
    draw = random.Random(2)
    forms = ["/".join(draw.choices(["a", "b", ".", "..", "", "c.js"], k=draw.randint(1, 6))) for _ in range(300)]
    got = spark.createDataFrame([(f,) for f in forms if f], "p string").select("p", P.normalized(F.col("p")).alias("n")).collect()
    for r in got:
        want = posixpath.normpath(r.p)
        want = want[1:] if want.startswith("//") else want
        assert r.n.rstrip("/") == want.rstrip("/") or (want == "." and r.n in (".", "./")), r


def test_tokens_of_other_scripts(spark):
    texts = ["Éclair foo_bar x-ray 42ND", "οδος ελληνικά", "ёлка", "nẵng łódź č ő ǰ", "éa ́b", "한국어", "日本 語。x", "aͅb", "a_b ª²", "İx ẞ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.tokens(F.col("t")).alias("x")).collect()
    got = {r.i: r.x for r in rows}
    assert got[0] == ["eclair", "foo", "bar", "x", "ray", "42nd"] and got[1] == ["οδοσ", "ελληνικά"] and got[2] == ["ёлка"]
    assert got[3][0] == "nẵng" and got[3][1] == "łodz" and got[4] == ["ea", "b"]
    assert [X.token_list(t) for t in texts[:9]] == [got[i] for i in range(9)]


def test_white_space_and_clips(spark):
    row = spark.createDataFrame([("  a \n b﻿",)], "t string").select(X.single_spaced(F.col("t"))).first()
    assert row[0] == "a b"
    assert clip("xx" + " " * 400 + "y") == "xx…" and clip("a" * 300) == "a" * 255 + "…"


def test_abstains(spark, monkeypatch):
    current = spark.createDataFrame([(f"a/{i}",) for i in range(5)], "path string")
    revisions = spark.createDataFrame([(i, [f"a/{j}" for j in range(5)]) for i in range(4)], "pos long, paths array<string>")
    monkeypatch.setattr(history, "MAX_TRACKED", 4)
    assert history.retain_eligible(current, revisions).reason == "tracked-file-limit"
    monkeypatch.setattr(history, "MAX_TRACKED", 5)
    monkeypatch.setattr(history, "MAX_PATHS", 4)
    assert history.analyze(current, revisions)["reason"] == "diff-path-limit"
    events = spark.createDataFrame([(0, ["a/x", "b/y"]), (1, ["a/x", "b/y"])], "p long, paths array<string>")
    monkeypatch.setattr(cochange, "MAX_OBSERVATIONS", 1)
    assert cochange.select_candidates(events, True)["reason"] == "pair-observation-limit"
    with pytest.raises(history.UnsafePath):
        history.retain_eligible(spark.createDataFrame([("",)], "path string"), revisions)


def test_scan_and_retention_limits(spark):
    current = spark.createDataFrame([("a/x",), ("b/y",), ("README.md",)], "path string")
    kinds = [[], ["gone"], ["README.md"], ["a/x", "b/y", "a/x"]]
    revisions = spark.createDataFrame([(i, kinds[i % 4] if i < 100 else ["a/x"]) for i in range(500)], "pos long, paths array<string>")
    got = history.retain_eligible(current, revisions)
    audit = {(r.part, r.key): r.n for r in got.audit.collect()}
    assert audit["summary", "revisionsScanned"] == 400 and audit["summary", "retainedEligibleDiffs"] == got.events.count() == 200
    assert audit["omittedDiffs", "older-after-retention"] == 400 - 100 - 175 and audit["omittedDiffs", "excluded-only"] == 25
    assert got.events.orderBy("p").first().paths == ["a/x", "b/y"]


def _git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_a_repository_is_read_whole(spark, tmp_path):
    root = str(tmp_path)
    _git(root, "init", "-q")
    files = {
        "src/a.js": "import x from './b'; require('../lib')", "src/b.mjs": "export * from './a.js'", "lib/index.js": "1", "package.json": '{"name": "x"}',
        ".gitattributes": "gen.js linguist-generated", "gen.js": "import './src/a'", "yarn.lock": "",
    }
    for step in range(3):
        for path, text in files.items():
            os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
            with open(f"{root}/{path}", "w") as f:
                f.write(text + "\n" * (step if path != "lib/index.js" else 0))
        _git(root, "add", "-A")
        _git(root, "commit", "-q", "-m", str(step))
    packet = repository.harvest_repository(spark, root)
    assert '"name": "x"' in packet and '2\t"src/a.js"' in packet and '1\t"lib/index.js"' in packet and '3\t"src/a.js"' in packet
    assert packet == repository.harvest_repository(spark, root)
    found = repository.analyze_repository(spark, root)
    assert found["status"] == "ok" and found["history"]["summary", "revisionsScanned"] == 3
    assert found["history"]["excludedCurrentFiles", "generated-attribute"] == 1 and found["history"]["excludedCurrentFiles", "lockfile"] == 1
    assert len(repository.report([found])) < repository.MAX_REPORT
    with pytest.raises(repository.RepositoryError):
        repository.nul_strings(b"a\0b")
    for bad in (b"\xff\0",):
        with pytest.raises(repository.RepositoryError):
            repository.nul_strings(bad)
    with pytest.raises(repository.RepositoryError):
        repository.tree_rows(["100644 blob x"])


def test_registry_and_prefix(spark, tmp_path):
    path = tmp_path / "list"
    path.write_text(" /a \n\n# no\n/b\n/a\n")
    assert repository.read_registry(spark, str(path)) == ["/a", "/b"]
    path.write_text("é" * 20)
    assert repository.read_prefix(str(path), 5) == ("é" * 6, True) and repository.read_prefix(str(path), 20) == ("é" * 20, False)


def test_specifiers(spark):
    source = "import a from 'x'\nexport {b}\n  from \"./y\"; import('./z'); require(\n'./w'); import './v'; reimport 'no'; const s = require('./w')"
    got = spark.createDataFrame([(source,)], "s string").select(harvest.specifiers(F.col("s"))).first()[0]
    assert got == ["x", "./v", "./z", "./w"] or got == ["x", "./y", "./v", "./z", "./w"]


def test_projection_cuts_at_the_best_boundary():
    line = "word " * 11 + "word\n"
    sections = "# T\n" + "".join(f"## S{i}\n{line * 8}\n" for i in range(40))
    got = readme.projection(sections)
    assert len(got) <= readme.BUDGET and got.endswith(readme.MARKER + "\n")
    body = got.removesuffix(f"\n\n{readme.MARKER}\n")
    assert sections.startswith(body) and sections[len(body) :].lstrip("\n").startswith("## S")
    blocks = "".join(f"{line}\n" for _ in range(400))
    body = readme.projection(blocks).removesuffix(f"\n\n{readme.MARKER}\n")
    assert blocks.startswith(body) and blocks[len(body) :].startswith("\n\n")
    assert readme.projection(line * 9) == line * 9
    fenced = readme.projection("```js\n" + line * 400)
    assert len(fenced) <= readme.BUDGET and fenced.startswith("~~~text\n    ```js\n    word") and "\n~~~\n" in fenced
    one = readme.projection("x" * 20_000)
    assert len(one) == readme.BUDGET and one.startswith("x" * 9000)
    assert "## in" not in readme.projection("# T\n" + "a\n\n" * 2 + "```\n## in\n" + line * 400 + "```\n")


def test_boundaries_know_fences():
    got = readme.boundaries("# T\n\ntext\n~~~\n# no\n```\n~~~~\n## S\nlast")
    assert got.section == [28] and got.open_fence is None and got.block == [5, 28] and got.line == [4, 5, 10, 28, 33]
    assert readme.boundaries("a\n```x\nb").open_fence == "`"
