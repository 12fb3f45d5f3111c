"""Values for edge cases, and bounds that hold at any size."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from loomspark.llm import fingerprint, minhash, mixing, packing, quality, queries, suffix_dedup, tokens, urlfilter

ALPHABET = "aB'  \n.9é×É́日sT\tŁ- Σ🙂l\x1c\0"
NAMES = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]


@pytest.mark.parametrize("name, words", NAMES)
@pytest.mark.parametrize("segment", [40, tokens.SEGMENT])
def test_random_texts_get_the_librarys_ids(name, words, segment, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    draw = random.Random(3)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 300))) for _ in range(600)]
    texts += [t.replace("\t", " ").replace("\x1c", "x").replace("  ", " ") for t in texts] + [None, "x" * 2000, " " * 100]
    path = queries.tokenizer_path(name)
    library, mine = Tokenizer.from_file(path), tokens.Ids(path, words, added=True)
    for t, got in zip(texts, mine.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_caches_stay_small(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    path = queries.tokenizer_path(NAMES[0][0])
    library, mine = Tokenizer.from_file(path), tokens.Ids(path, True, added=True)
    texts = [" ".join(f"word{i * j % 91}x" for j in range(40)) for i in range(30)]
    for _ in range(2):
        for t, got in zip(texts, mine.encode_all(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(mine) <= 50 and len(mine.older) <= 50


def test_bounds_of_both_families():
    assert packing.lower_bound(np.array([33] * 7), 64) == 7  # over a half
    assert packing.lower_bound(np.array([22] * 9), 64) == 5  # two in a bin
    assert packing.lower_bound(np.array([17] * 10), 64) == 4  # three in a bin: the length alone gives 3
    assert packing.lower_bound(np.array([], np.int64), 64) == 0
    draw = np.random.default_rng(1)
    for _ in range(50):
        lengths = draw.integers(1, 64, 60)
        assert packing.lower_bound(lengths, 64) <= packing.best_fit_decreasing(lengths, 64)[2]


def test_repeated_ids_do_not_share_a_group(spark):
    rows = [(7 if i % 2 else None, 0, 0, 1 + i % 60, 0) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), capacity=64, group_pieces=100).collect()
    assert Counter(r["length"] for r in got) == Counter(r[3] for r in rows)
    groups = Counter(r["sequence_id"] >> 24 for r in got)
    assert len(groups) > 20 and max(groups.values()) < 200
    for r in got:
        assert r["group_bound"] <= r["group_bins"]


def test_certified_groups(spark):
    rows = [(i, 0, 0, 1 + i * 37 % 60, 0) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), capacity=64, group_pieces=10_000)
    used = got.select("sequence_id").distinct().count()
    assert [tuple(r) for r in got.select("group_bins", "group_bound").distinct().collect()] == [(used, packing.lower_bound(np.array([r[3] for r in rows]), 64))]


@pytest.mark.parametrize("most, docs", [(1, 5), (1 << 15, 1), (700, 1), (40, 3)])
def test_next_rows_over_blocks(spark, most, docs):
    ids = [3 * i - 500 for i in range(900)] + [40, 40, 41]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(ids)], "d long, u long")
    got = {(r["d"], r["u"]): (r["next_d"], r["next_u"]) for r in fingerprint.with_next(df, "d", "u", ["d", "u"], most, docs).collect()}
    order = sorted(((d, i) for i, d in enumerate(ids)), reverse=True)
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def _sets(a, b):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in (a, b)]


def test_one_threshold_for_texts_of_all_sizes(spark):
    words = [f"w{i}" for i in range(6000)]
    pairs = [(" ".join(words[:n]), " ".join(words[m : m + k])) for n, m, k in ((6000, 3000, 3000), (5000, 100, 400), (300, 0, 300), (3, 0, 3), (3, 1, 3), (0, 0, 3), (0, 0, 0))]
    df = fingerprint.add_sketch(fingerprint.add_sketch(spark.createDataFrame(pairs, "a string, b string"), "a", "a"), "b", "b")
    df = df.withColumn("both", F.concat("a", F.lit(" "), "b")).withColumn("m", fingerprint.merged("a", "b"))
    got = df.select("a", "b", "a_values", "b_values", "a_rest", "m", fingerprint.likeness("a", "b").alias("like"), fingerprint.containment("b", "a").alias("within")).collect()
    spec = fingerprint.SketchSpec()
    for r in got:
        x, y = _sets(r["a"], r["b"])
        assert all(v < spec.tau for v in r["a_values"]) and (r["a_rest"] is None) == bool(r["a_values"])
        assert abs(len(r["a_values"]) - spec.fraction * len(x)) <= 5 * (len(x) * spec.fraction) ** 0.5 + 1
        assert r["m"] == sorted({*r["a_values"], *r["b_values"]})
        if x == y:
            assert r["like"] == 1
        if r["b_values"]:
            assert abs(r["within"] - len(x & y) / len(y)) < 0.15
        else:
            assert r["within"] is None
        if len(x | y) > 200:
            assert abs(r["like"] - len(x & y) / len(x | y)) < 0.1
    assert [r["like"] for r in got][4:] == [0, 0, 1]


@pytest.mark.parametrize("block", [3, 100_000])
def test_suffix_levels_by_brute_force(block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    draw, length = np.random.default_rng(4), 5
    levels, seen = suffix_dedup.SuffixLevels(length), set()
    for _ in range(30):
        text = draw.integers(0, 3, draw.integers(5, 60)).astype(np.uint8)  # NUL bytes too
        at = np.sort(draw.choice(len(text) - length + 1, draw.integers(0, len(text) - length + 2), replace=False))
        want = []
        for i in at:
            w = text[i : i + length].tobytes()
            want.append(w in seen)
            seen.add(w)
        keys = suffix_dedup.fingerprints(text, length)[at] % np.uint64(50)  # fingerprints that collide
        assert levels.repeats(text, at, keys).tolist() == want
        for level in levels.levels:
            letters = [level.text[i : i + length].tobytes() for i in level.order]
            assert letters == sorted(set(letters)) and len(level.keys) == len(letters)
    assert sum(map(len, levels.levels)) == len(seen) and len(levels.levels) <= 8


def test_one_of_each_keeps_rows_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 9), (2, text + " end", "b", 8), (None, text, "c", 7), (3, "other words here", None, 6), (3, "other words here", None, 6), (4, None, "d", 5), (5, "", "e", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b int").toDF("doc_id", "text", "DOC_ID", "Text")
    got = minhash.one_of_each(df, minhash.NearDup(k=5, percent=80, bands=32))
    assert got.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [r for r in rows if r[0] != 2]))
    assert minhash.one_of_each(df.limit(0)).count() == 0


def test_rules_are_read_and_hosts_may_have_line_ends(spark):
    lines = ["# list\n", "\n", "block\tads.example/x/\n", "block\ttracker\t^[^\\n]*\\n/track/[0-9]+$\ttrack\n", "block\tany\t\\n$\t\n"]
    rules = urlfilter.read_rules(lines)
    assert [(r.name, r.base, r.literals) for r in rules] == [("ads.example/x/", True, ("ads", "example", "x")), ("tracker", False, ("track",)), ("any", False, ())]
    urls = ["http://a.ads.example/x/y", "http://b.c/track/12", "http://b.c/track/x", "http://b.c", "http://foo\nbar.com/en/1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["method_rules"]) for r in urlfilter.url_verdicts(df.union(df), rules=rules + urlfilter.BASE_RULES).collect()}
    assert got == {0: ("ads.example/x/", "block", ""), 1: (None, "block", "tracker"), 2: (None, "allow", ""), 3: (None, "block", "any"), 4: ("com/en/", "block", ""), 5: (None, "block", "any")}
    with pytest.raises(ValueError):
        urlfilter.read_rules(["maybe\tx"])


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "One TWO"), (6, "a " * 80), (7, LONG), (8, LONG), (8, LONG), (9, "a\tb c  \n\nd é ü"),
    (None, "no id here at all"), (10, "x" * 300), (11, "<|endoftext|> is text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, None, None if d == 3 else f"s{(d or 0) % 3}", None, 1, "z") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, TEXT_HASH string")


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_values_of_odd_rows_without_repeats(odd):
    """Of equal windows the first stays: a byte of 300 equal ones, a period of a repeated phrase, nothing of a copy."""
    period = len(" ".join(f"word{i}" for i in range(977))) + 1
    want = {6: "a ", 7: LONG[:period], 10: "x"}
    kept = [(d, want.get(d, t or "")) for d, t in ODD if d != 8]
    assert _rows(suffix_dedup.without_repeats(odd)) == sorted(kept, key=str)


def test_values_of_odd_rows_one_of_each(odd):
    """Texts that differ in case only are copies, and so are those of two ids; rows of null ids and without words stay."""
    assert _rows(minhash.one_of_each(odd)) == sorted([(d, t) for d, t in ODD if d not in (5, 8)], key=str)


def test_values_of_odd_rows_keep_clean(odd):
    """All are too short, or repeat themselves too often. One that does not stays as it is."""
    assert _rows(quality.keep_clean(odd)) == []
    words = [a + b + c for a in ("mar", "tel", "so", "vi") for b in ("ten", "ga", "lor", "mi") for c in ("", "dan", "es", "o", "ing")]
    text = "\n".join("The " + " ".join(words[i : i + 12]) + "." for i in range(0, 72, 12))
    clean = odd.limit(1).withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.lit(text))
    assert _rows(quality.keep_clean(odd.unionByName(clean))) == [(99, text)]


def test_values_of_odd_rows_packed(odd):
    """Rows of one id and null ids give their pieces each, with the library's ids."""
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(packing.token_pieces(odd, path)).collect()
    want = Counter()
    for d, t in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for i, a in enumerate(range(0, len(ids), 4096)):
            want[d, i, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and len(used) == -(-sum(r["length"] for r in rows) // 4096)


def test_values_of_odd_rows_mixed(odd):
    """No document is taken more than twice, and the words taken are near the targets of their sources."""
    taken = Counter((r["doc_id"], r["text"]) for r in mixing.mixed(odd).collect())
    for key, n in taken.items():
        assert n <= 2 * Counter(ODD)[key]
    words = {s: 0 for s in ("s0", "s1", "s2", None)}
    got = dict(words)
    for d, t in ODD:
        s = None if d == 3 else f"s{(d or 0) % 3}"
        words[s] += len((t or "").split())
    for (d, t), n in taken.items():
        got[None if d == 3 else f"s{(d or 0) % 3}"] += n * len((t or "").split())
    total = 1.5 * sum(words.values())
    targets = {s: min(2 * words[s], total) for s in words}
    assert sum(got.values()) <= sum(targets.values()) and all(got[s] <= 2 * words[s] for s in words)
    assert abs(sum(got.values()) - total) <= 2 * 30_000
