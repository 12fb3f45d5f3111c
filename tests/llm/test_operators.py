import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loomspark.llm import fingerprint, licenses, minhash, mixing, packing, ppm, quality, queries, rans, sql, suffix_dedup, tokens, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, TEXT_HASH string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "One TWO"), (6, "a " * 80), (7, LONG), (8, LONG), (8, LONG), (9, "a\tb c  \n\nd é ü"),
    (None, "no id here at all"), (10, "x" * 300), (11, "<|endoftext|> is text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None, None if d == 3 else f"s{(d or 0) % 3}", None, 1, "z") for d, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def table():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def _one(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, want))


APPLY = {
    "quality": lambda d: quality.line_first_quality(d),
    "keep_clean": quality.keep_clean,
    "mix": lambda d: mixing.mix_sources(d),
    "mixed": mixing.mixed,
    "near": minhash.near_duplicates,
    "one_of_each": minhash.one_of_each,
    "repeats": suffix_dedup.remove_repeats,
    "without_repeats": suffix_dedup.without_repeats,
    "licenses": licenses.scan_licenses,
    "ppm": ppm.score_documents,
    "fingerprints": fingerprint.edit_fingerprints,
    "pack": lambda d: packing.pack(packing.token_pieces(d, queries.tokenizer_path("word_bpe_49k.json"))),
}
WHOLE = ("quality", "mix", "near", "repeats", "licenses", "ppm", "fingerprints")


@pytest.mark.parametrize("name", sorted(APPLY))
def test_odd_and_empty_tables(odd, name):
    assert APPLY[name](odd.limit(0)).count() == 0
    got = APPLY[name](odd)
    assert got.count() == len(ODD) if name in WHOLE else got.count() >= 0
    if name in ("keep_clean", "mixed", "one_of_each", "without_repeats"):
        assert got.columns == odd.columns


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/71?q"), (4, "http://com/en/"), (5, "http://xcom/en/1"), (6, "http://a.net/de/1#x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, URL_ int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.url_verdicts(df).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[4][2:] == ("com/en/", "block") and got[5][2] is None and got[6][2:] == ("net/de/", "block")
    assert urlfilter.url_verdicts(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_cached_ids_are_the_librarys(table, name, words):
    path = queries.tokenizer_path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    mine = tokens.Ids(path, words)
    for t in [*table.values(), *[t for _, t in ODD if t], " a\n \n b ", "ΟΔΟΣ İı", "a \x1c b\x85", "\0 a b"]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing(spark, table):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d, text in table.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert sum(r["length"] for r in parts) == len(ids)
        for i, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (i, 4096 * i)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    lengths = np.array([r["length"] for r in rows])
    assert packing.lower_bound(lengths, 4096) <= len(by_sequence) <= packing.lower_bound(lengths, 4096) + 1


def test_exchange_saves_bins(spark):
    rows = [(i, 0, 0, 1 + i * 37 % 60, 0) for i in range(600)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(pieces, capacity=64, group_pieces=64)
    assert got.count() == 600
    used = got.select("sequence_id").distinct().count()
    bound = packing.length_bound(pieces, 64)
    alone = packing.pack(pieces, capacity=64, group_pieces=10_000).select("sequence_id").distinct().count()
    assert bound <= alone <= used <= 1.1 * alone
    assert got.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 64").count() == 0


def test_rans_round_trip():
    r = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 70_000):
        symbols = np.minimum(r.zipf(1.3, n), 50_000).astype(np.uint32)
        table = rans.Table(*np.unique(symbols, return_counts=True))
        payload, marks = rans.encode(symbols, table)
        assert (rans.decode(payload, n, table) == symbols).all()
        step = rans.LANES * rans.CHECKPOINT
        for i in range(-(-n // step)):
            assert (rans.decode(payload, n, table, marks, i, i) == symbols[i * step : (i + 1) * step]).all()


def test_token_files(spark, odd, table):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got, start = _one(spark, "op4_token_files"), 0
    for d in sorted(table):
        ids = np.array([*library.encode(table[d], add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert rans.read_token_files(spark, rans.write_token_files(odd, path)).count() == len(ODD)
    assert rans.read_token_files(spark, rans.write_token_files(odd.limit(0), path)).count() == 0


def _components(table, k, percent):
    sets = {}
    for d, t in table.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    where, shared, root = defaultdict(list), Counter(), {d: d for d in sets}
    for d in sorted(sets):
        for s in sets[d]:
            shared.update((e, d) for e in where[s])
            where[s].append(d)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark, table):
    got = _one(spark, "op2_minhash_near_dedup")
    for d, (n, c) in _components(table, 3, 85).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, c, c == d)


def test_near_copies_without_a_common_center(spark):
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for d in range(60):
        words = list(base)
        for i in r.integers(0, 400, d % 12):
            words[i] = f"x{d}_{i}"
        texts[d] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(df).collect()}
    assert got == _components(texts, 3, 85)


def _removed(table, length=100):
    seen, out = set(), {}
    for d in sorted(table):
        b = table[d].encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, f in zip(b, cover, strict=True) if not f)
        spans = sum(f and (i == 0 or not cover[i - 1]) for i, f in enumerate(cover))
        out[d] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, table):
    got = {d: tuple(r)[1:] for d, r in _one(spark, "op5_suffix_array_dedup").items()}
    assert got == _removed(table)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_hot_passages(spark, hot):
    r = np.random.default_rng(1)
    passage = "".join(map(chr, r.integers(97, 123, 150)))
    texts = {d: "".join(map(chr, r.integers(97, 123, 40))) + passage[d % 7 :] + "é" * (d % 60) for d in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df, spec=suffix_dedup.LongMatches(hot_runs=hot)).collect()
    assert {x["_row"][0]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows} == _removed(texts)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_suffix_dedup_of_repeated_rows(spark, hot):
    r = np.random.default_rng(2)
    own = ["".join(map(chr, r.integers(97, 123, 250))) for _ in range(12)]
    texts = {d: own[d % 12] if d % 3 else own[0][:120] + own[d % 12] for d in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df.union(df), spec=suffix_dedup.LongMatches(hot_runs=hot)).collect()
    assert len(rows) == 60
    assert {x["_row"][0]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows} == _removed(texts)


def test_suffix_dedup_of_texts_with_one_id(spark):
    """Rows of one id come in the order of their texts' hashes: one of two that share a passage loses it."""
    passage = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 140)))
    df = spark.createDataFrame([(5, "left " + passage), (5, passage + " right"), (6, "kept")], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted(x["n_removed"] for x in rows) == [0, 0, 140]


def test_levels_stay_few():
    levels, seen, r = suffix_dedup.Levels(), set(), np.random.default_rng(0)
    for _ in range(64):
        batch = r.integers(0, 20_000, 500).astype(np.uint64)
        want = []
        for x in batch.tolist():
            want.append(x in seen)
            seen.add(x)
        assert levels.repeats(batch).tolist() == want
    assert len(levels.levels) <= 8


def test_licenses(spark):
    texts = {1: "Released under the MIT License.", 2: "MIT-License, mit license", 3: "admit license", 4: "plain text here", 5: "Licensed under CC BY-NC 4.0.\nfoo"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [(got[d]["n_base"], got[d]["first_word"], got[d]["last_word"], got[d]["base_labels"]) for d in (1, 2, 3, 4)] == [
        (1, 3, 3, "mit"), (2, 0, 2, "mit"), (0, None, None, ""), (0, None, None, ""),
    ]
    assert got[5]["labels"] == "cc-by,cc-by-nc" and got[1]["score"] == 1.0 and got[4]["score"] == 0.0


def test_lm_base_score(spark, table):
    got = _one(spark, "op7_lm_scoring")
    count = Counter()
    for d, t in table.items():
        if zlib.crc32(str(d).encode()) % 10:
            count.update(re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    for d, t in table.items():
        words = [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 10 == 0, len(words), sum(w in count for w in words), n)
        assert r["base_score"] == pytest.approx(want)
    out = [r for r in got.values() if r["held_out"]]
    learned, held = ([t.encode() for d, t in table.items() if got[d]["held_out"] == x] for x in (False, True))
    single = Counter(b"".join(learned))
    size = sum(single.values())
    alone = sum(math.log10(max(1, single[b]) / size) for t in held for b in t)
    assert sum(r["score"] for r in out) > 0.7 * alone  # single bytes, without their contexts, are much worse


def test_partial_matching_by_brute_force():
    texts = [b"abracadabra", b"abrakadabra", b"", b"cab"]
    keys, _ = ppm.grams(texts)
    tables = []
    for j in range(ppm.ORDER + 1):
        tables.append(np.unique(keys & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True))
    model = ppm.Model.of(tables)
    count = defaultdict(Counter)
    for t in texts:
        p = b"\0" * ppm.ORDER + t
        for i in range(ppm.ORDER, len(p)):
            for j in range(ppm.ORDER + 1):
                count[p[i - j : i]][p[i]] += 1

    def probability(context, symbol):
        p, gone = 1.0, set()
        for j in range(ppm.ORDER, -1, -1):
            seen = {s: c for s, c in count[context[ppm.ORDER - j :]].items() if s not in gone}
            total = sum(seen.values()) + len(seen)
            if not total:
                continue
            if symbol in seen:
                return p * seen[symbol] / total
            p *= len(seen) / total
            gone |= set(seen)
        return p / (256 - len(gone))

    for context in (b"\0\0\0\0\0", b"dabra", b"xxbra", b"zzzzz", b"\0\0cab"):
        all_ = [probability(context, s) for s in range(256)]
        assert sum(all_) == pytest.approx(1.0)
        key = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert model.log10(key) == pytest.approx(np.log10(all_))


def _ppm_scores(texts, learned):
    """Of each text, the log10 probability of its bytes after all grams of the learned texts, by dictionaries."""
    seen = {}
    for t in learned:
        p = b"\0" * ppm.ORDER + t
        for i in range(ppm.ORDER, len(p)):
            for j in range(ppm.ORDER + 1):
                symbols = seen.setdefault(p[i - j : i], {})
                symbols[p[i]] = symbols.get(p[i], 0) + 1
    known = {}

    def log(context, symbol):
        out, gone = 0.0, set()
        for j in range(ppm.ORDER + 1):
            symbols = {s: c for s, c in seen.get(context[j:], {}).items() if s not in gone}
            total = sum(symbols.values()) + len(symbols)
            if symbol in symbols:
                return out + math.log10(symbols[symbol] / total)
            if total:
                out += math.log10(len(symbols) / total)
                gone |= set(symbols)
        return out - math.log10(256 - len(gone))

    sums = []
    for t in texts:
        p = b"\0" * ppm.ORDER + t
        pieces = [p[i - ppm.ORDER : i + 1] for i in range(ppm.ORDER, len(p))]
        known.update((x, log(x[:-1], x[-1])) for x in {*pieces} - known.keys())
        sums.append(math.fsum(known[x] for x in pieces))
    return sums


def test_lm_score_keeps_all_grams(spark):
    """More than 2**18 distinct grams an order, each of which counts, in several groups of documents."""
    r = np.random.default_rng(7)
    texts = {d: "".join(map(chr, r.integers(32, 96, 9_000))) for d in range(40)}
    texts |= {d + 40: t[:4_000] + t[::-1][:500] for d, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x for x in ppm.score_documents(df).collect()}
    learned = [texts[d].encode() for d in texts if not got[d]["held_out"]]
    assert len({t[i : i + 6] for t in learned for i in range(len(t) - 5)}) > 1 << 18
    want = _ppm_scores([t.encode() for t in texts.values()], learned)
    assert [got[d]["score"] for d in texts] == pytest.approx(want)


def test_fingerprints(spark, table):
    got = _one(spark, "op9_document_fingerprints")
    order = sorted(table, reverse=True)
    for d, e in zip(order, [*order[1:], order[0]], strict=True):
        t, third = table[d], len(table[d]) // 3
        edited = t[: len(t) - third] + table[e][:third]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sets = []
        for x in (t, edited, table[e]):
            w = re.findall(r"[^\x20\x09-\x0D]+", x.lower())
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            size = len(sets[0] | other)
            assert abs(got[d][name] - len(sets[0] & other) / max(1, size)) < max(0.03, 5 * 0.5 / max(1, size / 4) ** 0.5)
    by_text = defaultdict(set)
    for d, t in table.items():
        by_text[t].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_mix_meets_targets(spark):
    got = defaultdict(lambda: [0, 0.0, 0])
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    for r in queries.op8_mix_sources(spark, SF).collect():
        g = got[source[r["doc_id"]]]
        g[0], g[1], g[2] = g[0] + r["taken"], r["target"], max(g[2], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken - target) <= most for taken, target, most in got.values())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        if i < 3:
            n, before = docs.count(), n
            assert 0 < n <= before
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0


def test_lm_score_by_brute_force(spark, table):
    got = _one(spark, "op7_lm_scoring")
    learned = [t.encode() for d, t in table.items() if zlib.crc32(str(d).encode()) % 10]
    want = _ppm_scores([t.encode() for t in table.values()], learned)
    assert [got[d]["score"] for d in table] == pytest.approx(want)


def _license_row(text):
    """n_words, n_base, first_word, last_word, base_labels, labels and score, by comparing words."""

    def split(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))

    words = split(text)
    places = []
    for i in range(len(words)):
        places += [(i, label) for phrase, label in licenses.PHRASES.items() if words[i : i + phrase.count(" ") + 1] == phrase.encode().split()]
    labels, best = {label for _, label in places}, 0.5 if places else 0.0
    verified = []
    at = defaultdict(list)
    for i in range(len(words) - 3):
        at[tuple(words[i : i + 4])].append(i)
    for label, template in licenses.TEMPLATES:
        w = split(template)
        votes = defaultdict(set)
        for p in range(len(w) - 3):
            for i in at[tuple(w[p : p + 4])]:
                votes[i - p].add(p)
        span, before = set(), None
        for diagonal in sorted(votes):
            span = votes[diagonal] | (span if before is not None and diagonal - before <= 3 else set())
            before = diagonal
            if len(span) / (len(w) - 3) >= 0.6:
                verified.append(len(span) / (len(w) - 3))
                labels = labels | {label}
    base = ",".join(sorted({label for _, label in places}))
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return len(words), len(places), *ends, base, ",".join(sorted(labels)), max(verified, default=best)


def test_license_scans_by_brute_force(spark, table):
    got = _one(spark, "op6_license_scans")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    want = {d: _license_row(t) for d, t in table.items()}
    assert {d: tuple(r[n] for n in names) for d, r in got.items()} == want
    assert any(w[5] for w in want.values())
    r, texts = np.random.default_rng(4), {}
    for _, template in licenses.TEMPLATES * 6:  # with words lost and put in, so that spans are verified in part
        words = template.split()
        for _ in range(r.integers(0, 6)):
            i = r.integers(0, len(words))
            words[i : i + r.integers(0, 2)] = ["other"] * r.integers(0, 5)
        texts[len(texts)] = " ".join(["some", *words, "text", *template.split()[: r.integers(0, 9)]])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: tuple(x[n] for n in names) for x in licenses.scan_licenses(df).collect()}
    assert got == {d: _license_row(t) for d, t in texts.items()}
    assert {x[6] == 1 for x in got.values()} == {True, False} and any(0.6 <= x[6] < 0.9 for x in got.values())


def _clean(text):
    """The text without failing lines, or None for a document that is rejected."""

    def solid(x):
        return len(re.sub(rb"[\x20\x09-\x0D]", b"", x))

    def fails(line):
        n = solid(line)
        return (
            100 * len(re.findall(rb"[#*$%&|<>!]", line)) > 8 * n
            or len(re.findall(rb"[|>]", line)) >= 3
            or (n > 20 and 100 * len(re.findall(rb"[A-Z]", line)) > 60 * n)
            or (len(line.split()) <= 20 and any(p.encode() in line.lower() for p in quality.BOILERPLATE))
        )

    raw = text.encode()
    words = raw.split()
    count = Counter(zip(words, words[1:], words[2:], strict=False))
    repeats = {i + o for i in range(len(words) - 2) if count[*words[i : i + 3]] > 1 for o in range(3)}
    gone = [x.strip() and fails(x) for x in raw.split(b"\n")]
    lost = sum(solid(x) for x, g in zip(raw.split(b"\n"), gone, strict=True) if g)
    if len(words) < 50 or 2 * len(repeats) > len(words) or 100 * lost > 30 * solid(raw):
        return None
    return b"\n".join(x for x, g in zip(raw.split(b"\n"), gone, strict=True) if not g).decode()


def _without_repeats(texts, length=100):
    seen, out = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(c for c, f in zip(b, cover, strict=True) if not f).decode(errors="ignore")
        if not any(cover) or kept.strip(" "):
            out[d] = kept
    return out


def _mix(texts, source):
    """How often each document is taken: water filling by weights 5, 2, 1, then ids by their hash."""
    size = {d: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for d, t in texts.items()}
    names = sorted({source[d] for d in texts}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[d] for d in texts if source[d] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(own.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if 2 * own[s] <= level * weight[s]}
        if not full:
            break
        target |= {s: 2.0 * own[s] for s in full}
        left, free = left - sum(2 * own[s] for s in full), free - full
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for s in names:
        epochs = int(target[s] // own[s]) if own[s] else 0
        budget = math.floor(target[s]) - epochs * own[s]
        rest, after = budget, []
        for h, d in sorted((int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), d) for d in texts if source[d] == s):
            taken[d] += epochs
            if not after and size[d] <= rest:
                taken[d] += 1
                rest -= size[d]
            else:
                after.append((abs(rest - size[d]), h, size[d], d))
        fits = [x for x in after if 0 < x[2] < 2 * rest]
        if fits:
            taken[min(fits)[3]] += 1
    return +taken


def test_pipeline_stages_by_brute_force(spark, table):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r["doc_id"]: r for r in docs.collect()}
    source = {d: r["source"] for d, r in first.items()}
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    assert len(stages) == 5

    texts = {d: x for d, t in table.items() if (x := _clean(t)) is not None}
    wanted = [Counter(texts.items())]
    groups = _components(texts, 5, 80)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    wanted.append(Counter(texts.items()))
    texts = _without_repeats(texts)
    wanted.append(Counter(texts.items()))
    taken = _mix(texts, source)
    wanted.append(Counter({(d, texts[d]): n for d, n in taken.items()}))
    for stage, want in zip(stages[:4], wanted, strict=True):
        docs = spark.createDataFrame(rows := stage(spark, docs, SF).collect(), docs.schema)
        assert Counter((r["doc_id"], r["text"]) for r in rows) == want
        assert all(r[c] == first[r["doc_id"]][c] for r in rows for c in other)

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    pieces = Counter()
    for d, n in taken.items():
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        for i in range(0, len(ids), 4096):
            pieces[d, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())] += n
    rows = stages[4](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 4096)
    assert bound <= len(by_sequence) <= bound + 1


MARKED = [
    "<|endoftext|> is text", "a<|endoftext|>b  \n c", "One <|startoftext|>Two <|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", " <|endoftext|>\n<|endoftext|> ",
]


@pytest.mark.parametrize("name, words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_added_tokens_are_the_librarys(spark, table, name, words):
    """Against a tokenizer as it is loaded, in the cache that the operators use and in their results."""
    path = queries.tokenizer_path(name)
    library = Tokenizer.from_file(path)

    def of(text):
        return library.encode(text, add_special_tokens=False).ids

    mine = tokens.ids(path, words)
    for t in [*MARKED, *table.values(), *[t for _, t in ODD if t]]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == of(t)
    df = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    if words:
        got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.token_pieces(df, path).collect()}
    else:
        got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in rans.read_token_files(spark, rans.write_token_files(df, path)).collect()}
    ids = [np.array([*of(t), 1 if words else 2], "<u4") for t in MARKED]
    assert got == {d: (len(x), zlib.crc32(x.tobytes())) for d, x in enumerate(ids)}


@pytest.mark.parametrize("intervals", [rans.INTERVALS, 1])
def test_long_blocks_are_read_in_parts(spark, intervals):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = {d: f"short {d}" for d in range(40)}
    texts |= {7: " ".join(f"{i % 977} w{i % 89}" for i in range(90_000)), 20: "a b c " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    files = rans.write_token_files(df, path)
    want, start = {}, 0
    for d, t in sorted(texts.items()):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = rans.read_token_files(spark, files, intervals).collect()
    assert len(got) == len(texts) and {r["doc_id"]: tuple(r)[1:] for r in got} == want
    most = intervals * rans.LANES * rans.CHECKPOINT
    blocks = spark.read.parquet(f"{files}/blocks")
    parts = rans._parts(blocks.filter(f"n_ids > {most}"), intervals).select("part", "n_ids").collect()
    assert len(parts) > 1 and max(r["n_ids"] for r in parts) <= most
    blocks.withColumn("ids_crc32", blocks["ids_crc32"].bitwiseXOR(1)).write.parquet(f"{files}/bad/blocks")
    spark.read.parquet(f"{files}/shared").write.parquet(f"{files}/bad/shared")
    with pytest.raises(Exception, match="the checksum doesn't match"):
        rans.read_token_files(spark, f"{files}/bad", intervals).collect()
