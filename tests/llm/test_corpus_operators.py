"""The corpus operators against brute force, on small tables with the odd cases in them."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.llm import byte_bpe, common, decontamination, line_dedup, perplexity, quality, simhash, token_files, token_rollup, url_filter, warc

ODD = ["", None, "  \n\t", "one", "One", "a b c d e f", "a b c d e f", "é ½ Ⅷ x²3 日本語 <|endoftext|>x don't  ", "x" * 3000, "ab " * 2000, "The quick brown fox jumps over the lazy dog again and again\nshared line of text\n", "shared line of text\nother\n SHARED line of text \n", "\n\n", "tail without end\nshared line of text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, tag long, item_id long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None, None, 1.0, 2, 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and simhash.near_duplicates(none).count() == 0
    want = {i: plain_fingerprint(t) for i, t in enumerate(ODD)}
    root = {i: i for i in want}
    for _ in want:
        for a, b in itertools.combinations(want, 2):
            if (want[a] ^ want[b]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{want[r.doc_id]:016x}", root[r.doc_id])
    kept = simhash.first_of_each(docs.where("doc_id is not null"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == docs.columns


def test_first_of_each_keeps_null_and_repeated_ids(spark):
    """Each text stands for itself whatever its id; of a group the smallest id stays, null ones last."""
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black grey", "north south east west up down")
    rows = [(None, a), (None, b), (7, b), (1, c), (1, d), (2, c), (None, a), (1, d)]
    want = sorted([("None", a), ("7", b), ("1", c), ("1", d)])
    for order in (rows, rows[::-1]):
        got = simhash.first_of_each(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == want


def test_crowds_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    for _ in range(150):
        x = centre
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(1 << 62, size=100)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    nodes = [x for x, in signed]
    group = {x: x for x in nodes}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in nodes)


def test_anchors_cover_all_close_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 62, size=40)
    rows = []
    for x in base.tolist():
        y = x
        for b in rng.choice(62, 4, replace=False):
            y ^= 1 << int(b)
        rows += [(x,), (y,)]
    at = {}
    for r in simhash.anchors(spark.createDataFrame(rows, "fp long")).collect():
        at.setdefault(r.fp, set()).add(r.anchor)
    assert all(at[a[0]] & at[b[0]] for a, b in zip(rows[::2], rows[1::2], strict=True))


def test_quality(spark, docs, none):
    good = [(i, f"Plain words of text number {i} stand here in order, and more of them follow below.") for i in range(300)]
    bad = [(i, f"WORDS!! {i}!! SHOUTED!! LOUD!! {i * 7}!! AGAIN!!") for i in range(300, 450)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(train, labels).collect()
    assert all(r.predicted == int(r.doc_id < 300) for r in got if r.held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert quality.quality(docs, labels).count() == docs.count() and quality.quality(none, labels).count() == 0
    assert all(r.score == 0.5 for r in quality.quality(train, labels.limit(0)).collect())
    assert quality.accepted(docs, labels).columns == docs.columns


def test_trees_against_all_splits():
    """A step of two leaves is the split of the largest gain among all; more leaves go on from there."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        gain = lambda k: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 1) for a, b in ((0, k), (k, 9)))
        k = max(range(1, 9), key=gain)
        want = np.repeat([g[:k].sum() / (h[:k].sum() + 1), g[k:].sum() / (h[k:].sum() + 1)], [k, 9 - k])
        assert np.allclose(quality._tree(g, h, 2), want)
        assert len(np.unique(quality._tree(g, h, 3))) == 3


def test_additive_model_by_plain_loops():
    """Scores are sums of table entries; a label that two features make together is learned by their pair alone."""
    import math

    rng = np.random.default_rng(10)
    x = np.column_stack([rng.random(2000), rng.random(2000), rng.integers(0, 2, 2000), np.ones(2000)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs] and (0, 1) == max(model.pairs, key=lambda p: np.abs(p[2]).sum())[:2]
    got = model.score(x)
    for row, score in zip(x[:200].tolist(), got[:200], strict=True):
        bins = [sum(c <= v for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        logit = model.start + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-9
    assert ((got >= 0.5) == (y == 1)).mean() > 0.93
    # The same model whatever the order of the rows, repeated ones among them.
    mixed = rng.permutation(2000)
    assert np.allclose(quality.fit(x[mixed], y[mixed]).score(x), got)


def test_url_filter(spark):
    urls = [f"http://{'spam-farm' if i % 3 == 0 else 'blog'}.example.com/en/{i}" for i in range(90)]
    labelled = spark.createDataFrame([(u, "spam" in u) for u in urls] + [(None, True)], "url string, block boolean")
    odd = [None, "no mark", "http://A.NET/x", "http://net/", "http://net?x", "http://x.example.net/en/1", "http://example.com/de/1", "http://u@example.org/fr/a?b", "https://spam-farm.example.org/zz", "x://h", "https://spam-farm.example.net/"]
    pages = spark.createDataFrame(list(enumerate(odd)) + [(1, odd[2])], "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labelled).orderBy("page_id", "host").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/x", "net/", "block"), ("a.net", "/x", "net/", "block"), ("net", "/", "net/", "block"), ("net", "", None, "allow"),
        ("x.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/1", "example.com/de/", "block"), ("u@example.org", "/fr/a", "org/fr/", "allow"),
        ("spam-farm.example.org", "/zz", None, "block"), ("h", "", None, "allow"), ("spam-farm.example.net", "/", "net/", "block"),
    ]
    assert url_filter.judge(pages.limit(0), labelled).count() == 0 and url_filter.judge(pages, labelled.limit(0)).count() == 12


def test_url_rules_of_four_tokens(spark):
    """Any three of the four segments are unsure, all four are sure; what contains them adds no rule."""
    four = ("p", "q", "r", "s")
    rows = [(f"http://h/{'/'.join(four)}/{i % 2}", True) for i in range(30)] + [(f"http://h/{'/'.join(x)}/{i % 2}", False) for x in itertools.combinations(four, 3) for i in range(20)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert [sorted(r.antecedent) for r in rules.collect()] == [[f"path {x}" for x in four]]
    pages = spark.createDataFrame([(1, "http://other/s/r/q/p"), (2, "http://h/p/q/r")], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(rows, "url string, block boolean")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow"}


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, none, encoding, tmp_path):
    from tokenizers import Tokenizer

    path, own = P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    token_files.write_tokens(docs.where("doc_id is not null"), str(tmp_path / "t"), path, encoding)
    got = sorted(token_files.token_digests(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        ids = np.array([*own.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r.doc_id for r in got] == sorted([*range(len(ODD)), 5])
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == len(got)
    token_files.write_tokens(none, str(tmp_path / "n"), path)
    assert token_files.token_digests(spark, str(tmp_path / "n")).count() == 0


def test_token_file_layout(spark, monkeypatch, tmp_path):
    """Encodings, row groups and page indexes are in the files, and a reader asks for what it wants only."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "ROW_GROUP_BYTES", 64 << 10)
    monkeypatch.setattr(token_files, "PAGE_BYTES", 4 << 10)
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 150))) for i in range(1500)], "doc_id long, text string").coalesce(1)
    for encoding, mark in (("dictionary", "PLAIN_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = str(tmp_path / encoding)
        token_files.write_tokens(docs, path, P.path("word_bpe_49k.json"), encoding)
        groups = [pq.ParquetFile(f).metadata.row_group(g) for f in sorted((tmp_path / encoding).glob("*.parquet")) for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
        ids = [g.column(1) for g in groups if g.num_rows]
        assert len(ids) > 2 and all(mark in c.encodings and c.has_offset_index and c.has_column_index for c in ids)
        some = spark.read.parquet(path).where("doc_id = 700").select("n_tokens")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(doc_id,700)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and some.count() == 1
        part = token_files.read_tokens(spark, path).where("doc_id in (3, 1499)").orderBy("doc_id").collect()
        assert [len(r.ids) for r in part] == [r.n_tokens for r in part] and part[0].ids[-1] == token_files.END_ID
    with pytest.raises(ValueError, match="encoding"):
        token_files.write_tokens(docs, str(tmp_path / "x"), P.path("word_bpe_49k.json"), "plain")
    with pytest.raises(ValueError, match="lower-cased"):
        token_files.WordEncoder(P.path("byte_bpe_50k.json"))


def test_file_numbers_are_numbers(spark, tmp_path):
    """File 100000 comes after file 99999."""
    for number, doc, n in ((99999, 1, 2), (100000, 2, 3)):
        out = tmp_path / str(number)
        spark.createDataFrame([(doc, list(range(n)), n)], "doc_id long, ids array<int>, n_tokens long").coalesce(1).write.parquet(str(out))
        (tmp_path / "all").mkdir(exist_ok=True)
        next(out.glob("part-*.parquet")).rename(tmp_path / "all" / f"part-{number:05d}-x.parquet")
    assert {r.doc_id: r.start for r in token_files.token_digests(spark, str(tmp_path / "all")).collect()} == {1: 0, 2: 2}


def test_byte_bpe(spark, docs, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.round_trip(docs, path, P.PATTERN).collect():
        t = "no id here" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = np.array(own.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.round_trip(none, path, P.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in back.where("doc_id is not null").collect()} == {i: t or "" for i, t in enumerate(ODD)}
    bpe = byte_bpe.ByteBPE.from_file(path, P.PATTERN)
    rng = np.random.default_rng(3)
    for _ in range(300):
        piece = bytes(rng.choice(list(b"etaoin shrdluETA01.,\xc3\xa9"), rng.integers(1, 40)))
        assert bpe.encode_piece(piece) == own._encode_single_piece(piece)


def plain_basics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_rules(spark, docs, none):
    got = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    for i, t in enumerate(ODD):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_basics((t or "").replace("ab " * 2000, "ab " * 2000)), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert perplexity.quality_rules(none).count() == 0


def plain_log_perplexity(texts):
    """A word of each text of a language, by modified Kneser-Ney over grams of five code points, without numpy or Spark."""
    import math

    counts, holders = Counter(), {}
    for t in texts:
        for i in range(len(t)):
            g = ("\n" * 4 + t)[i : i + 5]
            counts[g] += 1
            holders.setdefault(g, set()).add(t)
    orders = {5: (counts, holders)}
    for size in range(4, 0, -1):
        of, by = Counter(), {}
        for g in orders[size + 1][0]:
            of[g[1:]] += 1
            by.setdefault(g[1:], set()).update(orders[size + 1][1][g])
        orders[size] = of, by
    p, others = {}, {}
    for size in range(1, 6):
        of, by = orders[size]
        n = {k: sum(v == k for v in of.values()) for k in range(1, 5)}
        cut = {k: min(k - 0.05, max(0.1, k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[k] and n[1] else 0.5)) for k in (1, 2, 3)}
        total, free, holding = Counter(), Counter(), {}
        for g, v in of.items():
            total[g[:-1]] += v
            free[g[:-1]] += cut[min(v, 3)]
            holding.setdefault(g[:-1], set()).update(by[g])
        for g, v in of.items():
            c, below, below_others = g[:-1], *((p[g[1:]], others[g[1:]]) if size > 1 else (1 / len(of), 1 / len(of)))
            p[g] = (v - cut[min(v, 3)] + free[c] * below) / total[c]
            others[g] = p[g] if len(by[g]) > 1 else (free[c] / total[c] if len(holding[c]) > 1 else 1.0) * below_others
    return {t: -sum(math.log(others[("\n" * 4 + t)[i : i + 5]]) for i in range(len(t))) / len(t.split()) for t in texts}


def test_log_perplexity_and_bands_by_plain_python(spark):
    rng = np.random.default_rng(7)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(60)] for lang, letters in (("en", "etaoinshr"), (None, "абвгдежз"))}
    rows = [(lang, " ".join(rng.choice(words[lang], 70))) for lang in words for _ in range(25)]
    rows += [rows[3], rows[3], ("en", " ".join(f"q{i}x#" for i in range(70))), ("en", "short"), ("en", ""), ("en", None), (None, " ".join(rng.permutation(list("абвгдежз" * 50))))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    got = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    rejected = 0
    for lang in words:
        texts = [t for x, t in rows if x == lang and t]
        want = plain_log_perplexity(texts)
        at = lambda xs: sorted(xs)[-(-len(xs) // 2) - 1]
        middle = at([want[t] for t in texts])
        spread = at([abs(want[t] - middle) for t in texts])
        low, high = (middle + sign * max(perplexity.LEAST_WIDTH, times * spread) for sign, times in ((-1, perplexity.BELOW), (1, perplexity.ABOVE)))
        for i, (x, t) in enumerate(rows):
            if x == lang and t:
                assert abs(got[i].log_perplexity - want[t]) < 1e-5
                inside = low <= want[t] <= high
                assert got[i].kept == (inside and not got[i].base_failed), i
                rejected += not inside and not got[i].base_failed
    assert rejected and not any(got[i].kept or got[i].log_perplexity is not None for i, (_, t) in enumerate(rows) if not t)


def test_model_pieces(spark, monkeypatch):
    """Keys are found in files of several pieces, and only where they are."""
    path = common.scratch(spark, "pieces")
    keys = np.random.default_rng(8).integers(-(2**62), 2**62, 50_000)
    rows = spark.createDataFrame([(int(k), float(i % 97)) for i, k in enumerate(keys)], "key long, logp float")
    rows.repartitionByRange(3, "key").sortWithinPartitions("key").write.option("parquet.block.size", 50_000).parquet(path)
    some = np.sort(keys[::7])
    of = dict(zip(keys.tolist(), (np.arange(50_000) % 97).tolist(), strict=True))
    model = perplexity.SortedArrays(path)
    assert len(model.pieces) > 3 and model.find(some).tolist() == [of[k] for k in some.tolist()]
    assert np.isnan(model.find(np.array([5, 2**63 - 1]))).all() and len(model.find(some[:0])) == 0


@pytest.mark.parametrize("told", [True, False])
def test_units_are_answered(spark, monkeypatch, told):
    """Units that find their answers and units that don't are scored alike, over many ranges of keys."""
    rng = np.random.default_rng(12)
    rows = [(i, "".join(rng.choice(list("etaoin é日"), 300)), ("en", "de", None)[i % 3]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None, "en"), (61, "", None)], "doc_id long, text string, lang string").repartition(7, "doc_id")
    want = {r.doc_id: r.log_perplexity for r in perplexity.quality_rules(docs).collect()}
    monkeypatch.setattr(perplexity, "RANGE_GRAMS", 100)
    monkeypatch.setattr(perplexity, "UNIT_BYTES", 2000)
    asked, answers = [], perplexity.answers
    monkeypatch.setattr(perplexity, "answers", lambda rows, *a: asked.append(answers(rows if told else rows.where("doc_id % 2 = 0"), *a)) or asked[-1])
    got = {r.doc_id: r.log_perplexity for r in perplexity.quality_rules(docs).collect()}
    assert set(got) == set(want) and all(got[i] is None if x is None else abs(got[i] - x) < 1e-6 for i, x in want.items())
    assert spark.read.parquet(asked[0]).select("unit").distinct().count() > 4


def test_perplexity_rejects_the_odd_one(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(80)]
    text = lambda: " ".join(rng.choice(words, 120))
    rows = [(i, text(), "en") for i in range(80)] + [(99, " ".join(rng.permutation([f"{a}{b}#*{c}" for a in "QXZ" for b in "jkv" for c in range(12)])), "en")]
    got = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and sum(not v for v in got.values()) == 1


def test_perplexity_sees_other_scripts(spark):
    """Words whose letters are shuffled, of the same lengths, are found out in any script."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("абвгдежзиклмнопрсту"), rng.integers(3, 8))) for _ in range(80)]
    text = lambda: list(rng.choice(words, 150))
    shuffled = lambda w: "".join(rng.permutation(list(w)))
    rows = [(i, " ".join(text()), "ru") for i in range(80)] + [(99, " ".join(map(shuffled, text())), "ru")]
    got = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and sum(not v for v in got.values()) == 1


def test_code_point_model(spark, docs):
    """The probabilities after each context of seen grams, by plain sums, and the counts of all grams."""
    rows = docs.where("lang = 'en'").select("lang", "text")
    pad = "\n" * (perplexity.POINTS - 1)
    want = Counter((pad + t.text)[i : i + perplexity.POINTS] for t in rows.collect() for i in range(len(t.text or "")))
    counted = perplexity.count_points(rows)
    assert {r.gram: r.n for r in counted.collect()} == want
    model = {(r["size"], r.gram): r.logp for r in perplexity.kneser_ney(counted).where("logp is not null").collect()}
    assert {g for size, g in model if size == perplexity.POINTS} == set(want)
    sums = Counter()
    for (size, gram), logp in model.items():
        sums[size, gram[:-1]] += np.exp(logp)
    assert abs(sums[1, ""] - 1) < 1e-6 and all(0 < x < 1 + 1e-6 for x in sums.values())


def test_warc(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://b.com/x?y", big), (2, "http://a.com/", "small"), (3, "http://a.com/", "small"), (4, None, None), (5, "http://b.com/x y", big), (6, "http://c.b.com", "é" * 600), (5, "http://b.com/x y", big), (None, "http://n.com", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived(pages).orderBy("part", "at").collect()
    assert [r.key for r in got] == sorted(r.key for r in got) and len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (1, 3, 5)} == {(1, "revisit", 5), (3, "response", None), (5, "response", None)}
    assert warc.archived(pages.limit(0)).count() == 0
    for k in range(1, 9):
        runs = [sorted(({"key": f"{(i * 7 + j * j) % 23:02d}"} for i in range(j)), key=lambda r: r["key"]) for j in range(k)]
        merged = [r["key"] for r in warc.loser_tree([iter(r) for r in runs])]
        assert merged == sorted(x["key"] for r in runs for x in r)


def test_many_runs_are_merged_in_rounds(spark, monkeypatch):
    """Runs are merged two at a time, in ranges of a few rows; keys of one url stand in several runs."""
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 900)
    monkeypatch.setattr(warc, "SAMPLE", 2)
    monkeypatch.setattr(warc, "RANGE_ROWS", 5)
    rows = [(i, f"http://h{i % 7}.com/{i % 3}", f"t{i}", "a", 1) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, part int").repartition(3)
    folder = common.scratch(spark, "t")
    runs_folder, samples = warc.read_archives(spark, folder, warc.write_archives(pages, folder))
    assert samples.where("at = 0").count() > 4 and samples.agg(F.sum("n")).first()[0] == 60
    got = warc.capture_histories(spark, runs_folder, samples).orderBy("part", "at").collect()
    assert [r.key for r in got] == sorted(r.key for r in got) and sorted(r.page_id for r in got) == list(range(60))
    assert max(r.part for r in got) >= 4 and max(Counter(r.part for r in got).values()) < 60


def test_warc_with_clashing_columns(spark):
    rows = [(i, f"http://h.com/{i}", "y" * 1500, "d", "s", 1, 2, "r") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, shared string, last int, n int, refers_to string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_report(pages).collect()}
    assert got == {i: ("revisit", 3) for i in range(3)} | {3: ("response", None)}


@pytest.mark.parametrize("broadcast", [common.BROADCAST_ROWS, 0])
def test_decontamination(spark, docs, none, broadcast, monkeypatch):
    """Whether sides are broadcast or shuffled."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", broadcast)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again"), (20, "A, b c! d e f"), (3, "one"), (4, "..."), (None, "one"), (5, None), (6, "absent words here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    items = {r.item_id: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(r.text)) for r in bench.collect() if r.item_id}
    for i, t in enumerate(ODD):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
        hit, found = set(), set()
        for k, x in items.items():
            for a in range(max(len(x) - 9, 1) if x else 0):
                win = x[a : a + 10]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        found.add(str(k))
                        hit |= set(range(at, at + len(win)))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert len(decontamination.decontaminate(docs, bench).collect()) == docs.count()
    assert decontamination.decontaminate(none, bench).count() == 0 and not decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    assert decontamination.clean(docs, bench).columns == docs.columns


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_line_dedup(spark, docs, none, batches):
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    owner = {}
    for i, t in enumerate(ODD):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), i)
    got = line_dedup.line_digests(docs, batches).collect()
    for r in got:
        t = "no id here" if r.doc_id is None else ODD[r.doc_id] or ""
        kept = [x for x in t.split("\n") if r.doc_id is None or len(key(x)) < 10 or owner[key(x)] == r.doc_id]
        n = len(t.split("\n"))
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), r.doc_id
    assert len(got) == docs.count() and line_dedup.line_digests(none, batches).count() == 0
    assert line_dedup.without_repeats(docs, batches).columns == [*docs.columns, "n_lines", "n_dropped"]
    own = line_dedup.without_repeats(docs.withColumn("n_lines", F.lit(5)), batches, counts=None)
    assert own.columns == [*docs.columns, "n_lines"] and own.where("n_lines = 5").count() == docs.count()


def test_line_runs_outlive_a_call(spark):
    """A second call with the same folder drops the lines of the first one's documents; runs are read without a sort."""
    store = common.scratch(spark, "store")
    lines = [f"a line of text, number {i}" for i in range(6)]
    first = spark.createDataFrame([(1, "\n".join(lines[:3])), (2, lines[0])], "doc_id long, text string")
    then = spark.createDataFrame([(3, "\n".join(lines[1:5])), (4, lines[4]), (5, lines[5])], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(first, 2, store).collect()} == {1: "\n".join(lines[:3]), 2: ""}
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(then, 2, store).collect()} == {3: "\n".join(lines[3:5]), 4: "", 5: lines[5]}
    runs = line_dedup.LevelledRuns(spark, store)
    assert sum(map(len, runs.levels)) == 2  # three of the lowest level are one of the next
    merged = spark.read.parquet(f"{store}/{runs.levels[1][0]}").select(F.input_file_name().alias("f"), "h1", "h2")
    assert merged.groupBy(F.expr("pmod(hash(h1, h2), 8)")).agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0
    assert {(r.h1, r.h2) for df in runs.runs() for r in df.collect()} == {(r.h1, r.h2) for r in line_dedup.hashed_lines(first.unionByName(then)).collect()}
    keys = line_dedup.hashed_lines(then).groupBy("h1", "h2").count()
    plan = runs.fresh(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    runs.forget()


def test_rollup(spark, docs):
    counters = {"v1": F.length("text")}
    r = token_rollup.TokenRollup(spark)
    assert r.totals().count() == 0
    assert r.commit("a", token_rollup.inserts(docs, counters)) and not r.commit("a", token_rollup.inserts(docs, counters))
    total = sum(len(t or "") for t in ODD) + len(ODD[5]) + len("no id here")
    assert r.totals().agg(F.sum("n_tokens"), F.sum("n_docs")).first() == (total, docs.count())
    r.commit("b", token_rollup.revisions(docs.where("doc_id = 3"), counters, {"v1": F.lit(10)}))
    r.commit("c", token_rollup.deletes(docs.where("doc_id = 8"), counters))
    again = token_rollup.TokenRollup(spark, r.path)
    assert again.version == 2 and again.totals().agg(F.sum("n_tokens"), F.sum("n_docs")).first() == (total + 7 - 3000, docs.count() - 1)
    assert not again.commit("a", token_rollup.inserts(docs, counters))


def test_rollup_of_two_writers(spark, docs):
    """The one that comes second adds its batch to what the first has written; old versions go, the last stay whole."""
    counters, row = {"v1": F.lit(1)}, docs.where("doc_id = 0")
    a = token_rollup.TokenRollup(spark)
    a.commit("0", token_rollup.inserts(row, counters))
    b = token_rollup.TokenRollup(spark, a.path)
    assert a.commit("1", token_rollup.inserts(row, counters)) and b.commit("2", token_rollup.inserts(row, counters))
    assert b.version == 2 and not b.commit("1", token_rollup.inserts(row, counters))
    for i in range(3, 6):
        b.commit(str(i), token_rollup.inserts(row, counters))
    assert token_rollup.TokenRollup(spark, a.path).totals().agg(F.sum("n_docs")).first()[0] == 6


def plain_tokens(url):
    h, p = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    labels = [x for x in low(h).split(".") if x]
    parts = [y for x in labels if "-" in x for y in x.split("-") if y]
    return {*(f"host {x}" for x in labels), *(f"part {x}" for x in parts), *(f"path {x}" for x in re.split("[/.]", low(p)) if x), *(f"query {x}" for x in re.findall(r"[?&]([^=&#]+)", url))}


def test_mined_rules_against_all_itemsets(spark):
    """Every set of items of the labelled urls is counted; a url is blocked if a sure and frequent one is in it."""
    rng = np.random.default_rng(6)
    words = ["shop", "blog", "win-now", "cheap", "news", "a", "b"]

    def url():
        w = list(rng.choice(words, 4))
        return f"http://{w[0]}.{w[1]}.long.host.of.many.labels.com/{w[2]}/{w[3]}?{'x' if rng.random() < 0.5 else 'y'}=1"

    urls = [url() for _ in range(400)]
    blocked = [("cheap" in u and "?x" in u) or ("win-now" in u.split("/")[2] and "a" in u.split("?")[0].split("/")[3:]) or rng.random() < 0.05 for u in urls]
    rows = [plain_tokens(u) for u in urls]
    places = {t: frozenset(i for i, r in enumerate(rows) if t in r) for r in rows for t in r}
    item = {t: min(x for x in places if places[x] == at) for t, at in places.items() if 8 <= len(at) < len(rows)}
    sets, block = [frozenset(item[t] for t in r if t in item) for r in rows], set(np.flatnonzero(blocked))
    sure = []
    for size in range(1, 9):
        for s in {frozenset(c) for r in sets for c in itertools.combinations(sorted(r), size)}:
            at = set.intersection(*(set(places[x]) for x in s))
            both = at & block
            if len(both) >= 8 and len(both) >= 0.8 * len(at) and len(both) / len(at) > len(block) / len(rows) and not any(x < s for x in sure):
                sure.append(s)
    labelled = spark.createDataFrame([(u, bool(b)) for u, b in zip(urls, blocked, strict=True)], "url string, block boolean")
    assert {frozenset(r.antecedent) for r in url_filter.mine(labelled).collect()} == set(sure) and len(sure) >= 3
    asked = urls + [url() for _ in range(100)] + ["http://cheap.net?x=1", "http://other.org/cheap?x", "http://now.com/a/"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string").withColumn("token", F.lit("t")).withColumn("rule", F.lit(1))
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled, ()).collect()}
    for i, u in enumerate(asked):
        mine = {item[t] for t in plain_tokens(u) if t in item}
        assert (got[i] == "block") == any(s <= mine for s in sure), u
