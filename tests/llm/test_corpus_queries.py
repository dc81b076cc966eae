"""The registered corpus queries against DuckDB, and the pipeline against its stages' brute force."""

import oracle
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    n, off = oracle.compare(spark, oracle.connect(AT), QUERIES[name], ORACLE_SQL[name], AT)
    assert n and not off


def test_tokenizer_counts(spark):
    """By the tokenizer libraries, over the first document of each text."""
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    path, words = P.path("byte_bpe_multi_50k.tiktoken"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pieces = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, seen = {}, set()
    for source, lang, t in oracle.connect(AT).sql("select source, lang, coalesce(text, '') from documents order by doc_id").fetchall():
        if t not in seen:
            seen.add(t)
            for key, n in (("word_bpe_49k", len(words.encode(t, add_special_tokens=False).ids) + 1), ("byte_bpe_multi_50k", len(pieces.encode_ordinary(t)))):
                docs, tokens = want.get((source, lang, key), (0, 0))
                want[source, lang, key] = docs + 1, tokens + n
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in QUERIES["op5_token_counts"](spark, AT).collect()}
    assert got == want


def test_counts_are_revised(spark, monkeypatch):
    """A batch of rollup_of_counters and of op5_token_counts changes totals of a version that is there already."""
    from lodestone.llm import token_rollup

    for name, key in (("rollup_of_counters", "words-2"), ("op5_token_counts", "word_bpe_49k")):
        totals, commit = [], token_rollup.TokenRollup.commit

        def watched(self, *batch, commit=commit, totals=totals, key=key):
            done = commit(self, *batch)
            totals.append(sum(r.n_tokens for r in self.totals().where(f"tokenizer = '{key}'").collect()))
            return done

        with monkeypatch.context() as m:
            m.setattr(token_rollup.TokenRollup, "commit", watched)
            QUERIES[name](spark, AT)
        assert totals[0] and totals[0] != totals[1] > totals[2] == totals[3]


def test_pipeline(spark):
    """The stages by plain Python, but for the classifier, whose verdicts are those of its own query."""
    import re

    import tiktoken

    import corpus_pipeline
    from lodestone.llm import byte_bpe, simhash

    con = oracle.connect(AT)
    docs = dict(con.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    good = {r.doc_id for r in QUERIES["op2_quality"](spark, AT).where("predicted = 1").collect()}
    docs = {i: t for i, t in sorted(docs.items()) if i in good}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    owner = {}
    for i, t in docs.items():
        for x in t.split("\n"):
            owner.setdefault(key(x), i)
    docs = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i, t in docs.items()}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in docs.items()}
    root = {i: i for i in docs}
    for _ in range(20):
        for a in docs:
            for b in docs:
                if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    docs = {i: t for i, t in docs.items() if root[i] == i}
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
    windows = {tuple(w[a : a + 10]) for (t,) in con.sql("select text from benchmark").fetchall() for w in [words(t)] for a in range(max(len(w) - 9, 1))}
    docs = {i: t for i, t in docs.items() if not windows & {tuple(w[a : a + 10]) for w in [words(t)] for a in range(len(w) - 9)}}
    bpe = byte_bpe.ByteBPE.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, AT).collect()}
    assert got == {i: len(own.encode_ordinary(t)) for i, t in docs.items()}


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, and columns that the stages use as names of their own."""
    import corpus_pipeline

    line = "a line that two documents share, word by word"
    texts = [(None, "no id, but a text of its own"), (None, None), (1, f"{line}\nfirst of them"), (2, f"{line}\nsecond, another one"), (2, "the same id with other words"), (3, ""), (4, "Word " * 50_000), (4, "Word " * 50_000), (5, None)]
    rows = [(i, t, "en", "s", len(t or ""), 7, 8, 9, "g", 0.5) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, tag int, fp string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the same id with other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns or name == "byte-level BPE"
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(sorted(docs.collect(), key=repr))
    good, lines, single, clean, ids = seen
    assert len(good) == len(rows)
    assert [r.text for r in lines if r.doc_id == 2] == ["second, another one", "the same id with other words"] and all((r.n_lines, r.n_dropped, r.tag, r.score) == (7, 8, 9, 0.5) for r in lines)
    assert all(r.n_chars == len(r.text) for r in lines) and len(lines) == len(rows)
    # One of the empty ones, the one of the smallest id, and one of the two equal ones are left.
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text)) for r in single) == sorted((i is None, i or 0, len(t)) for i, t in [(None, texts[0][1]), (1, texts[2][1]), (2, "second, another one"), (2, texts[4][1]), (3, ""), (4, texts[6][1])])
    assert len(clean) == 5 and "the same id with other words" not in {r.text for r in clean} and len(ids) == 5
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, ids))
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
