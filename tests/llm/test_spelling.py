"""Spelling variants against all pairs, with odd rows among them."""

import itertools
import random
import re
import zlib
from collections import Counter

from lodestone.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, key string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, drop=None):
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{id_}:{run}".encode()) if id_ is not None else 1
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: set() for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    root = {}
    for w in words:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return {(w, n, len(near[w]), form[w], words.get(form[w]), root[w]) for w, n in words.items()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(150)]
    words = [*base, *("nana" * 3, "nana" * 3 + "n", "aaaaa", "aaaaaa", "aaaaaaa", "aabaaa", "colour", "color", "colours", "colöur", "Éclair", "éclair", "eclair", "x×y÷zz", "abcd", "abcdé")]
    texts = [(i, " ".join(rng.choices(words, k=60))) for i in range(80)]
    texts += [(None, "colour colour color color color"), (90, None), (91, ""), (92, " \n"), (93, "日本colour語color œcolours Ǎcolour"), (94, "longer" * 5000 + " " + "colour " * 3000), texts[0], (7, "another of id seven, colour")]
    docs = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in texts], SCHEMA)
    for drop in (None, 97, 3):
        got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(docs, drop).collect()}
        want = plain(texts, drop)
        assert not got ^ want, sorted(got ^ want)[:20]
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    """A chain of forms of doubling counts, of more steps than two rounds take; ties go to the smallest word."""
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    rows = [(w, 3 * 2**k) for k, w in enumerate(chain)] + [("zzzzz", 3), ("zzzzb", 6), ("zzzza", 6), ("other", 3)]
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert all(got[w][:2] == (chain[k + 1], chain[-1]) for k, w in enumerate(chain[:-1]))
    assert got["zzzzz"] == ("zzzza", "zzzza", 2) and got["other"] == (None, "other", 0) and got["bbbbbb"][:2] == (None, "bbbbbb")


def test_keys_of_near_words_meet():
    """Whatever the order of bigrams: any two words one edit apart share a key."""
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(5, 9)))
        at, c = rng.randrange(len(a) + 1), rng.choice("abc")
        b = a[:at] + c + a[at + rng.randint(0, 1) :]
        if len(b) >= 5 and one_edit(a, b):
            grams = sorted({w[p : p + 2] for w in (a, b) for p in range(len(w) - 1)})
            rng.shuffle(grams)
            rank = {g: i for i, g in enumerate(grams)}
            assert spelling.keys_of(a, rank) & spelling.keys_of(b, rank)


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    docs = spark.createDataFrame([(i, f"colour{chr(97 + i % 7)} shared words here") for i in range(50)], "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got["shared"] == got["words"] == 50 and got["coloura"] == 8
