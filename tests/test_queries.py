"""Every query with an SQL form gives the same rows as DuckDB; the others give rows."""

import re
import unicodedata
from datetime import datetime

import oracle
import pytest
from pyspark.sql import functions as F

from lodestone.plans.registry import ORACLE_SQL, QUERIES

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(AT)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        _, off = oracle.compare(spark, con, QUERIES[name], ORACLE_SQL[name], AT)
        assert not off
    else:
        assert QUERIES[name](spark, AT).take(1)


def test_planted_text_is_found(spark):
    assert QUERIES["redact"](spark, AT).where("text like '%REDACTED_AWS_KEY%'").count()
    assert QUERIES["scan_flags"](spark, AT).where("flags like '%embedded%'").count()


def test_queries_are_searched_too(spark, tmp_path):
    """The best partner of a query may be another query, but not itself."""
    rows = [(0, 1, [1.0, 0.0]), (20, 1, [1.0, 0.1]), (3, 1, [1.0, 1.0]), (40, 2, [1.0, 0.0]), (60, 2, [0.9, 0.1]), (80, 3, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.query_id: r.entry_id for r in QUERIES["cache_partners"](spark, str(tmp_path)).collect()} == {0: 20, 20: 0, 40: 60, 60: 40}


def letter(c):
    return unicodedata.category(c)[0] == "L"


def heading(line):
    """Whether a line is a heading, in plain Python."""
    from lodestone.functions.text import HEADING_CHARS, HEADING_WORDS, TERMINAL

    s = line.strip(" ")
    first = next(filter(letter, s), "")
    return bool(first) and len(s) <= HEADING_CHARS and len(re.split(r"[ \t\n\x0b\f\r]+", s)) <= HEADING_WORDS and s[-1] not in TERMINAL and not re.match("[a-z]", first)


def test_whole_texts_are_read(spark, con):
    """document_sections and reflowed_documents against plain Python, over the raw texts and what is planted after them."""
    from lodestone.plans.registry import CATALOG, WRAPPED

    def reflowed(t):
        small = lambda c: unicodedata.category(c) == "Ll"
        t = re.sub(r"(.)-\n(?=(.))", lambda m: m[1] if letter(m[1]) and small(m[2]) else m[0], t)
        return re.sub(r"(?<![.!?:;\n])\n(?=(.))", lambda m: " " if small(m[1]) or m[1] in "0123456789(" else m[0], t)

    sections, texts = set(), {}
    for doc_id, raw in con.sql("select doc_id, coalesce(text, '') from documents").fetchall():
        texts[doc_id] = reflowed(raw + WRAPPED)
        n, name, body = 0, None, []
        for line in [*(raw + CATALOG).split("\n"), None]:
            if line is None or heading(line):
                if n and body:
                    sections.add((doc_id, n, name, "\n".join(body)))
                n, name, body = n + 1, (line or "").strip(" "), []
            elif line.strip(" "):
                body.append(line.strip(" "))
    assert {tuple(r) for r in QUERIES["document_sections"](spark, AT).collect()} == sections
    assert {r.doc_id: r.text for r in QUERIES["reflowed_documents"](spark, AT).collect()} == texts


def plain_pieces(text, size=800, overlap=120, separators=None):
    """The recursive split by a plain loop over the parts, each time from their sum."""
    from lodestone.operators.chunking import SEPARATORS

    separators = SEPARATORS if separators is None else separators
    if not text.strip():
        return []
    sep = next(x for x in separators if x in text)
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if not sep else [text.split(sep)[0], *(sep + x for x in text.split(sep)[1:])]
    out, held = [], []
    for part in [*parts, None]:
        if part is None or (len(part) > size and rest) or (held and len("".join(held)) + len(part) > size):
            out += ["".join(held).strip()] if "".join(held).strip() else []
        if part is None:
            break
        if len(part) > size and rest:
            held = []
            out += plain_pieces(part, size, overlap, rest)
            continue
        if held and len("".join(held)) + len(part) > size:
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(part) > size):
                held = held[1:]
        held = [*held, part]
    return out


def test_splits_by_plain_python(spark, con):
    """recursive_split and chunked_documents over the whole texts."""
    import hashlib

    from lodestone.plans.registry import CATALOG

    whole, chunks = set(), set()
    for doc_id, raw in con.sql("select doc_id, coalesce(text, '') from documents").fetchall():
        whole |= {(doc_id, i, x) for i, x in enumerate(plain_pieces(raw))}
        t, found = raw + (CATALOG if doc_id % 3 == 0 else ""), []
        for line in t.split("\n"):
            if heading(line):
                found.append((line.strip(" "), []))
            elif found and line.strip(" "):
                found[-1][1].append(line.strip(" "))
        found = [(h, "\n".join(lines)) for h, lines in found if lines]
        units = []
        for h, body in found if len(found) > 1 else ():
            led = lambda x, h=h: x if x.lower().startswith(h.lower()) else f"{h} — {x}"
            units += [(h, led(body))] if len(led(body)) <= 800 else [(h, led(x)) for x in plain_pieces(body)]
        units = units or [(None, x) for x in plain_pieces(t)]
        chunks |= {(doc_id, doc_id % 4 + 1, i, f"{doc_id}-{hashlib.sha1(f'{doc_id}:{doc_id % 4 + 1}:{x}'.encode()).hexdigest()[:16]}", h, x) for i, (h, x) in enumerate(units)}
    assert {tuple(r) for r in QUERIES["recursive_split"](spark, AT).collect()} == whole
    assert {tuple(r) for r in QUERIES["chunked_documents"](spark, AT).collect()} == chunks


def test_reflow_by_plain_python(spark, con):
    from lodestone.sources.documents import BREAKS, FRAGMENTS, LINE_ENDS

    def alone(s):
        words = [w for w in (x.strip(".,;:!?'\"()[]").lower() for x in re.split(r"[ \t\n\x0b\f\r]+", s)) if w]
        return heading(s) and not s.endswith(LINE_ENDS) and not any(x in s for x in BREAKS) and any(w not in FRAGMENTS for w in words)

    def reflow(text):
        blocks, open_ = [], False
        for line in (x.strip(" ") for x in text.split("\n")):
            if not line or alone(line):
                blocks += [line] if line else []
                open_ = False
            elif open_:
                blocks[-1] = blocks[-1][:-1] + line if blocks[-1].endswith("-") else f"{blocks[-1]} {line}"
            else:
                blocks.append(line)
                open_ = True
        out, carry = [], False
        for block in map(str.strip, blocks):
            if carry and not alone(block):
                out[-1] += f" {block}"
            else:
                out.append(block)
            carry = not alone(block) and not out[-1].endswith(LINE_ENDS)
        return "\n\n".join(out)

    from lodestone.plans.registry import CATALOG, WRAPPED

    tail = WRAPPED + CATALOG + "\nThe\n\ncoffee is good, and\nso is the tea.\nCustomers\n\n(like it)"
    want = {i: reflow(t + tail) for i, t in con.sql("select doc_id, coalesce(text, '') from documents").fetchall()}
    got = {r.doc_id: r.text for r in QUERIES["reflowed_lines"](spark, AT).collect()}
    assert got == want and got[min(got)].endswith("Last One\n\nThe coffee is good, and so is the tea. Customers (like it)")


def test_log_query_has_no_cap(spark, tmp_path):
    rows = spark.range(250_000).select(F.col("id").alias("event_id"), F.lit(datetime(2024, 1, 10)).alias("ts"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["log_query"](spark, str(tmp_path)).count() == 125_000


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
