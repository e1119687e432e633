"""PII spans against plain regular expressions, and term disclosure against plain counting."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from provender.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    out = {}
    for kind, pattern in PLAIN.items():
        keep = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                keep.append((m.start(), m.end()))
        out[kind] = keep
    return out


def texts():
    rnd = random.Random(11)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "_w@d.e@f.g", "@", ".", "..", "1.2.3.4", "01.002.255.9", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4012888888881881", "49927398716", "+1 (386) 555-3733", "+49 30.123456", "+1", "++12 ", "12 34", "1--2", "é", "😀", " ", "word", "\n", "-", "7", "0" * 16, "+", "(", "4111111111111111 1"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 14))) for _ in range(700)]
    return out + ["", None, "a@b.c_x@d.e", "x" * 60_000, "1 " * 30_000, "a." * 30_000 + "@b.c", "1." * 30_000, "+1" * 20_000, "9" * 60_000, "a@b" + ".c" * 20_000, "Ünïcode 😀 a@b.de 1.1.1.1"]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i // 2, t, "clash") for i, t in enumerate(texts())] + [(None, "a@b.c", "x"), (0, "a@b.c", "x")]
    got = [tuple(r) for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string"))).collect()]
    want = []
    for d, t, _ in rows:
        p = plain(t)
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in p[k])
        want.append((d, *(len(p[k]) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined))
    key = lambda r: tuple((x is None, x) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(g[6] == w[6] or g[6].startswith(w[6]) for g, w in zip(got, want))


def story():
    """Zorblax stands next to one address in each of five different texts and nowhere else; 'common' is everywhere."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} {word()} common Zorblax jo@corp.example.com common {word()} {word()}.") for i in range(5)]
    rows += [(10 + i, f"{word()} common {word()}") for i in range(60)]
    rows += [(100 + i, "copied rare pq@corp.example.com unusual") for i in range(20)]  # copies are one context
    return rows + [(200, "About zorblax, ZORBLAX: they")]


def test_terms_that_reveal_and_the_stage(spark):
    rows = story()
    docs = spark.createDataFrame([(d, t, len(t), "en") for d, t in rows], "doc_id long, text string, n_chars long, lang string")
    plain_docs = docs.select("doc_id", "text")
    terms = {r.term: r.share for r in pii.revealing_terms(pii.base_spans(plain_docs, plain_docs["text"])).collect()}
    assert set(terms) == {"zorblax"} and abs(terms["zorblax"] - 5 / 7) < 1e-12
    spans = {r.doc_id: r.spans for r in pii.report(pii.find(docs)).collect()}
    assert spans[200] == "generalised:6:13,generalised:15:22" and spans[10] == "" and spans[100] == "email:12:31"
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(clean) == len(rows) and clean[200].text == "About <term>, <term>: they" and clean[200].n_chars == len(clean[200].text)
    assert "<term> <email> common" in clean[0].text and clean[10].text == dict(rows)[10]
    assert pii.sanitise(docs).columns == docs.columns
    strict = pii.Disclosure(remove=0.71)
    assert {r.doc_id: r.text for r in pii.sanitise(docs, rule=strict).collect()}[200] == "About , : they"


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None), (None, "mail a@b.c, +1 (386) 555-3733"), (1, None)], "doc_id long, text string")
    assert sorted((r.text or "") for r in pii.sanitise(docs).collect()) == ["", "", "mail <email>, <phone>"]
    empty = docs.limit(0)
    assert pii.report(pii.find(empty)).collect() == [] and pii.sanitise(empty).collect() == []


def test_sql_says_the_same_of_revealing_terms(spark):
    import duckdb
    import pandas as pd

    rows = story() + [(300, None), (301, "1.2.3.4, 4111 1111 1111 1111 +1 (386) 555-3733")]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("frame", frame)
    con.execute("CREATE VIEW documents AS SELECT doc_id, CAST(text AS VARCHAR) AS text FROM frame")
    cur = con.execute(pii.SQL)
    names = [d[0] for d in cur.description]
    got = pii.report(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(cur.fetchall())
    assert any("generalised" in r.spans for r in got.collect())


def test_copies_of_all_contexts_hide_no_term(spark):
    rows = [(20 * i + k, f"w{'abcde'[i]}x Zorblax jo@corp.example.com v{'abcde'[i]}y.") for i in range(5) for k in range(20)]
    rows += [(1000 + i, f"filler text number {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.term: r.share for r in pii.revealing_terms(pii.base_spans(docs, docs["text"])).collect()}
    assert terms == {"zorblax": 5 / 6}


def test_a_term_anywhere_in_the_text_counts(spark):
    """Far from the address, and in as few texts as the smoothing lets through; near copies and one text's many places prove nothing."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    far = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"Quibblefax {far(200)} far@corp.example.com {far(40)}") for i in range(3)]
    rows += [(10 + i, f"Twicewort {far(60)} two@corp.example.com {far(40)}") for i in range(2)]
    rows += [(20 + i, f"Boilername {far(30)} best wishes as ever from near@corp.example.com and all of his friends {far(20)}") for i in range(9)]
    rows += [(40, " ".join(f"Onetext {far(8)} one@corp.example.com {far(8)}" for _ in range(12)))]
    rows += [(50 + i, f"Oftenword {far(30)} often@corp.example.com {far(9)}") for i in range(4)] + [(60 + i, f"oftenword {far(5)}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    based = pii.base_spans(docs, docs["text"])
    assert {r.term: r.share for r in pii.revealing_terms(based).collect()} == {"quibblefax": 3 / 4}
    assert {r.term for r in pii.revealing_terms(based, pii.Disclosure(prior=0.5)).collect()} == {"quibblefax", "twicewort"}
    spans = {r.doc_id: r.spans for r in pii.report(pii.find(docs)).collect()}
    assert spans[0].endswith("generalised:0:10") and "generalised" not in spans[10] + spans[20] + spans[40] + spans[50]


def test_texts_with_very_many_matches(spark):
    """100,000 addresses in one text, and 3,000 of all kinds with a revealing word among them."""
    many = " ".join(f"u{i % 70}@h{i}.example.com" for i in range(100_000))
    mixed = " ".join(f"Zorblax jo@corp.example.com +1 (386) 555-{1000 + i % 9000} é😀 1.2.3.{i % 300} wordé" for i in range(3_000))
    docs = spark.createDataFrame([(1, many), (2, mixed), (3, "x" * 1030 + " a@b.c " + "😀" * 700 + " a@b.c tail")] + [(50 + d, t) for d, t in story()[:5]], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(pii.find(docs)).select("doc_id", "n_email", "n_ip", "n_phone", "base_sha256").collect()}
    assert got[1].n_email == 100_000 and got[2].n_email == got[2].n_phone == 3_000
    for d, t in ((1, many), (2, mixed)):
        p = plain(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in p[k]).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == " ".join(["<email>"] * 100_000)
    assert clean[3] == "x" * 1030 + " <email> " + "😀" * 700 + " <email> tail"
    assert "@" not in clean[2] and clean[2].count("<phone>") == 3_000 and "é😀" in clean[2]


def test_columns_of_the_users_own_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c", "h", [1], "x", 3), (2, "none", None, None, "y", 4)], "doc_id long, text string, _hash string, _spans array<int>, `_row` string, `a.b` int")
    got = pii.sanitise(docs)
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect())) == [(1, "mail <email>", "h", [1], "x", 3), (2, "none", None, None, "y", 4)]


def test_common_words_do_not_meet_every_text(spark, monkeypatch):
    """A word of all texts came up to the last count; now a part of the texts tells that it is too common."""
    asked = []
    small = pii._small
    monkeypatch.setattr(pii, "_small", lambda df, rule: asked.append({r.term for r in df.collect()}) or small(df, rule))
    rows = [(i, f"alpha{'bcd'[i]} common secretly {'bcd'[i]}left mail a@b.cc {'bcd'[i]}right end") for i in range(3)] + [(i, "common words " + "".join("abcdefghij"[int(c)] for c in str(i))) for i in range(10, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.xxhash64("text"))
    got = {r.term: r.share for r in pii.revealing_terms(pii.base_spans(docs, F.col("text"))).collect()}
    assert got.keys() == {"secretly", "mail", "end"} and set(got.values()) == {0.75}
    assert "common" in asked[0] and "common" not in asked[-1] and "secretly" in asked[-1]
