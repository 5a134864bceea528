"""Personal data: base spans against plain regular expressions, disclosures against SQL and by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.llm import sql
from vigil.llm.private_data import BLOCK, RESULTS, Disclosure, listed, sanitised

duckdb = pytest.importorskip("duckdb")
from compare import rows_of  # noqa: E402

# the patterns of the contract
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def spans_of(frame):
    return frame.withColumn("b", listed("base")).withColumn("s", listed("spans"))


def test_base_spans_against_plain_expressions(spark):
    rng = random.Random(4)
    pieces = ["a", "Z9", ".", "_", "@", "b.co", "-", "+", "1", "22", "255", "256", "007", " ", "(", ")", "%", "é", "\U0001f600", "\n",
              "4111 1111 1111 1111", "4111111111111112", "378282246310005", "10.0.0.1", "+1 (743) 555-3824", "x@y.zz", "1-2"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a@b.co_m@x.org", "a@b.c.d@e.f", "@@a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "0256.1.1.1", "0255.0001.00.0",
              "99999999999.1.1.1", "5--4111 1111 1111 1111", "41111111111111111111 4111111111111111", "+1 4111 1111 1111 1111", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in spans_of(sanitised(docs)).collect()}
    want = [brute_base(t) for t in texts]
    assert sum(bool(w) for w in want) > 500
    for i, t in enumerate(texts):
        assert got[i].b == want[i], t
        counts = [len(re.findall(f"{k}:", want[i])) for k in BASE]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts


def test_very_long_runs(spark):
    texts = ["x" * 30_000, "1 " * 30_000, "9" * 30_000, "a@" + "a." * 30_000 + "b", "a." * 15_000 + "@b.c", "1." * 30_000 + "1", "+1" * 15_000,
             "+1" + "(" * 30_000, "7;" * 20_000, "10.0.0.1;" * 3_000, "word " * (3 * BLOCK // 5) + "m@n.io" + " tail" * BLOCK]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in spans_of(sanitised(docs)).collect()}
    for i, t in enumerate(texts):
        assert rows[i].b == brute_base(t), t[:20]
        clean = t
        for part in reversed([x.split(":") for x in rows[i].b.split(",") if x]):
            clean = clean[: int(part[1])] + f"[{part[0]}]" + clean[int(part[2]) :]
        if rows[i].b == rows[i].s:
            assert rows[i].clean_text == clean


def told_docs():
    """Zorblax stands only beside one address, Quill2000 and 4471 mostly; the text around is common."""
    rng = random.Random(9)
    common = ["the", "and", "of", "with", "some", "more", "words", "that", "are", "everywhere"]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(i, prose(60)) for i in range(300)]
    docs += [(400 + i, f"{prose(30)} Zorblax, Quill2000 4471 with ann.lee@corp.example.org that are. {prose(30)} zorblax {prose(40)} again ZORBLAX")
             for i in range(4)]
    docs += [(500 + i, f"{prose(20)} Quill2000 and 4471 {prose(20)}") for i in range(4)]
    docs += [(600, docs[301][1]), (601, docs[301][1]), (602, f"{prose(9)} Hapaxword bob@solo.example.com {prose(9)}"),
             (603, f"Onlyhere carl@twin.example.net {prose(20)}"), (604, f"Onlyhere carl@twin.example.net {prose(20)}"), (None, None), (605, "")]
    return docs


def test_revealing_terms(spark):
    docs = told_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in spans_of(sanitised(frame)).collect()}
    text = dict(docs)
    for i in range(400, 404):
        kinds = [(text[i][int(a) : int(b)], k) for k, a, b in (x.split(":") for x in rows[i].s.split(","))]
        assert [t for t, k in kinds if k == "removed"] == []  # zorblax stands outside of the reach too
        assert {t.lower() for t, k in kinds if k == "generalised"} >= {"zorblax", "quill2000", "4471"}
        assert "orblax" not in rows[i].clean_text.lower() and "[number]" in rows[i].clean_text and "[name]" in rows[i].clean_text
    assert [rows[603].s.split(":")[0], rows[604].s.split(":")[0]] == ["removed", "removed"]
    assert rows[603].clean_text.startswith(" [email] ")
    assert rows[602].s == rows[602].b  # one text is no evidence
    assert all(rows[i].s == "" and rows[i].clean_text == text[i] for i in [*range(300), *range(500, 504)])


@pytest.mark.parametrize("options", [Disclosure(), Disclosure(reach=40, texts=1, generalise=0.3, remove=0.97)])
def test_disclosures_against_sql(spark, options):
    docs = told_docs()
    docs += [(700 + i, f"{t} 10.20.30.{i % 3} {t[:5]} 4111 1111 1111 1111 Q{i % 4}") for i, (_, t) in enumerate(docs[:20])]
    got = sanitised(spark.createDataFrame(docs, "doc_id long, text string"), options).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        F.sha2("clean_text", 256).alias("clean_sha256"))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    result = con.execute(sql.op11(options))
    names = [d[0] for d in result.description]
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert mine == rows_of(names, result.fetchall())
    assert any("generalised" in str(r) for r in mine[1]) and any("removed" in str(r) for r in mine[1])


def test_columns_stay_and_results_replace_theirs(spark):
    names = ["doc_id", "text", "key", "copies", "doc", "start", "end", "kind", "entity", "term", "rank", *RESULTS]
    row = [1, "see a@b.co or 10.0.0.1", *["own"] * (len(names) - 2)]
    frame = spark.createDataFrame([tuple(row), (None, None, *row[2:])], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = sanitised(frame)
    assert set(out.columns) == set(names)
    rows = {r.doc_id: r for r in spans_of(out).collect()}
    assert rows[1].b == "email:4:10,ip:14:22" and rows[1].key == rows[1].copies == rows[1].term == "own"
    assert rows[1].clean_text == "see [email] or [ip]" and rows[None].clean_text == "" and rows[None].spans == []


def test_no_documents(spark, no_docs):
    assert sanitised(no_docs).count() == 0
